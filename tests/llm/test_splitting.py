from factloom.llm.splitting import cuts, pieces


def test_pieces_are_whole_bounded_and_overlap():
    for text in ["", "ab", "word " * 3000, "x" * 9001, "Satz eins.\n\nSatz zwei. " * 700, "।क्षि " * 2000, "a\r\n" * 4000]:
        spans = cuts(text, 400, 20)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(e - s <= 400 for s, e in spans)
        assert all(b[0] == a[1] - 20 and b[1] > a[1] for a, b in zip(spans, spans[1:]))


def test_strongest_boundary_wins_and_none_is_a_full_piece():
    text = "a" * 250 + "\n\n" + "b" * 50 + ". " + "c " * 200
    assert cuts(text, 400, 20)[0] == (0, 252)
    assert cuts("x" * 1000, 400, 20)[0] == (0, 400)
    assert cuts("y" * 50 + " " + "x" * 1000, 400, 20)[0] == (0, 51)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab " * 10)], "id bigint, text string")
    got = sorted((r.page_id, r.piece_no, r.piece) for r in pieces(df, 20, 5).collect())
    assert got[:2] == [(1, 0, None), (2, 0, "")] and len([g for g in got if g[0] == 3]) == 2


def test_a_space_is_weaker_than_a_line():
    text = "a" * 250 + "\n" + "b " * 300
    assert cuts(text, 400, 20)[0] == (0, 251)
