"""Spellings of the names of persons and organisations, linked where they name the same one.

What identifies a name is one of its words, a surname or a brand; the rest (given names, the line of
business) tells relatives and subsidiaries apart.  The steps:

1. Words of all distinct names are joined within an edit radius of one by metric-space partitioning:
   a bounded sample of pivots, the unrestricted Damerau-Levenshtein distance (a true metric, a swap
   is one edit), each word homed at its nearest pivot.  If x is homed at p, y at q and d(x,y) <= r,
   then (d(x,q) - d(x,p)) + (d(y,p) - d(y,q)) <= 2r by the triangle inequality, so one of the two gaps
   is at most r: a word is replicated to every cell whose pivot is at most r farther than its home,
   and each pair meets in a cell.  Inside a cell, pairs are found by the words' single deletions, an
   exact filter for one edit, as an equi-join on (cell, deletion), and decided by the metric; no cell
   has to fit one task.
2. A name's identifying words are the ones that are rarest with their neighbours, for their length.
3. Rarer spellings of identifying words follow their most frequent neighbour up to one without any.
4. A name goes to the block, of an identifying word and the initials in the rest, that has most rows.
5. Names of a block are compared: abbreviations, initials, nicknames, vowel-less and joined words,
   typing errors.  Names of one entity are linked.

Null, empty and nobody's names ("the Company", a dash) are linked to none.  Repeated names count as
one spelling with their frequency.  An empty table gives no pairs.  Names may be of any length; words
over 64 letters are compared for equality only.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.canonical import _consonants, _within
from factloom.session import cut

#: at most so many words are taken as pivots; the sample only shapes the cells, every word is compared
PIVOTS = 64
RADIUS = 1
LONGEST, SHORTEST = 64, 5
#: words up to so many times as common as a name's rarest are tried as its identifying word too
NEARLY = 10.0

# ---- fixed values ----
LEGAL = frozenset(
    "limited ltd lmt private pvt p corporation corp incorporated incorp inc gmbh mbh plc llc llp ag sa co company companies ms the of and group holding issuer".split()
)
TITLES = frozenset("mr mrs miss dr prof professor shri smt sri sir".split())
#: words of a state's name that don't tell it from another
STATE = frozenset("republic rep economy government govt state kingdom".split())
NICKNAMES = {
    "alexander": "alex sandy xander al", "benjamin": "ben benny benji", "catherine": "cathy cate kate katie cat", "charles": "charlie chuck",
    "christopher": "chris kit", "daniel": "dan danny", "edward": "ed eddie ned ted", "elizabeth": "liz beth lizzie eliza betty lisa",
    "frederick": "fred freddie freddy", "gregory": "greg", "harold": "harry hal", "henry": "hank harry", "isabella": "izzy bella isa", "james": "jim jimmy",
    "john": "jack johnny", "joseph": "joe joey", "kenneth": "ken kenny", "leonard": "len lenny leo", "margaret": "maggie meg peggy greta",
    "michael": "mike mick", "nicholas": "nick nicky", "olivia": "liv ollie livvy", "patricia": "pat trish patty tricia", "richard": "rick dick rich",
    "robert": "rob bob bobby robbie", "samuel": "sam sammy", "susan": "sue susie", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "victoria": "vicky tori vic", "william": "bill will billy willie liam",
}
# ---- end of fixed values ----
GIVEN_OF: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _n in _short.split():
        GIVEN_OF.setdefault(_n, set()).add(_full)

_WORD = re.compile(r"[^\W_]+")


def words(name: str) -> list[str]:
    """The words of a name in order, without legal forms and titles."""
    text = unicodedata.normalize("NFKC", name).casefold().replace("m/s", " ").replace("g.m.b.h", "gmbh").replace("'", "").replace("’", "")
    out = [w for w in _WORD.findall(text) if w not in TITLES and (len(w) == 1 or w not in LEGAL)]
    # a lone letter in brackets or beside Limited is a legal form, as in (P) Limited
    if re.search(r"\(p\)\s*l", text) and "p" in out:
        out.remove("p")
    return out


def distances(texts: list[str], pivot: str) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of many words to one, computed for all at once."""
    n, m = len(texts), len(pivot)
    if not n:
        return np.zeros(0, dtype=np.int32)
    length = np.array([len(t) for t in texts])
    size = int(length.max()) if n else 0
    codes = np.zeros((size, n), dtype=np.int64)
    for k, t in enumerate(texts):
        codes[: len(t), k] = [ord(c) for c in t]
    far, every = m + size, np.arange(n)
    d = np.full((m + 2, size + 2, n), far, dtype=np.int32)
    d[1, 1:, :] = np.arange(size + 1)[:, None]
    d[1:, 1, :] = np.arange(m + 1)[:, None]
    last_row: dict[int, int] = {}
    for i in range(1, m + 1):
        mine = ord(pivot[i - 1])
        last_col = np.zeros(n, dtype=np.int64)
        for j in range(1, size + 1):
            other = codes[j - 1]
            row = np.zeros(n, dtype=np.int64)
            for code, at in last_row.items():
                row[other == code] = at
            same = other == mine
            best = np.minimum(np.minimum(d[i, j] + ~same, d[i + 1, j] + 1), d[i, j + 1] + 1)
            swapped = d[row, last_col, every] + (i - row - 1) + 1 + (j - last_col - 1)
            d[i + 1, j + 1] = np.where((row > 0) & (last_col > 0), np.minimum(best, swapped), best)
            last_col[same] = j
        last_row[mine] = i
    return d[m + 1, length + 1, every]


def near(a: str, b: str) -> bool:
    """Whether the metric's distance is at most one: an insertion, deletion, substitution or swap."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, other) of all words at most one edit apart, both ways, without a word and itself."""
    pool = vocabulary.filter(F.length("word").between(SHORTEST, LONGEST)).select("word")
    # a bounded sample: the words with the smallest hashes
    pivots = [r.word for r in pool.orderBy(F.xxhash64("word"), "word").limit(PIVOTS).collect()]
    if not pivots:
        return pool.select("word", F.col("word").alias("other")).limit(0)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                texts = batch.column(0).slice(start, 4096).to_pylist()
                table = np.stack([distances(texts, p) for p in pivots])
                cell, word = np.nonzero(table <= table.min(axis=0) + RADIUS)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array([texts[k] for k in word], pa.string())], names=["cell", "word"])

    in_cells = _spread(pool, "word").mapInArrow(cells, "cell int, word string")
    # the word itself and each of it without one letter; two words one edit apart share one of these
    keys = F.expr("array_distinct(transform(sequence(0, length(word)), i -> xxhash64(concat(left(word, i - 1), if(i = 0, word, substring(word, i + 1))))))")
    keyed = in_cells.select("cell", "word", F.explode(keys).alias("key"))
    pair = keyed.join(keyed.withColumnRenamed("word", "other"), ["cell", "key"]).filter("word < other").select("word", "other").distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    one_way = pair.filter(close("word", "other"))
    both = F.explode(F.array(F.struct(F.col("word").alias("word"), F.col("other").alias("other")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"))))
    return one_way.select(both.alias("x")).select("x.*")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys over all partitions: few bytes can be much work here, so they aren't to be put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _signatures(rest: list[str]) -> list[str]:
    """The initials of the rest: of the given name, which a nickname may be of several, or of all words of a line of business."""
    rest = [w for w in rest if w not in STATE]
    full = [w for w in rest if len(w) > 1]
    if len(full) == 1:
        return sorted({w[0] for w in GIVEN_OF.get(full[0], ())} or {full[0][0]})
    if full:
        return ["".join(sorted({w[0] for w in full}))]
    return sorted({"".join(rest[:1]), "".join(sorted(set(rest)))})


def _rest(ws: list[str], core: str) -> list[str]:
    ws = list(ws)
    ws.remove(core)
    return ws


def _singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") else word.removesuffix("s")


def _same_word(a: str, b: str) -> bool:
    """Whether two words of the rest may be the same one, as typed, shortened or as a nickname."""
    if a == b or (len(a) == 1 or len(b) == 1) and a[0] == b[0]:
        return True
    known_a, known_b = GIVEN_OF.get(a), GIVEN_OF.get(b)
    if known_a or known_b:
        if (known_a or set()) & (known_b or set()) or b in (known_a or ()) or a in (known_b or ()):
            return True
        if known_a and any(near(g, b) for g in known_a) or known_b and any(near(g, a) for g in known_b):
            return True
    if a in NICKNAMES and b in NICKNAMES:
        return False
    short, long = sorted((a, b), key=len)
    if _singular(a) == _singular(b):
        return True
    if len(short) >= 4 and near(a, b) or len(short) >= 7 and abs(len(a) - len(b)) < 2 and near(_consonants(a), _consonants(b)):
        return True
    if long in NICKNAMES:
        return False
    return short[0] == long[0] and len(short) >= 2 and (long.startswith(short) or (len(short) <= 5 and _within(short, long) and not set(short[1:]) & set("aeiou")))


def compatible(a: list[str], b: list[str]) -> bool:
    """Whether two rests can belong to the same name."""
    a, b = ([w for w in x if w not in STATE] for x in (a, b))
    full_a, full_b = ([w for w in x if len(w) > 1] for x in (a, b))
    letters_a, letters_b = ([w for w in x if len(w) == 1] for x in (a, b))
    if not a or not b:
        return not a and not b
    if len(full_a) <= 1 and len(full_b) <= 1:  # a given name and initials, or initials alone
        lead_a, lead_b = (full_a or letters_a[:1])[0], (full_b or letters_b[:1])[0]
        more_a, more_b = letters_a[0 if full_a else 1 :], letters_b[0 if full_b else 1 :]
        initials_a = {g[0] for g in GIVEN_OF.get(lead_a, {lead_a})} | {lead_a[0]}
        initials_b = {g[0] for g in GIVEN_OF.get(lead_b, {lead_b})} | {lead_b[0]}
        lead = bool(initials_a & initials_b) if min(len(lead_a), len(lead_b)) == 1 else _same_word(lead_a, lead_b)
        return lead and (not more_a or not more_b or more_a[0] == more_b[0])
    if "".join(a) == "".join(b) or near("".join(sorted(full_a)), "".join(sorted(full_b))) or near("".join(a), "".join(b)):
        return True
    short, long = sorted((a, b), key=len)
    left = list(long)
    for w in sorted(short, key=len, reverse=True):
        match = next((x for x in sorted(left, key=lambda x: (x != w, not near(x, w), x)) if _same_word(x, w)), None)
        if match is None:
            return False
        left.remove(match)
    return not left


def entities(block: list[tuple[str, int, list[str]]]) -> list[int]:
    """A number of the entity of each (name, frequency, rest) of one block.

    Rests are taken with the fuller and more frequent ones first; each joins the first entity whose
    rests so far it is all compatible with, or begins one.
    """
    forms: dict[tuple[str, ...], int] = {}
    for _, n, rest in block:
        forms[tuple(rest)] = forms.get(tuple(rest), 0) + n
    order = sorted(forms, key=lambda f: (not any(len(w) > 1 for w in f), -forms[f], f))
    groups: list[list[tuple[str, ...]]] = []
    number: dict[tuple[str, ...], int] = {}
    for form in order:
        # the leading spelling decides; of the others none may have another middle initial
        at = next((k for k, g in enumerate(groups) if compatible(list(g[0]), list(form)) and not any(_middles_differ(x, form) for x in g)), len(groups))
        if at == len(groups):
            groups.append([])
        groups[at].append(form)
        number[form] = at
    return [number[tuple(rest)] for _, _, rest in block]


def _middles_differ(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    def middle(x):
        full = [w for w in x if len(w) > 1]
        letters = [w for w in x if len(w) == 1]
        return None if len(full) > 1 else (letters[0:1] if full else letters[1:2])

    p, q = middle(a), middle(b)
    return bool(p and q and p != q)


def spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n) of the distinct names in some columns, with how often they stand there."""
    parts = [df.select(F.col(f"`{c}`").cast("string").alias("name")) for c in columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.filter("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def entity_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, entity) of every distinct name that names somebody; entity is one spelling's text and a number."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([words(x) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["name", "n", "words"])

    names = cut(spellings(df, columns).mapInArrow(parse, "name string, n bigint, words array<string>").filter("size(words) > 0"))
    used = names.select("n", F.explode(F.array_distinct("words")).alias("word")).filter((F.length("word") > 1) & ~F.col("word").isin(*STATE))
    vocabulary = used.groupBy("word").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n"))
    near_words = cut(neighbours(vocabulary))
    around = near_words.join(vocabulary.select(F.col("word").alias("other"), F.col("names").alias("o_names")), "other").groupBy("word").agg(F.sum("o_names").alias("o_names"))
    given = F.col("word").isin(*sorted({*NICKNAMES, *GIVEN_OF}))
    weight = (F.col("names") + F.coalesce("o_names", F.lit(0))) / F.pow(F.length("word"), F.lit(2)) * F.when(given, 1000).otherwise(1)
    weights = vocabulary.join(around, "word", "left").select("word", weight.alias("weight"))
    weighed = names.select("name", "n", "words", F.explode(F.array_distinct("words")).alias("word")).join(weights, "word")
    weighed = weighed.groupBy("name").agg(F.collect_list(F.struct("weight", "word")).alias("weighed"), F.first("n").alias("n"), F.first("words").alias("words"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, weighed, n, ws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = min(w["weight"] for w in weighed)
                for core in sorted(w["word"] for w in weighed if w["weight"] <= NEARLY * least):
                    out += [(name, core, n, sig, _rest(ws, core)) for sig in _signatures(_rest(ws, core))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], names=["name", "core", "n", "sig", "rest"])

    signed = cut(weighed.select("name", "weighed", "n", "words").mapInArrow(sign, "name string, core string, n bigint, sig string, rest array<string>"))
    heads = follow(signed.groupBy("core", "sig").agg(F.sum("n").alias("n")), near_words)
    placed = signed.join(heads, ["core", "sig"])
    blocks = placed.groupBy("head", "sig").agg(F.sum("n").alias("rows"))
    # of the words that may identify a name, the one with most rows; it stands in all spellings
    best = placed.join(blocks, ["head", "sig"]).groupBy("name").agg(F.max(F.struct("rows", "head", "sig", "n", "rest")).alias("b"))

    def resolve(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((name, int(n), list(rest)) for name, n, rest in zip(block["name"], block["n"], block["rest"], strict=True))
        return pd.DataFrame({"name": [r[0] for r in rows], "n": [r[1] for r in rows], "entity": [f"{key[0]}|{key[1]}|{k}" for k in entities(rows)]})

    return _spread(best.select("name", "b.head", "b.sig", "b.n", "b.rest"), "head", "sig").groupBy("head", "sig").applyInPandas(resolve, "name string, n bigint, entity string")


def follow(nodes: DataFrame, near_words: DataFrame) -> DataFrame:
    """(core, sig, head): each spelling of a core follows its most frequent neighbour, up to the top.

    A node points only to one with a larger (n, core), so there are no circles; pointers are doubled
    until none changes, which takes as many rounds as the logarithm of the longest chain.
    """
    other = nodes.select(F.col("core").alias("other"), "sig", F.col("n").alias("o_n"))
    best = nodes.join(near_words.withColumnRenamed("word", "core"), "core").join(other, ["other", "sig"])
    best = best.filter(F.struct("o_n", "other") > F.struct("n", "core")).groupBy("core", "sig").agg(F.max(F.struct("o_n", "other"))["other"].alias("head"))
    heads = cut(nodes.select("core", "sig").join(best, ["core", "sig"], "left").withColumn("head", F.coalesce("head", "core")))
    while True:
        up = heads.select(F.col("core").alias("head"), "sig", F.col("head").alias("above"))
        jumped = cut(heads.join(up, ["head", "sig"]).select("core", "sig", "above", (F.col("above") != F.col("head")).alias("moved")))
        heads = jumped.select("core", "sig", F.col("above").alias("head"))
        if not jumped.filter("moved").limit(1).count():
            return heads


def found(claims: DataFrame) -> DataFrame:
    """(name_a, name_b) of the different spellings of the same person or organisation."""
    named = entity_of(claims, ["subject", "org_scope"]).select("name", "entity")
    a, b = (named.withColumnRenamed("name", c) for c in ("name_a", "name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def linked(claims: DataFrame) -> DataFrame:
    """(name, n, entity, spellings) of every name: its frequency, its entity and how many spellings that has."""
    named = entity_of(claims, ["subject", "org_scope"])
    sizes = named.groupBy("entity").agg(F.count(F.lit(1)).alias("spellings"))
    return named.join(sizes, "entity").select("name", "n", "entity", "spellings")

