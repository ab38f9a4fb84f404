"""The claim-context graph, questions, and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import texts
from factloom.operators import similarity
from factloom.plans import ask, rank
from factloom.queries import Registry
from factloom.queries.corpus import _PREDICATE_KEY

QUERIES = Registry()
query = QUERIES.add
SEED, OTHER = "claim:1", "claim:2"

_NOISE = "[" + ", ".join(f"'{w}'" for w in rank.NOISE) + "]"
_LINKS = rf"""linked AS (SELECT DISTINCT claim, node, split_part(node, ':', 1) AS kind FROM (SELECT 'claim:' || id AS claim, unnest(list_concat(
    CASE WHEN document_id IS NOT NULL THEN ['doc:' || document_id] ELSE [] END, ['page:' || concat_ws('/', document_id, page_no)],
    CASE WHEN {_PREDICATE_KEY.format('predicate')} <> '' THEN ['metric:' || {_PREDICATE_KEY.format('predicate')}] ELSE [] END,
    CASE WHEN period_label IS NOT NULL THEN ['period:' || period_label] ELSE [] END,
    list_transform(list_filter(coalesce(map_entries(qualifiers), []), lambda e: e.value IS NOT NULL), lambda e: 'qual:' || e.key || '=' || e.value),
    list_transform(coalesce(unknown_qualifiers, []), lambda x: 'axis:' || x),
    list_transform(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(evidence_quote, ''), '([A-Za-z][A-Za-z''\-]{{2,}})', 1), lambda w: lower(w))), lambda w: NOT list_contains({_NOISE}, w)))[1:12], lambda w: 'term:' || w))) AS node FROM claims)),
    total AS (SELECT count(*)::DOUBLE AS t FROM claims),
    weights AS (SELECT node, count(*) AS n, greatest(0.05::DOUBLE, ln((SELECT t FROM total) / count(*))) AS weight FROM linked GROUP BY 1)"""
_EDGES = (
    _LINKS
    + """, oneway AS (SELECT claim AS a, l.node AS b, CASE kind WHEN 'doc' THEN 0.3::DOUBLE WHEN 'metric' THEN 1 WHEN 'period' THEN 0.8 WHEN 'page' THEN 0.9 WHEN 'qual' THEN 1 WHEN 'axis' THEN 0.4 ELSE 0.5 END * weight AS w FROM linked l JOIN weights USING (node)
        UNION ALL SELECT q.node, 'axis:' || regexp_extract(q.node, '^qual:([^=]*)=', 1), q.n * coalesce(x.weight, ln((SELECT t FROM total))) FROM weights q LEFT JOIN weights x ON x.node = 'axis:' || regexp_extract(q.node, '^qual:([^=]*)=', 1) WHERE q.node LIKE 'qual:%'),
    edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM oneway UNION ALL SELECT b, a, w FROM oneway) GROUP BY 1, 2)"""
)


@query(f"WITH {_LINKS} SELECT node, n, round(weight, 6) AS weight FROM weights", "claims")
def idf_weights(claims: DataFrame) -> DataFrame:
    """How rare everything is that claims are linked to."""
    return rank.rarity(rank.links(claims), claims.count()).select("node", "n", F.round("weight", 6).alias("weight"))


@query(f"WITH {_EDGES} SELECT split_part(src, ':', 1) AS kind_a, split_part(dst, ':', 1) AS kind_b, count(*) AS edges, round(sum(w), 3) AS weight FROM edges GROUP BY 1, 2", "claims")
def graph_edges(claims: DataFrame) -> DataFrame:
    """The graph's links by what they join."""
    kind = lambda c: F.element_at(F.split(c, ":"), 1)
    return rank.edges(claims).groupBy(kind("src").alias("kind_a"), kind("dst").alias("kind_b")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 3).alias("weight"))


@query(
    f"""WITH {_EDGES}, h1 AS (SELECT DISTINCT dst AS node FROM edges WHERE src = '{SEED}'), h2 AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (SELECT node FROM h1) AND dst NOT IN (SELECT node FROM h1) AND dst <> '{SEED}')
        SELECT hop, count(*) AS nodes FROM (SELECT 0 AS hop UNION ALL SELECT 1 FROM h1 UNION ALL SELECT 2 FROM h2) GROUP BY 1""",
    "claims",
)
def graph_neighbourhood(claims: DataFrame) -> DataFrame:
    """How many nodes lie one and two links from a claim."""
    seeds = claims.sparkSession.createDataFrame([(SEED,)], "node string")
    return rank.neighbourhood(rank.edges(claims), seeds, 2).groupBy("hop").agg(F.count(F.lit(1)).alias("nodes"))


def _walk_sql(iterations: int) -> str:
    out = f", shares AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM edges), r0 AS (SELECT seed, seed AS node, 1.0::DOUBLE AS rank FROM (VALUES ('{SEED}'), ('{OTHER}')) s(seed))"
    for k in range(1, iterations + 1):
        out += f", r{k} AS (SELECT seed, node, sum(rank) AS rank FROM (SELECT seed, dst AS node, 0.85::DOUBLE * sum(rank * share) AS rank FROM r{k - 1} JOIN shares ON src = node GROUP BY 1, 2 UNION ALL SELECT seed, seed, 0.15::DOUBLE FROM r0) GROUP BY 1, 2)"
    return out


@query(f"WITH {_EDGES}{_walk_sql(4)} SELECT seed, node, round(rank, 9) AS rank FROM r4 WHERE rank >= 0.001", "claims")
def ppr_fixed_iters(claims: DataFrame) -> DataFrame:
    """What two claims' walks of four steps come by most."""
    return _walk(claims).filter("rank >= 0.001").select("seed", "node", F.round("rank", 9).alias("rank"))


def _walk(claims: DataFrame) -> DataFrame:
    seeds = claims.sparkSession.createDataFrame([(SEED, SEED), (OTHER, OTHER)], "seed string, node string")
    return rank.personalized(rank.edges(claims), seeds, iterations=4)


@query(
    f"""WITH {_EDGES}{_walk_sql(4)}, x AS (SELECT substring(a.node, 6) AS axis, a.rank AS ra, b.rank AS rb FROM r4 a JOIN r4 b ON a.node = b.node AND a.seed = '{SEED}' AND b.seed = '{OTHER}' WHERE a.node LIKE 'axis:%'),
        y AS (SELECT axis, least(ra, rb) AS connection, abs(ra - rb) / (ra + rb) AS divergence FROM x)
        SELECT axis, round(connection, 9) AS connection, round(divergence, 6) AS divergence, round(connection * (0.25 + 0.75 * divergence), 9) AS score FROM y ORDER BY connection * (0.25 + 0.75 * divergence) DESC, axis LIMIT 6""",
    "claims",
)
def rank_pair_axes(claims: DataFrame) -> DataFrame:
    """The axes that may explain a difference between two claims; the limit is the report's."""
    ranks = _walk(claims)
    best = rank.pair_axes(ranks.filter(F.col("seed") == SEED), ranks.filter(F.col("seed") == OTHER))
    return best.select("axis", F.round("connection", 9).alias("connection"), F.round("divergence", 6).alias("divergence"), F.round("score", 9).alias("score"))


@query(
    """WITH c AS (SELECT a.vec_id AS query, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 12) DESC, other) AS rank FROM c WHERE cos >= 0.1) SELECT query, rank, other, round(cos, 6) AS cos FROM r WHERE rank <= 5""",
    "embeddings",
)
def cosine_topk(embeddings: DataFrame) -> DataFrame:
    """The five vectors most similar to each fiftieth one."""
    return similarity.top_k(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0), floor=0.1).select("query", "rank", "other", F.round("cos", 6).alias("cos"))


_CONTEXT = """array_to_string(list_sort(list_transform(list_filter(list_concat(list_filter(coalesce(map_entries(qualifiers), []), lambda e: e.key <> 'modality' AND e.value IS NOT NULL), [{'key': 'modality', 'value': nullif(modality, '')}]),
    lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || e.value)), '; ')"""


@query(
    f"""WITH r AS (SELECT subject, predicate, coalesce(period_label, period_raw, '') AS period, coalesce(unit_dimension, '') AS dimension, {_CONTEXT} AS context,
        CASE WHEN claim_type = 'measurement' THEN value_num * coalesce(unit_scale, 1.0) END AS v, lower(trim(value_text)) AS t FROM claims),
        g AS (SELECT subject, predicate, period, dimension, context, count(*) AS claims, CASE WHEN max(abs(v)) > 0 THEN (max(v) - min(v)) / max(abs(v)) ELSE 0 END AS spread, count(DISTINCT t) AS texts FROM r GROUP BY ALL)
        SELECT dimension, spread > 0.01 OR texts > 1 AS incoherent, count(*) AS contexts, sum(claims)::BIGINT AS claims FROM g GROUP BY 1, 2""",
    "claims",
)
def ask_incoherent(claims: DataFrame) -> DataFrame:
    """Contexts in which answers don't go together, by dimension."""
    return ask.contexts(claims).groupBy("dimension", "incoherent").agg(F.count(F.lit(1)).alias("contexts"), F.sum("claims").alias("claims"))


@query(
    """WITH r AS (SELECT subject, predicate, list_filter(list_concat(list_filter(coalesce(map_entries(qualifiers), []), lambda e: e.key <> 'modality' AND e.value IS NOT NULL), [{'key': 'modality', 'value': nullif(modality, '')}]), lambda e: e.value IS NOT NULL) AS m FROM claims),
       n AS (SELECT subject, predicate, count(*) AS total FROM r GROUP BY 1, 2), x AS (SELECT subject, predicate, unnest(m).key AS axis, unnest(m).value AS value FROM r),
       y AS (SELECT subject, predicate, axis, count(DISTINCT value) AS stated, count(*) AS n FROM x GROUP BY ALL)
       SELECT y.subject, y.predicate, axis, stated + CASE WHEN n < total THEN 1 ELSE 0 END AS n_values FROM y JOIN n ON n.subject IS NOT DISTINCT FROM y.subject AND n.predicate IS NOT DISTINCT FROM y.predicate WHERE stated + CASE WHEN n < total THEN 1 ELSE 0 END > 1""",
    "claims",
)
def ask_axes(claims: DataFrame) -> DataFrame:
    """The axes on which the answers about one thing differ."""
    return ask.distinguishing(claims)


@query(
    rf"""WITH p AS (SELECT document_id, page_no, min_by(text, id) AS text FROM filing_pages WHERE page_no IN (0, 1) GROUP BY 1, 2),
        w AS (SELECT document_id, page_no, list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z][A-Za-z''\-]{{2,}})', 1), lambda w: lower(w))), lambda w: NOT list_contains({_NOISE}, w)) AS words FROM p),
        ab AS (SELECT a.document_id, greatest(len(list_intersect(a.words, b.words)), 1) AS shared, list_filter(a.words, lambda x: NOT list_contains(b.words, x)) AS oa, list_filter(b.words, lambda x: NOT list_contains(a.words, x)) AS ob
            FROM w a JOIN w b ON a.document_id = b.document_id AND a.page_no = 0 AND b.page_no = 1),
        s AS (SELECT document_id, unnest(oa) AS word, 1.0::DOUBLE / (1 + len(oa)::DOUBLE / shared) AS score, 0 AS side FROM ab UNION ALL SELECT document_id, unnest(ob), 1.0::DOUBLE / (1 + len(ob)::DOUBLE / shared), 1 FROM ab)
        SELECT document_id, word, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, side, word) AS r FROM s) WHERE r <= 12""",
    "filing_pages",
)
def local_terms(pages: DataFrame) -> DataFrame:
    """The words that tell a document's first page from its second; twelve are kept, as for a shortlist."""
    one = pages.filter("page_no IN (0, 1)").groupBy("document_id").pivot("page_no", [0, 1]).agg(F.min_by("text", "id").alias("t"), F.count(F.lit(1)).alias("n"))
    both = one.filter("`0_n` > 0 AND `1_n` > 0").select("document_id", F.explode(texts.local_terms(F.col("0_t"), F.col("1_t"), rank.NOISE)).alias("x"))
    return both.select("document_id", "x.word", F.round("x.score", 6).alias("score"))


QUESTIONS = ["What were the net sales of Veltraneth Logistics Limited in FY2020?", "Who is the company secretary of Osmarrow Grain Terminals?", "interest cover of Thavennic Solar Power", "something else altogether"]


@query(None, "claims", "metrics", "metric_aliases")
def ask_resolve(claims: DataFrame, metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """The metric and the subject that each of some questions names."""
    spark = claims.sparkSession
    subjects = claims.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("subject IS NOT NULL")
    names = metrics.select(F.lit("metric").alias("kind"), F.col("canonical_name").alias("name")).unionByName(aliases.select(F.lit("metric").alias("kind"), F.col("alias").alias("name")))
    names = names.unionByName(subjects.select(F.lit("subject").alias("kind"), F.col("subject").alias("name")))
    return ask.resolve(spark.createDataFrame([(q,) for q in QUESTIONS], "question string"), names)


@query(
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "events",
)
def stream_tumbling(events: DataFrame) -> DataFrame:
    """Events of each day and type, as the streaming plan counts them."""
    from factloom.streaming import windows

    return windows.tumbling(events, "1 day")


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
       SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM s GROUP BY user_id, run""",
    "events",
)
def stream_sessions(events: DataFrame) -> DataFrame:
    """Each user's sessions, ended by six hours of silence."""
    from factloom.streaming import windows

    return windows.sessions(events, "6 hours")
