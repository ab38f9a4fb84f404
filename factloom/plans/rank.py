"""The claim-context graph and personalized PageRank over it.

Claims are linked to their document, page, metric, period, stated and unknown axes and the words of
their quote.  A link weighs its kind's base times the rarity of what it leads to; what a claim
states of an axis is linked to the axis.  Links count both ways, parallel ones add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import texts
from factloom.session import cut

# ---- fixed values: base weights, words that tell nothing, the walk ----
BASES = {"doc": 0.3, "metric": 1.0, "period": 0.8, "page": 0.9, "qual": 1.0, "axis": 0.4, "term": 0.5}
NOISE = (
    "the and for with from was were has have had that this which per cent percent year years crore million billion total net gross value values figure figures "
    "table page note notes above below during compared versus respectively including excluding under over into than been also its their our"
).split()
TERMS, LEAST_WEIGHT, DAMPING, ITERATIONS, TOLERANCE = 12, 0.05, 0.85, 40, 1e-7
# ---- end of fixed values ----


def links(claims: DataFrame) -> DataFrame:
    """(claim, node, kind) of every claim and what it is linked to, each once."""
    none = F.array().cast("array<string>")
    named = lambda kind, value: F.when(value.isNotNull(), F.array(F.concat(F.lit(f"{kind}:"), value))).otherwise(none)
    each = lambda kind, values: F.transform(F.coalesce(values, none), lambda v: F.concat(F.lit(f"{kind}:"), v))
    words = F.slice(F.array_sort(texts.terms(F.col("evidence_quote"), NOISE)), 1, TERMS)
    stated = F.transform(F.map_entries(F.map_filter("qualifiers", lambda k, v: v.isNotNull())), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    nodes = F.concat(
        named("doc", F.col("document_id").cast("string")),
        named("page", F.concat_ws("/", F.col("document_id").cast("string"), F.col("page_no").cast("string"))),
        named("metric", F.nullif(texts.predicate_key(F.col("predicate")), F.lit(""))),
        named("period", F.col("period_label")),
        each("qual", stated),
        each("axis", F.col("unknown_qualifiers")),
        each("term", words),
    )
    rows = claims.select(F.concat(F.lit("claim:"), F.col("id").cast("string")).alias("claim"), F.explode(F.array_distinct(nodes)).alias("node"))
    return rows.withColumn("kind", F.element_at(F.split("node", ":"), 1))


def rarity(linked: DataFrame, claims: int) -> DataFrame:
    """(node, n, weight): how many claims touch a node, and the logarithm of how rare that is."""
    counted = linked.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("weight", F.greatest(F.lit(LEAST_WEIGHT), F.log(F.lit(float(claims)) / F.col("n"))))


def edges(claims: DataFrame) -> DataFrame:
    """(src, dst, w) of the graph, both ways."""
    total = claims.count()
    linked = links(claims)
    weights = rarity(linked, total)
    base = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in BASES.items()])
    of_claims = linked.join(weights, "node").select(F.col("claim").alias("a"), F.col("node").alias("b"), (base * F.col("weight")).alias("w"))
    qualified = weights.filter(F.col("node").startswith("qual:")).withColumn("b", F.concat(F.lit("axis:"), F.regexp_extract("node", "^qual:([^=]*)=", 1)))
    axis = weights.select(F.col("node").alias("b"), F.col("weight").alias("axis_weight"))
    of_axes = qualified.join(axis, "b", "left").select(F.col("node").alias("a"), "b", (F.col("n") * F.coalesce("axis_weight", F.log(F.lit(float(max(total, 1)))))).alias("w"))
    one_way = of_claims.unionByName(of_axes)
    both = one_way.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e")).select("e.*")
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def with_recovered(graph: DataFrame, relations: DataFrame, weights: DataFrame, claims: int, held_out: DataFrame | None = None) -> DataFrame:
    """The graph with the axes that earlier second looks found, but for held-out relations.

    Relations: (relation_id, claim_a, claim_b, axis, value_a, value_b); held_out: (relation_id).  A side
    with a value is linked to it and through it to the axis, one without to the axis at less weight.
    """
    rows = relations.filter("axis IS NOT NULL")
    if held_out is not None:
        rows = rows.join(held_out.select("relation_id").distinct(), "relation_id", "left_anti")
    sides = rows.select(F.explode(F.array(F.struct(F.col("claim_a").alias("claim"), F.col("value_a").alias("value"), "axis"), F.struct(F.col("claim_b").alias("claim"), F.col("value_b").alias("value"), "axis"))).alias("s")).select("s.*")
    sides = sides.select(F.concat(F.lit("claim:"), F.col("claim").cast("string")).alias("src"), F.concat(F.lit("axis:"), F.col("axis")).alias("axis"), F.concat(F.lit("qual:"), F.col("axis"), F.lit("="), F.substring(F.nullif("value", F.lit("")), 1, 60)).alias("qual"))
    sides = sides.join(graph.select("src").distinct(), "src", "left_semi")
    rare = F.coalesce("weight", F.log(F.lit(float(max(claims, 1)))))
    to = lambda c: weights.select(F.col("node").alias(c), "weight")
    valued, bare = sides.filter("qual IS NOT NULL"), sides.filter("qual IS NULL")
    new = (
        valued.join(to("qual"), "qual", "left").select("src", F.col("qual").alias("dst"), rare.alias("w"))
        .unionByName(valued.join(to("axis"), "axis", "left").select(F.col("qual").alias("src"), F.col("axis").alias("dst"), rare.alias("w")))
        .unionByName(bare.join(to("axis"), "axis", "left").select("src", F.col("axis").alias("dst"), (BASES["axis"] * rare).alias("w")))
    )
    both = new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return graph.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def neighbourhood(graph: DataFrame, seeds: DataFrame, radius: int = 4) -> DataFrame:
    """(node, hop) of the nodes within so many links of the seeds."""
    graph = cut(graph.select("src", "dst"))
    reached = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, radius + 1):
        front = reached.filter(F.col("hop") == hop - 1).select(F.col("node").alias("src"))
        new = graph.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        reached = cut(reached.unionByName(new.withColumn("hop", F.lit(hop))))
    return reached


def personalized(graph: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(seed, node, rank) of walks that restart at their seed; many seeds at once, seeds: (seed, node).

    What a node without links holds goes back to the seed.  Ends when no seed's ranks move by more
    than the tolerance in sum.
    """
    out = graph.groupBy("src").agg(F.sum("w").alias("all"))
    steps = cut(graph.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")))
    linked = steps.select(F.col("src").alias("node")).distinct()
    rank = seeds.select("seed", "node", F.lit(1.0).alias("rank"))
    for k in range(iterations):
        moved = rank.withColumnRenamed("node", "src").join(steps, "src").groupBy("seed", F.col("dst").alias("node")).agg((F.sum(F.col("rank") * F.col("share")) * DAMPING).alias("rank"))
        lost = rank.join(linked, "node", "left_anti").groupBy("seed").agg(F.sum("rank").alias("lost"))
        back = seeds.join(lost, "seed", "left").select("seed", "node", (F.lit(1 - DAMPING) + DAMPING * F.coalesce("lost", F.lit(0.0))).alias("rank"))
        new = moved.unionByName(back).groupBy("seed", "node").agg(F.sum("rank").alias("rank"))
        if k % 5 == 4:
            new = cut(new)
            change = new.join(rank.withColumnRenamed("rank", "old"), ["seed", "node"], "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("d")).first().d
            rank = new
            if change is None or change < tolerance:
                break
        rank = new
    return rank


def pair_axes(ranks_a: DataFrame, ranks_b: DataFrame, keep: int = 6) -> DataFrame:
    """(axis, connection, divergence, score) of the axes that two claims' walks meet at, the best first."""
    axis = lambda r, c: r.filter(F.col("node").startswith("axis:")).select(F.expr("substring(node, 6)").alias("axis"), F.col("rank").alias(c))
    both = axis(ranks_a, "ra").join(axis(ranks_b, "rb"), "axis")
    connection = F.least("ra", "rb")
    divergence = F.when(F.col("ra") + F.col("rb") > 0, F.abs(F.col("ra") - F.col("rb")) / (F.col("ra") + F.col("rb"))).otherwise(0.0)
    scored = both.select("axis", connection.alias("connection"), divergence.alias("divergence"))
    return scored.withColumn("score", F.col("connection") * (0.25 + 0.75 * F.col("divergence"))).orderBy(F.desc("score"), "axis").limit(keep)
