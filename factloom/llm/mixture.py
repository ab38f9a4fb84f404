"""One mixture of sources with target shares of its tokens and a cap on how often a text is repeated.

Weights stand at the leaves of a tree (domain, language, source); a leaf is one source's texts in one
language and has the source's target in proportion to its tokens.  A node's budget goes to its
children by their weights; what a child can't take, since its texts may be repeated only so often,
goes to its siblings, and only what they all can't take has not come to the node in the first
place: shortages are made up among siblings before ancestors.

A leaf's budget is spent in epochs, each over its texts in an order seeded by epoch: whole epochs
first, then a prefix of the next by tokens.  Prefix sums are taken in two levels, over hash buckets
of a leaf and within the one bucket in which the prefix ends.

Texts of no listed source stay out; a null language is one of its own; null and empty texts have no
tokens and stay out.  Repeated rows are texts of their own.  A source without texts has nothing and
others make up for it.  With an empty table the mixture is empty.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tokens import VOCABULARY, sizes
from factloom.session import cut

#: leaves and targets are collected, so there must not be more; more are refused, not cut
MOST_LEAVES = 100_000
#: texts in a bucket of the seeded order, about
BUCKET = 20_000


def water_fill(amount: float, weights: list[float], caps: list[float]) -> list[float]:
    """The amount in proportion to the weights, none above its cap, shortages made up by the others."""
    given = [0.0] * len(weights)
    active = [k for k in range(len(weights)) if weights[k] > 0 and caps[k] > 0]
    left = min(amount, sum(caps[k] for k in active))
    while active and left > 1e-9:
        total = sum(weights[k] for k in active)
        full = [k for k in active if given[k] + left * weights[k] / total >= caps[k]]
        if not full:
            for k in active:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - given[k]
            given[k] = caps[k]
        active = [k for k in active if k not in set(full)]
    return given


def spread(leaves: list[tuple[tuple, float, float]], amount: float) -> dict[tuple, float]:
    """The budget of each leaf (path, weight, cap): from the root down, level by level."""
    if not leaves:
        return {}
    if len(leaves[0][0]) == 0:
        return {(): min(amount, leaves[0][2])}
    children: dict = defaultdict(list)
    for path, weight, cap in leaves:
        children[path[0]].append((path[1:], weight, cap))
    order = sorted(children, key=repr)
    given = water_fill(amount, [sum(w for _, w, _ in children[c]) for c in order], [sum(k for _, w, k in children[c] if w > 0) for c in order])
    return {(c, *path): x for c, a in zip(order, given, strict=True) for path, x in spread(children[c], a).items()}


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, domain_of: dict[str, str] | None = None, seed: int = 0, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """The texts taken (doc_id, source, lang, epoch, n_tokens) and a report per listed source.

    The mixture is as large as the listed sources' tokens, if no total is given; with "exact" it is
    as large as it can be with every source that has texts at its target.
    """
    spark = documents.sparkSession
    listed = targets.select("source", "target_share", "max_repeats").limit(MOST_LEAVES + 1).collect()
    if len(listed) > MOST_LEAVES:
        raise ValueError(f"there are more than {MOST_LEAVES} targets")
    listed = [r for r in listed if r.source is not None]
    named = F.broadcast(targets.select("source").filter("source IS NOT NULL").distinct())
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.coalesce("lang", F.lit("")).alias("lang"), "text").join(named, "source", "left_semi")
    sized = cut(sizes(texts, ["doc_id", "source", "lang"], vocabulary=vocabulary).filter("n_tokens > 0"))
    have = sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).limit(MOST_LEAVES + 1).collect()
    if len(have) > MOST_LEAVES:
        raise ValueError(f"there are more than {MOST_LEAVES} leaves")
    by_source = defaultdict(int)
    for r in have:
        by_source[r.source] += r.tokens
    share = {r.source: float(r.target_share or 0) for r in listed}
    repeats = {r.source: int(r.max_repeats or 0) for r in listed}
    whole = sum(by_source.values())
    if total_tokens == "exact":
        total = min((repeats[s] * by_source[s] / share[s] for s in by_source if share[s] > 0), default=0)
    else:
        total = whole if total_tokens is None else int(total_tokens)
    domain_of = domain_of or {}
    leaves = [((domain_of.get(r.source, ""), r.lang, r.source), share[r.source] * r.tokens / by_source[r.source], float(repeats[r.source] * r.tokens)) for r in have]
    budgets = spread(leaves, total)
    rows = [(r.source, r.lang, r.tokens, int(budgets.get((domain_of.get(r.source, ""), r.lang, r.source), 0.0) + 1e-6)) for r in have]
    plan = spark.createDataFrame(rows or [("", "", 1, 0)], "source string, lang string, tokens bigint, budget bigint")
    plan = plan.select("source", "lang", F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("last"))

    buckets = max(1, -(-sum(r.texts for r in have) // BUCKET))
    rank = F.xxhash64(F.lit(seed), "epochs", "doc_id", "salt")
    placed = sized.join(F.broadcast(plan), ["source", "lang"]).withColumn("rank", rank)
    placed = placed.withColumn("bucket", F.floor((F.col("rank") / 2.0**64 + 0.5) * buckets).cast("bigint"))
    leaf = ["source", "lang"]
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("in_bucket")
    sums = sums.withColumn("before", before)
    known = placed.join(sums, [*leaf, "bucket"]).withColumn("ends_here", (F.col("before") < F.col("last")) & (F.col("before") + F.col("in_bucket") > F.col("last")))
    inside = F.sum("n_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("rank", "doc_id", "salt").rowsBetween(Window.unboundedPreceding, 0))
    ending = known.filter("ends_here").withColumn("upto", F.col("before") + inside).withColumn("more", (F.col("upto") <= F.col("last")).cast("int"))
    others = known.filter("NOT ends_here").withColumn("more", (F.col("before") + F.col("in_bucket") <= F.col("last")).cast("int"))
    columns = ["doc_id", "source", "lang", "n_tokens", (F.col("epochs") + F.col("more")).cast("int").alias("times")]
    used = ending.select(*columns).unionByName(others.select(*columns)).filter("times > 0")
    taken = used.select("doc_id", "source", "lang", F.explode(F.expr("sequence(1, times)")).alias("epoch"), "n_tokens")

    got = used.groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("tokens_used"), F.max("times").alias("most_repeats"))
    state = spark.createDataFrame(
        [(s, share[s], by_source.get(s, 0), repeats[s]) for s in sorted(share)] or [("", 0.0, 0, 0)], "source string, target_share double, tokens_available bigint, max_repeats int"
    ).filter("source <> ''")
    out = state.join(F.broadcast(got), "source", "left")
    out = out.withColumn("all_tokens", F.sum("tokens_used").over(Window.partitionBy()))  # over the listed sources
    reached = F.when(F.col("all_tokens") > 0, F.round(F.coalesce("tokens_used", F.lit(0)) / F.col("all_tokens"), 6))
    out = out.select(
        "source",
        "target_share",
        reached.alias("reached_share"),
        "tokens_available",
        F.coalesce("tokens_used", F.lit(0)).cast("bigint").alias("tokens_used"),
        "max_repeats",
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("tokens_used") >= F.col("tokens_available") * F.col("max_repeats"), F.lit(False)).alias("repeats_limit_it"),
    )
    return taken, out
