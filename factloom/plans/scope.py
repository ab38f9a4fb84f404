"""What lines of a page declare, and how far a declaration reaches: headings, frames, rows.

Lines are (page_id, line_no, text, size, y).  A heading of a level is in force until the next one of
the same or a higher level; the nearest declaration of an axis counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: what a declaration looks like; lines longer than this declare nothing ----
LONGEST = 140
HEADING_STEP, ROW_STEP = 0.4, 2.5
CURRENCIES = [("INR", r"₹|\brs\b|\binr\b|\brupees?\b"), ("USD", r"\bus\$|\busd\b|\bdollars?\b|\$"), ("EUR", r"€|\beur\b|\beuros?\b"), ("GBP", r"£|\bgbp\b|\bpounds?\b")]
SCALES = [("crore", r"\bcrores?\b"), ("lakh", r"\blakhs?\b|\blacs?\b"), ("billion", r"\bbillions?\b|\bbn\b"), ("million", r"\bmillions?\b|\bmn\b"), ("thousand", r"\bthousands?\b|'000")]
CONSOLIDATION = [("consolidated", r"\bconsolidated\b"), ("standalone", r"\bstandalone\b")]
PRICE_BASE = [("constant", r"\bconstant\b.*\bprices?\b"), ("current", r"\bcurrent\b.*\bprices?\b")]
OTHERS = [("restated", r"\brestated\b"), ("pro_forma", r"\bpro[\s-]?forma\b")]
DECLARES = r"(?i)\b(in|amounts?|figures?|all|unless|stated|expressed)\b|\("
# ---- end of fixed values ----


def _first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for value, pattern in reversed(patterns):
        out = F.when(text.rlike("(?i)" + pattern), value).otherwise(out)
    return out


def declarations(text: Column, table_row: Column) -> Column:
    """MAP<axis, value> of what a line declares; rows of tables and long lines declare nothing, nor one that names both bases."""
    unit_line = text.rlike(DECLARES) & ~text.rlike(r"[0-9]{2,}[.,]?[0-9]*\s*(%|crore|million|billion)")
    both_bases = text.rlike(r"(?i)\bconsolidated\b") & text.rlike(r"(?i)\bstandalone\b")
    found = {
        "currency": F.when(unit_line, _first(text, CURRENCIES)),
        "scale": F.when(unit_line, _first(text, SCALES)),
        "consolidation": F.when(~both_bases, _first(text, CONSOLIDATION)),
        "price_base": _first(text, PRICE_BASE),
        **{axis: F.when(text.rlike("(?i)" + p), "yes") for axis, p in OTHERS},
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()]), lambda e: e["value"].isNotNull())
    nothing = F.coalesce(table_row, F.lit(False)) | text.isNull() | (F.length(text) > LONGEST)
    return F.map_from_entries(F.when(nothing, F.slice(pairs, 1, 0)).otherwise(pairs))


def heading_levels(lines: DataFrame, body: Column | float) -> DataFrame:
    """Lines with ``level``: 1 for the largest size above the body's, and so on; null for text."""
    heading = F.col("size") > F.lit(body) + HEADING_STEP
    ranks = lines.filter(heading).select("page_id", "size").distinct().withColumn("level", F.dense_rank().over(Window.partitionBy("page_id").orderBy(F.desc("size"))))
    return lines.join(ranks, ["page_id", "size"], "left")


def body_size(lines: DataFrame) -> DataFrame:
    """(page_id, body): the size in which most characters are set, the smaller of equals."""
    sized = lines.groupBy("page_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return sized.groupBy("page_id").agg(F.min_by("size", F.struct(-F.col("chars"), "size")).alias("body"))


def inherited(lines: DataFrame, deepest: int = 6) -> DataFrame:
    """Lines with the ``frame`` in force: declarations of the headings above, the nearest first, and of the text under the innermost one.

    Lines need ``level`` and ``declared``.  One running value per level: the last heading of the
    level, reset by a higher one.
    """
    order = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = {}
    for level in range(1, deepest + 1):
        # the last heading of this level or a higher one; it counts if it is of this level
        last = F.last(F.when(F.col("level") <= level, F.struct("level", "line_no", "declared")), ignorenulls=True).over(order)
        at[level] = F.when(last["level"] == level, last["declared"])
    section = F.max(F.when(F.col("level").isNotNull(), F.col("line_no"))).over(order)
    rows = lines.withColumns({f"h{k}": v for k, v in at.items()}).withColumn("section", F.coalesce(section, F.lit(-1)))
    own = Window.partitionBy("page_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    texts = F.collect_list(F.when(F.col("level").isNull() & (F.size("declared") > 0), F.col("declared"))).over(own)
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))

    def over(near: Column, far: Column) -> Column:
        return F.map_concat(F.map_filter(far, lambda k, v: ~F.map_contains_key(near, k)), near)

    frame = empty
    for level in range(1, deepest + 1):
        frame = over(F.coalesce(F.col(f"h{level}"), empty), frame)
    frame = F.aggregate(texts, frame, lambda acc, x: over(x, acc))
    return rows.withColumn("frame", frame).drop("section", *[f"h{k}" for k in at])


def frame_changes(lines: DataFrame) -> DataFrame:
    """The lines at which the frame differs from the line before's."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("frame"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    order = Window.partitionBy("page_id").orderBy("line_no")
    return lines.withColumn("context", text).withColumn("before", F.lag("context", 1, "").over(order)).filter("context <> before").select("page_id", "line_no", "context")


def rows_of(cells: DataFrame) -> DataFrame:
    """Cells with ``row_no``: a new row where a cell lies more than a step from the first cell of its row.

    Cells are (page_id, y, x, text).  The row is anchored to its first cell, so it is a fold over a
    page's cells in order, not a session of neighbours.
    """
    lists = cells.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "text"))).alias("cells"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<row_no:int,x:double,text:string>>").alias("out"))

    def step(acc: Column, cell: Column) -> Column:
        fresh = acc["anchor"].isNull() | (F.abs(cell["y"].cast("double") - acc["anchor"]) > ROW_STEP)
        row = F.when(fresh, acc["row"] + 1).otherwise(acc["row"])
        placed = F.struct(row.alias("row_no"), cell["x"].cast("double").alias("x"), cell["text"].alias("text"))
        return F.struct(F.when(fresh, cell["y"].cast("double")).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.concat(acc["out"], F.array(placed)).alias("out"))

    return lists.select("page_id", F.explode(F.aggregate("cells", start, step)["out"]).alias("c")).select("page_id", "c.*")
