"""Passages that stand verbatim in several documents, found by recompression.

A text's signs are read as tokens (a word, or a run of one other sign), and tokens get a name that
depends on their signs alone.  Rounds of recompression follow: runs of one name get a name, then
adjacent names of a left and a right half of all names are paired under a name of the pair, which
leaves about three quarters of them.  A name is a hash of what it stands for and the halves are drawn
by hash, so names are the same in every document without any exchange, and equal substrings get equal
symbols but for a margin at each end.

Every symbol carries the stretch of text that settles it (its context).  A window of ``least``
characters belongs to a symbol of the highest round of which any has its context in the window, to the
one whose name has the smallest hash; which one that is depends on the window's characters alone, so
equal windows belong to equally named symbols.  If no higher symbol is settled a lower one is; a window
in one long word belongs to one of its characters.  Consecutive windows of one symbol are a run; its key
is the symbol with the text that all of them have around its start, three fifths of a window:

1. Rows (key, hash of the run's text, document, place) are grouped by key.  A run whose text stands in
   two documents is shared as a whole; keys of one document are done with.
2. The windows of what is left, runs beginning or ending at the edge of a passage, are compared as
   texts within their key, or by hashes of 128 bits where a key has more runs than ``CROWD``.
3. Stretches are merged per document.

Hot groups: a bounded sample of documents shows which keys are met often.  Runs that it has in several
documents are proven shared, and the rows of hot keys are spread over all tasks.  The sample only
decides ways; nothing is left out at any step.

Null, empty and shorter texts share nothing.  Lengths are code points.  A repeat inside one document
alone isn't shared; rows with one doc_id are one document's.  An empty table shares nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rounds of pairs, and those that name runs first
ROUNDS, RUN_ROUNDS = 5, frozenset({2})
#: characters parsed at once
CHUNK = 1 << 19
#: runs of one symbol that are compared as texts in one task
CROWD = 1024
#: documents in the sample that finds hot keys, about, and the share of them that makes one
SAMPLE, HOT = 2000, 0.005
_END = 0x110000
_ONE, _PAIR, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Signs:
    """Per sign: whether it is part of words, and its hash; made once a process."""

    word = np.zeros(0, dtype=bool)
    hashed = np.zeros(0, dtype=np.uint64)

    @classmethod
    def load(cls) -> None:
        if not len(cls.word):
            cls.hashed = _mix(np.arange(1, _END + 2, dtype=np.uint64) * _ONE)
            cls.word = np.array([chr(i).isalnum() for i in range(_END)] + [False])


class _Powers:
    """Powers of an odd number and of its inverse, grown as texts need them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size, base = max(n, CHUNK), int(_ONE)
            for name, factor in (("up", base), ("down", pow(base, -1, 2**64))):
                setattr(cls, name, np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(factor))]), dtype=np.uint64))
        return cls.up, cls.down


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[1:], x[-1:]])


def tokens(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, context start, context end, whether it parts texts) of the tokens of joined texts."""
    word = _Signs.word[codes]
    joined = (word[1:] & word[:-1]) | ((codes[1:] == codes[:-1]) & (codes[1:] != _END))
    start = np.flatnonzero(np.concatenate([[True], ~joined])).astype(np.int32)
    end = np.append(start[1:], np.int32(len(codes)))
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(start, end - start)
    name = _mix(np.add.reduceat(_Signs.hashed[codes] * _Powers.upto(int(place.max()) + 1)[0][place], start))
    # the signs around a token settle where it begins and ends
    return name, start - 1, end + 1, codes[start] == _END


def characters(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.arange(len(codes), dtype=np.int32)
    return _Signs.hashed[codes], at, at + 1, codes == _END


def name_runs(name: np.ndarray, low: np.ndarray, high: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one name under a name of their own; the neighbours settle how long a run is."""
    start = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | parts[1:]]))
    last = np.append(start[1:], len(name)) - 1
    n = last - start + 1
    named = np.where(n > 1, _mix(name[start] * _RUN + n.astype(np.uint64)), name[start])
    alone = parts[start]
    return named, np.where(alone, low[start], low[np.maximum(start - 1, 0)]), np.where(alone, high[last], high[np.minimum(last + 1, len(name) - 1)]), alone


def name_pairs(name: np.ndarray, low: np.ndarray, high: np.ndarray, parts: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
    """Pairs of a left and a right name under one name; a single left one is settled by the next, a right one by the one before."""
    right = (_mix(name + np.uint64(number + 1)) & np.uint64(1)).astype(bool)
    left = ~right & ~parts
    right &= ~parts
    pair = np.append(left[:-1] & right[1:], False)
    keep = np.concatenate([[True], ~pair[:-1]])
    named = np.where(pair, _mix(name * _PAIR + _after(name)), name)[keep]
    return named, np.where(right, _before(low), low)[keep], np.where(left, _after(high), high)[keep], parts[keep]


def window_runs(texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """(key, run, text number, first window, windows) of the runs of windows of some texts.

    ``key`` is a hash of the owning symbol and of text that all windows of the run have around it.
    ``run`` is a hash of the run's text, which has at most twice ``least`` characters.
    """
    _Signs.load()
    joined = "\0".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])  # where texts are parted; a text may hold the sign itself
    codes[ends] = _END
    many = lengths >= least
    start, end = ends[:-1][many] + 1, ends[1:][many] - least + 1  # of each text's windows

    levels = [characters(codes), tokens(codes)]
    for number in range(ROUNDS):
        level = levels[-1]
        levels.append(name_pairs(*(name_runs(*level) if number in RUN_ROUNDS else level), number))
    found = []
    while len(start):
        name, low, high, _ = levels.pop()
        first, n, own, start, end = _owned(name, low, high, start, end, least)
        found.append((name[own], low[own], high[own], first, n))
    symbol, low, high, first, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 5
    up, down = _Powers.upto(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_Signs.hashed[codes] * up[: len(codes)], dtype=np.uint64)])

    def text_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((sums[b] - sums[a]) * down[a])

    # windows that begin late in the reach of a symbol are told apart by what follows its start, others by what is before
    split = np.maximum(low - least * 2 // 5, 0)
    late, early = first + n > split, first < split
    symbol, low, high = symbol.astype(np.uint64), low.astype(np.int64), high.astype(np.int64)
    key = np.concatenate([symbol[late] ^ text_hash(low[late], low[late] + (least - least * 2 // 5)), ~symbol[early] ^ text_hash(split[early], high[early])])
    until = np.concatenate([(first + n)[late], np.minimum(first + n, split)[early]])
    first = np.concatenate([np.maximum(first, split)[late], first[early]])
    n = until - first
    run = text_hash(first, first + n - 1 + least)
    number = np.searchsorted(ends, first, side="right") - 1
    return key, run, number, first - ends[number] - 1, n


def _owned(name: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that own a symbol of this level (first window, windows, symbol), and the stretches of windows that own none.

    Between the places where a context enters or leaves it, a window has the same settled symbols.
    """
    cut = np.unique(np.concatenate([low + 1, high - least, start, end]))
    at = np.searchsorted(start, cut, side="right") - 1
    inside = (at >= 0) & (cut < end[np.maximum(at, 0)])
    until = np.append(cut[1:], cut[-1])[inside]
    at, cut = at[inside], cut[inside]
    from_, to = np.searchsorted(low, cut), np.searchsorted(high, cut + least, side="right") - 1
    has = to >= from_
    # a sparse table of the places of range minima of the names' hashes
    rank = _mix(name + _RUN)
    width = (to - from_ + 1)[has]
    table = [np.arange(len(name))]
    while len(width) and 2 << (len(table) - 1) <= width.max():
        a, b = table[-1][: -(1 << (len(table) - 1))], table[-1][1 << (len(table) - 1) :]
        table.append(np.where(rank[b] < rank[a], b, a))
    own = np.zeros(len(width), dtype=np.int64)
    step = np.frexp(width)[1] - 1
    for k in range(len(table)):
        mine = step == k
        a, b = table[k][from_[has][mine]], table[k][to[has][mine] + 1 - (1 << k)]
        own[mine] = np.where(rank[b] < rank[a], b, a)
    owner = np.full(len(cut), -1)
    owner[has] = own
    # pieces that follow each other in a text with one owner are a run
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]) | (cut[1:] != until[:-1])]) if len(cut) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(cut)) - 1 if len(head) else head
    first, last, owner = cut[head], until[tail], owner[head]
    some = owner >= 0
    return first[some], (last - first)[some], owner[some], first[~some], last[~some]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        docs.append(doc)
        texts.append(text)
        size += len(text)
        if size >= CHUNK:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _runs(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, run, doc, first, windows) as arrays."""
    for docs, texts in _chunks(batch):
        key, run, number, first, n = window_runs(texts, least)
        yield key.view(np.int64), run.view(np.int64), np.array(docs, dtype=np.int64)[number], first, n


class _Hot:
    """What a bounded sample shows: keys met often, and runs proven shared with one place of each."""

    def __init__(self, documents: DataFrame, texts: DataFrame, least: int):
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, run, doc, first, _ in _runs(batch, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, run, doc, first)], names=["key", "run", "doc_id", "first"])

        # about SAMPLE documents, by hash; texts as long as they are
        share = min(1.0, SAMPLE / max(1, documents.count()))
        sample = texts.filter(F.xxhash64("doc_id") / 2.0**64 + 0.5 < share)
        rows = sample.mapInArrow(parse, "key bigint, run bigint, doc_id bigint, first bigint")
        many = max(2, int(SAMPLE * HOT))
        seen = rows.groupBy("key", "run").agg(F.count_distinct("doc_id").alias("docs"), F.min(F.struct("doc_id", "first")).alias("place"))
        seen = seen.withColumn("in_key", F.sum("docs").over(Window.partitionBy("key"))).filter(F.col("in_key") >= many)
        proven = F.col("docs") >= many
        kept = seen.select("key", F.when(proven, F.col("run")).alias("run"), F.when(proven, F.col("place")).alias("place")).distinct().collect()
        self.keys = np.array(sorted({r.key for r in kept}), dtype=np.int64)
        self.proven = {(r.key, r.run): tuple(r.place) for r in kept if r.run is not None}


def _compared(runs: dict[str, list[tuple[int, int, bool]]], least: int) -> Iterator[tuple[int, int, int]]:
    """(doc, first, last character) of what runs of one symbol share; runs: text -> [(doc, first, several)]."""
    doc_of: dict[str, int | None] = {}
    held = {text: None if any(several or d != places[0][0] for d, _, several in places) else places[0][0] for text, places in runs.items()}
    for text, doc in held.items():
        for i in range(len(text) - least + 1):
            w = text[i : i + least]
            if doc_of.setdefault(w, doc) != doc:
                doc_of[w] = None
    for text, places in runs.items():
        spans: list[list[int]] = []
        for i in range(len(text) - least + 1):
            if doc_of[text[i : i + least]] is None:
                if spans and i + least - 2 == spans[-1][1]:
                    spans[-1][1] += 1
                else:
                    spans.append([i, i + least - 1])
        for doc, first, _ in places:
            for s, e in spans:
                yield doc, first + s, first + e


def shared_spans(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, span_start, span_end) of the maximal stretches made of shared windows."""
    if least >= 1 << 18:
        raise ValueError("a window has too many characters")
    texts = documents.filter((F.length("text") >= least) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = documents.sparkSession.sparkContext.broadcast(_Hot(documents, texts, least))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ones: _Hot = shared.value
        for batch in batches:
            for key, run, doc, first, n in _runs(batch, least):
                hot = np.isin(key, hot_ones.keys).astype(np.int64)
                for k in np.flatnonzero(hot).tolist():
                    if (place := hot_ones.proven.get((int(key[k]), int(run[k])))) is not None:
                        hot[k] = 3 if place == (int(doc[k]), int(first[k])) else 2
                # hot rows need no group: proven ones are spread by place, others of a hot key by run
                spread = _mix(key.view(np.uint64) ^ _mix(run.view(np.uint64)))
                alone = _mix(spread ^ _mix(doc.astype(np.uint64) * _ONE + first.astype(np.uint64)))
                key = np.where(hot > 1, alone, np.where(hot > 0, spread, key.view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(run), pa.array(doc), pa.array((first << 22) + (n << 2) + hot)], names=["key", "run", "doc_id", "place"])

    rows = texts.mapInArrow(parse, "key bigint, run bigint, doc_id bigint, place bigint")
    hot = F.col("place").bitwiseAND(3)
    in_key, in_run = Window.partitionBy("key"), Window.partitionBy("key", "run")
    rows = rows.withColumn("low", F.min("doc_id").over(in_key)).withColumn("high", F.max("doc_id").over(in_key)).filter((hot > 0) | (F.col("low") != F.col("high")))
    rows = rows.withColumn("low", F.min("doc_id").over(in_run)).withColumn("high", F.max("doc_id").over(in_run))
    at = F.struct("doc_id", "place")
    rows = rows.withColumn("whole", (hot >= 2) | (F.col("low") != F.col("high"))).withColumn("lead", F.when(hot != 2, F.min(at).over(in_run) == at).otherwise(False))
    rows = rows.withColumn("open", F.count_if(~F.col("whole")).over(in_key)).withColumn("runs", F.count_if(F.col("lead")).over(in_key))
    # 0: a shared stretch; 1: to be compared; 2: shared, and compared on behalf of its run
    partner = F.col("lead") & ((F.col("open") > 0) | (hot > 0))
    kind = F.when(~F.col("whole"), 1).when(partner, 2).otherwise(0)
    crowd = (hot > 0) | (F.col("runs") > CROWD)
    wanted = rows.select("doc_id", F.struct("key", "place", kind.alias("kind"), crowd.alias("crowd")).alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("at"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out: list[tuple] = []
                spans: list[list[int]] = []
                for x in sorted(at, key=lambda x: x["place"]):
                    s, n = x["place"] >> 22, (x["place"] >> 2) & ((1 << 20) - 1)
                    if x["kind"] != 1:
                        if spans and s <= spans[-1][1] + 1:
                            spans[-1][1] = max(spans[-1][1], s + n + least - 2)
                        else:
                            spans.append([s, s + n + least - 2])
                    if x["kind"] and not x["crowd"]:
                        out.append((x["key"], 0, doc, s, 0, x["kind"] == 2, text[s : s + n - 1 + least]))
                    elif x["kind"]:
                        for i in range(s, s + n):
                            h = xxhash.xxh3_128_intdigest(text[i : i + least])
                            out.append((_signed(h >> 64), _signed(h), doc, i, 0, x["kind"] == 2, None))
                out += [(doc, 0, doc, s, e, None, None) for s, e in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], names=["key", "window", "doc_id", "s", "e", "several", "run"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by symbol, then window; stretches pass through, single windows are counted, runs compared."""
        runs: dict[str, list] = {}
        held: list[tuple[int, int]] = []
        first_doc, shared_window = None, False
        last: tuple | None = None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for symbol, window, doc, s, e, several, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (symbol, window) != last:
                    out.extend(_compared(runs, least))
                    runs, held, first_doc, shared_window, last = {}, [], None, False, (symbol, window)
                if several is None:
                    out.append((doc, s, e))
                elif run is not None:
                    runs.setdefault(run, []).append((doc, s, several))
                else:
                    # a window alone: the places before a second document's wait
                    first_doc = doc if first_doc is None else first_doc
                    shared_window = shared_window or several or doc != first_doc
                    held.append((doc, s))
                    if shared_window:
                        out += [(d, i, i + least - 1) for d, i in held]
                        held = []
            yield _spans(out)
            out = []
        yield _spans([*out, *_compared(runs, least)])

    out_schema = "key bigint, window bigint, doc_id bigint, s bigint, e bigint, several boolean, run string"
    found = texts.join(wanted, "doc_id").select("doc_id", "text", "at").mapInArrow(expand, out_schema)
    spans = found.repartition("key").sortWithinPartitions("key", "window").mapInArrow(compare, "doc_id bigint, s bigint, e bigint")
    ordered = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("fresh", F.coalesce(F.col("s") > before + 1, F.lit(True)).cast("bigint")).withColumn("stretch", F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "stretch").agg(F.min("s").alias("span_start"), (F.max("e") + 1).alias("span_end"))
    return merged.select("doc_id", "span_start", "span_end")


_OUT = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _spans(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["doc_id", "s", "e"])


def coverage(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every document; stretches of one text never overlap."""
    spans = shared_spans(documents, least).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    whole = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return whole.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"))
