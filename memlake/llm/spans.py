"""Long exact spans shared between records, by content-defined chunking.

A gear hash rolls over the last GEAR characters of every place. A place is a cut if its hash is the least of some CUT successive
ones. Unlike a cut at hashes below a mask, this bounds the chunks' length: every window of LENGTH characters has a cut among its first CUT places, and
which one depends on the window's own characters alone, so that insertions elsewhere shift nothing. From each cut a chunk of
variable length reaches to the place of the least hash of the CUT ones after it, which is a cut, too. Two equal windows
therefore have the same first cut, at the same distance from their start, and behind it the same chunk.

Chunks are deduplicated by their digests: one that a single record holds can be forgotten. Shared chunks are then extended at their borders. A
chunk whose surroundings, the CUT - 1 characters before it and the LENGTH ones from its start on, are those of another record's
chunk shares all its windows. Only chunks that agree in the CORE = LENGTH - CUT + 1 characters that every window has behind its first cut, but
not in all that surrounds them, are compared window by window, each different surrounding once, by digests of the
windows: no pairs of records are made, however many share a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.batches import small
from memlake.plans.runtime import written

LENGTH, CUT, GEAR = 300, 100, 32


def _gear(codes: np.ndarray) -> np.ndarray:
    """32-bit gear hashes of the GEAR characters that begin at each place; the last GEAR - 1 places have none."""
    x = codes.astype(np.uint32) + np.uint32(0x7F4A7C15)
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(odd)
    h = x ^ (x >> np.uint32(16))
    size = 1
    while size < GEAR:  # the sum of gear values shifted by their distance, by doubling
        h = (h[:-size] << np.uint32(size)) + h[size:]
        size *= 2
    return h


def cuts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `codes` that are the cut of some window of CUT places beginning at one of `starts` (a mask over places), and where their chunks end.

    The least hash counts, the last one of equal ones. A chunk ends at the cut of the window that begins right behind its start.
    """
    h = _gear(codes)
    places = np.arange(len(h), dtype=np.uint64)
    packed = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places)
    least, size = packed, 1
    while size * 2 <= CUT:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = CUT - size
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    place = lambda x: (np.uint64(0xFFFFFFFF) - (x & np.uint64(0xFFFFFFFF))).astype(np.int64)
    # the same cut serves successive windows
    found = np.unique(place(least[np.flatnonzero(starts[: len(least)])]))
    return found, place(least[np.minimum(found + 1, len(least) - 1)])


CUT_SCHEMA = "doc_id long, pos int, chunk long, core long, around long"


def _codes(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Code points of all texts, the same as bytes, and where each text begins and the last one ends."""
    raw = b"".join(t.encode("utf-32-le", "surrogatepass") for t in texts)
    return np.frombuffer(raw, np.uint32), raw, np.cumsum([0, *map(len, texts)])


def _place(pos: int, begin: int, end: int, length: int, cut: int) -> tuple[int, int]:
    """First and last distance of a window's start before a cut, for windows within the text."""
    return max(0, pos + length - end), min(cut - 1, pos - begin)


def record_cuts(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, chunk, core, around): cuts of texts (doc_id long, text string), digests of the chunk, of what follows and of what surrounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        core = LENGTH - CUT + 1
        for batch in small(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):  # parts of bounded size
                end, size = at, 0
                while end < len(ids) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                part_ids, part = ids[at:end], texts[at:end]
                at = end
                codes, raw, bounds = _codes(part)
                starts = np.zeros(len(codes) + 1, np.int8)
                for b, e in zip(bounds[:-1], bounds[1:]):
                    starts[b : max(b, e - LENGTH + 1)] = 1
                found, ends = cuts(codes, starts[:-1].view(bool))
                text = np.searchsorted(bounds, found, "right") - 1
                chunks, cores, arounds = (np.empty(len(found), np.uint64) for _ in range(3))
                low, high = bounds[text], bounds[text + 1]
                left, right = np.maximum(low, found - CUT + 1), np.minimum(high, found + LENGTH)
                for i, (p, e, a, b) in enumerate(zip(found.tolist(), ends.tolist(), left.tolist(), right.tolist())):
                    chunks[i] = digest(raw[4 * p : 4 * e])
                    cores[i] = digest(raw[4 * p : 4 * (p + core)])
                    arounds[i] = digest(raw[4 * a : 4 * b], p - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(part_ids, np.int64)[text]), pa.array((found - low).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (chunks, cores, arounds))],
                    names=["doc_id", "pos", "chunk", "core", "around"],
                )

    return texts.where(F.length("text") >= LENGTH).mapInArrow(run, CUT_SCHEMA)


def _window_digests(kept: DataFrame, texts: DataFrame) -> DataFrame:
    """(core, around, first, last, ahead, window): digests of the windows around one instance of each (core, around) in `kept`.

    ahead is the distance from the window's start to the cut.
    """
    asked = kept.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "core", "around", "first", "last")).alias("asked"))
    both = asked.join(texts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in small(batches):
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                raw = text.encode("utf-32-le", "surrogatepass")
                rows = []
                for x in asked:
                    least, most = _place(x["pos"], 0, len(text), LENGTH, CUT)
                    for ahead in range(least, most + 1):
                        s = x["pos"] - ahead
                        rows.append((x["core"], x["around"], x["first"], x["last"], ahead, digest(raw[4 * s : 4 * (s + LENGTH)], ahead) - (1 << 63)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    names=["core", "around", "first", "last", "ahead", "window"],
                )

    return both.mapInArrow(run, "core long, around long, first long, last long, ahead int, window long")


def shared_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): maximal unions of windows of LENGTH characters that another record has too.

    `texts` is (doc_id long, text string); places count Unicode code points from 0, the end is exclusive; nothing is
    normalised. Null texts and those shorter than LENGTH share nothing. Repeated rows of a doc_id count as one record if equal; what
    only rows of the same doc_id share doesn't count. Exact, but for equal 64-bit digests of different stretches.
    """
    texts = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = written(record_cuts(texts), "cuts")
    chunks = found.groupBy("chunk").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") != F.col("last")).select("chunk")
    shared = written(found.join(chunks, "chunk", "left_semi").drop("chunk"), "shared")
    # one row for each different surrounding, whatever the number of records that have it
    kinds = shared.groupBy("core", "around").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "pos")).alias("one"))
    kinds = written(kinds, "kinds")
    whole = kinds.where(F.col("first") != F.col("last")).select("core", "around", F.lit(0).alias("least"), F.lit(CUT - 1).alias("most"))
    several = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("core")
    compared = kinds.join(several, "core", "left_semi").select("one.doc_id", "one.pos", "core", "around", "first", "last")
    digests = written(_window_digests(compared, texts), "windows")
    common = digests.groupBy("window").agg(F.min("first").alias("a"), F.max("last").alias("b")).where(F.col("a") != F.col("b")).select("window")
    hits = digests.where(F.col("first") == F.col("last")).join(common, "window", "left_semi")
    # successive distances make one row
    order = Window.partitionBy("core", "around").orderBy("ahead")
    runs = hits.withColumn("run", F.col("ahead") - F.row_number().over(order)).groupBy("core", "around", "run").agg(F.min("ahead").alias("least"), F.max("ahead").alias("most"))
    marks = whole.unionByName(runs.select("core", "around", "least", "most"))
    sizes = texts.select("doc_id", F.length("text").alias("size")).where(F.col("size") >= LENGTH).dropDuplicates(["doc_id"])
    spans = shared.join(marks, ["core", "around"]).join(sizes, "doc_id").select(
        "doc_id",
        F.greatest(F.lit(0), F.col("pos") - F.col("most")).alias("s"),
        F.least(F.col("size"), F.col("pos") - F.col("least") + LENGTH).alias("e"),
    )
    return merged_spans(spans)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): unions of the overlapping or touching spans (doc_id, s, e)."""
    before = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = spans.distinct().withColumn("new", F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True)).cast("int"))
    return (
        marked.withColumn("island", F.sum("new").over(upto))
        .groupBy("doc_id", "island")
        .agg(F.min("s").cast("long").alias("span_start"), F.max("e").cast("long").alias("span_end"))
        .select("doc_id", "span_start", "span_end")
    )
