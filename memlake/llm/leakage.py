"""Evaluation texts leaking into training text, by winnowing.

The hash of every run of GRAM words is a fingerprint candidate; of every WINDOW successive ones the least is kept. Two texts
that share WINDOW + GRAM - 1 = RUN words keep the same fingerprint inside them. Shorter items are fingerprinted as a whole: texts keep
the hash of every run of such an item's length that occurs among these hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import small
from memlake.plans.runtime import BROADCAST_ROWS, written

RUN, GRAM = 13, 5
WINDOW = RUN - GRAM + 1
#: Fingerprints of items up to which workers drop a text's other fingerprints before the join.
KNOWN = 200_000
WORDS = re.compile(r"[^\W_]+")
PRINT_SCHEMA = "id long, print long, pos int, n int"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of Unicode letters and digits."""
    return [w.lower() for w in WORDS.findall(text or "")]


class _Hashes(dict):
    """64-bit hashes of words, computed once while remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return h


_hashes = _Hashes()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words; the last k - 1 places of `h` have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int, begins: np.ndarray | None = None) -> np.ndarray:
    """Places of the least hash of each window, the last of equal ones; begins: a mask of the places where windows may begin."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, window):
        lower = grams[i : i + n] <= least
        np.minimum(least, grams[i : i + n], out=least)
        place[lower] = i
    place += np.arange(n)
    return np.unique(place if begins is None else place[begins[:n]])


def at_ends(kept: np.ndarray, grams: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """`kept` with the places inside a repetition, successive equal hashes, replaced by the repetition's first and last place.

    So a text of one repeated word keeps two places. Two texts still meet on the diagonal of each run that they share: either a
    repetition begins or ends within the run, at places that fit, or the run is nothing but one word, and then the first places
    of both repetitions fit. left: words from each place to the end of its text, where grams are those of several texts.
    """
    if not len(kept):
        return kept
    joined = np.zeros(len(grams), bool)
    joined[1:] = grams[1:] == grams[:-1]
    if left is not None:
        joined[1:] &= (left[1 : len(grams)] >= GRAM) & (left[: len(grams) - 1] == left[1 : len(grams)] + 1)
    places = np.arange(len(grams))
    first = np.maximum.accumulate(np.where(joined, 0, places))
    ends = ~np.append(joined[1:], False)
    last = np.minimum.accumulate(np.where(ends, places, len(grams))[::-1])[::-1]
    return np.unique(np.concatenate([first[kept], last[kept]]))


def item_prints(items: DataFrame) -> DataFrame:
    """(id, print, pos, n) of items (id long, text string): kept fingerprints of long items, n = 0; the whole of short ones, n their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                h = np.array([_hashes[w] for w in words_of(text)], np.uint64)
                if len(h) >= RUN:
                    g = _grams(h, GRAM)
                    rows += [(i, int(g[p].view(np.int64)), int(p), 0) for p in at_ends(winnow(g, WINDOW), g)]
                elif len(h):
                    rows.append((i, int(_grams(h, len(h))[0].view(np.int64)), 0, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", "print", "pos", "n"])

    return items.mapInArrow(run, PRINT_SCHEMA)


def text_prints(texts: DataFrame, lengths: list[int], known: np.ndarray | None) -> DataFrame:
    """(id, print, pos, n) of texts (id long, text string): winnowed runs of GRAM words, n = 0, and all runs of the `lengths` of short items.

    known: sorted hashes of a bounded item set, others are dropped here already; None keeps all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names, words = batch.column("id").to_numpy(), [words_of(t) for t in batch.column("text").to_pylist()]
            h = np.fromiter((_hashes[w] for ws in words for w in ws), np.uint64)
            bounds = np.cumsum([0, *map(len, words)])
            # words left in its text from each place on
            left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(h))
            ids, prints, places, sizes = [], [], [], []
            for n in (0, *lengths):
                g = _grams(h, n or GRAM)
                at = np.flatnonzero(left[: len(g)] >= n) if n else at_ends(winnow(g, WINDOW, left >= RUN), g, left)
                v = g[at].view(np.int64)
                if known is not None:
                    inside = known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v if len(known) else np.zeros(len(v), bool)
                    at, v = at[inside], v[inside]
                text = np.searchsorted(bounds, at, "right") - 1
                ids.append(names[text])
                prints.append(v)
                places.append((at - bounds[text]).astype(np.int32))
                sizes.append(np.full(len(v), n, np.int32))
            flat = [np.concatenate(x) for x in (ids, prints, places, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["id", "print", "pos", "n"])

    return texts.mapInArrow(run, PRINT_SCHEMA)


def _longest(item: list[str], words: list[str], diagonals: list[int]) -> tuple[int, int, int]:
    """(length, place in the item, place in the text) of the longest common run on one of the diagonals (place in the text less that in the item).

    Of equal ones the first in the item, then in the text.
    """
    a, b = np.array([_hashes[w] for w in item], np.uint64), np.array([_hashes[w] for w in words], np.uint64)
    best: tuple[int, int, int] = (0, 0, 0)
    for d in diagonals:
        q, p = max(0, -d), max(0, d)
        same = a[q : len(b) - d] == b[p : p + len(a) - q]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        if len(edges):
            n = edges[1::2] - edges[::2]
            i = int(n.argmax())
            best = max(best, (int(n[i]), -(q + int(edges[2 * i])), -(p + int(edges[2 * i]))))
    return best[0], -best[1], -best[2]


def leaked_items(texts: DataFrame, items: DataFrame, known: int = KNOWN) -> DataFrame:
    """(item_id, doc_id, n_words, item_start, doc_start): the longest run of words that a text shares with an item.

    Where fingerprints meet, the whole diagonal of the two texts is compared. texts and items are (id long, text string). A text counts if the run has RUN words or, for a shorter item, is the
    whole item. Null, empty and wordless texts and items never count; ids should be unique among items. Exact: winnowing
    misses no such run (words are compared by 64-bit hashes).
    """
    items = items.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    texts = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    prints = written(item_prints(items), "prints")
    lengths = sorted(r[0] for r in prints.where("n > 0").select("n").distinct().limit(RUN).collect())  # below RUN
    total = prints.limit(known + 1).count()
    few = total <= known
    values = np.unique(prints.select("print").distinct().toArrow().column(0).to_numpy()) if few else None
    found = text_prints(texts, lengths, values)
    own = prints.select("print", "n", F.col("id").alias("item_id"), F.col("pos").alias("q"))
    hits = found.join(F.broadcast(own) if total <= min(known, BROADCAST_ROWS) else own, ["print", "n"]).select("item_id", F.col("id").alias("doc_id"), (F.col("pos") - F.col("q")).alias("d"))
    # a diagonal counts once, so that a pair has fewer of them than both have words
    pairs = written(hits.distinct().groupBy("doc_id", "item_id").agg(F.collect_list("d").alias("diagonals")), "hits")
    both = pairs.join(texts.select(F.col("id").alias("doc_id"), F.col("text").alias("doc_text")), "doc_id").join(
        items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id"
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for r in batch.to_pylist():
                item = words_of(r["item_text"])
                n, q, p = _longest(item, words_of(r["doc_text"]), r["diagonals"])
                if n >= min(RUN, len(item)):
                    rows.append((r["item_id"], r["doc_id"], n, q, p))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["item_id", "doc_id", "n_words", "item_start", "doc_start"])

    return both.mapInArrow(extend, "item_id long, doc_id long, n_words int, item_start int, doc_start int")
