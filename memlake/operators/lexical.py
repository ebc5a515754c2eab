"""Full-text ranking, and the terms that mark groups of documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.columns import tokens
from memlake.plans.runtime import written

K1, B = 1.2, 0.75
#: Cues of one pass over the documents, and numbers in one product of a task.
CUES, TILE = 1_000, 1 << 22


def bm25(docs: DataFrame, cues: DataFrame, k: int = 10, block: int = CUES) -> DataFrame:
    """(cue_id, doc_id, score, rank): the `k` best of `docs` (doc_id long, text) for each of `cues` (cue_id long, text), by BM25.

    Statistics are those of all documents that have words. The cues are a stated set, taken in blocks of about `block`: only a block's terms
    and weights travel to the tasks. Two passes over the documents: one counts the documents that have each of the terms, the other scores
    its documents and keeps each cue's `k` best of each task; those meet by cue. The idf is floored at 1e-6. Equal scores (6 decimals) go by
    doc_id. Null and wordless texts have no score; ids should be unique.
    """
    asked = written(cues.select("cue_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 0), "cues")
    words = docs.select("doc_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    parts = max(1, -(-asked.count() // block))
    passes = (asked.where(F.pmod(F.xxhash64("cue_id"), F.lit(parts)) == p).toArrow() for p in range(parts))
    found = reduce(DataFrame.unionByName, [_best_documents(words, one, k) for one in passes])
    order = Window.partitionBy("cue_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _counted(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document, and for each of its known terms (document's place, term's place, times)."""
    lists = batch.column("words")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    keys = (np.repeat(np.arange(len(sizes)), sizes) * len(vocabulary) + terms)[terms >= 0]
    keys, times = np.unique(keys, return_counts=True)
    return sizes, keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), times


def _best_documents(words: DataFrame, cues: pa.Table, k: int) -> DataFrame:
    """(cue_id, doc_id, score): each task's `k` best documents for each cue of one block."""
    lists = cues.column("terms").combine_chunks()
    vocabulary = pc.unique(lists.flatten()) if len(cues) else pa.array([], pa.string())
    ids = cues.column("cue_id").to_numpy()
    wanted = np.zeros((len(vocabulary), len(ids)))
    if len(ids):
        owners = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        wanted[pc.index_in(lists.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False), owners] = 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, have = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            sizes, _, terms, _ = _counted(batch, vocabulary)
            n, length = n + len(sizes), length + int(sizes.sum())
            have += np.bincount(terms, minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([n, length, *have.tolist()]), pa.array(range(-2, len(vocabulary)))], names=["n", "term"])

    counts = words.select("words").mapInArrow(count, "n long, term long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(vocabulary) + 2)
    totals[counts.column("term").to_numpy() + 2] = counts.column("n").to_numpy()
    n, length, have = totals[0], totals[1], totals[2:]
    weight = wanted * np.maximum(1e-6, np.log((n - have + 0.5) / (have + 0.5)))[:, None]
    mean = length / max(1.0, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        step = max(1, TILE // max(1, len(vocabulary), len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes, rows, terms, times = _counted(part, vocabulary)
                factors = np.zeros((len(sizes), len(vocabulary)))
                factors[rows, terms] = times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[rows] / mean))
                found = np.round(factors @ weight, 6).T
                met = (factors > 0).astype(np.float32) @ wanted.astype(np.float32) > 0  # a document without the cue's terms has no score
                found[~met.T] = -1
                least = np.partition(found, len(sizes) - k, axis=1)[:, len(sizes) - k, None] if len(sizes) > k else 0.0
                cue, row = np.nonzero((found >= least) & (found >= 0))
                docs = part.column("doc_id").to_numpy()
                cue, doc, value = np.concatenate([best[0], cue]), np.concatenate([best[1], docs[row]]), np.concatenate([best[2], found[cue, row]])
                order = np.lexsort((doc, -value, cue))
                cue, doc, value = cue[order], doc[order], value[order]
                keep = np.arange(len(cue)) - np.searchsorted(cue, cue, "left") < k
                best = cue[keep], doc[keep], value[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], names=["cue_id", "doc_id", "score"])

    return words.mapInArrow(score, "cue_id long, doc_id long, score double")


def contrastive_terms(docs: DataFrame, group: str, k: int = 8) -> DataFrame:
    """(group, term, weight, rank): terms that mark each group, by tf / sum of tf * ln(1 + N / (1 + df)) over all documents."""
    # a document's words in order, so that the first of equal ones is known without a shuffle by document
    ordered = docs.select(group, F.array_sort(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 3)).alias("words"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 1)))
    words = ordered.select(group, F.explode(F.zip_with("words", before, lambda t, b: F.struct(t.alias("term"), (~t.eqNullSafe(b)).cast("long").alias("d")))).alias("x"))
    tf = words.where("x.term is not null").groupBy(group, F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.sum("x.d").alias("d"))
    df = tf.groupBy("term").agg(F.sum("d").alias("df"))
    totals = tf.groupBy(group).agg(F.sum("tf").alias("total"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    weight = F.round(F.col("tf") / F.col("total") * F.log(1 + F.col("n") / (1 + F.col("df"))), 6)
    scored = tf.join(df, "term").join(totals, group).crossJoin(F.broadcast(n)).withColumn("weight", weight)  # n is one row
    order = Window.partitionBy(group).orderBy(F.col("weight").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(group, "term", "weight", "rank")
