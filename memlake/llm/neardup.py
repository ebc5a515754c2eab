"""Near-duplicate records: pairs of texts by their word sets, pairs of vectors by their cosine.

Neither loses a pair: what both compare first is a bound, and the rest is verified exactly.

Texts: a fingerprint has a bit for each word (a 64-bit hash) and is mapped to bit counts per segment; the Manhattan distance of the counts never
exceeds the number of differing bits. Its segments are the SEGMENTS ranges of hashes, of whose counts
nearly all are 0. Two sets that are similar enough agree in so many counts that they share three of their rarest ones
(prefix argument): these triples are the grid's cells. On candidates a coarser embedding of COARSE segments gives the bound.

Vectors: all pairs that the angles to the centres of `memlake.llm.links` leave are bounded by their projections on some orthonormal lines. In a
hundred dimensions quantised projections and the largest Manhattan distance that the least cosine allows would let most pairs pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.cells import usable_vector
from memlake.llm.links import near_pairs, piled
from memlake.plans.runtime import broadcast_if_small, written

SEGMENTS, COARSE = 1 << 16, 32
#: Sets of up to SHORT words meet in triples of their rarest segments, sets of LONG words or more in single ones.
SHORT = 40


def word_set(text: Column) -> Column:
    """Distinct lower-case runs of Unicode letters and digits; null for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)")), F.lower))


def _classes(df: DataFrame) -> DataFrame:
    """(id, head, bits): each id's word hashes in order, and the smallest id with the same ones."""
    bits = F.array_sort(F.array_distinct(F.transform(word_set(F.col("text")), lambda w: F.xxhash64(w))))
    rows = df.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", bits.alias("bits")).where(F.size("bits") > 0)
    return rows.select("id", "bits", F.xxhash64("bits").alias("digest"), F.xxhash64("bits", F.lit(3)).alias("digest2"))


def similar_texts(texts: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Pairs of different word sets, and the classes of equal ones, of `texts` (id long, text string).

    Returns (head_1, head_2, jaccard) of classes whose common words make up at least `least` (2/3 or more) of the words of both, and (id,
    head) of every id that has words; a class is named by its smallest id. Null, empty and wordless texts belong to no class.
    Repeated rows count once; an id with several texts belongs to several classes. Nothing is lost: the candidate
    search and the bounds are exact (up to equal 64-bit hashes of different words).
    """
    if least < 2 / 3:
        raise ValueError("sets of one or two words are compared as classes only, which needs a similarity of 2/3 or more")
    rows = written(_classes(texts).distinct(), "words")
    heads = rows.groupBy("digest", "digest2").agg(F.min("id").alias("head"), F.first("bits").alias("bits"))
    classes = rows.join(heads.select("digest", "digest2", "head"), ["digest", "digest2"]).select("id", "head")
    # how many classes touch each segment: at most SEGMENTS numbers
    touched = heads.select(F.explode("bits").alias("bit")).groupBy((F.col("bit") % SEGMENTS).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(SEGMENTS, np.int64)
    for batch in touched.withColumn("s", F.pmod("s", F.lit(SEGMENTS))).toArrow().to_batches():
        np.add.at(counts, batch.column("s").to_numpy(), batch.column("n").to_numpy())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each grid cell of each class."""
        for batch in batches:
            cells, owners, sizes = [], [], []
            for head, bits in zip(batch.column("head").to_pylist(), batch.column("bits").to_pylist()):
                n = len(bits)
                need = ceil(round(least * n, 9))
                segment = [b % SEGMENTS for b in bits]
                times: dict[int, int] = {}
                tokens = []  # the k-th bit of a segment is a token of its own
                for s in sorted(segment, key=lambda s: (counts[s], s)):
                    times[s] = times.get(s, 0) + 1
                    tokens.append(s + SEGMENTS * times[s])
                found = []
                if 3 <= n <= SHORT:
                    found += [hash(x) for x in combinations(tokens[: n - need + 3], 3)]
                if n >= int(SHORT * least):
                    found += [hash((t,)) for t in tokens[: n - need + 1]]
                cells += found
                owners += [head] * len(found)
                sizes += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int32())], names=["cell", "head", "n"])

    grid = heads.select("head", "bits").mapInArrow(keys, "cell long, head long, n int")
    other = grid.select("cell", F.col("head").alias("other"), F.col("n").alias("m"))
    pairs = grid.join(other, "cell").where((F.col("head") < F.col("other")) & (F.col("m") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("m") - 1e-9)).select("head", "other").distinct()
    sets = heads.select("head", "bits", _coarse(F.col("bits")).alias("counts"))
    both = pairs.join(sets, "head").join(sets.select(F.col("head").alias("other"), F.col("bits").alias("bits2"), F.col("counts").alias("counts2")), "other")
    a, b = F.size("bits"), F.size("bits2")
    manhattan = F.aggregate(F.zip_with("counts", "counts2", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = both.where(manhattan <= (1 - least) / (1 + least) * (a + b) + 1e-9)
    common = F.size(F.array_intersect("bits", "bits2"))
    verified = near.withColumn("jaccard", common / (a + b - common)).where(F.col("jaccard") >= least)
    return verified.select(F.col("head").alias("head_1"), F.col("other").alias("head_2"), "jaccard"), classes


def _coarse(bits: Column) -> Column:
    """Bit counts of COARSE segments."""
    own = F.transform(bits, lambda b: F.pmod(b, F.lit(COARSE)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(COARSE - 1)), lambda s: F.size(F.filter(own, lambda x: x == s)))


def expand_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (id_1, id_2), id_1 < id_2: members of linked classes and of the same class."""
    one, two = classes.select(F.col("id").alias("a"), F.col("head").alias("head_1")), classes.select(F.col("id").alias("b"), F.col("head").alias("head_2"))
    across = pairs.join(one, "head_1").join(two, "head_2").select("a", "b")
    within = one.join(two, F.col("head_1") == F.col("head_2")).where(F.col("a") < F.col("b")).select("a", "b")
    return across.unionByName(within).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")).distinct()


def similar_vectors(vectors: DataFrame, least: float = 0.97) -> tuple[DataFrame, DataFrame]:
    """Pairs of different vectors, and the classes of equal ones, of `vectors` (id long, vec array<float>).

    Returns (head_1, head_2) of classes whose cosine, rounded to 9 decimals, is at least `least`, and (id, head) of the members
    of classes of more than one id. Only vectors that are word for word equal share a class here; a scaled copy is a pair.
    Null, empty, all-zero and non-finite vectors belong to nothing; different lengths aren't compared; repeated rows
    count once. Nothing is lost, whatever the number of vectors.
    """
    digests = vectors.select("id", F.xxhash64("vec").alias("digest"), F.xxhash64("vec", F.lit(3)).alias("digest2")).distinct()
    heads = digests.groupBy("digest", "digest2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # only members of classes of several ids; all others stand for themselves
    classes = written(digests.join(heads, ["digest", "digest2"]).select("id", "head"), "copies")
    spare = classes.where(F.col("id") != F.col("head")).select("id")
    reps = vectors.join(broadcast_if_small(spare), "id", "left_anti") if spare.limit(1).count() else vectors
    pairs = near_pairs(piled(reps), least)
    return pairs.select(F.col("id_1").alias("head_1"), F.col("id_2").alias("head_2")), classes


def vector_classes(pairs: DataFrame, classes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, head, links) of every usable vector: its class of equal vectors, named by the smallest id, and the number of other classes that are near.

    `pairs` and `classes` are `similar_vectors`' result for `vectors`. Copies aren't expanded into pairs.
    """
    links = pairs.select(F.explode(F.array("head_1", "head_2")).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("links"))
    usable = vectors.where(usable_vector(F.col("vec"))).select("id").distinct()
    named = usable.join(classes.withColumnRenamed("head", "own"), "id", "left").select("id", F.coalesce("own", "id").alias("head"))
    return named.join(links, "head", "left").select("id", "head", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def expand_vectors(pairs: DataFrame, classes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct (id_1, id_2) of `similar_vectors`' result; members of a class with an unusable vector are no pair."""
    usable = vectors.join(classes.select("id"), "id", "left_semi").where(usable_vector(F.col("vec"))).select("id").distinct()
    own = classes.join(usable, "id")
    ends = pairs.select(F.explode(F.array("head_1", "head_2")).alias("id")).distinct()
    lone = ends.join(own.select(F.col("head").alias("id")), "id", "left_anti").select("id", F.col("id").alias("head"))
    return expand_pairs(pairs, own.unionByName(lone))
