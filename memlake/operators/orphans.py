"""References whose target is missing, deleted or younger than the reference.

Parent keys become a blocked Bloom filter, one 64-bit word per block, built by a grouped `bit_or`. A reference that the filter
rejects is proved to be an orphan and skips the exact join; only the references that it lets pass are joined with the parents.

The filter grows with the keys, so that it always rejects alike. It is broadcast in parts of bounded size, each to the references
whose blocks it holds; a filter of more than MAX_PARTS parts meets the references in a shuffle by block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.runtime import written

#: Keys for each 64-bit block of the filter, the most blocks of a part (about 40 MB in a hash relation), and the most parts that are broadcast.
KEYS_PER_BLOCK, MAX_BLOCKS, MAX_PARTS = 5, 1 << 19, 8


@dataclass(frozen=True)
class Reference:
    """`field` names the referring column (`table.column`); `key` and `loaded_at` are expressions over `rows`."""

    field: str
    rows: DataFrame
    key: Column
    loaded_at: Column
    target: str
    parents: DataFrame
    parent_key: Column
    parent_loaded_at: Column


def text_key(key: Column) -> Column:
    """Keys compare as text, trimmed and in lower case; null stays null."""
    return F.lower(F.regexp_replace(key.cast("string"), r"^\s+|\s+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit word, from a second hash."""
    h = F.xxhash64(key, F.lit(17))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_filter(parents: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the parents' keys; at most `blocks` rows."""
    hashed = F.struct("target", "key")
    return parents.groupBy(_block(hashed, blocks).alias("block")).agg(F.bit_or(_mask(hashed)).alias("word"))


def probed(refs: DataFrame, parents: DataFrame, keys: int) -> DataFrame:
    """`refs` (target, key, ...) with `passes`: false proves that `parents` (target, key), `keys` in number, lacks the key."""
    blocks = max(1, -(-keys // KEYS_PER_BLOCK))
    hashed = F.struct("target", "key")
    words, columns = bloom_filter(parents, blocks), refs.columns
    rows = refs.withColumn("block", _block(hashed, blocks))
    parts = -(-blocks // MAX_BLOCKS)
    if parts == 1:
        met = rows.join(F.broadcast(words), "block", "left")  # at most MAX_BLOCKS rows
    elif parts <= MAX_PARTS:
        words = written(words, "filter")
        inside = lambda df, p: df.where(F.floor(F.col("block") / MAX_BLOCKS) == p)
        met = reduce(DataFrame.unionByName, [inside(rows, p).join(F.broadcast(inside(words, p)), "block", "left") for p in range(parts)])
    else:
        met = rows.join(words, "block", "left")
    mask = _mask(hashed)
    return met.select(*columns, F.coalesce(F.col("word").bitwiseAND(mask) == mask, F.lit(False)).alias("passes"))


def find_orphans(references: list[Reference], deletions: DataFrame) -> DataFrame:
    """Distinct (ref_field, ref_month, missing_key, orphan_kind) of all references; see TESTDATA.md, p2_found.

    `deletions` has (target, key) of tombstones, keys as `text_key` gives them. A null key is no reference; an empty one is
    an ordinary key. A referring row without loaded_at has a null month and is never late; parents whose loaded_at are all
    null make nothing late. Repeated rows give one row. Hot keys are pre-aggregated to one row per field, key and month
    before any shuffle.
    """
    refs = None
    parents = None
    seen = set()
    for r in references:
        one = (
            r.rows.select(F.lit(r.field).alias("ref_field"), F.lit(r.target).alias("target"), text_key(r.key).alias("key"), r.loaded_at.alias("at"))
            .where(F.col("key").isNotNull())
            .groupBy("ref_field", "target", "key", F.date_format("at", "yyyy-MM").alias("ref_month"))
            .agg(F.min("at").alias("first_ref"))
        )
        refs = one if refs is None else refs.unionByName(one)
        if r.target not in seen:
            seen.add(r.target)
            own = (
                r.parents.select(F.lit(r.target).alias("target"), text_key(r.parent_key).alias("key"), r.parent_loaded_at.alias("at"))
                .where(F.col("key").isNotNull())
                .groupBy("target", "key")
                .agg(F.min("at").alias("first_parent"))
            )
            parents = own if parents is None else parents.unionByName(own)
    parents = written(parents, "parents")
    found = probed(written(refs, "references"), parents, parents.count())
    orphans = found.where("not passes").select("ref_field", "target", "key", "ref_month")
    rest = found.where("passes").drop("passes")
    verified = rest.join(parents.withColumn("has", F.lit(True)), ["target", "key"], "left")
    late = verified.where(F.col("first_ref") < F.col("first_parent")).select("ref_field", "ref_month", F.col("key").alias("missing_key"), F.lit("late").alias("orphan_kind"))
    absent = verified.where(F.col("has").isNull()).select("ref_field", "target", "key", "ref_month").unionByName(orphans)
    gone = deletions.select("target", "key").where(F.col("key").isNotNull()).distinct().withColumn("gone", F.lit(True))
    kinds = absent.join(gone, ["target", "key"], "left").select(
        "ref_field", "ref_month", F.col("key").alias("missing_key"), F.when(F.col("gone"), "deleted").otherwise("missing").alias("orphan_kind")
    )
    return kinds.unionByName(late)


def orphan_report(found: DataFrame) -> DataFrame:
    """Keys without a valid target per field, month and kind."""
    return found.groupBy("ref_field", "ref_month", "orphan_kind").agg(F.count(F.lit(1)).alias("keys"))
