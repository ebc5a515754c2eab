"""Query p2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.orphans import Reference, find_orphans, orphan_report, text_key
from memlake.sources.tables import table

#: (field, referring table, column, target table, its key)
REFERENCES = [
    ("episode_prototype_map.episode_id", "episode_prototype_map", "episode_id", "episodic_memories", "id"),
    ("episode_prototype_map.prototype_id", "episode_prototype_map", "prototype_id", "semantic_prototypes", "id"),
    ("standing_rules.memory_id", "standing_rules", "memory_id", "memory_schemas", "id"),
    ("retrieval_trace_runs.retrieval_id", "retrieval_trace_runs", "retrieval_id", "context_recall_events", "context_id"),
]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    references = [
        Reference(field, table(spark, d, t), F.col(c), F.col("loaded_at"), target, table(spark, d, target), F.col(k), F.col("loaded_at"))
        for field, t, c, target, k in REFERENCES
    ]
    key = text_key(F.col("row_key"))
    key = F.when((F.col("table_name") == "memory_schemas"), F.regexp_replace(key, "^sch_", "")).otherwise(key)
    return find_orphans(references, table(spark, d, "deletions").select(F.col("table_name").alias("target"), key.alias("key")))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p2_found(spark, d))


def _sql(field: str, t: str, c: str, target: str, k: str) -> str:
    key = lambda x: rf"lower(regexp_replace(CAST({x} AS VARCHAR), '^\s+|\s+$', '', 'g'))"
    gone = rf"SELECT regexp_replace({key('row_key')}, '^sch_', '')" if target == "memory_schemas" else f"SELECT {key('row_key')}"
    return f"""
    SELECT DISTINCT '{field}' AS ref_field, strftime(r.at, '%Y-%m') AS ref_month, r.key AS missing_key,
           CASE WHEN p.key IS NOT NULL THEN 'late'
                WHEN r.key IN ({gone} FROM deletions WHERE table_name = '{target}' AND row_key IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS orphan_kind
    FROM (SELECT {key(c)} AS key, loaded_at AS at FROM {t} WHERE {c} IS NOT NULL) r
    LEFT JOIN (SELECT {key(k)} AS key, min(loaded_at) AS first FROM {target} WHERE {k} IS NOT NULL GROUP BY 1) p ON r.key = p.key
    WHERE p.key IS NULL OR r.at < p.first"""


_FOUND_SQL = "\nUNION ALL\n".join(_sql(*r) for r in REFERENCES)

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _FOUND_SQL,
    "p2_report": f"SELECT ref_field, ref_month, orphan_kind, count(*) AS keys FROM ({_FOUND_SQL}) GROUP BY ALL",
}
