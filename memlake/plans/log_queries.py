"""Queries over the logs: time buckets, latest rows, set operations, counters, episodes and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import BUCKET_MINUTES, DAY, TIME_SCALES, WEEK, bucket, clamp, decayed, epoch, ladder, normalised, scope_key, stage, time_code
from memlake.operators.buckets import bucketed
from memlake.operators.latest import add_missing, complete, latest_wins, upsert, without
from memlake.plans.registry import registry
from memlake.sources.tables import table

#: "Now" of every query, an explicit value.
NOW = 1_790_000_000

QUERIES, SQL, query = registry()


# latest row of each key, settled by all columns that the queries read
LAST_SCHEMAS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, last_updated_ts DESC, status DESC, salience DESC) AS r FROM memory_schemas) WHERE r = 1)"""
LAST_CANDS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_id, candidate_kind, candidate_id ORDER BY loaded_at DESC, rrf_score DESC NULLS LAST, decision, dense_cosine DESC NULLS LAST, lexical_rank NULLS LAST, applicability DESC NULLS LAST, selected_position NULLS LAST) AS r FROM retrieval_trace_candidates) WHERE r = 1)"""
LAST_CALLS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY loaded_at DESC, response_chars DESC NULLS LAST) AS r FROM context_recall_events) WHERE r = 1)"""
LAST_RUNS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(retrieval_id)) ORDER BY loaded_at DESC, retrieval_id) AS r FROM retrieval_trace_runs) WHERE r = 1)"""
LAST_EPISODES = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, recalled_count DESC) AS r FROM episodic_memories) WHERE r = 1)"""


def schemas(s: SparkSession, d: str) -> DataFrame:
    return latest_wins(table(s, d, "memory_schemas"), ["id"], [F.desc("loaded_at"), F.desc("last_updated_ts"), F.desc("status"), F.desc("salience")])


def candidates(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc("loaded_at"), F.col("rrf_score").desc_nulls_last(), F.asc("decision"), F.col("dense_cosine").desc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), F.col("applicability").desc_nulls_last(), F.col("selected_position").asc_nulls_last()]
    rows = table(s, d, "retrieval_trace_candidates")
    # NaN sorts above all numbers, in DuckDB too
    return latest_wins(rows, ["retrieval_id", "candidate_kind", "candidate_id"], order)


def calls(s: SparkSession, d: str) -> DataFrame:
    return latest_wins(table(s, d, "context_recall_events"), ["context_id"], [F.desc("loaded_at"), F.col("response_chars").desc_nulls_last()])


def runs(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "retrieval_trace_runs").withColumn("key", F.lower(F.trim("retrieval_id")))
    return latest_wins(rows, ["key"], [F.desc("loaded_at"), F.asc("retrieval_id")])


def episodes(s: SparkSession, d: str) -> DataFrame:
    return latest_wins(table(s, d, "episodic_memories").drop("embedding"), ["id"], [F.desc("loaded_at"), F.desc("recalled_count")])


@query("""WITH c AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS bucket, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)
SELECT g.bucket, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), 86400)) AS bucket) g LEFT JOIN c ON g.bucket = c.bucket""")
def q01_bucket_counts(s, d):
    rows = bucketed(table(s, d, "events"), epoch(F.col("ts")), DAY, {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return rows.withColumn("total", F.round("total", 4))


@query("""SELECT CAST(floor(created_at / 604800) AS BIGINT) * 604800 AS bucket, count(*) FILTER (lower(retrieval_type) = 'context') AS context, count(*) FILTER (lower(retrieval_type) = 'recall') AS recall
FROM context_recall_events GROUP BY 1""")
def q02_bucket_channels(s, d):
    rows = table(s, d, "context_recall_events").withColumn("bucket", bucket(F.col("created_at"), WEEK))
    return rows.groupBy("bucket").agg(*[F.count_if(F.lower("retrieval_type") == c).alias(c) for c in ("context", "recall")])


_WIDTH = "CASE " + " ".join(f"WHEN s <= {m * 60 * 40} THEN {m * 60}" for m in BUCKET_MINUTES[:-1]) + f" ELSE {BUCKET_MINUTES[-1] * 60} END"


@query(f"""WITH w AS (SELECT max(created_at) - min(created_at) AS s FROM retrieval_trace_runs), l AS (SELECT {_WIDTH} AS width FROM w)
SELECT CAST(floor(created_at / width) AS BIGINT) * width AS bucket, CAST(width AS BIGINT) AS width, count(*) AS n FROM retrieval_trace_runs, l GROUP BY 1, 2""")
def q03_histogram_adaptive(s, d):
    rows = table(s, d, "retrieval_trace_runs")
    width = rows.agg(ladder(F.max("created_at") - F.min("created_at")).cast("long").alias("width"))  # one row
    return rows.crossJoin(F.broadcast(width)).groupBy((F.floor(F.col("created_at") / F.col("width")) * F.col("width")).alias("bucket"), "width").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, status, confidence, salience FROM {LAST_SCHEMAS}")
def q04_latest_state(s, d):
    return schemas(s, d).select("id", "status", "confidence", "salience")


@query(f"""SELECT c.retrieval_id, c.candidate_id, e.scope_id, m.status FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id
LEFT JOIN {LAST_SCHEMAS} m ON 'sch_' || m.id = c.candidate_id WHERE c.decision = 'selected' AND c.candidate_kind = 'memory'""")
def q05_occasions(s, d):
    delivered = candidates(s, d).where("decision = 'selected' and candidate_kind = 'memory'")
    # the id inside the text key is parsed once, so that the join is on a number
    shown = delivered.withColumn("id", F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long"))
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "scope_id")
    return shown.join(asked, "retrieval_id").join(schemas(s, d).select("id", "status"), "id", "left").select("retrieval_id", "candidate_id", "scope_id", "status")


@query(f"""SELECT key AS retrieval_id, mode FROM (SELECT *, lower(trim(retrieval_id)) AS key FROM {LAST_RUNS}) r WHERE key IN (SELECT retrieval_id FROM {LAST_CANDS} WHERE decision = 'selected')
AND NOT EXISTS (SELECT 1 FROM {LAST_CANDS} c WHERE c.retrieval_id = r.key AND decision = 'selected' AND coalesce(applicability < threshold, true))""")
def q06_complete_requests(s, d):
    shown = candidates(s, d).where("decision = 'selected'").select(F.col("retrieval_id").alias("key"), "applicability", "threshold")
    failed = F.coalesce(F.col("applicability") < F.col("threshold"), F.lit(True))
    return complete(runs(s, d), shown, "key", failed).select(F.col("key").alias("retrieval_id"), "mode")


@query("""SELECT DISTINCT context_id FROM context_recall_events WHERE context_id NOT IN (SELECT lower(trim(retrieval_id)) FROM retrieval_trace_runs)""")
def q07_outstanding(s, d):
    traced = table(s, d, "retrieval_trace_runs").select(F.lower(F.trim("retrieval_id")).alias("context_id"))
    return without(table(s, d, "context_recall_events").select("context_id"), traced, ["context_id"]).distinct()


@query(f"""WITH c AS (SELECT coalesce(scope_id, 'none') AS scope, count(*) AS n FROM {LAST_SCHEMAS} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, scope) AS k FROM c)
SELECT CASE WHEN k <= 8 THEN scope ELSE 'other scopes' END AS scope, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def q08_scope_breakdown(s, d):
    counts = schemas(s, d).groupBy(F.coalesce("scope_id", F.lit("none")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    top = F.broadcast(counts.orderBy(F.desc("n"), "scope").limit(8).select(F.col("scope").alias("top")))  # eight rows
    named = counts.join(top, F.col("scope") == F.col("top"), "left")
    return named.groupBy(F.coalesce("top", F.lit("other scopes")).alias("scope")).agg(F.sum("n").alias("n"))


@query("""SELECT scope_id FROM memory_schemas WHERE scope_id IS NOT NULL UNION SELECT scope_id FROM context_recall_events WHERE scope_id IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL""")
def q09_scope_union(s, d):
    parts = [table(s, d, t).select(F.col(c).alias("scope_id")).where("scope_id is not null").distinct() for t, c in (("memory_schemas", "scope_id"), ("context_recall_events", "scope_id"), ("documents", "source"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""SELECT lower(retrieval_type) AS kind, quantile_cont(response_chars, 0.5) AS median, CAST(quantile_disc(response_chars, 0.95) AS DOUBLE) AS p95, count(*) FILTER (response_chars = 0) AS empty FROM context_recall_events GROUP BY 1""")
def q10_size_percentiles(s, d):
    rows = table(s, d, "context_recall_events")
    p95 = F.expr("percentile_disc(0.95) within group (order by response_chars)")
    return rows.groupBy(F.lower("retrieval_type").alias("kind")).agg(F.percentile("response_chars", 0.5).alias("median"), p95.cast("double").alias("p95"), F.count_if(F.col("response_chars") == 0).alias("empty"))


@query(r"""SELECT md5(t) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\r\n\f\v]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY t HAVING count(*) > 1""")
def q11_exact_duplicates(s, d):
    # the texts are reduced to digests before they are shuffled
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.md5(normalised(F.col("text"))).alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""WITH g AS (SELECT *, coalesce(scope_id, '') AS sc, trim(regexp_replace(lower(content_text), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS t FROM {LAST_SCHEMAS})
SELECT id AS canonical, n, best, total FROM (SELECT *, row_number() OVER (PARTITION BY sc, t ORDER BY salience DESC, first_formed_ts, id) AS k, count(*) OVER w AS n, max(confidence) OVER w AS best, round(sum(salience) OVER w, 4) AS total FROM g WINDOW w AS (PARTITION BY sc, t)) WHERE k = 1""")
def q12_dedup_canonical(s, d):
    rows = schemas(s, d).withColumn("digest", F.md5(normalised(F.col("content_text")))).groupBy(F.coalesce("scope_id", F.lit("")), "digest")
    first = F.min(F.struct(-F.col("salience"), F.col("first_formed_ts"), F.col("id")))
    return rows.agg(first["id"].alias("canonical"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"), F.round(F.sum("salience"), 4).alias("total")).select("canonical", "n", "best", "total")


@query("""SELECT user_id, event_id, nxt AS next_id, round((value + nv) / 2, 6) AS mean_value FROM (SELECT *, lead(event_id) OVER w AS nxt, lead(value) OVER w AS nv, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nxt IS NOT NULL
UNION ALL SELECT user_id, min(event_id), NULL, round(min(value), 6) FROM events GROUP BY user_id HAVING count(*) = 1""")
def q24_micro_episodes(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events").withColumns({"next_id": F.lead("event_id").over(w), "nv": F.lead("value").over(w), "pv": F.lag("event_id").over(w)})
    kept = rows.where("next_id is not null or pv is null")  # a lone event is an episode of its own
    return kept.select("user_id", "event_id", "next_id", F.round(F.when(F.col("next_id").isNull(), F.col("value")).otherwise((F.col("value") + F.col("nv")) / 2), 6).alias("mean_value"))


@query("""SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS day, count(*) AS n, min(event_id) AS first_event, count(DISTINCT event_type) AS kinds, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def q25_macro_episodes(s, d):
    rows = table(s, d, "events").groupBy("user_id", bucket(epoch(F.col("ts")), DAY).alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 43200 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM i GROUP BY 1, 2""")
def q26_idle_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("double")
    rows = table(s, d, "events").withColumn("new", F.when(at - F.lag(at).over(w) <= 43_200, 0).otherwise(1))
    return rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(f"SELECT id, round(greatest(0.01, salience * exp(-greatest(0, {NOW} - last_salience_ts) / 604800.0)), 9) AS salience FROM {LAST_EPISODES} WHERE salience IS NOT NULL")
def q27_salience_decay(s, d):
    return episodes(s, d).where("salience is not null").select("id", F.round(decayed(F.col("salience"), F.lit(NOW) - F.col("last_salience_ts")), 9).alias("salience"))


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_partkey, epoch(o_orderdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n, round(sum(exp(-0.6931471805599453 / 31536000 * greatest(0, 1000000000 - a.at))), 6) AS weight FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""")
def q28_coactivation(s, d):
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), epoch(F.col("o_orderdate")).alias("at"))
    # the order's parts as one array (an order has a few lines), then its pairs: one shuffle in place of a self-join
    baskets = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts")).join(orders, "l_orderkey")
    pairs = baskets.select("at", F.posexplode("parts").alias("i", "src"), "parts").select("at", "src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst"))
    half_life = 0.6931471805599453 / 31_536_000
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.exp(-half_life * F.greatest(F.lit(0), 1_000_000_000 - F.col("at")))), 6).alias("weight"))


@query(f"""WITH a AS (SELECT count(DISTINCT scope_id) AS active FROM {LAST_CALLS}), u AS (SELECT candidate_id, count(DISTINCT scope_id) AS scopes, count(DISTINCT split_part(scope_id, ':', 1)) AS kinds, count(DISTINCT session_id) AS sessions
FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON c.retrieval_id = e.context_id WHERE decision = 'selected' AND candidate_kind = 'memory' GROUP BY 1)
SELECT candidate_id, scopes, kinds, sessions, CASE WHEN scopes >= least(8, active) AND round(scopes / active, 4) >= 0.78 AND sessions + CAST(kinds >= 2 AS INT) >= 5 THEN 3 WHEN scopes >= least(4, active) AND round(scopes / active, 4) >= 0.55 AND sessions + CAST(kinds >= 2 AS INT) >= 3 THEN 2
WHEN scopes >= least(2, active) AND round(scopes / active, 4) >= 0.25 AND sessions >= 2 THEN 1 ELSE 0 END AS stage FROM u, a""")
def q29_generalization_stage(s, d):
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "scope_id", "session_id")
    active = asked.agg(F.count_distinct("scope_id").alias("active"))  # one row
    used = candidates(s, d).where("decision = 'selected' and candidate_kind = 'memory'").join(asked, "retrieval_id")
    per = used.groupBy("candidate_id").agg(F.count_distinct("scope_id").alias("scopes"), F.count_distinct(F.split_part("scope_id", F.lit(":"), F.lit(1))).alias("kinds"), F.count_distinct("session_id").alias("sessions"))
    return per.crossJoin(F.broadcast(active)).select("candidate_id", "scopes", "kinds", "sessions", stage(F.col("scopes"), F.col("kinds"), F.col("sessions"), F.col("active")).alias("stage"))


@query(f"""SELECT candidate_id, coalesce(scope_id, 'none') AS scope, round(count(*) FILTER (decision <> 'selected') / (count(*) FILTER (decision <> 'selected') + 3.0 * count(*) FILTER (decision = 'selected') + 1), 6) AS noise
FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON c.retrieval_id = e.context_id WHERE candidate_kind = 'rule' GROUP BY 1, 2""")
def q30_noise_by_scope(s, d):
    rows = candidates(s, d).where("candidate_kind = 'rule'").join(calls(s, d).select(F.col("context_id").alias("retrieval_id"), F.coalesce("scope_id", F.lit("none")).alias("scope")), "retrieval_id")
    bad, good = F.count_if(F.col("decision") != "selected"), F.count_if(F.col("decision") == "selected")
    return rows.groupBy("candidate_id", "scope").agg(F.round(bad / (bad + 3.0 * good + 1), 6).alias("noise"))


@query(f"""SELECT candidate_kind, candidate_id, least(1.0, greatest(0.0, 0.5 + 0.05 * sum(CASE decision WHEN 'selected' THEN 1 WHEN 'suppressed' THEN -1 ELSE 0 END))) AS confidence FROM {LAST_CANDS} GROUP BY 1, 2""")
def q31_learning_projection(s, d):
    units = F.when(F.col("decision") == "selected", 1).when(F.col("decision") == "suppressed", -1).otherwise(0)
    rows = candidates(s, d).groupBy("candidate_kind", "candidate_id").agg(F.sum(units).alias("u"))
    return rows.select("candidate_kind", "candidate_id", clamp(0.5 + 0.05 * F.col("u"), 0.0, 1.0).alias("confidence"))


@query(f"""SELECT candidate_id, policy_version, least(0.7, greatest(0, net - 1) * 0.35) AS inhibition FROM (SELECT candidate_id, policy_version, count(*) FILTER (decision = 'rejected') - count(*) FILTER (decision = 'selected') AS net
FROM {LAST_CANDS} c JOIN {LAST_RUNS} r ON lower(trim(r.retrieval_id)) = c.retrieval_id GROUP BY 1, 2) WHERE net > 1""")
def q32_inhibition(s, d):
    rows = candidates(s, d).join(runs(s, d).select(F.col("key").alias("retrieval_id"), "policy_version"), "retrieval_id")
    net = F.count_if(F.col("decision") == "rejected") - F.count_if(F.col("decision") == "selected")
    return rows.groupBy("candidate_id", "policy_version").agg(net.alias("net")).where("net > 1").select("candidate_id", "policy_version", F.least(F.lit(0.7), (F.col("net") - 1) * 0.35).alias("inhibition"))


@query(f"""SELECT candidate_kind, count(*) AS exposed, count(*) FILTER (decision = 'selected') AS used, count(DISTINCT candidate_id) AS targets, count(DISTINCT candidate_id) FILTER (decision = 'selected') AS used_targets, count(*) FILTER (rrf_score IS NULL OR isnan(rrf_score)) AS unscored, round(avg(applicability), 6) AS mean_applicability FROM {LAST_CANDS} GROUP BY 1""")
def q45_effectiveness(s, d):
    used = F.col("decision") == "selected"
    return candidates(s, d).groupBy("candidate_kind").agg(
        F.count(F.lit(1)).alias("exposed"), F.count_if(used).alias("used"), F.count_distinct("candidate_id").alias("targets"), F.count_distinct(F.when(used, F.col("candidate_id"))).alias("used_targets"),
        F.count_if(F.col("rrf_score").isNull() | F.isnan("rrf_score")).alias("unscored"), F.round(F.avg("applicability"), 6).alias("mean_applicability"),
    )


@query(f"""SELECT candidate_id, count(DISTINCT session_id) AS sessions FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON c.retrieval_id = e.context_id WHERE decision = 'selected' GROUP BY 1 HAVING count(DISTINCT session_id) >= 2""")
def q46_across_tasks(s, d):
    used = candidates(s, d).where("decision = 'selected'").join(calls(s, d).select(F.col("context_id").alias("retrieval_id"), "session_id"), "retrieval_id")
    return used.groupBy("candidate_id").agg(F.count_distinct("session_id").alias("sessions")).where("sessions >= 2")


@query("""SELECT CAST(floor(created_at / 86400) AS BIGINT) * 86400 AS bucket, count(*) AS runs, CAST(sum(selected_total) AS BIGINT) AS selected, CAST(sum(CASE WHEN catalog_truncated = 1 THEN scored_total ELSE 0 END) AS BIGINT) AS truncated_scored FROM retrieval_trace_runs GROUP BY 1""")
def q47_worker_buckets(s, d):
    cut = F.when(F.col("catalog_truncated") == 1, F.col("scored_total")).otherwise(0)
    return table(s, d, "retrieval_trace_runs").groupBy(bucket(F.col("created_at"), DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.sum("selected_total").alias("selected"), F.sum(cut).alias("truncated_scored"))


@query("SELECT event_id, " + ", ".join(f"CAST(round({f}(2 * pi() * epoch(date_trunc('second', ts)) / {sc}.0) / sqrt(7.0) * 1e6) AS BIGINT) AS {f}_{i}" for i, sc in enumerate(TIME_SCALES) for f in ("sin", "cos")) + " FROM events")
def q55_time_code(s, d):
    rows = table(s, d, "events").select("event_id", time_code(epoch(F.col("ts"))).alias("c"))
    return rows.select("event_id", *[F.round(F.col("c")[2 * i + j] * 1e6).cast("long").alias(f"{f}_{i}") for i in range(7) for j, f in enumerate(("sin", "cos"))])


@query("""SELECT kind, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.kind') END AS kind, CASE WHEN json_valid(metadata_json) THEN TRY_CAST(json_extract_string(metadata_json, '$.n') AS BIGINT) END AS x FROM episodic_memories) GROUP BY 1""")
def q56_json_props(s, d):
    v = F.try_parse_json("metadata_json")
    rows = table(s, d, "episodic_memories").select(F.try_variant_get(v, "$.kind", "string").alias("kind"), F.try_variant_get(v, "$.n", "bigint").alias("x"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("""SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prior FROM events""")
def q58_chronological_visibility(s, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)  # what came strictly before
    return table(s, d, "events").select("event_id", F.count(F.when(F.col("event_type") == "purchase", 1)).over(w).alias("prior"))


@query(f"""SELECT m.id, coalesce(exposed, 0) AS exposed, coalesce(used, 0) AS used, CASE WHEN coalesce(exposed, 0) = 0 THEN -1.0 ELSE round(used / exposed, 6) END AS use_rate FROM {LAST_SCHEMAS} m
LEFT JOIN (SELECT candidate_id, count(*) AS exposed, count(*) FILTER (decision = 'selected') AS used FROM {LAST_CANDS} WHERE candidate_kind = 'memory' GROUP BY 1) c ON c.candidate_id = 'sch_' || m.id""")
def q59_memory_table(s, d):
    per = candidates(s, d).where("candidate_kind = 'memory'").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("exposed"), F.count_if(F.col("decision") == "selected").alias("used"))
    per = per.withColumn("id", F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long")).drop("candidate_id")
    rows = schemas(s, d).select("id").join(per, "id", "left").fillna(0, ["exposed", "used"])
    return rows.withColumn("use_rate", F.when(F.col("exposed") == 0, -1.0).otherwise(F.round(F.col("used") / F.col("exposed"), 6)))


@query(f"""SELECT coalesce(e.session_id, 'none') AS session_id, count(*) AS calls, count(r.retrieval_id) AS traced, CAST(coalesce(sum(r.selected_total), 0) AS BIGINT) AS returned, min(e.created_at) AS started, max(e.created_at) AS ended, bool_or(coalesce(e.response_chars, 0) = 0) AS any_empty
FROM {LAST_CALLS} e LEFT JOIN {LAST_RUNS} r ON lower(trim(r.retrieval_id)) = e.context_id GROUP BY 1""")
def q60_session_table(s, d):
    rows = calls(s, d).join(runs(s, d).select(F.col("key").alias("context_id"), "selected_total", F.lit(1).alias("t")), "context_id", "left")
    return rows.groupBy(F.coalesce("session_id", F.lit("none")).alias("session_id")).agg(
        F.count(F.lit(1)).alias("calls"), F.count("t").alias("traced"), F.coalesce(F.sum("selected_total"), F.lit(0)).alias("returned"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"), F.bool_or(F.coalesce("response_chars", F.lit(0)) == 0).alias("any_empty")
    )


@query("""SELECT * FROM (SELECT 'episode' AS kind, CAST(id AS VARCHAR) AS key, max(ts) AS last_ts FROM episodic_memories GROUP BY id UNION ALL SELECT 'memory', CAST(id AS VARCHAR), max(last_updated_ts) FROM memory_schemas GROUP BY id UNION ALL SELECT 'rule', CAST(memory_id AS VARCHAR), max(tagged_ts) FROM standing_rules GROUP BY memory_id) ORDER BY last_ts DESC, kind, key LIMIT 30""")
def q61_recent_feed(s, d):
    parts = [
        table(s, d, t).groupBy(F.lit(k).alias("kind"), F.col(i).cast("string").alias("key")).agg(F.max(c).alias("last_ts")).orderBy(F.desc("last_ts"), "key").limit(30)
        for k, t, i, c in (("episode", "episodic_memories", "id", "ts"), ("memory", "memory_schemas", "id", "last_updated_ts"), ("rule", "standing_rules", "memory_id", "tagged_ts"))
    ]
    return parts[0].union(parts[1]).union(parts[2]).orderBy(F.desc("last_ts"), "kind", "key").limit(30)


@query("""SELECT coalesce(lifecycle_version, 'none') AS version, lower(retrieval_type) AS kind, count(*) AS calls, bool_or(coalesce(TRY_CAST(substr(lifecycle_version, 2) AS INT) >= 9, false)) AS current FROM context_recall_events GROUP BY 1, 2""")
def q62_lifecycle_versions(s, d):
    current = F.coalesce(F.substring("lifecycle_version", 2, 10).try_cast("int") >= 9, F.lit(False))
    return table(s, d, "context_recall_events").groupBy(F.coalesce("lifecycle_version", F.lit("none")).alias("version"), F.lower("retrieval_type").alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.bool_or(current).alias("current"))


@query("""SELECT regexp_replace(regexp_replace(lower(trim(source)), '/+$', ''), '[-_]+', '-', 'g') AS scope, split_part(lower(trim(source)), ':', 1) AS kind, count(DISTINCT source) AS spellings, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2""")
def q63_scope_keys(s, d):
    rows = table(s, d, "documents").where("source is not null")
    return rows.groupBy(scope_key(F.col("source")).alias("scope"), F.split_part(F.lower(F.trim("source")), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count_distinct("source").alias("spellings"), F.count(F.lit(1)).alias("n"))


@query("""SELECT m.episode_id, arg_min(p.id, (CASE p.scale WHEN 'fine' THEN 0 ELSE 1 END) * 1000000000 + p.id) AS prototype_id FROM (SELECT DISTINCT episode_id, prototype_id FROM episode_prototype_map WHERE episode_id IS NOT NULL) m JOIN (SELECT id, min(lower(trim(scale))) AS scale FROM semantic_prototypes GROUP BY id) p ON p.id = m.prototype_id GROUP BY 1""")
def q64_episode_prototype(s, d):
    scale = table(s, d, "semantic_prototypes").groupBy(F.col("id").alias("prototype_id")).agg(F.min(F.lower(F.trim("scale"))).alias("scale"))
    links = table(s, d, "episode_prototype_map").where("episode_id is not null").select("episode_id", "prototype_id").join(scale, "prototype_id")
    fine_first = F.struct(F.when(F.col("scale") == "fine", 0).otherwise(1), F.col("prototype_id"))
    return links.groupBy("episode_id").agg(F.min_by("prototype_id", fine_first).alias("prototype_id"))


@query("""SELECT prototype_id, episode_id, k AS place FROM (SELECT prototype_id, episode_id, row_number() OVER (PARTITION BY prototype_id ORDER BY episode_id DESC) AS k FROM (SELECT DISTINCT prototype_id, episode_id FROM episode_prototype_map WHERE prototype_id IS NOT NULL AND episode_id IS NOT NULL)) WHERE k <= 8""")
def q65_prototype_members(s, d):
    rows = table(s, d, "episode_prototype_map").select("prototype_id", "episode_id").dropna().distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("prototype_id").orderBy(F.desc("episode_id"))).cast("long")).where("place <= 8")


@query("""SELECT min(x) AS earliest FROM (SELECT min(ts) AS x FROM episodic_memories WHERE ts > 0 UNION ALL SELECT min(first_formed_ts) FROM memory_schemas WHERE first_formed_ts > 0 UNION ALL SELECT min(created_at) FROM context_recall_events WHERE created_at > 0 UNION ALL SELECT min(tagged_ts) FROM standing_rules WHERE tagged_ts > 0)""")
def q66_earliest_history(s, d):
    parts = [table(s, d, t).where(F.col(c) > 0).agg(F.min(c).alias("x")) for t, c in (("episodic_memories", "ts"), ("memory_schemas", "first_formed_ts"), ("context_recall_events", "created_at"), ("standing_rules", "tagged_ts"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).agg(F.min("x").alias("earliest"))


@query("""SELECT id, scope_id, last_updated_ts FROM """ + LAST_SCHEMAS + """ ORDER BY last_updated_ts DESC, id DESC LIMIT 50 OFFSET 100""")
def q68_page(s, d):
    return schemas(s, d).select("id", "scope_id", "last_updated_ts").orderBy(F.desc("last_updated_ts"), F.desc("id")).offset(100).limit(50)


@query("""SELECT k AS reason, count(*) AS runs, CAST(sum(CAST(json_extract_string(gate_rejections_json, '$.' || k) AS BIGINT)) AS BIGINT) AS rejected FROM (SELECT gate_rejections_json, unnest(json_keys(gate_rejections_json)) AS k FROM retrieval_trace_runs WHERE json_valid(gate_rejections_json)) GROUP BY 1""")
def q74_gate_rejections(s, d):
    rows = table(s, d, "retrieval_trace_runs").select(F.explode(F.from_json("gate_rejections_json", "map<string,bigint>")).alias("reason", "n"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("rejected"))


#: From this load on a link counts as new in q75 and q110; one without a time of loading does, too.
LOADED = "2025-10-01 00:00:00"


@query("""SELECT DISTINCT episode_id, prototype_id FROM episode_prototype_map WHERE episode_id IS NOT NULL AND prototype_id IS NOT NULL""")
def q75_insert_or_ignore(s, d):
    """The links known before a load, and those of the load that they lack."""
    rows = table(s, d, "episode_prototype_map").dropna(subset=["episode_id", "prototype_id"])
    known = F.coalesce(F.col("loaded_at").cast("timestamp") < F.lit(LOADED).cast("timestamp"), F.lit(False))
    pairs = lambda df: df.select("episode_id", "prototype_id")
    return add_missing(pairs(rows.where(known)).distinct(), pairs(rows.where(~known)), ["episode_id", "prototype_id"])


@query(f"""SELECT episode_id, prototype_id, bool_or(coalesce(loaded_at < TIMESTAMP '{LOADED}', false)) AS known FROM episode_prototype_map WHERE episode_id IS NOT NULL AND prototype_id IS NOT NULL GROUP BY 1, 2""")
def q110_insert_or_ignore_late(s, d):
    """The links known before a load and those that it adds; links that it repeats are ignored."""
    rows = table(s, d, "episode_prototype_map").dropna(subset=["episode_id", "prototype_id"])
    known = F.coalesce(F.col("loaded_at").cast("timestamp") < F.lit(LOADED).cast("timestamp"), F.lit(False))
    rows = rows.select("episode_id", "prototype_id", known.alias("known"))
    return add_missing(rows.where("known").distinct(), rows.where("not known"), ["episode_id", "prototype_id"])


@query("""WITH o AS (SELECT id, max(support_count) AS c, max(variance) AS v FROM semantic_prototypes WHERE logic_version = '0' GROUP BY id), n AS (SELECT id, max(support_count) AS c, max(variance) AS v FROM semantic_prototypes WHERE logic_version <> '0' GROUP BY id)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.c, o.c) AS support_count, coalesce(n.v, o.v) AS variance FROM o FULL JOIN n ON o.id = n.id""")
def q76_upsert(s, d):
    rows = lambda keep: table(s, d, "semantic_prototypes").where(keep).groupBy("id").agg(F.max("support_count").alias("support_count"), F.max("variance").alias("variance"))
    return upsert(rows("logic_version = '0'"), rows("logic_version <> '0'"), ["id"], ["support_count", "variance"])


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(*) FILTER (epoch(loaded_at) - {c} > 3600) AS late_hour, count(*) FILTER (epoch(loaded_at) - {c} > 604800) AS late_week FROM {t}" for t, c in (("episodic_memories", "ts"), ("context_recall_events", "created_at"), ("retrieval_trace_runs", "created_at"), ("standing_rules", "tagged_ts"))))
def q77_arrival_delay(s, d):
    parts = []
    for t, c in (("episodic_memories", "ts"), ("context_recall_events", "created_at"), ("retrieval_trace_runs", "created_at"), ("standing_rules", "tagged_ts")):
        late = F.unix_micros(F.col("loaded_at").cast("timestamp")) / 1e6 - F.col(c)
        parts.append(table(s, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.count_if(late > 3_600).alias("late_hour"), F.count_if(late > WEEK).alias("late_week")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""SELECT lower(trim(status)) AS status, count(*) AS n, min(salience) AS low, round(avg(salience), 6) AS mean, max(salience) AS high, count(*) FILTER (generalization_stage NOT BETWEEN 0 AND 3) AS invalid_stage FROM {LAST_SCHEMAS} GROUP BY 1""")
def q78_health(s, d):
    return schemas(s, d).groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("salience").alias("low"), F.round(F.avg("salience"), 6).alias("mean"), F.max("salience").alias("high"), F.count_if(~F.col("generalization_stage").between(0, 3)).alias("invalid_stage"))


@query(f"""SELECT id, round(greatest(0, salience - 0.15), 6) AS salience, salience - 0.15 < 0.30 AS labile FROM {LAST_SCHEMAS} WHERE lower(trim(status)) = 'active' AND {NOW} - first_formed_ts > 30 * 86400 AND 'sch_' || id NOT IN (SELECT candidate_id FROM retrieval_trace_candidates WHERE decision = 'selected')""")
def q79_decay_unused(s, d):
    used = table(s, d, "retrieval_trace_candidates").where("decision = 'selected'").select(F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long").alias("id")).where("id is not null")
    idle = schemas(s, d).where((F.lower(F.trim("status")) == "active") & (F.lit(NOW) - F.col("first_formed_ts") > 30 * DAY))
    return without(idle, used, ["id"]).select("id", F.round(F.greatest(F.lit(0), F.col("salience") - 0.15), 6).alias("salience"), (F.col("salience") - 0.15 < 0.30).alias("labile"))


@query(f"""SELECT scope_id, min(a) AS first_seen, max(b) AS last_seen, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(recalls) AS BIGINT) AS recalls FROM (SELECT scope_id, min(created_at) AS a, max(created_at) AS b, count(DISTINCT session_id) AS sessions, count(*) FILTER (lower(retrieval_type) = 'recall') AS recalls FROM {LAST_CALLS} WHERE trim(scope_id) <> '' GROUP BY 1) GROUP BY 1""")
def q80_scope_registry(s, d):
    return calls(s, d).where("trim(scope_id) <> ''").groupBy("scope_id").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count_distinct("session_id").alias("sessions"), F.count_if(F.lower("retrieval_type") == "recall").alias("recalls"))
