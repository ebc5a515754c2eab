"""Queries of texts, JSON, facets, health, and relations between vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import canonical_json, compatible, cosine, elapsed_seconds, facets, folded_tokens, identifiers, meets, offset_time, tokens
from memlake.operators import graph, ranking
from memlake.operators.lexical import bm25
from memlake.operators.search import block_search, cosine_histogram
from memlake.operators.vectors import mean_pair_distance, mean_vectors
from memlake.operators.windows import sentence_windows
from memlake.plans.log_queries import LAST_CALLS, LAST_CANDS, LAST_EPISODES, LAST_RUNS, LAST_SCHEMAS, NOW, calls, candidates, episodes, runs, schemas
from memlake.plans.rank_queries import _PROB, _TRANS, BM25, WIDTH, _counts, _edges, _vectors, _V, cues
from memlake.plans.registry import registry
from memlake.plans.runtime import broadcast_if_small
from memlake.sources.tables import table

QUERIES, SQL, query = registry()

# ---- texts


@query(r"""SELECT doc_id, len(list_distinct(t)) AS n, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS digest FROM (SELECT doc_id, list_filter(flatten(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: list_concat([x], string_split(regexp_replace(regexp_replace(x, '([\p{Ll}\p{N}])(\p{Lu})', '\1_\2', 'g'), '_+', '_', 'g'), '_')))), lambda x: length(x) >= 2) AS t FROM documents WHERE text IS NOT NULL)""")
def q141_identifiers(s, d):
    """How many identifiers, whole or part of a compound, each document has, and a digest of them."""
    rows = table(s, d, "documents").where("text is not null").select("doc_id", identifiers(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(BM25.replace("documents", "(SELECT id AS doc_id, content_text AS text FROM " + LAST_SCHEMAS + ")") + " SELECT cue_id, doc_id AS id, score, rank FROM top WHERE rank <= 10")
def q142_claim_search(s, d):
    """The claims that best match each cue."""
    docs = schemas(s, d).select(F.col("id").alias("doc_id"), F.col("content_text").alias("text"))
    return bm25(docs, cues(s, d)).select("cue_id", F.col("doc_id").alias("id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT id, sha256(concat_ws(chr(10), 'Claim: ' || content_text, 'Class: ' || lower(trim(status)), 'Scope: ' || scope_id)) AS digest, length(concat_ws(' ', content_text, scope_id)) AS cue_chars FROM {LAST_SCHEMAS}""")
def q143_canonical_texts(s, d):
    """Each claim's canonical text, missing parts left out, as a digest."""
    named = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    text = F.concat_ws("\n", named("Claim", F.col("content_text")), named("Class", F.lower(F.trim("status"))), named("Scope", F.col("scope_id")))
    return schemas(s, d).select("id", F.sha2(text, 256).alias("digest"), F.length(F.concat_ws(" ", "content_text", "scope_id")).cast("long").alias("cue_chars"))


@query()
def q144_best_window(s, d):
    """The window of whole sentences of each document that has the most distinct words, and how many."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = sentence_windows(docs).join(docs, "id").select("id", "start", "stop", F.size(F.array_distinct(tokens(F.expr("substring(text, start + 1, stop - start)")))).alias("n"))
    best = F.max_by(F.struct("start", "stop", "n"), F.struct("n", -F.col("start"))).alias("w")
    return rows.groupBy("id").agg(best).select(F.col("id").alias("doc_id"), "w.start", "w.stop", F.col("w.n").alias("words"))


# ---- JSON, facets and times


@query("""SELECT 'gate' AS field, path, count(*) AS n, count(DISTINCT v) AS kinds FROM (SELECT k AS path, json_extract_string(j, '$.' || k) AS v FROM (SELECT gate_rejections_json AS j, unnest(json_keys(gate_rejections_json)) AS k FROM retrieval_trace_runs WHERE json_valid(gate_rejections_json))) GROUP BY 1, 2
UNION ALL SELECT 'metadata', path, count(*), count(DISTINCT v) FROM (SELECT k AS path, json_extract_string(j, '$.' || k) AS v FROM (SELECT metadata_json AS j, unnest(json_keys(metadata_json)) AS k FROM episodic_memories WHERE json_valid(metadata_json))) GROUP BY 1, 2""")
def q145_json_paths(s, d):
    """The paths of two JSON columns, the rows that have each, and their different values."""
    parts = [table(s, d, t).select(F.lit(f).alias("field"), F.explode(facets(F.col(c))).alias("path", "v")) for f, t, c in (("gate", "retrieval_trace_runs", "gate_rejections_json"), ("metadata", "episodic_memories", "metadata_json"))]
    return parts[0].union(parts[1]).groupBy("field", "path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("kinds"))


@query(f"""SELECT id, CASE WHEN NOT coalesce(json_valid(metadata_json), false) THEN 'broken' WHEN len(json_keys(metadata_json)) = 0 THEN 'empty' WHEN json_extract_string(metadata_json, '$.kind') IS NULL THEN 'no kind' ELSE 'ok' END AS verdict, CASE WHEN json_valid(metadata_json) THEN len(json_keys(metadata_json)) ELSE 0 END AS keys FROM {LAST_EPISODES}""")
def q146_json_audit(s, d):
    """Which episodes' JSON is broken, empty or lacks its kind, and how many keys it has."""
    f = facets(F.col("metadata_json"))
    verdict = F.when(f.isNull(), "broken").when(F.size(f) == 0, "empty").when(f["kind"].isNull(), "no kind").otherwise("ok")
    return episodes(s, d).select("id", verdict.alias("verdict"), F.when(f.isNull(), 0).otherwise(F.size(f)).cast("long").alias("keys"))


@query(f"""SELECT id, CASE WHEN json_valid(metadata_json) THEN '{{' || coalesce(string_agg('"' || k || '":"' || CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$."' || k || '"') END || '"', ',' ORDER BY k) FILTER (k <> 'n' AND k <> ''), '') || '}}' END AS json FROM (SELECT id, metadata_json, unnest(CASE WHEN json_valid(metadata_json) AND len(json_keys(metadata_json)) > 0 THEN json_keys(metadata_json) ELSE ['n'] END) AS k FROM {LAST_EPISODES}) GROUP BY id, metadata_json""")
def q147_json_scrub(s, d):
    """Each episode's JSON without one key, in canonical form."""
    f = facets(F.col("metadata_json"))
    return episodes(s, d).select("id", canonical_json(F.map_filter(f, lambda k, _: k != "n")).alias("json"))


@query(f"""SELECT id, CASE WHEN json_valid(metadata_json) THEN coalesce(json_extract_string(metadata_json, '$.kind') = 'micro', true) ELSE true END AS agrees, coalesce(CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.kind') = 'macro' END, false) AS meets FROM {LAST_EPISODES}""")
def q148_facets(s, d):
    """Whether each episode's facets contradict what is asked for, and whether they have all that is required."""
    f = facets(F.col("metadata_json"))
    asked, required = F.create_map(F.lit("kind"), F.lit("micro"), F.lit("colour"), F.lit("red")), F.create_map(F.lit("kind"), F.array(F.lit("macro"), F.lit("mixed")))
    return episodes(s, d).select("id", compatible(asked, f).alias("agrees"), F.coalesce(meets(required, f), F.lit(False)).alias("meets"))


@query("""SELECT table_name, row_key, CASE WHEN row_key = lower(trim(row_key)) THEN CAST(epoch(date_trunc('second', deleted_at)) AS BIGINT) - 5400 END AS at_ts FROM deletions""")
def q149_offset_times(s, d):
    """Times with an offset are read, times without one aren't: tidy keys' times are written with one here."""
    text = F.concat(F.date_format("deleted_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("row_key") == F.lower(F.trim("row_key")), "+01:30").otherwise(""))
    return table(s, d, "deletions").select("table_name", "row_key", offset_time(text).alias("at_ts"))


@query("""SELECT context_id, loaded_at, greatest(0, CAST(floor(epoch(loaded_at)) AS BIGINT) - created_at) AS seconds FROM context_recall_events""")
def q150_elapsed_times(s, d):
    """Delays written as [[dd-]hh:]mm:ss and read back."""
    late = F.greatest(F.lit(0), F.unix_seconds(F.col("loaded_at").cast("timestamp")) - F.col("created_at"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.concat_ws(":", two(F.floor(late / 3_600) % 24), two(F.floor(late / 60) % 60), two(late % 60))
    short = F.concat_ws(":", two(F.floor(late / 60) % 60), two(late % 60))
    text = F.when(late >= 86_400, F.concat(F.floor(late / 86_400).cast("string"), F.lit("-"), hours)).when(late >= 3_600, hours).otherwise(short)
    return table(s, d, "context_recall_events").select("context_id", "loaded_at", elapsed_seconds(text).alias("seconds"))


@query(f"""SELECT e.context_id, e.created_at FROM {LAST_CALLS} e WHERE lower(e.retrieval_type) = 'context' AND (e.scope_id = 'project:harborline' OR e.scope_id IS NULL) AND e.created_at BETWEEN 1740000000 AND 1780000000 AND e.query_text ILIKE '%session%'
AND EXISTS (SELECT 1 FROM {LAST_CANDS} c WHERE c.retrieval_id = e.context_id AND decision = 'selected') AND NOT EXISTS (SELECT 1 FROM {LAST_CANDS} c WHERE c.retrieval_id = e.context_id AND candidate_kind = 'rule' AND decision = 'suppressed')""")
def q151_filtered_retrievals(s, d):
    """Calls of a type, scope, time and wording that returned something and suppressed no rule."""
    rows = calls(s, d).where("lower(retrieval_type) = 'context' and (scope_id = 'project:harborline' or scope_id is null) and created_at between 1740000000 and 1780000000 and query_text ilike '%session%'")
    items = candidates(s, d).withColumnRenamed("retrieval_id", "context_id")
    return rows.join(items.where("decision = 'selected'"), "context_id", "left_semi").join(items.where("candidate_kind = 'rule' and decision = 'suppressed'"), "context_id", "left_anti").select("context_id", "created_at")


# ---- health


@query("""WITH p AS (SELECT id, max(support_count) AS support, max(last_updated_ts) AS at_ts FROM semantic_prototypes GROUP BY id), t AS (SELECT count(*) AS links FROM (""" + _TRANS + f"""))
SELECT count(*) AS prototypes, round(any_value(links) / (count(*) * (count(*) - 1.0)), 9) AS density, round(max(support) / sum(support), 9) AS largest_share, max(support) > 0.5 * sum(support) AS dominated, round(avg(support), 6) AS mean_support, count(*) FILTER ({NOW} - at_ts < 30 * 86400) AS fresh FROM p, t""")
def q152_prototype_health(s, d):
    """Density of the prototypes' graph, whether one prototype dominates, support and freshness."""
    own = table(s, d, "semantic_prototypes").groupBy("id").agg(F.max("support_count").alias("support"), F.max("last_updated_ts").alias("at_ts"))
    links = _counts(s, d).agg(F.count(F.lit(1)).alias("links"))  # one row
    n, total = F.count(F.lit(1)), F.sum("support")
    return own.crossJoin(F.broadcast(links)).agg(
        n.alias("prototypes"), F.round(F.max("links") / (n * (n - 1.0)), 9).alias("density"), F.round(F.max("support") / total, 9).alias("largest_share"), (F.max("support") > 0.5 * total).alias("dominated"),
        F.round(F.avg("support"), 6).alias("mean_support"), F.count_if(F.lit(NOW) - F.col("at_ts") < 30 * 86_400).alias("fresh"),
    )


@query(f"""WITH t AS ({_TRANS}), w AS (SELECT n::DOUBLE AS x FROM t) SELECT count(*) AS links, round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS median, round(quantile_cont(x, 0.9), 6) AS p90, (SELECT round(count(*) FILTER (b.src IS NOT NULL) / count(*), 6) FROM t a LEFT JOIN t b ON a.src = b.dst AND a.dst = b.src) AS mutual FROM w""")
def q153_link_health(s, d):
    """Mean, median and 90th percentile of the links' weights, and the share of links that go both ways."""
    counts = _counts(s, d).withColumn("x", F.col("n").cast("double"))
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    rows = counts.join(back, ["src", "dst"], "left")
    return rows.agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("x"), 6).alias("mean"), F.percentile("x", 0.5).alias("median"), F.round(F.percentile("x", 0.9), 6).alias("p90"), F.round(F.count("back") / F.count(F.lit(1)), 6).alias("mutual"))


@query(f"""SELECT metric, value FROM (SELECT 'claims' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {LAST_SCHEMAS} UNION ALL SELECT 'claims active', CAST(count(*) FILTER (lower(trim(status)) = 'active') AS DOUBLE) FROM {LAST_SCHEMAS} UNION ALL SELECT 'claims salience', round(avg(salience), 6) FROM {LAST_SCHEMAS}
UNION ALL SELECT 'calls', CAST(count(*) AS DOUBLE) FROM {LAST_CALLS} UNION ALL SELECT 'calls empty', CAST(count(*) FILTER (coalesce(response_chars, 0) = 0) AS DOUBLE) FROM {LAST_CALLS} UNION ALL SELECT 'episodes', CAST(count(*) AS DOUBLE) FROM {LAST_EPISODES} UNION ALL SELECT 'episodes recalled', CAST(sum(recalled_count) AS DOUBLE) FROM {LAST_EPISODES})""")
def q154_health_snapshot(s, d):
    """All health figures as rows, each table read once."""
    n = F.count(F.lit(1)).cast("double")
    per = [
        schemas(s, d).agg(n.alias("claims"), F.count_if(F.lower(F.trim("status")) == "active").cast("double").alias("claims active"), F.round(F.avg("salience"), 6).alias("claims salience")),
        calls(s, d).agg(n.alias("calls"), F.count_if(F.coalesce("response_chars", F.lit(0)) == 0).cast("double").alias("calls empty")),
        episodes(s, d).agg(n.alias("episodes"), F.sum("recalled_count").cast("double").alias("episodes recalled")),
    ]
    parts = [df.unpivot([], df.columns, "metric", "value") for df in per]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""SELECT candidate_id, count(*) AS retrieved, count(*) FILTER (decision = 'selected') AS used, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'suppressed') AS suppressed, count(*) FILTER (reason_code = 'wrong_task_facet') AS wrong_task, round(count(*) FILTER (decision = 'selected') / count(*), 6) AS use_rate FROM {LAST_CANDS} WHERE candidate_kind = 'procedure' GROUP BY 1""")
def q155_procedure_counters(s, d):
    own = lambda c, v: F.count_if(F.col(c) == v)
    rows = candidates(s, d).where("candidate_kind = 'procedure'").groupBy("candidate_id")
    return rows.agg(
        F.count(F.lit(1)).alias("retrieved"), own("decision", "selected").alias("used"), own("decision", "rejected").alias("rejected"), own("decision", "suppressed").alias("suppressed"), own("reason_code", "wrong_task_facet").alias("wrong_task"),
        F.round(own("decision", "selected") / F.count(F.lit(1)), 6).alias("use_rate"),
    )


@query(f"""SELECT session_id, calls, success, round(0.6 * success + 0.4 * coalesce(fit, 0), 6) AS composite, success < 0.3 AND calls >= 2 AS anti_pattern FROM (SELECT e.session_id, count(DISTINCT e.context_id) AS calls, round(count(*) FILTER (c.decision = 'selected') / count(*), 6) AS success, avg(c.applicability) AS fit FROM {LAST_CALLS} e JOIN {LAST_CANDS} c ON c.retrieval_id = e.context_id WHERE e.session_id IS NOT NULL GROUP BY 1)""")
def q156_session_scores(s, d):
    asked = calls(s, d).where("session_id is not null").select(F.col("context_id").alias("retrieval_id"), "session_id")
    rows = candidates(s, d).join(asked, "retrieval_id").groupBy("session_id")
    per = rows.agg(F.count_distinct("retrieval_id").alias("calls"), F.round(F.count_if(F.col("decision") == "selected") / F.count(F.lit(1)), 6).alias("success"), F.avg("applicability").alias("fit"))
    return per.select("session_id", "calls", "success", F.round(0.6 * F.col("success") + 0.4 * F.coalesce("fit", F.lit(0.0)), 6).alias("composite"), ((F.col("success") < 0.3) & (F.col("calls") >= 2)).alias("anti_pattern"))


@query(f"""SELECT coalesce(policy_version, 'none') AS policy, count(*) AS runs, round(count(*) FILTER (selected_total = 0 AND scored_total > 0) / count(*), 6) AS false_empty, round(count(*) FILTER (selected_total = 0) / count(*), 6) AS abstained, round(sum(selected_total) / greatest(1, sum(scored_total)), 6) AS precision FROM {LAST_RUNS} GROUP BY 1""")
def q157_replay_metrics(s, d):
    none, n = F.col("selected_total") == 0, F.count(F.lit(1))
    rows = runs(s, d).groupBy(F.coalesce("policy_version", F.lit("none")).alias("policy"))
    return rows.agg(n.alias("runs"), F.round(F.count_if(none & (F.col("scored_total") > 0)) / n, 6).alias("false_empty"), F.round(F.count_if(none) / n, 6).alias("abstained"), F.round(F.sum("selected_total") / F.greatest(F.lit(1), F.sum("scored_total")), 6).alias("precision"))


@query(f"""WITH c AS (SELECT generalization_stage AS stage, count(*) AS n FROM {LAST_SCHEMAS} WHERE generalization_stage BETWEEN 0 AND 3 GROUP BY 1) SELECT stage, n, CAST(sum(n) OVER (ORDER BY stage DESC) AS BIGINT) AS at_least FROM c""")
def q158_stages(s, d):
    """Claims of each stage, and of it or a higher one."""
    counts = schemas(s, d).where("generalization_stage between 0 and 3").groupBy(F.col("generalization_stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("at_least", F.sum("n").over(Window.orderBy(F.desc("stage")).rowsBetween(Window.unboundedPreceding, 0)))  # four rows


@query(f"""SELECT e.session_id, count(DISTINCT c.candidate_kind || c.candidate_id) AS returned, count(DISTINCT c.candidate_kind || c.candidate_id) FILTER (c.applicability IS NOT NULL) AS assessed, count(DISTINCT c.candidate_kind || c.candidate_id) FILTER (c.decision = 'selected') AS used FROM {LAST_CALLS} e JOIN {LAST_CANDS} c ON c.retrieval_id = e.context_id WHERE e.session_id IS NOT NULL GROUP BY 1""")
def q159_session_targets(s, d):
    asked = calls(s, d).where("session_id is not null").select(F.col("context_id").alias("retrieval_id"), "session_id")
    # one row for each target of a session, then plain counts
    per = candidates(s, d).join(asked, "retrieval_id").groupBy("session_id", "candidate_kind", "candidate_id").agg(F.bool_or(F.col("applicability").isNotNull()).alias("assessed"), F.bool_or(F.col("decision") == "selected").alias("used"))
    return per.groupBy("session_id").agg(F.count(F.lit(1)).alias("returned"), F.count_if("assessed").alias("assessed"), F.count_if("used").alias("used"))


@query(f"""SELECT lower(retrieval_type) AS kind, count(*) AS calls, count(*) FILTER (query_text ILIKE '%decision%') AS decisions, max(created_at) AS last_at, CAST(floor(({NOW} - max(created_at)) / 86400) AS BIGINT) AS age_days, count(DISTINCT session_id) AS sessions, round(count(*) FILTER (response_chars > 0) / count(*), 6) AS answered FROM {LAST_CALLS} GROUP BY 1""")
def q160_call_health(s, d):
    rows = calls(s, d).groupBy(F.lower("retrieval_type").alias("kind"))
    return rows.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("query_text").ilike("%decision%")).alias("decisions"), F.max("created_at").alias("last_at"), F.floor((F.lit(NOW) - F.max("created_at")) / 86_400).alias("age_days"),
        F.count_distinct("session_id").alias("sessions"), F.round(F.count_if(F.col("response_chars") > 0) / F.count(F.lit(1)), 6).alias("answered"),
    )


@query(f"""WITH s AS (SELECT session_id, bool_or(lower(retrieval_type) = 'context') AS begun, bool_or(lower(retrieval_type) = 'recall') AS ended, max(coalesce(lifecycle_version, 'none')) AS version FROM {LAST_CALLS} WHERE session_id IS NOT NULL GROUP BY 1) SELECT version, count(*) FILTER (begun) AS begun, count(*) FILTER (begun AND ended) AS ended, count(*) FILTER (begun AND ended) < 0.5 * count(*) FILTER (begun) AS warning FROM s GROUP BY 1""")
def q161_lifecycle_health(s, d):
    """Sessions begun and ended by client version, with a warning below a half."""
    is_ = lambda k: F.bool_or(F.lower("retrieval_type") == k)
    per = calls(s, d).where("session_id is not null").groupBy("session_id").agg(is_("context").alias("begun"), is_("recall").alias("ended"), F.max(F.coalesce("lifecycle_version", F.lit("none"))).alias("version"))
    both = F.count_if(F.col("begun") & F.col("ended"))
    return per.groupBy("version").agg(F.count_if("begun").alias("begun"), both.alias("ended"), (both < 0.5 * F.count_if("begun")).alias("warning"))


@query(f"""SELECT c.candidate_id, coalesce(e.scope_id, 'none') AS scope, count(*) AS n FROM retrieval_trace_candidates c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE c.candidate_kind = 'rule' AND c.decision <> 'selected' GROUP BY 1, 2""")
def q162_rejections_in_scope(s, d):
    """How often each rule was rejected in each scope; every delivery counts, not only the latest."""
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), F.coalesce("scope_id", F.lit("none")).alias("scope"))
    return table(s, d, "retrieval_trace_candidates").where("candidate_kind = 'rule' and decision <> 'selected'").join(asked, "retrieval_id").groupBy("candidate_id", "scope").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT coalesce(policy_version, 'none') AS policy, selected_total > 0 AS returned, count(*) AS n, count(*) FILTER (difference = 0) AS agree, CAST(sum(difference) AS BIGINT) AS difference FROM (SELECT r.policy_version, r.selected_total, r.scored_total - coalesce(c.n, 0) AS difference FROM {LAST_RUNS} r LEFT JOIN (SELECT retrieval_id, count(*) AS n FROM {LAST_CANDS} WHERE rrf_score IS NOT NULL GROUP BY 1) c ON c.retrieval_id = lower(trim(r.retrieval_id))) GROUP BY 1, 2""")
def q163_score_recount(s, d):
    """Totals that runs recorded against a recount of their scored candidates."""
    scored = candidates(s, d).where("rrf_score is not null").groupBy(F.col("retrieval_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = runs(s, d).join(scored, "key", "left").withColumn("difference", F.col("scored_total") - F.coalesce("n", F.lit(0)))
    return rows.groupBy(F.coalesce("policy_version", F.lit("none")).alias("policy"), (F.col("selected_total") > 0).alias("returned")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("difference") == 0).alias("agree"), F.sum("difference").alias("difference"))


@query(f"""WITH o AS (SELECT retrieval_id, candidate_kind, candidate_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY rrf_score DESC NULLS LAST, candidate_kind, candidate_id) AS k, length(candidate_id) + 20 AS size FROM (SELECT * FROM {LAST_CANDS} WHERE NOT coalesce(isnan(rrf_score), false)))
SELECT retrieval_id, candidate_kind, candidate_id, k AS position FROM (SELECT *, sum(size) OVER (PARTITION BY retrieval_id ORDER BY k) AS upto FROM o WHERE k > 5 AND k <= 40) WHERE upto <= 300""")
def q164_cursor_page(s, d):
    """The page after the fifth of each retrieval's forty frozen results, as long as it fits 300 bytes."""
    order = Window.partitionBy("retrieval_id").orderBy(F.col("rrf_score").desc_nulls_last(), "candidate_kind", "candidate_id")
    head = candidates(s, d).where("not coalesce(isnan(rrf_score), false)").withColumn("k", F.row_number().over(order)).where("k <= 40").where("k > 5")
    upto = F.sum(F.length("candidate_id") + 20).over(Window.partitionBy("retrieval_id").orderBy("k"))
    return head.withColumn("upto", upto).where("upto <= 300").select("retrieval_id", "candidate_kind", "candidate_id", F.col("k").cast("long").alias("position"))


@query(f"""SELECT session_id, query_text AS goal FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, context_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY session_id, split_part(lower(query_text), ' ', 1) ORDER BY created_at DESC, context_id) AS same FROM {LAST_CALLS} WHERE session_id IS NOT NULL AND query_text IS NOT NULL) WHERE same = 1) WHERE k <= 3""")
def q165_diverse_goals(s, d):
    """Three latest goals of each session that begin differently."""
    rows = calls(s, d).where("session_id is not null and query_text is not null").withColumn("start", F.split_part(F.lower("query_text"), F.lit(" "), F.lit(1)))
    first = ranking.diverse(rows, "session_id", "start", [F.desc("created_at"), F.asc("context_id")], 1)
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "context_id")
    return first.withColumn("k", F.row_number().over(order)).where("k <= 3").select("session_id", F.col("query_text").alias("goal"))


@query(f"""SELECT retrieval_id, candidate_kind, candidate_id, round(dense_cosine / nullif(max(dense_cosine) OVER w, 0), 6) AS of_best, round(dense_cosine - avg(dense_cosine) OVER w, 12) AS above_mean, round(coalesce(1.0 / lexical_rank, 0) / nullif(sum(coalesce(1.0 / lexical_rank, 0)) OVER w, 0), 6) AS lexical_share, count(*) OVER w AS pool FROM {LAST_CANDS} WHERE candidate_kind = 'memory' WINDOW w AS (PARTITION BY retrieval_id)""")
def q166_pool_features(s, d):
    """Features of each memory within its retrieval's pool."""
    lexical = F.coalesce(1.0 / F.col("lexical_rank"), F.lit(0.0))
    rows = candidates(s, d).where("candidate_kind = 'memory'")
    pool = ranking.with_pool(rows, "retrieval_id", best=F.max("dense_cosine"), mean=F.avg("dense_cosine"), lexical=F.sum(lexical), size=F.count(F.lit(1)))
    return pool.select(
        "retrieval_id", "candidate_kind", "candidate_id", F.round(F.col("dense_cosine") / F.nullif("best", F.lit(0.0)), 6).alias("of_best"), F.round(F.col("dense_cosine") - F.col("mean"), 12).alias("above_mean"),
        F.round(lexical / F.nullif("lexical", F.lit(0.0)), 6).alias("lexical_share"), F.col("size").alias("pool"),
    )


# ---- vectors


@query()
def q167_near_duplicates_left_out(s, d):
    """Of each query vector's twenty nearest those that stay when one as near as 0.92 to a better one is left out."""
    rows = _vectors(s, d).select("id", "vec")
    top = block_search(rows, rows.where("id % 100 = 0"), 20, WIDTH)
    return ranking.apart(top.join(rows, "id").select("query_id", "id", "cosine", "vec"), "query_id", "id", "cosine", "vec")


@query(f"""SELECT q.id, round((1 - max(round(list_cosine_similarity(q.v, r.v), 6))) / 2, 6) AS novelty FROM {_V} q JOIN {_V} r ON r.id < q.id WHERE q.id % 100 = 0 GROUP BY 1""")
def q168_novelty(s, d):
    """How far each query vector is from all that came before it."""
    rows = _vectors(s, d).select("id", "vec")
    best = block_search(rows, rows.where("id % 100 = 0"), 1, WIDTH, earlier=True)
    return best.select(F.col("query_id").alias("id"), F.round((1 - F.col("cosine")) / 2, 6).alias("novelty"))


_CENTRES = "(SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH x AS (SELECT v.id, c.label, list_cosine_similarity(v.v, c.c) AS cos FROM {_V} v, {_CENTRES} c WHERE v.id % 100 = 0), y AS (SELECT *, max(cos) OVER (PARTITION BY id) AS best FROM x) SELECT id, round(sum(exp((cos - best) / 0.05) * label) / sum(exp((cos - best) / 0.05)), 6) AS expected, round(max(cos), 6) AS best FROM y GROUP BY 1""")
def q169_anchors(s, d):
    """Where each query vector stands among the landmarks (the labels' means): a soft mean of those that it is nearest to."""
    rows = _vectors(s, d)
    landmarks = mean_vectors(rows, "label", "vec").select("label", "centroid")
    # the stated query set against all landmarks; one label is a few rows, and their number is checked
    met = rows.where("id % 100 = 0").select("id", "vec", F.lit(1).alias("one")).join(broadcast_if_small(landmarks.withColumn("one", F.lit(1))), "one")
    near = met.select("id", "label", cosine(F.col("vec"), F.col("centroid")).alias("cos"))
    weight = F.exp((F.col("cos") - F.col("best")) / 0.05)
    best = near.groupBy("id").agg(F.max("cos").alias("best"))
    return near.join(best, "id").groupBy("id").agg(F.round(F.sum(weight * F.col("label")) / F.sum(weight), 6).alias("expected"), F.round(F.max("best"), 6).alias("best"))


_USABLE = "(SELECT id, any_value(list_transform({c}, lambda x: x::DOUBLE)) AS v FROM {t} WHERE len({c}) > 0 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0 GROUP BY id)"
_E, _P = _USABLE.format(t="episodic_memories", c="embedding"), _USABLE.format(t="semantic_prototypes", c="centroid")


def usable(s: SparkSession, d: str, t: str, c: str) -> DataFrame:
    """(id, v) of the usable vectors of a table, one of each id."""
    v = F.col(c)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table(s, d, t).where("id is not null").where(good).groupBy("id").agg(F.any_value(v).alias("v"))


_MEMBERS = f"(SELECT m.prototype_id, e.id, e.v FROM (SELECT DISTINCT prototype_id, episode_id FROM episode_prototype_map WHERE prototype_id IS NOT NULL) m JOIN {_E} e ON e.id = m.episode_id WHERE len(e.v) = 128)"


def members(s: SparkSession, d: str) -> DataFrame:
    """(prototype_id, id, v) of the usable episodes of the main length that each prototype maps to."""
    links = table(s, d, "episode_prototype_map").select("prototype_id", F.col("episode_id").alias("id")).dropna().distinct()
    return links.join(usable(s, d, "episodic_memories", "embedding").where(F.size("v") == 128), "id").select("prototype_id", "id", "v")


@query(f"""WITH n AS (SELECT prototype_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM {_MEMBERS}), f AS (SELECT prototype_id, pos, avg(x / l) AS m, max(k) AS k FROM (SELECT prototype_id, l, unnest(v) AS x, generate_subscripts(v, 1) AS pos, count(*) OVER (PARTITION BY prototype_id) AS k FROM n) GROUP BY 1, 2), g AS (SELECT prototype_id, list(m ORDER BY pos) AS c FROM f GROUP BY 1)
SELECT g.prototype_id, (SELECT count(*) FROM n WHERE n.prototype_id = g.prototype_id) AS n, round(list_cosine_similarity(g.c, p.v), 6) AS agreement FROM g JOIN {_P} p ON p.id = g.prototype_id WHERE len(p.v) = 128""")
def q170_rebuilt_centroids(s, d):
    """Centroids derived anew from the members of each prototype, and how far the stored ones agree."""
    fresh = mean_vectors(members(s, d), "prototype_id", "v", unit=True)
    stored = usable(s, d, "semantic_prototypes", "centroid").where(F.size("v") == 128).withColumnRenamed("id", "prototype_id")
    return fresh.join(stored, "prototype_id").select("prototype_id", "n", F.round(cosine(F.col("centroid"), F.col("v")), 6).alias("agreement"))


@query(f"""SELECT a.prototype_id, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS coherence FROM {_MEMBERS} a JOIN {_MEMBERS} b ON a.prototype_id = b.prototype_id AND a.id < b.id GROUP BY 1""")
def q171_coherence(s, d):
    """The mean cosine of all pairs of a prototype's episodes, from the sum of their unit vectors."""
    return mean_pair_distance(members(s, d), "prototype_id", "v").select("prototype_id", F.round(1 - F.col("distance"), 6).alias("coherence"))


@query(f"""WITH x AS (SELECT m.prototype_id, m.id, m.v, list_cosine_similarity(m.v, p.v) AS cos FROM {_MEMBERS} m JOIN {_P} p ON p.id = m.prototype_id WHERE len(p.v) = 128), y AS (SELECT *, row_number() OVER (PARTITION BY prototype_id ORDER BY round(cos, 9) DESC, id) AS k FROM x WHERE cos >= 0.6)
SELECT a.prototype_id, a.id AS id_1, b.id AS id_2, CASE WHEN round(list_cosine_similarity(a.v, b.v), 6) >= 0.75 THEN 'same topic' ELSE 'related' END AS verdict FROM y a JOIN y b USING (prototype_id) WHERE a.k = 1 AND b.k = 2""")
def q172_nearest_pairs(s, d):
    """The two episodes nearest to each prototype, and whether they are of one topic."""
    centres = usable(s, d, "semantic_prototypes", "centroid").where(F.size("v") == 128).select(F.col("id").alias("prototype_id"), F.col("v").alias("c"))
    near = members(s, d).join(centres, "prototype_id").withColumn("cos", cosine(F.col("v"), F.col("c"))).where("cos >= 0.6").drop("c")
    order = Window.partitionBy("prototype_id").orderBy(F.round("cos", 9).desc(), "id")
    top = near.withColumn("k", F.row_number().over(order)).where("k <= 2")
    pair = top.groupBy("prototype_id").agg(F.max_by("id", -F.col("k")).alias("id_1"), F.max_by("id", "k").alias("id_2"), F.max_by("v", -F.col("k")).alias("a"), F.max_by("v", "k").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    verdict = F.when(F.round(cosine(F.col("a"), F.col("b")), 6) >= 0.75, "same topic").otherwise("related")
    return pair.select("prototype_id", "id_1", "id_2", verdict.alias("verdict"))


@query(f"""SELECT m.prototype_id, arg_max(e.event_id, (e.ts, e.id)) AS claim, count(*) AS members, round(greatest(0, 1 - any_value(p.variance) / 0.01), 6) AS confidence FROM (SELECT DISTINCT prototype_id, episode_id FROM episode_prototype_map WHERE prototype_id IS NOT NULL) m JOIN {LAST_EPISODES} e ON e.id = m.episode_id LEFT JOIN (SELECT id, max(variance) AS variance FROM semantic_prototypes GROUP BY id) p ON p.id = m.prototype_id GROUP BY 1""")
def q173_latent_claims(s, d):
    """A claim for each prototype: its latest episode, its members and a confidence that falls with its variance."""
    links = table(s, d, "episode_prototype_map").select("prototype_id", F.col("episode_id").alias("id")).dropna().distinct()
    per = links.join(episodes(s, d).select("id", "event_id", "ts"), "id").groupBy("prototype_id").agg(F.max_by("event_id", F.struct("ts", "id")).alias("claim"), F.count(F.lit(1)).alias("members"))
    spread = table(s, d, "semantic_prototypes").groupBy(F.col("id").alias("prototype_id")).agg(F.max("variance").alias("variance"))
    return per.join(spread, "prototype_id", "left").select("prototype_id", "claim", "members", F.round(F.greatest(F.lit(0.0), 1 - F.col("variance") / 0.01), 6).alias("confidence"))


# ---- graphs


@query(f"""SELECT src, dst, round(max(w), 9) AS weight, count(*) AS kinds FROM (SELECT src, dst, weight AS w FROM {_PROB} UNION ALL SELECT dst, src, n / (n + 1.0) FROM ({_TRANS})) WHERE src <> dst GROUP BY 1, 2""")
def q174_all_relations(s, d):
    """Relations of two kinds as one graph: how probable a step is, and how often its way back was taken, squashed below 1."""
    back = _counts(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / (F.col("n") + 1.0)).alias("weight"))
    return _edges(s, d).select("src", "dst", "weight").unionByName(back).where("src <> dst").groupBy("src", "dst").agg(F.round(F.max("weight"), 9).alias("weight"), F.count(F.lit(1)).alias("kinds"))


@query(f"""WITH e AS (SELECT src, dst, n FROM ({_TRANS}) WHERE src <> dst ORDER BY n DESC, src, dst LIMIT 50) SELECT 'edge' AS part, src, dst, n AS weight FROM e UNION ALL SELECT 'node', id, NULL, max(support_count) FROM semantic_prototypes WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY id""")
def q175_graph_export(s, d):
    """The fifty heaviest links and the prototypes at their ends."""
    edges = _counts(s, d).where("src <> dst").orderBy(F.desc("n"), "src", "dst").limit(50)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = table(s, d, "semantic_prototypes").join(F.broadcast(ends), "id", "left_semi").groupBy("id").agg(F.max("support_count").alias("weight"))  # a hundred ends at most
    return edges.select(F.lit("edge").alias("part"), "src", "dst", F.col("n").alias("weight")).union(nodes.select(F.lit("node"), "id", F.lit(None).cast("long"), F.col("weight").cast("long")))


@query(f"""WITH e AS {_PROB}, s0 AS (SELECT DISTINCT src AS node, 1.0 AS a FROM e WHERE src % 100 = 0), s1 AS (SELECT dst AS node, sum(a * weight) AS a FROM s0 JOIN e ON node = src GROUP BY 1), c AS (SELECT id, v FROM {_P} WHERE len(v) = 128), x AS (SELECT pos, sum(a * x / l) AS y FROM (SELECT a, unnest(v) AS x, generate_subscripts(v, 1) AS pos, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM s1 JOIN c ON c.id = s1.node) GROUP BY 1)
SELECT CAST(pos - 1 AS BIGINT) AS pos, round(y / sqrt(sum(y * y) OVER ()), 6) AS v FROM x""")
def q176_spread_projection(s, d):
    """The direction of all that the seeds' activation reaches: the prototypes' unit centroids weighted by it, scaled to length 1."""
    edges = _edges(s, d)
    seeds = edges.where("src % 100 = 0").select(F.col("src").alias("node")).distinct().withColumn("activation", F.lit(1.0))
    reach = graph.spread(seeds, edges, steps=1, decay=1.0, least=0.0).unionByName(seeds.withColumn("activation", -F.col("activation"))).groupBy("node").agg(F.sum("activation").alias("a"))
    centres = usable(s, d, "semantic_prototypes", "centroid").where(F.size("v") == 128).withColumnRenamed("id", "node")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    parts = reach.join(centres, "node").select("a", length.alias("l"), F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("a") * F.col("x").cast("double") / F.col("l")).alias("y"))
    whole = parts.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))  # one row
    return parts.crossJoin(F.broadcast(whole)).select(F.col("pos").cast("long").alias("pos"), F.round(F.col("y") / F.col("norm"), 6).alias("v"))


@query(f"""WITH e AS {_PROB} SELECT e.dst AS node, round(sum(e.weight * greatest(0, list_cosine_similarity(a.v, b.v))), 6) AS relevance, count(*) AS paths FROM e JOIN {_P} a ON a.id = e.src JOIN {_P} b ON b.id = e.dst WHERE e.src % 100 = 0 AND e.src <> e.dst AND len(a.v) = len(b.v) GROUP BY 1""")
def q177_relevant_expansion(s, d):
    """Neighbours of the seeds, each link weighted by how near the two prototypes are."""
    centres = usable(s, d, "semantic_prototypes", "centroid")
    edges = _edges(s, d).where("src % 100 = 0 and src <> dst")
    met = edges.join(centres.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(centres.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst").where(F.size("a") == F.size("b"))
    near = F.greatest(F.lit(0.0), cosine(F.col("a"), F.col("b")))
    return met.groupBy(F.col("dst").alias("node")).agg(F.round(F.sum(F.col("weight") * near), 6).alias("relevance"), F.count(F.lit(1)).alias("paths"))


_PAIRED = "(SELECT DISTINCT prototype_id AS p, episode_id AS e FROM episode_prototype_map WHERE prototype_id IS NOT NULL AND episode_id IS NOT NULL)"


@query(f"""SELECT a.p AS id_1, b.p AS id_2, count(*) AS shared FROM {_PAIRED} a JOIN {_PAIRED} b ON a.e = b.e AND a.p < b.p GROUP BY 1, 2""")
def q178_competing_prototypes(s, d):
    """Prototypes that claim the same episodes; an episode's prototypes are few, so its pairs are made within one row."""
    own = table(s, d, "episode_prototype_map").select("prototype_id", "episode_id").dropna().groupBy("episode_id").agg(F.array_sort(F.collect_set("prototype_id")).alias("p")).where(F.size("p") > 1)
    pairs = own.select(F.posexplode("p").alias("i", "id_1"), "p").select("id_1", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("id_2"))
    return pairs.groupBy("id_1", "id_2").agg(F.count(F.lit(1)).alias("shared"))


@query(f"""WITH x AS (SELECT v.id, c.label, round(list_cosine_similarity(v.v, c.c), 6) AS cosine FROM {_V} v, {_CENTRES} c WHERE v.id % 100 = 0) SELECT id, label, cosine, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, label) AS k FROM x WHERE cosine >= 0.1) WHERE k <= 3""")
def q179_situations(s, d):
    """The three situations (the labels' means) nearest to each query vector, if near enough."""
    rows = _vectors(s, d)
    centres = mean_vectors(rows, "label", "vec").select(F.col("label").cast("long").alias("id"), F.col("centroid").cast("array<float>").alias("vec"))
    near = block_search(centres, rows.where("id % 100 = 0").select("id", "vec"), 3, WIDTH, same=False).where("cosine >= 0.1")
    return near.select(F.col("query_id").alias("id"), F.col("id").cast("int").alias("label"), "cosine", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH c AS (SELECT CAST(floor(round(list_cosine_similarity(q.v, r.v), 6) * 1000) AS BIGINT) AS bin, count(*) AS n FROM {_V} q JOIN {_V} r ON q.id <> r.id WHERE q.id % 100 = 0 GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS every FROM c)
SELECT p, min(bin) / 1000.0 AS cosine FROM u, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) WHERE upto >= p * every GROUP BY 1""")
def q180_cosine_percentiles(s, d):
    """Percentiles of the cosines between the query set and all rows, from counts of bins of 0.001."""
    rows = _vectors(s, d).select("id", "vec")
    counts = cosine_histogram(rows, rows.where("id % 100 = 0"), WIDTH, step=0.001)
    # at most two thousand bins
    placed = counts.withColumns({"upto": F.sum("pairs").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "every": F.sum("pairs").over(Window.partitionBy())})
    met = placed.select("bin", "upto", "every", F.explode(F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("p")).where(F.col("upto") >= F.col("p") * F.col("every"))
    return met.groupBy("p").agg((F.min("bin") / 1000.0).alias("cosine"))


@query()
def q181_folded_tokens(s, d):
    """How many folded tokens each document has, and a digest of them."""
    rows = table(s, d, "documents").where("text is not null").select("doc_id", folded_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""WITH g AS (SELECT id, greatest(0.5, coalesce(confidence, 0.5)) AS confidence, count(DISTINCT scope_id) AS scopes, avg(applicability) AS fit FROM (SELECT m.id, m.confidence, e.scope_id, c.applicability FROM {LAST_SCHEMAS} m JOIN {LAST_CANDS} c ON c.candidate_id = 'sch_' || m.id AND c.candidate_kind = 'memory' JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE e.scope_id IS DISTINCT FROM m.scope_id) GROUP BY 1, 2)
SELECT id, scopes, round(least(1.0, confidence + 0.05), 6) AS confidence FROM g WHERE scopes >= 2 AND fit >= 0.4""")
def q182_cross_scope_completion(s, d):
    """Claims that fit calls of two other scopes or more gain in confidence."""
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), F.col("scope_id").alias("asked"))
    shown = candidates(s, d).where("candidate_kind = 'memory'").select(F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long").alias("id"), "retrieval_id", "applicability").where("id is not null")
    own = schemas(s, d).select("id", "scope_id", F.greatest(F.lit(0.5), F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    met = shown.join(asked, "retrieval_id").join(own, "id").where(~F.col("asked").eqNullSafe(F.col("scope_id")))
    per = met.groupBy("id", "confidence").agg(F.count_distinct("asked").alias("scopes"), F.avg("applicability").alias("fit")).where("scopes >= 2 and fit >= 0.4")
    return per.select("id", "scopes", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.05), 6).alias("confidence"))


@query(f"""SELECT coalesce(scope_id, 'none') AS scope, count(*) AS n, CAST(sum(length(content_text)) AS BIGINT) AS chars, count(*) FILTER (confidence >= 0.5) AS confident FROM {LAST_SCHEMAS} WHERE lower(trim(status)) = 'active' AND 'sch_' || id NOT IN (SELECT candidate_id FROM {LAST_CANDS} WHERE decision = 'suppressed') GROUP BY 1""")
def q183_passage_index(s, d):
    """What a scope's index of passages holds: active claims that no retrieval suppressed."""
    out = candidates(s, d).where("decision = 'suppressed'").select(F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long").alias("id")).where("id is not null")
    rows = schemas(s, d).where(F.lower(F.trim("status")) == "active").join(out, "id", "left_anti")
    return rows.groupBy(F.coalesce("scope_id", F.lit("none")).alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content_text").cast("long")).alias("chars"), F.count_if(F.col("confidence") >= 0.5).alias("confident"))
