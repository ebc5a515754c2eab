"""Queries about what a memory came from and what it led to, and about incremental work over the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import DAY, epoch, normalised
from memlake.operators.latest import add_missing
from memlake.operators.windows import leader_runs
from memlake.plans.log_queries import LAST_CALLS, LAST_CANDS, LAST_EPISODES, LAST_RUNS, LAST_SCHEMAS, NOW, calls, candidates, episodes, runs, schemas
from memlake.plans.registry import registry
from memlake.sources.tables import table

QUERIES, SQL, query = registry()

#: The watermark of incremental queries: what was loaded before it is known, the rest is new.
SINCE = "2025-10-01 00:00:00"


def known(c: str = "loaded_at") -> F.Column:
    return F.col(c).cast("timestamp") < F.lit(SINCE).cast("timestamp")


def memory_id(c: str = "candidate_id") -> F.Column:
    """The number in a text key such as sch_17; null for other keys."""
    return F.regexp_extract(c, r"^sch_(\d+)$", 1).try_cast("long")


_ID = "TRY_CAST(CASE WHEN regexp_matches(candidate_id, '^sch_[0-9]+$') THEN substr(candidate_id, 5) END AS BIGINT)"
#: Memories and rules shown in a session: candidates of its calls.
_SHOWN = f"(SELECT e.session_id, c.retrieval_id, c.candidate_kind, {_ID} AS id, c.decision, c.selected_position, e.created_at, e.scope_id, e.lifecycle_version FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE e.session_id IS NOT NULL AND {_ID} IS NOT NULL)"


def shown(s: SparkSession, d: str) -> DataFrame:
    asked = calls(s, d).where("session_id is not null").select(F.col("context_id").alias("retrieval_id"), "session_id", "created_at", "scope_id", "lifecycle_version")
    rows = candidates(s, d).withColumn("id", memory_id()).where("id is not null")
    return rows.join(asked, "retrieval_id").select("session_id", "retrieval_id", "candidate_kind", "id", "decision", "selected_position", "created_at", "scope_id", "lifecycle_version")


@query(f"SELECT session_id, max(created_at) AS last_at FROM {LAST_CALLS} WHERE session_id IS NOT NULL AND scope_id = 'project:harborline' AND created_at >= 1750000000 GROUP BY 1")
def q111_session_list(s, d):
    """Sessions of a scope since a time."""
    rows = calls(s, d).where("session_id is not null and scope_id = 'project:harborline' and created_at >= 1750000000")
    return rows.groupBy("session_id").agg(F.max("created_at").alias("last_at"))


@query(f"""SELECT retrieval_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY pos) AS place, id, status FROM (SELECT retrieval_id, id, min(pos) AS pos FROM (SELECT retrieval_id, {_ID} AS id, row_number() OVER (PARTITION BY retrieval_id ORDER BY selected_position NULLS LAST, candidate_kind, candidate_id) AS pos FROM {LAST_CANDS} WHERE decision = 'selected') WHERE pos <= 20 AND id IS NOT NULL GROUP BY 1, 2) JOIN {LAST_SCHEMAS} USING (id)""")
def q112_multi_get(s, d):
    """The claims that each retrieval delivered, twenty at most, in the order asked for: each id once, at its first place, missing ones left out."""
    order = Window.partitionBy("retrieval_id").orderBy(F.col("selected_position").asc_nulls_last(), "candidate_kind", "candidate_id")
    asked = candidates(s, d).where("decision = 'selected'").withColumn("pos", F.row_number().over(order)).where("pos <= 20")
    first = asked.withColumn("id", memory_id()).where("id is not null").groupBy("retrieval_id", "id").agg(F.min("pos").alias("pos"))
    met = first.join(schemas(s, d).select("id", "status"), "id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("retrieval_id").orderBy("pos")).cast("long")).select("retrieval_id", "place", "id", "status")


@query(f"""WITH h AS (SELECT doc_id, sha256(text) AS h, coalesce(loaded_at < TIMESTAMP '{SINCE}', false) AS known FROM documents WHERE text IS NOT NULL)
SELECT doc_id, substr(h, 1, 16) AS source_hash, h IN (SELECT h FROM h WHERE known) AS cached FROM h WHERE NOT known""")
def q113_content_cache(s, d):
    """Which of the new texts have their vector already, addressed by content: only the others need to be encoded."""
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.coalesce(known(), F.lit(False)).alias("known"))
    cached = rows.where("known").select("h").distinct().withColumn("cached", F.lit(True))
    return rows.where("not known").join(cached, "h", "left").select("doc_id", F.substring("h", 1, 16).alias("source_hash"), F.coalesce("cached", F.lit(False)).alias("cached"))


_LEDGER = f"""(SELECT DISTINCT session_id, at_ts, kind, key FROM (SELECT session_id, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS at_ts, 2 AS kind, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE session_id IS NOT NULL
UNION ALL SELECT session_id, created_at, 0, context_id FROM context_recall_events WHERE session_id IS NOT NULL UNION ALL SELECT e.session_id, r.created_at, 1, e.context_id FROM retrieval_trace_runs r JOIN {LAST_CALLS} e ON e.context_id = lower(trim(r.retrieval_id)) WHERE e.session_id IS NOT NULL))"""


def ledger(s: SparkSession, d: str) -> DataFrame:
    """What happened in each session, from three sources, each event once: calls (0), runs (1) and documents (2)."""
    docs = table(s, d, "documents").select("session_id", epoch(F.col("created_at")).alias("at_ts"), F.lit(2).alias("kind"), F.col("doc_id").cast("string").alias("key"))
    asked = table(s, d, "context_recall_events").select("session_id", F.col("created_at").alias("at_ts"), F.lit(0).alias("kind"), F.col("context_id").alias("key"))
    traced = table(s, d, "retrieval_trace_runs").select(F.lower(F.trim("retrieval_id")).alias("key"), F.col("created_at").alias("at_ts"))
    own = traced.join(calls(s, d).select(F.col("context_id").alias("key"), "session_id"), "key").select("session_id", "at_ts", F.lit(1).alias("kind"), "key")
    return docs.unionByName(asked).unionByName(own).where("session_id is not null").distinct()


@query(f"SELECT session_id, at_ts, kind, key, row_number() OVER (PARTITION BY session_id ORDER BY at_ts, kind, key) AS place FROM {_LEDGER}")
def q114_session_timeline(s, d):
    order = Window.partitionBy("session_id").orderBy("at_ts", "kind", "key")
    return ledger(s, d).withColumn("place", F.row_number().over(order).cast("long"))


@query(f"SELECT session_id, kind, key, bool_or(NOT fresh) AS known FROM (SELECT session_id, kind, key, at_ts >= 1759276800 AS fresh FROM {_LEDGER}) GROUP BY 1, 2, 3")
def q115_ledger_backfill(s, d):
    """The ledger of events before a time, and those since then that it lacks (insert or ignore)."""
    rows = ledger(s, d).withColumn("known", F.col("at_ts") < 1_759_276_800).select("session_id", "kind", "key", "known")
    return add_missing(rows.where("known").distinct(), rows.where("not known"), ["session_id", "kind", "key"])


@query(f"""SELECT d.doc_id, c.context_id FROM documents d LEFT JOIN (SELECT session_id, arg_min(context_id, (created_at, context_id)) AS context_id FROM {LAST_CALLS} WHERE lower(retrieval_type) = 'context' AND session_id IS NOT NULL GROUP BY 1) c ON c.session_id = d.session_id WHERE d.doc_kind = 'procedure' AND d.text IS NOT NULL""")
def q116_procedure_documents(s, d):
    """Each procedure's text with the earliest call for context in its session."""
    first = calls(s, d).where("lower(retrieval_type) = 'context' and session_id is not null").groupBy("session_id").agg(F.min_by("context_id", F.struct("created_at", "context_id")).alias("context_id"))
    docs = table(s, d, "documents").where("doc_kind = 'procedure' and text is not null").select("doc_id", "session_id")
    return docs.join(first, "session_id", "left").select("doc_id", "context_id")


@query(f"""SELECT r.retrieval_id, r.created_at, coalesce(a.session_id, b.session_id) AS session_id FROM (SELECT DISTINCT retrieval_id, created_at FROM retrieval_trace_runs) r LEFT JOIN {LAST_CALLS} a ON a.context_id = r.retrieval_id LEFT JOIN {LAST_CALLS} b ON b.context_id = lower(trim(r.retrieval_id))""")
def q117_run_sessions(s, d):
    """The session of each run: that of the call of the same id, else of the call whose id the run spells untidily."""
    own = calls(s, d).select("context_id", "session_id")
    rows = table(s, d, "retrieval_trace_runs").select("retrieval_id", "created_at").distinct()
    exact = rows.join(own.withColumnRenamed("context_id", "retrieval_id").withColumnRenamed("session_id", "a"), "retrieval_id", "left")
    tidy = exact.withColumn("context_id", F.lower(F.trim("retrieval_id"))).join(own.withColumnRenamed("session_id", "b"), "context_id", "left")
    return tidy.select("retrieval_id", "created_at", F.coalesce("a", "b").alias("session_id"))


@query(f"""SELECT id, session_id, max(used) AS used, CAST(sum(seen) AS BIGINT) AS seen FROM (SELECT id, session_id, CAST(decision = 'selected' AS INT) AS used, 1 AS seen FROM {_SHOWN} WHERE candidate_kind = 'memory' UNION ALL SELECT id, session_id, 0, 0 FROM {_SHOWN} WHERE candidate_kind = 'rule') GROUP BY 1, 2""")
def q118_memory_sessions(s, d):
    """Links between memories and sessions from two paths, with whether one was used and how often it was seen."""
    rows = shown(s, d)
    one = rows.where("candidate_kind = 'memory'").select("id", "session_id", (F.col("decision") == "selected").cast("int").alias("used"), F.lit(1).alias("seen"))
    two = rows.where("candidate_kind = 'rule'").select("id", "session_id", F.lit(0).alias("used"), F.lit(0).alias("seen"))
    return one.unionByName(two).groupBy("id", "session_id").agg(F.max("used").alias("used"), F.sum("seen").alias("seen"))


@query(f"SELECT id, string_agg(v, ',' ORDER BY v) AS versions FROM (SELECT DISTINCT id, coalesce(lifecycle_version, 'none') AS v FROM {_SHOWN}) GROUP BY 1")
def q119_memory_clients(s, d):
    """The versions of clients that met each memory."""
    rows = shown(s, d).groupBy("id").agg(F.collect_set(F.coalesce("lifecycle_version", F.lit("none"))).alias("v"))  # a few versions
    return rows.select("id", F.array_join(F.array_sort("v"), ",").alias("versions"))


@query(f"""SELECT m.id, coalesce(c.shown, 0) AS shown, coalesce(c.sessions, 0) AS sessions, coalesce(c.scopes, 0) AS scopes, c.last_at, coalesce(r.wordings, 0) AS wordings FROM {LAST_SCHEMAS} m
LEFT JOIN (SELECT id, count(*) AS shown, count(DISTINCT session_id) AS sessions, count(DISTINCT scope_id) AS scopes, max(created_at) AS last_at FROM {_SHOWN} GROUP BY 1) c ON c.id = m.id LEFT JOIN (SELECT memory_id, count(DISTINCT content_hash) AS wordings FROM standing_rules GROUP BY 1) r ON r.memory_id = m.id""")
def q120_claim_detail(s, d):
    """Each claim with what is linked to it; each link is counted before it is joined."""
    per = shown(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("shown"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("scope_id").alias("scopes"), F.max("created_at").alias("last_at"))
    rules = table(s, d, "standing_rules").where("memory_id is not null").groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("content_hash").alias("wordings"))
    return schemas(s, d).select("id").join(per, "id", "left").join(rules, "id", "left").fillna(0, ["shown", "sessions", "scopes", "wordings"])


@query(f"SELECT session_id, id FROM {_SHOWN} WHERE candidate_kind = 'memory' AND decision = 'selected' UNION SELECT session_id, id FROM {_SHOWN} WHERE candidate_kind = 'rule'")
def q121_session_memories(s, d):
    """Memories of each session by either of two paths: delivered ones and rules shown (an OR as two branches)."""
    rows = shown(s, d)
    one, two = rows.where("candidate_kind = 'memory' and decision = 'selected'"), rows.where("candidate_kind = 'rule'")
    return one.select("session_id", "id").union(two.select("session_id", "id")).distinct()


@query(f"""SELECT * FROM (SELECT session_id, candidate_kind, id, last_at, row_number() OVER (PARTITION BY session_id ORDER BY first_at, candidate_kind, id) AS place FROM (SELECT session_id, candidate_kind, id, max(created_at) AS last_at, min(created_at) AS first_at FROM {_SHOWN} WHERE decision = 'selected' GROUP BY 1, 2, 3)) WHERE place <= 50""")
def q122_session_items(s, d):
    """What each session was given, each item once with its latest delivery, in the order of first deliveries; fifty at most."""
    per = shown(s, d).where("decision = 'selected'").groupBy("session_id", "candidate_kind", "id").agg(F.max("created_at").alias("last_at"), F.min("created_at").alias("first_at"))
    order = Window.partitionBy("session_id").orderBy("first_at", "candidate_kind", "id")
    return per.withColumn("place", F.row_number().over(order)).where("place <= 50").select("session_id", "candidate_kind", "id", "last_at", F.col("place").cast("long").alias("place"))


_TIMES = "(SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events)"


@query(f"""WITH RECURSIVE t AS MATERIALIZED {_TIMES}, r(user_id, event_id, at_ts, k, lead_at, run) AS (SELECT user_id, event_id, at_ts, k, at_ts, CAST(0 AS BIGINT) FROM t WHERE k = 1 UNION ALL SELECT t.user_id, t.event_id, t.at_ts, t.k, CASE WHEN t.at_ts - r.lead_at > 7200 THEN t.at_ts ELSE r.lead_at END, r.run + CASE WHEN t.at_ts - r.lead_at > 7200 THEN 1 ELSE 0 END FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1)
SELECT user_id, run, count(*) AS n, min(at_ts) AS begun, arg_max(event_id, (value, event_id)) AS richest FROM r JOIN (SELECT event_id, value FROM events) USING (event_id) GROUP BY 1, 2""")
def q123_merged_calls(s, d):
    """Events of a user within two hours of the first one of their run, merged into the richest."""
    rows = table(s, d, "events").select("user_id", "event_id", epoch(F.col("ts")).alias("at_ts"), "value")
    numbered = leader_runs(rows.withColumn("user", F.col("user_id").cast("string")), "user", "at_ts", "event_id", 7_200)
    met = numbered.join(rows, "event_id")
    return met.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("at_ts").alias("begun"), F.max_by("event_id", F.struct("value", "event_id")).alias("richest"))


@query(f"""SELECT DISTINCT a.retrieval_id, b.id FROM (SELECT DISTINCT retrieval_id, session_id FROM {_SHOWN}) a JOIN (SELECT DISTINCT session_id, id FROM {_SHOWN} WHERE candidate_kind = 'rule') b USING (session_id)""")
def q124_optional_targets(s, d):
    """Every rule shown in the session of each retrieval."""
    rows = shown(s, d)
    rules = rows.where("candidate_kind = 'rule'").select("session_id", "id").distinct()
    return rows.select("retrieval_id", "session_id").distinct().join(rules, "session_id").select("retrieval_id", "id").distinct()


@query(f"""SELECT e.context_id, e.session_id, r.mode, coalesce(c.n, 0) AS items, coalesce(c.selected, 0) AS selected, c.best FROM {LAST_CALLS} e LEFT JOIN (SELECT lower(trim(retrieval_id)) AS key, mode FROM {LAST_RUNS}) r ON r.key = e.context_id
LEFT JOIN (SELECT retrieval_id, count(*) AS n, count(*) FILTER (decision = 'selected') AS selected, max(applicability) AS best FROM {LAST_CANDS} GROUP BY 1) c ON c.retrieval_id = e.context_id""")
def q125_retrieval_detail(s, d):
    """Each call with its trace and its items."""
    items = candidates(s, d).groupBy(F.col("retrieval_id").alias("context_id")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("decision") == "selected").alias("selected"), F.max("applicability").alias("best"))
    traced = runs(s, d).select(F.col("key").alias("context_id"), "mode")
    return calls(s, d).select("context_id", "session_id").join(traced, "context_id", "left").join(items, "context_id", "left").fillna(0, ["items", "selected"])


@query(f"""SELECT id, CASE WHEN json_valid(metadata_json) THEN substr(json_extract_string(metadata_json, '$.kind'), 1, 60) END AS origin FROM {LAST_EPISODES}""")
def q126_origins(s, d):
    """Where each episode comes from, as its JSON says."""
    v = F.try_parse_json("metadata_json")
    return episodes(s, d).select("id", F.substring(F.try_variant_get(v, "$.kind", "string"), 1, 60).alias("origin"))


@query(f"SELECT id, event_id, ts FROM {LAST_EPISODES} WHERE metadata_json ILIKE '%MACRO%' ORDER BY ts DESC, id LIMIT 50 OFFSET 20")
def q127_episode_page(s, d):
    """The second page of episodes whose metadata contain a word."""
    return episodes(s, d).where(F.col("metadata_json").ilike("%MACRO%")).select("id", "event_id", "ts").orderBy(F.desc("ts"), "id").offset(20).limit(50)


@query(f"""WITH t AS (SELECT count(*) AS runs, CAST(sum(selected_total) AS BIGINT) AS selected FROM {LAST_RUNS}) SELECT lower(trim(retrieval_id)) AS retrieval_id, created_at, selected_total, runs, selected FROM {LAST_RUNS}, t ORDER BY created_at DESC, retrieval_id LIMIT 30""")
def q128_run_listing(s, d):
    """The latest runs, with the totals of all."""
    rows = runs(s, d)
    total = rows.agg(F.count(F.lit(1)).alias("runs"), F.sum("selected_total").alias("selected"))  # one row
    last = rows.select(F.col("key").alias("retrieval_id"), "created_at", "selected_total").orderBy(F.desc("created_at"), "retrieval_id").limit(30)
    return last.crossJoin(F.broadcast(total))


@query(f"""SELECT DISTINCT id FROM (SELECT {_ID} AS id FROM retrieval_trace_candidates WHERE NOT coalesce(loaded_at < TIMESTAMP '{SINCE}', false) UNION ALL SELECT memory_id FROM standing_rules WHERE NOT coalesce(loaded_at < TIMESTAMP '{SINCE}', false) UNION ALL SELECT id FROM memory_schemas WHERE NOT coalesce(loaded_at < TIMESTAMP '{SINCE}', false)) WHERE id IS NOT NULL""")
def q129_refresh_set(s, d):
    """Memories that anything loaded since the watermark touches: what an incremental refresh has to derive anew."""
    parts = [table(s, d, t).where(~F.coalesce(known(), F.lit(False))).select(c.alias("id")) for t, c in (("retrieval_trace_candidates", memory_id()), ("standing_rules", F.col("memory_id")), ("memory_schemas", F.col("id")))]
    return parts[0].union(parts[1]).union(parts[2]).where("id is not null").distinct()


@query(f"""WITH l AS (SELECT {_ID} AS id, loaded_at, decision FROM {LAST_CANDS} WHERE candidate_kind = 'memory') SELECT id, used, shown, CAST(id IN (SELECT id FROM l WHERE NOT coalesce(loaded_at < TIMESTAMP '{SINCE}', false)) AS INT) AS refreshed FROM (SELECT id, count(*) FILTER (decision = 'selected') AS used, count(*) AS shown FROM l WHERE id IS NOT NULL GROUP BY 1)""")
def q130_incremental_counts(s, d):
    """Counters of memories, of which only those touched since the watermark are counted anew; the others keep what was counted before it."""
    rows = candidates(s, d).where("candidate_kind = 'memory'").select(memory_id().alias("id"), "decision", F.coalesce(known(), F.lit(False)).alias("known")).where("id is not null")
    touched = rows.where("not known").select("id").distinct()
    count = lambda df, flag: df.groupBy("id").agg(F.count_if(F.col("decision") == "selected").alias("used"), F.count(F.lit(1)).alias("shown")).withColumn("refreshed", F.lit(flag))
    kept = count(rows.where("known"), 0).join(touched, "id", "left_anti")
    return kept.unionByName(count(rows.join(touched, "id", "left_semi"), 1))


_TABLES = ("context_recall_events", "episodic_memories", "memory_schemas", "retrieval_trace_runs", "standing_rules")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) FILTER (loaded_at < TIMESTAMP '{SINCE}') AS before, count(*) AS after, coalesce(count(*) FILTER (loaded_at < TIMESTAMP '{SINCE}') = count(*) AND max(loaded_at) < TIMESTAMP '{SINCE}', false) AS unchanged FROM {t}" for t in _TABLES))
def q131_fingerprints(s, d):
    """Whether each table's fingerprint (rows and latest load) has changed since the watermark: work over an unchanged one can be skipped."""
    parts = []
    for t in _TABLES:
        before = F.count_if(known())
        same = F.coalesce((before == F.count(F.lit(1))) & (F.max(F.col("loaded_at").cast("timestamp")) < F.lit(SINCE).cast("timestamp")), F.lit(False))
        parts.append(table(s, d, t).agg(F.lit(t).alias("name"), before.alias("before"), F.count(F.lit(1)).alias("after"), same.alias("unchanged")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query(f"""SELECT m.id, CASE WHEN r.memory_id IS NULL THEN 'untagged' WHEN m.last_updated_ts > r.tagged_ts THEN 'updated' WHEN r.classifier_version < 3 THEN 'older' ELSE 'current' END AS state FROM {LAST_SCHEMAS} m LEFT JOIN (SELECT memory_id, max(tagged_ts) AS tagged_ts, max(classifier_version) AS classifier_version FROM standing_rules GROUP BY 1) r ON r.memory_id = m.id WHERE length(m.content_text) <= 600""")
def q132_tag_backfill(s, d):
    """Which claims have to be tagged (again): never tagged, updated since, or tagged by an older classifier."""
    tags = table(s, d, "standing_rules").groupBy(F.col("memory_id").alias("id")).agg(F.max("tagged_ts").alias("tagged_ts"), F.max("classifier_version").alias("v"), F.lit(True).alias("tagged"))
    state = F.when(F.col("tagged").isNull(), "untagged").when(F.col("last_updated_ts") > F.col("tagged_ts"), "updated").when(F.col("v") < 3, "older").otherwise("current")
    return schemas(s, d).where(F.length("content_text") <= 600).join(tags, "id", "left").select("id", state.alias("state"))


_FROZEN = (("memory_schemas", "id", ("id", "content_text", "status")), ("standing_rules", "memory_id", ("memory_id", "preview", "rule_type")), ("documents", "doc_id", ("doc_id", "text", "source")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT DISTINCT sha256(concat_ws('|', {', '.join(f'''coalesce(CAST({c} AS VARCHAR), '')''' for c in cs)})) AS h FROM {t})" for t, _, cs in _FROZEN))
def q133_corpus_digest(s, d):
    """A digest of each table that doesn't depend on the order or the number of deliveries of its rows."""
    parts = []
    for t, _, cs in _FROZEN:
        h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs]), 256)
        rows = table(s, d, t).select(h.alias("h")).distinct()
        parts.append(rows.agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("digest")))
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""SELECT retrieval_id, count(*) FILTER (m AND NOT r) AS misses, count(*) FILTER (r AND NOT m) AS confusers, CAST(sum(CASE WHEN m AND NOT r THEN 0.5 WHEN r AND NOT m THEN -0.25 ELSE 0 END) AS DOUBLE) AS correction FROM (SELECT retrieval_id, id, bool_or(decision = 'selected') AS r, bool_or(applicability >= 0.5) AS m FROM (SELECT retrieval_id, {_ID} AS id, decision, coalesce(applicability, 0) AS applicability FROM {LAST_CANDS}) WHERE id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def q134_misses_and_confusers(s, d):
    """Of each retrieval, items that should have been shown and weren't, those shown that shouldn't, and the correction that follows."""
    rows = candidates(s, d).select("retrieval_id", memory_id().alias("id"), "decision", F.coalesce("applicability", F.lit(0.0)).alias("a")).where("id is not null")
    per = rows.groupBy("retrieval_id", "id").agg(F.bool_or(F.col("decision") == "selected").alias("r"), F.bool_or(F.col("a") >= 0.5).alias("m"))
    missed, confused = F.col("m") & ~F.col("r"), F.col("r") & ~F.col("m")
    return per.groupBy("retrieval_id").agg(F.count_if(missed).alias("misses"), F.count_if(confused).alias("confusers"), F.sum(F.when(missed, 0.5).when(confused, -0.25).otherwise(0.0)).alias("correction"))


@query(f"""SELECT memory_id, string_agg(s, ' ' ORDER BY first, s) AS situations FROM (SELECT memory_id, s, min(tagged_ts) AS first FROM (SELECT memory_id, tagged_ts, unnest(string_split(situations, ' ')) AS s FROM standing_rules) WHERE s <> '' GROUP BY 1, 2) GROUP BY 1""")
def q135_ordered_union(s, d):
    """The situations of all wordings of a rule, each once, in the order in which they came."""
    words = table(s, d, "standing_rules").select("memory_id", "tagged_ts", F.explode(F.split("situations", " ")).alias("s")).where("s <> ''")
    first = words.groupBy("memory_id", "s").agg(F.min("tagged_ts").alias("first"))
    order = F.array_sort(F.collect_list(F.struct("first", "s")))  # a fixed list of situations
    return first.groupBy("memory_id").agg(F.array_join(F.transform(order, lambda x: x["s"]), " ").alias("situations"))


@query(f"""SELECT session_id, context_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, context_id) AS k FROM {LAST_CALLS} WHERE session_id IS NOT NULL AND created_at >= {NOW} - 365 * 86400) WHERE k <= 100""")
def q136_kept_deliveries(s, d):
    """Deliveries that stay: of the last year, a hundred of each session at most."""
    rows = calls(s, d).where(F.col("session_id").isNotNull() & (F.col("created_at") >= NOW - 365 * DAY))
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "context_id")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 100").select("session_id", "context_id", "created_at")


@query(f"""SELECT session_id, count(*) FILTER (k > coalesce(f, 0)) AS since_full FROM (SELECT session_id, k, max(k) FILTER (response_chars >= 1000) OVER (PARTITION BY session_id) AS f FROM (SELECT session_id, response_chars, row_number() OVER (PARTITION BY session_id ORDER BY created_at, context_id) AS k FROM {LAST_CALLS} WHERE session_id IS NOT NULL)) GROUP BY 1""")
def q137_rows_since_full(s, d):
    """Calls of each session since the last one that had a full answer."""
    at = F.struct("created_at", "context_id")
    rows = calls(s, d).where("session_id is not null")
    last = rows.where("response_chars >= 1000").groupBy("session_id").agg(F.max(at).alias("full"))
    per = rows.join(last, "session_id", "left")
    return per.groupBy("session_id").agg(F.count_if(F.col("full").isNull() | (at > F.col("full"))).alias("since_full"))


@query(r"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) ORDER BY doc_id) AS k FROM documents WHERE doc_kind = 'procedure' AND text IS NOT NULL) WHERE k = 1""")
def q138_method_dedup(s, d):
    """Procedures of a source once for each wording of the method, whatever its case, spaces and marks."""
    method = F.concat_ws(" ", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)")))
    rows = table(s, d, "documents").where("doc_kind = 'procedure' and text is not null").select("source", F.md5(method).alias("digest"), "doc_id")
    return rows.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query(f"""SELECT candidate_kind, candidate_id, max(dense_cosine) AS best_cosine, min(lexical_rank) AS best_rank, max(rrf_score) FILTER (NOT isnan(rrf_score)) AS best_score, count(*) AS evidence FROM {LAST_CANDS} GROUP BY 1, 2""")
def q139_best_evidence(s, d):
    """The best evidence that any retrieval had for each candidate."""
    score = F.max(F.when(~F.isnan("rrf_score"), F.col("rrf_score")))
    return candidates(s, d).groupBy("candidate_kind", "candidate_id").agg(F.max("dense_cosine").alias("best_cosine"), F.min("lexical_rank").alias("best_rank"), score.alias("best_score"), F.count(F.lit(1)).alias("evidence"))


@query(rf"""WITH o AS (SELECT id, md5(trim(regexp_replace(lower(content_text), '[ \t\r\n\f\v]+', ' ', 'g'))) AS h, coalesce(scope_id, '') AS sc, coalesce(loaded_at < TIMESTAMP '{SINCE}', false) AS known FROM {LAST_SCHEMAS})
SELECT n.id, CASE WHEN any_value(k.id) IS NULL THEN 'created' WHEN bool_or(k.sc = n.sc) THEN 'reinforced' ELSE 'related' END AS path, min(k.id) AS target FROM o n LEFT JOIN o k ON k.h = n.h AND k.known WHERE NOT n.known GROUP BY 1""")
def q140_write_path(s, d):
    """What becomes of each new claim: it reinforces an old one of its scope, is related to one of another scope, or is created."""
    rows = schemas(s, d).select("id", F.md5(normalised(F.col("content_text"))).alias("h"), F.coalesce("scope_id", F.lit("")).alias("sc"), F.coalesce(known(), F.lit(False)).alias("known"))
    old = rows.where("known").groupBy("h", "sc").agg(F.min("id").alias("target"))
    met = rows.where("not known").select("id", "h", F.col("sc").alias("own")).join(old, "h", "left")
    same = F.bool_or(F.col("sc") == F.col("own"))
    path = F.when(F.max("target").isNull(), "created").when(same, "reinforced").otherwise("related")
    return met.groupBy("id").agg(path.alias("path"), F.min("target").alias("target"))


#: Counters of candidates by their condition, in words that both Spark and the checking SQL understand.
_COUNTERS = {
    "exposed": "true", "used": "decision = 'selected'", "rejected": "decision = 'rejected'", "suppressed": "decision = 'suppressed'", "assessed": "applicability is not null", "unknown": "applicability is null",
    "fit": "applicability >= threshold", "unfit": "applicability < threshold", "used_unfit": "decision = 'selected' and applicability < threshold", "missed": "decision <> 'selected' and applicability >= threshold",
    "dense": "dense_cosine is not null", "near": "dense_cosine >= 0.5", "lexical": "lexical_rank is not null", "lexical_first": "lexical_rank <= 3", "both_channels": "dense_cosine is not null and lexical_rank is not null", "scored": "rrf_score is not null",
    "placed": "selected_position is not null", "placed_first": "selected_position = 0", "redundant": "redundant_with is not null",
    **{f"for_{r}": f"reason_code = '{r}'" for r in ("below_threshold", "insufficient_evidence", "hybrid_relevance", "redundant", "wrong_task_facet", "decision_constraint", "filtered")},
}


@query(f"""WITH t AS (SELECT candidate_kind, candidate_id, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTERS.items())}, count(DISTINCT e.session_id) FILTER (decision = 'selected') AS sessions FROM {LAST_CANDS} c LEFT JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id GROUP BY 1, 2)
SELECT candidate_kind, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}, count(*) FILTER ({n} > 0) AS {n}_targets" for n in _COUNTERS)}, count(*) FILTER (sessions >= 2) AS across_sessions FROM t GROUP BY 1""")
def q184_effectiveness(s, d):
    """Counters of candidates and of the different targets behind them, first of each target, then of each kind: no distinct count over all rows."""
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "session_id")
    rows = candidates(s, d).join(asked, "retrieval_id", "left")
    sessions = F.count_distinct(F.when(F.col("decision") == "selected", F.col("session_id"))).alias("sessions")
    per = rows.groupBy("candidate_kind", "candidate_id").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTERS.items()], sessions)
    sums = [x for n in _COUNTERS for x in (F.sum(n).alias(n), F.count_if(F.col(n) > 0).alias(f"{n}_targets"))]
    return per.groupBy("candidate_kind").agg(*sums, F.count_if(F.col("sessions") >= 2).alias("across_sessions"))


_ROW = ("exposed", "used", "rejected", "suppressed", "assessed", "fit", "unfit", "missed", "redundant")


@query(f"""SELECT m.id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in _ROW)}, coalesce(sessions, 0) AS sessions, last_at, last_used, coalesce(tags, 0) AS tags, CASE WHEN coalesce(assessed, 0) = 0 THEN -1.0 ELSE round(used / assessed, 6) END AS use_rate FROM {LAST_SCHEMAS} m
LEFT JOIN (SELECT {_ID} AS id, {", ".join(f"count(*) FILTER ({_COUNTERS[n]}) AS {n}" for n in _ROW)}, count(DISTINCT e.session_id) AS sessions, max(e.created_at) AS last_at, max(e.created_at) FILTER (decision = 'selected') AS last_used FROM {LAST_CANDS} c LEFT JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE candidate_kind = 'memory' GROUP BY 1) x ON x.id = m.id
LEFT JOIN (SELECT memory_id, count(*) AS tags FROM standing_rules GROUP BY 1) r ON r.memory_id = m.id""")
def q185_claim_table(s, d):
    """Each claim with its counters, one grouped aggregate for each table below it."""
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "session_id", "created_at")
    rows = candidates(s, d).where("candidate_kind = 'memory'").withColumn("id", memory_id()).where("id is not null").join(asked, "retrieval_id", "left")
    used = F.max(F.when(F.col("decision") == "selected", F.col("created_at")))
    per = rows.groupBy("id").agg(*[F.count_if(F.expr(_COUNTERS[n])).alias(n) for n in _ROW], F.count_distinct("session_id").alias("sessions"), F.max("created_at").alias("last_at"), used.alias("last_used"))
    tags = table(s, d, "standing_rules").where("memory_id is not null").groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("tags"))
    met = schemas(s, d).select("id").join(per, "id", "left").join(tags, "id", "left").fillna(0, [*_ROW, "sessions", "tags"])
    return met.withColumn("use_rate", F.when(F.col("assessed") == 0, -1.0).otherwise(F.round(F.col("used") / F.col("assessed"), 6)))


@query(f"""SELECT c.session_id, calls, contexts, recalls, empties, first_at, last_at, coalesce(targets, 0) AS targets, coalesce(memories, 0) AS memories, coalesce(procedures, 0) AS procedures, coalesce(rules, 0) AS rules, coalesce(texts, 0) AS texts FROM (SELECT session_id, count(*) AS calls, count(*) FILTER (lower(retrieval_type) = 'context') AS contexts, count(*) FILTER (lower(retrieval_type) = 'recall') AS recalls, count(*) FILTER (coalesce(response_chars, 0) = 0) AS empties, min(created_at) AS first_at, max(created_at) AS last_at FROM {LAST_CALLS} WHERE session_id IS NOT NULL GROUP BY 1) c
LEFT JOIN (SELECT session_id, count(*) AS targets, {", ".join(f"count(*) FILTER (candidate_kind = '{k}') AS {n}" for k, n in (("memory", "memories"), ("procedure", "procedures"), ("rule", "rules")))} FROM (SELECT DISTINCT e.session_id, candidate_kind, candidate_id FROM {LAST_CANDS} x JOIN {LAST_CALLS} e ON e.context_id = x.retrieval_id WHERE decision = 'selected') GROUP BY 1) t ON t.session_id = c.session_id
LEFT JOIN (SELECT session_id, count(*) AS texts FROM documents GROUP BY 1) d ON d.session_id = c.session_id""")
def q186_session_page(s, d):
    """Each session with aggregates of its calls, of the different targets it was given, and of its texts."""
    asked = calls(s, d).where("session_id is not null")
    kind = lambda k: F.count_if(F.lower("retrieval_type") == k)
    own = asked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), kind("context").alias("contexts"), kind("recall").alias("recalls"), F.count_if(F.coalesce("response_chars", F.lit(0)) == 0).alias("empties"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
    given = candidates(s, d).where("decision = 'selected'").join(asked.select(F.col("context_id").alias("retrieval_id"), "session_id"), "retrieval_id").select("session_id", "candidate_kind", "candidate_id").distinct()
    targets = given.groupBy("session_id").agg(F.count(F.lit(1)).alias("targets"), *[F.count_if(F.col("candidate_kind") == k).alias(n) for k, n in (("memory", "memories"), ("procedure", "procedures"), ("rule", "rules"))])
    texts = table(s, d, "documents").where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("texts"))
    return own.join(targets, "session_id", "left").join(texts, "session_id", "left").fillna(0, ["targets", "memories", "procedures", "rules", "texts"])


@query(f"""SELECT id, scope_id, generalization_stage FROM {LAST_SCHEMAS} WHERE scope_id = 'project:harborline' OR scope_id IS NULL OR scope_id IN ('global', 'user:global') OR (generalization_stage BETWEEN 2 AND 3)""")
def q187_visible_claims(s, d):
    """Claims that one scope sees: its own, those of none or of all, and those general enough."""
    visible = "scope_id = 'project:harborline' or scope_id is null or scope_id in ('global', 'user:global') or generalization_stage between 2 and 3"
    return schemas(s, d).where(visible).select("id", "scope_id", "generalization_stage")
