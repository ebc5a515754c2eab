"""Queries that derive state: utilities, links between logs, audits, pages, samples and windows of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions.columns import DAY, clamp, epoch, normalised, tokens
from memlake.operators import graph
from memlake.operators.windows import budget_pages, sentence_windows
from memlake.plans.log_queries import LAST_CALLS, LAST_CANDS, LAST_EPISODES, LAST_RUNS, LAST_SCHEMAS, NOW, calls, candidates, episodes, runs, schemas
from memlake.plans.rank_queries import _TRANS, _counts
from memlake.plans.registry import registry
from memlake.sources.tables import table

QUERIES, SQL, query = registry()


_USES = f"(SELECT CAST(substr(candidate_id, 5) AS BIGINT) AS id, count(*) AS uses, max(e.created_at) AS last_used FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE decision = 'selected' AND candidate_kind = 'memory' AND regexp_matches(candidate_id, '^sch_[0-9]+$') GROUP BY 1)"


def _uses(s, d):
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "created_at")
    shown = candidates(s, d).where("decision = 'selected' and candidate_kind = 'memory'").withColumn("id", F.regexp_extract("candidate_id", r"^sch_(\d+)$", 1).try_cast("long")).where("id is not null")
    return shown.join(asked, "retrieval_id").groupBy("id").agg(F.count(F.lit(1)).alias("uses"), F.max("created_at").alias("last_used"))


@query(f"""SELECT m.id, round(0.5 * (1 - 1 / (1 + greatest(0, {NOW} - first_formed_ts) / 86400.0 / 7.0)) + 0.5 * (coalesce(uses, 0) / (coalesce(uses, 0) + 5.0)), 6) AS utility FROM {LAST_SCHEMAS} m LEFT JOIN {_USES} u ON u.id = m.id""")
def q84_utility(s, d):
    age = F.greatest(F.lit(0), F.lit(NOW) - F.col("first_formed_ts")) / F.lit(float(DAY))
    uses = F.coalesce("uses", F.lit(0))
    return schemas(s, d).join(_uses(s, d), "id", "left").select("id", F.round(0.5 * (1 - 1 / (1 + age / 7.0)) + 0.5 * (uses / (uses + 5.0)), 6).alias("utility"))


@query(f"SELECT candidate_kind, candidate_id, count(*) AS exposed, count(*) FILTER (decision = 'selected') AS used, max(e.created_at) AS last_seen, max(e.created_at) FILTER (decision = 'selected') AS last_used FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id GROUP BY 1, 2")
def q85_target_history(s, d):
    asked = calls(s, d).select(F.col("context_id").alias("retrieval_id"), "created_at")
    used = F.col("decision") == "selected"
    return candidates(s, d).join(asked, "retrieval_id").groupBy("candidate_kind", "candidate_id").agg(F.count(F.lit(1)).alias("exposed"), F.count_if(used).alias("used"), F.max("created_at").alias("last_seen"), F.max(F.when(used, F.col("created_at"))).alias("last_used"))


@query("""SELECT p.id, count(DISTINCT m.episode_id) AS members, max(p.support) AS support FROM (SELECT id, max(support_count) AS support FROM semantic_prototypes GROUP BY id) p LEFT JOIN episode_prototype_map m ON m.prototype_id = p.id GROUP BY 1""")
def q86_prototype_sizes(s, d):
    # members are counted before the join, so that large prototypes travel as one row
    links = table(s, d, "episode_prototype_map").where("prototype_id is not null").groupBy(F.col("prototype_id").alias("id")).agg(F.count_distinct("episode_id").alias("members"))
    own = table(s, d, "semantic_prototypes").groupBy("id").agg(F.max("support_count").alias("support"))
    return own.join(links, "id", "left").select("id", F.coalesce("members", F.lit(0)).alias("members"), "support")


@query("SELECT " + ", ".join(f"(SELECT count(DISTINCT {c}) FROM {t}) AS {n}" for n, t, c in (("episodes", "episodic_memories", "id"), ("prototypes", "semantic_prototypes", "id"), ("schemas", "memory_schemas", "id"), ("rules", "standing_rules", "memory_id"))))
def q87_table_counts(s, d):
    one = None
    for n, t, c in (("episodes", "episodic_memories", "id"), ("prototypes", "semantic_prototypes", "id"), ("schemas", "memory_schemas", "id"), ("rules", "standing_rules", "memory_id")):
        count = table(s, d, t).agg(F.count_distinct(c).alias(n))
        one = count if one is None else one.crossJoin(F.broadcast(count))  # rows of one
    return one


@query("""SELECT CASE WHEN d < 0 THEN 'early' WHEN d <= 60 THEN 'minute' WHEN d <= 3600 THEN 'hour' WHEN d <= 86400 THEN 'day' ELSE 'later' END AS delay, count(*) AS n FROM (SELECT epoch(date_trunc('second', loaded_at)) - created_at AS d FROM context_recall_events) GROUP BY 1""")
def q88_delay_classes(s, d):
    x = epoch(F.col("loaded_at")) - F.col("created_at")
    name = F.when(x < 0, "early").when(x <= 60, "minute").when(x <= 3_600, "hour").when(x <= DAY, "day").otherwise("later")
    return table(s, d, "context_recall_events").groupBy(name.alias("delay")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT candidate_id, scopes FROM (SELECT candidate_id, CAST(floor(sum(w) + 1e-9) AS BIGINT) AS scopes FROM (SELECT candidate_id, scope_id, max(CASE decision WHEN 'selected' THEN 1.0 WHEN 'rejected' THEN 0.0 ELSE 0.25 END) AS w FROM {LAST_CANDS} c JOIN {LAST_CALLS} e ON e.context_id = c.retrieval_id WHERE scope_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) WHERE scopes > 0""")
def q89_scope_breadth(s, d):
    asked = calls(s, d).where("scope_id is not null").select(F.col("context_id").alias("retrieval_id"), "scope_id")
    weight = F.when(F.col("decision") == "selected", 1.0).when(F.col("decision") == "rejected", 0.0).otherwise(0.25)
    per = candidates(s, d).join(asked, "retrieval_id").groupBy("candidate_id", "scope_id").agg(F.max(weight).alias("w"))
    return per.groupBy("candidate_id").agg(F.floor(F.sum("w") + 1e-9).alias("scopes")).where("scopes > 0")


@query(f"""SELECT candidate_id, least(0.2, (n - 2) * 0.15) AS prior FROM (SELECT candidate_id, count(*) FILTER (decision = 'rejected') AS n, count(*) FILTER (decision = 'selected') AS u FROM {LAST_CANDS} GROUP BY 1) WHERE u = 0 AND n > 2""")
def q90_negative_prior(s, d):
    per = candidates(s, d).groupBy("candidate_id").agg(F.count_if(F.col("decision") == "rejected").alias("n"), F.count_if(F.col("decision") == "selected").alias("u"))
    return per.where("u = 0 and n > 2").select("candidate_id", F.least(F.lit(0.2), (F.col("n") - 2) * 0.15).alias("prior"))


@query(f"""WITH g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ({_TRANS}) UNION ALL SELECT dst FROM ({_TRANS})) GROUP BY 1) SELECT count(*) AS nodes, list_extract(list_sort(list(degree)), CAST(floor(count(*) / 2) AS INT) + 1) AS upper_median, max(degree) AS most, count(*) FILTER (degree > 20) AS breaches, round(avg(degree), 6) AS mean FROM g""")
def q91_degree_stats(s, d):
    degrees = _counts(s, d).select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    # the upper median from counts of degrees, which are few, not from a list of all nodes
    counts = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("c").over(upto), "all": F.sum("c").over(Window.partitionBy())})
    return placed.agg(
        F.max("all").alias("nodes"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("degree"))).alias("upper_median"), F.max("degree").alias("most"),
        F.coalesce(F.sum(F.when(F.col("degree") > 20, F.col("c"))), F.lit(0)).alias("breaches"), F.round(F.sum(F.col("degree") * F.col("c")) / F.max("all"), 6).alias("mean"),
    )


@query(f"""SELECT src, dst, round(n * exp(-0.6931471805599453 / 604800 * 1209600), 9) AS weight FROM ({_TRANS}) WHERE n * exp(-0.6931471805599453 / 604800 * 1209600) > 0.3""")
def q92_link_decay(s, d):
    weight = F.col("n") * F.exp(F.lit(-0.6931471805599453 / 604_800 * 1_209_600))
    return _counts(s, d).withColumn("w", weight).where("w > 0.3").select("src", "dst", F.round("w", 9).alias("weight"))


@query(f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM ({_TRANS}) WHERE src <> dst) WHERE k <= 5), c AS (SELECT m.prototype_id AS p, avg(e.salience) AS v FROM (SELECT DISTINCT episode_id, prototype_id FROM episode_prototype_map) m JOIN {LAST_EPISODES} e ON e.id = m.episode_id GROUP BY 1)
SELECT src, round(sum(n * v) / sum(n), 9) AS expected, count(*) AS branches FROM t JOIN c ON c.p = t.dst WHERE v IS NOT NULL GROUP BY 1""")
def q93_expected_successor(s, d):
    links = table(s, d, "episode_prototype_map").select(F.col("episode_id").alias("id"), "prototype_id").distinct()
    value = links.join(episodes(s, d).select("id", "salience"), "id").groupBy(F.col("prototype_id").alias("dst")).agg(F.avg("salience").alias("v")).where("v is not null")
    top = graph.strongest(_counts(s, d).where("src <> dst").withColumnRenamed("n", "weight"), 5)
    return top.join(value, "dst").groupBy("src").agg(F.round(F.sum(F.col("weight") * F.col("v")) / F.sum("weight"), 9).alias("expected"), F.count(F.lit(1)).alias("branches"))


@query("SELECT memory_id, round(2 / pi() * atan(score / 2), 9) AS squashed, trim(s) AS situation FROM (SELECT memory_id, score, unnest(string_split(situations, ' ')) AS s FROM (SELECT DISTINCT memory_id, score, situations FROM standing_rules)) WHERE trim(s) <> ''")
def q94_rule_situations(s, d):
    rows = table(s, d, "standing_rules").select("memory_id", "score", "situations").distinct().select("memory_id", "score", F.explode(F.split("situations", " ")).alias("s")).where("trim(s) <> ''")
    return rows.select("memory_id", F.round(2 / F.pi() * F.atan(F.col("score") / 2), 9).alias("squashed"), F.trim("s").alias("situation"))


@query("""SELECT memory_id, max(standing) AS standing, max(always_flag) AS always_flag, count(DISTINCT content_hash) AS wordings, bool_or(blocked IS NOT NULL) AS blocked FROM standing_rules GROUP BY 1""")
def q95_rule_tags(s, d):
    return table(s, d, "standing_rules").groupBy("memory_id").agg(F.max("standing").alias("standing"), F.max("always_flag").alias("always_flag"), F.count_distinct("content_hash").alias("wordings"), F.bool_or(F.col("blocked").isNotNull()).alias("blocked"))


@query("""SELECT memory_id, tagged_ts, round((tagged_ts - min(tagged_ts) OVER ()) / greatest(1, max(tagged_ts) OVER () - min(tagged_ts) OVER ()), 6) AS recency FROM (SELECT memory_id, max(tagged_ts) AS tagged_ts FROM standing_rules GROUP BY 1)""")
def q96_recency(s, d):
    rows = table(s, d, "standing_rules").groupBy("memory_id").agg(F.max("tagged_ts").alias("tagged_ts"))
    ends = F.broadcast(rows.agg(F.min("tagged_ts").alias("a"), F.max("tagged_ts").alias("b")))  # one row, in place of a window over all
    return rows.crossJoin(ends).select("memory_id", "tagged_ts", F.round((F.col("tagged_ts") - F.col("a")) / F.greatest(F.lit(1), F.col("b") - F.col("a")), 6).alias("recency"))


@query("""SELECT doc_id, length(text) AS n, substr(sha256(text), 1, 16) AS digest, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79), ' ') || '…' ELSE text END AS preview FROM documents WHERE text IS NOT NULL""")
def q97_previews(s, d):
    text = F.col("text")
    short = F.when(F.length(text) > 80, F.concat(F.rtrim(F.substring(text, 1, 79)), F.lit("…"))).otherwise(text)
    return table(s, d, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"), F.substring(F.sha2("text", 256), 1, 16).alias("digest"), short.alias("preview"))


@query("""SELECT id, strftime(make_timestamp(first_formed_ts * 1000000), '[%Y-%m-%d] ') || content_text AS line, strftime(make_timestamp(first_formed_ts * 1000000), '%Y-%m') AS month FROM """ + LAST_SCHEMAS)
def q98_dated_lines(s, d):
    at = F.timestamp_seconds("first_formed_ts")
    return schemas(s, d).select("id", F.concat(F.date_format(at, "'['yyyy-MM-dd'] '"), F.col("content_text")).alias("line"), F.date_format(at, "yyyy-MM").alias("month"))


@query("""WITH t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content_text), '[\\p{L}\\p{N}]+')) AS term FROM memory_schemas), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT id, count(*) AS terms, count(*) FILTER (df = 1) AS unique_terms, CAST(min(df) AS BIGINT) AS rarest FROM t JOIN f USING (term) GROUP BY 1""")
def q99_rare_terms(s, d):
    t = table(s, d, "memory_schemas").select("id", F.explode(tokens(F.col("content_text"))).alias("term")).distinct()
    f = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return t.join(f, "term").groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("df") == 1).alias("unique_terms"), F.min("df").alias("rarest"))


@query("""SELECT table_name, count(*) AS n, count(DISTINCT lower(trim(row_key))) AS keys, count(*) FILTER (row_key <> lower(trim(row_key))) AS untidy, CAST(epoch(date_trunc('second', min(deleted_at))) AS BIGINT) AS first_at FROM deletions GROUP BY 1""")
def q100_tombstones(s, d):
    tidy = F.lower(F.trim("row_key"))
    return table(s, d, "deletions").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(tidy).alias("keys"), F.count_if(F.col("row_key") != tidy).alias("untidy"), epoch(F.min("deleted_at")).alias("first_at"))


@query(f"""SELECT retrieval_id, string_agg(candidate_id, ',' ORDER BY coalesce(selected_position, 999999), candidate_kind, candidate_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_id ORDER BY coalesce(selected_position, 999999), candidate_kind, candidate_id) AS k FROM {LAST_CANDS} WHERE decision = 'selected') WHERE k <= 20 GROUP BY 1""")
def q101_delivered_lists(s, d):
    order = [F.coalesce("selected_position", F.lit(999_999)), F.col("candidate_kind"), F.col("candidate_id")]
    top = candidates(s, d).where("decision = 'selected'").withColumn("k", F.row_number().over(Window.partitionBy("retrieval_id").orderBy(*order))).where("k <= 20")  # a page has twenty
    return top.groupBy("retrieval_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "candidate_id"))), lambda x: x["candidate_id"]), ",").alias("items"))


@query()
def q102_weighted_sample(s, d):
    """256 episodes drawn without replacement, in proportion to their salience, by a draw fixed by the id."""
    u = (F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 2))
    return episodes(s, d).where("salience > 0").select("id", "salience", (F.log(u) / F.col("salience")).alias("key")).orderBy(F.desc("key"), "id").limit(256).select("id", "salience")


@query()
def q103_sentence_windows(s, d):
    """Windows of whole sentences of at most 1,024 characters over each document; a longer sentence is a window of its own."""
    return sentence_windows(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH RECURSIVE c AS (SELECT coalesce(scope_id, 'none') AS scope, id, least(2000, length(content_text)) AS size, row_number() OVER (PARTITION BY coalesce(scope_id, 'none') ORDER BY id) AS k FROM {LAST_SCHEMAS}),
r(scope, id, k, fill, page) AS (SELECT scope, id, k, size, CAST(0 AS BIGINT) FROM c WHERE k = 1 UNION ALL SELECT c.scope, c.id, c.k, CASE WHEN r.fill > 0 AND r.fill + c.size > 2000 THEN c.size ELSE r.fill + c.size END, r.page + CASE WHEN r.fill > 0 AND r.fill + c.size > 2000 THEN 1 ELSE 0 END FROM r JOIN c ON c.scope = r.scope AND c.k = r.k + 1)
SELECT scope, id, page FROM r""")
def q104_pages(s, d):
    """The page of each claim in its scope: a page takes claims in order while they fit 2,000 characters."""
    rows = schemas(s, d).select(F.coalesce("scope_id", F.lit("none")).alias("scope"), "id", F.length("content_text").alias("size"))
    return budget_pages(rows, "scope", "id", "size", 2_000)


@query(f"""SELECT r.key AS retrieval_id, selected_total, coalesce(n, 0) AS delivered, selected_total - coalesce(n, 0) AS difference FROM (SELECT *, lower(trim(retrieval_id)) AS key FROM {LAST_RUNS}) r LEFT JOIN (SELECT retrieval_id, count(*) AS n FROM {LAST_CANDS} WHERE decision = 'selected' GROUP BY 1) c ON c.retrieval_id = r.key""")
def q105_selection_audit(s, d):
    """What each run says it selected, what a recount of its candidates gives, and the difference."""
    shown = candidates(s, d).where("decision = 'selected'").groupBy(F.col("retrieval_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = runs(s, d).join(shown, "key", "left").withColumn("delivered", F.coalesce("n", F.lit(0)))
    return rows.select(F.col("key").alias("retrieval_id"), "selected_total", "delivered", (F.col("selected_total") - F.col("delivered")).alias("difference"))


@query("""SELECT id, CAST(sum(CASE WHEN dim <> len(embedding) THEN 1 ELSE 0 END) AS BIGINT) AS wrong_dim, count(*) AS deliveries, count(DISTINCT salience) AS saliences FROM episodic_memories GROUP BY 1 HAVING count(*) > 1 OR sum(CASE WHEN dim <> len(embedding) THEN 1 ELSE 0 END) > 0""")
def q106_vector_audit(s, d):
    wrong = F.when(F.col("embedding").isNotNull() & (F.col("dim") != F.size("embedding")), 1).otherwise(0)
    per = table(s, d, "episodic_memories").groupBy("id").agg(F.sum(wrong).alias("wrong_dim"), F.count(F.lit(1)).alias("deliveries"), F.count_distinct("salience").alias("saliences"))
    return per.where("deliveries > 1 or wrong_dim > 0").select("id", "wrong_dim", "deliveries", "saliences")


@query(f"""SELECT id, least(20.0, salience + 0.5 * coalesce(uses, 0)) AS salience, greatest(coalesce(confidence, 0.5), least(1.0, 0.5 + 0.1 * coalesce(uses, 0))) AS confidence FROM {LAST_SCHEMAS} LEFT JOIN {_USES} u USING (id)""")
def q107_reinforced(s, d):
    rows, uses = schemas(s, d).join(_uses(s, d), "id", "left"), F.coalesce("uses", F.lit(0))
    return rows.select("id", F.least(F.lit(20.0), F.col("salience") + 0.5 * uses).alias("salience"), F.greatest(F.coalesce("confidence", F.lit(0.5)), clamp(0.5 + 0.1 * uses, 0.0, 1.0)).alias("confidence"))


@query(r"""SELECT sc AS scope, count(*) AS claims, count(DISTINCT t) AS texts, round(1 - count(DISTINCT t) / count(*), 6) AS repeated FROM (SELECT coalesce(scope_id, 'none') AS sc, trim(regexp_replace(lower(content_text), '[ \t\r\n\f\v]+', ' ', 'g')) AS t FROM """ + LAST_SCHEMAS + """) GROUP BY 1""")
def q108_repeated_claims(s, d):
    rows = schemas(s, d).groupBy(F.coalesce("scope_id", F.lit("none")).alias("scope"))
    texts = F.count_distinct(F.md5(normalised(F.col("content_text"))))
    return rows.agg(F.count(F.lit(1)).alias("claims"), texts.alias("texts")).withColumn("repeated", F.round(1 - F.col("texts") / F.col("claims"), 6))
