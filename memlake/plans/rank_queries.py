"""Queries of text, vectors, ranking and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.columns import dot, epoch, stem, tokens
from memlake.operators import graph, ranking
from memlake.operators.lexical import bm25, contrastive_terms
from memlake.operators.search import block_search, cosine_histogram
from memlake.operators.vectors import bound_pairs, mean_pair_distance, mean_vectors, principal_axes
from memlake.plans.log_queries import LAST_CANDS, candidates, schemas
from memlake.plans.registry import registry
from memlake.plans.runtime import broadcast_if_small, written
from memlake.sources.tables import table

QUERIES, SQL, query = registry()
WIDTH = 64


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", "text", "doc_kind")


def cues(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").where("text is not null").select(F.col("item_id").alias("cue_id"), "text")


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS kinds FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL)")
def q13_tokens(s, d):
    rows = documents(s, d).select("doc_id", tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("kinds"))


BM25 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, len(w) AS len, w FROM d WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q AS (SELECT DISTINCT item_id AS cue_id, unnest({WORDS}) AS term FROM benchmark WHERE text IS NOT NULL), p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(w) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), sc AS (SELECT cue_id, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY 1, 2),
top AS (SELECT cue_id, doc_id, score, row_number() OVER (PARTITION BY cue_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(BM25 + " SELECT cue_id, doc_id, score, rank FROM top WHERE rank <= 10")
def q14_bm25_topk(s, d):
    return bm25(documents(s, d), cues(s, d)).select("cue_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH w AS (SELECT doc_kind, doc_id, unnest({WORDS}) AS term FROM documents WHERE text IS NOT NULL), x AS (SELECT * FROM w WHERE length(term) >= 3), t AS (SELECT doc_kind, term, count(*) AS tf, count(DISTINCT doc_id) AS d FROM x GROUP BY 1, 2),
f AS (SELECT term, sum(d) AS df FROM t GROUP BY 1), g AS (SELECT doc_kind, sum(tf) AS total FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_kind, term, round(tf / total * ln(1 + n / (1 + df)), 6) AS weight FROM t JOIN f USING (term) JOIN g USING (doc_kind), n)
SELECT * FROM (SELECT doc_kind, term, weight, row_number() OVER (PARTITION BY doc_kind ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 8""")
def q15_contrastive_terms(s, d):
    return contrastive_terms(documents(s, d), "doc_kind").withColumn("rank", F.col("rank").cast("long"))


@query(BM25 + f""" SELECT t.cue_id, t.doc_id, round(3.0 * len(list_intersect(b.w, dd.w)) / len(b.w) - 2, 6) AS overlap FROM top t JOIN (SELECT item_id, list_distinct({WORDS}) AS w FROM benchmark) b ON b.item_id = t.cue_id
JOIN (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents) dd ON dd.doc_id = t.doc_id WHERE rank <= 10""")
def q16_lexical_overlap(s, d):
    docs, asked = documents(s, d), cues(s, d)
    own = lambda df, c: df.select(c, F.array_distinct(tokens(F.col("text"))).alias(f"{c}_w"))
    rows = bm25(docs, asked).join(own(asked, "cue_id"), "cue_id").join(own(docs, "doc_id"), "doc_id")
    common = F.size(F.array_intersect("cue_id_w", "doc_id_w"))
    return rows.select("cue_id", "doc_id", F.round(3.0 * common / F.size("cue_id_w") - 2, 6).alias("overlap"))


@query()
def q50_budget_pack(s, d):
    """Of each cue's ten best documents, those that fit 4,000 characters when taken in order."""
    docs = documents(s, d)
    top = bm25(docs, cues(s, d)).join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
    lists = top.groupBy("cue_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size"))).alias("l"))  # ten at most
    taken = lists.select("cue_id", "l", F.explode(ranking.packed(F.transform("l", lambda x: x["size"].cast("long")), 4_000)).alias("place"))
    return taken.select("cue_id", "place", F.element_at("l", F.col("place"))["doc_id"].alias("doc_id"))


@query(f"""SELECT stem, count(*) AS n FROM (SELECT CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN CASE WHEN length(t) > 5 AND t[-4] = t[-5] THEN t[:-5] ELSE t[:-4] END WHEN length(t) > 4 AND t LIKE '%ies' THEN regexp_replace(t, 'ies$', 'y') WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN regexp_replace(t, 's$', '') ELSE t END AS stem
FROM (SELECT unnest(regexp_extract_all(lower(content_text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM memory_schemas)) GROUP BY 1""")
def q71_stems(s, d):
    words = table(s, d, "memory_schemas").select(F.explode(tokens(F.col("content_text"))).alias("t"))
    return words.groupBy(stem(F.col("t")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


# ---- vectors: the stated query set is every id that 100 divides


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_V = "(SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query(f"""SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine FROM {_V} q JOIN {_V} r ON q.id <> r.id WHERE q.id % 100 = 0)) WHERE rank <= 10""")
def q17_cosine_topk(s, d):
    rows = _vectors(s, d)
    return block_search(rows.select("id", "vec"), rows.where("id % 100 = 0").select("id", "vec"), 10, WIDTH).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine FROM {_V} q JOIN {_V} r ON q.id <> r.id WHERE q.id % 100 = 0 AND r.label IN (1, 3, 5))) WHERE rank <= 5""")
def q18_cosine_topk_scoped(s, d):
    rows = _vectors(s, d)
    visible = rows.where(F.col("label").isin(1, 3, 5))  # the scope is filtered before the ranking, not after
    return block_search(visible.select("id", "vec"), rows.where("id % 100 = 0").select("id", "vec"), 5, WIDTH).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT CAST(floor(round(c / 0.05, 6)) AS BIGINT) AS bin, count(*) AS pairs FROM (SELECT round(list_cosine_similarity(q.v, r.v), 6) AS c FROM {_V} q JOIN {_V} r ON q.id <> r.id WHERE q.id % 100 = 0) GROUP BY 1""")
def q41_cosine_distribution(s, d):
    rows = _vectors(s, d).select("id", "vec")
    return cosine_histogram(rows, rows.where("id % 100 = 0"), WIDTH)


@query("""SELECT label, CAST(pos - 1 AS BIGINT) AS pos, round(avg(x), 6) AS v, count(*) AS n, any_value(variance) AS variance FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
JOIN (SELECT label, round(sum(v), 6) AS variance FROM (SELECT label, var_pop(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY 1) USING (label) GROUP BY 1, 2""")
def q43_centroids(s, d):
    rows = mean_vectors(_vectors(s, d), "label", "vec").select("label", "n", F.round("variance", 6).alias("variance"), F.posexplode("centroid").alias("pos", "v"))
    return rows.select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"), "n", "variance")


@query(f"""SELECT a.label, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS distance FROM {_V} a JOIN {_V} b ON a.label = b.label AND a.id < b.id GROUP BY 1""")
def q44_pair_distances(s, d):
    return mean_pair_distance(_vectors(s, d), "label", "vec").select("label", F.round("distance", 6).alias("distance"))


@query()
def q49_mmr(s, d):
    """Five varied ones of each query's twenty nearest vectors."""
    rows = _vectors(s, d).select("id", "vec")
    top = block_search(rows, rows.where("id % 100 = 0"), 20, WIDTH)
    return ranking.mmr(top.join(rows, "id").select("query_id", "id", "cosine", "vec"), "query_id", "id", "cosine", "vec")


@query()
def q51_principal_axes(s, d):
    """The four strongest axes of each label's vectors, the strength of each and its largest component."""
    rows = principal_axes(_vectors(s, d), "label", "vec", WIDTH)
    return rows.select("label", "axis", F.round("strength", 6).alias("strength"), F.round(F.array_max("direction"), 6).alias("largest"), (F.array_position("direction", F.array_max("direction")) - 1).alias("place"))


@query()
def q54_role_binding(s, d):
    """Each vector bound with its label's centroid in two roles, and how well the first role gives it back."""
    rows = _vectors(s, d)
    centres = broadcast_if_small(mean_vectors(rows, "label", "vec").select("label", "centroid"), 10_000)  # labels; a join in shuffles beyond
    return bound_pairs(rows.join(centres, "label"), "vec", "centroid").select("id", F.round("recovered", 6).alias("recovered"))


@query("""SELECT label, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm, count(*) AS n FROM embeddings GROUP BY 1""")
def q81_norms(s, d):
    return _vectors(s, d).groupBy("label").agg(F.round(F.avg(F.sqrt(dot(F.col("vec"), F.col("vec")))), 6).alias("mean_norm"), F.count(F.lit(1)).alias("n"))


# ---- ranking

_RANKS = f"""SELECT *, CASE WHEN dense_cosine IS NULL THEN NULL ELSE rank() OVER (PARTITION BY retrieval_id ORDER BY dense_cosine DESC NULLS LAST) END AS dense_rank FROM {LAST_CANDS}"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return ranking.tied_rank(written(candidates(s, d), "candidates"), "retrieval_id", "dense_cosine", "dense_rank")


@query(f"""SELECT retrieval_id, candidate_kind, candidate_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_id ORDER BY score DESC, candidate_kind, candidate_id) AS place FROM (
SELECT *, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0), 9) AS score FROM ({_RANKS}))) WHERE place <= 10""")
def q19_rrf_fusion(s, d):
    score = F.round(ranking.reciprocal(F.col("dense_rank")) + ranking.reciprocal(F.col("lexical_rank")), 9)
    w = Window.partitionBy("retrieval_id").orderBy(F.desc("score"), "candidate_kind", "candidate_id")
    rows = _ranked(s, d).withColumn("score", score).withColumn("place", F.row_number().over(w)).where("place <= 10")
    return rows.select("retrieval_id", "candidate_kind", "candidate_id", "score", F.col("place").cast("long").alias("place"))


@query(f"""SELECT candidate_kind, candidate_id, max(score) AS score FROM (SELECT *, round(coalesce(CASE WHEN dense_rank <= 32 THEN 1.0 / (30 + dense_rank) END, 0) + coalesce(CASE WHEN lexical_rank <= 32 THEN 2.0 / (30 + lexical_rank) END, 0), 9) AS score FROM ({_RANKS})) GROUP BY 1, 2""")
def q20_weighted_rrf(s, d):
    near = lambda c: F.when(F.col(c) <= 32, F.col(c))
    score = F.round(ranking.reciprocal(near("dense_rank"), 30) + ranking.reciprocal(near("lexical_rank"), 30, 2.0), 9)
    return _ranked(s, d).groupBy("candidate_kind", "candidate_id").agg(F.max(score).alias("score"))


@query(f"""SELECT retrieval_id, candidate_kind, candidate_id, round(CASE WHEN count(dense_cosine) OVER w >= 3 THEN least(6.0, greatest(-4.0, (dense_cosine - avg(dense_cosine) OVER w) / greatest(0.02, stddev_pop(dense_cosine) OVER w))) ELSE 0 END, 5) AS z FROM {LAST_CANDS} WHERE dense_cosine IS NOT NULL WINDOW w AS (PARTITION BY retrieval_id)""")
def q22_pool_zscore(s, d):
    rows = candidates(s, d).where("dense_cosine is not null")
    return ranking.pool_z(rows, "retrieval_id", "dense_cosine").select("retrieval_id", "candidate_kind", "candidate_id", F.round("z", 5).alias("z"))


@query(f"""SELECT retrieval_id, candidate_kind, candidate_id, round(p, 6) AS p FROM (SELECT *, max(p) OVER (PARTITION BY retrieval_id) AS best FROM (SELECT *, 1 / (1 + exp(-(4 * coalesce(dense_cosine, 0) + 3 * coalesce(applicability, 0) - 3))) AS p FROM {LAST_CANDS})) WHERE best >= 0.8 AND p >= 0.6""")
def q23_admission(s, d):
    x = 4 * F.coalesce("dense_cosine", F.lit(0.0)) + 3 * F.coalesce("applicability", F.lit(0.0)) - 3
    rows = candidates(s, d).withColumn("p", 1 / (1 + F.exp(-x)))
    return ranking.admitted(rows, "retrieval_id", "p", 0.6, 0.8).select("retrieval_id", "candidate_kind", "candidate_id", F.round("p", 6).alias("p"))


@query(f"SELECT retrieval_id, candidate_kind, candidate_id, dense_rank FROM ({_RANKS}) WHERE dense_rank <= 3")
def q72_tied_ranks(s, d):
    # a rank below a constant is limited within each task before the shuffle
    w = Window.partitionBy("retrieval_id").orderBy(F.desc("dense_cosine"))
    rows = candidates(s, d).where("dense_cosine is not null").withColumn("dense_rank", F.rank().over(w)).where("dense_rank <= 3")
    return rows.select("retrieval_id", "candidate_kind", "candidate_id", F.col("dense_rank").cast("long").alias("dense_rank"))


@query(f"""SELECT retrieval_id, candidate_kind, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_id, candidate_kind ORDER BY applicability DESC NULLS LAST, candidate_id) AS k FROM {LAST_CANDS}) WHERE k <= 2""")
def q73_diversity_cap(s, d):
    return ranking.diverse(candidates(s, d), "retrieval_id", "candidate_kind", [F.col("applicability").desc_nulls_last(), F.asc("candidate_id")]).select("retrieval_id", "candidate_kind", "candidate_id")


# ---- graphs: prototypes linked when an episode of one directly follows, within a day, one of the other

_LINKS = """SELECT e.id, e.ts, min(m.prototype_id) AS p FROM (SELECT id, min(ts) AS ts FROM episodic_memories GROUP BY id) e JOIN episode_prototype_map m ON m.episode_id = e.id WHERE m.prototype_id IS NOT NULL GROUP BY 1, 2"""
_TRANS = f"""SELECT p AS src, nxt AS dst, count(*) AS n FROM (SELECT p, lead(p) OVER (PARTITION BY ts // 86400 ORDER BY ts, id) AS nxt FROM ({_LINKS})) WHERE nxt IS NOT NULL GROUP BY 1, 2"""
_PROB = f"(SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM ({_TRANS}))"


def _steps(s: SparkSession, d: str) -> DataFrame:
    at = table(s, d, "episodic_memories").groupBy("id").agg(F.min("ts").alias("ts"))
    links = table(s, d, "episode_prototype_map").where("prototype_id is not null").select(F.col("episode_id").alias("id"), "prototype_id")
    return at.join(links, "id").groupBy("id", "ts").agg(F.min("prototype_id").alias("p"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return graph.transitions(_steps(s, d), F.floor(F.col("ts") / 86_400), F.floor(F.col("ts") / 60), ["ts", "id"], "p")


_NODES = f"(SELECT id AS node FROM semantic_prototypes WHERE id IS NOT NULL UNION SELECT p FROM ({_LINKS}))"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """Every prototype, and every one that an episode maps to, linked or not."""
    return table(s, d, "semantic_prototypes").select(F.col("id").alias("node")).where("node is not null").union(_steps(s, d).select("p")).distinct()


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.probabilities(_counts(s, d))


@query(f"SELECT src, dst, round(weight, 9) AS weight FROM {_PROB}")
def q33_transition_prob(s, d):
    return _edges(s, d).withColumn("weight", F.round("weight", 9))


@query(f"""WITH a AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM ({_TRANS.replace('WHERE nxt', 'WHERE h = 0 AND nxt').replace('SELECT p, lead', 'SELECT p, (ts // 86400) % 2 AS h, lead')})), b AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM ({_TRANS.replace('WHERE nxt', 'WHERE h = 1 AND nxt').replace('SELECT p, lead', 'SELECT p, (ts // 86400) % 2 AS h, lead')}))
SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, round(coalesce(a.w, 0) * 0.9 + coalesce(b.w, 0) * 0.1, 9) AS weight FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""")
def q35_edge_average(s, d):
    steps = _steps(s, d).withColumn("day", F.floor(F.col("ts") / 86_400))
    half = lambda h: graph.probabilities(graph.transitions(steps.where(F.col("day") % 2 == h), F.col("day"), F.floor(F.col("ts") / 60), ["ts", "id"], "p"))
    return graph.moving_average(half(0), half(1)).withColumn("weight", F.round("weight", 9))


@query(f"""SELECT src, dst, round(x, 9) AS weight FROM (SELECT src, dst, CASE WHEN s > 1 THEN n / s ELSE n END AS x, m FROM (SELECT src, dst, n / 2.0 AS n, sum(n / 2.0) OVER (PARTITION BY src) AS s, max(n / 2.0) OVER (PARTITION BY src) AS m FROM ({_TRANS}))) WHERE x >= 0.2 * m AND x >= 0.05""")
def q36_homeostatic(s, d):
    return graph.homeostatic(_counts(s, d).select("src", "dst", (F.col("n") / 2.0).alias("weight"))).withColumn("weight", F.round("weight", 9))


@query(f"""WITH e AS {_PROB}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM e) WHERE k <= 8), s0 AS (SELECT DISTINCT src AS node, 1.0 AS a FROM e WHERE src % 100 = 0),
s1 AS (SELECT dst AS node, sum(a * weight * 0.6) AS a FROM s0 JOIN t ON node = src GROUP BY 1 HAVING sum(a * weight * 0.6) >= 0.001), s2 AS (SELECT dst AS node, sum(a * weight * 0.6) AS a FROM s1 JOIN t ON node = src GROUP BY 1 HAVING sum(a * weight * 0.6) >= 0.001)
SELECT node, round(sum(a), 9) AS activation FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1""")
def q37_spread(s, d):
    edges = _edges(s, d)
    seeds = edges.where("src % 100 = 0").select(F.col("src").alias("node")).distinct().withColumn("activation", F.lit(1.0))
    return graph.spread(seeds, graph.strongest(edges, 8)).withColumn("activation", F.round("activation", 9))


@query(f"""WITH e AS {_PROB}, s0 AS (SELECT DISTINCT src AS node, 1.0 AS a FROM e WHERE src % 100 = 0), h1 AS (SELECT dst AS node, sum(a * weight * 0.6) AS a FROM s0 JOIN e ON node = src WHERE dst NOT IN (SELECT node FROM s0) GROUP BY 1),
h2 AS (SELECT dst AS node, sum(a * weight * 0.36) AS a FROM h1 JOIN e ON node = src WHERE dst NOT IN (SELECT node FROM s0) AND dst NOT IN (SELECT node FROM h1) GROUP BY 1)
SELECT node, 1 AS hop, round(a, 9) AS activation FROM h1 UNION ALL SELECT node, 2, round(a, 9) FROM h2""")
def q38_relation_spread(s, d):
    edges = _edges(s, d)
    seeds = edges.where("src % 100 = 0").select(F.col("src").alias("node")).distinct().withColumn("activation", F.lit(1.0))
    return graph.reached(seeds, edges, 2, 0.6).withColumn("activation", F.round("activation", 9))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_TRANS}) WHERE src <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.label FROM r JOIN b ON r.node = b.src WHERE r.label < b.dst) SELECT node, min(label) AS label FROM r GROUP BY 1""")
def q39_components(s, d):
    """Components of all links; q109_all_components adds the nodes without any."""
    return graph.connected_components(_counts(s, d).select("src", "dst"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_TRANS}) WHERE src <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, label) AS (SELECT DISTINCT src, src FROM b UNION SELECT b.dst, r.label FROM r JOIN b ON r.node = b.src WHERE r.label < b.dst)
SELECT n.node, coalesce(c.label, n.node) AS label FROM {_NODES} n LEFT JOIN (SELECT node, min(label) AS label FROM r GROUP BY 1) c ON c.node = n.node""")
def q109_all_components(s, d):
    return graph.connected_components(_counts(s, d).select("src", "dst"), _nodes(s, d))


@query()
def q40_hits(s, d):
    """Hubs and authorities over all links, until none changes by 1e-8 or after 50 rounds."""
    counts = _counts(s, d).select("src", "dst", F.col("n").cast("double").alias("weight"))
    return graph.hubs_and_authorities(counts, nodes=_nodes(s, d)).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query(f"""WITH t AS ({_TRANS}), g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM t UNION ALL SELECT dst FROM t) GROUP BY 1) SELECT degree, count(*) AS nodes FROM g GROUP BY 1""")
def q42_degrees(s, d):
    ends = _counts(s, d).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH t AS ({_TRANS}) SELECT a.src, a.dst, a.n, coalesce(b.n, 0) AS back FROM t a LEFT JOIN t b ON a.src = b.dst AND a.dst = b.src""")
def q82_symmetry(s, d):
    counts = _counts(s, d)
    back = counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("back"))
    return counts.join(back, ["src", "dst"], "left").fillna(0, ["back"])


@query()
def q52_step_alignment(s, d):
    """How far a user's events of one day follow the order of those of the day before: twice the common subsequence over both lengths."""
    days = table(s, d, "events").groupBy("user_id", F.floor(epoch(F.col("ts")) / 86_400).alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))
    days = days.select("user_id", "day", F.transform("l", lambda x: x["event_type"]).alias("steps"))
    pairs = days.withColumn("before", F.lag("steps").over(Window.partitionBy("user_id").orderBy("day"))).where("before is not null")
    return pairs.select("user_id", "day", F.round(2 * ranking.lcs_length(F.col("before"), F.col("steps")) / (F.size("before") + F.size("steps")), 6).alias("alignment"))


@query("""SELECT scope_id, status, n, round(n / sum(n) OVER (PARTITION BY scope_id), 6) AS share FROM (SELECT coalesce(scope_id, 'none') AS scope_id, lower(trim(status)) AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, last_updated_ts DESC, status DESC, salience DESC) AS r FROM memory_schemas) WHERE r = 1 GROUP BY 1, 2)""")
def q83_scope_purity(s, d):
    counts = schemas(s, d).groupBy(F.coalesce("scope_id", F.lit("none")).alias("scope_id"), F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scope_id")), 6))
