"""Queries p1 and p3 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.clusters import linked_clusters, typical_members
from memlake.llm.leakage import leaked_items
from memlake.llm.neardup import expand_pairs, expand_vectors, similar_texts, similar_vectors, vector_classes
from memlake.llm.nearest import nearest_vectors, neighbour_pairs, vectors_of
from memlake.llm.spans import shared_spans
from memlake.llm.tokens import decode, encode, encode_offsets
from memlake.llm.topn import latest_candidates, top_n
from memlake.sources.tables import table

VECTOR_SETS = {"episode": ("episodic_memories", "embedding"), "prototype": ("semantic_prototypes", "centroid")}


def vector_set(spark: SparkSession, d: str, name: str) -> DataFrame:
    t, c = VECTOR_SETS[name]
    return vectors_of(table(spark, d, t), F.col("id"), F.col(c))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    sets = [neighbour_pairs(nearest_vectors(vector_set(spark, d, s), k=5, least=0.7)).select(F.lit(s).alias("vector_set"), "id_1", "id_2") for s in VECTOR_SETS]
    return sets[0].unionByName(sets[1])


def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "standing_rules").select(F.col("memory_id").alias("id"), F.col("preview").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = expand_pairs(*similar_texts(previews(spark, d), 0.7))
    vectors = vector_set(spark, d, "episode")
    pairs = expand_vectors(*similar_vectors(vectors, 0.97), vectors)
    return texts.select(F.lit("preview").alias("dup_field"), "id_1", "id_2").unionByName(pairs.select(F.lit("embedding").alias("dup_field"), "id_1", "id_2"))


def p3_preview_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each rule with words, its class of equal word sets, and the number of other classes that are nearly the same."""
    pairs, classes = similar_texts(previews(spark, d), 0.7)
    links = pairs.select(F.explode(F.array("head_1", "head_2")).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(links, "head", "left").select(F.col("id").alias("memory_id"), F.col("head").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def p3_embedding_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each episode with a usable vector, its class of equal vectors, and the number of other classes that are nearly the same."""
    vectors = vector_set(spark, d, "episode")
    rows = vector_classes(*similar_vectors(vectors, 0.97), vectors)
    return rows.select(F.col("id").alias("episode_id"), F.col("head").alias("class_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_clusters(vector_set(spark, d, "episode")).select("cluster_key", F.col("id").alias("episode_id"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size and most typical episodes, the prototype most of its episodes map to, and what that one claims as support."""
    vectors = vector_set(spark, d, "episode")
    members = linked_clusters(vectors)
    typical = typical_members(members, vectors).groupBy("cluster_key", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical"))
    links = table(spark, d, "episode_prototype_map").select(F.col("episode_id").alias("id"), "prototype_id").where(F.col("prototype_id").isNotNull()).distinct()
    counts = members.join(links, "id").groupBy("cluster_key", "prototype_id").agg(F.count(F.lit(1)).alias("mapped"))
    best = counts.groupBy("cluster_key").agg(F.max(F.struct("mapped", -F.col("prototype_id"))).alias("best"))
    support = table(spark, d, "semantic_prototypes").groupBy(F.col("id").alias("prototype_id")).agg(F.max_by("support_count", "loaded_at").alias("support_count"))
    flat = typical.join(best, "cluster_key", "left").select("cluster_key", "size", "typical", F.col("best.mapped").alias("mapped"), (-F.col("best.col2")).alias("prototype_id"))
    return flat.join(support, "prototype_id", "left").select("cluster_key", "size", "typical", "prototype_id", "mapped", "support_count")


def _top(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = latest_candidates(table(spark, d, "retrieval_trace_candidates"))
    ties = [F.col("selected_position").asc_nulls_last(), F.col("candidate_kind"), F.col("candidate_id")]
    return top_n(rows, "retrieval_id", "rrf_score", ties, n)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 5).select("retrieval_id", "candidate_kind", "candidate_id")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 10).select("retrieval_id", F.col("rank").cast("long").alias("place"), "candidate_kind", "candidate_id", "rrf_score")


_TOP_SQL = """
SELECT retrieval_id, candidate_kind, candidate_id, rrf_score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY retrieval_id ORDER BY rrf_score DESC, selected_position ASC NULLS LAST, candidate_kind, candidate_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY retrieval_id, candidate_kind, candidate_id ORDER BY loaded_at DESC NULLS LAST, rrf_score DESC, selected_position DESC) AS age
        FROM retrieval_trace_candidates)
  WHERE age = 1 AND rrf_score IS NOT NULL AND NOT isnan(rrf_score))
WHERE place <= {n}"""


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, characters and bytes of each document, and how many of its tokens begin inside a character."""
    rows = encode_offsets(table(spark, d, "documents"))
    inside = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.element_at("char_starts", i) == F.element_at("char_starts", i + 1)), lambda x: x))
    return rows.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.when(F.size("ids") > 1, inside).otherwise(0).cast("long").alias("split_tokens"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as its ids give it back: null and empty texts give an empty one."""
    return decode(encode(table(spark, d, "documents"))).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return leaked_items(texts, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """The longest passage of each leaked item in each document that holds one."""
    return _leaks(spark, d)


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document that shares a span stands elsewhere too."""
    size = table(spark, d, "documents").select("doc_id", F.length("text").alias("size"))
    sums = _spans(spark, d).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    return sums.join(size, "doc_id").select("doc_id", "spans", "shared_chars", F.round(F.col("shared_chars") / F.col("size"), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p3_found, p3_preview_classes, p3_embedding_classes, p4_found, p4_clusters, p5_found, p5_ranked, p6_ids, p6_offsets, p6_decoded, p7_found, p7_spans, p8_found, p8_shares)
}

# usable vectors, one of each id, in double precision
_VECTORS = """(SELECT id, any_value(list_transform({c}, lambda x: x::DOUBLE)) AS v FROM {t} WHERE len({c}) > 0 AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({c}, lambda x: x <> 0)) > 0 GROUP BY id)"""


def _cosines(t: str, c: str, least: float) -> str:
    v = _VECTORS.format(t=t, c=c)
    return f"(SELECT * FROM (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS cos FROM {v} a JOIN {v} b ON a.id <> b.id AND len(a.v) = len(b.v)) WHERE cos >= {least})"


_WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
_NEAREST = """SELECT DISTINCT '{s}' AS vector_set, least(a, b) AS id_1, greatest(a, b) AS id_2 FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS r FROM {x}) WHERE r <= 5"""
_PREVIEWS = f"(SELECT DISTINCT memory_id AS id, list_distinct({_WORDS.format(c='preview')}) AS w FROM standing_rules WHERE len({_WORDS.format(c='preview')}) > 0)"
_GRAMS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark WHERE text IS NOT NULL), l AS (SELECT DISTINCT least(13, len(w)) AS n FROM i WHERE len(w) > 0),
x AS (SELECT item_id, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
y AS (SELECT doc_id, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, l WHERE len(w) >= n))"""
_SPANS = """WITH w AS (SELECT doc_id, p, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM documents WHERE length(text) >= 300)), s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 300 THEN 0 ELSE 1 END AS new FROM w WHERE h IN (SELECT h FROM s)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m)"""

# p1 is approximate; on the test data of scale 0.01 it loses nothing
SQL = {
    "p1_found": " UNION ALL ".join(_NEAREST.format(s=k, x=_cosines(t, c, 0.7)) for k, (t, c) in VECTOR_SETS.items()),
    "p3_found": f"""SELECT 'preview' AS dup_field, a.id AS id_1, b.id AS id_2 FROM {_PREVIEWS} a JOIN {_PREVIEWS} b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.7
UNION ALL SELECT 'embedding', a, b FROM {_cosines("episodic_memories", "embedding", 0.97)} WHERE a < b""",
    "p3_preview_classes": f"""WITH w AS {_PREVIEWS}, k AS (SELECT id, list_sort(w) AS w FROM w), h AS (SELECT w, min(id) AS head FROM k GROUP BY 1), l AS (SELECT a.head, count(*) AS links FROM h a JOIN h b ON a.head <> b.head AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.7 GROUP BY 1)
SELECT k.id AS memory_id, h.head AS class_id, coalesce(l.links, 0) AS links FROM k JOIN h ON h.w = k.w LEFT JOIN l ON l.head = h.head""",
    "p3_embedding_classes": f"""WITH v AS {_VECTORS.format(t="episodic_memories", c="embedding")}, h AS (SELECT v, min(id) AS head FROM v GROUP BY 1), l AS (SELECT a.head, count(*) AS links FROM h a JOIN h b ON a.head <> b.head AND len(a.v) = len(b.v) AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.97 GROUP BY 1)
SELECT v.id AS episode_id, h.head AS class_id, coalesce(l.links, 0) AS links FROM v JOIN h ON h.v = v.v LEFT JOIN l ON l.head = h.head""",
    "p4_found": f"""WITH RECURSIVE e AS MATERIALIZED {_cosines("episodic_memories", "embedding", 0.7)}, r(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a WHERE r.label < e.b), m AS (SELECT node, min(label) AS label FROM r GROUP BY 1)
SELECT label AS cluster_key, node AS episode_id FROM m WHERE label IN (SELECT label FROM m GROUP BY 1 HAVING count(*) >= 5)""",
    "p7_found": _GRAMS + " SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (g)",
    "p8_found": _SPANS + " SELECT doc_id, min(p) - 1 AS span_start, max(p) + 299 AS span_end FROM g GROUP BY doc_id, k",
    "p8_shares": _SPANS + """ SELECT doc_id, count(*) AS spans, CAST(sum(e - b) AS BIGINT) AS shared_chars, round(sum(e - b) / any_value(length(text)), 6) AS share FROM (SELECT doc_id, min(p) - 1 AS b, max(p) + 299 AS e FROM g GROUP BY doc_id, k) JOIN documents USING (doc_id) GROUP BY 1""",
    "p5_found": f"SELECT retrieval_id, candidate_kind, candidate_id FROM ({_TOP_SQL.format(n=5)})",
    "p5_ranked": _TOP_SQL.format(n=10),
    "p6_decoded": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
}
