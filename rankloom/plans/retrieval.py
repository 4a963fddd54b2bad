"""Queries: search, fusion, ranking and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.functions import text as X
from rankloom.operators import etl, metrics
from rankloom.operators import retrieval as R
from rankloom.plans import base as B
from rankloom.plans.catalogue import register


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_topk(B.items(spark, sf), B.vector_queries(spark, sf))


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_topk(B.term_docs(spark, sf), B.term_queries(spark, sf))


@register("dense_topk", f"SELECT query_id, item_id, round(dense_score, 9) AS dense_score, dense_rank FROM {B.DENSE_SQL}")
def dense_topk(spark, sf):
    return B.rounded(_dense(spark, sf), "dense_score")


_META = """(SELECT doc_id AS item_id, lang AS category, source, n_chars, doc_id * 7919 % 1000 / 1000.0 AS joy FROM documents)"""


def _metadata(spark, sf):
    docs = B.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("category"), "source", "n_chars", (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("joy"))


def _found(spark, sf):
    return _dense(spark, sf).select("query_id", "item_id", F.col("dense_rank").alias("rank"))


@register("recommend_filtered", f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY joy DESC, dense_rank, item_id) AS place, m.item_id, category, source, n_chars, round(joy, 9) AS joy, dense_rank AS rank
FROM {B.DENSE_SQL} d JOIN {_META} m USING (item_id) WHERE category = 'en'""")
def recommend_filtered(spark, sf):
    out = etl.recommend(_found(spark, sf), _metadata(spark, sf), category="en", tone="happy")
    return B.rounded(out.select("query_id", "place", "item_id", "category", "source", "n_chars", "joy", F.col("rank").cast("long").alias("rank")), "joy")


@register("recommend_all", f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY joy DESC, dense_rank, item_id) AS place, item_id, round(joy, 9) AS joy, dense_rank AS rank
FROM (SELECT * FROM {B.DENSE_SQL} JOIN {_META} m USING (item_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense_rank, item_id) <= 16)""")
def recommend_all(spark, sf):
    return B.rounded(etl.recommend(_found(spark, sf), _metadata(spark, sf), tone="happy").select("query_id", "place", "item_id", "joy", F.col("rank").cast("long").alias("rank")), "joy")


@register("tokenize_counts", f"""
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({B.TOKENS.format('text')}) AS term FROM documents) GROUP BY term""")
def tokenize_counts(spark, sf):
    flat = B.term_docs(spark, sf).select("item_id", F.explode("terms").alias("term"))
    # one row for each (document, term) first: no second shuffle for the distinct count
    return flat.groupBy("term", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@register("bm25_topk", f"WITH {B.BM25_CTE} SELECT query_id, item_id, round(bm25_score, 9) AS bm25_score, bm25_rank FROM bm")
def bm25_topk(spark, sf):
    return B.rounded(_bm25(spark, sf), "bm25_score")


_UNION = f"""
  de AS (SELECT * FROM {B.DENSE_SQL}), {B.BM25_CTE.strip()},
  hu AS (SELECT query_id, item_id, dense_rank, bm25_rank,
         CASE WHEN dense_rank IS NULL THEN 'bm25' WHEN bm25_rank IS NULL THEN 'dense' ELSE 'both' END AS source,
         coalesce(1.0 / (60 + dense_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0) AS rrf_score
         FROM de FULL JOIN bm USING (query_id, item_id)),
  hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, item_id) AS hybrid_rank FROM hu)"""


def _hybrid(spark, sf):
    return R.hybrid_union(_dense(spark, sf), _bm25(spark, sf))


@register("hybrid_union", f"WITH {_UNION} SELECT query_id, item_id, dense_rank, bm25_rank, source, round(rrf_score, 9) AS rrf_score, hybrid_rank FROM hr")
def hybrid_union(spark, sf):
    return B.rounded(_hybrid(spark, sf).select("query_id", "item_id", "dense_rank", "bm25_rank", "source", "rrf_score", "hybrid_rank"), "rrf_score")


# a stand-in for a cross encoder's score that both engines compute alike
_RAW = "(item_id * 31 + query_id) % 97"
_RERANKED = f"""
  rr AS (SELECT *, {_RAW} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_RAW} DESC, hybrid_rank, item_id) AS rerank_rank FROM hr)"""


def _reranked(spark, sf):
    return R.rerank(_hybrid(spark, sf).withColumn("score", F.expr(_RAW)), prior="hybrid_rank")


@register("rerank_rank", f"WITH {_UNION}, {_RERANKED} SELECT query_id, item_id, score, rerank_rank FROM rr")
def rerank_rank(spark, sf):
    return _reranked(spark, sf).select("query_id", "item_id", "score", "rerank_rank")


@register("rrf_rank", f"""WITH {_UNION}, {_RERANKED},
  fu AS (SELECT *, 1.0 / (60 + hybrid_rank) + 1.0 / (60 + rerank_rank) AS fused_score FROM rr)
SELECT query_id, item_id, round(fused_score, 9) AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, rerank_rank, hybrid_rank, item_id) AS final_rank FROM fu""")
def rrf_rank(spark, sf):
    return B.rounded(R.fuse_with_rerank(_reranked(spark, sf), prior="hybrid_rank").select("query_id", "item_id", "fused_score", "final_rank"), "fused_score")


@register("vector_rerank_fusion", f"""WITH de AS (SELECT * FROM {B.DENSE_SQL}),
  rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_RAW} DESC, dense_rank, item_id) AS rerank_rank FROM de),
  fu AS (SELECT *, 1.0 / (60 + dense_rank) + 1.0 / (60 + rerank_rank) AS fused_score FROM rr)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused_score, 12) DESC, rerank_rank, dense_rank, item_id) AS final_rank FROM fu QUALIFY final_rank <= 10""")
def vector_rerank_fusion(spark, sf):
    scored = R.rerank(_dense(spark, sf).withColumn("score", F.expr(_RAW)), prior="dense_rank")
    return R.top(R.fuse_with_rerank(scored, prior="dense_rank"), "final_rank", 10).select("query_id", "item_id", "final_rank")


@register("v4b_rank", f"""WITH {_UNION}
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id % 7 DESC, hybrid_rank, item_id) AS final_rank FROM hr QUALIFY final_rank <= 10""")
def v4b_rank(spark, sf):
    pairs = _hybrid(spark, sf).withColumn("score", (F.col("item_id") % 7).cast("double"))
    return R.top(R.strict_rank(pairs, prior="hybrid_rank"), "final_rank", 10).select("query_id", "item_id", "final_rank")


@register("display_union", f"""
WITH a AS {B.graded_sql('a')}, b AS {B.graded_sql('b')}
SELECT query_id, item_id, a.rank AS a_rank, b.rank AS b_rank, a.rank IS NOT NULL AS in_a, b.rank IS NOT NULL AS in_b,
       CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS pair_source
FROM a FULL JOIN b USING (query_id, item_id)""")
def display_union(spark, sf):
    return R.display_union(B.graded(spark, sf, "a"), B.graded(spark, sf, "b")).select("query_id", "item_id", "a_rank", "b_rank", "in_a", "in_b", "pair_source")


@register("system_membership", f"""
SELECT query_id, item_id, min(rank) FILTER (s = 'a') AS a_rank, min(rank) FILTER (s = 'b') AS b_rank, min(rank) FILTER (s = 'c') AS c_rank, min(rank) AS best_rank, count(DISTINCT s) AS n_systems
FROM (SELECT query_id, item_id, rank, 'a' AS s FROM {B.graded_sql('a')} UNION ALL SELECT query_id, item_id, rank, 'b' FROM {B.graded_sql('b')} UNION ALL SELECT query_id, item_id, rank, 'c' FROM {B.graded_sql('a', 3)})
GROUP BY query_id, item_id""")
def system_membership(spark, sf):
    return R.membership({"a": B.graded(spark, sf, "a"), "b": B.graded(spark, sf, "b"), "c": B.graded(spark, sf, "a", 3)})


@register("rank_preserving_join", f"""
SELECT item_id, source, min(dense_rank) AS rank FROM {B.DENSE_SQL} JOIN {_META} m USING (item_id) GROUP BY item_id, source""")
def rank_preserving_join(spark, sf):
    return R.first_ranks(_dense(spark, sf).withColumnRenamed("dense_rank", "rank"), _metadata(spark, sf)).select("item_id", "source", "rank")


@register("vector_checks", """
SELECT label, count(*) AS n, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 0.001 AND len(embedding) = 64) AS unit,
       round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS mean_square FROM embeddings GROUP BY label""")
def vector_checks(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return B.rounded(e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(N.is_unit(F.col("embedding"), 64)).alias("unit"), F.avg(N.dot(F.col("embedding"), F.col("embedding"))).alias("mean_square")), "mean_square")


@register("graded_retrieval", f"""
WITH j AS (SELECT d.query_id, d.item_id, d.dense_rank AS rank, 4 - least(4, abs(e.label - q.label)) AS score
           FROM {B.DENSE_SQL} d JOIN embeddings e ON e.vec_id = d.item_id JOIN embeddings q ON q.vec_id = d.query_id WHERE dense_rank <= 10)
SELECT query_id, round(avg(score), 9) AS mean_score, coalesce(1.0 / min(rank) FILTER (score >= 3), 0)::DOUBLE AS mrr FROM j GROUP BY query_id""")
def graded_retrieval(spark, sf):
    labels = B.items(spark, sf).select("item_id", "label")
    queries = B.vector_queries(spark, sf).select("query_id", "query_label")
    judged = R.top(_dense(spark, sf), "dense_rank", 10).join(labels, "item_id").join(queries, "query_id").select(
        "query_id", "item_id", F.col("dense_rank").alias("rank"), (4 - F.least(F.lit(4), F.abs(F.col("label") - F.col("query_label")))).alias("score"))
    return B.rounded(metrics.query_summary(judged).select("query_id", "mean_score", "mrr"), "mean_score")


@register("search_texts", r"""
SELECT doc_id, md5('Title: ' || source || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || 'Description: ' || trim(text) END) AS labelled FROM documents""")
def search_texts(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(X.labelled_text(F.col("source"), F.col("text"))).alias("labelled"))
