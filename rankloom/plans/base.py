"""Tables in the shapes that the operators expect, from the star-schema and text tables, with the SQL of the same shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.session import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns rounded to nine places, as sums come in any order."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns})


# ------------------------------------------------ graded lists: a query is a part, an item an order line

SCORE = "CAST(floor(l_quantity) AS INT) % 5"
_ORDERS = {"a": "l_extendedprice DESC", "b": "l_discount DESC, l_extendedprice"}


def graded(spark: SparkSession, sf_dir: str, system: str = "a", depth: int = 10) -> DataFrame:
    """query_id, item_id, score, stratum, rank of one of two systems."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.expr(SCORE).alias("score"), "l_extendedprice", "l_discount")
    order = [F.desc("l_extendedprice")] if system == "a" else [F.desc("l_discount"), F.asc("l_extendedprice")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.asc("item_id")))).where(F.col("rank") <= depth).select("query_id", "item_id", "score", "rank")


def graded_sql(system: str = "a", depth: int = 10) -> str:
    return f"""(SELECT l_partkey AS query_id, l_orderkey * 10 + l_linenumber AS item_id, {SCORE} AS score,
      row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDERS[system]}, l_orderkey * 10 + l_linenumber) AS rank
      FROM lineitem QUALIFY rank <= {depth})"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("stratum"))


# ------------------------------------------------ retrieval: documents, their vectors, benchmark items as queries

TOKENS = r"""list_filter(regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '[''’]', '', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda t: NOT contains(t, '_') AND length(t) >= 2)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), X.tokens(F.col("text")).alias("terms"))


def term_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, numbered like the vector queries."""
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("query_id"), X.tokens(F.col("text")).alias("terms"))


DENSE_SQL = """(SELECT query_id, item_id, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, item_id) AS dense_rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS item_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense_score
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) QUALIFY dense_rank <= 50)"""
BM25_CTE = f"""
  d AS (SELECT doc_id AS item_id, {TOKENS.format('text')} AS terms FROM documents),
  s AS (SELECT count(*) AS n_docs, avg(len(terms)) AS mean_length FROM d),
  p AS (SELECT item_id, any_value(length) AS length, term, count(*) AS tf FROM (SELECT item_id, len(terms) AS length, unnest(terms) AS term FROM d) GROUP BY item_id, term),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT item_id * 100 AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY query_id, term),
  m AS (SELECT query_id, item_id, sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS bm25_score
        FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY query_id, item_id),
  bm AS (SELECT query_id, item_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, item_id) AS bm25_rank FROM m WHERE bm25_score > 0 QUALIFY bm25_rank <= 50)"""


# ------------------------------------------------ two annotators: order lines scored by quantity and by discount

PAIRS_SQL = "(SELECT l_orderkey * 10 + l_linenumber AS case_id, CAST(floor(l_quantity) AS INT) % 5 AS human, CAST(floor(l_quantity) + (CASE WHEN l_linenumber % 3 = 0 THEN round(l_discount * 100) ELSE 0 END) AS INT) % 5 AS judge, l_returnflag AS grp FROM lineitem)"


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, human, judge, grp."""
    judge = F.expr("CAST(floor(l_quantity) + (CASE WHEN l_linenumber % 3 = 0 THEN round(l_discount * 100) ELSE 0 END) AS INT) % 5")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), F.expr(SCORE).alias("human"), judge.alias("judge"), F.col("l_returnflag").alias("grp"))
