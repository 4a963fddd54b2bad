"""Exact deduplication by 128-bit content hash with byte comparison, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import read

_WIDE = "decimal(38,0)"
#: Weight of a code point in the ranking number; more than any place of a doc_id.
_UNIT = "100000000000000000000"


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts: one row per input row.

    Texts are equal when their normalised forms have the same bytes. Of a group the row with the most code
    points in the original text stays, then the one with the smallest id (a null id comes last).

    * The grouping keys are the two halves of a 128-bit hash *and* the normalised text, so the aggregation itself
      compares bytes; map-side partial aggregation leaves one row per task of a group of any size.
    * Texts whose hashes collide are thus groups of their own; rows find theirs by the hash and the text's SHA-256,
      so the text is shuffled once. Were two texts to share both, the job would fail rather than merge them.
    * Null text counts as empty, empty texts form a group, repeated rows are members like any other, an empty
      table gives an empty result. Further columns of the input are ignored, whatever their names.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("_norm"), F.char_length(text).alias("_points"))
    place = F.coalesce(F.lit("9223372036854775808").cast(_WIDE) - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast(_WIDE))
    rank = (F.col("_points").cast("decimal(10,0)") * F.lit(_UNIT).cast("decimal(21,0)") + place).cast(_WIDE)
    keyed = rows.select("doc_id", "_norm", F.xxhash64("_norm").alias("_h1"), F.xxhash64(F.lit(0x5DEECE66D), F.col("_norm")).alias("_h2"), F.sha2("_norm", 256).alias("text_sha256"), rank.alias("_rank"))

    by_bytes = keyed.groupBy("_h1", "_h2", "_norm").agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_best"))
    # each group of equal bytes is known by its hash and its digest from here on; two texts with both alike stop the job
    named = by_bytes.select("_h1", "_h2", F.sha2("_norm", 256).alias("text_sha256"), "_n", "_best")
    groups = named.groupBy("_h1", "_h2", "text_sha256").agg(F.sum("_n").alias("_n"), F.max("_best").alias("_best"), F.count(F.lit(1)).alias("_texts"))
    alone = F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share their 128-bit hash and their SHA-256")))
    # rows whose text is theirs alone stay and need no partner: the side that is joined holds copies only
    copies = groups.withColumn("_n", alone).where("_n > 1").drop("_texts")
    light = keyed.select("doc_id", "_h1", "_h2", "text_sha256", "_rank")
    # joined by one number of the keys, which the groups aren't dealt by yet: both sides are dealt for this join alone,
    # so that the adaptive planner may split the rows of a hot group over many tasks
    one = F.xxhash64("_h1", "_h2", "text_sha256")
    out = light.withColumn("_key", one).join(copies.withColumn("_key", one), ["_key", "_h1", "_h2", "text_sha256"], "left")
    # a row alone keeps itself: compared by rank, so the row that stays is the one whose rank is the best
    best = F.coalesce(F.col("_best"), F.col("_rank"))
    place_of = (best % F.lit(_UNIT).cast("decimal(21,0)")).cast("decimal(20,0)")
    keep = F.when(place_of > 0, (F.lit("9223372036854775808").cast("decimal(20,0)") - place_of).cast("long"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; of rows with the same id and text one stays."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    wrapped = docs.select(F.col(id_col).cast("long").alias("_key"), F.sha2(normalised(F.col(text_col)), 256).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = wrapped.join(kept, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")))
    # rows repeated with their id: the join has already brought them together
    first = Window.partitionBy("_id", "_sha").orderBy("_id")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY pts DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
