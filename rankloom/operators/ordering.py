"""Places in a global order without one task that sees all rows: rows are dealt to buckets that follow the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a global order: the only rows that one task sees together, and far fewer than any table's.
BUCKETS = 256


def value_buckets(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> dict[str, Column]:
    """For each numeric column a bucket of each value, ascending with it, from one pass; values that tie share one.

    The columns are read by name, so they also serve a table that has the same values under the same name.
    """
    marks = df.agg(*[F.approx_percentile(F.col(c).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets).alias(c) for c in columns]).first()
    return {c: _search(F.col(c).cast("double"), sorted({float(x) for x in marks[c] or []})) for c in columns}


def _search(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts lie under the value, by halving."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(value > cuts[middle], F.lit(middle + 1) + _search(value, cuts[middle + 1 :])).otherwise(_search(value, cuts[:middle]))


def hash_buckets(hashed: Column) -> Column:
    """A bucket for each hexadecimal hash, ascending with it."""
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")


def running_total(df: DataFrame, bucket: Column, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of ``weight`` over all rows up to each one, in the order that ``bucket`` follows."""
    rows = df.withColumns({"_bucket": bucket, "_weight": weight})
    sums = rows.groupBy("_bucket").agg(F.sum("_weight").alias("_sum"))
    before = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_before"))  # a row for each bucket
    own = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, "_bucket").withColumn(name, F.col("_before") + F.sum("_weight").over(own)).drop("_bucket", "_weight", "_before")
