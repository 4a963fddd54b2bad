"""Graded relevance metrics of ranked lists, their aggregates, release gates and decisions.

A judged list has query_id, rank (1-based) and score (0 to 4).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.contracts import require, require_contiguous_ranks, require_group_sizes

CLEAR, CATASTROPHIC_MEAN = 3, 1.5
#: The release gates (metric, comparison, threshold); mean_score_lower is the lower end of the mean's 95 % interval.
GATES = (
    ("mean_score", ">=", 2.5),
    ("mean_score_lower", ">=", 2.0),
    ("clear_rate", ">=", 0.6),
    ("irrelevant_rate", "<=", 0.1),
    ("hit_at_5", ">=", 0.9),
    ("top1_clear", ">=", 0.75),
    ("ndcg", ">=", 0.85),
    ("catastrophic_rate", "==", 0.0),
)
METRICS = ("mean_score", "clear_rate", "irrelevant_rate", "hit_at_5", "top1_clear", "mrr", "ndcg", "catastrophic")


def ndcg(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """nDCG of each list against the same list in its best order; 0 where nothing is relevant."""
    group = group or ["query_id"]
    ideal = judged.withColumn("ideal_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("rank"))))
    gain = F.pow(F.lit(2.0), F.col("score")) - 1
    sums = ideal.groupBy(*group).agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("ideal_rank") + 1)).alias("idcg"))
    return sums.select(*group, F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def query_summary(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row of metrics for each list, from one window and one aggregation."""
    group = group or ["query_id"]
    window = Window.partitionBy(*group)
    gain = F.pow(F.lit(2.0), F.col("score")) - 1
    both = judged.withColumn("ideal_rank", F.row_number().over(window.orderBy(F.desc("score"), F.asc("rank"))))
    first = F.min(F.when(F.col("score") >= CLEAR, F.col("rank")))
    out = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("mean_score"),
        F.median("score").alias("median_score"),
        F.avg((F.col("score") >= CLEAR).cast("double")).alias("clear_rate"),
        F.avg((F.col("score") == 0).cast("double")).alias("irrelevant_rate"),
        F.max(F.when((F.col("rank") <= 5) & (F.col("score") >= CLEAR), 1).otherwise(0)).alias("hit_at_5"),
        F.max(F.when((F.col("rank") == 1) & (F.col("score") >= CLEAR), 1).otherwise(0)).alias("top1_clear"),
        first.alias("first_clear_rank"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(gain / F.log2(F.col("ideal_rank") + 1)).alias("idcg"),
        (F.avg("score") < CATASTROPHIC_MEAN).cast("int").alias("catastrophic"),
        *[F.count_if(F.col("score") == s).alias(f"score_{s}_count") for s in range(5)],
    )
    return out.withColumn("ndcg", F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg"))).drop("dcg", "idcg")


def macro(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries, for each value of ``by``."""
    return summary.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(m).alias(m if m != "catastrophic" else "catastrophic_rate") for m in METRICS])


def long_metrics(macro_row: DataFrame, keys: list[str] | None = None, gates: tuple = GATES) -> DataFrame:
    """(keys, metric, value) from a table with a column for each metric."""
    names = [g[0] for g in gates]
    return macro_row.unpivot(keys or [], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def compare(actual: Column, op: Column, expected: Column) -> Column:
    """A comparison whose operator is data; an unknown one is an error."""
    return F.when(op == ">=", actual >= expected).when(op == "<=", actual <= expected).when(op == "==", actual == expected).otherwise(F.raise_error(F.concat(F.lit("unknown comparison "), op)))


def release_gates(macro_row: DataFrame, keys: list[str] | None = None, gates: tuple = GATES) -> DataFrame:
    """Each gate's threshold, actual value and whether it passes; values are compared as they are, a null one fails."""
    table = F.broadcast(macro_row.sparkSession.createDataFrame([tuple(g) for g in gates], "metric string, op string, threshold double"))
    joined = long_metrics(macro_row, keys, gates).join(table, "metric")
    return joined.withColumn("passed", F.coalesce(compare(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)))


def decision(gates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """PASS if no gate fails, REVIEW if at most two fail and no query is a catastrophe, else FAIL.

    The rate itself decides, whatever a caller's own gates ask of it; without the rate there is no REVIEW.
    """
    failed = F.count_if(~F.col("passed"))
    rate = F.max(F.when(F.col("metric") == "catastrophic_rate", F.col("value")))
    out = gates.groupBy(*(keys or [])).agg(failed.alias("failed"), rate.alias("_rate"))
    review = (F.col("failed") <= 2) & F.coalesce(F.col("_rate") == 0, F.lit(False))
    return out.withColumn("decision", F.when(F.col("failed") == 0, "PASS").when(review, "REVIEW").otherwise("FAIL")).drop("_rate")


def require_lists(judged: DataFrame, depth: int = 10, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The judged lists if each has the ranks 1 to ``depth`` once and scores from 0 to 4; else an error."""
    require(judged, score_on_the_scale=F.col("score").between(0, 4))
    return require_contiguous_ranks(require_group_sizes(judged, group, depth), group, "rank")


def gate_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    word = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    x, y = before.select("metric", word.alias("before")), after.select("metric", word.alias("after"))
    return x.join(y, "metric").withColumn("transition", F.concat_ws("->", "before", "after"))


def distribution(df: DataFrame, score: str, by: list[str] | None = None, values: range = range(5)) -> DataFrame:
    """How often each value of the scale occurs, 0 included: score, n."""
    counts = df.groupBy(*(by or [])).agg(*[F.count_if(F.col(score) == v).alias(str(v)) for v in values])
    return counts.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(v).alias("score"), F.col(str(v)).alias("n")) for v in values])).alias("x")).select(*(by or []), "x.*")


def worst_queries(summary: DataFrame, k: int = 5) -> DataFrame:
    return summary.orderBy("mean_score", "ndcg", "query_id").limit(k)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
