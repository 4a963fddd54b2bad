"""Agreement of two annotators (human and judge) on a 0 to 4 scale, and stability over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numbers import ratio

SCALE, POSITIVE, SEVERE = 5, 1, 2


def _signed(human: str, judge: str) -> Column:
    return F.col(judge) - F.col(human)


def agreement(pairs: DataFrame, human: str = "human", judge: str = "judge", by: list[str] | None = None) -> DataFrame:
    """Exact and within-one agreement, errors and the kinds of disagreement, in one aggregation.

    severe, over and under are differences of two or more; a false zero is a judge's 0 where the human saw something, a
    false positive the reverse.
    """
    d = _signed(human, judge)
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((d == 0).cast("double")).alias("exact"),
        F.avg((F.abs(d) <= 1).cast("double")).alias("within_one"),
        F.avg(F.abs(d).cast("double")).alias("mae"),
        F.avg(d.cast("double")).alias("bias"),
        F.count_if(F.abs(d) >= SEVERE).alias("severe"),
        F.count_if(d >= SEVERE).alias("over"),
        F.count_if(d <= -SEVERE).alias("under"),
        F.count_if((F.col(judge) == 0) & (F.col(human) > 0)).alias("false_zero"),
        F.count_if((F.col(human) == 0) & (F.col(judge) > 0)).alias("false_positive"),
    )


def binary_prf(pairs: DataFrame, human: str = "human", judge: str = "judge", threshold: int = POSITIVE, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of "relevant": at least the threshold, so any score but 0; 0 where undefined."""
    h, j = F.col(human) >= threshold, F.col(judge) >= threshold
    counts = pairs.groupBy(*(by or [])).agg(F.count_if(h & j).alias("tp"), F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn"), F.count_if(~h & ~j).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pairs: DataFrame, human: str = "human", judge: str = "judge") -> DataFrame:
    """A row for each human score and a column for each judge score of the scale, zero filled."""
    cells = [F.struct(F.lit(h).alias(human), *[F.count_if((F.col(human) == h) & (F.col(judge) == s)).alias(f"judge_{s}") for s in range(SCALE)]) for h in range(SCALE)]
    return pairs.agg(F.array(*cells).alias("_cells")).select(F.explode("_cells").alias("_row")).select("_row.*")


def weighted_kappa(pairs: DataFrame, human: str = "human", judge: str = "judge", by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa with linear and quadratic weights.

    Expected disagreement comes from the marginals, which are ten counts in the same aggregation as the observed one, so
    that the pairs are read once and shuffled as one row for each task. Without expected disagreement kappa is 1 if
    none is observed, else 0.
    """
    d = F.abs(_signed(human, judge)).cast("double")
    counts = pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("o1"), F.sum(d * d).alias("o2"),
        *[F.count_if(F.col(c) == s).alias(f"{k}{s}") for c, k in ((human, "h"), (judge, "j")) for s in range(SCALE)])
    out = counts
    for name, power, seen in (("linear", 1, "o1"), ("quadratic", 2, "o2")):
        expected = sum((F.col(f"h{a}") * F.col(f"j{b}") * float(abs(a - b) ** power) for a in range(SCALE) for b in range(SCALE) if a != b), F.lit(0.0)) / F.col("n")
        out = out.withColumn(f"kappa_{name}", F.when(expected == 0, F.when(F.col(seen) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col(seen) / expected))
    return out.select(*(by or []), "n", "kappa_linear", "kappa_quadratic")


def disagreements(pairs: DataFrame, key: str = "case_id", human: str = "human", judge: str = "judge", least: int = 1) -> DataFrame:
    d = _signed(human, judge)
    return pairs.select("*", d.alias("signed_difference"), F.abs(d).alias("absolute_difference")).where(F.col("absolute_difference") >= least).orderBy(F.desc("absolute_difference"), key)


def stability(runs: DataFrame, key: str = "case_id", run: str = "run", score: str = "score") -> DataFrame:
    """Per case over repeated runs: the sequence of scores, how many differ, and their span."""
    return runs.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(run), F.col(score)))), lambda x: x[score].cast("string")), ",").alias("sequence"),
        F.count_distinct(score).alias("n_scores"), (F.max(score) - F.min(score)).alias("span"))


def repeatability(first: DataFrame, second: DataFrame, keys: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """Largest score difference of two passes, and whether all ranks agree."""
    a = first.select(*keys, F.col(score).alias("s1"), F.col(rank).alias("r1"))
    b = second.select(*keys, F.col(score).alias("s2"), F.col(rank).alias("r2"))
    return a.join(b, keys, "full_outer").agg(F.max(F.abs(F.col("s1") - F.col("s2"))).alias("max_delta"), F.bool_and(F.col("r1").eqNullSafe(F.col("r2"))).alias("same_order"))


def expectation_check(results: DataFrame, expected: DataFrame, key: str = "case_id", score: str = "score") -> DataFrame:
    """Whether each expected case's score lies in its range; either end may be null, a missing case fails."""
    low, high = F.coalesce(F.col(score) >= F.col("judge_min"), F.col("judge_min").isNull()), F.coalesce(F.col(score) <= F.col("judge_max"), F.col("judge_max").isNull())
    joined = expected.join(results.select(key, score), key, "left")
    return joined.withColumn("passed", F.col(score).isNotNull() & low & high)
