"""Bootstrap intervals over queries, paired comparisons, factorial contrasts and candidate selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ordering import hash_buckets, running_total

SEED, REPLICATES = 20261002, 5000


#: Most numbers (queries x metrics) that are sent to every task; more are joined by a shuffle.
BROADCAST_VALUES = 20_000_000
#: Fixed values of the draws: two odd multipliers.
_STEP, _MIX = 0x1E3779B97F4A7C15, 0x3F58476D1CE4E5B9
_WRAP = (1 << 64) - 1


def draws(seed: int, replicate: int, n: int) -> np.ndarray:
    """The n places, from 0 to n - 1, that a replicate draws: hashes of its number and of 0 to n - 1."""
    z = np.arange(n, dtype=np.uint64) + np.uint64(((seed << 24) + replicate << 32) & _WRAP >> 1)
    z *= np.uint64(_STEP)
    z ^= z >> np.uint64(32)
    z *= np.uint64(_MIX)
    z ^= z >> np.uint64(29)
    return ((z >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def draws_sql(seed: int, replicate: str, slot: str, n: str) -> str:
    """``draws`` as DuckDB SQL over columns of these names."""
    key = f"({slot}::HUGEINT + (({seed << 24}::HUGEINT + {replicate}) * 4294967296) % 9223372036854775808)"
    first = f"(({key} * {_STEP}::HUGEINT) % 18446744073709551616)::UBIGINT"
    second = f"((xor({first}, {first} >> 32)::HUGEINT * {_MIX}::HUGEINT) % 18446744073709551616)::UBIGINT"
    return f"((xor({second}, {second} >> 29) >> 11) % {n})::BIGINT"


def bootstrap_ci(values: DataFrame, metrics: list[str], key: str = "query_id", replicates: int = REPLICATES, seed: int = SEED, indices: str = "hash") -> DataFrame:
    """Percentile intervals of the mean of each metric when queries are drawn with replacement.

    All metrics share the draws, which each task makes for its replicates. ``indices="hash"`` draws by a hash that other
    engines can repeat; ``indices="numpy"`` takes the matrix of NumPy's default generator, made in order on the driver (for
    evaluation sets). The values are a row for each query: up to ``BROADCAST_VALUES`` numbers go to every task, beyond
    that they stay where they are and the draws are shuffled to them.

    Returns metric, mean, se (sample deviation of the replicates' means), lo, hi and boot_mean (the mean of those means).
    """
    spark = values.sparkSession
    rows = values.select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    shape = ", ".join(f"{m} double" for m in metrics)
    n, table = rows.count(), None
    if n * len(metrics) > BROADCAST_VALUES:
        if indices == "numpy":
            raise ValueError(f"{n} queries are too many for a matrix of draws on the driver")
        means = _shuffled_means(rows, metrics, key, n, replicates, seed)
    else:
        held = rows.toArrow().sort_by(key)
        table = np.stack([held.column(m).to_numpy() for m in metrics], axis=1) if n else np.zeros((0, len(metrics)))
        if not n:
            means = spark.createDataFrame([], shape)
        elif indices == "numpy":
            matrix = np.random.default_rng(seed).integers(0, n, size=(replicates, n))
            means = spark.createDataFrame([tuple(map(float, table[own].mean(axis=0))) for own in matrix], shape)
        else:
            sent = spark.sparkContext.broadcast(table)

            def resample(batches):
                for batch in batches:
                    own = np.stack([sent.value[draws(seed, r, n)].mean(axis=0) for r in batch.column("id").to_pylist()]) if len(batch) else np.zeros((0, len(metrics)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, i]) for i in range(len(metrics))], metrics)

            means = spark.range(0, replicates, 1, min(replicates, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(resample, shape)
    long = means.unpivot([], metrics, "metric", "value")
    # the draws' values are all at hand where they were sent to the tasks
    if table is None:
        actual = rows.agg(*[F.avg(m).alias(m) for m in metrics]).unpivot([], [F.col(m) for m in metrics], "metric", "mean")
    else:
        actual = spark.createDataFrame([(m, float(x)) for m, x in zip(metrics, table.mean(axis=0) if n else [], strict=False)], "metric string, mean double")
    ci = long.groupBy("metric").agg(F.stddev_samp("value").alias("se"), F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.avg("value").alias("boot_mean"))
    return actual.join(ci, "metric")


def _shuffled_means(rows: DataFrame, metrics: list[str], key: str, n: int, replicates: int, seed: int) -> DataFrame:
    """The means of all replicates for more queries than a task can hold: draws are counted by place, then meet their values."""
    spark = rows.sparkSession
    hashed = rows.withColumn("_hash", F.sha2(F.col(key).cast("string"), 256))
    numbered = running_total(hashed, hash_buckets(F.col("_hash")), [F.col("_hash"), F.col(key)], F.lit(1), "_place").withColumn("idx", F.col("_place") - 1)

    def places(batches):
        for batch in batches:
            for r in batch.column("id").to_pylist():
                own, count = np.unique(draws(seed, r, n), return_counts=True)
                for i in range(0, len(own), 1 << 20):
                    part = own[i : i + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), r)), pa.array(part), pa.array(count[i : i + (1 << 20)])], ["rep", "idx", "times"])

    taken = spark.range(0, replicates, 1, replicates).mapInArrow(places, "rep long, idx long, times long")
    return taken.join(numbered, "idx").groupBy("rep").agg(*[(F.sum(F.col(m) * F.col("times")) / n).alias(m) for m in metrics]).drop("rep")


def deltas(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "query_id") -> DataFrame:
    """(query, metric, a, b, delta = b - a) for queries in both."""
    left = a.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "a")
    right = b.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "b")
    return left.join(right, [key, "metric"]).withColumn("delta", F.col("b") - F.col("a"))


def paired_bootstrap(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "query_id", **options) -> DataFrame:
    """``bootstrap_ci`` of the differences b - a, one draw for all metrics."""
    wide = a.select(key, *[F.col(m).cast("double").alias(f"a_{m}") for m in metrics]).join(b.select(key, *[F.col(m).cast("double").alias(f"b_{m}") for m in metrics]), key)
    return bootstrap_ci(wide.select(key, *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in metrics]), metrics, key, **options)


def wins_ties_losses(delta: DataFrame, lower_is_better: tuple[str, ...] = ("irrelevant_rate", "catastrophic"), eps: float = 1e-15) -> DataFrame:
    better = F.when(F.col("metric").isin(*lower_is_better), -F.col("delta")).otherwise(F.col("delta"))
    return delta.groupBy("metric").agg(F.count_if(better > eps).alias("wins"), F.count_if(F.abs(better) <= eps).alias("ties"), F.count_if(better < -eps).alias("losses"), F.avg("delta").alias("mean_delta"))


def contrasts(long: DataFrame, pairs: dict[str, tuple[str, str]], key: str = "query_id", interaction: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Differences between systems from (key, system, value): one column for each named pair and the interaction w-x-y+z."""
    systems = sorted({s for p in pairs.values() for s in p} | set(interaction or ()))
    wide = long.groupBy(key).pivot("system", systems).agg(F.first("value"))
    out = wide.select(key, *[(F.col(x) - F.col(y)).alias(n) for n, (x, y) in pairs.items()], *([] if interaction is None else [
        (F.col(interaction[0]) - F.col(interaction[1]) - F.col(interaction[2]) + F.col(interaction[3])).alias("interaction")]))
    return out


def select_candidate(candidates: DataFrame, order: list[tuple[str, str]], baseline: str, name: str = "system") -> DataFrame:
    """The best candidate by metrics in order; exact ties go to the baseline, then to fewer changes, then to lower latency.

    ``order`` has (metric, "max" or "min"); the table may have n_changes and latency. Metrics are compared as they are.
    A tie that is still open leaves no row: nothing is selected.
    """
    by = [F.desc(m) if d == "max" else F.asc(m) for m, d in order]
    by += [F.desc(F.col(name) == baseline)]
    by += [F.asc(c) for c in ("n_changes", "latency") if c in candidates.columns]
    best = candidates.withColumn("_place", F.rank().over(Window.orderBy(*by))).where("_place = 1").drop("_place")  # a row for each system
    return best.withColumn("_tied", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("_tied = 1").drop("_tied")
