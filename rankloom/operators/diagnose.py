"""Where relevance is lost: depth profiles, oracle lists, headroom and limitation classes, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.metrics import METRICS

CLEAR, EPS = 3, 1e-9


def _ranks(least: int, low: int, high: int) -> Column:
    """The ranks from ``low`` to ``high`` with at least a score, as text."""
    return F.array_join(F.sort_array(F.collect_list(F.when((F.col("score") >= least) & F.col("rank").between(low, high), F.col("rank")))), ",")


def depth_profile(judged: DataFrame, depths: tuple[int, ...] = (5, 10, 20, 50), shallow: int = 10, deep: int = 50) -> DataFrame:
    """Per query: first clear and strong ranks, the best scores and the counts of each score down to ``shallow``, below it and
    over all, clear and partial counts down to each depth, and the clear and partial ranks below ``shallow``."""
    score, rank = F.col("score"), F.col("rank")
    buckets = ((1, shallow), (shallow + 1, deep), (1, deep))
    first = [F.min(F.when(score >= s, rank)).alias(f"first_{n}_rank") for s, n in ((CLEAR, "clear"), (4, "strong"))]
    best = [F.max(F.when(rank.between(a, b), score)).alias(f"best_{a}_{b}") for a, b in buckets]
    below = [F.count_if((score >= s) & rank.between(shallow + 1, deep)).alias(f"{n}_{shallow + 1}_{deep}") for s, n in ((3, "clear"), (2, "partial"))]
    listed = [_ranks(s, shallow + 1, deep).alias(f"{n}_ranks") for s, n in ((3, "clear"), (2, "partial"))]
    count = [F.count_if((score >= s) & (rank <= d)).alias(f"{n}_at_{d}") for d in depths for s, n in ((3, "clear"), (2, "partial"))]
    cells = [F.count_if((score == s) & rank.between(a, b)).alias(f"ranks_{a}_{b}_score_{s}") for a, b in buckets for s in range(5)]
    return judged.groupBy("query_id").agg(*first, *best, *below, *listed, *count, *cells)


def oracle_topk(judged: DataFrame, k: int = 10) -> DataFrame:
    """The k best-scored rows of each query, as a reranker without error would show them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"), F.asc("item_id"))
    return judged.withColumn("oracle_rank", F.row_number().over(w)).where(F.col("oracle_rank") <= k)


def limitation_class(oracle_summary: DataFrame) -> DataFrame:
    """RETRIEVAL_LIMITED if even the oracle list is poor, RERANKER_LIMITED if it is good, else MIXED."""
    poor = (F.col("mean_score") < 1.5 - EPS) | (F.col("clear_rate") <= EPS)
    good = (F.col("mean_score") >= 2.5 - EPS) & (F.col("clear_rate") >= 0.6 - EPS) & (F.col("irrelevant_rate") <= 0.1 + EPS)
    return oracle_summary.withColumn("limitation", F.when(poor, "RETRIEVAL_LIMITED").when(good, "RERANKER_LIMITED").otherwise("MIXED"))


def unclear(judged: DataFrame, shallow: int = 10) -> DataFrame:
    """The queries whose first ``shallow`` results hold no clear one."""
    return judged.groupBy("query_id").agg(F.count_if((F.col("score") >= CLEAR) & (F.col("rank") <= shallow)).alias("_n")).where("_n = 0").select("query_id")


def headroom(judged: DataFrame, low: int = 11, high: int | None = 50) -> DataFrame:
    """Per query: what the results from rank ``low`` to ``high`` (None: the last one) hold, and whether one is clear."""
    score, last = F.col("score"), ("END", "FULL_UNION") if high is None else (str(high), str(high))
    rows = judged.where((F.col("rank") >= low) & (F.col("rank") <= high if high is not None else F.lit(True)))
    out = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("score").alias("best_score"), F.count_if(score >= CLEAR).alias("n_clear"), F.count_if(score == 2).alias("n_partial"), F.count_if(score == 1).alias("n_incidental"),
        F.count_if(score == 0).alias("n_irrelevant"), F.min(F.when(score >= CLEAR, F.col("rank"))).alias("first_clear_rank"),
        F.to_json(F.sort_array(F.collect_list(F.when(score >= CLEAR, F.col("rank"))))).alias("clear_ranks"))
    return out.withColumn("headroom", F.when(F.col("n_clear") > 0, f"HEADROOM_FOUND_{low}_{last[0]}").otherwise(f"NO_CLEAR_THROUGH_{last[1]}"))


def combine_headroom(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two stages as one, for the queries of the first: query_id, stage_a, stage_b, headroom.

    The first stage's class stands where it found a clear result and the second stage isn't asked; else the second's does,
    which is without a clear result where nothing lies that deep.
    """
    joined = first.select("query_id", F.col("headroom").alias("stage_a"), F.col("n_clear").alias("_n")).join(second.select("query_id", F.col("headroom").alias("_b")), "query_id", "left")
    later = F.when(F.col("_n") > 0, "NOT_RUN_STAGE_A_ALREADY_RESOLVED").otherwise(F.coalesce("_b", F.lit("NO_CLEAR_THROUGH_FULL_UNION")))
    return joined.withColumn("stage_b", later).select("query_id", "stage_a", "stage_b", F.when(F.col("_n") > 0, F.col("stage_a")).otherwise(F.col("stage_b")).alias("headroom"))


def oracle_support(actual: DataFrame, oracle: DataFrame, gates: DataFrame, deep_rows: DataFrame) -> DataFrame:
    """What a perfect reranking of the retrieved pool could reach: one row.

    ``actual`` and ``oracle`` are the macro metrics of the two lists, ``gates`` the oracle's release gates, ``deep_rows`` the oracle's
    rows from below the shown list. All gates met: RERANKER_SUPPORTED; any metric changed or any deep row: MIXED; else
    RETRIEVAL_LIMITED.
    """
    names = [m if m != "catastrophic" else "catastrophic_rate" for m in METRICS]
    both = actual.select(*[F.col(m).alias(f"_{m}") for m in names]).join(oracle.select(*names))  # one row each
    met = gates.agg(F.bool_and("passed").alias("all_met"), F.count_if(F.col("passed")).alias("gates_met"))
    deep = deep_rows.agg(F.count(F.lit(1)).alias("deep_rows"), F.count_distinct("query_id").alias("deep_queries"))
    row = both.join(met).join(deep).withColumns({f"{m}_gain": F.col(m) - F.col(f"_{m}") for m in names})
    changed = (F.greatest(*[F.abs(F.col(f"{m}_gain")) for m in names]) > 1e-15) | (F.col("deep_rows") > 0)
    kind = F.when(F.col("all_met"), "RERANKER_SUPPORTED").when(changed, "MIXED").otherwise("RETRIEVAL_LIMITED")
    return row.select(kind.alias("support"), "gates_met", "deep_rows", "deep_queries", *[f"{m}_gain" for m in names])


def sensitivity(judged: DataFrame, unresolved: DataFrame, classify, values: range = range(5)) -> DataFrame:
    """Classes of the affected queries when their unresolved cells take each value of the scale.

    ``unresolved`` has (query_id, item_id); only queries with such a cell are repeated, once for each value.
    ``classify`` maps a judged table (whose query_id carries the scenario) to (query_id, class).
    """
    spark = judged.sparkSession
    affected = judged.join(unresolved.select("query_id").distinct(), "query_id", "left_semi")
    marked = affected.join(unresolved.withColumn("_open", F.lit(True)), ["query_id", "item_id"], "left")
    scenarios = F.broadcast(spark.createDataFrame([(v,) for v in values], "scenario int"))
    cells = marked.join(scenarios).withColumn("score", F.when(F.col("_open"), F.col("scenario")).otherwise(F.col("score"))).drop("_open")
    return classify(cells)


def invariance(classes: DataFrame, kind: str = "limitation") -> DataFrame:
    """Whether a query's class is the same in all scenarios."""
    return classes.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("classes"), (F.count_distinct(kind) == 1).alias("invariant"))


def transitions(before: DataFrame, after: DataFrame, key: str = "query_id", kind: str = "limitation") -> DataFrame:
    joined = before.select(key, F.col(kind).alias("_a")).join(after.select(key, F.col(kind).alias("_b")), key)
    return joined.groupBy(F.concat_ws("->", "_a", "_b").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def cross_tab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts by two columns with fixed values of the second, zero filled."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in values])


def membership_change(a: DataFrame, b: DataFrame, key: tuple[str, ...] = ("query_id", "item_id"), score: str = "score") -> DataFrame:
    """Rows and mean scores of what both lists, only the first or only the second hold."""
    x, y = a.select(*key, F.col(score).alias("_a")), b.select(*key, F.col(score).alias("_b"))
    source = F.when(F.col("_a").isNull(), "second_only").when(F.col("_b").isNull(), "first_only").otherwise("shared")
    return x.join(y, list(key), "full_outer").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_b", "_a").cast("double")).alias("mean_score"))
