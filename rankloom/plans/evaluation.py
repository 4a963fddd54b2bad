"""Queries: metrics, gates, bootstrap, contrasts, agreement and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import agreement as A
from rankloom.operators import diagnose as D
from rankloom.operators import metrics as M
from rankloom.operators import stats as S
from rankloom.plans import base as B
from rankloom.plans.catalogue import register


def _summary_sql(system: str, depth: int = 10, source: str | None = None) -> str:
    return f"""(SELECT query_id, count(*) AS n, avg(score) AS mean_score, median(score) AS median_score, avg((score >= 3)::INT) AS clear_rate, avg((score = 0)::INT) AS irrelevant_rate,
      max((rank <= 5 AND score >= 3)::INT) AS hit_at_5, max((rank = 1 AND score >= 3)::INT) AS top1_clear, min(rank) FILTER (score >= 3) AS first_clear_rank,
      coalesce(1.0 / min(rank) FILTER (score >= 3), 0) AS mrr, (avg(score) < 1.5)::INT AS catastrophic,
      count(*) FILTER (score = 0) AS score_0_count, count(*) FILTER (score = 4) AS score_4_count,
      CASE WHEN sum((2 ** score - 1) / log2(ideal + 1)) = 0 THEN 0 ELSE sum((2 ** score - 1) / log2(rank + 1)) / sum((2 ** score - 1) / log2(ideal + 1)) END AS ndcg
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS ideal FROM {source or B.graded_sql(system, depth)}) GROUP BY query_id)"""


def _summary(spark, sf, system="a", depth=10):
    return M.query_summary(B.graded(spark, sf, system, depth))


_SHOWN = ["query_id", "n", "mean_score", "median_score", "clear_rate", "irrelevant_rate", "hit_at_5", "top1_clear", "first_clear_rank", "mrr", "ndcg", "catastrophic", "score_0_count", "score_4_count"]


def _rounded(names, reals):
    return ", ".join(f"round({n}, 9)::DOUBLE AS {n}" if n in reals else n for n in names)


_REALS = {"mean_score", "median_score", "clear_rate", "irrelevant_rate", "mrr", "ndcg"}


@register("query_metrics", f"SELECT {_rounded(_SHOWN, _REALS)} FROM {_summary_sql('a')}")
def query_metrics(spark, sf):
    return B.rounded(_summary(spark, sf).select(*_SHOWN), *sorted(_REALS))


@register("ndcg", f"SELECT query_id, round(ndcg, 9)::DOUBLE AS ndcg FROM {_summary_sql('b')}")
def ndcg(spark, sf):
    return B.rounded(M.ndcg(B.graded(spark, sf, "b")), "ndcg")


_MACRO = "count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 9)::DOUBLE AS {m if m != 'catastrophic' else 'catastrophic_rate'}" for m in M.METRICS)
_MACRO_NAMES = [m if m != "catastrophic" else "catastrophic_rate" for m in M.METRICS]


@register("macro_metrics", f"SELECT {_MACRO} FROM {_summary_sql('a')}")
def macro_metrics(spark, sf):
    return B.rounded(M.macro(_summary(spark, sf)), *_MACRO_NAMES)


@register("stratum_metrics", f"SELECT p_brand AS stratum, {_MACRO} FROM {_summary_sql('a')} JOIN part ON p_partkey = query_id GROUP BY p_brand")
def stratum_metrics(spark, sf):
    return B.rounded(M.macro(_summary(spark, sf).join(B.strata(spark, sf), "query_id"), ["stratum"]), *_MACRO_NAMES)


#: The release contract as its text states it: metric, comparison, threshold.
_CONTRACT = """(VALUES ('mean_score', '>=', 2.5::DOUBLE), ('mean_score_lower', '>=', 2.0), ('clear_rate', '>=', 0.6), ('irrelevant_rate', '<=', 0.1),
  ('hit_at_5', '>=', 0.9), ('top1_clear', '>=', 0.75), ('ndcg', '>=', 0.85), ('catastrophic_rate', '==', 0.0)) AS contract(metric, op, threshold)"""


def _lower_sql(source: str) -> str:
    """The 2.5 % quantile of the resampled means of mean_score."""
    return f"""(WITH v AS (SELECT mean_score, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM {source}), n AS (SELECT count(*) AS n FROM v),
      k AS (SELECT rep, {S.draws_sql(S.SEED, 'rep', 'slot', 'n')} AS idx FROM n, (SELECT unnest(range(0, {S.REPLICATES})) AS rep), (SELECT unnest(range(0, (SELECT n FROM n))) AS slot))
      SELECT quantile_cont(m, 0.025) FROM (SELECT avg(mean_score) AS m FROM k JOIN v USING (idx) GROUP BY rep))"""


def _gates_sql(summary: str) -> str:
    return f"""(WITH s AS (SELECT * FROM {summary}),
      m AS (SELECT avg(mean_score) AS mean_score, {_lower_sql('s')} AS mean_score_lower, avg(clear_rate) AS clear_rate, avg(irrelevant_rate) AS irrelevant_rate, avg(hit_at_5) AS hit_at_5,
            avg(top1_clear) AS top1_clear, avg(ndcg) AS ndcg, avg(catastrophic) AS catastrophic_rate FROM s),
      l AS (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value)
      SELECT metric, op, threshold, value, CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value = threshold END AS passed FROM l JOIN {_CONTRACT} USING (metric))"""


def _release(summary):
    """The gates of a table of query metrics, the interval's lower end included."""
    lower = S.bootstrap_ci(summary, ["mean_score"]).select(F.col("lo").alias("mean_score_lower"))
    return M.release_gates(M.macro(summary).join(lower))  # one row each


def _gates(spark, sf, system):
    return _release(_summary(spark, sf, system))


@register("release_gates", f"SELECT metric, op, threshold, round(value, 9) AS value, passed FROM {_gates_sql(_summary_sql('a'))}")
def release_gates(spark, sf):
    return B.rounded(_gates(spark, sf, "a").select("metric", "op", "threshold", "value", "passed"), "value")


@register("release_decision", f"""
SELECT failed, CASE WHEN failed = 0 THEN 'PASS' WHEN failed <= 2 AND rate = 0 THEN 'REVIEW' ELSE 'FAIL' END AS decision
FROM (SELECT count(*) FILTER (NOT passed) AS failed, max(value) FILTER (metric = 'catastrophic_rate') AS rate FROM {_gates_sql(_summary_sql('a'))})""")
def release_decision(spark, sf):
    return M.decision(_gates(spark, sf, "a"))


@register("gate_transitions", f"""
SELECT metric, CASE WHEN a.passed THEN 'PASS' ELSE 'FAIL' END AS before, CASE WHEN b.passed THEN 'PASS' ELSE 'FAIL' END AS after,
       concat(CASE WHEN a.passed THEN 'PASS' ELSE 'FAIL' END, '->', CASE WHEN b.passed THEN 'PASS' ELSE 'FAIL' END) AS transition
FROM {_gates_sql(_summary_sql('a'))} a JOIN {_gates_sql(_summary_sql('b'))} b USING (metric)""")
def gate_transitions(spark, sf):
    return M.gate_transitions(_gates(spark, sf, "a"), _gates(spark, sf, "b"))


@register("score_distribution", f"""
SELECT v.score, count(g.score) AS n FROM (SELECT unnest(range(0, 5))::INT AS score) v LEFT JOIN {B.graded_sql('a')} g ON g.score = v.score GROUP BY v.score""")
def score_distribution(spark, sf):
    return M.distribution(B.graded(spark, sf), "score")


@register("worst_queries", f"SELECT query_id, round(mean_score, 9) AS mean_score FROM {_summary_sql('a')} ORDER BY mean_score, ndcg, query_id LIMIT 5")
def worst_queries(spark, sf):
    return B.rounded(M.worst_queries(_summary(spark, sf)).select("query_id", "mean_score"), "mean_score")


# ------------------------------------------------ statistics


_BOOT = ["mean_score", "clear_rate", "ndcg"]


def _bootstrap_sql(values: str, names=tuple(_BOOT)) -> str:
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, rep, {m} AS value FROM r" for m in names)
    actual = " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) AS mean FROM v" for m in names)
    return f"""
WITH v AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM {values}),
  n AS (SELECT count(*) AS n FROM v),
  k AS (SELECT rep, {S.draws_sql(S.SEED, 'rep', 'slot', 'n')} AS idx FROM n, (SELECT unnest(range(0, {S.REPLICATES})) AS rep), (SELECT unnest(range(0, (SELECT n FROM n))) AS slot)),
  r AS (SELECT rep, {', '.join(f'avg({m}) AS {m}' for m in names)} FROM k JOIN v USING (idx) GROUP BY rep),
  l AS ({long}), a AS ({actual})
SELECT metric, round(any_value(mean), 9)::DOUBLE AS mean, round(stddev_samp(value), 9) AS se, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi, round(avg(value), 9) AS boot_mean
FROM l JOIN a USING (metric) GROUP BY metric"""


_BOUNDS = ("mean", "se", "lo", "hi", "boot_mean")


@register("bootstrap_ci", _bootstrap_sql(_summary_sql("a")))
def bootstrap_ci(spark, sf):
    return B.rounded(S.bootstrap_ci(_summary(spark, sf, "a"), _BOOT), *_BOUNDS)


_DELTA_SQL = f"(SELECT query_id, {', '.join(f'b.{m} - a.{m} AS {m}' for m in _BOOT)} FROM {_summary_sql('a')} a JOIN {_summary_sql('b')} b USING (query_id))"


@register("paired_delta", _bootstrap_sql(_DELTA_SQL))
def paired_delta(spark, sf):
    return B.rounded(S.paired_bootstrap(_summary(spark, sf, "a"), _summary(spark, sf, "b"), _BOOT), *_BOUNDS)


_WTL = ["mean_score", "irrelevant_rate"]


def _long_delta_sql(names):
    return " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, b.{m} - a.{m} AS delta FROM {_summary_sql('a')} a JOIN {_summary_sql('b')} b USING (query_id)" for m in names)


@register("wins_ties_losses", f"""
SELECT metric, count(*) FILTER (d > 1e-15) AS wins, count(*) FILTER (abs(d) <= 1e-15) AS ties, count(*) FILTER (d < -1e-15) AS losses, round(avg(delta), 9)::DOUBLE AS mean_delta
FROM (SELECT *, CASE WHEN metric = 'irrelevant_rate' THEN -delta ELSE delta END AS d FROM ({_long_delta_sql(_WTL)})) GROUP BY metric""")
def wins_ties_losses(spark, sf):
    return B.rounded(S.wins_ties_losses(S.deltas(_summary(spark, sf, "a"), _summary(spark, sf, "b"), _WTL)), "mean_delta")


@register("metric_deltas", f"SELECT query_id, metric, round(delta, 9)::DOUBLE AS delta FROM ({_long_delta_sql(_BOOT)})")
def metric_deltas(spark, sf):
    return B.rounded(S.deltas(_summary(spark, sf, "a"), _summary(spark, sf, "b"), _BOOT).select("query_id", "metric", "delta"), "delta")


_SYSTEMS = {"B": ("a", 10), "K": ("b", 10), "R": ("a", 5), "RK": ("b", 5)}
_FACTORIAL = "(" + " UNION ALL ".join(f"SELECT query_id, '{n}' AS system, mean_score AS value FROM {_summary_sql(*x)}" for n, x in _SYSTEMS.items()) + ")"


def _factorial(spark, sf):
    out = None
    for name, (system, depth) in _SYSTEMS.items():
        part = _summary(spark, sf, system, depth).select("query_id", F.lit(name).alias("system"), F.col("mean_score").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@register("factorial_contrast", f"""
WITH w AS (SELECT query_id, max(value) FILTER (system = 'B') AS b, max(value) FILTER (system = 'K') AS k, max(value) FILTER (system = 'R') AS r, max(value) FILTER (system = 'RK') AS rk FROM {_FACTORIAL} GROUP BY query_id)
SELECT query_id, round(r - b, 9) + 0.0 AS r_b, round(rk - k, 9) + 0.0 AS rk_k, round(k - b, 9) + 0.0 AS k_b, round(rk - r, 9) + 0.0 AS rk_r, round(rk - k - r + b, 9) + 0.0 AS interaction FROM w""")
def factorial_contrast(spark, sf):
    pairs = {"r_b": ("R", "B"), "rk_k": ("RK", "K"), "k_b": ("K", "B"), "rk_r": ("RK", "R")}
    return B.rounded(S.contrasts(_factorial(spark, sf), pairs, interaction=("RK", "K", "R", "B")), *pairs, "interaction")


@register("interaction_ci", _bootstrap_sql(f"(SELECT query_id, max(value) FILTER (system = 'RK') - max(value) FILTER (system = 'K') - max(value) FILTER (system = 'R') + max(value) FILTER (system = 'B') AS interaction FROM {_FACTORIAL} GROUP BY query_id)", ("interaction",)))
def interaction_ci(spark, sf):
    return B.rounded(S.bootstrap_ci(S.contrasts(_factorial(spark, sf), {}, interaction=("RK", "K", "R", "B")), ["interaction"]), *_BOUNDS)


@register("select_candidate", f"""
SELECT system, round(mean_score, 9)::DOUBLE AS mean_score, round(catastrophic, 9)::DOUBLE AS catastrophic FROM (
  {' UNION ALL '.join(f"SELECT '{n}' AS system, avg(mean_score) AS mean_score, avg(catastrophic) AS catastrophic FROM {_summary_sql(*x)}" for n, x in _SYSTEMS.items())})
QUALIFY rank() OVER (ORDER BY mean_score DESC, catastrophic, system = 'B' DESC) = 1""")
def select_candidate(spark, sf):
    rows = None
    for name, (system, depth) in _SYSTEMS.items():
        part = M.macro(_summary(spark, sf, system, depth)).select(F.lit(name).alias("system"), "mean_score", F.col("catastrophic_rate").alias("catastrophic"))
        rows = part if rows is None else rows.unionByName(part)
    return B.rounded(S.select_candidate(rows, [("mean_score", "max"), ("catastrophic", "min")], "B"), "mean_score", "catastrophic")


@register("median_latency", "SELECT event_type AS system, round(quantile_cont(value, 0.5), 9) AS median_latency FROM events GROUP BY event_type")
def median_latency(spark, sf):
    return B.rounded(B.table(spark, sf, "events").groupBy(F.col("event_type").alias("system")).agg(F.percentile("value", 0.5).alias("median_latency")), "median_latency")


# ------------------------------------------------ agreement

_AGREE = """count(*) AS n, round(avg((judge = human)::INT), 9)::DOUBLE AS exact, round(avg((abs(judge - human) <= 1)::INT), 9)::DOUBLE AS within_one, round(avg(abs(judge - human)), 9)::DOUBLE AS mae,
  round(avg(judge - human), 9)::DOUBLE AS bias, count(*) FILTER (abs(judge - human) >= 2) AS severe, count(*) FILTER (judge - human >= 2) AS over, count(*) FILTER (judge - human <= -2) AS under,
  count(*) FILTER (judge = 0 AND human > 0) AS false_zero, count(*) FILTER (human = 0 AND judge > 0) AS false_positive"""


@register("agreement", f"SELECT {_AGREE} FROM {B.PAIRS_SQL}")
def agreement(spark, sf):
    return B.rounded(A.agreement(B.annotated(spark, sf)), "exact", "within_one", "mae", "bias")


@register("agreement_by_group", f"SELECT coalesce(grp, '<none>') AS grp, {_AGREE} FROM {B.PAIRS_SQL} GROUP BY 1")
def agreement_by_group(spark, sf):
    pairs = B.annotated(spark, sf).withColumn("grp", F.coalesce("grp", F.lit("<none>")))
    return B.rounded(A.agreement(pairs, by=["grp"]), "exact", "within_one", "mae", "bias")


@register("agreement_by_human", f"SELECT human, {_AGREE} FROM {B.PAIRS_SQL} GROUP BY human")
def agreement_by_human(spark, sf):
    return B.rounded(A.agreement(B.annotated(spark, sf), by=["human"]), "exact", "within_one", "mae", "bias")


@register("confusion", f"SELECT h.human, {', '.join(f'count(*) FILTER (judge = {s}) AS judge_{s}' for s in range(5))} FROM (SELECT unnest([0, 1, 2, 3, 4]) AS human) h LEFT JOIN {B.PAIRS_SQL} p USING (human) GROUP BY h.human")
def confusion(spark, sf):
    return A.confusion(B.annotated(spark, sf))


@register("kappa", f"""
WITH p AS (SELECT * FROM {B.PAIRS_SQL}), h AS (SELECT human, count(*) AS n FROM p GROUP BY human), j AS (SELECT judge, count(*) AS n FROM p GROUP BY judge), t AS (SELECT count(*) AS n, sum(abs(human - judge)) AS o1, sum((human - judge) ** 2) AS o2 FROM p),
  e AS (SELECT sum(abs(human - judge) * h.n * j.n) AS e1, sum((human - judge) ** 2 * h.n * j.n) AS e2 FROM h, j)
SELECT n, round(1 - o1 / (e1 / n), 9)::DOUBLE AS kappa_linear, round(1 - o2 / (e2 / n), 9)::DOUBLE AS kappa_quadratic FROM t, e""")
def kappa(spark, sf):
    return B.rounded(A.weighted_kappa(B.annotated(spark, sf)), "kappa_linear", "kappa_quadratic")


_PRF = """count(*) FILTER ({h} AND {j}) AS tp, count(*) FILTER (NOT {h} AND {j}) AS fp, count(*) FILTER ({h} AND NOT {j}) AS fn, count(*) FILTER (NOT {h} AND NOT {j}) AS tn"""


@register("binary_prf", f"""
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1
FROM (SELECT {_PRF.format(h='(human > 0)', j='(judge > 0)')} FROM {B.PAIRS_SQL})""")
def binary_prf(spark, sf):
    return B.rounded(A.binary_prf(B.annotated(spark, sf)), "precision", "recall", "f1")


@register("severe_disagreements", f"SELECT case_id, human, judge, judge - human AS signed_difference, abs(judge - human) AS absolute_difference FROM {B.PAIRS_SQL} WHERE abs(judge - human) >= 2")
def severe_disagreements(spark, sf):
    return A.disagreements(B.annotated(spark, sf), least=2).select("case_id", "human", "judge", "signed_difference", "absolute_difference")


_RUNS = "(SELECT o_custkey AS case_id, o_orderkey AS run, CAST(floor(o_totalprice) AS BIGINT) % 5 AS score FROM orders)"


@register("stability_span", f"""
SELECT case_id, string_agg(score::VARCHAR, ',' ORDER BY run, score) AS sequence, count(DISTINCT score) AS n_scores, max(score) - min(score) AS span FROM {_RUNS} GROUP BY case_id""")
def stability_span(spark, sf):
    runs = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run"), (F.floor("o_totalprice") % 5).alias("score"))
    return A.stability(runs)


@register("repeatability", f"""
WITH a AS {B.graded_sql('a')}, b AS {B.graded_sql('b')}
SELECT max(abs(a.score - b.score)) AS max_delta, bool_and(a.rank IS NOT DISTINCT FROM b.rank) AS same_order FROM a FULL JOIN b USING (query_id, item_id)""")
def repeatability(spark, sf):
    return A.repeatability(B.graded(spark, sf, "a"), B.graded(spark, sf, "b"), ["query_id", "item_id"])


@register("expectation_check", f"""
SELECT e.case_id, p.judge AS score, p.judge IS NOT NULL AND coalesce(p.judge >= judge_min, true) AND coalesce(p.judge <= judge_max, true) AS passed
FROM (SELECT o_orderkey * 10 + 1 AS case_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS judge_min, CASE WHEN o_orderkey % 3 < 2 THEN 3 END AS judge_max FROM orders) e LEFT JOIN {B.PAIRS_SQL} p USING (case_id)""")
def expectation_check(spark, sf):
    expected = B.table(spark, sf, "orders").select((F.col("o_orderkey") * 10 + 1).alias("case_id"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END").alias("judge_min"), F.expr("CASE WHEN o_orderkey % 3 < 2 THEN 3 END").alias("judge_max"))
    results = B.annotated(spark, sf).select("case_id", F.col("judge").alias("score"))
    return A.expectation_check(results, expected).select("case_id", "score", "passed")


# ------------------------------------------------ diagnostics

_DEEP = 50


_BUCKETS = ((1, 10), (11, 50), (1, 50))


@register("depth_profile", f"""
SELECT query_id, {', '.join(f'min(rank) FILTER (score >= {s}) AS first_{n}_rank' for s, n in ((3, 'clear'), (4, 'strong')))},
  {', '.join(f'max(score) FILTER (rank BETWEEN {a} AND {b}) AS best_{a}_{b}' for a, b in _BUCKETS)},
  {', '.join(f'count(*) FILTER (score >= {s} AND rank > 10) AS {n}_11_50' for s, n in ((3, 'clear'), (2, 'partial')))},
  {', '.join(f"coalesce(string_agg(rank::VARCHAR, ',' ORDER BY rank) FILTER (score >= {s} AND rank > 10), '') AS {n}_ranks" for s, n in ((3, 'clear'), (2, 'partial')))},
  {', '.join(f'count(*) FILTER (score >= {s} AND rank <= {d}) AS {n}_at_{d}' for d in (5, 10, 20, 50) for s, n in ((3, 'clear'), (2, 'partial')))},
  {', '.join(f'count(*) FILTER (score = {s} AND rank BETWEEN {a} AND {b}) AS ranks_{a}_{b}_score_{s}' for a, b in _BUCKETS for s in range(5))}
FROM {B.graded_sql('a', _DEEP)} GROUP BY query_id""")
def depth_profile(spark, sf):
    return D.depth_profile(B.graded(spark, sf, "a", _DEEP))


_ORACLE = f"(SELECT query_id, item_id, score, o AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, item_id) AS o FROM {B.graded_sql('a', _DEEP)}) WHERE o <= 10)"


def _oracle(spark, sf):
    return D.oracle_topk(B.graded(spark, sf, "a", _DEEP)).drop("rank").withColumnRenamed("oracle_rank", "rank")


@register("oracle_topk", f"SELECT query_id, item_id, score, rank AS oracle_rank FROM {_ORACLE}")
def oracle_topk(spark, sf):
    return D.oracle_topk(B.graded(spark, sf, "a", _DEEP)).select("query_id", "item_id", "score", "oracle_rank")


_CLASS = """CASE WHEN mean_score < 1.5 - 1e-9 OR clear_rate <= 1e-9 THEN 'RETRIEVAL_LIMITED' WHEN mean_score >= 2.5 - 1e-9 AND clear_rate >= 0.6 - 1e-9 AND irrelevant_rate <= 0.1 + 1e-9 THEN 'RERANKER_LIMITED' ELSE 'MIXED' END"""


@register("limitation_class", f"SELECT query_id, {_CLASS} AS limitation FROM {_summary_sql('a', 10, _ORACLE)}")
def limitation_class(spark, sf):
    return D.limitation_class(M.query_summary(_oracle(spark, sf))).select("query_id", "limitation")


_NO_CLEAR = f"(SELECT query_id FROM {B.graded_sql('a', _DEEP)} GROUP BY query_id HAVING count(*) FILTER (score >= 3 AND rank <= 3) = 0)"


def _stage_sql(low: int, high: int | None) -> str:
    """Stage A and B over the queries without a clear result in the first three ranks."""
    end, through = ("END", "FULL_UNION") if high is None else (high, high)
    return f"""(SELECT query_id, count(*) AS n_candidates, max(score) AS best_score, count(*) FILTER (score >= 3) AS n_clear, count(*) FILTER (score = 2) AS n_partial, count(*) FILTER (score = 1) AS n_incidental,
      count(*) FILTER (score = 0) AS n_irrelevant, min(rank) FILTER (score >= 3) AS first_clear_rank, '[' || coalesce(string_agg(rank::VARCHAR, ',' ORDER BY rank) FILTER (score >= 3), '') || ']' AS clear_ranks,
      CASE WHEN count(*) FILTER (score >= 3) > 0 THEN 'HEADROOM_FOUND_{low}_{end}' ELSE 'NO_CLEAR_THROUGH_{through}' END AS headroom
      FROM {B.graded_sql('a', _DEEP)} JOIN {_NO_CLEAR} USING (query_id) WHERE rank >= {low}{'' if high is None else f' AND rank <= {high}'} GROUP BY query_id)"""


def _stage(spark, sf, low, high):
    judged = B.graded(spark, sf, "a", _DEEP)
    return D.headroom(judged.join(D.unclear(judged, 3), "query_id"), low, high)


@register("headroom_class", f"SELECT * FROM {_stage_sql(4, 20)}")
def headroom_class(spark, sf):
    return _stage(spark, sf, 4, 20)


@register("headroom_stages", f"""
SELECT query_id, a.headroom AS stage_a, CASE WHEN a.n_clear > 0 THEN 'NOT_RUN_STAGE_A_ALREADY_RESOLVED' ELSE coalesce(b.headroom, 'NO_CLEAR_THROUGH_FULL_UNION') END AS stage_b,
  CASE WHEN a.n_clear > 0 THEN a.headroom ELSE coalesce(b.headroom, 'NO_CLEAR_THROUGH_FULL_UNION') END AS headroom
FROM {_stage_sql(4, 20)} a LEFT JOIN {_stage_sql(21, None)} b USING (query_id)""")
def headroom_stages(spark, sf):
    return D.combine_headroom(_stage(spark, sf, 4, 20), _stage(spark, sf, 21, None))


_GAINED = ["mean_score", "clear_rate", "irrelevant_rate", "hit_at_5", "top1_clear", "mrr", "ndcg", "catastrophic_rate"]


@register("oracle_gain", f"""
WITH s AS (SELECT * FROM {_summary_sql('a')}), o AS (SELECT * FROM {_summary_sql('a', 10, _ORACLE)}), g AS (SELECT * FROM {_gates_sql('o')}),
  d AS (SELECT {', '.join(f"(SELECT avg({m.replace('catastrophic_rate', 'catastrophic')}) FROM o) - (SELECT avg({m.replace('catastrophic_rate', 'catastrophic')}) FROM s) AS {m}_gain" for m in _GAINED)}),
  k AS (SELECT count(*) AS deep_rows, count(DISTINCT query_id) AS deep_queries FROM (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, item_id) AS o FROM {B.graded_sql('a', _DEEP)}) WHERE o <= 10 AND rank > 10)
SELECT CASE WHEN (SELECT bool_and(passed) FROM g) THEN 'RERANKER_SUPPORTED' WHEN {' OR '.join(f'abs({m}_gain) > 1e-15' for m in _GAINED)} OR deep_rows > 0 THEN 'MIXED' ELSE 'RETRIEVAL_LIMITED' END AS support,
  (SELECT count(*) FROM g WHERE passed) AS gates_met, deep_rows, deep_queries, {', '.join(f'round({m}_gain, 9) + 0.0 AS {m}_gain' for m in _GAINED)}
FROM d, k""")
def oracle_gain(spark, sf):
    pool = D.oracle_topk(B.graded(spark, sf, "a", _DEEP))
    oracle = M.query_summary(pool.drop("rank").withColumnRenamed("oracle_rank", "rank"))
    found = D.oracle_support(M.macro(_summary(spark, sf)), M.macro(oracle), _release(oracle), pool.where("rank > 10"))
    return B.rounded(found, *[f"{m}_gain" for m in _GAINED])


@register("sensitivity", f"""
WITH g AS (SELECT * FROM {B.graded_sql('a', 5)}), u AS (SELECT query_id, min(item_id) AS item_id FROM g GROUP BY query_id),
  c AS (SELECT g.query_id, v.scenario, avg(CASE WHEN g.item_id = u.item_id THEN v.scenario ELSE score END) AS mean_score,
        avg(((CASE WHEN g.item_id = u.item_id THEN v.scenario ELSE score END) >= 3)::INT) AS clear_rate, avg(((CASE WHEN g.item_id = u.item_id THEN v.scenario ELSE score END) = 0)::INT) AS irrelevant_rate
        FROM g JOIN u USING (query_id), (SELECT unnest(range(0, 5))::INT AS scenario) v GROUP BY g.query_id, v.scenario)
SELECT query_id, string_agg(DISTINCT {_CLASS}, ',' ORDER BY {_CLASS}) AS classes, count(DISTINCT {_CLASS}) = 1 AS invariant FROM c GROUP BY query_id""")
def sensitivity(spark, sf):
    judged = B.graded(spark, sf, "a", 5)
    unresolved = judged.groupBy("query_id").agg(F.min("item_id").alias("item_id"))

    def classify(cells):
        per = cells.groupBy("query_id", "scenario").agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 3).cast("double")).alias("clear_rate"), F.avg((F.col("score") == 0).cast("double")).alias("irrelevant_rate"))
        return D.limitation_class(per)

    return D.invariance(D.sensitivity(judged, unresolved, classify))


@register("class_transitions", f"""
SELECT concat(a.l, '->', b.l) AS transition, count(*) AS n FROM (SELECT query_id, {_CLASS} AS l FROM {_summary_sql('a')}) a JOIN (SELECT query_id, {_CLASS} AS l FROM {_summary_sql('b')}) b USING (query_id) GROUP BY 1""")
def class_transitions(spark, sf):
    return D.transitions(D.limitation_class(_summary(spark, sf, "a")), D.limitation_class(_summary(spark, sf, "b")))


_KINDS = ["RETRIEVAL_LIMITED", "RERANKER_LIMITED", "MIXED"]


@register("stratum_cross_tab", f"""
SELECT p_brand AS stratum, {', '.join(f"count(*) FILTER (l = '{k}') AS {k}" for k in _KINDS)} FROM (SELECT query_id, {_CLASS} AS l FROM {_summary_sql('a')}) JOIN part ON p_partkey = query_id GROUP BY p_brand""")
def stratum_cross_tab(spark, sf):
    return D.cross_tab(D.limitation_class(_summary(spark, sf)).join(B.strata(spark, sf), "query_id"), "stratum", "limitation", _KINDS)


@register("membership_change", f"""
WITH a AS {B.graded_sql('a')}, b AS {B.graded_sql('b')}
SELECT CASE WHEN a.score IS NULL THEN 'second_only' WHEN b.score IS NULL THEN 'first_only' ELSE 'shared' END AS source, count(*) AS n, round(avg(coalesce(b.score, a.score)), 9)::DOUBLE AS mean_score
FROM a FULL JOIN b USING (query_id, item_id) GROUP BY 1""")
def membership_change(spark, sf):
    return B.rounded(D.membership_change(B.graded(spark, sf, "a"), B.graded(spark, sf, "b")), "mean_score")
