"""Hand-calculated cases of single operators."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.functions import text as X
from rankloom.operators import agreement, contracts, diagnose, etl, judge, metrics, ordering, pools, retrieval, reuse, stats, verdict


def one(df):
    return df.first()[0]


def rows(df):
    return [tuple(r) for r in df.collect()]


def values(spark, text):
    return spark.createDataFrame([(text,)], "t string")


# ------------------------------------------------ text


def test_tokens(spark):
    df = values(spark, "A Doctor’s Decision-Making, NOT politics.")
    wanted = ["doctors", "decision", "making", "not", "politics"]
    assert one(df.select(X.tokens(F.col("t")))) == wanted
    assert one(df.select(X.folded_tokens(F.col("t")))) == wanted
    assert one(values(spark, "a_b ab x ﬁx Straße").select(X.folded_tokens(F.col("t")))) == ["ab", "fix", "strasse"]
    assert one(values(spark, None).select(X.tokens(F.col("t")))) == []


def test_words_and_captions(spark):
    assert one(values(spark, " a  b\n").select(X.word_count(F.col("t")))) == 2
    assert one(values(spark, "").select(X.word_count(F.col("t")))) == 0
    assert one(values(spark, "a b c").select(X.first_words(F.col("t"), 2))) == "a b..."
    assert [one(values(spark, t).select(X.people_line(F.col("t")))) for t in ("a", "a;b", "a;b;c")] == ["a", "a and b", "a, b and c"]
    assert one(values(spark, '"978 text"').select(X.leading_id(F.col("t")))) == 978


def test_spans(spark):
    found = one(values(spark, " One. Two!  Three? ").select(X.spans(F.col("t"))))
    assert [tuple(s) for s in found] == [("S1", "One."), ("S2", "Two!"), ("S3", "Three?")]
    assert one(values(spark, "One. Two").select(X.render_spans(X.spans(F.col("t"))))) == "S1: One.\nS2: Two"
    assert one(values(spark, "a.b.").select(X.sentence_parts(F.col("t")))) == ["a", "b", ""]


def test_identifiers(spark):
    assert one(values(spark, "'123.0'").select(X.canonical_id(F.col("t")))) == "123"
    with pytest.raises(PySparkException):
        values(spark, " ").select(X.canonical_id(F.col("t"))).collect()
    with pytest.raises(PySparkException):
        values(spark, "12").select(X.canonical_id(F.col("t"), 13)).collect()
    assert one(values(spark, "NaN").select(X.optional_author(F.col("t")))) == ""
    assert [one(values(spark, t).select(X.natural_number(F.col("t")))) for t in ("Q12x", "Q1_T02", "none")] == [12, 102, 10**9]


def test_search_text(spark):
    df = spark.createDataFrame([("Book", "Desc"), ("Book", None)], "a string, b string")
    assert [r[0] for r in df.select(X.labelled_text(F.col("a"), F.col("b"))).collect()] == ["Title: Book\nDescription: Desc", "Title: Book"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("", None)], "a string, b string").select(X.search_text(F.col("a"), F.col("b"))).collect()


def test_numbers(spark):
    df = spark.createDataFrame([("Yes", "7"), ("", "x")], "b string, n string")
    assert rows(df.select(N.parse_bool(F.col("b")), N.int_or_zero(F.col("n")))) == [(True, 7), (False, 0)]
    with pytest.raises(PySparkException):
        values(spark, "maybe").select(N.parse_bool(F.col("t"))).collect()
    v = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert tuple(v.select(N.dot(F.col("v"), F.col("v")), N.norm(F.col("v")), N.is_unit(F.col("v"), 2)).first()) == (25.0, 5.0, False)


# ------------------------------------------------ retrieval


def bm25(spark, docs, queries):
    d = spark.createDataFrame(docs, "item_id long, terms array<string>")
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    return {(r.query_id, r.item_id): r.bm25_score for r in retrieval.bm25_topk(d, q).collect()}


def test_bm25_closed_form(spark):
    docs = [(1, ["alpha", "beta", "beta"]), (2, ["alpha", "gamma"]), (3, ["delta"])]
    found = bm25(spark, docs, [(1, ["beta"]), (2, ["beta", "beta"]), (3, ["none"])])
    wanted = math.log(1 + (3 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2))
    assert set(found) == {(1, 1), (2, 1)}
    assert found[1, 1] == pytest.approx(wanted, abs=1e-12)
    assert found[2, 1] == pytest.approx(2 * wanted, abs=1e-12)


def test_bm25_tie(spark):
    d = spark.createDataFrame([(9, ["x"]), (4, ["x"])], "item_id long, terms array<string>")
    q = spark.createDataFrame([(1, ["x"])], "query_id long, terms array<string>")
    assert [r.item_id for r in retrieval.bm25_topk(d, q).orderBy("bm25_rank").collect()] == [4, 9]


def test_dense_topk(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (5, None)], "item_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, embedding array<float>")
    found = rows(retrieval.dense_topk(items, queries, 2, block=1).select("query_id", "dense_rank", "item_id").orderBy("query_id", "dense_rank"))
    assert found == [(7, 1, 2), (7, 2, 3), (8, 1, 1), (8, 2, 2)]
    assert retrieval.dense_topk(items, queries.where("false")).count() == 0


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, item_id long, dense_rank int")
    words = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, item_id long, bm25_rank int")
    found = {r.item_id: (r.source, r.rrf_score, r.hybrid_rank) for r in retrieval.hybrid_union(dense, words).collect()}
    assert found[20][0] == "both" and found[20][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-12) and found[20][2] == 1
    assert found[10][2] == 2 and found[30][2] == 3


def test_strict_rank(spark):
    schema = "query_id long, item_id long, score double, prior_rank int"
    pairs = spark.createDataFrame([(1, 5, 1.0, 2), (1, 6, 1.0, 1), (1, 7, 2.0, 3), (1, 4, 1.0, 2)], schema)
    assert [r.item_id for r in retrieval.strict_rank(pairs).orderBy("final_rank").collect()] == [7, 6, 4, 5]
    for bad in ([(1, 5, 1.0, 1), (1, 5, 2.0, 2)], [(1, 5, float("nan"), 1)], [(1, 5, 1.0, 0)], []):
        with pytest.raises(contracts.ContractError):
            retrieval.strict_rank(spark.createDataFrame(bad, schema))


def test_first_ranks_keep_retrieval_order(spark):
    found = spark.createDataFrame([(300, 1), (100, 2), (400, 3), (200, 4), (300, 5)], "item_id long, rank int")
    meta = spark.createDataFrame([(i, "x") for i in (100, 200, 300, 400)], "item_id long, title string")
    assert [r.item_id for r in retrieval.first_ranks(found, meta).collect()] == [300, 100, 400, 200]


def test_union_identity(spark):
    a = spark.createDataFrame([(1, i, i) for i in range(1, 51)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, i, i - 40) for i in range(41, 91)], "query_id long, item_id long, rank int")
    u = retrieval.display_union(a, b)
    assert u.count() == 90 and u.where("pair_source = 'both'").count() == 10


# ------------------------------------------------ metrics and statistics


def judged(spark, scores, query=1):
    return spark.createDataFrame([(query, 100 + i, i + 1, s) for i, s in enumerate(scores)], "query_id long, item_id long, rank int, score int")


def test_summary(spark):
    r = metrics.query_summary(judged(spark, [0, 3, 4, 0, 1])).first()
    assert (r.n, r.mean_score, r.hit_at_5, r.top1_clear, r.first_clear_rank, r.mrr, r.catastrophic) == (5, 1.6, 1, 0, 2, 0.5, 0)
    gains, ideal = [0, 7, 15, 0, 1], [15, 7, 1, 0, 0]
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    assert r.ndcg == pytest.approx(dcg(gains) / dcg(ideal))
    none = metrics.query_summary(judged(spark, [0, 0])).first()
    assert none.ndcg == 0 and none.first_clear_rank is None and none.mrr == 0 and none.catastrophic == 1


def test_gates_of_the_contract(spark):
    """Eight gates; a value on its threshold passes, the interval's lower end has a gate of its own, MRR has none."""
    names = ["mean_score", "mean_score_lower", "clear_rate", "irrelevant_rate", "hit_at_5", "top1_clear", "mrr", "ndcg", "catastrophic_rate"]
    find = lambda *v: {r.metric: r.passed for r in metrics.release_gates(spark.createDataFrame([v], [f"{n}" for n in names])).collect()}
    on = (2.5, 2.0, 0.6, 0.1, 0.9, 0.75, 0.0, 0.85, 0.0)
    assert find(*on) == {n: True for n in names if n != "mrr"}
    under = (2.5 - 1e-13, 1.99, 0.59, 0.11, 0.89, 0.74, 0.0, 0.84, 1 / 12)
    assert find(*under) == {n: False for n in names if n != "mrr"}
    # the published second run: 0 of 8
    assert not any(find(1.692, 1.350, 0.333, 0.308, 0.667, 0.333, 0.508, 0.836, 0.25).values())


def test_decision(spark):
    def gates(*failed, rate=0.0):
        rows = [(g[0], g[0] not in failed, rate if g[0] == "catastrophic_rate" else 1.0) for g in metrics.GATES]
        return one(metrics.decision(spark.createDataFrame(rows, "metric string, passed boolean, value double")).select("decision"))

    assert gates() == "PASS" and gates("top1_clear", "ndcg") == "REVIEW" and gates("clear_rate", "ndcg", "hit_at_5") == "FAIL"
    assert gates("catastrophic_rate", rate=0.25) == "FAIL"
    # the rate decides, whatever a caller's own gate asks of it
    assert gates("ndcg", rate=0.25) == "FAIL" and gates("catastrophic_rate", rate=0.0) == "REVIEW"


def test_lists_under_contract(spark):
    metrics.require_lists(judged(spark, [0, 1, 2]), 3)
    for bad in (judged(spark, [0, 1]), judged(spark, [0, 1, 5]), judged(spark, [0, 1, 2]).withColumn("rank", F.col("rank") + 1)):
        with pytest.raises(contracts.ContractError):
            metrics.require_lists(bad, 3)


def test_bootstrap_with_numpy_draws(spark):
    data = [0.0, 1.0, 2.0, 5.0]
    df = spark.createDataFrame(list(enumerate(data)), "query_id long, m double")
    r = stats.bootstrap_ci(df, ["m"], replicates=200, indices="numpy").first()
    draws = np.array(data)[np.random.default_rng(stats.SEED).integers(0, 4, size=(200, 4))].mean(axis=1)
    assert (r["mean"], r.se, r.lo, r.hi) == pytest.approx((2.0, draws.std(ddof=1), *np.quantile(draws, [0.025, 0.975])))


def test_bootstrap_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, i * 0.37 % 1, i % 3 / 1.0) for i in range(40)], "query_id long, m double, k double")
    values = np.array([[r.m, r.k] for r in df.orderBy("query_id").collect()])
    wanted = np.stack([values[stats.draws(5, r, 40)].mean(axis=0) for r in range(64)])
    assert np.bincount(np.concatenate([stats.draws(5, r, 40) for r in range(500)])).std() < 40  # 500 expected of each
    sent = {r.metric: r for r in stats.bootstrap_ci(df, ["m", "k"], replicates=64, seed=5).collect()}
    for i, name in enumerate(("m", "k")):
        own = wanted[:, i]
        assert (sent[name].se, sent[name].lo, sent[name].hi, sent[name].boot_mean) == pytest.approx((own.std(ddof=1), *np.quantile(own, [0.025, 0.975]), own.mean()))
    monkeypatch.setattr(stats, "BROADCAST_VALUES", 10)
    shuffled = {r.metric: r for r in stats.bootstrap_ci(df, ["m", "k"], replicates=400, seed=5).collect()}
    assert shuffled["m"].se == pytest.approx(sent["m"].se, rel=0.3) and shuffled["m"]["mean"] == pytest.approx(sent["m"]["mean"])


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 5, 300).tolist(), rng.normal(size=300).tolist(), [7.0] * 20, []):
        df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i long")
        found = ordering.running_total(df, ordering.value_buckets(df, ["v"])["v"], [F.col("v"), F.col("i")], F.lit(1), "place").collect()
        assert [r.i for r in sorted(found, key=lambda r: r.place)] == [i for _, i in sorted((v, i) for i, v in enumerate(values))]
        assert sorted(r.place for r in found) == list(range(1, len(values) + 1))


def test_select_candidate_ties(spark):
    df = spark.createDataFrame([("B", 1.0, 0, 5.0), ("K", 1.0, 1, 1.0), ("R", 0.5, 1, 1.0)], "system string, m double, n_changes int, latency double")
    assert one(stats.select_candidate(df, [("m", "max")], "B").select("system")) == "B"
    assert one(stats.select_candidate(df.where("system <> 'B'"), [("m", "max")], "B").select("system")) == "K"
    # metrics are compared exactly; a tie in everything selects nothing
    close = spark.createDataFrame([("K", 1.0, 1, 1.0), ("R", 1.0 + 1e-15, 1, 9.0)], df.schema)
    assert one(stats.select_candidate(close, [("m", "max")], "B").select("system")) == "R"
    assert stats.select_candidate(spark.createDataFrame([("K", 1.0, 1, 1.0), ("R", 1.0, 1, 1.0), ("S", 1.0, 2, 0.1)], df.schema), [("m", "max")], "B").count() == 0


def test_agreement_counts(spark):
    """Hand-worked: over and under from two on, false zero and false positive by zero alone."""
    pairs = [(0, 0), (0, 1), (0, 3), (1, 0), (2, 4), (4, 2), (4, 0), (3, 4), (2, 3)]
    r = agreement.agreement(spark.createDataFrame(pairs, "human int, judge int")).first()
    assert (r.n, r.severe, r.over, r.under, r.false_zero, r.false_positive) == (9, 4, 2, 2, 2, 2)


def test_confusion_has_all_rows(spark):
    found = sorted(rows(agreement.confusion(spark.createDataFrame([(0, 1), (0, 1), (4, 4)], "human int, judge int"))))
    assert found == [(0, 0, 2, 0, 0, 0), (1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (4, 0, 0, 0, 0, 1)]


def test_disagreements_in_order(spark):
    df = spark.createDataFrame([("c", 0, 2), ("a", 4, 2), ("b", 0, 4), ("d", 1, 1)], "case_id string, human int, judge int")
    assert [r.case_id for r in agreement.disagreements(df, least=2).collect()] == ["b", "a", "c"]


def test_oracle_support(spark):
    def kind(actual, best, deep=0):
        gates = lambda m: metrics.release_gates(m.withColumn("mean_score_lower", F.col("mean_score")))
        a, o = (metrics.macro(metrics.query_summary(judged(spark, x))) for x in (actual, best))
        below = judged(spark, [1] * deep) if deep else judged(spark, [1]).where("false")
        return one(diagnose.oracle_support(a, o, gates(o), below).select("support"))

    assert kind([0, 4, 4, 4], [4, 4, 4, 4]) == "RERANKER_SUPPORTED"
    assert kind([0, 4, 0], [4, 0, 0]) == "MIXED" and kind([4, 0, 0], [4, 0, 0], deep=1) == "MIXED"
    assert kind([4, 0, 0], [4, 0, 0]) == "RETRIEVAL_LIMITED"


def test_kappa(spark):
    pairs = lambda p: spark.createDataFrame(p, "human int, judge int")
    assert tuple(agreement.weighted_kappa(pairs([(i % 5, i % 5) for i in range(20)])).first())[1:] == (1.0, 1.0)
    assert tuple(agreement.weighted_kappa(pairs([(2, 2), (2, 2)])).first())[1:] == (1.0, 1.0)
    found = agreement.weighted_kappa(pairs([(0, 1), (1, 0), (2, 2), (4, 4)])).first()
    h, j = [0, 1, 2, 4], [1, 0, 2, 4]
    expected = sum(abs(a - b) for a in h for b in j) / 16
    assert found.kappa_linear == pytest.approx(1 - (2 / 4) / expected)


def test_prf_without_positives(spark):
    r = agreement.binary_prf(spark.createDataFrame([(0, 0), (0, 0)], "human int, judge int")).first()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1) == (0, 2, 0.0, 0.0, 0.0)
    r = agreement.binary_prf(spark.createDataFrame([(1, 2), (1, 0), (0, 4), (0, 1), (3, 1)], "human int, judge int")).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (2, 2, 1, 0.5, pytest.approx(2 / 3))


def test_expectations(spark):
    res = spark.createDataFrame([("a", 2), ("b", 4)], "case_id string, score int")
    exp = spark.createDataFrame([("a", 1, None), ("b", None, 3), ("c", 0, 4)], "case_id string, judge_min int, judge_max int")
    assert dict(rows(agreement.expectation_check(res, exp).select("case_id", "passed"))) == {"a": True, "b": False, "c": False}


def test_headroom(spark):
    df = judged(spark, [0] * 12 + [3, 2], 1).unionByName(judged(spark, [0] * 60 + [4], 2)).unionByName(judged(spark, [4] + [1] * 20, 3)).unionByName(judged(spark, [0] * 11, 4))
    left = df.join(diagnose.unclear(df), "query_id")
    first, second = diagnose.headroom(left), diagnose.headroom(left, 51, None)
    found = {r.query_id: (r.headroom, r.n_candidates, r.best_score, r.n_partial, r.clear_ranks) for r in first.collect()}
    assert found == {1: ("HEADROOM_FOUND_11_50", 4, 3, 1, "[13]"), 2: ("NO_CLEAR_THROUGH_50", 40, 0, 0, "[]"), 4: ("NO_CLEAR_THROUGH_50", 1, 0, 0, "[]")}
    both = {r.query_id: (r.stage_b, r.headroom) for r in diagnose.combine_headroom(first, second).collect()}
    assert both == {1: ("NOT_RUN_STAGE_A_ALREADY_RESOLVED", "HEADROOM_FOUND_11_50"), 2: ("HEADROOM_FOUND_51_END",) * 2, 4: ("NO_CLEAR_THROUGH_FULL_UNION",) * 2}


def test_depth_profile(spark):
    r = diagnose.depth_profile(judged(spark, [0, 3, 1, 2, 0, 0, 0, 0, 0, 0, 4, 2, 3])).first()
    assert (r.first_clear_rank, r.first_strong_rank, r.best_1_10, r.best_11_50, r.clear_11_50, r.partial_11_50) == (2, 11, 3, 4, 2, 3)
    assert (r.clear_ranks, r.partial_ranks, r.clear_at_10, r.partial_at_20, r.ranks_1_10_score_0, r.ranks_11_50_score_4) == ("11,13", "11,12,13", 1, 5, 7, 1)


# ------------------------------------------------ judge


def test_support(spark):
    cases = [("core", "unsupported", "central", "absent"), ("core", "adjacent", "not_applicable", "incidental"), ("core", "direct", "incidental", "incidental"), ("core", "direct", "central", "strong"), ("core", "entailed", "central", "meaningful"), ("core", "direct", "substantive", "meaningful"), ("qualifier", "direct", "not_applicable", "strong"), ("qualifier", "entailed", "not_applicable", "meaningful"), ("qualifier", "adjacent", "not_applicable", "absent")]
    df = spark.createDataFrame(cases, "k string, r string, p string, wanted string")
    assert df.where(judge.facet_support(F.col("k"), F.col("r"), F.col("p")) != F.col("wanted")).count() == 0


@pytest.mark.parametrize(
    ("core", "qualifiers", "score"),
    [("aa", "", 0), ("ia", "", 1), ("ss", "", 4), ("sa", "", 2), ("si", "", 3), ("mms", "", 3), ("mma", "", 3), ("maa", "", 2), ("ss", "a", 2), ("ss", "m", 3), ("ss", "s", 4), ("ma", "a", 2), ("m", "", 3), ("mm", "", 3)],
)
def test_case_score(spark, core, qualifiers, score):
    names = {"a": "absent", "i": "incidental", "m": "meaningful", "s": "strong"}
    facets = [(1, f"c{i}", "core", names[c]) for i, c in enumerate(core)] + [(1, f"q{i}", "qualifier", names[c]) for i, c in enumerate(qualifiers)]
    df = spark.createDataFrame(facets, "case_id long, facet_id string, facet_type string, support string")
    assert judge.case_scores(df).first().score == score


def test_case_cap(spark):
    df = spark.createDataFrame([(1, "r", "core", "absent"), (1, "x", "core", "strong"), (1, "y", "core", "strong")], "case_id long, facet_id string, facet_type string, support string")
    caps = spark.createDataFrame([(1, "r", 2)], "case_id long, facet_id string, cap int")
    assert (judge.case_scores(df).first().score, judge.case_scores(df, caps=caps).first().score) == (3, 2)


def test_assembly(spark):
    data = [("d", "a", 0, True, True, False), ("e", "a", 0, True, True, False), ("e", "b", 1, True, False, False), ("u", "a", 0, True, True, False), ("u", "b", 1, False, False, True), ("j", "a", 0, False, False, False), ("j", "b", 1, True, True, False), ("n", "a", 0, False, False, False)]
    df = spark.createDataFrame(data, "f string, component_id string, spec_pos int, established boolean, explicit boolean, negative_boundary boolean")
    found = {r.f: (r.relation, r.missing_component) for r in judge.assemble_facets(df, ["f"]).collect()}
    assert found == {"d": ("direct", None), "e": ("entailed", None), "u": ("unsupported", None), "j": ("adjacent", "a"), "n": ("unsupported", None)}


def test_cues():
    rules = [{"cue_id": "c", "any_regex": [r"dragons?"]}, {"cue_id": "g", "all_regex_groups": [["king", "queen"]]}]
    before, after = [r"\bno\s+$"], [r"^\s+are absent"]
    assert judge.scan_cue([("S1", "There are no dragons"), ("S2", "A dragon")], rules, before, after) == ("c", "S2", 1)
    assert judge.scan_cue([("S1", "dragons are absent; king and Queen")], rules, before, after) == ("g", "S1", 1)
    assert judge.scan_cue([("S1", "nothing")], rules, before, after) == (None, None, 0)


def test_collection_cues_near_each_other(spark):
    text = "An anthology " + "x " * 10 + "and a collection " + "y" * 221 + " about sea magic"
    far = "An anthology " + "x" * 260 + " about sea magic"
    for whole, wanted in ((text, True), (far, False), ("sea magic " + "x" * 150 + " collection", True), ("sea magic " + "x" * 190 + " collection", False), ("no cue: sea magic", False)):
        df = spark.createDataFrame([("Sea-Magic", whole)], "f string, w string")
        assert one(df.select(judge.named_at_collection(F.col("f"), F.col("w")))) is wanted
    assert one(spark.createDataFrame([("--", text)], "f string, w string").select(judge.named_at_collection(F.col("f"), F.col("w")))) is False


def test_guards(spark):
    df = spark.createDataFrame([("same_as_primary_subject", "magic", "In one story a wizard acts", "An anthology. In one story a wizard acts"), ("same_as_primary_subject", "magic", "In one story a wizard acts", "A collection about magic. In one story a wizard acts"), ("other", "magic", "x", "y")], "r string, f string, e string, w string")
    assert [r[0] for r in df.select(judge.scope_guard(F.col("r"), F.col("f"), F.col("e"), F.col("w"))).collect()] == ["other", "same_as_primary_subject", "other"]
    lists = spark.createDataFrame([("same_as_primary_subject", "S1", ["S1"], "his king, his lover, his gods"), ("same_as_primary_subject", "S1", ["S2"], "his king, his lover, his gods")], "r string, s string, p array<string>, e string")
    assert [r[0] for r in lists.select(judge.list_guard(F.col("r"), F.col("s"), F.col("p"), F.col("e"))).collect()] == ["other", "same_as_primary_subject"]


def test_assessment_faults(spark):
    schema = "case_id long, facet_id string, facet_type string, relation string, inference_kind string, prominence string, candidate_ids array<string>, winner string, composite_ids array<string>, missing_component string"
    good = (1, "a", "core", "direct", "explicit_components", "central", ["S1"], "S1", [], None)
    bad = (1, "b", "core", "direct", "none", "not_applicable", ["S1", "S1"], "S9", [], None)
    assert {(r.facet_id, r.fault) for r in judge.assessment_faults(spark.createDataFrame([good, bad], schema)).collect()} == {
        ("b", "too many or repeated candidates"), ("b", "winner isn't a candidate"), ("b", "inference kind doesn't fit the relation"), ("b", "prominence doesn't fit")}


# ------------------------------------------------ reuse, pools, catalogue


def test_precedence_and_payloads(spark):
    a = spark.createDataFrame([(1, 2)], "k long, score int")
    b = spark.createDataFrame([(1, 3), (2, 4)], "k long, score int")
    assert rows(reuse.precedence([a, b], ["k"]).select("k", "score", "source_rank", "n_conflicts").orderBy("k")) == [(1, 2, 0, 1), (2, 4, 1, 0)]
    c = spark.createDataFrame([(1, 2), (1, 4)], "k long, score int")
    assert one(reuse.precedence([a, b, c.limit(1).withColumn("score", F.lit(5)), a], ["k"]).where("k = 1").select("n_conflicts")) == 2
    with pytest.raises(PySparkException, match="repeats the key 1"):
        reuse.precedence([a, c], ["k"]).collect()
    wanted = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, payload string")
    known = spark.createDataFrame([(1, "x", 4), (2, "other", 1)], "k long, payload string, score int")
    assert rows(reuse.payload_reuse(wanted, known, ["k"]).select("k", "status", "score").orderBy("k")) == [(1, "reused", 4), (2, "mismatch", None), (3, "novel", None)]


def test_cascade_stops_at_ambiguity(spark):
    left = spark.createDataFrame([(1, "t", "a"), (2, "t", "z"), (3, "u", "q"), (4, "none", "q")], "id long, t string, x string")
    right = spark.createDataFrame([(10, "t", "a"), (11, "t", "b"), (12, "u", "c")], "id long, t string, x string")
    found = reuse.cascade_match(left, right, {"both": [(F.col("t"), F.col("t")), (F.col("x"), F.col("x"))], "title": [(F.col("t"), F.col("t"))]}, "id", "id")
    assert {r.id: (r.status, r.matched_id) for r in found.collect()} == {1: ("recovered", 10), 2: ("ambiguous", None), 3: ("recovered", 12), 4: ("unmatched", None)}


def test_slots(spark):
    df = spark.createDataFrame([(1, 100 + r, r) for r in (1, 5, 6, 40)], "query_id long, item_id long, rank int")
    assert rows(pools.slot_sample(df, (2, 4, 30, 70)).select("target_rank", "rank").orderBy("target_rank")) == [(2, 5), (4, 6), (30, 40)]


def test_similar_sets_match_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {i: sorted({f"w{x}" for x in rng.integers(0, 12, 6)}) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    for least in (0.35, 0.8):
        found = {(r.a, r.b) for r in pools.similar_sets(df, least).collect()}
        wanted = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-12}
        assert found == wanted


def test_splits():
    data = [(i, f"g{i % 3}", i % 2) for i in range(18)]
    chosen = pools.exact_split(data, {"g0": 3, "g1": 3, "g2": 3}, {0: 4, 1: 5})
    assert len(chosen) == 9 and sum(1 for i in chosen if i % 2) == 5 and all(sum(1 for i in chosen if i % 3 == g) == 3 for g in range(3))
    assert pools.exact_split(data, {"g0": 3, "g1": 3, "g2": 3}, {0: 10, 1: 0}) is None
    cost, ids = pools.search_split(data, {"g0": 3, "g1": 3, "g2": 3}, tries=200)
    assert len(ids) == 9 and cost <= 2


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b")], "q long, rank int, t string")
    with pytest.raises(contracts.ContractError):
        contracts.require_contiguous_ranks(df, ["q"], "rank")
    with pytest.raises(contracts.ContractError):
        contracts.require_dependency(df, ["q"], "t")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique(df, ["q"])
    with pytest.raises(contracts.ContractError):
        contracts.join_checked(df, df, ["q"], validate="many_to_one")
    with pytest.raises(contracts.ContractError):
        contracts.require(df, small=F.col("rank") < 3)
    assert contracts.same_rows(df, df.select("*")) and not contracts.same_rows(df, df.limit(1))


def test_recommend(spark):
    found = spark.createDataFrame([(i, i) for i in range(1, 31)], "item_id long, rank int")
    meta = spark.createDataFrame([(i, "x" if i % 2 else "y", float(i)) for i in range(1, 31)], "item_id long, category string, joy double")
    assert [r.item_id for r in etl.recommend(found, meta).collect()] == list(range(1, 17))
    assert [r.item_id for r in etl.recommend(found, meta, tone="happy").collect()] == list(range(16, 0, -1))
    assert [r.item_id for r in etl.recommend(found, meta, category="x").collect()] == list(range(1, 31, 2))
    assert etl.recommend(found, meta, category=None).count() == 0


def test_model_hooks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "k long, t string")
    scored = etl.score_texts(df, "k", "t", lambda texts: [{"long": float(len(x))} for x in texts], ["long"], batch=1)
    assert dict(rows(scored)) == {1: 2.0, 2: 0.0}
    unit = etl.embed(df, "k", "t", lambda texts: [[3.0, 4.0] for _ in texts], 2)
    assert unit.where(N.is_unit(F.col("embedding"), 2)).count() == 2
    pairs = spark.createDataFrame([(1, "q", "text")], "k long, q string, t string")
    assert rows(etl.score_pairs(pairs, ["k"], "q", "t", lambda xs: [len(a) + len(b) for a, b in xs])) == [(1, 5.0)]


def test_blind_labels_come_back(spark):
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, t string")
    blind = pools.blind(pool, "id", "s").persist()
    assert sorted(r.blind_id for r in blind.collect()) == [f"B{i:06d}" for i in range(1, 51)]
    labels = blind.select("blind_id", (F.col("id") % 5).alias("score"))
    assert {(r.id, r.score) for r in pools.unblind(labels, blind.select("blind_id", "id")).collect()} == {(i, i % 5) for i in range(50)}
    for bad in (labels.where("blind_id <> 'B000007'"), labels.unionByName(labels)):
        with pytest.raises(contracts.ContractError):
            pools.unblind(bad, blind.select("blind_id", "id"))


def test_pool_checks(spark):
    pool = spark.createDataFrame([("Q1", 1, "a"), ("Q1", 2, "b"), ("Q2", 3, None)], "query_id string, id long, key string")
    kept, apart = pools.quarantine(pool, F.col("key") == "b")
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 3] and [r.id for r in apart.collect()] == [2]
    expected = spark.createDataFrame([("query_id", "Q1", 2), ("query_id", "Q2", 2), ("key", "a", 1), ("key", "z", 1)], "column string, value string, n int")
    assert sorted(rows(pools.composition_faults(pool, expected, ["query_id", "key"])), key=str) == sorted([("query_id", "Q2", 2, 1), ("key", "z", 1, 0), ("key", "b", 0, 1), ("key", None, 0, 1)], key=str)
    consumed = spark.createDataFrame([(2, "a"), (9, None)], "id long, key string")
    assert dict(rows(pools.overlap_report(pool, consumed, ["id", "key"]))) == {"id": 1, "key": 1}
    assert [r.id for r in pools.exclude_ids(pool, spark.createDataFrame([(1,), (2,)], "id long"), "id").collect()] == [3]
    with pytest.raises(contracts.ContractError):
        pools.exclude_ids(pool, spark.createDataFrame([(7,)], "id long"), "id")


def test_slots_without_used_works(spark):
    ranked = spark.createDataFrame([(1, i, i, f"w{i // 2}") for i in range(1, 12)], "query_id long, item_id long, rank long, work string")
    assert [r["rank"] for r in pools.slot_sample(ranked, (2, 3, 10)).orderBy("rank").collect()] == [2, 3, 10]
    used = spark.createDataFrame([(1, "w1")], "query_id long, work string")
    assert [r["rank"] for r in pools.slot_sample(ranked, (2, 3, 10), used, "work").orderBy("rank").collect()] == [4, 5, 10]
    with pytest.raises(contracts.ContractError):
        pools.slot_sample(ranked, (2, 30), complete=True)


def test_union_of_lists_that_differ(spark):
    a = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, None)], "query_id long, item_id long, rank long, title string")
    b = spark.createDataFrame([(1, 1, 2, "x"), (1, 3, 1, "z")], "query_id long, item_id long, rank long, title string")
    assert sorted((r.item_id, r.title) for r in retrieval.display_union(a, b, shared=("title",)).collect()) == [(1, "x"), (2, None), (3, "z")]
    with pytest.raises(PySparkException, match="title differs"):
        retrieval.display_union(a, b.withColumn("title", F.lit("y")), shared=("title",)).collect()


def test_vectors_of_other_lengths(spark):
    items = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "item_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")
    with pytest.raises(PySparkException, match="vectors of 1 to 3 numbers"):
        retrieval.dense_topk(items, queries).collect()


def test_recommend_in_order(spark):
    """Retrieval order survives a catalogue in another order, and the tone orders the shown ones alone."""
    found = spark.createDataFrame([(7, 300, 1), (7, 100, 2), (7, 400, 3), (7, 200, 4), (8, 200, 1)], "query_id long, item_id long, rank long")
    meta = spark.createDataFrame([(100, "a", 0.1), (200, "b", 0.9), (300, "a", 0.5), (400, "a", 0.5)], "item_id long, category string, joy double")
    order = lambda **o: [(r.query_id, r.place, r.item_id) for r in etl.recommend(found, meta, **o).collect()]
    assert order() == [(7, 1, 300), (7, 2, 100), (7, 3, 400), (7, 4, 200), (8, 1, 200)]
    assert order(k=2, tone="Happy") == [(7, 1, 300), (7, 2, 100), (8, 1, 200)]
    assert order(category="a", tone="happy") == [(7, 1, 300), (7, 2, 400), (7, 3, 100)] and order(category=None) == []


def test_defaults_and_choices(spark):
    df = spark.createDataFrame([("u", "b"), (None, "a"), ("v", "b"), ("w", None)], "t string, c string")
    assert [r[0] for r in df.select(etl.with_default("cover.jpg", F.col("t"), F.lit("&w=8"))).collect()] == ["u&w=8", "cover.jpg", "v&w=8", "w&w=8"]
    assert rows(etl.choices(df, "c")) == [(0, "All"), (1, "a"), (2, "b")]


def test_title_lookup(spark):
    wanted = spark.createDataFrame([("Sea",), ("river ",), ("none",)], "title string")
    catalog = spark.createDataFrame([(1, "The Sea"), (2, "sea"), (3, "A River"), (4, "river run")], "item_id long, title string")
    assert sorted(rows(reuse.title_lookup(wanted, catalog)), key=str) == [("Sea", 2, "exact"), ("none", None, "none"), ("river ", 3, "contains")]
    with pytest.raises(ValueError, match="more than 1"):
        reuse.title_lookup(wanted, catalog, most=1)


# ------------------------------------------------ verdicts


def test_text_anchors(spark):
    """Hand-worked from the rules' own wording."""
    cases = [
        ("Resistance ", "active_opposition_or_defiance", "She joined the movement", "explicit", "missing"),
        ("resistance", "active_opposition_or_defiance", "They fought on", "explicit", "explicit"),
        ("resistance", "target_oppressive_or_authoritarian_power", "They fought on", "entailed", "missing"),
        ("complicated parent-child relationship", "parent_child_relationship", "two lovers quarrel", "explicit", "missing"),
        ("complicated parent-child relationship", "conflict", "two lovers quarrel", "explicit", "explicit"),
        ("dangerous journeys", "movement_or_travel", "They took off on a wild adventure into the hills", "entailed", "entailed"),
        ("grief", "anything", "home from the war", "explicit", "missing"), ("grief", "anything", "home from the war, a widow", "explicit", "explicit"),
        ("building effective organizations", "organizational_effectiveness_goal", "Silos hurt corporate\nperformance", "missing", "entailed"),
        ("legendary heroes", "legendary_or_mythic_hero_identity", "the origin of a legend", "explicit", "missing"),
        ("mythology", "mythic_or_mythological_basis", "based on the Odyssey, with a cyclops", "missing", "entailed"),
        ("adventure", "adventure_like_progression", "a quest", "missing", "entailed"), ("adventure", "adventure_like_progression", "symbolism of a quest", "missing", "missing"),
        ("unknown facet", "x", "a quest", "missing", "missing"),
    ]
    df = spark.createDataFrame(cases, "facet string, part string, text string, grounding string, wanted string")
    found = df.withColumn("found", verdict.guarded(F.col("grounding"), F.col("facet"), F.col("part"), F.col("text")))
    assert [(r.text, r.found) for r in found.where("found <> wanted OR found IS NULL").collect()] == []


def test_recovery_from_several_spans(spark):
    cases = [
        ("dangerous journeys", "danger_or_threat", ["A shipwrecked man.", "He sails home.", "The end."], ("entailed", ["S1", "S2"])),
        ("dangerous journeys", "danger_or_threat", ["A shipwrecked man."], None),
        ("resistance", "active_opposition_or_defiance", ["They revolt.", "A tyrannical king."], None),
        ("resistance", "active_opposition_or_defiance", ["They revolt against a tyrannical king."], ("entailed", ["S1"])),
        ("mythology", "mythic_or_mythological_basis", ["Based on the Iliad.", "A goddess speaks."], ("entailed", ["S1", "S2"])),
        ("mythology", "mythic_or_mythological_basis", ["Based on the Iliad.", "A goddess speaks.", "A scholarly analysis."], None),
        ("dangerous journeys", "movement_or_travel", ["a trip"] * 6, ("explicit", ["S1", "S2", "S3", "S4"])),
    ]
    for facet, part, texts, wanted in cases:
        df = spark.createDataFrame([(facet, part, [(f"S{i}", t) for i, t in enumerate(texts, 1)])], "f string, p string, s array<struct<span_id: string, text: string>>")
        r = df.select(verdict.recovered(F.col("f"), F.col("p"), F.col("s"))).first()[0]
        assert (r and (r.grounding, r.span_ids)) == wanted


def test_role_guards(spark):
    same, defining = "same_as_primary_subject", "defining_content_or_narrative_driver"
    cases = [("inequality", same, True, "a working class boy", ("other", False)), ("inequality", same, True, "a working class boy in poverty", (same, True)),
             ("Love", "other", False, "This story of love and loss", (defining, True)), ("love", "other", False, "his love, his king", ("other", False)), ("love", same, True, "this book is about love", (same, True))]
    df = spark.createDataFrame([x[:4] for x in cases], "f string, r string, e boolean, t string")
    assert [tuple(r[0]) for r in df.select(verdict.role_guarded(F.col("r"), F.col("e"), F.col("f"), F.col("t"))).collect()] == [x[4] for x in cases]


def test_result_contract(spark):
    schema = f"id int, checks {verdict.CHECKS}, spec array<string>, allowed array<string>, relation string, inference_kind string, reason string, all_established boolean, missing_component string, definition_excluded boolean, triggered boolean, exclusion_id string, exclusions array<string>"
    ok = [("a", True, False, ["S1"]), ("b", True, False, ["S1"])]
    good = (1, ok, ["a", "b"], ["S1"], "direct", "explicit_components", "said", True, None, False, False, None, ["X"])
    rows = [
        good, (2, [ok[1], ok[0]], *good[2:]), (3, [ok[0]], *good[2:]), (4, [ok[0], ("b", False, True, [])], ["a", "b"], ["S1"], "adjacent", "incomplete_connection", "r", False, "b", False, False, None, []),
        (5, [ok[0], ("b", False, True, ["S9"])], ["a", "b"], ["S1"], "entailed", "none", "might hint", True, "a", False, True, "Y", ["X"]), (6, [], *good[2:])]
    found = {}
    for r in verdict.result_faults(spark.createDataFrame(rows, schema), ["id"], forbidden=("might",)).collect():
        found.setdefault(r.id, set()).add(r.fault)
    assert found == {
        2: {"components out of order"}, 3: {"other components than the facet's"}, 6: {"no components"},
        5: {"unknown spans", "missing with spans", "all_established isn't the ledger's", "positive with an incomplete ledger", "missing component is established", "positive with a missing component", "complete with a missing component",
            "exclusion isn't the facet's", "exclusion without unsupported", "inference kind doesn't fit the relation", "entailed by speculation"}}


def test_exclusions_settle(spark):
    rows = [(1, True, "X", ["X"], "direct", "explicit_components", ["S1"]), (2, True, "Y", ["X"], "direct", "explicit_components", ["S1"]), (3, True, "Z", [], "direct", "explicit_components", ["S1"]), (4, False, None, ["X"], "adjacent", "incomplete_connection", [])]
    df = spark.createDataFrame(rows, "id int, triggered boolean, exclusion_id string, exclusions array<string>, relation string, inference_kind string, span_ids array<string>")
    found = {r.id: (r.triggered, r.exclusion_id, r.relation, r.inference_kind, r.span_ids) for r in verdict.with_exclusions_settled(df).collect()}
    assert found == {1: (True, "X", "unsupported", "none", []), 2: (True, "Y", "direct", "explicit_components", ["S1"]), 3: (False, None, "direct", "explicit_components", ["S1"]), 4: (False, None, "adjacent", "incomplete_connection", [])}


def test_candidates(spark):
    rows = [(1, ["S1", " S2 "]), (2, ["NONE"]), (3, ["NONE", "S1"]), (4, ["S1", "S1"]), (5, ["S1", "S2", "S3", "S4"]), (6, ["S9"]), (7, None)]
    df = spark.createDataFrame(rows, "id int, c array<string>")
    known = F.array(*[F.lit(f"S{i}") for i in range(1, 5)])
    assert sorted((r.id, r.fault) for r in verdict.faults(df, ["id"], verdict.candidate_rules(F.col("c"), known)).collect()) == [(3, "NONE beside span ids"), (4, "repeated candidates"), (5, "too many candidates"), (6, "unknown candidates")]
    assert {r.id: r.c for r in df.select("id", verdict.candidates(F.col("c")).alias("c")).where("id IN (1, 2, 7)").collect()} == {1: ["S1", "S2"], 2: [], 7: []}
    assert {r.fault for r in verdict.faults(df.where("id = 4"), ["id"], verdict.subject_rules(F.col("c"), F.array(F.lit("S2")))).collect()} == {"repeated subject spans", "unknown subject spans"}


def test_the_whole_flow(spark):
    """Models that know a few words; everything else is rules."""
    cases = spark.createDataFrame([
        (1, "Q", "The rebels resisted a totalitarian king. A mother mourns."), (2, "Q", "A cook learns to bake."), (3, "Q", "They revolt. The regime is authoritarian."), (4, "Q", ""),
    ], "case_id long, query_id string, text string")
    spec = spark.createDataFrame([
        ("Q", "F1", 0, "resistance", "core", "active_opposition_or_defiance", 0), ("Q", "F1", 0, "resistance", "core", "target_oppressive_or_authoritarian_power", 1), ("Q", "F2", 1, "motherhood", "qualifier", "mother", 0),
    ], "query_id string, facet_id string, facet_pos int, facet_text string, facet_type string, component_id string, spec_pos int")
    words = {"active_opposition_or_defiance": ("resist", "revolt", "cook"), "target_oppressive_or_authoritarian_power": ("totalitarian", "authoritarian"), "mother": ("mother",)}

    def select(rows):
        return [{"span_ids": list(r["span_ids"])[:2] or ["NONE"]} for r in rows]

    def verify(rows):
        return [{"grounding": "explicit" if any(w in r["evidence"].lower() for w in words[r["component_id"]]) else "missing", "negative_boundary": False} for r in rows]

    def role(rows):
        return [{"subject_relation": "same_as_primary_subject", "examined": True} for _ in rows]

    facets, scores = verdict.judge_cases(cases, spec, select, verify, role)
    found = {(r.case_id, r.facet_id): (r.relation, r.support, r.from_composite) for r in facets.collect()}
    assert found[1, "F1"] == ("direct", "strong", False) and found[1, "F2"][:2] == ("direct", "strong")
    # the model's "cook" has no anchor; two spans together establish what neither does alone
    assert found[2, "F1"][:2] == ("unsupported", "absent") and found[3, "F1"] == ("entailed", "meaningful", True) and found[4, "F1"][0] == "unsupported"
    assert {r.case_id: r.score for r in scores.collect()} == {1: 4, 2: 0, 3: 2, 4: 0}
    texts = {r.case_id: r for r in verdict.summaries(facets.select("case_id", "facet_id", "facet_pos", "facet_text", "facet_type", "support", "evidence"), scores).collect()}
    assert texts[1].matched_core == "resistance" and texts[1].evidence_text == "F1: The rebels resisted a totalitarian king. | F2: A mother mourns."
    assert texts[2].evidence_text is None and [x["facet_id"] for x in json.loads(texts[2].assessments_json)] == ["F1", "F2"]
    with pytest.raises(PySparkException, match="bad candidates"):
        verdict.judge_cases(cases, spec, lambda rows: [{"span_ids": ["S77"]} for _ in rows], verify, role)[0].collect()
