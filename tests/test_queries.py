"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import os
import re

import duckdb
import numpy as np
import pytest

from rankloom.operators import stats
from rankloom.plans import catalogue, evaluation

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark_df, con, sql):
    columns = sorted(spark_df.columns)
    found = [tuple(plain(v) for v in r) for r in spark_df.select(*columns).collect()]
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(catalogue.queries()[name](spark, sf_dir), duck(sf_dir), catalogue.oracle_sql()[name])


def plain_spans(text):
    parts = [x.strip() for x in re.split(r"(?<=[.!?])\s+", (text or "").strip())]
    return [(f"S{i}", x) for i, x in enumerate([x for x in parts if x], 1)]


def test_spans_in_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = sorted((r.doc_id, r.place, r.span_id, r.text) for r in catalogue.queries()["spans"](spark, sf_dir).collect())
    assert found == sorted((d.doc_id, i, n, x) for d in docs for i, (n, x) in enumerate(plain_spans(d.text)))


def test_cues_in_plain_python(spark, sf_dir):
    """The first span in which each word of a rule stands somewhere without a negation beside it."""
    wanted = []
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = {"en": ("the-and", ["the", "and"]), "de": ("und", ["und"])}.get(d.lang)
        row = (None, None, 0)
        if words:
            blocked = 0
            for name, text in plain_spans(d.text):
                ok = True
                for word in words[1]:
                    ok = False
                    for m in re.finditer(rf"\b{word}\b", text, re.IGNORECASE):
                        head, tail = text[max(0, m.start() - 96) : m.start()], text[m.end() : m.end() + 64]
                        negated = re.search(r"\b(?:not|no|never|nicht|kein)\b\W*$", head, re.IGNORECASE) or re.search(r"^\W*\b(?:not|nicht)\b", tail, re.IGNORECASE)
                        if not negated:
                            ok = True
                            break
                        blocked += 1
                    if not ok:
                        break
                if ok:
                    row = (words[0], name, blocked)
                    break
            else:
                row = (None, None, blocked)
        wanted.append((d.doc_id, d.lang, *row))
    found = [(r.case_id, r.facet_id, r.cue_id, r.span_id, r.blocked) for r in catalogue.queries()["direct_cue"](spark, sf_dir).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str) and any(w[2] for w in wanted)


def test_every_query_is_compared():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"spans", "direct_cue"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_delta"])
def test_bootstrap_draws_all_queries(spark, sf_dir, name):
    summaries = [{r.query_id: r for r in evaluation._summary(spark, sf_dir, s).collect()} for s in "ab"]
    if name == "bootstrap_ci":
        rows = [[r.mean_score, r.clear_rate, r.ndcg] for _, r in sorted(summaries[0].items())]
    else:
        rows = [[summaries[1][q][m] - r[m] for m in ("mean_score", "clear_rate", "ndcg")] for q, r in sorted(summaries[0].items()) if q in summaries[1]]
    values = np.array(rows, float)
    assert len(values) > 100  # parts, not brands
    # the draws, worked out with Python's integers
    def place(rep, slot):
        z = (slot + (((stats.SEED << 24) + rep << 32) % 2**63)) * stats._STEP % 2**64
        z = (z ^ z >> 32) * stats._MIX % 2**64
        return ((z ^ z >> 29) >> 11) % len(values)

    draws = np.array([[place(r, i) for i in range(len(values))] for r in range(5000)])
    means = values[draws].mean(axis=1)
    wanted = zip(values.mean(axis=0), means.std(axis=0, ddof=1), *np.quantile(means, [0.025, 0.975], axis=0), means.mean(axis=0), strict=True)
    found = {r.metric: (r["mean"], r.se, r.lo, r.hi, r.boot_mean) for r in catalogue.queries()[name](spark, sf_dir).collect()}
    for metric, row in zip(("mean_score", "clear_rate", "ndcg"), wanted, strict=True):
        assert found[metric] == pytest.approx(row, abs=2e-9)
