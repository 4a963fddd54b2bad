"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
from rankloom.llm import common as C
from rankloom.llm import op02_quality as O2
from tests.llm.test_llm_operators import brute_groups, shingles


def test_stages(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = C.save(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and all(r.text == before[r.doc_id] for r in rows)
        gone = set(before) - set(after)
        if name == "quality_classifier":
            scores = O2.quality_scores(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
            assert gone == {r.doc_id for r in scores.where("predicted = 0").collect()}
        elif name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            assert len({norm(t) for t in before.values()}) == len(after) == len({norm(r.text) for r in rows})
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, _, _, kept in brute_groups(list(before.items()), 5) if kept}
        elif name == "benchmark_decontamination":
            items = [shingles(r.text, 5) for r in C.read(spark, sf_dir, "benchmark").collect()]
            assert gone == {i for i, t in before.items() if any(s and 100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in items)}
        else:
            assert not gone and all(r.lossless for r in rows)
        before = {i: t for i, t in before.items() if i in after}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(after)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows and clashing names: what each stage keeps, by brute force."""
    from tests.llm.test_llm_operators import odd

    words = [f"w{i}" for i in range(60)]
    long, near = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(1, long, "x"), (1, long, "x"), (2, near, "x"), (3, f" {long}\n", "y"), (4, None, "y"), (5, "", None), (None, "lost words here", "z"), (6, "LOST WORDS here", "z"), (7, "item " * 3 + "one two three four five six", "z")]
    docs = odd(spark, rows)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df=docs: stages[name](spark, df, str(tmp_path))
    kept = {name: sorted(((r.doc_id, r.text) for r in run(name).collect()), key=str) for name, _ in corpus_pipeline.STAGES[:-1]}
    pairs = [(i, t) for i, t, _ in rows]
    # of equal texts the longest, then the smallest id; null and empty are equal
    assert kept["exact_dedup"] == sorted([(2, near), (3, rows[3][1]), (4, None), pairs[6], pairs[7], pairs[8]], key=str)
    # the smallest id of a group; rows that repeat it stay with it; a null id is near nothing
    assert kept["minhash_near_dedup"] == sorted([(1, long), (1, long), (4, None), (5, ""), pairs[6], pairs[7], pairs[8]], key=str)
    assert kept["benchmark_decontamination"] == sorted(pairs[:-1], key=str)
    # equal texts stay or go together
    assert len({(1, long) in kept["quality_classifier"], kept["quality_classifier"].count((1, long)) == 2}) == 1
    pieces = run("sentencepiece_sampling").collect()
    assert len(pieces) == len(rows) and all(r.lossless for r in pieces)
    for name, _ in corpus_pipeline.STAGES:
        empty = run(name, odd(spark, []))
        assert empty.count() == 0
        if name != "sentencepiece_sampling":
            assert empty.columns == docs.columns and run(name).columns == docs.columns


def test_tables_of_earlier_stages_go(spark, sf_dir):
    import os

    root = C.scratch_root(spark).removeprefix("file://")
    names = [n for n, _ in corpus_pipeline.STAGES[:-1]]
    before = set(os.listdir(root))
    corpus_pipeline.run(spark, sf_dir).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert [n for n in names if n in left] == names[-1:]
