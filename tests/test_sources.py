"""Readers, writers, resuming and the stream."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankloom.sources import files
from rankloom.streaming.resume import score_stream


def test_text_csv_keeps_blanks_and_drops_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,text\n1,\n2,"a ""q"", b\nc"\n'.encode())
    df = files.read_text_csv(spark, str(path))
    assert df.columns == ["id", "text"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", ""), ("2", 'a "q", b\nc')]


def test_latin_csv_and_typed_csv(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_bytes("id,name\n1,é\n".encode("latin-1"))
    assert files.read_csv(spark, str(path), "id int, name string", "ISO-8859-1").first().name == "é"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "x,y"), ("2", "")], "id string, t string")
    files.write_csv(df, str(tmp_path / "out"), single=True)
    assert sorted(tuple(r) for r in files.read_text_csv(spark, str(tmp_path / "out")).collect()) == [("1", "x,y"), ("2", "")]
    with pytest.raises(Exception, match="already exists"):
        files.write_csv(df, str(tmp_path / "out"))


def test_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text('12 some text\n\n"13 more"\n')
    assert sorted(tuple(r) for r in files.read_tagged(spark, str(tmp_path / "t.txt")).collect()) == [(12, "some text"), (13, "more")]


def test_mixed_bytes(spark, tmp_path):
    raw = "é".encode() + b"\x93q\x94 \x81" + "ü".encode()
    assert files.decode_mixed(raw) == "é“q” �ü"
    (tmp_path / "m.txt").write_bytes(raw)
    assert files.read_mixed(spark, str(tmp_path / "m.txt")).first().text == "é“q” �ü"


def test_hashes(spark, tmp_path):
    (tmp_path / "h.txt").write_bytes(b"a\r\nb\x0d\x10\nc")
    assert files.file_hashes(spark, str(tmp_path / "h.txt")).first().sha256 == hashlib.sha256(b"a\r\nb\x0d\x10\nc").hexdigest()
    assert files.file_hashes(spark, str(tmp_path / "h.txt"), True).first().sha256 == hashlib.sha256(b"a\nb\x0d\x10\nc").hexdigest()


def test_hashes_leave_bytes_alone(spark, tmp_path):
    raw = " Рx\n".encode() + b"\x0d\x0d\x0a\x0d"
    (tmp_path / "c.txt").write_bytes(raw)
    assert files.file_hashes(spark, str(tmp_path / "c.txt"), True).first().sha256 == hashlib.sha256(raw.replace(b"\r\n", b"\n")).hexdigest()


def test_long_mixed_bytes():
    raw = b"\x93" * 300_000 + "ü".encode() + b"\xe2\x82"
    assert files.decode_mixed(raw) == "“" * 300_000 + "ü" + "â‚"


def test_json_with_mark(spark, tmp_path):
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + b'[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_json(spark, str(tmp_path / "b.json"), "a int").collect()) == [1, 2]


def test_facets(spark, tmp_path):
    spec = {"queries": [{"query_id": "Q1", "query": "q", "facets": [{"facet_id": "f", "text": "t", "facet_type": "core", "required_components": [{"component_id": "a"}, {"component_id": "b"}]}]}]}
    (tmp_path / "f.json").write_text(json.dumps(spec))
    assert [(r.component_id, r.spec_pos) for r in files.read_facets(spark, str(tmp_path / "f.json")).orderBy("spec_pos").collect()] == [("a", 0), ("b", 1)]


def test_reports(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(files.write_json(df)) == [{"a": 1, "b": None}]
    assert files.markdown(df).splitlines()[-1] == "| 1 |  |"
    with pytest.raises(ValueError, match="more than 2 rows"):
        files.markdown(spark.range(3), most=2)
    assert files.contract_differences({"a": 1, "b": 2}, {"a": 1, "c": 3}) == {"b": (2, None), "c": (None, 3)}


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "done")
    make = lambda *k: spark.createDataFrame([(x, x * 2) for x in k], "k int, v int")
    files.append_new(make(1, 2, 2), path, ["k"])
    files.append_new(make(2, 3), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert [r.k for r in files.unseen(make(3, 4, 4), path, ["k"]).collect()] == [4]
    with pytest.raises(ValueError, match="columns"):
        files.append_new(make(4).withColumnRenamed("v", "w"), path, ["k"])


def test_stream_scores_each_case_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    asked = []

    def score(df):
        asked.extend(r.k for r in df.collect())
        return df.withColumn("score", F.col("k") * 10)

    for keys in ((1, 2, 2), (2, 3)):
        spark.createDataFrame([(k,) for k in keys], "k int").write.mode("append").parquet(source)
        score_stream(spark, source, "k int", target, mark, score, ["k"]).awaitTermination()
    assert sorted((r.k, r.score) for r in spark.read.parquet(target).collect()) == [(1, 10), (2, 20), (3, 30)]
    # a stream that starts over finds all cases done
    score_stream(spark, source, "k int", target, mark + "2", score, ["k"]).awaitTermination()
    assert sorted(asked) == [1, 2, 3]
