"""Readers and writers with the conventions of evaluation artefacts: text-only CSV, marks, encodings, hashes, write-once."""

from __future__ import annotations

import codecs
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNSEEN = "\x00"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, quotes doubled and fields over several lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    return reader.csv(path, schema=schema) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_text_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; a blank stays an empty string, and a byte order mark isn't part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("nullValue", _UNSEEN).option("emptyValue", "").csv(path)
    names = [n.lstrip("﻿").strip('"') for n in df.columns]
    return df.toDF(*names).na.fill("")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single: bool = False) -> None:
    """CSV with a header; ``single`` makes one file of a small report."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank: value."""
    return spark.read.text(path).where(F.trim("value") != "")


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, text) from lines of a key and a text."""
    line = F.regexp_replace("value", '^"+|"+$', "")
    return read_lines(spark, path).select(F.substring_index(line, " ", 1).cast("long").alias("item_id"), F.regexp_replace(line, r"^\S+\s*", "").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return reader.json(path, schema=schema) if schema is not None else reader.json(path)


#: Fixed format: a query's facets with their required components and exclusions.
FACET_SPEC = (
    "queries array<struct<query_id: string, query: string, facets: array<struct<facet_id: string, text: string, facet_type: string, semantic_definition: string, "
    "hard_exclusions: array<struct<exclusion_id: string, rule: string>>, "
    "required_components: array<struct<component_id: string, definition: string, negative_boundaries: array<string>>>>>>>"
)


def read_facets(spark: SparkSession, path: str) -> DataFrame:
    """One row for each required component of each facet, in order: query_id, facet_id, facet_type, facet_text, component_id, spec_pos."""
    queries = read_json(spark, path, FACET_SPEC).select(F.explode("queries").alias("q"))
    facets = queries.select("q.query_id", F.posexplode("q.facets").alias("facet_pos", "f"))
    rows = facets.select("query_id", "facet_pos", "f.facet_id", "f.facet_type", F.col("f.text").alias("facet_text"), F.posexplode_outer("f.required_components").alias("spec_pos", "c"))
    return rows.select("query_id", "facet_id", "facet_pos", "facet_type", "facet_text", F.col("c.component_id").alias("component_id"), "spec_pos")


#: What a byte that isn't UTF-8 stands for: its Windows-1252 character, U+FFFD where there is none.
_STRAY = bytes(range(256)).decode("cp1252", "replace")


def _stray_byte(fault: UnicodeError) -> tuple[str, int]:
    if not isinstance(fault, UnicodeDecodeError):
        raise fault
    return _STRAY[fault.object[fault.start]], fault.start + 1


codecs.register_error("rankloom.stray_byte", _stray_byte)


def decode_mixed(raw: bytes) -> str:
    """UTF-8 with single bytes of Windows-1252 in between, in one pass; bytes that are in neither become U+FFFD."""
    return raw.decode("utf-8", "rankloom.stray_byte")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_mixed(bytes(b)))


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files in a mixture of UTF-8 and Windows-1252."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))


def file_hashes(spark: SparkSession, path: str, any_line_end: bool = False) -> DataFrame:
    """(path, length, sha256), with CRLF counted as LF on request."""
    df = spark.read.format("binaryFile").load(path)
    content: Column = F.col("content")
    if any_line_end:
        # a space after every byte, so that no pair of digits is taken across two of them
        spaced = F.regexp_replace(F.hex("content"), "(..)", "$1 ")
        content = F.unhex(F.replace(F.replace(spaced, F.lit("0D 0A "), F.lit("0A ")), F.lit(" "), F.lit("")))
    return df.select("path", "length", F.sha2(content, 256).alias("sha256"))


def write_json(rows: DataFrame, most: int = 10_000) -> str:
    """A small table as a JSON array with sorted keys; more rows than ``most`` are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one JSON document")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, sort_keys=True, default=str, indent=2)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as a Markdown table; more rows than ``most`` are an error."""
    head, found = rows.columns, rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one Markdown table")
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


def unseen(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """One row for each key that the table at ``path`` lacks."""
    done, rows = stored(df.sparkSession, path), df.dropDuplicates(list(keys))
    return rows if done is None else rows.join(done.select(*keys), list(keys), "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks, one for each key, and return what was appended; its columns must agree."""
    df, done = df.dropDuplicates(list(keys)), stored(df.sparkSession, path)
    if done is None:
        df.write.parquet(path)
        return df
    if sorted(done.columns) != sorted(df.columns):
        raise ValueError(f"columns {sorted(df.columns)} don't continue {sorted(done.columns)}")
    fresh = df.join(done.select(*keys), list(keys), "left_anti").select(*done.columns)
    fresh.write.mode("append").parquet(path)
    return fresh


def contract_differences(saved: dict, current: dict) -> dict[str, tuple]:
    """Fields of a run's description that differ from the one that it resumes."""
    return {k: (saved.get(k), current.get(k)) for k in sorted(saved.keys() | current.keys()) if saved.get(k) != current.get(k)}


def publish(df: DataFrame, send) -> None:
    """Hand every partition's rows to ``send`` on the executors."""
    df.foreachPartition(lambda rows: send([r.asDict(recursive=True) for r in rows]))
