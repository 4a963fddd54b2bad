"""Restartable incremental scoring as a stream: new cases are scored once, whatever is read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.files import append_new, unseen


def score_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Read cases from a folder of Parquet files as they arrive, score the new ones and append them to ``target``.

    The checkpoint remembers the files read. Cases that the target has already aren't scored again when a batch is
    repeated, and none is written twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        append_new(score(unseen(df, target, keys)), target, keys)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
