"""Sharding by a k-d tree over document metadata with distributed weighted medians.

Every node of the tree is split at the median of bytes along its widest metadata dimension until its leaves reach
the target bytes. Medians come from histograms that are made in three passes, each within one bin of the last: what reaches the driver is one row for each
open node and bin, whatever the input size. Ties along a dimension (a source may hold a third of all rows) are broken
by a hash of the document, so a node is cut within its hottest value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

SHARDS = 8
_BINS, _PASSES = 2048, 3


@dataclass
class _Node:
    number: int
    leaves: int
    first: int
    dimension: int = 0
    low: float = 0.0
    high: float = 1.0
    below: float = 0.0
    total: float = 0.0


def _case(nodes: list[_Node], column: Column, value) -> Column:
    """A value of each node by its number; null for other numbers."""
    out = None
    for x in nodes:
        out = F.when(column == x.number, value(x)) if out is None else out.when(column == x.number, value(x))
    return out


def _coordinates(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, _tie and one column _d0, _d1, ... for each dimension, and how many there are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    dims = [F.log(size.cast("double"))]
    for name in metadata:
        if name in docs.columns:
            numeric = dict(docs.dtypes)[name] in ("int", "bigint", "smallint", "tinyint", "double", "float")
            value = F.log1p(F.greatest(F.col(f"`{name}`").cast("double"), F.lit(0.0))) if numeric else F.pmod(F.xxhash64(F.col(f"`{name}`").cast("string")), F.lit(1 << 20)).cast("double") + 1
            dims.append(F.coalesce(value, F.lit(0.0)))
    crc = F.crc32(text.cast("binary")).cast("long")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
        # in [0, 1): the order of documents that a dimension ties
        (F.pmod(F.xxhash64(F.col(id_col).cast("long"), crc, F.lit(11)), F.lit(1 << 40)).cast("double") / float(1 << 40)).alias("_tie"),
        *[d.alias(f"_d{i}") for i, d in enumerate(dims)]), len(dims)


def kd_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars", "source", "lang"), target_bytes: int | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes, or into as many as keep them at ``target_bytes`` if that is given.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1. The dimensions are the logarithm of the
    size and the listed metadata columns that exist; numbers count as they are, other types by a hash, null as the
    lowest. A node of several shards is cut where its lower part has its share of the node's bytes, so sizes differ
    by about one document; documents that agree in id and text fall on the same side. A shard count that is no power of
    two works alike. Slots follow ascending doc_id (nulls first) within a shard and have no gaps. Empty tables give
    an empty result; further columns are ignored, whatever their names.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: sizes decide, not keys).
    """
    spark = docs.sparkSession
    light, n_dims = _coordinates(docs, id_col, text_col, metadata)
    rows, first_at = C.save(light.withColumn("_node", F.lit(1)), "kd")
    stats = rows.agg(F.sum("size").alias("bytes"), *[f(f"_d{i}").alias(f"{n}{i}") for i in range(n_dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    span = [max((stats[f"hi{i}"] or 0) - (stats[f"lo{i}"] or 0), 1e-12) for i in range(n_dims)]
    # a rank in [0, 1) that orders by the dimension first: its whole part in 2**20 steps, then the tie
    steps = float(1 << 20)
    ranks = [(F.floor((F.col(f"_d{i}") - F.lit(float(stats[f"lo{i}"] or 0))) / F.lit(span[i]) * (steps - 1)) + F.col("_tie")) / steps for i in range(n_dims)]

    shard_of: dict[int, int] = {}
    if target_bytes is not None:
        shards = max(1, -(-(stats["bytes"] or 0) // target_bytes))
    nodes = [_Node(1, shards, 0)]
    place = F.lit(1)
    while nodes:
        split = [x for x in nodes if x.leaves > 1]
        shard_of |= {x.number: x.first for x in nodes if x.leaves == 1}
        if not split:
            break
        placed = rows.withColumn("_node", place)
        wide = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum("size").alias("bytes"), *[(F.max(f"_d{i}") - F.min(f"_d{i}")).alias(f"w{i}") for i in range(n_dims)]).collect()}
        for x in split:
            found = wide.get(x.number)
            x.total = float(found["bytes"]) if found else 0.0
            # the widest, in parts of the whole table's extent; the size comes first among equals
            x.dimension = max(range(n_dims), key=lambda i: ((found[f"w{i}"] if found else 0) / span[i], -i))
        ranked = placed.withColumn("_rank", _case(split, F.col("_node"), lambda x: ranks[x.dimension])).where("_rank IS NOT NULL").select("_node", "_rank", "size")
        for _ in range(_PASSES):
            low, step = _case(split, F.col("_node"), lambda x: F.lit(x.low)), _case(split, F.col("_node"), lambda x: F.lit((x.high - x.low) / _BINS))
            inside = ranked.withColumns({"_low": low, "_step": step, "_high": _case(split, F.col("_node"), lambda x: F.lit(x.high))}).where("_rank >= _low AND _rank < _high")
            bins = inside.groupBy("_node", F.least(F.floor((F.col("_rank") - F.col("_low")) / F.col("_step")), F.lit(_BINS - 1)).cast("int").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
            by_node: dict[int, list] = {}
            for r in bins:
                by_node.setdefault(r["_node"], []).append((r["bin"], r["bytes"]))
            for x in split:
                goal, below, width = x.total * (x.leaves // 2) / x.leaves, x.below, (x.high - x.low) / _BINS
                for b, n in sorted(by_node.get(x.number, [])):
                    if below + n > goal:
                        x.low, x.high = x.low + b * width, x.low + (b + 1) * width
                        break
                    below += n
                else:
                    x.low = x.high
                x.below = below
        # the cut is at the low end of the last bin: what lies under it has at most its share
        node = place
        for x in split:
            node = F.when(place == x.number, F.when(ranks[x.dimension] < F.lit(x.low), 2 * x.number).otherwise(2 * x.number + 1)).otherwise(node)
        rows, at = C.save(rows.withColumn("_node", node), "kd")
        C.drop(spark, first_at)
        first_at, place = at, F.col("_node")
        nodes = [y for x in split for y in (_Node(2 * x.number, x.leaves // 2, x.first), _Node(2 * x.number + 1, x.leaves - x.leaves // 2, x.first + x.leaves // 2))]

    shard = _case([_Node(n, 1, s) for n, s in shard_of.items()], F.col("_node"), lambda x: F.lit(x.first))
    out = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"))
    return with_slots(out).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds slot: places without gaps from 0 within a shard, in the order of doc_id.

    Rows are sorted by range over (shard, doc_id) and numbered within each partition; partitions start at the number
    of rows of their shard in the partitions before them. Only these counts reach the driver, never a whole shard
    one task.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(C.partitions(spark), "shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
    held, _ = C.save(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "slots")
    heads = held.groupBy("shard", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    start, starts = {}, []
    for r in sorted(heads, key=lambda r: (r["shard"], r["_part"])):
        before = start.get(r["shard"], 0)
        starts.append((r["shard"], r["_part"], r["_first"] - before))
        start[r["shard"]] = before + r["_n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "shard int, _part int, _offset long"))
    return held.join(offsets, ["shard", "_part"]).withColumn("slot", F.col("_row") - F.col("_offset")).drop("_part", "_row", "_offset")


def op4_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(C.read(spark, sf_dir, "documents"))
