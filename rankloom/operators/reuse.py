"""Reusing scores that exist: precedence, payload equality, pending work, overlays, diffs and cascading matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.contracts import require, require_unique


def precedence(sources: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """The first source's row of each key, with how many sources have it and how many scores differ from the winner.

    A key that repeats within a source is an error when it is read. The scores of a key are gathered: one for each source.
    """
    stacked = reduce(lambda a, b: a.unionByName(b), [s.select(*keys, score).withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    gathered = stacked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("source_rank", F.col(score).alias("score")))).alias("_all"))
    every, first = F.col("_all"), F.col("_all")[0]
    twice = F.size(F.array_distinct(every["source_rank"])) < F.size(every)
    best = F.when(twice, F.raise_error(F.concat_ws(" ", F.lit("a source repeats the key"), *[F.col(k).cast("string") for k in keys]))).otherwise(first["score"])
    return gathered.select(
        *keys, best.alias(score), first["source_rank"].alias("source_rank"), F.size(every).cast("long").alias("n_sources"),
        F.size(F.filter(every["score"], lambda x: x != first["score"])).cast("long").alias("n_conflicts"))


def conflicts(sources: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    return precedence(sources, keys, score).where("n_conflicts > 0")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done.select(*keys), keys, "left_anti")


def payload_reuse(wanted: DataFrame, scored: DataFrame, keys: list[str], payload: str = "payload", score: str = "score") -> DataFrame:
    """Each wanted pair as reused (same key and payload), mismatch (same key only) or novel, with the score if reused."""
    known = require_unique(scored, keys).select(*keys, F.col(payload).alias("_payload"), F.col(score).alias("_score"))
    joined = wanted.join(known, keys, "left")
    same = F.col(payload) == F.col("_payload")
    status = F.when(F.col("_payload").isNull(), "novel").when(same, "reused").otherwise("mismatch")
    return joined.withColumns({"status": status, score: F.when(same, F.col("_score"))}).drop("_payload", "_score")


def complete_map(inventory: DataFrame, reused: DataFrame, novel: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores of the whole inventory from a partition of it into reused and novel pairs; gaps are an error."""
    a, b = reused.select(*keys, F.col(score).alias("_a")), novel.select(*keys, F.col(score).alias("_b"))
    out = inventory.join(a, keys, "left").join(b, keys, "left").withColumns({score: F.coalesce("_b", "_a"), "origin": F.when(F.col("_b").isNotNull(), "novel").when(F.col("_a").isNotNull(), "reused")}).drop("_a", "_b")
    require(out, covered=F.col(score).isNotNull())
    return out


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The base with non-null values of ``changes`` laid over the named columns; a key that ``changes`` repeats is an error."""
    renamed = require_unique(changes, keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(renamed, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose named columns differ (null-safe), with both values."""
    a = before.select(*keys, *[F.col(c).alias(f"before_{c}") for c in columns])
    b = after.select(*keys, *[F.col(c).alias(f"after_{c}") for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in columns])
    return a.join(b, keys).where(~same)


def aligned_union(parts: list[DataFrame], fill: str = "") -> DataFrame:
    """Union by name; columns that a part lacks are filled."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.na.fill(fill)


def cascade_match(left: DataFrame, right: DataFrame, levels: dict[str, list[tuple[Column, Column]]], left_key: str, right_key: str) -> DataFrame:
    """Match rows by ever weaker keys; the first level with any match decides, and only a unique match counts.

    ``levels`` maps a name to pairs of (left, right) expressions. Returns left_key, strategy, n_candidates, right_key
    (null if ambiguous or unmatched) and status.
    """
    found = None
    for place, (name, columns) in enumerate(levels.items()):
        a = left.select(F.col(left_key).alias("_l"), *[x.alias(f"k{i}") for i, (x, _) in enumerate(columns)])
        b = right.select(F.col(right_key).alias("_r"), *[y.alias(f"k{i}") for i, (_, y) in enumerate(columns)])
        # candidates are counted before the join, so an ambiguous key costs one row
        single = b.groupBy(*[f"k{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("_r"))
        hits = a.join(single, [f"k{i}" for i in range(len(columns))]).select("_l", F.lit(place).alias("place"), F.lit(name).alias("strategy"), "n", "_r")
        found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("_l").orderBy("place")
    first = found.withColumn("_o", F.row_number().over(w)).where("_o = 1")
    out = left.select(F.col(left_key).alias("_l")).join(first, "_l", "left")
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "recovered").otherwise("ambiguous")
    return out.select(F.col("_l").alias(left_key), "strategy", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.when(F.col("n") == 1, F.col("_r")).alias("matched_id"), status.alias("status"))


def title_lookup(wanted: DataFrame, catalog: DataFrame, title: str = "title", most: int = 1000) -> DataFrame:
    """Wanted titles in a catalogue: equal ignoring case, else literally contained; the smallest id of the better kind.

    Equal titles are joined by value. Only what has none is searched for inside titles, which compares it with every
    title: more than ``most`` such are an error, and they alone are sent to the tasks.
    """
    names = wanted.select(F.col(title).alias("wanted"), F.lower(F.trim(title)).alias("_w")).distinct()
    titles = catalog.select("item_id", F.lower(F.trim(F.col(title))).alias("_t"))
    exact = names.join(titles, F.col("_w") == F.col("_t")).groupBy("wanted").agg(F.min("item_id").alias("item_id")).withColumn("kind", F.lit(0))
    rest = names.join(exact, "wanted", "left_anti").limit(most + 1).collect()
    if len(rest) > most:
        raise ValueError(f"more than {most} titles to search for")
    few = F.broadcast(catalog.sparkSession.createDataFrame([tuple(r) for r in rest], "wanted string, _w string"))
    inside = titles.join(few, F.contains("_t", "_w")).groupBy("wanted").agg(F.min("item_id").alias("item_id")).withColumn("kind", F.lit(1))
    best = exact.unionByName(inside).select("wanted", F.struct("kind", "item_id").alias("b"))
    return wanted.select(F.col(title).alias("wanted")).join(best, "wanted", "left").select("wanted", "b.item_id", F.when(F.col("b.kind") == 0, "exact").when(F.col("b.kind") == 1, "contains").otherwise("none").alias("match"))
