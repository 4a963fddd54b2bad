"""Evaluation pools without contamination: freshness, near duplicates, slots, splits and blind orders."""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import order_hash
from rankloom.operators.contracts import require_covered, require_same_ids, require_unique
from rankloom.operators.ordering import hash_buckets, running_total


def fresh(pool: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the pool that share no key with consumed rows: one anti join for each key; null keys exclude nothing."""
    for key in keys:
        pool = pool.join(consumed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return pool


def similar_sets(sets: DataFrame, least: float, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """(a, b, similarity) of all pairs of token sets with a Jaccard similarity of at least ``least`` > 0, a < b.

    Every set posts its rarest tokens only: two sets that are similar enough share one of the first
    ``n - ceil(least * n) + 1`` in any common order. So no pair without a shared rare token is ever made.
    """
    rows = sets.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("t")).where(F.size("t") > 0)
    flat = rows.select("id", F.size("t").alias("n"), F.explode("t").alias("token"))
    df = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "token")
    kept = flat.join(df, "token").withColumn("place", F.row_number().over(order)).where(F.expr(f"place <= n - ceil({least} * n - 1e-9) + 1"))
    x = kept.select(F.col("id").alias("a"), F.col("n").alias("na"), "token")
    y = kept.select(F.col("id").alias("b"), F.col("n").alias("nb"), "token")
    near = x.join(y, "token").where(F.expr(f"a < b AND least(na, nb) >= {least} * greatest(na, nb) - 1e-9")).select("a", "b").distinct()
    left, right = rows.select(F.col("id").alias("a"), F.col("t").alias("ta")), rows.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    both = near.join(left, "a").join(right, "b").withColumn("_i", F.size(F.array_intersect("ta", "tb")))
    similarity = F.col("_i") / (F.size("ta") + F.size("tb") - F.col("_i"))
    return both.withColumn("similarity", similarity).where(F.col("similarity") >= least - 1e-12).select("a", "b", "similarity")


def hash_negative(pool: DataFrame, exclude: DataFrame, key: str, seed: str, per: list[str]) -> DataFrame:
    """For each group the pool row with the least hash that isn't excluded."""
    left = pool.join(exclude.select(*per, key), [*per, key], "left_anti")
    w = Window.partitionBy(*per).orderBy(order_hash(seed, F.concat_ws("|", *per, key)), key)
    return left.withColumn("_o", F.row_number().over(w)).where("_o = 1").drop("_o")


def slot_sample(ranked: DataFrame, targets: tuple[int, ...] = (2, 10, 30, 70), taken: DataFrame | None = None, identity: str | None = None, complete: bool = False) -> DataFrame:
    """For each query and target rank the next eligible item at or after it, none twice within a query.

    ``taken`` (query_id, ``identity``) names works that are used already, whatever their item_id; ``complete`` makes a slot without
    a candidate an error.

    ``ranked`` (query_id, item_id, rank) holds eligible items only. The choice of a slot depends on the one before, which
    an ascending order of targets turns into a maximum: a slot starts at its target or after the last pick.
    """
    if taken is not None:
        ranked = ranked.join(taken.where(F.col(identity).isNotNull()).select("query_id", identity).distinct(), ["query_id", identity], "left_anti")
    out, queries = None, ranked.select("query_id").distinct()
    used = ranked.select("query_id").distinct().withColumn("_last", F.lit(0))
    for target in targets:
        pick = ranked.join(used, "query_id").where((F.col("rank") >= target) & (F.col("rank") > F.col("_last"))).groupBy("query_id").agg(F.min(F.struct("rank", "item_id")).alias("_p"))
        chosen = pick.select("query_id", F.lit(target).alias("target_rank"), F.col("_p.rank").alias("rank"), F.col("_p.item_id").alias("item_id"))
        out = chosen if out is None else out.unionByName(chosen)
        used = used.join(chosen.select("query_id", F.col("rank").alias("_r")), "query_id", "left").select("query_id", F.coalesce("_r", "_last").alias("_last"))
    if complete:
        require_covered(queries.crossJoin(F.broadcast(ranked.sparkSession.createDataFrame([(t,) for t in targets], "target_rank int"))), out, ["query_id", "target_rank"])
    return out


def blind(pool: DataFrame, key: str, seed: str) -> DataFrame:
    """The pool in a reproducible random order with blind ids; the key stays as the way back."""
    hashed = pool.withColumn("_hash", order_hash(seed, F.col(key)))
    placed = running_total(hashed, hash_buckets(F.col("_hash")), [F.col("_hash"), F.col(key)], F.lit(1), "_place")
    number = F.col("_place").cast("string")
    return placed.withColumn("blind_id", F.concat(F.lit("B"), F.lpad(number, 6, "0"))).drop("_hash", "_place")


def unblind(labels: DataFrame, key_table: DataFrame, blind_id: str = "blind_id") -> DataFrame:
    """Labels given under blind ids, with their keys back; both tables must have the same ids, each once."""
    require_unique(labels, [blind_id])
    require_unique(key_table, [blind_id])
    require_same_ids(labels, key_table, [blind_id])
    return key_table.join(labels, blind_id)


def quarantine(scored: DataFrame, held_back: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that count and, apart, those that ``held_back`` names (null names none)."""
    apart = F.coalesce(held_back, F.lit(False))
    return scored.where(~apart), scored.where(apart)


def composition_faults(pool: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Where a pool's counts differ from the expected ones: column, value, expected, found.

    ``expected`` has column, value (as text) and n. All columns are counted in one pass; values on either side alone
    count 0 on the other.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    found = pool.select(cells.alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("found"))
    wanted = expected.select("column", "value", F.col("n").cast("long").alias("expected"))
    joined = wanted.join(found, (wanted["column"].eqNullSafe(found["column"])) & (wanted["value"].eqNullSafe(found["value"])), "full_outer")
    both = joined.select(F.coalesce(wanted["column"], found["column"]).alias("column"), F.coalesce(wanted["value"], found["value"]).alias("value"), F.coalesce("expected", F.lit(0).cast("long")).alias("expected"), F.coalesce("found", F.lit(0).cast("long")).alias("found"))
    return both.where("expected <> found")


def overlap_report(pool: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """For each key how many rows of the pool share it with consumed rows: key, overlap. A clean pool has zeros only."""
    out = None
    for key in keys:
        hit = pool.join(consumed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")
        row = hit.agg(F.count(F.lit(1)).alias("overlap")).select(F.lit(key).alias("key"), "overlap")
        out = row if out is None else out.unionByName(row)
    return out


def exclude_ids(pool: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The pool without the named ids; an id that the pool lacks is an error."""
    require_covered(ids, pool, [key])
    return pool.join(ids.select(key).distinct(), key, "left_anti")


def hash_split(pool: DataFrame, key: str, per: list[str], n: int, seed: str) -> DataFrame:
    """Marks ``n`` rows of each group for validation by hash order, the rest for the holdout."""
    w = Window.partitionBy(*per).orderBy(order_hash(seed, F.col(key)), key)
    return pool.withColumn("split", F.when(F.row_number().over(w) <= n, "validation").otherwise("holdout"))


def balance(split: DataFrame, by: str, name: str = "split", part: str = "validation") -> Column:
    """sum |2 x got - total| over the values of a column: 0 for an even split."""
    counts = split.groupBy(by).agg(F.count_if(F.col(name) == part).alias("got"), F.count(F.lit(1)).alias("total"))
    return counts.agg(F.sum(F.abs(2 * F.col("got") - F.col("total"))).alias("imbalance"))


# Splits of a labelled pool of tens of rows are solved on the driver: (id, group, label) triples in, chosen ids out.


def search_split(rows: list[tuple], sizes: dict, tries: int = 20_000, seed: int = 7) -> tuple[int, list]:
    """Random search for a validation set with a given number of rows of each group and the most even labels."""
    rng, by_group = random.Random(seed), {}
    for r in sorted(rows):
        by_group.setdefault(r[1], []).append(r)
    totals = {}
    for _, _, label in rows:
        totals[label] = totals.get(label, 0) + 1
    best = None
    for _ in range(tries):
        chosen = [r for g, own in by_group.items() for r in rng.sample(own, sizes[g])]
        got = {}
        for _, _, label in chosen:
            got[label] = got.get(label, 0) + 1
        cost = sum(abs(2 * got.get(k, 0) - n) for k, n in totals.items())
        if best is None or cost < best[0]:
            best = (cost, sorted(r[0] for r in chosen))
            if not cost:
                break
    return best


def exact_split(rows: list[tuple], sizes: dict, label_targets: dict) -> list | None:
    """Ids with exactly ``sizes`` rows of each group and ``label_targets`` rows of each label, or None.

    Groups with the fewest ways come first; states that can't be finished are remembered.
    """
    labels = sorted(label_targets)
    counts: dict = {}
    for _, g, label in rows:
        counts.setdefault(g, {}).setdefault(label, 0)
        counts[g][label] += 1

    def ways(group):
        own, need = counts[group], sizes[group]

        def fill(i, left):
            if i == len(labels):
                if left == 0:
                    yield ()
                return
            for n in range(min(left, own.get(labels[i], 0)) + 1):
                for rest in fill(i + 1, left - n):
                    yield (n, *rest)
        return list(fill(0, need))

    order = sorted(counts, key=lambda g: (len(ways(g)), str(g)))
    options = {g: ways(g) for g in order}

    @lru_cache(maxsize=None)
    def solve(i: int, left: tuple):
        if i == len(order):
            return () if not any(left) else None
        for way in options[order[i]]:
            rest = tuple(a - b for a, b in zip(left, way, strict=True))
            if min(rest, default=0) >= 0 and (tail := solve(i + 1, rest)) is not None:
                return (way, *tail)
        return None

    found = solve(0, tuple(label_targets[x] for x in labels))
    if found is None:
        return None
    chosen = []
    for g, way in zip(order, found, strict=True):
        for label, n in zip(labels, way, strict=True):
            chosen += sorted(r[0] for r in rows if r[1] == g and r[2] == label)[:n]
    return sorted(chosen)
