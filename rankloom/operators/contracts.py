"""Contracts on tables: each check is one aggregate job that raises ``ContractError`` with what it found."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table doesn't keep its contract."""


def require_columns(df: DataFrame, names: Iterable[str], exactly: bool = False) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    extra = [n for n in df.columns if n not in set(names)] if exactly else []
    if missing or extra:
        raise ContractError(f"missing columns {missing}, unexpected {extra}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = duplicate_keys(df, keys).head(3)
    if found:
        raise ContractError(f"{list(keys)} repeats: {[tuple(r) for r in found]}")
    return df


def require_count(df: DataFrame, n: int) -> DataFrame:
    if (found := df.count()) != n:
        raise ContractError(f"{found} rows, not {n}")
    return df


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """How many rows break each rule (null breaks it): rule, broken."""
    row = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("v")).select("v.*")


def require(df: DataFrame, **rules: Column) -> DataFrame:
    if broken := {r["rule"]: r["broken"] for r in violations(df, **rules).collect() if r["broken"]}:
        raise ContractError(f"broken rules: {broken}")
    return df


def require_group_sizes(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    sizes = df.groupBy(*keys).count().agg(F.min("count"), F.max("count")).first()
    if tuple(sizes) not in ((n, n), (None, None)):
        raise ContractError(f"groups of {sizes[0]} to {sizes[1]} rows, not {n}")
    return df


def rank_faults(df: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """Groups whose ranks aren't exactly 1..n."""
    stats = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("kinds"))
    return stats.where("lo IS DISTINCT FROM 1 OR hi IS DISTINCT FROM n OR kinds <> n")


def require_contiguous_ranks(df: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    if found := rank_faults(df, group, rank).head(3):
        raise ContractError(f"{rank} isn't 1..n: {[tuple(r) for r in found]}")
    return df


def require_dependency(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Each key has one value."""
    if found := df.groupBy(*key).agg(F.count_distinct(value).alias("n")).where("n > 1").head(3):
        raise ContractError(f"{value} differs within {list(key)}: {[tuple(r) for r in found]}")
    return df


def require_same_ids(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    for left, right, side in ((a, b, "left"), (b, a, "right")):
        if found := left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti").head(3):
            raise ContractError(f"only on the {side}: {[tuple(r) for r in found]}")


def require_covered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of ``left`` has a partner."""
    if found := left.join(right.select(*keys), list(keys), "left_anti").select(*keys).head(3):
        raise ContractError(f"without a partner: {[tuple(r) for r in found]}")
    return left


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join whose cardinality is checked first: one_to_one, many_to_one, one_to_many or many_to_many."""
    one_left, _, one_right = validate.partition("_to_")
    if one_left == "one":
        require_unique(left, on)
    if one_right == "one":
        require_unique(right, on)
    return left.join(right, list(on), how)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows with the same multiplicity."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
