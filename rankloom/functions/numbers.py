"""Numeric expressions: safe ratios, tolerant parsing, grades, rank fusion, BM25 parts and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the grades 0 to 4.
GRADES = ("irrelevant", "weak", "partial", "clear", "strong")
BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def int_or_zero(raw: Column) -> Column:
    return F.coalesce(F.expr("try_cast(0 as int)") * 0 + raw.try_cast("int"), F.lit(0))


def parse_bool(raw: Column) -> Column:
    """true/1/yes and false/0/no/empty in any case; anything else is an error."""
    plain = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    return F.when(plain.isin("true", "1", "yes"), F.lit(True)).when(plain.isin("false", "0", "no", ""), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), plain)))


def grade_name(score: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), score.cast("int") + 1)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def tf_part(tf: Column, length: Column, mean_length: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def rrf(*ranks: Column, k: int = RRF_K) -> Column:
    """Reciprocal rank fusion; a missing rank adds nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (k + r), F.lit(0.0))
    return total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_unit(a: Column, size: int, eps: float = 1e-3) -> Column:
    """Whether a vector has the right size, finite entries and length 1."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == size) & finite & (F.abs(norm(a) - 1) < eps), F.lit(False))


def missing_flag(x: Column) -> Column:
    return x.isNull().cast("int")
