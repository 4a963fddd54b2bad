"""Catalogue preparation: cleaning, derived text, category mapping, model scores, pooling and correlation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import sentence_parts, word_count
from rankloom.operators.ordering import running_total, value_buckets

TONES = {"happy": "joy", "surprising": "surprise", "angry": "anger", "suspenseful": "fear", "sad": "sadness"}


def clean_catalog(df: DataFrame, required: list[str], text: str, least_words: int = 25) -> DataFrame:
    """Rows with all required values and a text of enough words; adds n_words."""
    return df.na.drop(subset=required).withColumn("n_words", word_count(F.col(text))).where(F.col("n_words") >= least_words)


def full_title(title: Column, subtitle: Column) -> Column:
    return F.when(subtitle.isNull(), title).otherwise(F.concat(title, F.lit(": "), subtitle))


def tagged(key: Column, text: Column) -> Column:
    """The text after its key, as one line of an index file."""
    return F.concat_ws(" ", key.cast("string"), text.cast("string"))


def map_values(raw: Column, table: dict[str, str]) -> Column:
    """Dictionary values; what isn't in the dictionary is null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[raw]


def value_counts(df: DataFrame, column: str, more_than: int = 0) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), column)


def score_texts(df: DataFrame, key: str, text: str, scorer: Callable[[list[str]], list[dict[str, float]]], labels: list[str], batch: int = 64) -> DataFrame:
    """Scores of each label for each text by any model: the scorer gets lists of texts, is made once for each task, and returns dicts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for i in range(0, len(own), batch):
                part = own.iloc[i : i + batch]
                found = scorer(part[text].fillna("").tolist())
                yield pd.DataFrame({key: part[key].to_numpy()} | {name: [float(f.get(name, 0.0)) for f in found] for name in labels})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in labels))


def score_pairs(df: DataFrame, keys: list[str], query: str, text: str, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8) -> DataFrame:
    """A pair scorer (cross encoder) over (query, text): keys and score."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for i in range(0, len(own), batch):
                part = own.iloc[i : i + batch]
                yield part[keys].assign(score=[float(x) for x in scorer(list(zip(part[query], part[text], strict=True)))])

    return df.select(*keys, query, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score double")


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], size: int, batch: int = 16) -> DataFrame:
    """Unit vectors of texts by any model; a vector of another size is an error."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for i in range(0, len(own), batch):
                part = own.iloc[i : i + batch]
                out = []
                for v in embedder(part[text].fillna("").tolist()):
                    if len(v) != size:
                        raise ValueError(f"a vector of {len(v)} numbers, not {size}")
                    length = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([x / length for x in v])
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": out})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def argmax_label(scores: dict[str, Column]) -> Column:
    """The label with the greatest score; the first on ties."""
    ordered = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())])
    return F.array_max(ordered)["n"]


def max_pool(sentence_scores: DataFrame, key: str, labels: list[str]) -> DataFrame:
    return sentence_scores.groupBy(key).agg(*[F.max(n).alias(n) for n in labels])


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(sentence_parts(F.col(text))).alias("place", "sentence"))


def fill_missing(df: DataFrame, predicted: DataFrame, key: str, column: str, by: str) -> DataFrame:
    """Null values of a column from predictions."""
    return df.join(predicted.select(key, F.col(by).alias("_p")), key, "left").withColumn(column, F.coalesce(column, "_p")).drop("_p")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows where both have values: a, b, rho.

    Average ranks come from counts by value, not from an ordered pass over all rows: each pair is aggregated by value, and
    ranks are running sums over the distinct values only, in buckets that follow the order.
    """
    out, buckets = None, value_buckets(df, columns)
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
            ranked = cells
            for name, c in (("rx", a), ("ry", b)):
                totals = cells.groupBy(c).agg(F.sum("n").alias("m"))
                sums = running_total(totals, buckets[c], [F.col(c)], F.col("m"), "_upto")
                ranked = ranked.join(sums.select(c, (F.col("_upto") - (F.col("m") - 1) / 2).alias(name)), c)
            w, x, y = F.col("n"), F.col("rx"), F.col("ry")
            s = ranked.agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
            rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
            row = s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), rho.alias("rho"))
            out = row if out is None else out.unionByName(row)
    return out


def recommend(found: DataFrame, metadata: DataFrame, category: str | None = "All", tone: str | None = "All", k: int = 16, key: str = "item_id", category_col: str = "category") -> DataFrame:
    """Metadata of retrieved items (query_id, item_id, rank): in rank order, filtered, then sorted by tone, for each query.

    Without a category (``All``) the first k stay, and the tone orders these alone; with one, all matches stay. No category
    (None) matches nothing. Ties keep rank order. ``place`` is a row's place in its query's list; ``found`` without query_id
    is one query's.
    """
    group = ["query_id"] if "query_id" in found.columns else []
    own = Window.partitionBy(*group or [F.lit(1)])  # a query's list: at most the retrieval depth
    best = found.groupBy(*group, key).agg(F.min("rank").alias("rank"))
    rows = best.join(metadata, key)
    if category == "All":
        rows = rows.withColumn("place", F.row_number().over(own.orderBy("rank", key))).where(F.col("place") <= k)
    else:
        rows = rows.where(F.col(category_col) == F.lit(category))
    order = [F.desc(TONES[tone.lower()])] if tone and tone.lower() in TONES else []
    return rows.withColumn("place", F.row_number().over(own.orderBy(*order, "rank", key))).orderBy(*group, "place")


def with_default(default: str, *parts: Column) -> Column:
    """The parts joined; the default where any part is null."""
    return F.coalesce(F.concat(*parts), F.lit(default))


def choices(df: DataFrame, column: str, first: str = "All") -> DataFrame:
    """What a column can be filtered by: ``first``, then its distinct values in order: place, value."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    ranked = values.withColumn("place", F.row_number().over(Window.orderBy("value")).cast("long"))  # the categories of a menu
    return df.sparkSession.createDataFrame([(0, first)], "place long, value string").unionByName(ranked.select("place", "value")).orderBy("place")
