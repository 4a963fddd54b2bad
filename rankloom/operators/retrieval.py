"""Exact vector search, BM25 over postings, candidate unions and the ranking rules built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numbers import BM25_B, BM25_K1, RRF_K, idf, rrf, tf_part
from rankloom.operators.contracts import ContractError, require, require_unique

#: Most query vectors that are sent to the executors at a time.
QUERY_BLOCK = 1024
#: Most (query, term) rows that are sent to the executors, and scores that a task holds at once.
TERM_ROWS, _CELLS = 500_000, 4_000_000


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds 1-based places within a group; ``order`` must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def _scores(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of every batch for each query: what can't be among a partition's best isn't shuffled."""
        for batch in batches:
            vectors = batch.column("embedding")
            if not len(batch):
                continue
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            if np.any(lengths != matrix.shape[1]):
                raise ValueError(f"vectors of {lengths.min()} to {lengths.max()} numbers, queries of {matrix.shape[1]}")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = matrix @ flat.reshape(len(batch), -1).T
            item = batch.column("item_id").to_numpy(zero_copy_only=False)
            # all scores that reach the k-th best, so that ties are broken by the id and not by the partition
            least = np.partition(scores, -k, axis=1)[:, -k] if k < len(batch) else np.full(len(ids), -np.inf)
            query, at = np.nonzero(scores >= least[:, None])
            order = np.lexsort((item[at], -scores[query, at], query))
            query, at = query[order], at[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, at = query[place < k], at[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(item[at]), pa.array(scores[query, at])], ["query_id", "item_id", "dense_score"])

    return run


def dense_topk(items: DataFrame, queries: DataFrame, k: int = 50, block: int = QUERY_BLOCK) -> DataFrame:
    """The k items with the greatest inner product for each query: query_id, item_id, dense_score, dense_rank.

    ``items`` has item_id and embedding, ``queries`` query_id and embedding. Queries are sent in blocks of bounded size,
    each scored as one matrix product per batch; only a batch's best k travel to the final ranking. Null vectors
    are skipped; ties go to the smaller id.
    """
    out, held = None, []

    def scan(part: list) -> DataFrame:
        ids = np.array([r[0] for r in part], dtype=np.int64)
        matrix = np.array([r[1] for r in part], dtype=np.float64)
        return items.where("embedding IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "embedding").mapInArrow(_scores(ids, matrix, k), "query_id long, item_id long, dense_score double")

    for row in queries.where("embedding IS NOT NULL").select("query_id", "embedding").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out, held = scan(held) if out is None else out.unionByName(scan(held)), []
    if held:
        out = scan(held) if out is None else out.unionByName(scan(held))
    if out is None:
        out = items.sparkSession.createDataFrame([], "query_id long, item_id long, dense_score double")
    return ranked(out, ["query_id"], [F.desc("dense_score"), F.asc("item_id")], "dense_rank").where(F.col("dense_rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """(item_id, term, tf, length) from (item_id, terms). Documents without terms have no postings."""
    sized = docs.select("item_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return sized.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(query_id, item_id, bm25_score) of all pairs that share a term.

    ``docs`` has item_id and terms, ``queries`` query_id and terms; a term repeated in a query counts as often. Only
    postings of query terms are joined, so documents without one are never scored. Mean length is over all documents.
    """
    wanted = _wanted(queries)
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("mean_length"))
    hits = postings(docs).join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = hits.join(df, "term").join(F.broadcast(stats)).withColumn("part", idf(F.col("n_docs"), F.col("df")) * tf_part(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b))
    return weighted.join(wanted, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("part") * F.col("weight")).alias("bm25_score"))


def _bm25_batches(sent, k: int, k1: float, b: float):
    """The best k of every batch of documents for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, first, query, gain, mean = sent.value
        terms = pa.array(terms, pa.string())
        many = max(1, _CELLS // max(len(ids), 1))
        for batch in (x.slice(i, many) for x in batches for i in range(0, len(x), many)):
            lists = batch.column("terms")
            length = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            term = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=terms), -1).to_numpy(zero_copy_only=False)
            pairs, tf = np.unique((row * len(terms) + term)[term >= 0], return_counts=True)
            if not len(pairs):
                continue
            row, term = pairs // len(terms), pairs % len(terms)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
            # a posting counts for each query that has its term
            times = np.diff(first)[term]
            which = np.repeat(np.arange(len(pairs)), times)
            entry = np.repeat(first[term] - (np.cumsum(times) - times), times) + np.arange(len(which))
            scores = np.bincount(query[entry] * len(batch) + row[which], part[which] * gain[entry], len(ids) * len(batch)).reshape(len(ids), -1)
            rounded = np.round(scores, 9)
            least = np.partition(rounded, -k, axis=1)[:, -k] if k < len(batch) else np.zeros(len(ids))
            q, at = np.nonzero((rounded >= least[:, None]) & (scores > 0))
            item = batch.column("item_id").to_numpy(zero_copy_only=False)
            order = np.lexsort((item[at], -rounded[q, at], q))
            q, at = q[order], at[order]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, at = q[near], at[near]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(item[at]), pa.array(scores[q, at])], ["query_id", "item_id", "bm25_score"])

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 50, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """The k best documents for each query: query_id, item_id, bm25_score, bm25_rank; equal scores go to the smaller id.

    A document is one row, so with the query terms at hand it is scored where it is read: one pass counts documents by
    term, a second keeps each batch's best k, and no posting is shuffled. Beyond ``TERM_ROWS`` query terms postings are
    joined instead.
    """
    spark, wanted = docs.sparkSession, _wanted(queries)
    held = wanted.limit(TERM_ROWS + 1).toArrow()
    if held.num_rows > TERM_ROWS:
        scored = bm25_scores(docs, queries, k1, b).where("bm25_score > 0")
    else:
        known = F.broadcast(spark.createDataFrame(sorted({(t,) for t in held.column("term").to_pylist()} | {("",)}), "term string"))
        # every document has the empty term as well, which gives the number of documents and their mean length
        each = docs.select(F.size("terms").alias("length"), F.explode(F.array_append(F.array_distinct("terms"), F.lit(""))).alias("term"))
        counts = {r["term"]: (r["df"], r["total"]) for r in each.join(known, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total")).collect()}
        n_docs, total = counts.pop("", (0, 0))
        rows = held.filter(pc.is_in(held.column("term"), value_set=pa.array(sorted(counts), pa.string()))).sort_by([("term", "ascending"), ("query_id", "ascending")])
        terms = sorted(counts)
        df = np.array([counts[t][0] for t in terms], float)
        term = pc.index_in(rows.column("term"), value_set=pa.array(terms, pa.string())).to_numpy().astype(np.int64)
        ids, query = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
        gain = rows.column("weight").to_numpy() * np.log(1 + (n_docs - df + 0.5) / (df + 0.5))[term]
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        shape = f"query_id {dict(wanted.dtypes)['query_id']}, item_id {dict(docs.dtypes)['item_id']}, bm25_score double"
        if not terms:
            scored = spark.createDataFrame([], shape)
        else:
            sent = spark.sparkContext.broadcast((terms, ids, first, query.astype(np.int64), gain, total / n_docs))
            scored = docs.select("item_id", "terms").mapInArrow(_bm25_batches(sent, k, k1, b), shape)
    # sums come in any order: equal scores must tie
    return ranked(scored, ["query_id"], [F.desc(F.round("bm25_score", 9)), F.asc("item_id")], "bm25_rank").where(F.col("bm25_rank") <= k)


def hybrid_union(dense: DataFrame, bm25: DataFrame, k: int = RRF_K) -> DataFrame:
    """All candidates of both lists with their provenance, fused by reciprocal rank; nothing is cut off."""
    both = dense.join(bm25, ["query_id", "item_id"], "full_outer")
    source = F.when(F.col("dense_rank").isNull(), "bm25").when(F.col("bm25_rank").isNull(), "dense").otherwise("both")
    fused = both.withColumns({"source": source, "rrf_score": rrf(F.col("dense_rank"), F.col("bm25_rank"), k=k)})
    order = [F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.asc("item_id")]
    return ranked(fused, ["query_id"], order, "hybrid_rank")


def rerank(pairs: DataFrame, score: str = "score", prior: str = "prior_rank", name: str = "rerank_rank") -> DataFrame:
    """By score, then the prior rank, then the id."""
    return ranked(pairs, ["query_id"], [F.desc(score), F.asc_nulls_last(prior), F.asc("item_id")], name)


def fuse_with_rerank(pairs: DataFrame, prior: str = "prior_rank", reranked: str = "rerank_rank", k: int = RRF_K, name: str = "final_rank") -> DataFrame:
    """Reciprocal rank fusion of the prior and the reranker; ties go to the reranker, the prior, the id."""
    fused = pairs.withColumn("fused_score", rrf(F.col(prior), F.col(reranked), k=k))
    return ranked(fused, ["query_id"], [F.desc(F.round("fused_score", 12)), F.asc(reranked), F.asc(prior), F.asc("item_id")], name)


def strict_rank(pairs: DataFrame, score: str = "score", prior: str = "prior_rank", name: str = "final_rank") -> DataFrame:
    """``rerank`` under contract: finite scores, prior ranks of 1 or more, no pair twice, at least one row."""
    if pairs.isEmpty():
        raise ContractError("no pairs to rank")
    require(pairs, finite=F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), positive=F.col(prior) >= 1)
    return rerank(require_unique(pairs, ["query_id", "item_id"]), score, prior, name)


def top(df: DataFrame, rank: str, k: int) -> DataFrame:
    return df.where(F.col(rank) <= k)


def first_ranks(found: DataFrame, metadata: DataFrame, key: str = "item_id", rank: str = "rank") -> DataFrame:
    """Metadata in the order of retrieval; of an id that was found twice the first rank counts."""
    best = found.groupBy(key).agg(F.min(rank).alias(rank))
    return metadata.join(best, key).orderBy(rank, key)


def display_union(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), key: tuple[str, ...] = ("query_id", "item_id"), rank: str = "rank", shared: tuple[str, ...] = ()) -> DataFrame:
    """The distinct pairs of two result lists with flags and both ranks.

    ``shared`` columns are taken from either list; a pair in both for which they differ is an error when it is read.
    """
    x, y = (d.select(*key, F.col(rank).alias(f"{n}_rank"), F.lit(True).alias(f"in_{n}"), *[F.col(c).alias(f"_{n}_{c}") for c in shared]) for d, n in zip((a, b), names, strict=True))
    joined = x.join(y, list(key), "full_outer")
    for c in shared:
        one, two = (F.col(f"_{n}_{c}") for n in names)
        both = F.col(f"in_{names[0]}").isNotNull() & F.col(f"in_{names[1]}").isNotNull()
        differs = F.raise_error(F.concat_ws(" ", F.lit(f"{c} differs for"), *[F.col(k).cast("string") for k in key]))
        joined = joined.withColumn(c, F.when(both & ~one.eqNullSafe(two), differs).otherwise(F.coalesce(one, two))).drop(f"_{names[0]}_{c}", f"_{names[1]}_{c}")
    flags = {f"in_{n}": F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in names}
    source = F.when(F.col(f"in_{names[0]}") & F.col(f"in_{names[1]}"), "both").when(F.col(f"in_{names[0]}"), f"{names[0]}_only").otherwise(f"{names[1]}_only")
    return joined.withColumns(flags).withColumn("pair_source", source)


def membership(systems: dict[str, DataFrame], key: tuple[str, ...] = ("query_id", "item_id"), rank: str = "rank") -> DataFrame:
    """Every pair of any number of systems: one rank for each system, the least rank, and how many have it."""
    stacked = None
    for name, df in systems.items():
        part = df.select(*key, F.col(rank).alias("rank"), F.lit(name).alias("system"))
        stacked = part if stacked is None else stacked.unionByName(part)
    ranks = [F.min(F.when(F.col("system") == n, F.col("rank"))).alias(f"{n}_rank") for n in systems]
    return stacked.groupBy(*key).agg(*ranks, F.min("rank").alias("best_rank"), F.count_distinct("system").alias("n_systems"))
