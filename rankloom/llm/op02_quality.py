"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. The weights maximise the likelihood of preference
pairs (a good document beats a bad one) under the logistic model of strength differences: of all pairs of all labelled
rows that are not held out. Strengths fall into narrow bins, and a pair's loss is its Taylor series around the centres
of two bins, so sums of powers for each bin give the loss of all pairs and its slope at every row to about twelve
digits, in two passes over the rows for each Newton step. The threshold is a quantile of the strengths of these rows;
a logistic link puts it at ``THRESHOLD``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm import common as C

THRESHOLD = 0.7
#: Bytes of text whose features are computed at once: a worker needs about 70 times as much.
FEATURE_BYTES = 1 << 20
#: Width of a bin of strengths, and the highest power in the series (which converges below a distance of pi).
BIN, ORDER = 0.25, 12
#: Up to so many labelled rows the sums are made by the driver; every row counts either way.
LOCAL_ROWS = 4096
#: Most tasks of a pass over the labelled rows; each sends the driver its sums.
_TASKS = 256
FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "short_words", "letters", "upper", "digits", "high_bytes",
    "end_marks", "bars", "signs", "spaces", "word_has_sign", "word_all_upper", "distinct_words", "same_as_before", "common_word",
    "distinct_pairs", "log_lines", "distinct_lines", "words_per_line", "words_per_stop", "no_text",
)

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[ord("|")] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
_KIND[[0x20, *range(9, 14)]] = 8


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the ragged keys: how many differ, and how often its most frequent one occurs."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(fresh)
    most = np.zeros(rows)
    np.maximum.at(most, r[begin], np.diff(begin, append=len(k)))
    return np.bincount(r[begin], minlength=rows).astype(float), most


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    rows, size = len(offs) - 1, np.diff(offs).astype(float)
    per_byte = 1.0 / np.maximum(size, 1)
    kind = _KIND[buf]
    share = [_sums(kind == k, offs) * per_byte for k in range(1, 9)]
    s, e, first = C.word_spans(buf, offs)
    n = np.diff(first).astype(float)
    per_word = 1.0 / np.maximum(n, 1)
    length = (e - s).astype(float)
    mean = _sums(length, first) * per_word
    spread = np.sqrt(np.maximum(_sums(length**2, first) * per_word - mean**2, 0))
    if len(s):
        signs = np.concatenate([[0], np.cumsum((kind == 6) | (kind == 7) | (buf == ord("!")), dtype=np.int64)])
        upper = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int64)])
        lower = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int64)])
        has_sign = signs[e] > signs[s]
        all_upper = (upper[e] - upper[s] > 1) & (lower[e] == lower[s])
        h, _ = C.word_hashes(buf, s, e, both=False)
        before = np.zeros(len(h), bool)
        before[1:] = h[1:] == h[:-1]
        before[first[:-1][n > 0]] = False
        distinct, most = _distinct(h, first)
        pairs = h.copy()
        pairs[:-1] = C.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        last = first[1:][n > 0] - 1  # a text's last word has no partner, whatever text comes next
        pairs[last] = h[last]
        pairs_distinct, _ = _distinct(pairs, first)
    else:
        has_sign = all_upper = before = np.zeros(0, bool)
        distinct = most = pairs_distinct = np.zeros(rows)
    line_end = (buf == 10).astype(np.int64)
    lines = _sums(line_end, offs) + 1
    # a line's hash is of all its bytes
    starts = np.unique(np.concatenate([offs[:-1][size > 0], np.flatnonzero(buf[:-1] == 10) + 1])) if len(buf) else np.zeros(0, np.int64)
    if len(starts):
        stops = np.append(starts[1:], len(buf))
        h_line, _ = C.word_hashes(buf, starts, stops, both=False)
        line_distinct, _ = _distinct(h_line, np.searchsorted(starts, offs))
    else:
        line_distinct = np.ones(rows)
    stops_n = _sums(np.isin(buf, np.frombuffer(b".!?", np.uint8)), offs)
    out = np.stack([
        np.log1p(size), np.log1p(n), mean, spread, _sums(length > 20, first) * per_word, _sums(length <= 3, first) * per_word,
        share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        _sums(has_sign, first) * per_word, _sums(all_upper, first) * per_word, distinct * per_word, _sums(before, first) * per_word, most * per_word,
        pairs_distinct * per_word, np.log1p(lines), line_distinct / lines, np.log1p(n / lines), np.log1p(n / (stops_n + 1)), (n == 0).astype(float),
    ], axis=1)
    return out


# ---------------------------------------------------------------- model


def _inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    # squares let a linear strength fall on both sides of a usual value
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z**2 / 4], axis=1)


def _strength(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows have equal strengths wherever they stand."""
    return (z * w).sum(axis=1)


def _add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the rows of ``values`` for each key, in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return own, np.add.reduceat(values[order], first, axis=0) if len(own) else values[:0]


def _bins(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A strength's bin, and how far it lies from the bin's centre in widths."""
    at = np.rint(strength / BIN)
    return at.astype(np.int64), strength / BIN - at


def _terms(gap: np.ndarray) -> list[np.ndarray]:
    """Coefficients of the series of log(1 + exp(-d)) around each ``gap``, for d in widths of a bin."""
    p = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
    out, slope, factor = [np.logaddexp(0, -gap)], np.polynomial.Polynomial([-1, 1]), 1.0
    for n in range(1, ORDER + 1):
        factor *= BIN / n
        out.append(slope(p) * factor)
        slope = slope.deriv() * np.polynomial.Polynomial([0, 1, -1])
    return out


def _series(at: np.ndarray, others: np.ndarray, powers: np.ndarray, sign: int) -> np.ndarray:
    """For each bin ``at``, the polynomial in a row's distance from its centre that gives the row's loss against all rows of the other label, from their sums of powers; sign 1 if the row should win."""
    reach = int(max(at.max() - others.min(), others.max() - at.min(), 0))
    terms = _terms(sign * BIN * np.arange(-reach, reach + 1))
    out = np.zeros((len(at), ORDER + 1))
    for i in range(0, len(at), 512):
        gap = at[i : i + 512, None] - others[None] + reach
        for n in range(ORDER + 1):
            split = np.array([comb(n, m) * (-1) ** (n - m) for m in range(n + 1)], float)
            out[i : i + 512, : n + 1] += sign**n * (terms[n][gap] @ (powers[:, n::-1] * split))
    return out


def _losses(total, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> dict:
    """The mean loss of all pairs, and what each bin's rows need to know of the other label."""

    def powers(x, label):
        at, u = _bins(_strength(_inputs(x, mean, scale), w))
        return 2 * at + label, u[:, None] ** np.arange(ORDER + 1)

    keys, sums = total(powers)
    side = keys % 2
    bins, n = [keys[side == v] // 2 for v in (0, 1)], [sums[side == v] for v in (0, 1)]
    series = np.zeros(sums.shape)
    series[side == 1] = _series(bins[1], bins[0], n[0], 1)
    series[side == 0] = _series(bins[0], bins[1], n[1], -1)
    pairs = n[0][:, 0].sum() * n[1][:, 0].sum()
    return {"keys": keys, "series": series, "count": sums[:, 0], "pairs": pairs, "loss": (series[side == 1] * n[1]).sum() / pairs}


def _newton(total, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, here: dict) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the mean loss of all pairs, and its Hessian with the rows of two neighbouring bins at their common centre."""
    size = len(w)
    slopes = here["series"][:, 1:] * np.arange(1, ORDER + 1) / BIN
    wide, count = _add_up(2 * (here["keys"] // 4) + here["keys"] % 2, here["count"][:, None])
    good, bad = wide % 2 == 1, wide % 2 == 0
    p = 1 / (1 + np.exp(-np.clip(2 * BIN * ((wide[good] // 2)[:, None] - (wide[bad] // 2)[None]), -500, 500)))
    curve, weight = p * (1 - p), np.zeros(len(wide))
    weight[good], weight[bad] = curve @ count[bad, 0], count[good, 0] @ curve
    narrow = here["keys"]

    def sums(x, label):
        z = _inputs(x, mean, scale)
        at, u = _bins(_strength(z, w))
        mine = slopes[np.searchsorted(narrow, 2 * at + label)]
        slope = (mine * u[:, None] ** np.arange(ORDER)).sum(axis=1)
        own = np.searchsorted(wide, 2 * (at // 2) + label)
        # keys: the gradient, the rows of the squares, then the wide bins
        bins, inner = _add_up(own + 1 + size, z)
        return np.concatenate([np.arange(size + 1), bins]), np.concatenate([(slope @ z)[None], z.T @ (z * weight[own, None]), inner])

    _, found = total(sums)
    inner = found[1 + size :]
    cross = inner[good].T @ curve @ inner[bad]
    return found[0] / here["pairs"], (found[1 : 1 + size] - cross - cross.T) / here["pairs"]


def fit(total, cut, ridge: float = 1e-4, most_steps: int = 100) -> dict:
    """Weights by Newton steps on the pairwise logistic loss of all pairs, then the cut between the labels as a quantile.

    ``total(step)`` adds up by key what ``step(x, label)`` returns for all rows; ``cut(strength)`` is the cut for a
    function from features to strengths. Weights that still move after ``most_steps`` are an error.
    """
    width = len(FEATURES)
    blank = {"mean": np.zeros(width), "scale": np.ones(width), "w": np.zeros(2 * width), "cut": 0.0, "always": -1}
    kinds, sums = total(lambda x, label: (label, np.concatenate([np.ones((len(x), 1)), x], axis=1)))
    if len(kinds) < 2:
        return blank | {"always": int(kinds[0]) if len(kinds) else 1}
    rows = sums[:, 0].sum()
    mean = sums[:, 1:].sum(axis=0) / rows
    scale = np.sqrt(total(lambda x, label: (np.zeros(len(x), np.int64), (x - mean) ** 2))[1][0] / rows)
    scale[scale < 1e-9] = 1.0
    w = np.zeros(2 * width)
    here = _losses(total, mean, scale, w)
    for _ in range(most_steps):
        grad, hess = _newton(total, mean, scale, w, here)
        grad, at = grad + ridge * w, here["loss"] + ridge / 2 * w @ w
        step = -np.linalg.solve(hess + ridge * np.eye(len(w)), grad)
        gain = -grad @ step
        if np.abs(step).max() < 1e-8 or gain < 1e-15:
            break
        share = 1.0
        while True:
            there = w + share * step
            here = _losses(total, mean, scale, there)
            if here["loss"] + ridge / 2 * there @ there <= at - 1e-4 * share * gain + 1e-14 or share < 1e-6:
                break
            share /= 2
        w = there
    else:
        raise RuntimeError(f"weights did not settle in {most_steps} steps")
    return blank | {"mean": mean, "scale": scale, "w": w, "cut": cut(lambda x: _strength(_inputs(x, mean, scale), w))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Strengths through a logistic link that is ``THRESHOLD`` at the cut."""
    if model["always"] >= 0:
        return np.full(len(x), float(model["always"]))
    strength = _strength(_inputs(x, model["mean"], model["scale"]), model["w"])
    at = np.clip(strength - model["cut"], -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-at))


# ---------------------------------------------------------------- passes over the labelled rows


def _pack(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.float64))])


def _unpack(column: pa.Array, width: int = len(FEATURES)) -> np.ndarray:
    return C.utf8(column)[0].view(np.float64).reshape(len(column), width)


def _labelled(table) -> tuple[np.ndarray, np.ndarray]:
    return _unpack(table.column("x")), table.column("_label").to_numpy(zero_copy_only=False).astype(np.int64)


def _local(x: np.ndarray, label: np.ndarray):
    """``total`` and ``cut`` of ``fit`` over arrays."""

    def cut(strength):
        values = strength(x)
        own, sums = _add_up(np.unique(values, return_inverse=True)[1], np.stack([np.ones(len(x)), np.where(label == 0, 1.0, -1.0)], axis=1))
        rank, hits = np.append(0, np.cumsum(sums[:, 0])), np.append(0, np.cumsum(sums[:, 1]))
        # the quantile of all strengths at which most labels agree with their side
        best = rank[hits == hits.max()]
        return float(np.quantile(values, (best[0] + best[-1]) / 2 / len(x)))

    return lambda step: _add_up(*step(x, label)), cut


def _distributed(rows: DataFrame):
    """``total`` and ``cut`` of ``fit`` over a table (x, _label): what reaches the driver is each task's sums, and one row for each range of strengths."""
    spark = rows.sparkSession

    def total(step):
        def run(batches):
            held = None
            for batch in batches:
                keys, values = _add_up(*step(*_labelled(batch)))
                held = (keys, values) if held is None else _add_up(np.append(held[0], keys), np.concatenate([held[1], values]))
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(held[0]), _pack(held[1])], ["key", "value"])

        found = rows.coalesce(_TASKS).mapInArrow(run, "key long, value binary").toArrow()
        if not found.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        values = found.column("value").combine_chunks()
        return _add_up(found.column("key").to_numpy(), _unpack(values, len(values[0].as_py()) // 8))

    def cut(strength):
        def run(batches):
            for batch in batches:
                x, label = _labelled(batch)
                yield pa.RecordBatch.from_arrays([pa.array(strength(x)), pa.array(np.where(label == 0, 1, -1))], ["strength", "net"])

        values = rows.mapInArrow(run, "strength double, net long").groupBy("strength").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("net"))
        held, path = C.save(values.repartitionByRange(C.partitions(spark), "strength").withColumn("_part", F.spark_partition_id()), "strengths")
        upto = Window.partitionBy("_part").orderBy("strength").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = held.select("_part", "strength", "n", "net", F.sum("n").over(upto).alias("rank"), F.sum("net").over(upto).alias("hits"))
        ranges = ranked.groupBy("_part").agg(F.sum("n").alias("n"), F.sum("net").alias("net"), F.max(F.struct("hits", -F.col("rank"))).alias("first"), F.max(F.struct("hits", "rank")).alias("last")).collect()
        # (labels that agree, rank) of no row below the cut, and of the first and last best place in each range
        places, begins, n, net = [(0, 0)], [], 0, 0
        for r in sorted(ranges, key=lambda r: r["_part"]):
            places += [(net + r["first"][0], n - r["first"][1]), (net + r["last"][0], n + r["last"][1])]
            begins.append((r["_part"], n))
            n, net = n + r["n"], net + r["net"]
        best = [rank for hits, rank in places if hits == max(places)[0]]
        place = (min(best) + max(best)) / 2 / n * (n - 1)
        low = int(place)
        wanted = [next((part, k - begin) for part, begin in reversed(begins) if begin <= k) for k in (low, min(low + 1, n - 1))]
        a, b = ranked.where(F.col("_part").isin([part for part, _ in wanted])).agg(*[F.min(F.when((F.col("_part") == part) & (F.col("rank") > k), F.col("strength"))).alias(f"v{i}") for i, (part, k) in enumerate(wanted)]).first()
        C.drop(spark, path)
        return a + (b - a) * (place - low)

    return total, cut


def _featurise(model):
    """Over rows with a column text: the features of the text (``x``), or with a model its score, in the place of the text."""

    def run(batches):
        for batch in batches:
            buf, offs = C.utf8(batch.column("text"))
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            for i, j in C.slices(offs, FEATURE_BYTES):
                x = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                value = _pack(x) if model is None else pa.array(score(model.value, x))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), value], [*(batch.schema.names[k] for k in rest), "x" if model is None else "score"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out and the features of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_featurise(None), "doc_id long, held_out boolean, x binary")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _learn(rows: DataFrame, labels: DataFrame, local_rows: int) -> dict:
    spark = rows.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)").where(~held_out(F.col("_id")))
    # one row for each id, however many documents or labels repeat it; the copies of an id meet before the shuffle
    own = rows.where("NOT held_out AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("x").alias("x"))
    found, path, seen = C.save_counted(own.join(usable.groupBy("_id").agg(F.min("_label").alias("_label")), "_id").select("x", "_label"), "labelled")
    model = fit(*(_local(*_labelled(found.toArrow().combine_chunks())) if seen["rows"] <= local_rows else _distributed(found)))
    C.drop(spark, path)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_rows: int = LOCAL_ROWS) -> dict:
    """Fit on all labelled rows that are not held out, and on all their pairs. Of documents that repeat a labelled id the one with the least features (as bytes) counts, of labels that repeat an id the lower."""
    return _learn(_rows(docs.where(~held_out(F.col(id_col))), id_col, text_col), labels, local_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Score every text: doc_id, held_out, score, predicted.

    The label, the language, the source and the id are never inputs of a score. Null and empty texts are scored like
    any text without words; equal texts get equal scores; labels with null or other values are ignored; without usable
    labels of both kinds every text gets the one kind there is (1 if none). An empty table gives an empty result;
    other columns are ignored. A null id is not held out. The features of every text are computed once and kept in the
    shared folder.
    """
    rows, _ = C.save(_rows(docs, id_col, text_col), "features")
    model = docs.sparkSession.sparkContext.broadcast(_learn(rows, labels, local_rows))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score(model.value, _unpack(batch.column("x"))))], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_featurise(model), f"_row {kind}, score double").where(F.col("score") >= THRESHOLD).select("_row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
