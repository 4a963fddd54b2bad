"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so the items are partitioned by size and
each partition searches passages of its own scale: for items of up to ``u`` shingles, overlapping windows of ``1.5 u``
shingles, one of which holds any run of ``u``. Windows are compared by MinHash: containment ``t`` of an item with
more than ``u / 2`` shingles means a similarity of at least ``0.5 t / (1.5 + 0.5 (1 - t))`` with that window (0.25
at 0.8), so a window is missed with the probability that none of ``COORDINATES`` minima agree, one in a million.
Block minima are computed once at the finest scale and combined for the coarser ones. An item whose shingles lie
scattered over more than a window is found by an exact bound: at containment ``t`` a document holds one of any
``n - ceil(t n) + 1`` of the item's ``n`` shingles, and those that the fewest items share are looked up. Candidates
are verified by the exact containment of the item's shingles, as words, in the whole document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

SHINGLE, CONTAINMENT, COORDINATES = 5, 0.8, 48
#: Most items, and about the most bytes of them, that are broadcast at a time; more go in further passes over the documents.
ITEM_BLOCK, ITEM_BYTES = 5000, 16 << 20
#: Bits of a shingle's hash that are looked up in a table before the sorted shingles.
_MARK_BITS = 20
_BASE = 0xA0761D6478BD642F
_rng = np.random.default_rng(510)
_MUL = (_rng.integers(0, 1 << 31, 256, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)


def _shingle_hashes(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order and each text's first one; a text of fewer words is one shingle."""
    s, e, first = C.word_spans(buf, offs)
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(counts)])
    if not edge[-1]:
        return np.zeros(0, np.uint64), edge
    h, _ = C.word_hashes(buf, s, e, both=False)
    row, place = C.ragged(counts)
    runs = C.run_hashes(h, size, _BASE)
    at = first[row] + place
    out = runs[np.minimum(at, max(len(runs) - 1, 0))] if len(runs) else np.zeros(len(at), np.uint64)
    for n in range(1, size):
        own = np.flatnonzero(words[row] == n)
        if len(own):
            out[own] = C.run_hashes(h, n, _BASE)[at[own]]
    return out, edge


def _shingle_words(raw: bytes, size: int) -> set[bytes]:
    """The shingles of a lower-cased text, as words."""
    words = raw.split()  # bytes are split at the space and 0x09 to 0x0D only
    if not words:
        return set()
    if len(words) < size:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _scale(n: int) -> int:
    """The least power of two that is not under n."""
    return 1 << (n - 1).bit_length()


class ItemIndex:
    """Signatures of a bounded block of items by size partition."""

    def __init__(self, items: list[tuple[object, str]], size: int, coordinates: int, least: float):
        self.ids, self.sets, self.hashes = [], [], []
        by_scale: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for name, text in items:
            raw = C.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            shingles, _ = _shingle_hashes(raw, np.array([0, len(raw)]), size)
            own = np.unique(shingles)
            if len(own):
                low = own.astype(np.uint32)
                sig = ((low[None, :] ^ _XOR[:coordinates, None]) * _MUL[:coordinates, None]).min(axis=1)
                by_scale[_scale(len(own))].append((len(self.ids), sig))
                self.ids.append(name)
                self.sets.append(_shingle_words(raw.tobytes(), size))
                self.hashes.append(own)
        self.scales = {}
        for u, own in sorted(by_scale.items()):
            number = np.array([i for i, _ in own])
            sig = np.stack([s for _, s in own])
            marks = np.zeros((coordinates, 1 << 16), bool)
            marks[np.arange(coordinates)[None, :], sig & 0xFFFF] = True
            order = np.argsort(sig, axis=0, kind="stable")
            self.scales[u] = (marks, np.take_along_axis(sig, order, 0), number[order])
        self.finest = max(1, min(self.scales, default=2) // 2)
        # of each item the rarest shingles, one of which is in any document that holds enough of it
        known, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.hashes]), return_counts=True)
        rare, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, own in enumerate(self.hashes):
            most = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
            rare.append(own[np.argsort(often[np.searchsorted(known, own)], kind="stable")[:most]])
            item.append(np.full(len(rare[-1]), i))
        order = np.argsort(np.concatenate(rare), kind="stable")
        self.rare, self.rare_item = np.concatenate(rare)[order], np.concatenate(item)[order]
        self.rare_marks = np.zeros(1 << _MARK_BITS, bool)
        self.rare_marks[self.rare >> np.uint64(64 - _MARK_BITS)] = True


def _scattered(index: ItemIndex, shingles: np.ndarray, edge: np.ndarray, least: float, found: set[tuple[int, int]]) -> None:
    """Adds the pairs that share a rare shingle and, by their hashes, enough of the item."""
    hit = np.flatnonzero(index.rare_marks[shingles >> np.uint64(64 - _MARK_BITS)])
    a, b = np.searchsorted(index.rare, shingles[hit], "left"), np.searchsorted(index.rare, shingles[hit], "right")
    hit, a, b = hit[b > a], a[b > a], b[b > a]
    row, place = C.ragged(b - a)
    text = np.searchsorted(edge, hit, "right") - 1
    pairs = np.unique(np.stack([text[row], index.rare_item[a[row] + place]], axis=1), axis=0)
    held, own = -1, shingles[:0]
    for i, k in pairs.tolist():
        if (i, k) not in found:
            if i != held:
                held, own = i, np.unique(shingles[edge[i] : edge[i + 1]])
            x = index.hashes[k]
            if (own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum() >= least * len(x) - 1e-9:
                found.add((i, k))


def _search(index: ItemIndex, buf: np.ndarray, offs: np.ndarray, size: int, coordinates: int, least: float) -> set[tuple[int, int]]:
    """Candidate (text, item) pairs."""
    shingles, edge = _shingle_hashes(buf, offs, size)
    found: set[tuple[int, int]] = set()
    if not len(shingles) or not index.scales:
        return found
    low = shingles.astype(np.uint32)
    counts = np.diff(edge)
    # blocks of each scale: starts in the level below, and the text that a block belongs to
    levels, n_blocks, start_of_text = {}, -(-counts // index.finest), edge[:-1]
    row, place = C.ragged(n_blocks)
    levels[index.finest] = (start_of_text[row] + place * index.finest, row)
    top = max(1, max(index.scales) // 2)
    size_now, blocks_now = index.finest, n_blocks
    while size_now < top:
        first = np.cumsum(blocks_now) - blocks_now
        size_now, blocks_now = 2 * size_now, -(-blocks_now // 2)
        row, place = C.ragged(blocks_now)
        levels[size_now] = (first[row] + 2 * place, row)
    for k in range(coordinates):
        minima = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], levels[index.finest][0])
        step = index.finest
        while True:
            for u in (u for u in index.scales if max(1, u // 2) == step):
                marks, sig, number = index.scales[u]
                text = levels[step][1]
                # a window is three blocks in a row, cut off at the end of its text
                window = minima.copy()
                for shift in (1, 2):
                    if len(window) > shift:
                        same = text[shift:] == text[:-shift]
                        window[:-shift] = np.where(same, np.minimum(window[:-shift], minima[shift:]), window[:-shift])
                near = np.flatnonzero(marks[k][window & 0xFFFF])
                if len(near):
                    a, b = np.searchsorted(sig[:, k], window[near], "left"), np.searchsorted(sig[:, k], window[near], "right")
                    for i, x, y in zip(near[b > a], a[b > a], b[b > a], strict=True):
                        found.update((int(text[i]), int(j)) for j in number[x:y, k])
            if step >= top:
                break
            step *= 2
            minima = np.minimum.reduceat(minima, levels[step][0])
    _scattered(index, shingles, edge, least, found)
    return found


def _matches(index: ItemIndex, buf: np.ndarray, offs: np.ndarray, size: int, coordinates: int, least: float) -> list[tuple[int, int, int]]:
    """Verified (text, item, shared shingles)."""
    by_text = defaultdict(list)
    for text, item in _search(index, buf, offs, size, coordinates, least):
        by_text[text].append(item)
    out = []
    for text, items in sorted(by_text.items()):
        own = _shingle_words(buf[offs[text] : offs[text + 1]].tobytes(), size)
        for item in sorted(items):
            shared = len(index.sets[item] & own)
            if shared >= least * len(index.sets[item]) - 1e-9:
                out.append((text, item, shared))
    return out


def _scan(index, size: int, coordinates: int, least: float, keep: bool):
    def run(batches):
        own = index.value
        for batch in batches:
            buf, offs = C.utf8(batch.column("_text" if keep else "text"))
            for i, j in C.slices(offs):
                found = _matches(own, C.LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], size, coordinates, least)
                if keep:
                    clean = np.ones(j - i, bool)
                    clean[[t for t, _, _ in found]] = False
                    yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, j - i).filter(pa.array(clean))], ["_row"])
                elif found:
                    ids = batch.column("doc_id").slice(i, j - i)
                    n = [len(own.sets[k]) for _, k, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([t for t, _, _ in found])), pa.array([own.ids[k] for _, k, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64()), pa.array(n, pa.int64()), pa.array([s / m for (_, _, s), m in zip(found, n, strict=True)])],
                        ["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return run


def _blocks(items: DataFrame, size: int, coordinates: int, block: int, least: float):
    """Broadcast indexes of at most ``block`` items and about ``ITEM_BYTES`` each."""
    spark = items.sparkSession
    held, used = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text")).orderBy("item_id", "text").toLocalIterator():
        held.append(tuple(r))
        used += len(r[1] or "")
        if len(held) == block or used >= ITEM_BYTES:
            yield spark.sparkContext.broadcast(ItemIndex(held, size, coordinates, least))
            held, used = [], 0
    if held:
        yield spark.sparkContext.broadcast(ItemIndex(held, size, coordinates, least))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = CONTAINMENT, coordinates: int = COORDINATES, block: int = ITEM_BLOCK) -> DataFrame:
    """Every (document, item) of which the document holds at least ``least`` of the item's distinct shingles.

    Words are lower-cased A-Z and separated by [\\x20\\x09-\\x0D]. A text of fewer than ``size`` words is one shingle, so
    such an item is found in equal texts only. An item's shingles may lie anywhere in the document. Null or empty texts and items match nothing; repeated
    documents and items are reported each; empty tables give an empty result; further columns are ignored. Documents
    are not shuffled; a worker's memory grows with the longest text.

    Returns doc_id, item_id, shared, item_shingles, containment; documents that are not listed are clean.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    found = docs.sparkSession.createDataFrame([], out)
    for n, index in enumerate(_blocks(items, size, coordinates, block, least)):
        own = rows.mapInArrow(_scan(index, size, coordinates, least, False), out)
        found = found.unionByName(own) if n else own
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged."""
    size, least, coordinates = options.get("size", SHINGLE), options.get("least", CONTAINMENT), options.get("coordinates", COORDINATES)
    for index in _blocks(items, size, coordinates, options.get("block", ITEM_BLOCK), least):
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
        docs = rows.mapInArrow(_scan(index, size, coordinates, least, True), f"_row {rows.schema['_row'].dataType.simpleString()}").select("_row.*")
    return docs


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


def _sql_shingles(table: str, key: str) -> str:
    return f"""
  SELECT {key}, w, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM ({_sql_shingles('documents', 'doc_id')})),
b AS (SELECT DISTINCT item_id, unnest(s) AS g FROM ({_sql_shingles('benchmark', 'item_id')})),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles) AS containment
FROM b JOIN d USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(item_shingles)
"""
