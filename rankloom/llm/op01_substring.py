"""Substring deduplication: windows of words, a count-min prefilter and an exact second pass.

1. A window's anchor is the least hash of the shorter runs of words in it, so that equal windows have equal anchors
   and a window occurs at most as often as its anchor. Neighbouring windows mostly share one. Every partition adds
   its anchors to a count-min sketch. Only the touched cells travel, as gap coded lists by block of cells; a block's
   lists are merged by adding counts, which stop at two.
2. The merged sketch is kept as one bit a cell, "two or more". It has about eight cells for each anchor that the counted
   bytes of text let expect, up to a bound, so it may be broadcast. It overestimates: the anchor of a window that occurs twice has all its bits set.
3. The second pass looks all windows up and sends only those estimated repeated, dealt by their anchor, to be grouped
   exactly by 104 bits. Windows that occur twice within one chunk are known to be repeated; one row of such a window
   travels, however often it occurs, so a hot passage never meets in one task.
4. The positions found go back to their documents, whose covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

WINDOW = 35
#: Rows of the sketch, and the least and most cells of each: 2 x 2**29 bits are 128 MB when broadcast.
DEPTH, LOG_CELLS = 2, (16, 29)
#: Bytes of text for each cell, and of text whose candidates meet in one group at most on average.
_BYTES_A_CELL, _BYTES_A_GROUP = 7, 256 << 20
#: Runs of words in a window, of which the least is the anchor (a power of two).
_RUNS = 16
_LOG_BLOCK = 18
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Windows that are gathered before cells or candidates are passed on.
_FLUSH = 2_000_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        buf, offs = C.utf8(batch.column("text"))
        for i, j in C.slices(offs):
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _anchors(h1: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For a window from each word on: the hash of its least run of words, and where the first such run begins."""
    runs = min(_RUNS, 1 << (width.bit_length() - 1))
    value = C.run_hashes(h1, width - runs + 1, _BASES[2])
    spot = np.arange(len(value))
    step = 1
    while step < runs:
        later = value[step:] < value[:-step]
        spot = np.where(later, spot[step:], spot[:-step])
        value = np.minimum(value[step:], value[:-step])
        step *= 2
    return value, spot


def _windows(buf: np.ndarray, offs: np.ndarray, width: int, hashes: bool = True) -> tuple[np.ndarray, ...]:
    """For each window that lies in one text: anchor, whether the anchor is another one than the window's before it, its
    text's row, its first word's place there and, on request, two hashes."""
    s, e, first = C.word_spans(buf, offs)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    none = np.zeros(0, np.uint64)
    if not counts.sum():
        return none, np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64), none, none
    row, place = C.ragged(counts)
    at = first[row] + place
    h1, h2 = C.word_hashes(buf, s, e, hashes)
    anchor, spot = _anchors(h1, width)
    new = np.diff(spot[at], prepend=-1) != 0
    if not hashes:
        return anchor[at], new, row, place, none, none
    return anchor[at], new, row, place, C.run_hashes(h1, width, _BASES[0])[at], C.run_hashes(h2, width, _BASES[1])[at]


def _cells(anchor: np.ndarray, row: int, log_cells: int) -> np.ndarray:
    """The cell of each anchor in a row of the sketch."""
    return (C.mix(anchor + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - log_cells)).astype(np.uint32)


# ---------------------------------------------------------------- first pass: sketch


def _pack(cells: np.ndarray) -> bytes:
    """Sorted places within a block, as gaps in three byte planes (the shuffle's compression removes the empty ones)."""
    gaps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(gaps[:, :3].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.uint32)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16, dtype=np.int64)


def _sketch(width: int, depth: int, log_cells: int):
    log_block = min(_LOG_BLOCK, log_cells)

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        blocks, once, more = [], [], []
        for row, parts in enumerate(held):
            if not parts:
                continue
            cells = np.sort(np.concatenate(parts))
            fresh = np.flatnonzero(np.diff(cells, prepend=np.int64(-1)))
            count = np.diff(fresh, append=len(cells))
            cells = cells[fresh]
            edges = np.searchsorted(cells, np.arange((1 << (log_cells - log_block)) + 1, dtype=np.int64) << log_block)
            for b in np.flatnonzero(np.diff(edges)):
                own, n = cells[edges[b] : edges[b + 1]].astype(np.int64) - (int(b) << log_block), count[edges[b] : edges[b + 1]]
                blocks.append((row << (log_cells - log_block)) + int(b))
                once.append(_pack(own[n == 1]))
                more.append(_pack(own[n > 1]))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), C.binary(once), C.binary(more)], ["block", "once", "more"])

    def run(batches):
        held, n = [[] for _ in range(depth)], 0
        for _, buf, offs in _chunks(batches):
            anchor, new, *_ = _windows(buf, offs, width, False)
            anchor = anchor[new]
            for row in range(depth):
                held[row].append(_cells(anchor, row, log_cells))
            n += len(anchor)
            if n >= _FLUSH:
                yield from flush(held)
                held, n = [[] for _ in range(depth)], 0
        if n:
            yield from flush(held)

    return run


def _merge(log_cells: int):
    """Adds the lists of a block and leaves one bit a cell."""
    size = 1 << min(_LOG_BLOCK, log_cells)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint8)
        for batch in batches:
            for once, more in zip(batch.column("once"), batch.column("more"), strict=True):
                at = _unpack(once.as_buffer())
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[_unpack(more.as_buffer())] = 2
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), C.binary([np.packbits(counts > 1, bitorder="little").tobytes()])], ["block", "bits"])

    return run


def repeated_cells(texts: DataFrame, width: int = WINDOW, depth: int = DEPTH, log_cells: int = LOG_CELLS[1]) -> np.ndarray:
    """The merged sketch as bits (``depth`` rows of ``2**log_cells``): set where the count is two or more.

    Blocks are merged side by side, each from a stream of lists. What reaches the driver has
    ``depth * 2**log_cells / 8`` bytes at any input size.
    """
    lists = texts.mapInArrow(_sketch(width, depth, log_cells), "block int, once binary, more binary")
    rows = lists.groupBy("block").applyInArrow(_merge(log_cells), "block int, bits binary")
    size = 1 << min(_LOG_BLOCK, log_cells)
    bits = np.zeros(depth * (1 << log_cells) // 8, np.uint8)
    for batch in rows.toArrow().to_batches():
        for block, own in zip(batch.column("block").to_pylist(), batch.column("bits"), strict=True):
            bits[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(own.as_buffer(), np.uint8)
    return bits


# ---------------------------------------------------------------- second pass: exact groups

#: Kinds of messages to a bucket: windows that ask, windows known to be repeated, and places found already.
_ASK, _SAY, _TOLD = 0, 1, 2
_MESSAGES = "bucket int, kind int, docs binary, entries binary"
#: Bits of the second hash that travel: with the first they make 104.
_SECOND = 40


def _planes(values: np.ndarray, width: int) -> bytes:
    """Integers as ``width`` byte planes, low bytes first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = data.reshape(width, n).T
    return out.view("<u8").ravel()


def _pack_hashes(h1: np.ndarray, h2: np.ndarray) -> bytes:
    return h1.astype("<u8").tobytes() + _planes(h2, _SECOND // 8)


def _unpack_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return data[: 8 * n].view("<u8"), _unplanes(data[8 * n : (8 + _SECOND // 8) * n], n, _SECOND // 8)


def _estimate(bits: np.ndarray, anchor: np.ndarray, new: np.ndarray, depth: int, log_cells: int) -> np.ndarray:
    """Indexes of the windows whose anchors the sketch counts twice or more."""
    own = anchor[new]
    often = np.ones(len(own), bool)
    for row in range(depth):
        cell = _cells(own, row, log_cells).astype(np.int64) + (row << log_cells)
        often &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return np.flatnonzero(often[np.cumsum(new) - 1]) if len(own) else np.zeros(0, np.int64)


def _equal_runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where in it a new pair begins."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = a[1:] == a[:-1]
    return order, np.concatenate([[True], ~(same & (b[1:] == b[:-1]))]) if len(order) else np.zeros(0, bool)


def _runs(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(doc, prepend=-1))


def _docs_table(doc: np.ndarray, keys: np.ndarray) -> bytes:
    """Runs of equal documents: both halves of the key and the run's length."""
    begin = _runs(doc)
    table = np.empty((len(begin), 3), "<i8")
    table[:, :2] = keys[doc[begin]]
    table[:, 2] = np.diff(begin, append=len(doc))
    return table.tobytes()


def _pack_places(place: np.ndarray, doc: np.ndarray) -> bytes:
    """Ascending places of each run of a document, as gaps that begin anew with each."""
    gap = np.diff(place, prepend=0)
    begin = _runs(doc)
    gap[begin] = place[begin]
    return _planes(gap, 4)


def _unpack_places(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    gap = _unplanes(data, int(lengths.sum()), 4).astype(np.int64)
    total = np.cumsum(gap)
    begin = np.cumsum(lengths) - lengths
    return (total - np.repeat(total[begin] - gap[begin], lengths)).astype("<u4")


def _candidates(bits, width: int, depth: int, log_cells: int, buckets: int):
    def flush(held) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, place, anchor = (np.concatenate([x[k] for x in held]) for k in range(5))
        w2 = w2 >> np.uint64(64 - _SECOND)
        keys = np.concatenate([x[5] for x in held])
        if not len(w1):
            return
        order, fresh = _equal_runs(w1, w2)
        group = np.cumsum(fresh) - 1
        many = np.bincount(group) > 1
        known = np.zeros(len(w1), bool)
        known[order] = many[group]
        out = []
        # windows repeated within the chunk: their documents are told at once
        at = np.flatnonzero(known)
        if len(at):
            begin = np.flatnonzero(np.diff(doc[at], prepend=-1))
            for a, b in zip(begin, np.append(begin[1:], len(at)), strict=True):
                key = keys[doc[at[a]]]
                out.append((int(key[0] % buckets), _TOLD, key.astype("<i8").tobytes(), place[at[a:b]].astype("<u4").tobytes()))
        # one entry of each distinct window travels; a repeated one has no document and only says so
        asks = np.sort(order[fresh])
        for kind, own_kind in ((_ASK, asks[~known[asks]]), (_SAY, asks[known[asks]])):
            target = (anchor[own_kind] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            edges = np.searchsorted(target[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = own_kind[by[edges[b] : edges[b + 1]]]
                hashes = _pack_hashes(w1[own], w2[own])
                out.append((int(b), kind, _docs_table(doc[own], keys), hashes + _pack_places(place[own], doc[own])) if kind == _ASK else (int(b), kind, b"", hashes))
        for i in range(0, len(out), 2000):
            part = out[i : i + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()), C.binary([x[2] for x in part]), C.binary([x[3] for x in part])], ["bucket", "kind", "docs", "entries"])

    def run(batches):
        sketch = bits.value
        held, n, docs = [], 0, 0
        for batch, buf, offs in _chunks(batches):
            anchor, new, row, place, w1, w2 = _windows(buf, offs, width)
            live = _estimate(sketch, anchor, new, depth, log_cells)
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")], axis=1)
            held.append((w1[live], w2[live], row[live] + docs, place[live], anchor[live], keys))
            docs += len(keys)
            n += len(live)
            if n >= _FLUSH // 2:
                yield from flush(held)
                held, n, docs = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _exact(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups the windows of a bucket and answers by document."""
    k1, k2, found = [], [], []
    hashes, places, tables, said = [], [], [], []
    for batch in batches:
        for kind, docs, data in zip(batch.column("kind").to_pylist(), batch.column("docs"), batch.column("entries"), strict=True):
            if kind == _TOLD:
                own = np.frombuffer(docs.as_buffer(), "<i8")
                k1.append(int(own[0]))
                k2.append(int(own[1]))
                found.append(data.as_py())
                continue
            raw = np.frombuffer(data.as_buffer(), np.uint8)
            if kind == _SAY:
                said.append(_unpack_hashes(raw, len(raw) // (8 + _SECOND // 8)))
            else:
                table = np.frombuffer(docs.as_buffer(), "<i8").reshape(-1, 3)
                n = int(table[:, 2].sum())
                hashes.append(_unpack_hashes(raw, n))
                places.append(_unpack_places(raw[(8 + _SECOND // 8) * n :], table[:, 2]))
                tables.append(table)
    if hashes:
        asking = sum(len(x[0]) for x in hashes)
        order, fresh = _equal_runs(*(np.concatenate([x[k] for x in hashes + said]) for k in (0, 1)))
        group = np.cumsum(fresh) - 1
        yes = np.zeros(len(order), bool)
        yes[order] = (np.bincount(group) > 1)[group]
        at = np.flatnonzero(yes[:asking])
        if len(at):
            table, spots = np.concatenate(tables), np.concatenate(places)[at]
            run = np.repeat(np.arange(len(table)), table[:, 2])[at]
            begin = _runs(run)
            own = table[run[begin]]
            k1 += own[:, 0].tolist()
            k2 += own[:, 1].tolist()
            found += [spots[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(at)), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), C.binary(found)], ["k1", "k2", "places"])


# ---------------------------------------------------------------- removal


def _remove(width: int, keep_text: bool):
    def run(batches):
        for batch, buf, offs in _chunks(batches):
            s, e, first = C.word_spans(buf, offs)
            rows, n_words = len(batch), np.diff(first)
            edge = np.zeros(len(s) + 1, np.int32)
            for i, lists in enumerate(batch.column("places").to_pylist()):
                for own in lists or ():
                    at = np.frombuffer(own, "<u4").astype(np.int64) + first[i]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) if rows else np.zeros(0, np.int64)
            removed[n_words == 0] = 0
            keep = ~gone
            length = (e - s)[keep] + 1
            kept = C.gather_spans(np.append(buf, np.uint8(32)), s[keep], length)
            ends = np.cumsum(length)
            kept[ends - 1] = 32
            last = np.append(0, ends)[np.append(0, np.cumsum(n_words - removed))]
            view = memoryview(kept)
            texts = [view[a : max(a, b - 1)] for a, b in zip(last[:-1], last[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([str(x, "utf-8") for x in texts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, depth: int = DEPTH, log_cells: int | None = None, keep_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts elsewhere, in any document.

    Windows are judged on the input. Equality of windows is that of 104 bits of two independent hashes of their words.
    Null and empty texts have no words; texts shorter than the window lose nothing; repeated rows are each other's
    copies; an empty table gives an empty result; other columns are ignored, whatever their names. A single text is
    worked on whole, so a Python worker's memory grows with the longest text, else with the chunk size only. ``log_cells``
    sets the size of the sketch; without it the bytes of all texts do, within ``LOG_CELLS``.

    Returns doc_id, n_words, n_removed, kept_sha256 and, on request, kept_text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    buckets = max(2 * C.partitions(spark), total // _BYTES_A_GROUP)
    if log_cells is None:
        log_cells = min(max((total // _BYTES_A_CELL).bit_length(), LOG_CELLS[0]), LOG_CELLS[1])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text")})
    bits = spark.sparkContext.broadcast(repeated_cells(rows.select("text"), width, depth, log_cells))
    found = keyed.select("k1", "k2", "text").mapInArrow(_candidates(bits, width, depth, log_cells, buckets), _MESSAGES)
    answers = found.groupBy("bucket").applyInArrow(_exact, "k1 long, k2 long, places binary")
    by_doc = answers.groupBy("k1", "k2").agg(F.collect_list("places").alias("places"))
    joined = keyed.join(by_doc, ["k1", "k2"], "left").select("doc_id", "text", "places")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return joined.mapInArrow(_remove(width, keep_text), out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
