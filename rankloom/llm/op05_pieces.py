"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and their decoding.

The lattice of a text has an arc for each vocabulary piece that fits; a character without a piece of its own goes by
its bytes. No piece has a space after another character and none holds a control separator, so the lattice falls
apart into chunks (a run of spaces with the characters up to the next space) and the distribution over whole texts is the
product of the chunks'. Forward sums are computed once for each distinct chunk; every occurrence then samples its
path from the end, with numbers that depend on the row's key, the chunk's place and the step only.

A piece's weight is ``(1 + rank) ** -sharpness`` with its merge rank (the negated score of a BPE model).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

SEED, SHARPNESS = 42, 1.0
#: Bytes of text whose lattices are held at once: a worker needs 200 times as much or more.
LATTICE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """A vocabulary as a trie with hashed transitions, and the sampler over it."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_id = np.full(256, -1, np.int64)
        spelled: list[bytes] = [b""] * n
        children: dict[int, int] = {}
        piece_of, states = [-1], 1
        weight = np.zeros(n)
        for i in range(n):
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                b = int(text[3:5], 16)
                self.bytes_id[b], spelled[i] = i, bytes([b])
                continue
            spelled[i] = text.replace("▁", " ").encode()
            weight[i] = -sharpness * np.log1p(max(-model.get_score(i), 0.0))
            state = 0
            for b in spelled[i]:
                key = state << 8 | b
                if key not in children:
                    children[key] = states
                    piece_of.append(-1)
                    states += 1
                state = children[key]
            piece_of[state] = i
        if np.any(self.bytes_id < 0):
            raise ValueError("the vocabulary has no byte fallback")
        self.weight, self.piece_of = weight, np.array(piece_of, np.int64)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.length) - self.length
        # open addressing with linear probing
        self.bits = max(16, (4 * len(children)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int64)
        for key, state in children.items():
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & (1 << self.bits) - 1
            self.keys[at], self.next[at] = key, state

    def _go(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state << 8 | byte
        at = (key.astype(np.uint64) * _STEP >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        live = np.arange(len(key))
        while len(live):
            found = self.keys[at[live]]
            hit = found == key[live]
            out[live[hit]] = self.next[at[live[hit]]]
            live = live[~hit & (found >= 0)]
            at[live] = (at[live] + 1) & (1 << self.bits) - 1
        return out

    def _arcs(self, buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every arc over chunks laid end to end; ``edge`` has their borders."""
        stop = np.repeat(edge[1:], np.diff(edge))
        lead = (buf & 0xC0) != 0x80
        lead[edge[:-1]] = True
        # a character's bytes: from its lead to the next lead
        leads = np.flatnonzero(lead)
        char_end = np.append(leads[1:], len(buf))
        ends_at = np.zeros(len(buf) + 1, bool)
        ends_at[char_end] = True
        starts, ends, pieces = [], [], []
        state, at, n = np.zeros(len(leads), np.int64), leads, 0
        alone = np.zeros(len(buf), bool)
        while len(at):
            state = self._go(state, buf[at + n].astype(np.int64))
            n += 1
            ok = state >= 0
            state, at = state[ok], at[ok]
            piece = self.piece_of[state]
            whole = (piece >= 0) & ends_at[at + n]
            starts.append(at[whole])
            ends.append(at[whole] + n)
            pieces.append(piece[whole])
            more = at + n < stop[at]
            state, at = state[more], at[more]
        s, e, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        length_of = np.zeros(len(buf), np.int64)
        length_of[leads] = char_end - leads
        alone[s[e - s == length_of[s]]] = True
        own = ~np.repeat(alone[leads], char_end - leads)
        raw = np.flatnonzero(own)
        return np.concatenate([s, raw]), np.concatenate([e, raw + 1]), np.concatenate([p, self.bytes_id[buf[raw]]])

    def forward(self, buf: np.ndarray, edge: np.ndarray):
        """For each node (a place after a byte): its incoming arcs and their cumulative probabilities."""
        s, e, p = self._arcs(buf, edge)
        begin = np.repeat(edge[:-1], np.diff(edge))  # of each byte's chunk
        depth = e - begin[e - 1]
        order = np.lexsort((s, e, depth))
        s, e, p, depth = s[order], e[order], p[order], depth[order]
        total = np.full(len(buf) + 1, -np.inf)
        lw = self.weight[p]
        chance = np.empty(len(s))
        # the sum at a chunk's start is 1; a chunk's last node is the next one's start, so ends are kept apart
        level = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
        at_start = s == begin[np.minimum(s, len(buf) - 1)]
        for a, b in zip(level[:-1], level[1:], strict=True):
            value = np.where(at_start[a:b], 0.0, total[s[a:b]]) + lw[a:b]
            node = e[a:b]
            fresh = np.flatnonzero(np.diff(node, prepend=-1))
            top = np.maximum.reduceat(value, fresh)
            count = np.diff(fresh, append=b - a)
            top = np.where(np.isfinite(top), top, 0.0)
            part = np.exp(value - np.repeat(top, count))
            sums = np.add.reduceat(part, fresh)
            with np.errstate(divide="ignore", invalid="ignore"):
                total[node[fresh]] = top + np.log(sums)
                chance[a:b] = part / np.repeat(sums, count)
        by_node = np.lexsort((s, e))
        s, e, p, chance = s[by_node], e[by_node], p[by_node], chance[by_node]
        fresh = np.flatnonzero(np.diff(e, prepend=-1))
        # summed within each node alone, so that no draw depends on what else is in the buffer
        cumulative, count, k = chance, np.diff(fresh, append=len(e)), 1
        while len(at := fresh[count > k] + k):
            cumulative[at] += cumulative[at - 1]
            k += 1
        last = np.append(fresh[1:], len(e)) - 1
        cumulative[last] = 2.0
        first_arc = np.full(len(buf) + 1, -1, np.int64)
        first_arc[e[fresh]] = fresh
        return s, p, cumulative, first_arc

    def sample(self, buf: np.ndarray, offs: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has; ``key`` seeds each text's draws."""
        filled = np.diff(offs) > 0
        # a space goes before every text, as the vocabulary expects
        shift = np.cumsum(filled)
        out = np.full(len(buf) + int(filled.sum()), 32, np.uint8)
        out[np.arange(len(buf)) + np.repeat(shift, np.diff(offs))] = buf
        text_at = np.append(offs[:-1] + shift - filled, len(out))
        if not len(out):
            return np.zeros(0, np.int64), np.zeros(len(filled), np.int64)
        space = out == 32
        control = C.SEPARATOR[out] & ~space
        cut = np.zeros(len(out), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | control[1:] | control[:-1]
        cut[text_at[:-1][filled]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(out))
        row = np.searchsorted(text_at, s, side="right") - 1
        place = np.arange(len(s)) - np.searchsorted(s, text_at)[row]
        h1, h2 = C.word_hashes(out, s, e)
        _, example, inverse = np.unique(h1, return_index=True, return_inverse=True)
        if np.any(h2[example][inverse] != h2):
            _, example, inverse = np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        size = (e - s)[example]
        edge = np.append(0, np.cumsum(size))
        arc_from, arc_piece, cumulative, first_arc = self.forward(C.gather_spans(out, s[example], size), edge)
        node, goal = edge[1:][inverse], edge[:-1][inverse]
        seed = C.mix(key[row] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        live, steps = np.arange(len(s)), []
        taken = np.zeros(len(s), np.int64)
        while len(live):
            seed[live] += _STEP
            draw = (C.mix(seed[live]) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            arc = first_arc[node[live]]
            open_ = np.flatnonzero(draw >= cumulative[arc])
            while len(open_):
                arc[open_] += 1
                open_ = open_[draw[open_] >= cumulative[arc[open_]]]
            steps.append((live, arc_piece[arc]))
            taken[live] += 1
            node[live] = arc_from[arc]
            live = live[node[live] != goal[live]]
        end = np.cumsum(taken)
        ids = np.empty(int(end[-1]), np.int64)
        for k, (who, piece) in enumerate(steps):
            ids[end[who] - 1 - k] = piece
        return ids, np.bincount(row, weights=taken, minlength=len(filled)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts that rows of ids spell, without the space before each."""
        length = self.length[ids]
        data = C.gather_spans(self.spelled, self.first[ids], length)
        edge = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
        filled = np.diff(edge) > 0
        keep = np.ones(len(data), bool)
        keep[edge[:-1][filled]] = False
        return data[keep], edge - np.append(0, np.cumsum(filled))


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, sharpness: float) -> Lattice:
    """One lattice for each Python worker and vocabulary."""
    if (path, sharpness) not in _lattices:
        _lattices[path, sharpness] = Lattice(path, sharpness)
    return _lattices[path, sharpness]


_OUT = "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, lossless boolean"


def _segment(path: str, seed: int, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]):
        own = lattice(path, sharpness)
        for batch in batches:
            buf, offs = C.utf8(batch.column("text"))
            names = batch.column("doc_id")
            key = names.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).view(np.uint64)
            key = C.mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
            for i, j in C.slices(offs, LATTICE_BYTES):
                text, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ids, counts = own.sample(text, at, key[i:j])
                back, back_at = own.decode(ids, counts)
                same = np.array_equal(back, text) and np.array_equal(back_at, at)
                view, whole = memoryview(np.ascontiguousarray(back)), memoryview(np.ascontiguousarray(text))
                spans = list(zip(back_at[:-1].tolist(), back_at[1:].tolist(), strict=True))
                lossless = [True] * (j - i) if same else [bytes(view[a:b]) == bytes(whole[x:y]) for (a, b), x, y in zip(spans, at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, j - i), pa.array(counts), lists, pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in spans]), pa.array(lossless)],
                    ["doc_id", "n_pieces", "ids", "decoded_sha256", "lossless"])

    return run


def sample_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """One sampled segmentation of every whole text, decoded again.

    The draws depend on ``seed`` and the id, so a row's pieces are the same in any partitioning and after any retry;
    rows with the same id and text get the same pieces, a null id counts as one fixed key. Null and empty texts have
    no pieces. A literal U+2581 goes by its bytes, so decoding gives every text back. An empty table gives an empty
    result; other columns are ignored. Texts are not shuffled; memory grows with the longest text.

    Returns doc_id, n_pieces, ids, decoded_sha256 (of the decoded text), lossless.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_segment(model, seed, sharpness), _OUT)


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sample_pieces(C.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
