"""Token ids in binary shards compressed with a Re-Pair grammar.

Documents are dealt by ranges of ascending doc_id; each task writes its shards in order. A shard replaces frequent
id pairs by nonterminals, round by round, and stores the rules with the expansion length of each nonterminal, so
that any document is decoded without its neighbours. A shard is one row (a file of the format below) of a Parquet
table in the shared folder, whose commit makes the write safe against lost executors.

Format, little-endian: magic ``RLTK0002``; first nonterminal uint64; six uint64 (documents, symbols, rules, ids, ids before it in its part,
bits of a symbol, 16 at least); doc_id int64[documents]; has_id uint8[documents]; first symbol uint64[documents]; number of ids
uint64[documents]; rules uint32[rules][2]; expansion lengths uint32[rules]; low halves uint16[symbols]; for
each bit from the 17th on, its values packed by eight.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common as C

END_ID = 1
MAGIC = b"RLTK0002"
#: Ids of a shard; how often a pair must occur to be replaced.
SHARD_IDS, LEAST = 3_000_000, 8
#: Bits of the table that counts pairs, and turns in which overlapping pairs are settled in a round.
_SLOT_BITS, _CHOICES = 21, 3
#: Distinct pieces of text whose ids a worker remembers.
CACHE_WORDS = 1_500_000

# ---------------------------------------------------------------- encoding


#: What a tokenizer's file says if its pieces don't depend on what is beyond white space, or between an
#: ASCII letter and ASCII punctuation.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _independent(config: dict) -> bool:
    """Whether a text's ids are those of its pieces, by the normalizer, the pre-tokenizer and the added tokens.

    Added tokens must begin and end with ``<`` and ``>``, hold no place where texts are cut, and match the raw text.
    """
    normal, before = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    plain = normal.get("normalizers") == _NORMALIZER and before.get("pretokenizers") == [_SPLIT, _BYTES] and not config["truncation"] and not config["model"].get("dropout")
    marks = all(re.fullmatch(r"<\|[A-Za-z0-9]+\|>", x["content"]) and not (x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]) for x in config["added_tokens"])
    return plain and marks


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, each distinct piece of text encoded once.

    The tokenizer lower-cases, drops white space and splits letters from other signs, so a text's ids are those of
    its pieces in order when it is cut at ASCII white space, or between an ASCII letter and ASCII punctuation other
    than the apostrophe. Pieces keep their case, as added tokens match the raw text. A tokenizer whose file says
    otherwise gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_piece = _independent(json.loads(self.library.to_str()))
        self.forget()

    def forget(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of texts; places in the text, which nobody asks for, aren't kept track of."""
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if self.by_piece:
            return self._by_piece(buf, offs)
        raw = buf.tobytes()
        own = self._library_ids([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)])
        return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)

    _LETTER = np.zeros(256, bool)
    _LETTER[[*range(65, 91), *range(97, 123)]] = True
    _SIGN = np.zeros(256, bool)
    _SIGN[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in "'<|>"]] = True

    def _by_piece(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        cut = np.zeros(len(buf) + 1, bool)
        letter, sign = self._LETTER[buf], self._SIGN[buf]
        cut[1:-1] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        cut[offs] = True
        inside = ~C.SEPARATOR[buf]
        edge = cut[:-1] & inside
        edge[0] |= inside[0]
        edge[1:] |= inside[1:] & ~inside[:-1]
        s = np.flatnonzero(edge)
        stop = cut[1:] & inside
        stop[-1] |= inside[-1]
        stop[:-1] |= inside[:-1] & ~inside[1:]
        e = np.flatnonzero(stop) + 1
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        h1, h2 = C.word_hashes(buf, s, e)
        order = np.argsort(h1)
        fresh = np.append(True, np.diff(h1[order]) != 0)
        example, inverse = order[fresh], np.empty(len(h1), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        if np.any(h2[example][inverse] != h2):  # two pieces with one hash: tell them apart by both
            _, example, inverse = np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        at = self._known(buf, s[example], e[example], h1[example], h2[example])
        row = at[inverse]
        lengths = self.length[row]
        ids = C.gather_spans(self.ids, self.first[row], lengths)
        before = np.append(0, np.cumsum(lengths))
        return ids, np.diff(before[np.searchsorted(s, offs)])

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, -1)

    def _known(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each distinct piece in the memory, after the new ones have been encoded."""
        at = self._find(h1, h2)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.h1) + len(new) > CACHE_WORDS:
                self.forget()
                new = np.arange(len(h1))
            raw = buf.tobytes()
            own = self._library_ids([raw[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)])
            length = np.fromiter(map(len, own), np.int64, len(own))
            first = len(self.ids) + np.cumsum(length) - length
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(length.sum()))])
            # the memory stays in the order of the first hash: what is new is laid between
            order = np.argsort(h1[new], kind="stable")
            spot = np.searchsorted(self.h1, h1[new][order])
            self.h1, self.h2, self.first, self.length = (
                np.insert(old, spot, add[order]) for old, add in ((self.h1, h1[new]), (self.h2, h2[new]), (self.first, first), (self.length, length)))
            at = self._find(h1, h2)
            if np.any(at < 0):  # pieces that share their first hash: search along the equal run
                for i in np.flatnonzero(at < 0):
                    j = int(np.searchsorted(self.h1, h1[i]))
                    while self.h2[j] != h2[i]:
                        j += 1
                    at[i] = j
        return at


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- grammar


def _first_choice(spots: np.ndarray, weight: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which of the overlapping pairs at ascending spots to replace: the heavier of neighbours, of equals by the pair itself, so that copies of a passage are cut alike."""
    beside = np.append(np.diff(spots) == 1, False)
    # no two neighbours are equal: in a run of one id one of them stands on an even place
    rank = ((weight.astype(np.int64) << _SLOT_BITS) + slot << 1) + (spots & 1)
    chosen, open_ = np.zeros(len(spots), bool), np.ones(len(spots), bool)
    for _ in range(_CHOICES):
        now = np.where(open_, rank, -1)
        win = open_.copy()
        win[1:] &= ~beside[:-1] | (now[1:] > now[:-1])
        win[:-1] &= ~beside[:-1] | (now[:-1] > now[1:])
        chosen |= win
        open_ &= ~win
        open_[1:] &= ~(beside[:-1] & win[:-1])
        open_[:-1] &= ~(beside[:-1] & win[1:])
    return chosen


def compress(ids: np.ndarray, ends: np.ndarray, first_free: int, end_id: int = END_ID, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in batches: symbols, rules, expansion lengths, and the places of ``ends`` among the symbols.

    A round replaces all pairs that occur ``LEAST`` times; of pairs that overlap the more frequent one. Rounds go on (at
    most ``rounds`` if given) until no pair is that frequent: the most frequent pair is always replaced, in a run of one
    id at least half as often, so every round with such a pair makes progress. A pair stays out of later rounds once it is
    rarer, as only pairs with a new symbol can become frequent. ``end_id`` is in no pair, so no rule crosses documents.
    """
    symbols, rules, lengths = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], np.ones(first_free, np.uint32)
    live = (symbols[:-1] != end_id) & (symbols[1:] != end_id)
    for number in itertools.count() if rounds is None else range(rounds):
        spots = np.flatnonzero(live)
        if not len(spots):
            break
        a, b = symbols[spots], symbols[spots + 1]
        bits = min(max((2 * len(spots)).bit_length(), 10), _SLOT_BITS)
        # other multipliers in each round: pairs that share a slot now are told apart later
        turn = 2 * number
        slot = (a * np.uint32(0x9E3779B1 + turn & 0xFFFFFFFF) ^ b * np.uint32(0x85EBCA77 + 2 * turn & 0xFFFFFFFF)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - bits)
        # one pair stands for each slot; others wait for the next round
        pair = a.astype(np.uint64) << np.uint64(32) | b
        holds = np.zeros(1 << bits, np.uint64)
        holds[slot] = pair
        own = holds[slot] == pair
        counts = (np.bincount(slot, minlength=1 << bits) - np.bincount(slot[~own], minlength=1 << bits)).astype(np.int32)
        weight = counts[slot]
        often = own & (weight >= LEAST)
        live[spots] = often | ~own
        at, where = spots[often], slot[often]
        taken = np.flatnonzero(_first_choice(at, weight[often], where))
        # a rule that overlaps leave too few places waits as well
        used = np.bincount(where[taken], minlength=1 << bits) >= LEAST // 2
        made = np.flatnonzero(used)
        if not len(made):
            if own.all():
                break
            continue
        taken = taken[used[where[taken]]]
        at, which = at[taken], np.cumsum(used)[where[taken]] - 1
        rule = np.stack([holds[made] >> np.uint64(32), holds[made] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        start = len(lengths)
        lengths = np.concatenate([lengths, lengths[rule[:, 0]] + lengths[rule[:, 1]]])
        rules.append(rule)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols[at] = (start + which).astype(np.uint32)
        # the pairs with a new symbol, on either side of it
        new = np.zeros(len(symbols), bool)
        new[at] = True
        ends = ends - np.searchsorted(at + 1, ends, side="right")
        symbols, new, live = symbols[stay], new[stay], np.append(live, False)[stay][:-1]
        live |= new[:-1] | new[1:]
        # a symbol before an end, and the end itself, begin no pair
        live[ends[ends < len(live)]] = False
        live[ends[ends > 0] - 1] = False
    return symbols, np.concatenate(rules), lengths[first_free:], ends


def expand(symbols: np.ndarray, rules: np.ndarray, first_free: int) -> np.ndarray:
    """The ids that symbols stand for."""
    table: list[np.ndarray] = []
    for left, right in rules.tolist():
        table.append(np.concatenate([np.array([x], np.uint32) if x < first_free else table[x - first_free] for x in (left, right)]))
    length = np.concatenate([np.ones(first_free, np.int64), np.array([len(x) for x in table], np.int64)])
    flat = np.concatenate([np.arange(first_free, dtype=np.uint32), *table])
    first = np.cumsum(length) - length
    return C.gather_spans(flat, first[symbols], length[symbols])


def pack(doc_ids: list, ids: np.ndarray, counts: np.ndarray, before: int, first_free: int) -> bytes:
    """One shard: ``counts`` ids of each document, the end id included."""
    ends = np.cumsum(counts) - 1
    symbols, rules, lengths, at = compress(ids, ends, first_free)
    width = max(16, (first_free + len(rules) - 1).bit_length())
    planes = [np.packbits((symbols >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(16, width)]
    head = np.array([len(doc_ids), len(symbols), len(rules), len(ids), before, width], "<u8")
    starts = np.append(0, at[:-1] + 1)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    own = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([MAGIC, np.uint64(first_free).tobytes(), head.tobytes(), own.tobytes(), known.tobytes(), starts.astype("<u8").tobytes(), counts.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), *(x.tobytes() for x in planes)])


class Shard:
    """Reads a shard; documents are decoded alone or all at once."""

    def __init__(self, data):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token shard")
        self.first_free = int(np.frombuffer(view, "<u8", 1, 8)[0])
        n, symbols, rules, self.n_ids, self.before, width = map(int, np.frombuffer(view, "<u8", 6, 16))
        at = 64
        parts = []
        for kind, count in (("<i8", n), ("u1", n), ("<u8", n), ("<u8", n), ("<u4", 2 * rules), ("<u4", rules), ("<u2", symbols), *[("u1", -(-symbols // 8))] * (width - 16)):
            parts.append(np.frombuffer(view, kind, count, at))
            at += parts[-1].nbytes
        if at != len(view):
            raise ValueError("a token shard is cut off")
        ids, known, self.first_symbol, self.counts, rules_, self.lengths, low, *planes = parts
        self.symbols = low.astype(np.uint32)
        for k, plane in enumerate(planes, 16):
            self.symbols |= np.unpackbits(plane, count=symbols).astype(np.uint32) << np.uint32(k)
        self.rules = rules_.reshape(-1, 2)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, from its own symbols and the rules they use."""
        end = int(self.first_symbol[i + 1]) if i + 1 < len(self.doc_ids) else len(self.symbols)
        out, stack = [], self.symbols[int(self.first_symbol[i]) : end][::-1].tolist()
        while stack:
            x = stack.pop()
            if x < self.first_free:
                out.append(x)
            else:
                left, right = self.rules[x - self.first_free]
                stack += [int(right), int(left)]
        return np.array(out, np.uint32)

    def all(self) -> np.ndarray:
        ids = expand(self.symbols, self.rules, self.first_free)
        if len(ids) != self.n_ids or int(self.counts.sum()) != self.n_ids:
            raise ValueError("a token shard's lengths don't agree")
        return ids


# ---------------------------------------------------------------- operator

_SHARDS = "part int, place int, ids long, data binary"


def _write(path: str, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]):
        coder = encoder(path)
        first_free = max(coder.library.get_vocab_size(), end_id + 1)
        part, place, before = TaskContext.get().partitionId(), 0, 0
        docs, ids, counts, held = [], [], [], 0

        def flush():
            nonlocal place, before, docs, ids, counts, held
            data = pack(docs, np.concatenate(ids), np.concatenate(counts), before, first_free)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([held], pa.int64()), C.binary([data])], ["part", "place", "ids", "data"])
            place, before, docs, ids, counts, held = place + 1, before + held, [], [], [], 0
            return row

        for batch in batches:
            buf, offs = C.utf8(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for i, j in C.slices(offs):
                own, n = coder.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                own = np.insert(own, np.cumsum(n), np.uint32(end_id))
                docs += names[i:j]
                ids.append(own)
                counts.append(n + 1)
                held += len(own)
                if held >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, str]:
    """Write the token shards of all documents in ascending order of the id and return them with their path."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(C.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return C.save(dealt.mapInArrow(_write(tokenizer, end_id, shard_ids), _SHARDS), "tokens")


def _read(starts):
    def run(batches):
        base = starts.value
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_buffer())
                ids = shard.all().astype("<u4")
                edge = np.append(0, np.cumsum(shard.counts.astype(np.int64)))
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(edge[:-1] + shard.before + base[part]), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def encode_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents' ids to shards, read the shards back and describe each document.

    Null and empty texts have the end id alone; rows with the same id (or a null id, which sorts first) follow each
    other in the order of their texts; an empty table gives an empty result; other columns are ignored. A worker's
    memory grows with the shard size and the longest text.

    Returns doc_id, start, n_tokens, ids_crc32.
    """
    spark = docs.sparkSession
    shards, _ = write_shards(docs, tokenizer, **options)
    totals, before = {}, 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("ids")).collect())):  # one number for each partition
        totals[part] = before
        before += n
    return shards.select("part", "data").mapInArrow(_read(spark.sparkContext.broadcast(totals)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
