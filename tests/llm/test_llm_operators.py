"""Training-data operators against SQL, brute force and round trips, with nulls, empty tables, ties and odd columns."""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import common as C
from rankloom.llm import components, registry
from rankloom.llm import op01_substring as O1
from rankloom.llm import op02_quality as O2
from rankloom.llm import op03_minhash as O3
from rankloom.llm import op04_kdtree as O4
from rankloom.llm import op05_pieces as O5
from rankloom.llm import op06_exact as O6
from rankloom.llm import op07_chat as O7
from rankloom.llm import op08_tokens as O8
from rankloom.llm import op09_warc as O9
from rankloom.llm import op10_contamination as O10
from tests.test_queries import duck, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Null, empty, blank, short, repeated, long and odd texts; extra columns with names that operators use themselves.
ODD = [
    (1, "a b c d e f", "x"), (2, None, "x"), (3, "", None), (4, " \t\n", "y"), (5, "a  b\tc d e f", "x"), (5, "a  b\tc d e f", "x"), (None, "lost words", "z"), (7, "word " * 400, "z"),
    (8, "w" * 5000 + " é ü 漢字 ▁ \x1a [INST] " + "z" * 3000, "z"), (9, "lost words", "z"), (-3, "A B C d e f", "q"),
]
SCHEMA = "doc_id long, text string, _norm string"
EXTRA = ("n", "node", "kept", "key", "_row", "size", "score", "a", "b")


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in EXTRA:
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df


def as_map(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), duck(sf_dir), registry.oracle_sql()[name])


# ------------------------------------------------ 1


def brute_windows(rows, width):
    seen = defaultdict(list)
    words = [WORD.findall(t or "") for _, t in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])].append((d, i))
    gone = defaultdict(set)
    for spots in seen.values():
        if len(spots) > 1:
            for d, i in spots:
                gone[d].update(range(i, i + width))
    return sorted(((rows[d][0], len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in enumerate(words)), key=str)


@pytest.mark.parametrize("log_cells", [4, 20])
def test_substring_brute_force(spark, log_cells):
    rng = np.random.default_rng(log_cells)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 60)))) for i in range(60)] + [(r[0], r[1]) for r in ODD]
    found = O1.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=5, log_cells=log_cells)
    assert as_map(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows, 5)


def test_substring_odd_rows(spark):
    found = O1.remove_repeats(odd(spark), width=3, log_cells=12, keep_text=True)
    assert as_map(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows([(r[0], r[1]) for r in ODD], 3)
    assert O1.remove_repeats(odd(spark, []), log_cells=12).count() == 0


# ------------------------------------------------ 2


def test_quality_ranks_held_out(spark, sf_dir):
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    rows = O2.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, "e"), (7, 0, "e"), (8, None, "e"), (9, 3, None), (None, 0, "e")], "doc_id long, quality int, text string")
    found = O2.quality_scores(odd(spark), labels)
    assert found.count() == len(ODD) and found.where("score IS NULL").count() == 0
    by_text = {}
    for (_, text, _), s in zip(sorted(ODD, key=str), sorted(found.collect(), key=str), strict=True):
        assert by_text.setdefault(text, s.score) is not None
    assert O2.quality_scores(odd(spark, []), labels).count() == 0
    assert {r.predicted for r in O2.quality_scores(odd(spark), labels.where("false")).collect()} == {1}
    assert O2.keep_good(odd(spark), labels.where("false")).columns == odd(spark).columns


# ------------------------------------------------ 3


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_groups(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {k: k for k in range(len(sets))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for m, (j, b) in enumerate(sets[:k]):
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[find(k)] = find(m)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    own = [None if i is None else least[find(k)] for k, (i, _) in enumerate(sets)]
    return sorted(((i, len(s), c, i == c) for (i, s), c in zip(sets, own, strict=True)), key=str)


def near_corpus():
    """A large family of copies with edits of their own, chains, truncations, exact copies and unrelated texts."""
    rng = np.random.default_rng(3)
    word = lambda: f"t{rng.integers(0, 3000)}"
    base = [word() for _ in range(150)]
    rows = []
    for n in range(120):
        w = list(base)
        for _ in range(n // 8):
            w[rng.integers(0, len(w))] = f"edit{rng.integers(0, 40 if n % 3 else 10**9)}"
        rows.append(w)
    chain = list(base[:90])
    for n in range(25):
        chain = chain[4:] + [f"chain{n}-{k}" for k in range(4)]
        rows.append(list(chain))
    rows += [base[: 150 - 3 * n] for n in range(20)] + [base] * 5
    rows += [[word() for _ in range(rng.integers(0, 30))] for _ in range(100)] + [[f"s{rng.integers(0, 3)}" for _ in range(rng.integers(1, 8))] for _ in range(60)]
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_brute_force(spark, size):
    rows = near_corpus()
    found = O3.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=size)
    assert as_map(found, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, size)


def test_near_groups_odd_rows(spark):
    found = O3.near_groups(odd(spark))
    assert as_map(found, "doc_id", "n_shingles", "component_id") == [(a, b, c) for a, b, c, _ in brute_groups([(r[0], r[1]) for r in ODD], 2)]
    assert O3.near_groups(odd(spark, [])).count() == 0
    kept = O3.keep_one(odd(spark).withColumn("_kept_id", F.lit(1)))
    assert kept.columns == [*odd(spark).columns, "_kept_id"]
    # five-word shingles: 5 and 5 repeat 1, -3 differs in case alone, "lost words" is one shingle under two ids
    assert as_map(kept, "doc_id", "text") == sorted(((i, t) for i, t, _ in ODD if i not in (1, 5)), key=str)


def test_near_groups_same_id_other_text(spark):
    base, other = " ".join(f"b{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, base), (1, other), (2, base + " end"), (3, other + " end")]
    found = O3.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_map(found, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, 2)


@pytest.mark.parametrize("seed", range(3))
def test_near_groups_around_the_threshold(spark, seed):
    """Copies with so many edits of their own that most are linked to few others or none."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(60 + 20 * seed)]
    rows = []
    for n in range(160):
        w = [x for x in base if rng.random() > 0.03 * (n % 4)]
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, (5, 50, 10**9)[n % 3])}"
        rows.append((n, " ".join(w[: len(w) - int(rng.integers(0, 12))])))
    found = O3.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_map(found, "doc_id", "n_shingles", "component_id", "kept") == brute_groups(rows, 2)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300), (None, 5)] + [(1000, 1000 + i) for i in range(50)]
    found = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in (100, 150, 200)} == {100} and {found[1000 + i] for i in range(50)} == {1000} and 300 not in found


# ------------------------------------------------ 4


def check_shards(rows, docs, n):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_shards_are_even(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    found = check_shards(O4.kd_shards(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 8)
    most = max(len(r.text.encode()) for r in docs.collect())
    assert len(found) == 8 and max(found.values()) - min(found.values()) <= 3 * most


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_of_hot_and_odd_rows(spark, n):
    hot = [(i, "same text", "x") for i in range(300)]
    sizes = check_shards(O4.kd_shards(odd(spark, hot), n).collect(), [(r[0], r[1]) for r in hot], n)
    assert len(sizes) == n and max(sizes.values()) - min(sizes.values()) <= 10 * n
    check_shards(O4.kd_shards(odd(spark), n).collect(), [(r[0], r[1]) for r in ODD], n)
    assert O4.kd_shards(odd(spark, []), n).count() == 0


# ------------------------------------------------ 5

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_follow_the_lattice():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = {model.id_to_piece(i): 1 / (1 + max(-model.get_score(i), 0)) for i in range(259, model.get_piece_size())}
    text, n = "tion", 20_000
    ways = {}

    def walk(rest, done, weight):
        if not rest:
            ways[done] = weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in table:
                walk(rest[k:], (*done, rest[:k]), weight * table[rest[:k]])

    walk("▁" + text, (), 1.0)
    buf, offs = C.utf8(pa.array([text] * n))
    ids, counts = O5.Lattice(PIECES).sample(buf, offs, C.mix(np.arange(n).astype(np.uint64)))
    at = np.append(0, np.cumsum(counts))
    got = Counter(tuple(model.id_to_piece(int(i)) for i in ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    total = sum(ways.values())
    assert set(got) <= set(ways)
    for way, w in ways.items():
        assert got[way] / n == pytest.approx(w / total, abs=0.015)


def test_pieces_odd_rows(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = O5.sample_pieces(odd(spark), PIECES).collect()
    again = O5.sample_pieces(odd(spark).repartition(3), PIECES).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    texts = defaultdict(set)
    for i, t, _ in ODD:
        texts[i].add(t or "")
    for r in rows:
        assert r.lossless and r.n_pieces == len(r.ids) and r.decoded_sha256 in {hashlib.sha256(t.encode()).hexdigest() for t in texts[r.doc_id]}
        if not any("▁" in t for t in texts[r.doc_id]):
            assert model.decode(r.ids) in texts[r.doc_id]
    assert O5.sample_pieces(odd(spark, []), PIECES).count() == 0


_lattice = O5.Lattice(PIECES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_pieces_are_lossless(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    buf, offs = C.utf8(pa.array(texts, pa.string()))
    ids, counts = _lattice.sample(buf, offs, C.mix(np.arange(len(texts)).astype(np.uint64)))
    back, at = _lattice.decode(ids, counts)
    assert [bytes(back[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts


# ------------------------------------------------ 6


def test_exact_odd_rows(spark):
    rows = [*ODD, (20, "abc", "x"), (18, "a b c", "x"), (19, "a b\tc", "x"), (21, "é", "x"), (22, "é", "x")]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    wanted = sorted(((i, min(g)[3], len(g), i == min(g)[3], hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, _, _, i in g), key=str)
    assert as_map(O6.exact_groups(odd(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == wanted
    assert O6.exact_groups(odd(spark, [])).count() == 0
    kept = O6.keep_one(odd(spark, rows))
    assert kept.columns == odd(spark).columns and kept.count() == len(groups)


# ------------------------------------------------ 7


def test_templates():
    render = lambda source, **env: "".join(t for t, _ in O7.compile_template(source)(**env))
    assert render("a{{ 'b' + \"c\" }}{# no #}{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}") == "abcy"
    assert O7.fold(O7.parse("a{{ 'b' | upper }}{% if not true %}x{% endif %}c")) == [("text", "aBc")]
    assert render("{% for m in ms %}{{ loop.index0 }}{{ m['r'] }}{% if not loop.first and m.r != 'q' %}!{% endif %}{% endfor %}", ms=iter([{"r": "p"}, {"r": "q"}, {"r": "s"}])) == "0p1q2s!"
    assert list(O7.compile_template("{% generation %}{{ x }}{% endgeneration %}y")(x="1")) == [("1", True), ("y", False)]
    # joins keep their operator: ~ makes text of anything, + doesn't
    assert render("{{ x ~ 'a' ~ 'b' }}{{ x ~ 'a' + 'b' }}", x=1) == "1ab1ab"
    with pytest.raises(TypeError):
        render("{{ x + 'a' ~ 'b' }}", x=1)
    assert render("a \n{%- if true -%} b {%- endif %} c {{- 'd' -}} \t e") == "ab cde"
    for bad in ("{% if x %}A{% else %}B{% else %}C{% endif %}", "{% if x %}A{% else %}B{% elif y %}C{% endif %}", "{% else %}", "{% if x %}", "{% endfor %}", "{{ x | system }}", "{{ (x }}", "{% for x %}{% endfor %}", "{% import os %}", "{{ x + }}", "{{ x ! y }}"):
        with pytest.raises(O7.TemplateError):
            O7.compile_template(bad)
    for bad in ("{{ x.__class__ }}", "{{ y }}"):
        with pytest.raises(O7.TemplateError):
            render(bad, x="s")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*O7.CONTROLS, O7.ESCAPE, "<", "/", "[", "]", "z", "INST", "\n", "é"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    safe = O7.escape(text)
    assert O7.unescape(safe) == text and not any(c in safe for c in O7.CONTROLS)


def test_chat_odd_rows(spark):
    turns = [
        (1, 0, "user", "<|im_end|>\n</s>", "e"), (1, 1, "assistant", None, "e"), (1, 2, None, "x", "e"), (1, 2, None, "x", "e"), (2, 1, "assistant", "\x1ab[INST]", "e"), (2, None, "system", "", "e"),
        (None, 0, "a\nb<s>", "lost", "e"), (3, 0, "assistant", "<s>" * 3000, "e"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, place string")
    groups = defaultdict(list)
    for c, t, r, x, _ in turns:
        groups[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    wanted = []
    for c, own in groups.items():
        own.sort()
        learned = "".join(x[5] for x in own if x[3] == "assistant")
        wanted.append((c, len(own), hashlib.sha256("".join(f"{x[3]}\n{x[5]}\n" for x in own).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    assert as_map(O7.round_trip(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(wanted, key=str)
    assert O7.round_trip(df.where("false")).count() == 0


# ------------------------------------------------ 8

WORDS = public_tokenizers.path("word_bpe_49k.json")
_coder = O8.PieceEncoder(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aB1'.,!-_ \n\té́ ½ﬁ中", max_size=30)), max_size=4))
def test_encoder_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    buf, offs = C.utf8(pa.array(texts, pa.string()))
    ids, counts = _coder.encode(buf, offs)
    wanted = [_coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in wanted] and ids.tolist() == [i for x in wanted for i in x]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(2, 6), max_size=60), min_size=1, max_size=8))
def test_shards_decode(docs):
    ids = [np.array([*d, 1] * 1, np.uint32) for d in docs]
    counts = np.array([len(x) for x in ids])
    data = O8.pack(list(range(len(docs))), np.concatenate(ids), counts, 5, 10)
    shard = O8.Shard(data)
    assert shard.before == 5 and np.array_equal(shard.all(), np.concatenate(ids))
    assert all(np.array_equal(shard.document(i), x) for i, x in enumerate(ids))


def test_grammar_shrinks():
    ids = np.tile(np.array([5, 6, 7, 8], np.uint32), 1000)
    symbols, rules, lengths, _ = O8.compress(ids, np.array([len(ids) - 1]), 10)
    assert len(symbols) < len(ids) / 4 and len(rules) == len(lengths) and np.array_equal(O8.expand(symbols, rules, 10), ids)


def test_tokens_brute_force(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    for df in (docs, odd(spark)):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in df.collect()))
        start, wanted = 0, []
        for _, _, _, text, i in rows:
            ids = np.array([*_coder.library.encode(text, add_special_tokens=False).ids, 1], "<u4")
            wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert as_map(O8.encode_documents(df, WORDS, shard_ids=2000), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(wanted, key=str)
    assert O8.encode_documents(odd(spark, []), WORDS).count() == 0


# ------------------------------------------------ 9


def test_warc_segments(spark):
    html = ["<p>" + "x" * n + "</p>" for n in (0, 10, 5000, 20_000)] + [None, "", "<p></p>", "ü\r\n\r\n0\r\n"]
    pages = spark.createDataFrame([(i if i != 7 else None, f"http://h/{i} x\n", h, "e") for i, h in enumerate(html)], "page_id long, url string, html string, data string")
    archives, _ = O9.write_archives(pages, segment_bytes=700)
    raw = b"".join(bytes(r.data) for r in archives.collect())
    assert sum(f["warc-type"] == "continuation" for f, _ in O9.records(raw)) > 20
    payloads = {r.page_id: r.payload for r in O9.read_archives(archives, keep_payload=True).collect()}
    assert bytes(payloads[3]).decode() == html[3] and payloads[6] is None and payloads[5] is None and bytes(payloads[None]).decode() == html[7]
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in O9.read_archives(archives).collect()}
    assert found[6] == (7, O9.digest(b"<p></p>"), "revisit", 0) and found[5] == (0, O9.digest(b""), "revisit", 4) and found[4][2:] == ("response", None)
    assert O9.archive_round_trip(pages.where("false")).count() == 0
    assert {r.record_type for r in O9.archive_round_trip(pages, min_bytes=100).collect()} == {"response"}
    broken = [r for r in O9.records(raw) if not (r[0]["warc-type"] == "continuation" and r[0]["warc-segment-number"] == "2")]
    data = b"".join(gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items()).encode() + b"\r\n" + b + b"\r\n\r\n") for f, b in broken)
    for given, why in ((data, "segments"), (data[:-20], "cut off"), (gzip.compress(b"HTTP/1.1 200 OK"), "no WARC record")):
        with pytest.raises(Exception, match=why):
            O9.read_archives(spark.createDataFrame([(bytearray(given), None)], "data binary, segmented boolean")).collect()


def test_warc_repeated_rows_and_long_pages(spark):
    """Rows that repeat a page are a response each; a page of 5 MB is cut and put together again."""
    rng = np.random.default_rng(9)
    long = "".join(map(chr, rng.integers(32, 1000, 3_000_000)))
    pages = spark.createDataFrame([(1, None, "same"), (1, None, "same"), (2, "", "same"), (3, "u", long), (None, "u", long), (4, "u", None)], "page_id long, url string, html string")
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in O9.archive_round_trip(pages).collect()), key=str)
    size, name = len(long.encode()), O9.digest(long.encode())
    wanted = [(1, 4, O9.digest(b"same"), "response", None)] * 2 + [(2, 4, O9.digest(b"same"), "revisit", 1), (3, size, name, "response", None), (None, size, name, "revisit", 3), (4, 0, O9.digest(b""), "response", None)]
    assert size > C.CHUNK_BYTES and found == sorted(wanted, key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 50))
def test_chunked_round_trip(payload, size):
    assert O9.unchunked(O9.chunked(payload, size)) == payload


# ------------------------------------------------ 10


def test_containment_brute_force(spark):
    rng = np.random.default_rng(10)
    make = lambda n: [f"v{x}" for x in rng.integers(0, 200, n)]
    items = [(k, make(n)) for k, n in enumerate([5, 6, 7, 9, 12, 17, 25, 40, 70, 130, 300, 3, 1, 0])]
    docs = []
    for d in range(120):
        w = make(int(rng.integers(0, 400)))
        item = items[d % len(items)][1]
        if d % 3:
            part = list(item)
            if d % 3 == 2 and len(part) > 20:
                part[int(rng.integers(0, len(part)))] = "CHANGED"
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + part + w[at:]
        docs.append((d, " ".join(w).upper() if d % 2 else "\n".join(w)))
    # shingles of an item far apart, in pieces of forty words
    for k in (8, 9, 10):
        w = items[k][1]
        docs.append((600 + k, " ".join(" ".join([*w[i : i + 40], *make(900)]) for i in range(0, len(w) - 4, 36))))
    docs += [(500, " ".join(items[11][1])), (501, None), (502, ""), (500, " ".join(items[11][1]))]
    table = [(k, " ".join(w)) for k, w in items] + [(90, None)]
    wanted = []
    for i, t in docs:
        own = shingles(t, 5)
        for k, x in table:
            s = shingles(x, 5)
            if s and 100 * len(s & own) >= 80 * len(s):
                wanted.append((i, k, len(s & own), len(s)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(table, "item_id long, text string")
    for block in (5000, 4):
        assert as_map(O10.contaminated(d, b, block=block), "doc_id", "item_id", "shared", "item_shingles") == sorted(wanted, key=str)
    hit = {i for i, *_ in wanted}
    assert {608, 609, 610} <= hit
    assert {r.doc_id for r in O10.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - hit
    assert O10.contaminated(d, b.where("false")).count() == 0 and O10.contaminated(odd(spark, []), b).count() == 0
    assert O10.drop_contaminated(odd(spark), b).columns == odd(spark).columns


def test_tokens_added_tokens_keep_case(spark):
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> a", "<|endoftext|>", "One<|ENDOFTEXT|>,two", "<|StartOfText|>x <|startoftext|>", "Plain PLAIN plain"]
    raw = "".join(texts).encode()
    ids, counts = O8.PieceEncoder(WORDS).encode(np.frombuffer(raw, np.uint8), np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    wanted = [_coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_quality_lines_counted_whole():
    same = "x" * 64
    texts = [f"{same} one\n{same} two\n{same} six\n", f"{same} one\n{same} one\n{same} six\n", "".join(f"{same * 20}{i}\n" for i in range(5))]
    buf, offs = C.utf8(pa.array(texts, pa.string()))
    x = O2.features(buf, offs)
    distinct = x[:, O2.FEATURES.index("distinct_lines")] * (np.array([t.count("\n") for t in texts]) + 1)
    assert distinct.tolist() == pytest.approx([3, 2, 5])


def test_grammar_leaves_no_frequent_pair():
    passage = np.random.default_rng(3).integers(2, 70_000, 1000).astype(np.uint32)
    ids = np.tile(np.append(passage, np.uint32(1)), 64)
    counts = np.full(64, 1001)
    symbols, rules, lengths, _ = O8.compress(ids, np.cumsum(counts) - 1, 70_000)
    assert len(symbols) <= 3 * 64 and lengths.max() > 8 and np.array_equal(O8.expand(symbols, rules, 70_000), ids)
    shard = O8.Shard(O8.pack(list(range(64)), ids, counts, 0, 70_000))
    assert np.array_equal(shard.all(), ids) and np.array_equal(shard.document(5), ids[:1001])


# ------------------------------------------------ against plain Python, and texts longer than a chunk


def plain_features(text):
    """The features as their names say, one text at a time."""
    raw = text.encode()
    kinds = [1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b > 127 else 5 if chr(b) in ".,;:!?'\"()-" else 6 if b == 124 else 8 if b in b" \t\n\x0b\x0c\r" else 7 if 32 < b < 127 else 0 for b in raw]
    words = [w.encode() for w in WORD.findall(text)]
    n, k = len(words), max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / k
    lines = text.split("\n")
    signs = b"#$%&*+/<=>@[\\]^_`{}~|!"
    out = [np.log1p(len(raw)), np.log1p(n), mean, max(sum(x * x for x in lengths) / k - mean * mean, 0) ** 0.5, sum(x > 20 for x in lengths) / k, sum(x <= 3 for x in lengths) / k]
    out += [sum(x == kind for x in kinds) / max(len(raw), 1) for kind in range(1, 9)]
    out += [sum(any(b in signs for b in w) for w in words) / k, sum(sum(65 <= b < 91 for b in w) > 1 and not any(97 <= b < 123 for b in w) for w in words) / k]
    out += [len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k, max(Counter(words).values(), default=0) / k]
    pairs = [*zip(words, words[1:]), (words[-1],)] if words else []
    kept = lines[:-1] if lines[-1] == "" else lines
    ends = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    return out + [len(set(pairs)) / k, np.log1p(len(lines)), (len(set(ends)) if ends else (0 if raw else 0)) / len(lines) if kept or raw else 0.0, np.log1p(n / len(lines)), np.log1p(n / (sum(b in b".!?" for b in raw) + 1)), float(n == 0)]


def test_quality_scores_in_plain_python(spark, sf_dir):
    """Features one text at a time, the link and the threshold by hand, and no better weights nearby."""
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    model = O2.learn(docs, labels)
    rows = docs.collect()
    x = np.array([plain_features(r.text) for r in rows])
    found = {r.doc_id: r for r in O2.quality_scores(docs, labels).collect()}
    for r, own in zip(rows, x, strict=True):
        z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(own, model["mean"], model["scale"], strict=True)]
        strength = sum(a * w for a, w in zip([*z, *(v * v / 4 for v in z)], model["w"], strict=True))
        score = 1 / (1 + np.exp(-(min(max(strength - model["cut"], -30), 30) + np.log(0.7 / 0.3))))
        assert found[r.doc_id].score == pytest.approx(score, abs=1e-6)
        assert found[r.doc_id].predicted == (found[r.doc_id].score >= 0.7)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    learned = [(r.doc_id, own) for r, own in zip(rows, x, strict=True) if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    z = np.clip((np.array([own for _, own in learned]) - model["mean"]) / model["scale"], -8, 8)
    z = np.concatenate([z, z**2 / 4], axis=1)
    label = np.array([quality[i] for i, _ in learned])

    def loss(w):
        s = z @ w
        return np.log1p(np.exp(-(s[label == 1][:, None] - s[label == 0][None, :]))).mean() + 5e-5 * w @ w

    rng = np.random.default_rng(0)
    at = loss(model["w"])
    assert at < loss(0 * model["w"]) and all(loss(model["w"] + rng.normal(size=len(model["w"])) * 0.5) > at - 0.02 for _ in range(20))


def test_quality_learns_from_all_rows_and_pairs(spark):
    """More rows of each label than a bounded sample would take, and the loss of every pair of them."""
    rng = np.random.default_rng(6)
    ids = [i for i in range(24_000) if zlib.crc32(str(i).encode()) % 4 != 2][:17_101]
    label = (np.arange(len(ids)) < 9_000).astype(int)
    texts = [" ".join(("w" * k) + ("|" if m < 2 - v else ".") for k, m in zip(rng.integers(1, 9, 4 + 2 * v), rng.integers(0, 6, 8))) for v in label]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(v)) for i, v in zip(ids, label, strict=True)], "doc_id long, quality int")
    model = O2.learn(docs, labels)
    x = O2.features(*C.utf8(pa.array(texts, pa.string())))
    assert model["mean"] == pytest.approx(x.mean(axis=0)) and model["scale"][x.std(axis=0) > 1e-9] == pytest.approx(x.std(axis=0)[x.std(axis=0) > 1e-9])
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    z = np.concatenate([z, z**2 / 4], axis=1)
    s = z @ model["w"]
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    slope, lost = np.zeros(len(s)), 0.0
    for part in np.array_split(good, 20):
        gap = s[part][:, None] - s[bad][None]
        p = 1 / (1 + np.exp(gap))
        slope[part] -= p.sum(axis=1)
        slope[bad] += p.sum(axis=0)
        lost += np.logaddexp(0, -gap).sum()
    assert np.abs(slope @ z / (len(good) * len(bad)) + 1e-4 * model["w"]).max() < 1e-8 and lost / (len(good) * len(bad)) < 0.6
    order = np.argsort(s)
    agreed = np.append(0, np.cumsum(np.where(label[order] == 0, 1, -1))) + label.sum()
    assert ((s >= model["cut"]) == label).sum() == agreed.max()


def test_quality_in_tasks_as_in_the_driver(spark, sf_dir):
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    again = docs.union(docs).union(docs.limit(5).selectExpr("doc_id", "text || ' | |' text", "lang", "source", "n_chars"))
    for own in (labels, labels.where("quality = 0"), labels.where("false"), labels.union(labels.selectExpr("doc_id", "1 - quality", "toxic").limit(9))):
        a, b = O2.learn(again, own), O2.learn(again.repartition(5), own, local_rows=0)
        assert a["always"] == b["always"] and a["w"] == pytest.approx(b["w"], abs=1e-6) and a["cut"] == pytest.approx(b["cut"], abs=1e-6)
    assert as_map(O2.quality_scores(docs, labels, local_rows=0), "doc_id", "held_out", "predicted") == as_map(O2.quality_scores(docs, labels), "doc_id", "held_out", "predicted")


def plain_tree(rows, n_dims, shards):
    """Recursive cuts at the weighted median along the widest dimension."""
    low = [min(r[f"_d{i}"] for r in rows) for i in range(n_dims)]
    span = [max(max(r[f"_d{i}"] for r in rows) - low[i], 1e-12) for i in range(n_dims)]
    place = lambda r, i: (np.floor((r[f"_d{i}"] - low[i]) / span[i] * (2**20 - 1)) + r["_tie"]) / 2**20
    out = {}

    def split(own, leaves, first):
        if leaves == 1 or not own:
            out.update({r["doc_id"]: first for r in own})
            return
        wide = [(max(r[f"_d{i}"] for r in own) - min(r[f"_d{i}"] for r in own)) / span[i] for i in range(n_dims)]
        i = max(range(n_dims), key=lambda k: (wide[k], -k))
        own = sorted(own, key=lambda r: place(r, i))
        goal, below, cut = sum(r["size"] for r in own) * (leaves // 2) / leaves, 0, 0
        while cut < len(own) and below + own[cut]["size"] <= goal:
            below += own[cut]["size"]
            cut += 1
        split(own[:cut], leaves // 2, first)
        split(own[cut:], leaves - leaves // 2, first + leaves // 2)

    split(rows, shards, 0)
    return out


@pytest.mark.parametrize("n", [8, 5])
def test_shards_equal_a_plain_tree(spark, sf_dir, n):
    docs = C.read(spark, sf_dir, "documents")
    light, dims = O4._coordinates(docs, "doc_id", "text", ("n_chars", "source", "lang"))
    wanted = plain_tree([r.asDict() for r in light.collect()], dims, n)
    assert {r.doc_id: r.shard for r in O4.kd_shards(docs, n).collect()} == wanted


def test_shards_of_target_bytes(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    total = sum(len(r.text.encode()) + 1 for r in docs.collect())
    rows = O4.kd_shards(docs, target_bytes=total // 5).collect()
    assert {r.shard for r in rows} == set(range(6)) and O4.kd_shards(docs.where("false"), target_bytes=10).count() == 0


def long_rows():
    """Texts over the bytes that one pass takes: a long one, its near copy and a passage of it on its own."""
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 700_000)]
    assert len(" ".join(words)) > C.CHUNK_BYTES
    return [(1, " ".join(words), "x"), (2, " ".join([*words[:1000], "CHANGED", *words[1001:]]), "x"), (3, " ".join(words[5000:5060]), "y"), (4, "short text", "y")]


def test_long_texts(spark):
    rows = long_rows()
    df = odd(spark, rows)
    texts = {i: t for i, t, _ in rows}
    found = {r.doc_id: r for r in O1.remove_repeats(df).collect()}
    assert [found[i].n_removed for i in (1, 2, 3, 4)] == [699_999, 699_999, 60, 0]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in O3.near_groups(df).collect()}
    assert near[2][1] == 1 and near[3][1] == 3 and near[1][0] == len(shingles(texts[1], 2))
    assert {r.doc_id: r.group_size for r in O6.exact_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    item = spark.createDataFrame([(7, texts[3])], "item_id long, text string")
    assert sorted(r.doc_id for r in O10.contaminated(df, item).collect()) == [1, 2, 3]
    ids = {r.doc_id: r.n_tokens for r in O8.encode_documents(df, WORDS).collect()}
    assert ids[3] == len(_coder.library.encode(texts[3], add_special_tokens=False).ids) + 1 and ids[1] > ids[3]
    small = df.where("doc_id > 1")
    assert all(r.lossless and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in O5.sample_pieces(small, PIECES).collect())
    one = O2.features(*C.utf8(pa.array([texts[1]])))[0]
    assert one[O2.FEATURES.index("log_words")] == pytest.approx(np.log1p(700_000)) and one[O2.FEATURES.index("distinct_words")] == pytest.approx(len(set(texts[1].split())) / 700_000)
