"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

1. Every text becomes its set of distinct shingles, a 128-bit hash of the set and a signature. A coordinate of the
   signature is the hash of ``MINIMA`` minima, so unrelated texts hardly ever share one. Equal sets are one node from
   here on, however many rows share them; a node has a number of its own, and ids of documents return at the end.
2. Nodes are posted under each (coordinate, value) pair. Lists of one node go, by exact counts, and so do nodes in
   fewer than ``MATCHES`` lists: nobody reaches the match threshold with them. All postings are linear in the nodes.
3. Each list is merged with its hub only, the node whose lists are the longest, and skips all other pairs: a list of n
   gives n - 1 pairs, counted once for each member and hub. Their full sets give the links and the *differences* of a
   member from its hub.
4. Two members F and A of one list can still be linked when F isn't linked to its hub H. Then their differences from
   H overlap by o >= (|F ^ H| + |A ^ H| - (|F| + |A|) (1 - t) / (1 + t)) / 2 for the threshold t, so they share an
   element in the first ``|.| - o + 1`` of each one's differences in any common order. Differences are ordered from
   rare to common by exact counts within the hub's members: what only one member has comes first and meets nobody.
   Each posting (hub, element) first meets its own hub, the member nearest to H; then what is left in different
   components is joined with the bounds of both prefixes for the very pair. Such pairs are retained when their
   signatures agree on ``MATCHES`` coordinates, and confirmed on the full sets. That covers all pairs of a list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm import common as C
from rankloom.llm.components import connected

COORDINATES, MINIMA, MATCHES = 32, 4, 3
_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


# ---------------------------------------------------------------- shingle sets


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (lower-cased A-Z); a shorter text is one shingle."""
    buf = C.LOWER[buf]
    s, e, first = C.word_spans(buf, offs)
    if not len(s):
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    h, _ = C.word_hashes(buf, s, e, both=False)
    runs = C.run_hashes(h, size, _BASE)
    short = {n: C.run_hashes(h, n, _BASE) for n in range(1, size)}
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(short[n][a : a + 1] if n else np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    if not len(shingles):
        return 0, 0
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(C.mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The hashes of groups of ``MINIMA`` minima over a set."""
    n = coordinates * MINIMA
    mul, add = _MUL[:n, None], _ADD[:n, None]
    best = None
    for i in range(0, len(shingles), 1024):
        own = (shingles[None, i : i + 1024] * mul + add).min(axis=1)
        best = own if best is None else np.minimum(best, own)
    total = np.zeros(coordinates, np.uint64)
    for part in best.reshape(MINIMA, coordinates):
        total = C.mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
    return (total >> np.uint64(32)).astype("<u4")


def _each_set(column: pa.Array, size: int):
    """The shingle set of every text, a bounded number of bytes at a time."""
    buf, offs = C.utf8(column)
    for i, j in C.slices(offs):
        yield from shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)


def _sign(size: int, coordinates: int):
    """(doc_id, n, s1, s2, sig) of each text."""

    def run(batches):
        for batch in batches:
            n, s1, s2, sig = [], [], [], []
            for own in _each_set(batch.column("text"), size):
                a, b = set_hash(own)
                n.append(len(own))
                s1.append(a)
                s2.append(b)
                sig.append(signature(own, coordinates).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "s1", "s2", "sig"])

    return run


def _collect_sets(size: int):
    """(n, s1, s2, shingles) of each text."""

    def run(batches):
        for batch in batches:
            n, s1, s2, sets, held = [], [], [], [], 0
            for own in _each_set(batch.column("text"), size):
                a, b = set_hash(own)
                n.append(len(own))
                s1.append(a)
                s2.append(b)
                sets.append(own.tobytes())
                held += own.nbytes
                if held > C.CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), C.binary(sets)], ["n", "s1", "s2", "shingles"])
                    n, s1, s2, sets, held = [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), C.binary(sets)], ["n", "s1", "s2", "shingles"])

    return run


# ---------------------------------------------------------------- postings and comparisons


def _matrix(column: pa.Array, coordinates: int) -> np.ndarray:
    buf, _ = C.utf8(column)
    return np.frombuffer(buf.tobytes(), "<u4").reshape(-1, coordinates)


def _post(coordinates: int):
    """Each node under each of its (coordinate, value) pairs."""

    def run(batches):
        for batch in batches:
            key = _matrix(batch.column("sig"), coordinates).astype(np.int64) | np.arange(coordinates, dtype=np.int64)[None, :] << np.int64(32)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(node, coordinates))], ["key", "node"])

    return run


def linked(a: int, b: int, both: int, percent: int) -> bool:
    """Whether sets of these sizes and this intersection are near enough."""
    return 100 * both >= percent * (a + b - both)


def _absent(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The elements of sorted x that sorted, non-empty y lacks."""
    at = np.searchsorted(y, x)
    return x[y[np.minimum(at, len(y) - 1)] != x]


def _compare(percent: int, coordinates: int, matches: int):
    """For each pair (a, b) whose signatures agree on ``matches`` coordinates: whether the full sets are near enough, and the shingles in which they differ."""

    def run(batches):
        for batch in (x.slice(i, j - i) for x in batches for i, j in C.slices(C.utf8(x.column("shingles_a"))[1])):
            near = (_matrix(batch.column("sig_a"), coordinates) == _matrix(batch.column("sig_b"), coordinates)).sum(axis=1) >= matches
            batch = batch.filter(pa.array(near))
            links, sizes, others, elements = [], [], [], []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                adds, lacks = _absent(a, b), _absent(b, a)
                links.append(linked(len(a), len(b), len(a) - len(adds), percent))
                sizes.append(len(a))
                others.append(len(b))
                elements.append(np.concatenate([adds, lacks]).view(np.int64))
            ends = np.append(0, np.cumsum([len(x) for x in elements], dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *elements])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(others, pa.int64()), lists], ["a", "b", "linked", "n", "m", "elements"])

    return run


_UNIT = "100000000000000000000"


def _hub() -> F.Column:
    """The most typical node of a list, then the smallest number, as one value that aggregates in place."""
    place = F.lit("9223372036854775807").cast("decimal(20,0)") - F.col("node").cast("decimal(20,0)")
    return F.max((F.col("typical").cast("decimal(10,0)") * F.lit(_UNIT).cast("decimal(21,0)") + place).cast("decimal(38,0)"))


def _hub_node(code) -> F.Column:
    return (F.lit("9223372036854775807").cast("decimal(20,0)") - (code % F.lit(_UNIT).cast("decimal(21,0)")).cast("decimal(20,0)")).cast("long")


# ---------------------------------------------------------------- groups


class _Groups:
    """Components of the nodes while links come in. ``labels`` has only nodes with a link: (id, component)."""

    def __init__(self, spark: SparkSession):
        self.labels, self._at = spark.createDataFrame([], "id long, component long"), []

    def of(self, rows: DataFrame, node: str, into: str) -> DataFrame:
        lab = self.labels.select(F.col("id").alias(node), F.col("component").alias("_label"))
        return rows.join(lab, node, "left").withColumn(into, F.coalesce("_label", node)).drop("_label")

    def settle(self, found: DataFrame) -> None:
        """Join components by new links (a, b), which are links between components from here on."""
        fresh = found.where("linked").select("a", "b")
        for x in "ab":
            fresh = self.of(fresh, x, "_c").withColumn(x, F.col("_c")).drop("_c")
        merged, merged_at = connected(fresh)
        to = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        moved = self.labels.join(to, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
        self.labels, at = C.save(moved.unionByName(merged.join(self.labels.select("id"), "id", "left_anti")), "components")
        C.drop(found.sparkSession, merged_at, *self._at)
        self._at = [at]


def _lists(nodes: DataFrame, coordinates: int, matches: int) -> tuple[DataFrame, str]:
    """(key, node, typical) of all lists that can matter, as a saved table: two nodes or more, each in ``matches`` such lists."""
    posted = nodes.select("node", "sig").mapInArrow(_post(coordinates), "key long, node long")
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # counts come from a table of their own: a hot list is one row for each task there, and the join may split it
    rows, rows_at = C.save(posted.join(shared, "key"), "postings")
    often = rows.groupBy("node").agg(F.count(F.lit(1)).alias("lists"), F.sum(F.round(8 * F.log2("size")).cast("long")).alias("typical")).where(F.col("lists") >= matches)
    kept = C.save(rows.join(often.select("node", "typical"), "node").select("key", "node", "typical"), "lists")
    C.drop(nodes.sparkSession, rows_at)
    return kept


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80,
    coordinates: int = COORDINATES, matches: int = MATCHES,
) -> DataFrame:
    """Components of near-duplicate texts: one row per input row.

    Two texts are linked when 100 x intersection >= ``percent`` x union of their shingle sets. A candidate pair at
    the threshold 0.8 is missed with the probability that fewer than 3 of 32 coordinates agree, each with
    probability 0.8 ** 4 (about one in 80,000, and less for nearer pairs); links are confirmed on the full sets.

    Null and empty texts have no set and are linked with nothing; texts of fewer words than a shingle are one
    shingle; equal sets of any number of rows are linked by their hash; repeated rows get equal rows, and rows that
    repeat an id with another text are compared by their own text; an empty table gives an empty result; further
    columns are ignored. A null id is a document of its own that is never linked.

    Returns doc_id, n_shingles, component_id, kept.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed, _ = C.save(texts.mapInArrow(_sign(shingle, coordinates), "doc_id long, n long, s1 long, s2 long, sig binary"), "signatures")
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    named = known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least"), F.max("sig").alias("sig"))
    nodes, _ = C.save(named.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # sets so small that no other size is near enough can only equal each other
    linkable = nodes.where(F.expr(f"100 * n >= {percent} * (n + 1) OR 100 * (n - 1) >= {percent} * n"))
    lists, lists_at = _lists(linkable, coordinates, matches)
    sets, sets_at = _sets(texts, nodes, lists, shingle)
    groups, scratch = _Groups(spark), [lists_at, sets_at]

    def compare(pairs: DataFrame, least: int, name: str) -> DataFrame:
        """What the full sets of distinct pairs (a, b) say; links take effect."""
        x, y = (sets.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("shingles").alias(f"shingles_{k}")) for k in "ab")
        found, at, seen = C.save_counted(
            pairs.join(x, "a").join(y, "b").mapInArrow(_compare(percent, coordinates, least), "a long, b long, linked boolean, n long, m long, elements array<long>"), name, linked=F.col("linked"))
        scratch.append(at)
        if seen["linked"]:
            groups.settle(found)
        return found

    hubs = lists.groupBy("key").agg(_hub().alias("hub")).select("key", _hub_node(F.col("hub")).alias("b"))
    # how often a member meets a hub doesn't matter here: a pair below the threshold still places the member
    starred = compare(lists.join(hubs, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), 0, "starred")
    posts, posts_at, open_members = _differences(starred, groups, percent)
    if open_members:
        def pairs(x: DataFrame, y: DataFrame, when: str) -> DataFrame:
            """Distinct pairs across components that share a posted difference."""
            met = groups.of(groups.of(x.join(y, "be").where(when), "a", "_ca"), "o", "_co").where("_ca <> _co")
            return met.select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b")).distinct()

        own = posts.where("NOT linked AND pos < wide")
        other = posts.where("pos < narrow").select("be", F.col("a").alias("o"), F.col("n").alias("n_o"), F.col("change").alias("change_o"), F.col("pos").alias("pos_o"))
        # an overlap is at most the smaller difference
        size = f"a <> o AND 100 * least(n, n_o) >= {percent} * greatest(n, n_o) AND {100 + percent} * abs(change - change_o) <= {100 - percent} * (n + n_o)"
        nearest = other.groupBy("be").agg(F.min(F.struct("change_o", "o", "n_o")).alias("x")).select("be", "x.*")
        compare(pairs(own, nearest, size), matches, "nearest")
        # twice the overlap that the pair needs, times 100 + percent
        need = f"({100 + percent} * (change + change_o) - {100 - percent} * (n + n_o))"
        bound = f"2 * {100 + percent} * pos + {need} <= 2 * {100 + percent} * change AND 2 * {100 + percent} * pos_o + {need} <= 2 * {100 + percent} * change_o"
        # labels come first, so that pairs within a component are skipped inside the join
        x, y = groups.of(own, "a", "_ca"), groups.of(other, "o", "_co")
        open_pairs = x.join(y, "be").where(f"_ca <> _co AND {size} AND {bound}")
        compare(open_pairs.select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b")).distinct(), matches, "differing")
    C.drop(spark, posts_at, *scratch)

    # the least id of each component; ids of documents take the place of node numbers
    placed = groups.of(nodes.select("s1", "s2", "n", "node", "least"), "node", "_component")
    least = placed.groupBy("_component").agg(F.min("least").alias("component_id"))
    group = placed.join(least, "_component").select(F.xxhash64("s1", "s2", "n").alias("_key"), "s1", "s2", "n", "component_id")
    # joined by one number of the keys, which nothing is dealt by: the adaptive planner may split a hot group's rows
    left = signed.select("doc_id", "n", "s1", "s2").withColumn("_key", F.xxhash64("s1", "s2", "n"))
    out = left.join(group, ["_key", "s1", "s2", "n"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def _sets(texts: DataFrame, nodes: DataFrame, lists: DataFrame, shingle: int) -> tuple[DataFrame, str]:
    """(node, sig, shingles) of the nodes in lists, as a saved table. The shingles are made again from the texts of their least ids and matched by the hash of the set, as an id may come with several texts."""
    held = nodes.join(lists.select("node").distinct(), "node", "left_semi")
    own = texts.join(held.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    made = own.select("text").mapInArrow(_collect_sets(shingle), "n long, s1 long, s2 long, shingles binary")
    return C.save(held.select("s1", "s2", "n", "node", "sig").join(made, ["s1", "s2", "n"]).dropDuplicates(["node"]).select("node", "sig", "shingles"), "sets")


def _differences(starred: DataFrame, groups: _Groups, percent: int) -> tuple[DataFrame, str, int]:
    """Postings of members under the elements in which they differ from their hub: a saved table, and how many of them are of members that aren't linked to it.

    ``be`` stands for hub and element, ``pos`` is its place from rare to common among the member's ``change`` elements.
    Elements of one member are counted in ``pos`` but not posted. A partner of any kind is met within the first
    ``wide`` places, one that isn't linked to the hub within the first ``narrow``.
    """
    labelled = groups.of(groups.of(starred, "a", "_ca"), "b", "_cb")
    open_hubs = labelled.where("_ca <> _cb").select("b").distinct()
    rows = starred.join(open_hubs, "b", "left_semi").withColumn("change", F.size("elements").cast("long"))
    # overlap >= change - (|a| + |partner|) (1 - t) / (1 + t) and |partner| <= |a| / t for any partner
    wide = F.expr(f"n * {100 - percent} div {percent} + 1")
    # overlap > half of ((1 + t) change + (1 - t) (|hub| - |a|)) / (1 + t) where the partner isn't linked to the hub
    narrow = F.expr(f"greatest(change - greatest(({100 + percent} * change + {100 - percent} * (m - n)) div {2 * (100 + percent)}, 0), 0)")
    rows = rows.withColumns({"wide": wide, "narrow": F.least(narrow, wide)})
    each = rows.select("a", "b", "linked", "n", "change", "wide", "narrow", F.explode("elements").alias("_e")).withColumn("be", F.xxhash64("b", "_e")).drop("_e")
    shared = each.groupBy("be").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    met = each.join(shared, "be")
    own = Window.partitionBy("a", "b")
    ranked = met.withColumns({"_rank": F.row_number().over(own.orderBy("often", "be")), "_met": F.count(F.lit(1)).over(own)})
    posts = ranked.withColumn("pos", F.col("change") - F.col("_met") + F.col("_rank") - 1).where("pos < wide").select("a", "linked", "n", "change", "wide", "narrow", "be", "pos")
    saved, at, seen = C.save_counted(posts, "differences", open=~F.col("linked"))
    return saved, at, seen["open"]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that represent their component, all columns unchanged."""
    kept = near_groups(docs, id_col, text_col, shingle, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi").select("_row.*")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(C.read(spark, sf_dir, "documents"))
