"""Queries: catalogue preparation, text functions, score reuse, pools and the deterministic judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import numbers as N
from rankloom.functions import text as X
from rankloom.operators import etl as E
from rankloom.operators import judge as J
from rankloom.operators import pools as P
from rankloom.operators import reuse as U
from rankloom.plans import base as B
from rankloom.plans.catalogue import register

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def _docs(spark, sf):
    return B.table(spark, sf, "documents")


# ------------------------------------------------ catalogue


@register("clean_catalog", f"SELECT doc_id, len({_WORDS.format('text')}) AS n_words FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND len({_WORDS.format('text')}) >= 25")
def clean_catalog(spark, sf):
    return E.clean_catalog(_docs(spark, sf), ["text", "lang"], "text").select("doc_id", "n_words")


@register("missing_flags", "SELECT lang, count(*) AS n, sum((quality IS NULL)::INT)::BIGINT AS unlabelled, round(avg(2026 - doc_id % 100), 9)::DOUBLE AS mean_age FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def missing_flags(spark, sf):
    joined = _docs(spark, sf).join(B.table(spark, sf, "labels"), "doc_id", "left")
    out = joined.select("lang", N.missing_flag(F.col("quality")).alias("flag"), (2026 - F.col("doc_id") % 100).alias("age"))
    return B.rounded(out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("unlabelled"), F.avg("age").alias("mean_age")), "mean_age")


_LANGS = {"en": "English", "de": "German", "fr": "French"}


@register("map_category", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS category, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END, source) AS filled FROM documents")
def map_category(spark, sf):
    mapped = _docs(spark, sf).select("doc_id", "source", E.map_values(F.col("lang"), _LANGS).alias("category"))
    return mapped.select("doc_id", "category", F.coalesce("category", "source").alias("filled"))


@register("value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 20")
def value_counts(spark, sf):
    return E.value_counts(_docs(spark, sf), "source", 20)


@register("derived_text", "SELECT doc_id, md5(CASE WHEN quality IS NULL THEN source ELSE source || ': ' || lang END) AS title, md5(doc_id || ' ' || text) AS tagged FROM documents LEFT JOIN labels USING (doc_id)")
def derived_text(spark, sf):
    rows = _docs(spark, sf).join(B.table(spark, sf, "labels"), "doc_id", "left").withColumn("subtitle", F.when(F.col("quality").isNotNull(), F.col("lang")))
    return rows.select("doc_id", F.md5(E.full_title(F.col("source"), F.col("subtitle"))).alias("title"), F.md5(E.tagged(F.col("doc_id"), F.col("text"))).alias("tagged"))


@register("sentence_maxpool", r"SELECT doc_id, max(length(s))::INT AS longest, count(*) AS n_parts, count(*) FILTER (s = '') AS n_empty FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents) GROUP BY doc_id")
def sentence_maxpool(spark, sf):
    parts = E.sentences(_docs(spark, sf), "doc_id", "text").withColumn("longest", F.length("sentence"))
    pooled = E.max_pool(parts, "doc_id", ["longest"])
    return pooled.join(parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("sentence") == "").alias("n_empty")), "doc_id")


_SIGNS = {"question": "?", "exclamation": "!", "comma": ","}


@register("argmax_label", "WITH c AS (SELECT doc_id, length(text) - length(replace(text, '?', '')) AS q, length(text) - length(replace(text, '!', '')) AS e, length(text) - length(replace(text, ',', '')) AS c FROM documents) SELECT doc_id, CASE WHEN q >= e AND q >= c THEN 'question' WHEN e >= c THEN 'exclamation' ELSE 'comma' END AS label FROM c")
def argmax_label(spark, sf):
    scores = {n: F.length("text") - F.length(F.replace(F.col("text"), F.lit(s))) for n, s in _SIGNS.items()}
    return _docs(spark, sf).select("doc_id", E.argmax_label(scores).alias("label"))


_SPEAR = ["l_quantity", "l_discount", "l_tax"]


def _spearman_sql():
    parts = []
    for i, a in enumerate(_SPEAR):
        for b in _SPEAR[i + 1 :]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(rx, ry), 9) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS rx, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS ry FROM lineitem)")
    return " UNION ALL ".join(parts)


@register("spearman", _spearman_sql())
def spearman(spark, sf):
    return B.rounded(E.spearman(B.table(spark, sf, "lineitem"), _SPEAR), "rho")


@register("accuracy", "SELECT lang, round(avg((quality = toxic)::INT), 9)::DOUBLE AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy(spark, sf):
    joined = _docs(spark, sf).join(B.table(spark, sf, "labels"), "doc_id")
    return B.rounded(joined.groupBy("lang").agg(F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")), "accuracy")


# ------------------------------------------------ text functions


@register("captions", f"SELECT doc_id, md5(source || ' by ' || lang || ': ' || array_to_string({_WORDS.format('text')}[1:30], ' ') || '...') AS caption FROM documents")
def captions(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.caption(F.col("source"), X.people_line(F.col("lang")), X.first_words(F.col("text"), 30))).alias("caption"))


@register("identity_keys", "SELECT doc_id, md5(trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(trim(regexp_replace(lower(translate(text, '‘’“”–—', '''''\"\"--')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents")
def identity_keys(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.identity_key(F.col("source"), F.col("text"))).alias("key"))


_PLAIN_RUNS = B.TOKENS.format("text")


@register("topic_tokens", f"SELECT doc_id, len(list_filter(list_distinct({_PLAIN_RUNS}), lambda t: NOT list_contains([{', '.join(repr(w) for w in X.STOP_WORDS)}], t)))::INT AS n_topics FROM documents")
def topic_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(X.topic_tokens(F.col("text"))).alias("n_topics"))


@register("spans", None)
def spans(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(X.spans(F.col("text"))).alias("place", "s")).select("doc_id", "place", "s.span_id", "s.text")


@register("identifiers", "SELECT doc_id, 'V4H_' || lang || '_' || doc_id AS case_id, lang || '_VR' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS padded, doc_id AS canonical, coalesce(try_cast(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT), 1000000000) AS natural_number, sha256('seed|' || doc_id) AS order_hash FROM documents")
def identifiers(spark, sf):
    d = _docs(spark, sf)
    return d.select(
        "doc_id", X.case_id("V4H", F.col("lang"), F.col("doc_id")).alias("case_id"), F.regexp_replace(X.padded_id("T", F.col("lang"), F.col("doc_id") % 100), "^T_", "").alias("padded"),
        X.canonical_id(F.concat(F.lit("'"), F.col("doc_id").cast("string"), F.lit(".0'")), None).cast("long").alias("canonical"), X.natural_number(F.col("source")).alias("natural_number"), X.order_hash("seed", F.col("doc_id")).alias("order_hash"))


@register("number_formats", "SELECT l_returnflag, printf('%.1f%%', round(100 * avg(l_discount), 1)) AS discount, printf('%+.3f', round(avg(l_tax) - avg(l_discount), 3)) AS delta FROM lineitem GROUP BY l_returnflag")
def number_formats(spark, sf):
    g = B.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return g.select("l_returnflag", X.percent(F.col("d")).alias("discount"), X.signed(F.col("t") - F.col("d")).alias("delta"))


@register("parsed_events", "SELECT event_type, count(*) AS n, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0))::BIGINT AS total, count(*) FILTER (coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) % 2 = 0) AS even FROM events GROUP BY event_type")
def parsed_events(spark, sf):
    k = N.int_or_zero(F.get_json_object("props", "$.k"))
    even = N.parse_bool(F.when(k % 2 == 0, "Yes").otherwise("no"))
    return B.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.count_if(even).alias("even"))


@register("grade_names", f"SELECT CASE score WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'weak' WHEN 2 THEN 'partial' WHEN 3 THEN 'clear' ELSE 'strong' END AS grade, count(*) AS n FROM {B.graded_sql('a')} GROUP BY 1")
def grade_names(spark, sf):
    return B.graded(spark, sf).groupBy(N.grade_name(F.col("score")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------ reuse of scores

_SOURCE = "(SELECT l_partkey AS query_id, l_suppkey AS item_id, CAST(floor(max(l_quantity)) AS INT) % 5 AS score, min(l_orderkey) AS o FROM lineitem WHERE least(l_linenumber, 3) = {0} GROUP BY l_partkey, l_suppkey)"


def _source(spark, sf, line):
    rows = B.table(spark, sf, "lineitem").where(F.least("l_linenumber", F.lit(3)) == line)  # every line is in one of three sources
    return rows.groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("item_id")).agg((F.floor(F.max("l_quantity")).cast("int") % 5).alias("score"), F.min("l_orderkey").alias("o"))


_STACK = " UNION ALL ".join(f"SELECT query_id, item_id, score, {i} AS r FROM {_SOURCE.format(i + 1)}" for i in range(3))


@register("score_precedence", f"SELECT query_id, item_id, arg_min(score, r) AS score, min(r) AS source_rank, count(*) AS n_sources, (count(*) - count(*) FILTER (score = best))::BIGINT AS n_conflicts FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id, item_id ORDER BY r) AS best FROM ({_STACK})) GROUP BY query_id, item_id")
def score_precedence(spark, sf):
    return U.precedence([_source(spark, sf, i) for i in (1, 2, 3)], ["query_id", "item_id"])


@register("pending_cases", f"SELECT a.query_id, a.item_id FROM {_SOURCE.format(1)} a ANTI JOIN {_SOURCE.format(2)} b USING (query_id, item_id)")
def pending_cases(spark, sf):
    return U.pending(_source(spark, sf, 1), _source(spark, sf, 2), ["query_id", "item_id"]).select("query_id", "item_id")


@register("payload_reuse", f"""
SELECT a.query_id, a.item_id, CASE WHEN b.item_id IS NULL THEN 'novel' WHEN a.o % 2 = b.o % 2 THEN 'reused' ELSE 'mismatch' END AS status, CASE WHEN a.o % 2 = b.o % 2 THEN b.score END AS score
FROM {_SOURCE.format(1)} a LEFT JOIN {_SOURCE.format(2)} b USING (query_id, item_id)""")
def payload_reuse(spark, sf):
    def with_payload(line):
        return _source(spark, sf, line).withColumn("payload", X.payload_hash((F.col("o") % 2).alias("parity"), F.col("query_id").alias("query")))

    return U.payload_reuse(with_payload(1).drop("score"), with_payload(2), ["query_id", "item_id"]).select("query_id", "item_id", "status", "score")


@register("complete_map", f"SELECT query_id, item_id, coalesce(b.score, 4) AS score, CASE WHEN b.item_id IS NULL THEN 'novel' ELSE 'reused' END AS origin FROM {_SOURCE.format(1)} a LEFT JOIN {_SOURCE.format(2)} b USING (query_id, item_id)")
def complete_map(spark, sf):
    keys = ["query_id", "item_id"]
    inventory, known = _source(spark, sf, 1).select(*keys), _source(spark, sf, 2).select(*keys, "score")
    novel = U.pending(inventory, known, keys).withColumn("score", F.lit(4))
    return U.complete_map(inventory, known, novel, keys).select(*keys, "score", "origin")


@register("label_overlay", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels")
def label_overlay(spark, sf):
    labels = B.table(spark, sf, "labels")
    return U.overlay(labels, labels.where("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")), ["doc_id"], ["quality"]).select("doc_id", "quality", "toxic")


@register("changed_rows", "SELECT doc_id, quality AS before_quality, 1 - quality AS after_quality FROM labels WHERE doc_id % 5 = 0")
def changed_rows(spark, sf):
    labels = B.table(spark, sf, "labels")
    after = labels.withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return U.changed_rows(labels, after, ["doc_id"], ["quality"])


@register("cascade_match", """
WITH r AS (SELECT * FROM documents WHERE doc_id % 2 = 0), l AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
  a AS (SELECT text, lang, source, count(*) AS n, min(doc_id) AS m FROM r GROUP BY ALL), b AS (SELECT text, count(*) AS n, min(doc_id) AS m FROM r GROUP BY ALL), c AS (SELECT lang, source, n_chars, count(*) AS n, min(doc_id) AS m FROM r GROUP BY ALL)
SELECT l.doc_id, CASE WHEN a.n IS NOT NULL THEN 'all' WHEN b.n IS NOT NULL THEN 'text' WHEN c.n IS NOT NULL THEN 'shape' END AS strategy, coalesce(a.n, b.n, c.n, 0) AS n_candidates,
  CASE WHEN coalesce(a.n, b.n, c.n) = 1 THEN coalesce(a.m, b.m, c.m) END AS matched_id, CASE WHEN coalesce(a.n, b.n, c.n) IS NULL THEN 'unmatched' WHEN coalesce(a.n, b.n, c.n) = 1 THEN 'recovered' ELSE 'ambiguous' END AS status
FROM l LEFT JOIN a USING (text, lang, source) LEFT JOIN b USING (text) LEFT JOIN c ON c.lang = l.lang AND c.source = l.source AND c.n_chars = l.n_chars""")
def cascade_match(spark, sf):
    d = _docs(spark, sf)
    levels = {n: [(F.col(c), F.col(c)) for c in cols] for n, cols in (("all", ["text", "lang", "source"]), ("text", ["text"]), ("shape", ["lang", "source", "n_chars"]))}
    return U.cascade_match(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), levels, "doc_id", "doc_id")


@register("title_lookup", """
WITH w AS (SELECT r_name AS wanted, lower(trim(r_name)) AS k FROM region), c AS (SELECT n_nationkey AS item_id, lower(trim(n_name)) AS t FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name || ' region') FROM region UNION ALL SELECT 200 + r_regionkey, lower(r_name) FROM region WHERE r_regionkey % 2 = 0)
SELECT wanted, arg_min(item_id, (t <> k)::INT * 1000000 + item_id) AS item_id, CASE min((t <> k)::INT) WHEN 0 THEN 'exact' ELSE 'contains' END AS match FROM w JOIN c ON contains(t, k) GROUP BY wanted""")
def title_lookup(spark, sf):
    region, nation = B.table(spark, sf, "region"), B.table(spark, sf, "nation")
    catalog = nation.select(F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("title"))
    catalog = catalog.unionByName(region.select((100 + F.col("r_regionkey")).alias("item_id"), F.concat("r_name", F.lit(" region")).alias("title")))
    catalog = catalog.unionByName(region.where("r_regionkey % 2 = 0").select((200 + F.col("r_regionkey")).alias("item_id"), F.col("r_name").alias("title")))
    return U.title_lookup(region.select(F.col("r_name").alias("title")), catalog)


@register("aligned_union", "SELECT doc_id::VARCHAR AS id, lang, source, '' AS url FROM documents UNION ALL SELECT page_id::VARCHAR, '', '', url FROM pages")
def aligned_union(spark, sf):
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "lang", "source")
    return U.aligned_union([docs, B.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "url")])


# ------------------------------------------------ pools


@register("fresh_pool", """
WITH p AS (SELECT doc_id, md5(text) AS h FROM documents), c AS (SELECT doc_id, h FROM p JOIN labels USING (doc_id) WHERE quality = 0)
SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM c) AND h NOT IN (SELECT h FROM c)""")
def fresh_pool(spark, sf):
    pool = _docs(spark, sf).select("doc_id", F.md5("text").alias("h"))
    consumed = pool.join(B.table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id")
    return P.fresh(pool, consumed, ["doc_id", "h"]).select("doc_id")


@register("jaccard_pairs", f"""
WITH t AS (SELECT item_id AS id, list_filter(list_distinct({B.TOKENS.format('text')}), lambda t: NOT list_contains([{', '.join(repr(w) for w in X.STOP_WORDS)}], t)) AS t FROM benchmark),
  j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS x, len(b.t) AS y FROM t a JOIN t b ON a.id < b.id)
SELECT a, b, round(i / (x + y - i), 9) AS similarity FROM j WHERE i >= 0.1 * (x + y - i) - 1e-12 AND i > 0""")
def jaccard_pairs(spark, sf):
    sets = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), X.topic_tokens(F.col("text")).alias("tokens"))
    return B.rounded(P.similar_sets(sets, 0.1), "similarity")


_HASH = "sha256('{0}|' || {1})"


@register("hash_negative", f"""
SELECT lang, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format('neg', "lang || '|' || doc_id")}, doc_id) = 1""")
def hash_negative(spark, sf):
    pool = _docs(spark, sf).select("lang", "doc_id")
    return P.hash_negative(pool, pool.join(B.table(spark, sf, "labels").select("doc_id"), "doc_id"), "doc_id", "neg", ["lang"])


# eligible are the items of orders that no urgent one has used up; lists of full depth
_TARGETS = (2, 10, 30, 70)
_ELIGIBLE = f"(SELECT * FROM {B.graded_sql('a', 1000)} WHERE item_id // 10 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))"


def _slots_sql() -> str:
    out, parts, last = f"e AS (SELECT * FROM {_ELIGIBLE})", [], "0"
    for i, target in enumerate(_TARGETS):
        before = " UNION ALL ".join(f"SELECT query_id, r FROM s{j}" for j in range(i)) or "SELECT 0 AS query_id, 0 AS r WHERE false"
        out += f", s{i} AS (SELECT query_id, min(rank) AS r FROM e LEFT JOIN (SELECT query_id, max(r) AS last FROM ({before}) GROUP BY query_id) USING (query_id) WHERE rank >= {target} AND rank > coalesce(last, {last}) GROUP BY query_id)"
        parts.append(f"SELECT query_id, {target} AS target_rank, r AS rank FROM s{i}")
    return f"WITH {out} SELECT query_id, target_rank, rank, item_id FROM ({' UNION ALL '.join(parts)}) JOIN e USING (query_id, rank)"


@register("slot_sample", _slots_sql())
def slot_sample(spark, sf):
    ranked = B.graded(spark, sf, "a", 1000).withColumn("work", F.floor(F.col("item_id") / 10))
    used = B.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("work"))
    return P.slot_sample(ranked.join(used, "work", "left_anti"), _TARGETS).select("query_id", "target_rank", "rank", "item_id")


@register("blind_order", f"SELECT item_id, 'B' || lpad((row_number() OVER (ORDER BY {_HASH.format('blind', 'item_id')}, item_id))::VARCHAR, 6, '0') AS blind_id FROM benchmark")
def blind_order(spark, sf):
    return P.blind(B.table(spark, sf, "benchmark").select("item_id"), "item_id", "blind")


@register("balanced_split", f"""
WITH s AS (SELECT l.*, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format('split', 'doc_id')}, doc_id) <= 10 THEN 'validation' ELSE 'holdout' END AS split FROM labels l JOIN documents USING (doc_id))
SELECT split, lang, count(*) AS n, sum(quality)::BIGINT AS good FROM s GROUP BY split, lang""")
def balanced_split(spark, sf):
    pool = B.table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return P.hash_split(pool, "doc_id", ["lang"], 10, "split").groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


# ------------------------------------------------ judge; components are order lines, facets orders, cases customers

_COMPONENTS = """(SELECT o_custkey AS case_id, o_orderkey AS facet_id, l_linenumber AS spec_pos, 'C' || l_linenumber AS component_id, l_quantity >= 12 AS established, l_discount < 0.05 AS explicit, l_tax > 0.06 AS negative_boundary
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _components(spark, sf):
    rows = B.table(spark, sf, "orders").join(B.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("facet_id"), F.col("l_linenumber").alias("spec_pos"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("component_id"), (F.col("l_quantity") >= 12).alias("established"), (F.col("l_discount") < 0.05).alias("explicit"), (F.col("l_tax") > 0.06).alias("negative_boundary"))


_FACETS = f"""(SELECT case_id, facet_id, CASE WHEN bool_and(established AND explicit) THEN 'direct' WHEN bool_and(established) THEN 'entailed' WHEN bool_or(NOT established AND negative_boundary) THEN 'unsupported' WHEN bool_or(established) THEN 'adjacent' ELSE 'unsupported' END AS relation,
  arg_min(component_id, spec_pos) FILTER (NOT established) AS missing FROM {_COMPONENTS} GROUP BY case_id, facet_id)"""


@register("assemble_facets", f"SELECT case_id, facet_id, relation, CASE relation WHEN 'direct' THEN 'explicit_components' WHEN 'entailed' THEN 'necessary_semantic_inference' WHEN 'adjacent' THEN 'incomplete_connection' ELSE 'none' END AS inference_kind, CASE WHEN relation = 'adjacent' THEN missing END AS missing_component FROM {_FACETS}")
def assemble_facets(spark, sf):
    return J.assemble_facets(_components(spark, sf), ["case_id", "facet_id"])


_SUBJECTS = ["same_as_primary_subject", "defining_content_or_narrative_driver", "causal_or_contextual_background", "example_or_meta", "other"]


def _supported(spark, sf):
    facets = J.assemble_facets(_components(spark, sf), ["case_id", "facet_id"])
    subject = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (F.col("facet_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("facet_id") % 7 == 0, "qualifier").otherwise("core")
    full = facets.withColumns({"facet_type": kind, "prominence": J.prominence(J.context_role(subject, F.col("facet_id") % 2 == 0))})
    return full.withColumn("support", J.facet_support(F.col("facet_type"), F.col("relation"), F.col("prominence")))


_SUPPORTED = f"""(SELECT case_id, facet_id, relation, kind AS facet_type, prom AS prominence,
  CASE WHEN kind = 'qualifier' THEN CASE relation WHEN 'direct' THEN 'strong' WHEN 'entailed' THEN 'meaningful' ELSE 'absent' END
       WHEN relation = 'unsupported' THEN 'absent' WHEN relation = 'adjacent' OR prom = 'incidental' THEN 'incidental' WHEN relation = 'direct' AND prom = 'central' THEN 'strong' ELSE 'meaningful' END AS support
  FROM (SELECT *, CASE WHEN facet_id % 7 = 0 THEN 'qualifier' ELSE 'core' END AS kind, CASE facet_id % 5 WHEN 0 THEN 'central' WHEN 1 THEN 'substantive' WHEN 2 THEN CASE WHEN facet_id % 2 = 0 THEN 'substantive' ELSE 'incidental' END ELSE 'incidental' END AS prom FROM {_FACETS}))"""


@register("facet_support", f"SELECT case_id, facet_id, facet_type, prominence, support FROM {_SUPPORTED}")
def facet_support(spark, sf):
    return _supported(spark, sf).select("case_id", "facet_id", "facet_type", "prominence", "support")


@register("facet_score", f"""
WITH a AS (SELECT case_id, count(*) FILTER (c) AS n, count(*) FILTER (c AND v = 0) AS ab, max(v) FILTER (c) AS best, count(*) FILTER (c AND v >= 2) AS me, count(*) FILTER (c AND v = 3) AS st, count(*) FILTER (NOT c) AS q, count(*) FILTER (NOT c AND v = 0) AS qa, count(*) FILTER (NOT c AND v = 3) AS qs
  FROM (SELECT case_id, facet_type = 'core' AS c, CASE support WHEN 'absent' THEN 0 WHEN 'incidental' THEN 1 WHEN 'meaningful' THEN 2 ELSE 3 END AS v FROM {_SUPPORTED}) GROUP BY case_id HAVING count(*) FILTER (c) > 0),
  r AS (SELECT *, CASE WHEN best = 0 THEN 0 WHEN best = 1 THEN 1 WHEN st = n THEN 4 WHEN me >= ceil(2 * n / 3) OR (n = 2 AND st >= 1 AND ab = 0) THEN 3 ELSE 2 END AS raw FROM a)
SELECT case_id, CASE WHEN qa > 0 AND raw >= 3 THEN 2 WHEN raw = 4 AND qs < q THEN 3 ELSE raw END AS score, n AS n_core, me AS n_meaningful, st AS n_strong FROM r""")
def facet_score(spark, sf):
    return J.case_scores(_supported(spark, sf)).where("n_core > 0").select("case_id", "score", "n_core", "n_meaningful", "n_strong")


@register("best_candidate", f"SELECT case_id, arg_max(facet_id, CASE relation WHEN 'direct' THEN 3 WHEN 'entailed' THEN 2 WHEN 'adjacent' THEN 1 ELSE 0 END * 1e12 - facet_id) AS facet_id FROM {_FACETS} GROUP BY case_id")
def best_candidate(spark, sf):
    return J.best_candidate(J.assemble_facets(_components(spark, sf), ["case_id", "facet_id"]).withColumn("candidate_rank", F.col("facet_id")), ["case_id"]).select("case_id", "facet_id")


_RULES = [{"query_id": "Q", "facet_id": "en", "cue_id": "the-and", "any_regex": [], "all_regex_groups": [[r"\bthe\b", r"\band\b"]]}, {"query_id": "Q", "facet_id": "de", "cue_id": "und", "any_regex": [r"\bund\b"]}]


@register("direct_cue", None)
def direct_cue(spark, sf):
    cases = _docs(spark, sf).select(F.col("doc_id").alias("case_id"), F.lit("Q").alias("query_id"), F.col("lang").alias("facet_id"), X.spans(F.col("text")).alias("spans"))
    return J.direct_cues(cases, _RULES, before=[r"\b(?:not|no|never|nicht|kein)\b\W*$"], after=[r"^\W*\b(?:not|nicht)\b"])


@register("anchor_guard", r"""
WITH c AS (SELECT doc_id, lang, doc_id % 3 = 0 AS established, text FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' AND regexp_matches(text, '(?i)(^| )was the ') THEN true WHEN lang = 'en' AND NOT regexp_matches(text, '(?i)(^| )of ') THEN false WHEN lang = 'de' AND regexp_matches(text, '(?i)(^| )nicht ') THEN false ELSE established END AS guarded FROM c""")
def anchor_guard(spark, sf):
    checks = _docs(spark, sf).select("doc_id", F.col("lang").alias("query_id"), F.lit("c").alias("component_id"), (F.col("doc_id") % 3 == 0).alias("established"), "text")
    rules = spark.createDataFrame([("en", "c", "recover", r"(?i)(^| )was the "), ("en", "c", "require", r"(?i)(^| )of "), ("de", "c", "reject", r"(?i)(^| )nicht ")], "query_id string, component_id string, action string, pattern string")
    return J.anchor_guard(checks, rules).select("doc_id", "guarded")
