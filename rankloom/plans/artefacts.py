"""Queries: contracts, checks of pools, files written and read again, and the contracts of the judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text as X
from rankloom.operators import agreement as A
from rankloom.operators import contracts as K
from rankloom.operators import judge as J
from rankloom.operators import pools as P
from rankloom.operators import reuse as U
from rankloom.operators import verdict as V
from rankloom.operators.guard_rules import GUARDS, PATTERNS, RECOVERIES
from rankloom.plans import base as B
from rankloom.plans import preparation as prep
from rankloom.plans.catalogue import register
from rankloom.session import scratch
from rankloom.sources import files

# ------------------------------------------------ contracts


@register("duplicate_pairs", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(spark, sf):
    return K.duplicate_keys(B.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@register("rule_violations", """
SELECT unnest(['large_enough', 'taxed', 'labelled']) AS rule, unnest([count(*) FILTER (l_quantity < 3), count(*) FILTER (l_tax <= 0), count(*) FILTER (quality IS NULL)]) AS broken
FROM lineitem LEFT JOIN labels ON doc_id = l_partkey""")
def rule_violations(spark, sf):
    joined = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "labels"), F.col("doc_id") == F.col("l_partkey"), "left")
    return K.violations(joined, large_enough=F.col("l_quantity") >= 3, taxed=F.col("l_tax") > 0, labelled=F.col("quality") >= 0)


@register("rank_faults", f"""
SELECT query_id, count(*) AS n, min(rank) AS lo, max(rank) AS hi, count(DISTINCT rank) AS kinds FROM {prep._ELIGIBLE} GROUP BY query_id
HAVING min(rank) <> 1 OR max(rank) <> count(*) OR count(DISTINCT rank) <> count(*)""")
def rank_faults(spark, sf):
    urgent = B.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("work"))
    ranked = B.graded(spark, sf, "a", 1000).withColumn("work", F.floor(F.col("item_id") / 10))
    return K.rank_faults(ranked.join(urgent, "work", "left_anti"), ["query_id"], "rank")


@register("checked_join", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def checked_join(spark, sf):
    docs, labels = B.table(spark, sf, "documents").select("doc_id", "lang"), B.table(spark, sf, "labels").select("doc_id", "quality")
    K.require_covered(labels, docs, ["doc_id"])
    K.require_dependency(docs, ["doc_id"], "lang")
    return K.join_checked(docs, labels, ["doc_id"])


# ------------------------------------------------ pools

_POOL = "(SELECT doc_id, lang, md5(text) AS h, quality FROM documents LEFT JOIN labels USING (doc_id))"


def _pool(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("h")).join(B.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("overlap_report", f"WITH p AS {_POOL} SELECT 'doc_id' AS key, count(*) FILTER (quality = 0) AS overlap FROM p UNION ALL SELECT 'h', count(*) FILTER (h IN (SELECT h FROM p WHERE quality = 0)) FROM p")
def overlap_report(spark, sf):
    pool = _pool(spark, sf)
    return P.overlap_report(pool, pool.where("quality = 0"), ["doc_id", "h"])


@register("composition_faults", f"""
WITH p AS {_POOL}, f AS (SELECT 'lang' AS "column", lang AS value, count(*) AS found FROM p GROUP BY lang UNION ALL SELECT 'quality', quality::VARCHAR, count(*) FROM p GROUP BY quality),
  e AS (SELECT 'lang' AS "column", n_name AS value, 7 AS expected FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'lang', 'en', (SELECT count(*) FROM p WHERE lang = 'en') UNION ALL SELECT 'quality', '1', 1)
SELECT coalesce(e."column", f."column") AS "column", coalesce(e.value, f.value) AS value, coalesce(expected, 0)::BIGINT AS expected, coalesce(found, 0)::BIGINT AS found
FROM e FULL JOIN f ON e."column" = f."column" AND e.value IS NOT DISTINCT FROM f.value WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def composition_faults(spark, sf):
    pool = _pool(spark, sf)
    nations = B.table(spark, sf, "nation").where("n_regionkey = 0").select(F.lit("lang").alias("column"), F.col("n_name").alias("value"), F.lit(7).cast("long").alias("n"))
    english = pool.where("lang = 'en'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lang").alias("column"), F.lit("en").alias("value"), "n")
    good = spark.createDataFrame([("quality", "1", 1)], "column string, value string, n long")
    return P.composition_faults(pool, nations.unionByName(english).unionByName(good), ["lang", "quality"])


@register("unblinded", "SELECT doc_id, quality FROM labels")
def unblinded(spark, sf):
    labels = B.table(spark, sf, "labels").select("doc_id", "quality")
    blind = P.blind(labels, "doc_id", "study")
    return P.unblind(blind.select("blind_id", "quality"), blind.select("blind_id", "doc_id")).select("doc_id", "quality")


@register("quarantined", "SELECT coalesce(quality = 0 AND toxic = 1, false) AS held_back, count(*) AS n FROM labels GROUP BY 1")
def quarantined(spark, sf):
    kept, apart = P.quarantine(B.table(spark, sf, "labels"), F.expr("quality = 0 AND toxic = 1"))
    return kept.withColumn("held_back", F.lit(False)).unionByName(apart.withColumn("held_back", F.lit(True))).groupBy("held_back").agg(F.count(F.lit(1)).alias("n"))


@register("split_balance", f"""
WITH s AS (SELECT quality, row_number() OVER (PARTITION BY lang ORDER BY sha256('split|' || doc_id), doc_id) <= 10 AS v FROM labels JOIN documents USING (doc_id))
SELECT sum(abs(2 * got - total))::BIGINT AS imbalance FROM (SELECT quality, count(*) FILTER (v) AS got, count(*) AS total FROM s GROUP BY quality)""")
def split_balance(spark, sf):
    pool = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return P.balance(P.hash_split(pool, "doc_id", ["lang"], 10, "split"), "quality")


@register("score_conflicts", f"""
SELECT query_id, item_id, n_conflicts FROM (SELECT query_id, item_id, (count(*) - count(*) FILTER (score = best))::BIGINT AS n_conflicts
  FROM (SELECT *, first_value(score) OVER (PARTITION BY query_id, item_id ORDER BY r) AS best FROM ({prep._STACK})) GROUP BY query_id, item_id) WHERE n_conflicts > 0""")
def score_conflicts(spark, sf):
    return U.conflicts([prep._source(spark, sf, i) for i in (1, 2, 3)], ["query_id", "item_id"]).select("query_id", "item_id", "n_conflicts")


@register("adjudicated_agreement", """
SELECT count(*) AS n, round(avg((judge = h)::INT), 9)::DOUBLE AS exact, count(*) FILTER (abs(judge - h) >= 2) AS severe, count(*) FILTER (h = 0 AND judge > 0) AS false_positive
FROM (SELECT judge, CASE WHEN abs(judge - human) >= 3 THEN judge ELSE human END AS h FROM (SELECT (o_custkey % 5)::INT AS human, (floor(o_totalprice)::BIGINT % 5)::INT AS judge FROM orders))""")
def adjudicated_agreement(spark, sf):
    pairs = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5).cast("int").alias("human"), (F.floor("o_totalprice") % 5).cast("int").alias("judge"))
    settled = A.disagreements(pairs, least=3).select("case_id", F.col("judge").alias("human"))
    found = A.agreement(U.overlay(pairs, settled, ["case_id"], ["human"]))
    return B.rounded(found.select("n", "exact", "severe", "false_positive"), "exact")


# ------------------------------------------------ files, written to the session's shared folder and read again


@register("csv_round_trip", "SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_type || '\"' || chr(10) AS label, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS brand FROM part")
def csv_round_trip(spark, sf):
    rows = B.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"\n')).alias("label"), F.expr("CASE WHEN p_size > 25 THEN p_brand END").alias("brand"))
    path = scratch(spark, "csv")
    files.write_csv(rows, path)
    return files.read_text_csv(spark, path)


@register("lines_round_trip", "SELECT doc_id AS item_id, trim(lang || ' ' || source) AS text FROM documents")
def lines_round_trip(spark, sf):
    path = scratch(spark, "lines")
    lines = B.table(spark, sf, "documents").select(F.concat(F.lit('"'), F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source"), F.lit('"')).alias("line"))
    files.write_lines(lines, "line", path)
    return files.read_tagged(spark, path)


@register("appended", "SELECT n_nationkey, n_name FROM nation")
def appended(spark, sf):
    nations, path = B.table(spark, sf, "nation").select("n_nationkey", "n_name"), scratch(spark, "appended")
    files.append_new(nations.where("n_regionkey < 3") if "n_regionkey" in nations.columns else nations.where("n_nationkey < 15"), path, ["n_nationkey"])
    files.append_new(nations.unionByName(nations), path, ["n_nationkey"])
    return spark.read.parquet(path)


@register("file_digests", "SELECT sum(strlen(r_name) + 2)::BIGINT AS length, sha256(string_agg(r_name || chr(13) || chr(10), '' ORDER BY r_name)) AS raw, sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS any_line_end FROM region")
def file_digests(spark, sf):
    path = scratch(spark, "digests")
    names = B.table(spark, sf, "region").select(F.concat("r_name", F.lit("\r")).alias("line")).coalesce(1).sortWithinPartitions("line")
    files.write_lines(names, "line", path)
    raw, plain = files.file_hashes(spark, f"{path}/part-*"), files.file_hashes(spark, f"{path}/part-*", any_line_end=True)
    return raw.select("path", "length", F.col("sha256").alias("raw")).join(plain.select("path", F.col("sha256").alias("any_line_end")), "path").drop("path")


_FOLDED = r"""list_filter(regexp_extract_all(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[''’]', '', 'g'), '[\p{L}\p{N}_]+'), lambda t: NOT contains(t, '_') AND length(t) >= 2)"""


@register("folded_tokens", f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS terms FROM (SELECT doc_id, {_FOLDED} AS t FROM documents)")
def folded_tokens(spark, sf):
    rows = B.table(spark, sf, "documents").select("doc_id", X.folded_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("terms"))


# ------------------------------------------------ judge: results are orders, components their lines

_RESULTS = """(SELECT o_orderkey AS facet_id, list(struct_pack(component_id := 'C' || l_linenumber % 6, established := l_quantity >= 8, negative_boundary := l_tax > 0.07,
    span_ids := CASE WHEN l_quantity >= 10 THEN ['S' || (l_partkey % 5), 'S' || (l_partkey % 7)] ELSE [] END) ORDER BY l_linenumber) AS checks,
  list('C' || l_linenumber ORDER BY l_linenumber) AS spec, ['S0', 'S1', 'S2', 'S3', 'S4', 'S5'] AS allowed,
  any_value(['direct', 'entailed', 'adjacent', 'unsupported'][o_orderkey % 4 + 1]) AS relation, any_value(['explicit_components', 'necessary_semantic_inference', 'incomplete_connection', 'none'][o_custkey % 4 + 1]) AS inference_kind,
  any_value(o_custkey % 3 = 0) AS all_established, any_value(CASE WHEN o_custkey % 5 < 3 THEN 'C' || o_custkey % 5 + 1 END) AS missing_component, any_value(o_orderkey % 11 = 0) AS definition_excluded,
  any_value(o_orderkey % 7 = 0) AS triggered, any_value(CASE WHEN o_orderkey % 7 < 2 THEN 'X' || o_custkey % 3 END) AS exclusion_id, any_value(CASE WHEN o_custkey % 2 = 0 THEN ['X0', 'X1'] ELSE [] END) AS exclusions, any_value(o_orderstatus) AS reason
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def _results(spark, sf):
    lines = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("facet_id"), "l_linenumber", F.expr("concat('C', l_linenumber % 6)").alias("component_id"), (F.col("l_quantity") >= 8).alias("established"), (F.col("l_tax") > 0.07).alias("negative_boundary"),
        F.expr("CASE WHEN l_quantity >= 10 THEN array(concat('S', l_partkey % 5), concat('S', l_partkey % 7)) ELSE array() END").alias("span_ids"))
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "component_id", "established", "negative_boundary", "span_ids")))
    checks = lines.groupBy("facet_id").agg(own.alias("c")).select(
        "facet_id", F.transform("c", lambda x: F.struct(x["component_id"], x["established"], x["negative_boundary"], x["span_ids"])).cast(V.CHECKS).alias("checks"),
        F.transform("c", lambda x: F.concat(F.lit("C"), x["l_linenumber"].cast("string"))).alias("spec"))
    orders = B.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS facet_id", "array('S0', 'S1', 'S2', 'S3', 'S4', 'S5') AS allowed", "array('direct', 'entailed', 'adjacent', 'unsupported')[int(o_orderkey % 4)] AS relation",
        "array('explicit_components', 'necessary_semantic_inference', 'incomplete_connection', 'none')[int(o_custkey % 4)] AS inference_kind", "o_custkey % 3 = 0 AS all_established",
        "CASE WHEN o_custkey % 5 < 3 THEN concat('C', o_custkey % 5 + 1) END AS missing_component", "o_orderkey % 11 = 0 AS definition_excluded", "o_orderkey % 7 = 0 AS triggered",
        "CASE WHEN o_orderkey % 7 < 2 THEN concat('X', o_custkey % 3) END AS exclusion_id", "CASE WHEN o_custkey % 2 = 0 THEN array('X0', 'X1') ELSE array() END AS exclusions", "o_orderstatus AS reason")
    return checks.join(orders, "facet_id")


_WHOLE = "list_bool_and(list_transform(checks, lambda c: c.established))"
_IDS = "list_transform(checks, lambda c: c.component_id)"
_FAULTS = {
    "a component without id": "false",
    "repeated components": f"len(list_distinct({_IDS})) <> len(checks)",
    "other components than the facet's": f"len(list_filter(spec, lambda s: NOT list_contains({_IDS}, s))) > 0 OR len(list_filter({_IDS}, lambda s: NOT list_contains(spec, s))) > 0",
    "components out of order": f"len(list_filter(spec, lambda s: NOT list_contains({_IDS}, s))) = 0 AND len(list_filter({_IDS}, lambda s: NOT list_contains(spec, s))) = 0 AND len(spec) = len(checks) AND {_IDS} <> spec",
    "repeated spans": "len(list_filter(checks, lambda c: len(list_distinct(c.span_ids)) <> len(c.span_ids))) > 0",
    "unknown spans": "len(list_filter(checks, lambda c: len(list_filter(c.span_ids, lambda s: NOT list_contains(allowed, s))) > 0)) > 0",
    "established without spans": "len(list_filter(checks, lambda c: c.established AND len(c.span_ids) = 0)) > 0",
    "missing with spans": "len(list_filter(checks, lambda c: NOT c.established AND len(c.span_ids) > 0)) > 0",
    "established across a boundary": "len(list_filter(checks, lambda c: c.established AND c.negative_boundary)) > 0",
    "all_established isn't the ledger's": f"all_established <> {_WHOLE}",
    "positive with an incomplete ledger": f"relation IN ('direct', 'entailed') AND NOT {_WHOLE}",
    "adjacent with a complete ledger": f"relation = 'adjacent' AND {_WHOLE}",
    "missing component isn't the facet's": "missing_component IS NOT NULL AND NOT list_contains(spec, missing_component)",
    "missing component is established": "missing_component IS NOT NULL AND len(list_filter(checks, lambda c: c.established AND c.component_id = missing_component)) > 0",
    "excluded by definition but not unsupported": "definition_excluded AND relation <> 'unsupported'",
    "positive without all components": "relation IN ('direct', 'entailed') AND NOT all_established",
    "positive with a missing component": "relation IN ('direct', 'entailed') AND missing_component IS NOT NULL",
    "adjacent with all components": "relation = 'adjacent' AND all_established",
    "adjacent without a missing component": "relation = 'adjacent' AND missing_component IS NULL",
    "complete with a missing component": "all_established AND missing_component IS NOT NULL",
    "exclusion isn't the facet's": "triggered AND NOT list_contains(exclusions, exclusion_id)",
    "exclusion without unsupported": "triggered AND relation <> 'unsupported'",
    "exclusion with an inference": "triggered AND inference_kind <> 'none'",
    "exclusion named but not triggered": "NOT triggered AND exclusion_id IS NOT NULL",
    "inference kind doesn't fit the relation": "inference_kind <> CASE relation WHEN 'direct' THEN 'explicit_components' WHEN 'entailed' THEN 'necessary_semantic_inference' WHEN 'adjacent' THEN 'incomplete_connection' ELSE 'none' END",
    "entailed by speculation": "relation = 'entailed' AND reason = 'P'",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register("result_faults", "WITH r AS " + _RESULTS + " SELECT facet_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_quoted(n)} END" for n, c in _FAULTS.items()) + "], lambda x: x IS NOT NULL)) AS fault FROM r")
def result_faults(spark, sf):
    return V.result_faults(_results(spark, sf), ["facet_id"], forbidden=("^p$",))


@register("settled_exclusions", f"""
SELECT facet_id, CASE WHEN hit THEN 'unsupported' ELSE relation END AS relation, CASE WHEN hit THEN 'none' ELSE inference_kind END AS inference_kind, CASE WHEN len(exclusions) = 0 THEN false ELSE triggered END AS triggered,
  CASE WHEN len(exclusions) > 0 THEN exclusion_id END AS exclusion_id, CASE WHEN hit THEN 0 ELSE 6 END AS n_spans
FROM (SELECT *, coalesce(triggered AND list_contains(exclusions, exclusion_id), false) AS hit FROM {_RESULTS})""")
def settled_exclusions(spark, sf):
    found = V.with_exclusions_settled(_results(spark, sf).withColumn("span_ids", F.col("allowed")))
    return found.select("facet_id", "relation", "inference_kind", "triggered", "exclusion_id", F.size("span_ids").alias("n_spans"))


@register("candidate_faults", r"""
WITH s AS (SELECT doc_id, list_distinct(list_transform(range(0, doc_id % 4 + 1), lambda i: CASE WHEN (doc_id // 3 + i) % 5 = 0 THEN 'NONE' ELSE 'S' || (doc_id + i) % 6 END)) || CASE WHEN doc_id % 10 = 0 THEN ['S' || doc_id % 6] ELSE [] END AS c FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN c <> ['NONE'] AND list_contains(c, 'NONE') THEN 'NONE beside span ids' END, CASE WHEN len(list_distinct(c)) <> len(c) THEN 'repeated candidates' END, CASE WHEN len(c) > 3 THEN 'too many candidates' END,
  CASE WHEN len(list_filter(c, lambda x: x <> 'NONE' AND NOT list_contains(['S0', 'S1', 'S2', 'S3'], x))) > 0 THEN 'unknown candidates' END], lambda x: x IS NOT NULL)) AS fault FROM s""")
def candidate_faults(spark, sf):
    made = "array_distinct(transform(sequence(0L, doc_id % 4), i -> CASE WHEN (doc_id DIV 3 + i) % 5 = 0 THEN 'NONE' ELSE concat('S', (doc_id + i) % 6) END))"
    rows = B.table(spark, sf, "documents").select("doc_id", F.expr(f"concat({made}, CASE WHEN doc_id % 10 = 0 THEN array(concat('S', doc_id % 6)) ELSE array() END)").alias("c"))
    return V.faults(rows, ["doc_id"], V.candidate_rules(F.col("c"), F.array(*[F.lit(f"S{i}") for i in range(4)])))


#: Phrases that evidence is put together from, one after another.
_PHRASES = (
    "The rebels resisted", "a totalitarian regime", "a long journey across the sea", "shipwrecked sailors", "She learned philosophy", "and grew in confidence", "their love when he discovers the secret", "a dangerous pursuit",
    "the war and its wounds", "the death of a friend", "silos and culture", "improved performance of corporate goals", "evidence for the origin of the legend", "stories of gods and heroes", "a retelling of the Odyssey", "the enchantress",
    "a quest", "nothing at all", "his mother", "self-awakening", "a meaningful life", "sent the knight after", "a deadly beast", "this story of grief")
_PARTS = sorted({(f, c or "any") for f, c, *_ in GUARDS} | {(f, c) for f, c, *_ in RECOVERIES})


def _list_sql(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


_EVIDENCE = f"""(SELECT o_orderkey AS case_id, {_list_sql(p[0] for p in _PARTS)}[o_orderkey % {len(_PARTS)} + 1] AS facet, {_list_sql(p[1] for p in _PARTS)}[o_orderkey % {len(_PARTS)} + 1] AS component,
  ['missing', 'explicit', 'entailed'][o_custkey % 3 + 1] AS grounding, {_list_sql(_PHRASES)}[o_custkey % {len(_PHRASES)} + 1] AS a, {_list_sql(_PHRASES)}[(o_orderkey // 7) % {len(_PHRASES)} + 1] AS b FROM orders)"""


def _evidence(spark, sf):
    array = lambda values: F.array(*[F.lit(v) for v in values])
    at = F.expr(f"int(o_orderkey % {len(_PARTS)})")
    rows = B.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), array(p[0] for p in _PARTS)[at].alias("facet"), array(p[1] for p in _PARTS)[at].alias("component"), array(("missing", "explicit", "entailed"))[F.expr("int(o_custkey % 3)")].alias("grounding"),
        array(_PHRASES)[F.expr(f"int(o_custkey % {len(_PHRASES)})")].alias("a"), array(_PHRASES)[F.expr(f"int((o_orderkey DIV 7) % {len(_PHRASES)})")].alias("b"))
    return rows


def _has(text: str, name: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {_quoted(PATTERNS[x])}, 'is')" for x in name.split("|")) + ")"


def _guards_sql() -> str:
    """One step for each rule, as rules apply in order."""
    step, text = "grounding", "(a || ' ' || b)"
    out = f"s AS (SELECT case_id, facet, component, {text} AS t, grounding AS g0 FROM {_EVIDENCE})"
    for i, (facet, part, found, absent, sets) in enumerate(GUARDS):
        when = [f"facet = {_quoted(facet)}", f"g{i} {'<>' if sets == 'missing' else '='} 'missing'"] + ([f"component = {_quoted(part)}"] if part else [])
        when += [_has("t", x) for x in found] + [f"NOT {_has('t', x)}" for x in absent]
        out += f", s{i} AS (SELECT *, CASE WHEN {' AND '.join(when)} THEN '{sets}' ELSE g{i} END AS g{i + 1} FROM {'s' if not i else f's{i - 1}'})"
    return f"WITH {out} SELECT case_id, g0 AS grounding, g{len(GUARDS)} AS guarded FROM s{len(GUARDS) - 1}".replace(step + " AS g0", "grounding AS g0")


@register("text_anchors", _guards_sql())
def text_anchors(spark, sf):
    return _evidence(spark, sf).select("case_id", "grounding", V.guarded(F.col("grounding"), F.col("facet"), F.col("component"), F.concat_ws(" ", "a", "b")).alias("guarded"))


def _recoveries_sql() -> str:
    cases = []
    for facet, part, groups, absent, sets in RECOVERIES:
        hit = lambda text, g: "(" + " AND ".join(_has(text, x) for x in g) + ")"
        lists = ["list_filter([CASE WHEN " + hit("a", g) + " THEN 'S1' END, CASE WHEN " + hit("b", g) + " THEN 'S2' END], lambda x: x IS NOT NULL)" for g in groups]
        when = [f"facet = {_quoted(facet)}", f"component = {_quoted(part)}", *[f"len({x}) > 0" for x in lists], *[f"NOT {_has(chr(39).join(['(a || ', ' ', ' || b)']), x)}" for x in absent]]
        ids = "list_concat(" + lists[0] + ", " + (lists[1] if len(lists) > 1 else "[]::VARCHAR[]") + ")"
        cases.append(f"WHEN {' AND '.join(when)} THEN '{sets}:' || array_to_string(list_filter(list_concat({ids}[1:1], list_filter({ids}[2:], lambda x: x <> {ids}[1])[1:1]), lambda x: x IS NOT NULL), ',')")
    return f"SELECT case_id, CASE {' '.join(cases)} END AS recovered FROM {_EVIDENCE}"


@register("recovered_components", _recoveries_sql())
def recovered_components(spark, sf):
    spans = F.array(*[F.struct(F.lit(f"S{i}").alias("span_id"), F.col(c).alias("text")) for i, c in ((1, "a"), (2, "b"))])
    r = _evidence(spark, sf).select("case_id", V.recovered(F.col("facet"), F.col("component"), spans).alias("r"))
    return r.select("case_id", F.when(F.col("r").isNotNull(), F.concat("r.grounding", F.lit(":"), F.array_join("r.span_ids", ","))).alias("recovered"))


@register("capped_score", """
WITH f AS (SELECT case_id, facet_id, facet_type = 'core' AS c, CASE support WHEN 'absent' THEN 0 WHEN 'incidental' THEN 1 WHEN 'meaningful' THEN 2 ELSE 3 END AS v FROM """ + prep._SUPPORTED + """),
  a AS (SELECT case_id, count(*) FILTER (c) AS n, count(*) FILTER (c AND v = 0) AS ab, max(v) FILTER (c) AS best, count(*) FILTER (c AND v >= 2) AS me, count(*) FILTER (c AND v = 3) AS st, count(*) FILTER (NOT c) AS q, count(*) FILTER (NOT c AND v = 0) AS qa, count(*) FILTER (NOT c AND v = 3) AS qs,
        min(facet_id % 3) FILTER (c AND v = 0 AND facet_id % 2 = 0) AS cap FROM f GROUP BY case_id HAVING count(*) FILTER (c) > 0),
  r AS (SELECT *, CASE WHEN best = 0 THEN 0 WHEN best = 1 THEN 1 WHEN st = n THEN 4 WHEN me >= ceil(2 * n / 3) OR (n = 2 AND st >= 1 AND ab = 0) THEN 3 ELSE 2 END AS raw FROM a),
  k AS (SELECT *, CASE WHEN raw >= 3 AND cap IS NOT NULL THEN least(raw, cap) ELSE raw END AS capped FROM r)
SELECT case_id, (CASE WHEN qa > 0 AND capped >= 3 THEN 2 WHEN capped = 4 AND qs < q THEN 3 ELSE capped END)::INT AS score FROM k""")
def capped_score(spark, sf):
    facets = prep._supported(spark, sf)
    caps = facets.where("facet_id % 2 = 0").select("case_id", "facet_id", (F.col("facet_id") % 3).cast("int").alias("cap"))
    return J.case_scores(facets, caps=caps).where("n_core > 0").select("case_id", "score")


@register("case_summaries", f"""
SELECT case_id, string_agg('t' || facet_id, '; ' ORDER BY facet_id) FILTER (support <> 'absent' AND facet_type = 'core') AS matched_core,
  CASE WHEN max(facet_id) % 3 > 0 THEN string_agg(facet_id || ': e' || facet_id % 9, ' | ' ORDER BY facet_id) FILTER (support <> 'absent' AND facet_id % 9 > 0) END AS evidence_text,
  md5('[' || string_agg('{{"facet_id":' || facet_id || ',"facet_text":"t' || facet_id || '","facet_type":"' || facet_type || '","support":"' || support || '"}}', ',' ORDER BY facet_id) || ']') AS audit
FROM {prep._SUPPORTED} GROUP BY case_id""")
def case_summaries(spark, sf):
    facets = prep._supported(spark, sf).select("case_id", "facet_id", F.col("facet_id").alias("facet_pos"), F.expr("concat('t', facet_id)").alias("facet_text"), "facet_type", "support")
    scores = facets.groupBy("case_id").agg((F.max("facet_id") % 3).alias("score"))
    shown = facets.withColumn("evidence", F.expr("CASE WHEN facet_id % 9 > 0 THEN concat('e', facet_id % 9) ELSE '' END"))
    texts, audit = V.summaries(shown, scores), V.summaries(facets.withColumn("evidence", F.lit(None).cast("string")), scores)
    plain = F.md5(F.regexp_replace("assessments_json", ',"evidence":null', ""))
    return texts.select("case_id", "matched_core", "evidence_text").join(audit.select("case_id", plain.alias("audit")), "case_id")
