"""Deterministic part of a facet judge: component assembly, support, 0 to 4 scores, cue rules and guards.

Components roll up to facets and facets to cases by two aggregations; cue and guard rules are rows of data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of a verified relation; the support scale.
RELATIONS = ("unsupported", "adjacent", "entailed", "direct")
SUPPORT = ("absent", "incidental", "meaningful", "strong")
#: What a facet's relation to the subject makes it, and how prominent that is.
ROLE_OF_SUBJECT = {
    "same_as_primary_subject": "central_subject",
    "defining_content_or_narrative_driver": "substantive_subject",
    "example_or_meta": "example_or_illustration",
}
PROMINENCE_OF_ROLE = {
    "not_applicable": "not_applicable",
    "central_subject": "central",
    "substantive_subject": "substantive",
    "background_cause": "incidental",
    "example_or_illustration": "incidental",
    "meta_discussion": "incidental",
    "incidental_mention": "incidental",
}
#: Wording that singles out one item of a collection, and that names a collection.
ONE_ITEM = (
    r"\b(?:title|opening|closing|first|last|final)\s+(?:story|tale|essay|chapter|entry|episode|piece)\b",
    r"\b(?:in|from)\s+(?:one|a|the)\s+(?:story|tale|essay|chapter|entry|episode|piece)\b",
    r"\b(?:one|a|the)\s+(?:story|tale|essay|chapter|entry|episode|piece)\s+(?:in|from)\b",
)
COLLECTION = r"\b(?:collection|anthology)\b"
POSSESSED_ITEM = r"\b(?:his|her|their|my|our|your)\s+[A-Za-z][A-Za-z'’-]*(?:\s+[A-Za-z][A-Za-z'’-]*){0,3}"
PROMOTED = ("same_as_primary_subject", "defining_content_or_narrative_driver")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def level(name: Column, scale: tuple[str, ...]) -> Column:
    """Place of a name on a scale, from 0; null for others."""
    return F.create_map(*[x for i, n in enumerate(scale) for x in (F.lit(n), F.lit(i))])[name]


def context_role(relation: Column, examined: Column) -> Column:
    """The role that a facet plays, from its relation to the subject."""
    background = F.when(F.coalesce(examined, F.lit(False)), "substantive_subject").otherwise("background_cause")
    return F.when(relation == "causal_or_contextual_background", background).otherwise(F.coalesce(_lookup(relation, ROLE_OF_SUBJECT), F.lit("incidental_mention")))


def prominence(role: Column) -> Column:
    """How prominent a role is; an unknown role is an error."""
    found = _lookup(role, PROMINENCE_OF_ROLE)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))))


def facet_support(kind: Column, relation: Column, prominent: Column) -> Column:
    """absent, incidental, meaningful or strong; a qualifier counts by its relation alone."""
    qualifier = F.when(relation == "direct", "strong").when(relation == "entailed", "meaningful").otherwise("absent")
    core = F.when(relation == "unsupported", "absent").when((relation == "adjacent") | (prominent == "incidental"), "incidental")
    core = core.when((relation == "direct") & (prominent == "central"), "strong").otherwise("meaningful")
    return F.when(kind == "qualifier", qualifier).otherwise(core)


def assemble_facets(components: DataFrame, keys: list[str], composite: bool = False, most_spans: int = 4) -> DataFrame:
    """Facet relations from component results.

    ``components`` has the keys, component_id, spec_pos, established, explicit, negative_boundary and, for composites,
    span_ids. All established is direct if all are explicit (never for a composite), else entailed; a broken boundary of a
    missing component is unsupported; any established is adjacent and names the first missing one.
    """
    aggs = [
        F.bool_and("established").alias("_all"), F.bool_or("established").alias("_any"), F.bool_and(F.col("established") & F.col("explicit")).alias("_explicit"),
        F.bool_or(~F.col("established") & F.col("negative_boundary")).alias("_boundary"),
        F.min_by("component_id", F.when(~F.col("established"), F.col("spec_pos"))).alias("_missing"),
    ]
    if composite:
        aggs.append(F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("established"), F.col("span_ids")))))).alias("_spans"))
    out = components.groupBy(*keys).agg(*aggs)
    direct = F.lit(False) if composite else F.col("_explicit")
    wide = F.coalesce(F.col("_spans") > most_spans, F.lit(False)) if composite else F.lit(False)
    relation = F.when(wide, "unsupported").when(direct, "direct").when(F.col("_all"), "entailed").when(F.col("_boundary"), "unsupported").when(F.col("_any"), "adjacent").otherwise("unsupported")
    kind = _lookup(F.col("relation"), {"direct": "explicit_components", "entailed": "necessary_semantic_inference", "adjacent": "incomplete_connection", "unsupported": "none"})
    return out.withColumn("relation", relation).withColumn("inference_kind", kind).withColumn("missing_component", F.when(F.col("relation") == "adjacent", F.col("_missing"))).select(*keys, "relation", "inference_kind", "missing_component")


def best_candidate(records: DataFrame, keys: list[str], relation: str = "relation", rank: str = "candidate_rank") -> DataFrame:
    """The strongest verified candidate of each group, the lower rank on ties."""
    chosen = F.max_by(F.struct(*[F.col(c) for c in records.columns if c not in keys]), F.struct(level(F.col(relation), RELATIONS), -F.col(rank)))
    return records.groupBy(*keys).agg(chosen.alias("_b")).select(*keys, "_b.*")


def merge_composite(single: DataFrame, composite: DataFrame, keys: list[str]) -> DataFrame:
    """The composite's relation replaces the single span's only where it is strictly stronger."""
    joined = single.join(composite.select(*keys, F.col("relation").alias("_c")), keys, "left")
    stronger = F.coalesce(level(F.col("_c"), RELATIONS) > level(F.col("relation"), RELATIONS), F.lit(False))
    return joined.withColumns({"relation": F.when(stronger, F.col("_c")).otherwise(F.col("relation")), "from_composite": stronger}).drop("_c")


def case_scores(facets: DataFrame, key: str = "case_id", caps: DataFrame | None = None) -> DataFrame:
    """A 0 to 4 score for each case from its facets' support (columns key, facet_id, facet_type, support).

    All core facets absent: 0; none beyond incidental: 1; all strong: 4; two thirds at least meaningful, or one of two
    strong with none absent: 3; else 2. ``caps`` (key, facet_id, cap) limits a score of 3 or more where the named core facet is
    absent. An absent qualifier then limits it to 2, and 4 needs all qualifiers strong.
    """
    value, core, qualifier = level(F.col("support"), SUPPORT), F.col("facet_type") == "core", F.col("facet_type") == "qualifier"
    rows = facets
    if caps is not None:
        rows = facets.join(caps, [key, "facet_id"], "left")
    else:
        rows = facets.withColumn("cap", F.lit(None).cast("int"))
    out = rows.groupBy(key).agg(
        F.count_if(core).alias("n_core"), F.count_if(core & (value == 0)).alias("n_absent"), F.max(F.when(core, value)).alias("best"),
        F.count_if(core & (value >= 2)).alias("n_meaningful"), F.count_if(core & (value == 3)).alias("n_strong"),
        F.count_if(qualifier).alias("n_qualifier"), F.count_if(qualifier & (value == 0)).alias("q_absent"), F.count_if(qualifier & (value == 3)).alias("q_strong"),
        F.min(F.when(core & (value == 0), F.col("cap"))).alias("cap"))
    enough = F.col("n_meaningful") >= F.ceil(2 * F.col("n_core") / 3)
    pair = (F.col("n_core") == 2) & (F.col("n_strong") >= 1) & (F.col("n_absent") == 0)
    raw = F.when(F.col("best") == 0, 0).when(F.col("best") == 1, 1).when(F.col("n_strong") == F.col("n_core"), 4).when(enough | pair, 3).otherwise(2)
    capped = F.when((raw >= 3) & F.col("cap").isNotNull(), F.least(raw, F.col("cap"))).otherwise(raw)
    score = F.when((F.col("q_absent") > 0) & (capped >= 3), 2).when((capped == 4) & (F.col("q_strong") < F.col("n_qualifier")), 3).otherwise(capped)
    return out.select(key, score.cast("int").alias("score"), "n_core", "n_meaningful", "n_strong", (score < capped).alias("qualifier_cap"))


# ---------------------------------------------------------------- rules over text


def _first_safe(pattern: str, text: str, before: list[str], after: list[str], pre: int, post: int) -> tuple[bool, int]:
    """Whether a match stands without negation around it, and how many don't."""
    blocked = 0
    for m in re.finditer(pattern, text, re.IGNORECASE):
        head, tail = text[max(0, m.start() - pre) : m.start()], text[m.end() : m.end() + post]
        if any(re.search(p, head, re.IGNORECASE) for p in before) or any(re.search(p, tail, re.IGNORECASE) for p in after):
            blocked += 1
        else:
            return True, blocked
    return False, blocked


def scan_cue(spans: list[tuple[str, str]], rules: list[dict], before: list[str], after: list[str], pre: int = 96, post: int = 64) -> tuple[str | None, str | None, int]:
    """First rule and span with a safe match: cue_id, span_id, blocked matches. Rules go first, then spans, then patterns."""
    blocked = 0
    for rule in rules:
        groups = [[p] for p in rule.get("any_regex") or []]
        for span_id, text in spans:
            for group in groups + [g for g in rule.get("all_regex_groups") or [] if g]:
                hit = True
                for pattern in group:
                    hit, n = _first_safe(pattern, text, before, after, pre, post)
                    blocked += n
                    if not hit:
                        break
                if hit:
                    return rule["cue_id"], span_id, blocked
    return None, None, blocked


def direct_cues(cases: DataFrame, rules: list[dict], before: list[str], after: list[str]) -> DataFrame:
    """Deterministic cues: case_id, facet_id, cue_id, span_id, blocked (cases: case_id, query_id, facet_id, spans).

    Match offsets are needed for the negation windows, which column expressions don't give: an Arrow batch UDF with the rule table.
    """
    by_facet: dict[tuple[str, str], list[dict]] = {}
    for r in rules:
        by_facet.setdefault((r["query_id"], r["facet_id"]), []).append(r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [scan_cue([(s["span_id"], s["text"]) for s in (spans if spans is not None else [])], by_facet.get((q, f), []), before, after) for q, f, spans in zip(df["query_id"], df["facet_id"], df["spans"], strict=True)]
            yield pd.DataFrame({"case_id": df["case_id"], "facet_id": df["facet_id"], "cue_id": [x[0] for x in found], "span_id": [x[1] for x in found], "blocked": [x[2] for x in found]})

    kind = dict(cases.dtypes)["case_id"]
    return cases.select("case_id", "query_id", "facet_id", "spans").mapInPandas(run, f"case_id {kind}, facet_id string, cue_id string, span_id string, blocked long")


def scope_phrase(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def named_at_collection(facet: Column, text: Column, before: int = 180, after: int = 240) -> Column:
    """Whether the facet's words stand near "collection" or "anthology"."""
    whole, phrase = scope_phrase(text), scope_phrase(facet)
    # what follows each cue, from the cue on: an empty match for each, so that cues near each other are all seen
    rests = F.regexp_extract_all(whole, F.lit(r"(?=(\b(?:collection|anthology)\b.*))"), 1)

    def near(rest: Column) -> Column:
        at = F.length(whole) - F.length(rest)
        low, high = F.greatest(at - before, F.lit(0)), at + F.length(F.regexp_extract(rest, "^(collection|anthology)", 1)) + after
        return F.contains(F.substr(whole, low + 1, high - low), phrase)

    return F.exists(rests, near) & (phrase != "")


def scope_guard(relation: Column, facet: Column, evidence: Column, whole: Column) -> Column:
    """Demotes evidence from one item of a collection to "other", unless the facet is named for the collection."""
    item = F.lit(False)
    for pattern in ONE_ITEM:
        item = item | evidence.rlike("(?i)" + pattern)
    return F.when(relation.isin(*PROMOTED) & item & whole.rlike("(?i)" + COLLECTION) & ~named_at_collection(facet, whole), "other").otherwise(relation)


def list_guard(relation: Column, evidence_span: Column, supporting: Column, evidence: Column) -> Column:
    """Demotes a cue that is one of three or more possessed things in a list, if no other span supports the role."""
    alone = ~F.exists(supporting, lambda s: s != evidence_span)
    listed = (F.regexp_count(evidence, F.lit("(?i)" + POSSESSED_ITEM)) >= 3) & (F.regexp_count(evidence, F.lit(",")) >= 2)
    return F.when(relation.isin(*PROMOTED) & F.coalesce(alone, F.lit(True)) & listed, "other").otherwise(relation)


def anchor_guard(checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Applies text anchors to component checks (query_id, component_id, established, text).

    ``rules`` (query_id, component_id, action, pattern): "require" un-establishes a component whose text lacks the pattern, "reject"
    one whose text has it, "recover" establishes one whose text has it. Rules are few and broadcast.
    """
    per = rules.groupBy("query_id", "component_id").agg(*[F.collect_list(F.when(F.col("action") == a, F.col("pattern"))).alias(f"_{a}") for a in ("require", "reject", "recover")])
    joined = checks.join(F.broadcast(per), ["query_id", "component_id"], "left")

    def any_match(column: str) -> Column:
        return F.coalesce(F.exists(F.col(column), lambda p: F.expr("true") & F.regexp_like(F.col("text"), p)), F.lit(False))

    lacks = (F.coalesce(F.size("_require"), F.lit(0)) > 0) & ~any_match("_require")
    guarded = F.when(any_match("_recover"), True).when(lacks | any_match("_reject"), False).otherwise(F.col("established"))
    return joined.withColumns({"guarded": guarded, "changed": guarded != F.col("established")}).drop("_require", "_reject", "_recover")


def assessment_faults(facets: DataFrame) -> DataFrame:
    """Broken invariants of stored assessments, one row for each: key columns and fault.

    Columns: case_id, facet_id, facet_type, relation, inference_kind, prominence, candidate_ids, winner, composite_ids, missing_component.
    """
    composite = F.size(F.coalesce("composite_ids", F.array().cast("array<string>"))) > 0
    candidates = F.coalesce("candidate_ids", F.array().cast("array<string>"))
    expected = _lookup(F.col("relation"), {"direct": "explicit_components", "entailed": "necessary_semantic_inference"})
    unneeded = F.col("relation").isin("unsupported", "adjacent") | (F.col("facet_type") == "qualifier")
    faults = {
        "too many or repeated candidates": (F.size(candidates) > 3) | (F.size(candidates) != F.size(F.array_distinct(candidates))),
        "winner isn't a candidate": (F.col("winner") != "NONE") & ~F.array_contains(candidates, F.col("winner")) & ~composite,
        "too many or repeated composite spans": composite & ((F.size("composite_ids") > 4) | (F.size("composite_ids") != F.size(F.array_distinct("composite_ids")))),
        "composite is direct": composite & (F.col("relation") == "direct"),
        "adjacent composite names no missing component": composite & (F.col("relation") == "adjacent") & F.col("missing_component").isNull(),
        "entailed names a missing component": (F.col("relation") == "entailed") & F.col("missing_component").isNotNull(),
        "inference kind doesn't fit the relation": expected.isNotNull() & (F.col("inference_kind") != expected),
        "prominence doesn't fit": (F.col("prominence") == "not_applicable") != unneeded,
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in faults.items()]))
    return facets.select("case_id", "facet_id", F.explode(found).alias("fault"))
