"""What holds a model's answers to the facet judge together: contracts, text anchors, the flow of stages and its records.

Answers are rows. Every contract is a list of (name, condition) over a row, so that one projection finds all faults of all
answers; text anchors are rows of ``guard_rules``; models are functions that the caller passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import spans as split_spans
from rankloom.operators import judge as J
from rankloom.operators.guard_rules import GUARDS, PATTERNS, RECOVERIES

NONE, MOST_CANDIDATES, MOST_COMPOSITE = "NONE", 3, 4
#: The kinds of inference that fit a relation.
KINDS_OF = {"direct": ["explicit_components"], "entailed": ["necessary_semantic_inference"], "adjacent": ["incomplete_connection"], "unsupported": ["none"]}
_POSITIVE = ("direct", "entailed")
CHECKS = "array<struct<component_id: string, established: boolean, negative_boundary: boolean, span_ids: array<string>>>"


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def _texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _repeats(x: Column) -> Column:
    return F.size(x) != F.size(F.array_distinct(x))


def faults(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (keys, fault) for each broken rule of each row; ``rules`` are conditions that mean a fault (null: none)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("fault"))


# ---------------------------------------------------------------- contracts


def candidate_rules(candidates: Column, known: Column) -> dict[str, Column]:
    """Selected span ids: unique, at most three, known, and NONE alone or not at all."""
    ids = F.transform(_texts(candidates), lambda x: F.trim(x))
    real = ids != F.array(F.lit(NONE))
    return {
        "NONE beside span ids": real & F.array_contains(ids, NONE),
        "repeated candidates": _repeats(ids),
        "too many candidates": F.size(ids) > MOST_CANDIDATES,
        "unknown candidates": real & (F.size(F.array_except(F.array_remove(ids, NONE), _texts(known))) > 0),
    }


def candidates(selected: Column) -> Column:
    """The selected span ids, none for the word NONE."""
    ids = F.transform(_texts(selected), lambda x: F.trim(x))
    return F.when(ids == F.array(F.lit(NONE)), F.array().cast("array<string>")).otherwise(ids)


def with_exclusions_settled(rows: DataFrame) -> DataFrame:
    """What a hard exclusion implies, put in place.

    Columns: triggered, exclusion_id, exclusions (the facet's ids), relation, inference_kind, span_ids. A facet without
    exclusions can't trigger one; a triggered one that the facet has makes the result unsupported, of no inference and
    without spans. An id that the facet lacks stays as it is, for ``exclusion_rules`` to find.
    """
    none = F.size(_texts(F.col("exclusions"))) == 0
    hit = F.coalesce(F.col("triggered") & F.array_contains("exclusions", F.col("exclusion_id")), F.lit(False))
    return rows.withColumns({
        "relation": F.when(hit, "unsupported").otherwise(F.col("relation")), "inference_kind": F.when(hit, "none").otherwise(F.col("inference_kind")),
        "span_ids": F.when(hit, F.array().cast("array<string>")).otherwise(F.col("span_ids")),
        "triggered": F.when(none, False).otherwise(F.col("triggered")), "exclusion_id": F.when(none, None).otherwise(F.col("exclusion_id"))})


def exclusion_rules() -> dict[str, Column]:
    triggered = F.coalesce(F.col("triggered"), F.lit(False))
    return {
        "exclusion isn't the facet's": triggered & _no(F.array_contains("exclusions", F.col("exclusion_id"))),
        "exclusion without unsupported": triggered & (F.col("relation") != "unsupported"),
        "exclusion with an inference": triggered & (F.col("inference_kind") != "none"),
        "exclusion named but not triggered": ~triggered & F.col("exclusion_id").isNotNull(),
    }


def inference_rules(kinds: dict[str, list[str]] | None = None, forbidden: tuple[str, ...] = ()) -> dict[str, Column]:
    """``forbidden`` are patterns of speculation that the reason of an entailed result may not have."""
    table = F.create_map(*[x for k, v in (kinds or KINDS_OF).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    guessed = reduce(lambda a, b: a | b, [F.col("reason").rlike("(?i)" + p) for p in forbidden], F.lit(False))
    return {"inference kind doesn't fit the relation": _no(F.array_contains(table[F.col("relation")], F.col("inference_kind"))), "entailed by speculation": (F.col("relation") == "entailed") & guessed}


def completeness_rules() -> dict[str, Column]:
    """Columns relation, all_established, missing_component, definition_excluded."""
    relation, whole, excluded = F.col("relation"), F.col("all_established"), F.col("definition_excluded")
    missing = F.trim(F.coalesce("missing_component", F.lit(""))) != ""
    return {
        "excluded by definition but not unsupported": excluded & (relation != "unsupported"),
        "positive without all components": relation.isin(*_POSITIVE) & ~whole,
        "positive with a missing component": relation.isin(*_POSITIVE) & missing,
        "adjacent with all components": (relation == "adjacent") & whole,
        "adjacent without a missing component": (relation == "adjacent") & ~missing,
        "complete with a missing component": whole & missing,
    }


def ledger_rules() -> dict[str, Column]:
    """Columns checks (``CHECKS``), spec (the facet's component ids in order), allowed (span ids), relation, all_established, missing_component."""
    checks, spec, relation = F.coalesce("checks", F.array().cast(CHECKS)), _texts(F.col("spec")), F.col("relation")
    ids = F.transform(checks, lambda c: F.trim(c["component_id"]))
    cited = lambda c: _texts(c["span_ids"])
    whole = F.forall(checks, lambda c: c["established"])
    missing = F.nullif(F.trim(F.coalesce("missing_component", F.lit(""))), F.lit(""))
    established = F.transform(F.filter(checks, lambda c: c["established"]), lambda c: F.trim(c["component_id"]))
    bound = (F.size(spec) > 0) & missing.isNotNull()
    return {
        "no components": F.size(checks) == 0,
        "a component without id": F.exists(ids, lambda x: F.coalesce(x, F.lit("")) == ""),
        "repeated components": _repeats(ids),
        "other components than the facet's": (F.size(spec) > 0) & (F.size(checks) > 0) & ((F.size(F.array_except(spec, ids)) > 0) | (F.size(F.array_except(ids, spec)) > 0)),
        "components out of order": (F.size(F.array_except(spec, ids)) == 0) & (F.size(F.array_except(ids, spec)) == 0) & (F.size(ids) == F.size(spec)) & (ids != spec),
        "repeated spans": F.exists(checks, lambda c: _repeats(cited(c))),
        "unknown spans": F.exists(checks, lambda c: F.size(F.array_except(cited(c), _texts(F.col("allowed")))) > 0),
        "established without spans": F.exists(checks, lambda c: c["established"] & (F.size(cited(c)) == 0)),
        "missing with spans": F.exists(checks, lambda c: ~c["established"] & (F.size(cited(c)) > 0)),
        "established across a boundary": F.exists(checks, lambda c: c["established"] & c["negative_boundary"]),
        "all_established isn't the ledger's": F.col("all_established") != whole,
        "positive with an incomplete ledger": relation.isin(*_POSITIVE) & ~whole,
        "adjacent with a complete ledger": (relation == "adjacent") & whole,
        "missing component isn't the facet's": bound & ~F.array_contains(spec, missing),
        "missing component is established": bound & F.array_contains(established, missing),
    }


def subject_rules(cited: Column, known: Column) -> dict[str, Column]:
    """Span ids that an analysis of the subject cites."""
    return {"repeated subject spans": _repeats(_texts(cited)), "unknown subject spans": F.size(F.array_except(_texts(cited), _texts(known))) > 0}


def result_faults(rows: DataFrame, keys: list[str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """All faults of verification results: (keys, fault)."""
    return faults(rows, keys, ledger_rules() | completeness_rules() | exclusion_rules() | inference_rules(forbidden=forbidden))


# ---------------------------------------------------------------- text anchors


def _found(text: Column, name: str) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike("(?is)" + PATTERNS[x]) for x in name.split("|")])


def _facet(facet: Column) -> Column:
    return F.lower(F.trim(facet))


def guarded(grounding: Column, facet: Column, component: Column, evidence: Column, rules: tuple = GUARDS) -> Column:
    """The grounding of a component after the rules in order: "missing" takes a positive one away, others fill a missing one."""
    steps = []
    for name, part, found, absent, sets in rules:
        applies = (_facet(facet) == name) & (component == part if part else F.lit(True))
        for x in found:
            applies = applies & _found(evidence, x)
        for x in absent:
            applies = applies & ~_found(evidence, x)
        steps.append(F.when(applies, F.lit(sets)))
    return F.aggregate(F.array_compact(F.array(*steps)), grounding, lambda now, sets: F.when((sets == "missing") | (now == "missing"), sets).otherwise(now))


def _holding(spans: Column, names: tuple[str, ...]) -> Column:
    """The ids of the spans that have all the patterns."""
    own = F.filter(spans, lambda s: reduce(lambda a, b: a & b, [_found(s["text"], x) for x in names]))
    return F.transform(own, lambda s: s["span_id"])


def recovered(facet: Column, component: Column, spans: Column, rules: tuple = RECOVERIES) -> Column:
    """What the spans of a whole text (span_id, text) establish together: a struct (grounding, span_ids), null if nothing."""
    out = F.lit(None).cast("struct<grounding: string, span_ids: array<string>>")
    whole = F.array_join(F.transform(spans, lambda s: s["text"]), " ")
    for name, part, groups, absent, sets in rules:
        hits = [_holding(spans, g) for g in groups]
        applies = (_facet(facet) == name) & (component == part)
        for h in hits:
            applies = applies & (F.size(h) > 0)
        for x in absent:
            applies = applies & ~_found(whole, x)
        ids = F.slice(F.array_distinct(F.concat(*hits)), 1, MOST_COMPOSITE)
        out = F.when(F.coalesce(applies, F.lit(False)), F.struct(F.lit(sets).alias("grounding"), ids.alias("span_ids"))).otherwise(out)
    return out


def role_guarded(relation: Column, examined: Column, facet: Column, evidence: Column) -> Column:
    """The relation to the subject after the rules for roles: class labels alone are no inequality; a facet that a sentence names as a
    theme of the whole work is defining. A struct (relation, examined)."""
    label = (_facet(facet) == "inequality") & relation.isin(*J.PROMOTED) & _found(evidence, "class_background") & ~_found(evidence, "inequality")
    phrase = J.scope_phrase(facet)
    theme = ~(relation.isin(*J.PROMOTED) & examined) & _found(evidence, "whole_work") & (phrase != "") & F.contains(J.scope_phrase(evidence), phrase)
    demoted, promoted = (F.struct(F.lit(x).alias("relation"), F.lit(y).alias("examined")) for x, y in (("other", False), ("defining_content_or_narrative_driver", True)))
    return F.when(F.coalesce(label, F.lit(False)), demoted).when(F.coalesce(theme, F.lit(False)), promoted).otherwise(F.struct(relation.alias("relation"), examined.alias("examined")))


# ---------------------------------------------------------------- the flow of stages


def ask(rows: DataFrame, keep: list[str], answers: str, model: Callable[[list[dict]], list[dict]], batch: int = 16) -> DataFrame:
    """A model's answers (``answers`` is their schema) to rows, beside the columns ``keep``: a list of rows in, a list of answers out."""
    kinds = dict(rows.dtypes)
    names = [x.split()[0] for x in answers.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for i in range(0, len(own), batch):
                part = own.iloc[i : i + batch]
                found = model(part.to_dict("records"))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} answers to {len(part)} rows")
                yield part[keep].reset_index(drop=True).assign(**{n: [a.get(n) for a in found] for n in names})

    return rows.mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], answers]))


def judge_cases(cases: DataFrame, spec: DataFrame, select: Callable, verify: Callable, role: Callable, caps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Facet records and case scores of texts by any models.

    ``cases`` has case_id, query_id and text; ``spec`` query_id, facet_id, facet_pos, facet_text, facet_type, component_id, spec_pos.
    ``select`` gets (facet_text, text, span_ids) and gives span_ids; ``verify`` gets (facet_text, component_id, evidence) and gives
    grounding (explicit, entailed or missing) and negative_boundary, and sees one span at a time; ``role`` gets (facet_text, text,
    evidence) and gives subject_relation and examined.
    Text anchors, assembly, the best candidate, recovery from several spans, prominence, support and scores are rules. Answers
    that break the contract of candidates are an error. Returns facets (one row each) and (case_id, score, ...).
    """
    keys = ["case_id", "facet_id"]
    facets = spec.select("query_id", "facet_id", "facet_pos", "facet_text", "facet_type").distinct()
    asked = cases.withColumn("spans", split_spans(F.col("text"))).withColumn("span_ids", F.transform("spans", lambda s: s["span_id"])).join(facets, "query_id")
    chosen = ask(asked.select(*keys, "facet_text", "text", "span_ids"), keys, "chosen array<string>", lambda rows: [{"chosen": x["span_ids"]} for x in select(rows)])
    known = asked.join(chosen, keys)
    bad = reduce(lambda a, b: a | b, candidate_rules(F.col("chosen"), F.col("span_ids")).values())
    known = known.withColumn("chosen", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("bad candidates for"), F.col("case_id").cast("string"), "facet_id"))).otherwise(candidates(F.col("chosen"))))
    tried = known.select(*keys, "query_id", "facet_text", "spans", F.posexplode("chosen").alias("candidate_rank", "span_id"))
    evidence = F.filter("spans", lambda s: s["span_id"] == F.col("span_id"))[0]["text"]
    parts = tried.withColumn("evidence", evidence).join(spec.select("query_id", "facet_id", "component_id", "spec_pos"), ["query_id", "facet_id"])
    by = [*keys, "candidate_rank", "span_id", "component_id", "spec_pos", "facet_text", "evidence"]
    checked = ask(parts.select(*by), by, "grounding string, negative_boundary boolean", verify)
    checked = checked.withColumn("grounding", guarded(F.col("grounding"), F.col("facet_text"), F.col("component_id"), F.col("evidence")))
    results = checked.select(*by, (F.col("grounding") != "missing").alias("established"), (F.col("grounding") == "explicit").alias("explicit"), F.coalesce("negative_boundary", F.lit(False)).alias("negative_boundary"))
    single = J.best_candidate(J.assemble_facets(results, [*keys, "candidate_rank", "span_id"]), keys)
    # components that single spans leave open may be established by several spans of the text
    every = asked.join(spec.select("query_id", "facet_id", "component_id", "spec_pos"), ["query_id", "facet_id"])
    found = every.select(*keys, "component_id", "spec_pos", recovered(F.col("facet_text"), F.col("component_id"), F.col("spans")).alias("r"))
    own = results.where("established").groupBy(*keys, "component_id").agg(F.array_distinct(F.collect_list("span_id")).alias("_ids"))
    merged = found.join(own, [*keys, "component_id"], "left").select(
        *keys, "component_id", "spec_pos", (F.col("_ids").isNotNull() | F.col("r").isNotNull()).alias("established"), F.lit(False).alias("explicit"), F.lit(False).alias("negative_boundary"),
        F.coalesce("_ids", F.col("r.span_ids"), F.array().cast("array<string>")).alias("span_ids"))
    composite = J.assemble_facets(merged, keys, composite=True)
    cited = merged.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("span_ids")))).alias("composite_ids"))
    base = known.select(*keys, "query_id", "facet_pos", "facet_text", "facet_type", "text", "spans", F.col("chosen").alias("candidate_ids")).join(single, keys, "left")
    base = base.withColumn("relation", F.coalesce("relation", F.lit("unsupported")))
    both = J.merge_composite(base, composite, keys).join(cited, keys, "left")
    both = both.withColumn("evidence_ids", F.when(F.col("from_composite"), F.col("composite_ids")).when(F.col("span_id").isNotNull(), F.array("span_id")).otherwise(F.array().cast("array<string>")))
    shown = both.withColumn("evidence", F.array_join(F.transform(F.filter("spans", lambda s: F.array_contains(F.col("evidence_ids"), s["span_id"])), lambda s: s["text"]), " "))
    needed = (F.col("facet_type") == "core") & F.col("relation").isin(*_POSITIVE)
    roles = ask(shown.where(needed).select(*keys, "facet_text", "text", "evidence"), [*keys, "facet_text", "text", "evidence"], "subject_relation string, examined boolean", role)
    scoped = J.scope_guard(F.col("subject_relation"), F.col("facet_text"), F.col("evidence"), F.col("text"))
    settled = roles.select(*keys, role_guarded(scoped, F.coalesce("examined", F.lit(False)), F.col("facet_text"), F.col("evidence")).alias("_role"))
    prominent = F.when(needed, J.prominence(J.context_role(F.col("_role.relation"), F.col("_role.examined")))).otherwise("not_applicable")
    full = shown.join(settled, keys, "left").withColumn("prominence", prominent)
    full = full.withColumn("support", J.facet_support(F.col("facet_type"), F.col("relation"), F.col("prominence")))
    out = full.select(*keys, "query_id", "facet_pos", "facet_text", "facet_type", "candidate_ids", "relation", "from_composite", "evidence_ids", "evidence", "prominence", "support")
    return out, J.case_scores(out, caps=caps)


# ---------------------------------------------------------------- records


def _in_order(facets: DataFrame, key: str, value: Column, keep: Column) -> Column:
    """The values of a case's facets that count, in the order of the specification; a case has as many as its query has facets."""
    return F.transform(F.sort_array(F.collect_list(F.when(keep & value.isNotNull(), F.struct("facet_pos", value.alias("v"))))), lambda x: x["v"])


def summaries(facets: DataFrame, scores: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case: supported core facets by "; ", the evidence of supported facets by " | " (null at score 0), and both audits as JSON.

    ``facets`` has key, facet_id, facet_pos, facet_text, facet_type, support and evidence. An absent facet's evidence stays in the audit.
    """
    held = F.col("support") != "absent"
    line = F.concat(F.col("facet_id").cast("string"), F.lit(": "), F.nullif(F.col("evidence"), F.lit("")))
    named = F.struct(F.col("facet_id").alias("facet_id"), *[F.col(c).alias(c) for c in facets.columns if c not in (key, "facet_id", "facet_pos")])
    out = facets.groupBy(key).agg(
        _in_order(facets, key, F.col("facet_text"), held & (F.col("facet_type") == "core")).alias("_core"), _in_order(facets, key, line, held).alias("_lines"),
        F.to_json(_in_order(facets, key, named, F.lit(True)), {"ignoreNullFields": "false"}).alias("assessments_json"))
    joined = out.join(scores.select(key, "score"), key, "left")
    text = lambda parts, by: F.when(F.size(parts) > 0, F.array_join(parts, by))
    return joined.select(
        key, "score", text(F.col("_core"), "; ").alias("matched_core"), F.when(F.col("score") > 0, text(F.col("_lines"), " | ")).alias("evidence_text"), "assessments_json")
