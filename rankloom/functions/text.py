"""Text expressions: counting, cutting, normalising, tokens, sentence spans and keys. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no topic, for comparing queries.
STOP_WORDS = (
    "a", "about", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "that", "the", "to", "with",
)
#: Texts that mean a missing author.
MISSING = ("", "nan", "none", "null", "<na>")
#: Typographic signs and their plain forms.
TYPOGRAPHY = ("‘’“”–—", "''\"\"--")


def word_list(text: Column) -> Column:
    """Words between white space; empty for an empty text, null for null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(text))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words by single spaces, with an ellipsis always."""
    return F.concat(F.array_join(F.slice(word_list(text), 1, n), " "), F.lit("..."))


def people_line(names: Column) -> Column:
    """``a``, ``a and b`` or ``a, b and c`` from a list separated by semicolons."""
    parts = F.split(names, ";")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(parts, -1)
    return F.when(n == 1, names).when(n == 2, F.concat(F.element_at(parts, 1), F.lit(" and "), last)).otherwise(F.concat(head, F.lit(" and "), last))


def caption(title: Column, people: Column, text: Column) -> Column:
    return F.format_string("%s by %s: %s", title, people, text)


def leading_id(tagged: Column) -> Column:
    """The integer before the first space of a line that may be in quotes; garbage is an error."""
    return F.element_at(F.split(F.trim(F.regexp_replace(tagged, '^"+|"+$', "")), " "), 1).cast("long")


def sentence_parts(text: Column) -> Column:
    """Parts between full stops, empty ones included."""
    return F.split(text, r"\.", -1)


def spans(text: Column) -> Column:
    """Sentence-like spans ``array<struct<span_id, text>>``: split after ``.!?`` and white space, trimmed, numbered S1..Sn."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("S"), (i + 1).cast("string")).alias("span_id"), x.alias("text")))


def render_spans(spanned: Column) -> Column:
    return F.array_join(F.transform(spanned, lambda s: F.concat(s["span_id"], F.lit(": "), s["text"])), "\n")


def safe_text(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def canonical_id(raw: Column, digits: int | None = None) -> Column:
    """An identifier without quotes, outer space and a trailing ``.0``; empty (or of another length) is an error."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(safe_text(raw), "^['\"]+|['\"]+$", "")), r"^(\d+)\.0$", "$1")
    ok = plain != "" if digits is None else plain.rlike(rf"^\d{{{digits}}}$")
    return F.when(ok, plain).otherwise(F.raise_error(F.concat(F.lit("not an identifier: "), F.coalesce(raw.cast("string"), F.lit("null")))))


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters and digits; a run with an underscore gives none, apostrophes vanish."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’]", "")
    runs = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(runs, lambda t: (F.instr(t, "_") == 0) & (F.length(t) >= 2))


_RUN = re.compile(r"\b[^\W_]{2,}\b")


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_tokens(text: pd.Series) -> pd.Series:
    """As ``tokens``, after NFKC and full case folding, which Spark has no function for."""
    return text.map(lambda x: _RUN.findall(re.sub("['’]", "", unicodedata.normalize("NFKC", x or "").casefold())))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, plain quotes and dashes, single spaces, case folded; for matching texts."""
    table = str.maketrans(*TYPOGRAPHY)
    return text.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x or "").translate(table)).strip().casefold())


def match_text(text: Column) -> Column:
    """As ``folded`` for texts already in NFKC whose lower case is their case folding, within code generation."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), *TYPOGRAPHY)), r"\s+", " "))


def identity_key(*parts: Column) -> Column:
    """Normalised parts joined by a bar, letters and digits only."""
    return F.concat_ws("|", *[F.trim(F.regexp_replace(match_text(p), "[^a-z0-9]+", " ")) for p in parts])


def topic_tokens(text: Column) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets, 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def search_text(title: Column, description: Column) -> Column:
    """What a document is indexed by; an error where both parts are empty."""
    whole = F.concat_ws("\n", F.nullif(safe_text(title), F.lit("")), F.nullif(safe_text(description), F.lit("")))
    return F.when(whole != "", whole).otherwise(F.raise_error(F.lit("a document has neither title nor description")))


def labelled_text(title: Column, description: Column) -> Column:
    t, d = safe_text(title), safe_text(description)
    return F.when(d == "", F.concat(F.lit("Title: "), t)).otherwise(F.concat(F.lit("Title: "), t, F.lit("\nDescription: "), d))


def suffix(name: Column, mark: str = "_") -> Column:
    return F.substring_index(name, mark, -1)


def case_id(prefix: str, query: Column, item: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), query.cast("string"), item.cast("string"))


def padded_id(prefix: str, query: Column, rank: Column, width: int = 2) -> Column:
    return F.concat(F.lit(prefix + "_"), query.cast("string"), F.lit("_VR"), F.lpad(rank.cast("string"), width, "0"))


def payload_hash(*fields: Column) -> Column:
    """SHA-256 of the named fields as compact JSON in the order of their names; the caller aliases them."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def optional_author(raw: Column) -> Column:
    return F.when(F.lower(safe_text(raw)).isin(*MISSING), F.lit("")).otherwise(safe_text(raw))


def order_hash(seed: str, value: Column) -> Column:
    """A hash that puts values into a reproducible random order."""
    return F.sha2(F.concat(F.lit(seed + "|"), value.cast("string")), 256)


def natural_number(name: Column) -> Column:
    """All digits of a name as one number; names without digits come last."""
    return F.coalesce(F.regexp_replace(name, r"[^0-9]", "").try_cast("long"), F.lit(10**9).cast("long"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(100 * x, digits))


def signed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", F.round(x, digits))


def count_format_errors(name: Column, pattern: str) -> Column:
    """How many rows of a group don't match an anchored pattern."""
    return F.count_if(~F.coalesce(name.rlike(pattern), F.lit(False)))
