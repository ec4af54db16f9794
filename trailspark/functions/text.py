"""Column helpers: names, regions, freshness and canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions import vocab


def local_name(iri: Column) -> Column:
    """Text after the last '#', then after the last '/'."""
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def slug(text: Column) -> Column:
    """Lower-case words joined by '-'; 'x' when nothing is left."""
    dashed = F.regexp_replace(text, "[^A-Za-z0-9]+", "-")
    trimmed = F.lower(F.btrim(dashed, F.lit("-")))
    return F.when(trimmed == "", "x").otherwise(trimmed)


def family_of(control_id: Column) -> Column:
    """'3.N' prefix of a control id, 'other' when it has none."""
    number = F.regexp_extract(control_id, r"3\.(\d+)", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("3."), number))


def one_line(text: Column) -> Column:
    """Whitespace runs as one space; '-' for missing or empty text."""
    squeezed = F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", "-").otherwise(squeezed)


def is_us_region(region: Column) -> Column:
    """Plan gate: a region that starts with 'us'; no region is not a US region."""
    return F.coalesce(F.lower(region).startswith("us"), F.lit(False))


def is_us_location(signal: Column) -> Column:
    """Residency signal: empty is no signal, 'in:' prefixes and US value groups count as US."""
    value = F.lower(F.trim(signal))
    after_prefix = F.regexp_replace(value, "^[^:]*:", "")
    return (value == "") | value.contains("us-locations") | after_prefix.startswith("us")


def freshness_label(days: Column) -> Column:
    """Plain name of a freshness window."""
    named = vocab.lookup(days.cast("int"), vocab.FRESHNESS_LABEL)
    return F.coalesce(named, F.format_string("every %d days", days.cast("bigint")))


def resolve_policy(name_or_days: Column) -> Column:
    """Days of a policy given by name or by number; null when it is neither or negative."""
    key = F.lower(F.trim(name_or_days))
    days = F.coalesce(vocab.lookup(key, vocab.POLICY_DAYS), key.try_cast("int"))
    return F.when(days >= 0, days)


def status_label(outcome: Column, missing: str) -> Column:
    """Determination an outcome reads as; ``missing`` when there is no known outcome."""
    return F.coalesce(vocab.lookup(outcome, vocab.STATUS_LABEL), F.lit(missing))


def status_or_name(outcome: Column) -> Column:
    """Determination of a known outcome, the outcome itself otherwise, '?' for none."""
    named = vocab.lookup(outcome, vocab.STATUS_LABEL)
    return F.coalesce(named, F.nullif(outcome, F.lit("")), F.lit("?"))


# -- canonical JSON ---------------------------------------------------------------
# Matches text with sorted keys, ", " and ": " separators and ASCII-only escapes.
# Callers write the keys in order; these helpers write the values.

def _escaped(text: Column) -> Column:
    """JSON string of any text, from Spark's own writer with its code points lower-cased."""
    written = F.to_json(
        F.struct(text.alias("v")), {"writeNonAsciiCharacterAsCodePoint": "true"}
    )
    body = F.substring(written, 6, F.length(written) - 6)
    # Escaped backslashes step aside as a control character, which never stands raw in
    # JSON, so that every "\\u" left is a code point.
    aside = F.replace(body, F.lit("\\\\"), F.lit("\x01"))
    points = F.transform(
        F.split(aside, r"\\u", -1),
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.lower(F.substring(piece, 1, 4)), F.substring(piece, 5, F.length(piece)))
        ),
    )
    joined = F.array_join(points, "\\u")
    return F.replace(
        F.replace(joined, F.lit("\x01"), F.lit("\\\\")), F.lit("\x7f"), F.lit("\\u007f")
    )


def json_text(text: Column) -> Column:
    """JSON string (or null) of a text value."""
    value = text.cast("string")
    plain = F.concat(F.lit('"'), F.regexp_replace(value, r'([\\"])', r"\\$1"), F.lit('"'))
    return F.coalesce(
        F.when(value.rlike(r"[^\x20-\x7E]"), _escaped(value)).otherwise(plain), F.lit("null")
    )


def json_bool(flag: Column) -> Column:
    return F.coalesce(flag.cast("string"), F.lit("null"))


def json_list(values: Column, separator: str = ", ") -> Column:
    """JSON array of strings in the given order."""
    items = F.array_join(F.transform(values, json_text), separator)
    return F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]"))


def json_object(*members: tuple[str, Column], separator: str = ", ", colon: str = ": ") -> Column:
    """JSON object from (key, rendered value) pairs given in key order."""
    parts: list[Column] = []
    for i, (key, value) in enumerate(members):
        lead = "{" if i == 0 else separator
        parts += [F.lit(f'{lead}"{key}"{colon}'), value]
    return F.concat(*parts, F.lit("}"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)
