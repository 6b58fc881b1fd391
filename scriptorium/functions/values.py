"""Scalar functions on texts, JSON, maps and settings. Column expressions; the driver's twins of some stand beside them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules for settings.
SECRET_ENDINGS = ("_API_KEY", "_TOKEN", "_SECRET_KEY")
PLACEHOLDER = "(?i)^(|your[_-].*|xxx+|changeme|<.*>|\\*+)$"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "on"), ("false", "no", "off")


def newlines(text: Column, mode: str = "lf") -> Column:
    """Line ends as ``lf`` or ``crlf``; ``auto`` leaves them."""
    if mode == "auto":
        return text
    plain = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.replace(plain, F.lit("\n"), F.lit("\r\n")) if mode == "crlf" else plain


def byte_width(text: Column) -> Column:
    """Columns that a text takes on a screen: CJK and full-width characters, and those of four bytes in UTF-8, twice."""
    return 2 * F.length(text) - F.length(F.regexp_replace(text, r"[\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}\x{10000}-\x{10ffff}]", ""))


def listed(kinds: Column) -> Column:
    """Section types as one comma-separated text."""
    return F.array_join(kinds, ",")


def unlisted(text: Column) -> Column:
    """The types of such a text, none of an empty one."""
    return F.filter(F.split(text, ",", -1), lambda x: x != "")


def rescued_json(text: Column) -> Column:
    """The JSON object from the first brace to the last of a model's answer; null if that isn't JSON."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.when(F.get_json_object(found, "$").isNotNull(), found))


def sorted_json(pairs: Column) -> Column:
    """A map<string,string> as JSON with its keys in order."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.to_json(F.map_from_entries(entries))


def config_digest(pairs: Column, chars: int = 12) -> Column:
    return F.left(F.sha2(sorted_json(pairs), 256), F.lit(chars))


def overlaid(base: Column, over: Column) -> Column:
    """The map ``base`` with the entries of ``over`` in place of its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def weighted_mean(scores: Column, weights: Column) -> Column:
    """Mean of a map of scores by a map of weights, to one place: a missing score is 0; without weights, or with none above 0, the plain mean."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    got = F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(scores, e["key"]), F.lit(0.0)))
    plain = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))
    return F.round(F.when(total > 0, got / total).otherwise(plain), 1)


def coerced(text: Column) -> Column:
    """(kind, value) of a setting's text: ``bool``, ``int``, ``float`` or ``str``, and the value written in one form."""
    low = F.lower(F.trim(text))
    kind = F.when(low.isin(*TRUE_WORDS, *FALSE_WORDS), "bool").when(low.rlike(r"^[+-]?\d{1,18}$"), "int").when(low.rlike(r"^[+-]?\d+\.\d+$"), "float").otherwise("str")
    value = F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false").when(kind == "int", low.try_cast("long").cast("string")).otherwise(text)
    return F.struct(kind.alias("kind"), value.alias("value"))


def unset_secrets(settings: Column) -> Column:
    """Names of secrets in a settings text (``NAME=value`` lines) whose values are missing or placeholders."""
    lines = F.filter(F.transform(F.split(settings, "\n", -1), F.trim), lambda x: x.contains("=") & ~x.startswith("#"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("name"), F.trim(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))
    secret = lambda p: F.greatest(*(p["name"].endswith(e) for e in SECRET_ENDINGS)) & p["value"].rlike(PLACEHOLDER)
    return F.transform(F.filter(pairs, secret), lambda p: p["name"])


# -- the driver's twins ------------------------------------------------------------------------


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``over`` laid on top, mapping by mapping."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def literal(text: str) -> bool | int | float | str:
    low = text.strip().lower()
    if low in TRUE_WORDS or low in FALSE_WORDS:
        return low in TRUE_WORDS
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            pass
    return text
