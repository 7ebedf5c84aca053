"""Similarity of tokens and of patterns, and the two ways to merge patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlog.functions.text import WILDCARD, words

# Two tokens of one of these kinds are alike to 0.85.
KINDS = (r"^\d+\.\d+\.\d+\.\d+$", r"^[a-f0-9]{32}$", r"^[a-f0-9]{64}$", r"^\d{4}-\d{2}-\d{2}$")


def token_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if both are numeric but for '.' and '-', 0.85 for one kind, else 1 - distance / longer length."""
    numeric = lambda t: F.regexp_replace(t, "[.-]", "").rlike("^[0-9]+$")
    alike = F.lit(False)
    for kind in KINDS:
        alike |= a.rlike(kind) & b.rlike(kind)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(numeric(a) & numeric(b), 0.9).when(alike, 0.85).when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def pattern_similarity(p: Column, q: Column) -> Column:
    """0.7 of the share of equal places plus 0.3 of the Jaccard similarity of tokens."""
    a, b = words(p), words(q)
    places = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    score = F.lit(0.7) * (places / F.greatest(F.size(a), F.size(b))) + F.lit(0.3) * jaccard(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(p == q, 1.0).otherwise(score)


def should_merge(p: Column, q: Column, threshold: float = 0.9, max_edit: int = 3, enabled: bool = True) -> Column:
    """Similar enough, and few enough edits between the patterns as strings (0: any number)."""
    if not enabled:
        return F.lit(False)
    similar = pattern_similarity(p, q) >= F.lit(threshold)
    return similar & (F.levenshtein(p, q, max_edit) >= 0) if max_edit else similar


def _joined(a: Column, b: Column) -> Column:
    return F.array_join(F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(WILDCARD))), " ")


def merge_pad(p: Column, q: Column) -> Column:
    """Different places as <*>; so are the places that only the longer pattern has."""
    return _joined(words(p), words(q))


def merge_truncate(p: Column, q: Column) -> Column:
    """Different places as <*>; the longer pattern is cut to the shorter."""
    a, b = words(p), words(q)
    n = F.least(F.size(a), F.size(b))
    return _joined(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def static_tokens(p: Column) -> Column:
    return F.array_distinct(F.filter(words(p), lambda t: t != WILDCARD))


def common_tokens(p: Column, q: Column) -> Column:
    return F.array_sort(F.array_intersect(static_tokens(p), static_tokens(q)))


def template_regex(p: Column) -> Column:
    """An anchored regular expression with a group for each <*>."""
    literal = F.regexp_replace(F.replace(p, F.lit(WILDCARD), F.lit("\u0000")), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("\u0000"), F.lit("(.+?)")), F.lit("$"))


def variables(text: Column, p: Column) -> Column:
    """map var_1, var_2, ... of what stands for each <*>; empty if the text does not match or the template has none."""
    n = (F.length(p) - F.length(F.replace(p, F.lit(WILDCARD), F.lit("")))) / len(WILDCARD)
    regex = template_regex(p)
    entry = lambda i: F.struct(F.concat(F.lit("var_"), i.cast("string")), F.call_function("regexp_extract", text, regex, i.cast("int")))
    found = F.map_from_entries(F.transform(F.sequence(F.lit(1), n.cast("int")), entry))
    return F.when((n > 0) & F.rlike(text, regex), found).otherwise(F.create_map().cast("map<string,string>"))
