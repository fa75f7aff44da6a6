"""Small text columns shared by the rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Byte searches; a word that contains another listed word adds nothing."""
    words = list(dict.fromkeys(words))
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return any_of(text.contains(w) for w in needed)


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return any_of(text.startswith(p) for p in prefixes)


def lower_or_empty(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def first_match(rules: Iterable[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first rule that holds, as one CASE expression."""
    case = F
    for condition, label in rules:
        case = case.when(condition, F.lit(label))
    return case.otherwise(F.lit(default))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def slug(text: Column, default: str, joiner: str = "_", width: int = 96) -> Column:
    """Lower-case words joined by ``joiner``.

    Of a long text only the beginning that holds ``width + 1`` letters and digits is joined; what comes after cannot
    show among the first ``width`` characters. That beginning has any length, as what lies between words is not counted.
    """
    start = F.regexp_extract(text, f"^[^a-zA-Z0-9]*+((?:[a-zA-Z0-9][^a-zA-Z0-9]*+){{0,{width + 1}}})", 1)
    joined = F.regexp_replace(start, "[^a-zA-Z0-9]+", joiner)
    bare = F.lower(F.regexp_replace(joined, f"^{joiner}+|{joiner}+$", ""))
    cut = F.substring(bare, 1, width)
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(default)).otherwise(cut)


def plain_label(text: Column) -> Column:
    """Stream label of a rule name: lower case, blanks to underscores."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("unknown_rule")).otherwise(
        F.lower(F.replace(text, F.lit(" "), F.lit("_"))))


def lookup(fields: Column, *keys: str) -> Column:
    """First usable value among ``keys`` of a text map; blank and <NA> do not count."""
    usable = []
    for key in keys:
        value = F.trim(F.try_element_at(fields, F.lit(key)))
        usable.append(F.when((value != "") & (value != "<NA>"), value))
    return F.coalesce(*usable)


def safe(text: Column, default: str = "unknown") -> Column:
    """Trimmed text; missing becomes the default, empty stays empty."""
    return F.coalesce(F.trim(text), F.lit(default))
