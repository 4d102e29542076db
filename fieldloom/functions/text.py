"""Predicates of the field language and small text functions."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, functions as F

from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.values import let, parse_number

_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def glob(value: Column, pattern: str) -> Column:
    """``*`` is any text, ``?`` any character; the whole value has to match."""
    body = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern)
    return value.rlike(f"(?s)\\A{body}\\z")


def glob_column(value: Column, pattern: Column) -> Column:
    """The same for a pattern in a column."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.rlike(value, F.concat(F.lit("(?s)\\A"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z")))


def compare(left: Column, op: str, right: Column | str | float, culture: Culture = EN, invariant: bool = False) -> Column:
    """Wildcards on the right of ``=`` and ``<>``; numbers if both sides are; else ordinal strings. Unknown operators are
    false. With a number on the right the left is a numeric column and compared as one."""
    if op not in _OPS:
        return F.lit(False)
    test = _OPS[op]
    if isinstance(right, (int, float)):
        return test(left, float(right))
    if isinstance(right, str):
        if op in ("=", "<>") and re.search(r"[*?]", right):
            hit = glob(left, right)
            return hit if op == "=" else ~hit
        other = F.lit(right)
    else:
        other = right

    def both(x: Column, y: Column) -> Column:
        ends = F.struct(parse_number(x, culture, invariant).alias("a"), parse_number(y, culture, invariant).alias("b"))
        plain = let(ends, lambda e: F.when(e["a"].isNotNull() & e["b"].isNotNull(), test(e["a"], e["b"])).otherwise(test(x, y)))
        if isinstance(right, str) or op not in ("=", "<>"):
            return plain
        hit = glob_column(x, y)
        return F.when(y.rlike(r"[*?]"), hit if op == "=" else ~hit).otherwise(plain)

    return let(left, lambda x: both(x, other) if isinstance(right, str) else let(other, lambda y: both(x, y)))


def merge_field(x: Column, before: str = "", after: str = "", vertical: bool = False) -> Column:
    """Text around a value that isn't empty; ``vertical`` puts each character on a line."""
    shown = F.array_join(F.split(x, ""), "\n") if vertical else x
    return F.when(F.length(x) > 0, F.concat(F.lit(before), shown, F.lit(after))).otherwise("")


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{Nd}.,\-–−]", "")


def html_text(x: Column) -> Column:
    """Text for HTML: the five characters that need it, code points 160 to 255, and those above the basic plane as references."""
    for c, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(c), F.lit(reference))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(160, 255) | (code > 0xFFFF), F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(c)

    return let(x, lambda t: F.when(t.rlike(r"[\x{a0}-\x{ff}\x{10000}-\x{10ffff}]"), F.array_join(F.transform(F.split(t, ""), one), "")).otherwise(t))


def html_attribute(x: Column) -> Column:
    for c, reference in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(c), F.lit(reference))
    return x


def blank_runs(x: Column) -> Column:
    """White space collapsed to single blanks and trimmed, as in alternative texts and table cells."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))
