"""Field values: text, numbers and dates as columns of a kind known when the plan is built, and conversions between them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fieldloom.functions.culture import EN, Culture


@dataclass(frozen=True)
class Value:
    kind: str  # text, number or date
    column: Column


def text(x: Column | str) -> Value:
    return Value("text", F.lit(x) if isinstance(x, str) else x)


def number(x: Column | float) -> Value:
    return Value("number", x.cast("double") if isinstance(x, Column) else F.lit(float(x)))


def date(x: Column) -> Value:
    return Value("date", x.cast("timestamp"))


def of_type(x: Column, type_name: str) -> Value:
    """A column of a table by its Spark type; booleans are 1 and 0, what is no number or date is text."""
    if type_name == "boolean":
        return number(x.cast("int"))
    if type_name in ("tinyint", "smallint", "int", "bigint", "float", "double") or type_name.startswith("decimal"):
        return number(x)
    if type_name in ("date", "timestamp", "timestamp_ntz"):
        return date(x)
    return text(x.cast("string"))


def number_text(x: Column, culture: Culture = EN) -> Column:
    """The shortest text that reads back as the number, without ``.0``; with an exponent from 1E+15 on and below 0.0001."""
    return let(x, lambda n: _number_text(n, culture))


def _number_text(x: Column, culture: Culture) -> Column:
    size = F.abs(x)
    whole = (x == F.floor(x)) & (size < 1e15)
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", "")
    java = F.format_string("%s", size.cast("string"))  # like 1.5E-7, or plain digits below 1E7
    mantissa = F.regexp_replace(F.regexp_extract(java, "^([0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, "E(-?[0-9]+)$", 1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    far = F.concat(F.when(x < 0, "-").otherwise(""), mantissa, F.lit("E"), sign, F.lpad(_size(exponent), F.greatest(F.length(_size(exponent)), F.lit(2)), "0"))
    out = F.when(whole, x.cast("decimal(38,0)").cast("string")).when((size < 1e15) & (size >= 1e-4), plain).when(size < float("inf"), far)
    out = out.when(F.isnan(x), "NaN").when(x > 0, "∞").when(x < 0, "-∞")
    return out if culture.decimal == "." else F.replace(out, F.lit("."), F.lit(culture.decimal))


def _size(exponent: Column) -> Column:
    return F.ltrim(exponent, F.lit("-"))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x computed once, however often it is used. Columns, casts and short arithmetic are used as they are, as
    lambdas aren't compiled to code."""
    shown = str(x)
    if len(shown) <= 90 and not re.search(r"[a-z_]\w*\(|CASE", shown):
        return use(x)
    return F.get(F.transform(F.array(x), use), 0)


def parse_number(x: Column, culture: Culture = EN, invariant: bool = False) -> Column:
    """The number of a text with signs in front or behind, group separators, a currency sign, parentheses or an exponent;
    null if it is none. With ``invariant`` the English conventions are tried as well."""
    return let(x, lambda t: _parse_number(t, culture, invariant))


def _parse_number(x: Column, culture: Culture, invariant: bool) -> Column:
    blank = r"[\s  ]"
    group = blank if culture.group.isspace() else re.escape(culture.group)
    point, money = re.escape(culture.decimal), f"(?:{re.escape(culture.currency)})?"
    body = rf"({group}?\d[\d{group if len(group) == 1 else culture.group.isspace() and chr(92) + 's' + chr(0xA0) + chr(0x202F) or group}]*(?:{point}\d*)?|{point}\d+)((?:[eE][+-]?\d+)?)"
    shape = rf"^{blank}*(\(?){blank}*([+-]?){blank}*{money}{blank}*([+-]?){body}{blank}*{money}{blank}*([+-]?){blank}*(\)?){blank}*$"
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, shape, 4), group, ""), point, ".")
    size = F.concat(digits, F.regexp_extract(x, shape, 5)).try_cast("double")
    signs = F.concat(*(F.regexp_extract(x, shape, i) for i in (1, 2, 3, 6, 7)))  # one sign, or a pair of parentheses
    found = x.rlike(shape) & signs.rlike(r"^([+-]?|\(\))$")
    out = F.when(x.rlike(r"^-?\d{1,15}$"), x.try_cast("double")).when(found, F.when(signs.rlike("[(-]"), -size).otherwise(size))
    return F.coalesce(out, _parse_number(x, EN, False)) if invariant and (culture.decimal, culture.group) != (EN.decimal, EN.group) else out


def parse_date(x: Column) -> Column:
    """ISO texts, English month names, and day or month first where one of the two can't be a month; else null."""
    t = F.trim(x)
    parts = [F.regexp_extract(t, r"^(\d{1,2})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{4})$", i).try_cast("int") for i in (1, 2, 3)]
    a, b, year = parts
    order = F.when((a > 12) & (b <= 12), F.make_date(year, b, F.least(a, F.lit(28)))).when((b > 12) & (a <= 12), F.make_date(year, a, F.lit(1)))
    exact = F.when((a > 12) & (b <= 12), F.format_string("%04d-%02d-%02d", year, b, a)).when((b > 12) & (a <= 12), F.format_string("%04d-%02d-%02d", year, a, b))
    named = F.try_to_timestamp(t, F.lit("MMMM d, yyyy"))
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), t.try_cast("timestamp")), F.when(order.isNotNull(), exact.try_cast("timestamp")), F.when(t.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), named))


def as_number(v: Value, culture: Culture = EN, invariant: bool = False) -> Column | None:
    """A double column, null where the value is no number; None if it never is one."""
    if v.kind == "number":
        return v.column
    return parse_number(v.column, culture, invariant) if v.kind == "text" else None


def as_date(v: Value) -> Column | None:
    if v.kind == "date":
        return v.column
    return parse_date(v.column) if v.kind == "text" else None


def as_text(v: Value, culture: Culture = EN) -> Column:
    """The default text; a null value has none and stays null."""
    if v.kind == "text":
        return v.column
    if v.kind == "number":
        return number_text(v.column, culture)
    from fieldloom.functions.pictures import date_picture

    return F.concat(date_picture(v.column, culture.date_time, culture), F.lit(" "), F.date_format(v.column, "xxx"))


def utc_text(t: Column) -> Column:
    """yyyy-MM-dd HH:mm:ssZ; the session's time zone has to be UTC."""
    return F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))


def points(x: Column, unit: str = "twip") -> Column:
    """Points of a length: a twip is a twentieth, an EMU the 12,700th part, a half-point a half, an eighth an eighth."""
    return x.cast("double") / {"twip": 20.0, "emu": 12_700.0, "half": 2.0, "eighth": 8.0}[unit]
