"""Formats of field results: numeric pictures, date pictures and text transforms, compiled to columns.

A picture is cut into tokens when the plan is built, each section into what stands left and right of its decimal point;
digits are then laid out by position.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fieldloom.functions import words
from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.values import Value, as_date, as_number, let, number_text

# ---- numeric pictures


@dataclass(frozen=True)
class Token:
    kind: str  # 0 # x . , + - % for themselves; "text" and "item"
    text: str = ""


def numeric_sections(picture: str) -> list[list[Token]]:
    """Tokens of the sections; quotes of both kinds protect literals, back-quotes name a numbered item."""
    sections: list[list[Token]] = [[]]
    for m in re.finditer(r"'([^']*)'?|\"([^\"]*)\"?|`([^`]*)`?|(.)", picture, re.S):
        if m[3] is not None:
            sections[-1].append(Token("item", m[3]))
        elif m[4] is None:
            sections[-1].append(Token("text", m[1] if m[1] is not None else m[2]))
        elif m[4] == ";":
            sections.append([])
        else:
            c = m[4].lower() if m[4] in "xX" else m[4]
            sections[-1].append(Token(c) if c in "0#x.,+-%" else Token("text", m[4]))
    return sections


def _digits(tokens: list[Token], kinds: str = "0#x") -> int:
    return sum(t.kind in tuple(kinds) for t in tokens)


class _Section:
    def __init__(self, tokens: list[Token], x: Column, culture: Culture, items: Mapping[str, Column]):
        self.tokens, self.x, self.culture = tokens, x, culture
        self.items = {k.lower(): v for k, v in items.items()}

    def item(self, name: str) -> Column:
        held = self.items.get(name.lower())
        return F.lit("") if held is None else F.coalesce(held.cast("string"), F.lit(""))

    def column(self) -> Column:
        if not self.tokens:
            return number_text(self.x, self.culture)
        point = next((i for i, t in enumerate(self.tokens) if t.kind == "."), len(self.tokens))
        left, right = self.tokens[:point], [t for t in self.tokens[point + 1 :] if t.kind != "."]
        places = _digits(right)
        # Half away from zero, scaled in binary; as a decimal where a long can't hold it, so that great numbers keep their digits.
        size = F.abs(self.x) * float(10**places)
        scaled = F.when(size < 9e15, F.floor(size + 0.5).cast("string")).otherwise(size.try_cast("decimal(38,0)").cast("string"))
        scaled = F.lpad(scaled, F.greatest(F.length(scaled), F.lit(places + 1)), "0")
        whole = F.substring(scaled, F.lit(1), F.length(scaled) - places)
        head = self.left(left, whole)
        if point == len(self.tokens) or not right:
            return head
        fraction = F.right(scaled, F.lit(places)) if places else F.lit("")
        if (least := _digits(right, "0x")) < places:
            fraction = F.regexp_replace(fraction, "0{0,%d}$" % (places - least), "")
        tail = F.concat(head, F.lit(self.culture.decimal), self.right(right, fraction))
        if least or any(t.kind in ("text", "item", "%", "-", "+") for t in right):
            return tail
        return F.when(F.length(fraction) > 0, tail).otherwise(head)

    def left(self, tokens: list[Token], whole: Column) -> Column:
        total = _digits(tokens)
        extra: Column | None = None
        if total:
            drop = next((i for i, t in enumerate(t for t in tokens if t.kind in ("0", "#", "x")) if t.kind == "x"), None)
            digits = F.right(whole, F.lit(total))
            if least := _digits(tokens, "0x"):
                digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(least)), "0")
            if drop is None:  # more digits than places are kept in front
                extra = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - total, F.lit(0)))
            elif drop:
                digits = F.substring(digits, F.lit(drop + 1), F.length(digits))
            digits = F.lpad(digits, total, " ")
        out, at, i = [], 0, 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind in ("0", "#", "x"):
                run = 1
                while i + run < len(tokens) and (tokens[i + run].kind == "#") == (t.kind == "#") and tokens[i + run].kind in ("0", "#", "x"):
                    run += 1
                if not at and extra is not None:
                    out.append(extra)
                part = F.substring(digits, at + 1, run)
                out.append(part if t.kind == "#" else F.translate(part, " ", "0"))
                at += run
                i += run
                continue
            if t.kind == "-":
                out.append(F.when(self.x < 0, "-").otherwise(" "))
            elif t.kind == "+":
                out.append(F.when(self.x > 0, "+").when(self.x < 0, "-").otherwise(" "))
            elif t.kind in ("%", "text"):
                out.append(F.lit(t.text or "%" if t.kind == "%" else t.text))
            elif t.kind == "item":
                out.append(self.item(t.text))
            i += 1
        joined = F.concat(*out) if out else F.lit("")
        size = self.group_size(tokens)
        if not size:
            return joined
        return F.regexp_replace(joined, r"(?<=\d\D{0,64})(?=(?:(?:\d\D*){%d})+$)" % size, re.sub(r"([\\$])", r"\\\1", self.culture.group))

    @staticmethod
    def group_size(tokens: list[Token]) -> int:
        """The digits behind the last comma; 0 without a comma."""
        last = max((i for i, t in enumerate(tokens) if t.kind == ","), default=None)
        return 0 if last is None else _digits(tokens[last:])

    def right(self, tokens: list[Token], fraction: Column) -> Column:
        out, at = [], 1
        for t in tokens:
            if t.kind in ("0", "#", "x"):
                digit = F.substring(fraction, at, 1)
                out.append(digit if t.kind == "#" else F.when(F.length(digit) == 0, "0").otherwise(digit))
                at += 1
            elif t.kind == "item":
                out.append(self.item(t.text))
            else:
                out.append(F.lit({",": self.culture.group, "text": t.text}.get(t.kind, t.kind)))
        return F.concat(*out)


def numeric_picture(x: Column, picture: str, culture: Culture = EN, items: Mapping[str, Column] | None = None) -> Column:
    """Sections for positive, negative and zero numbers; the first serves where one is missing. A sign is shown by ``-`` and
    ``+`` only, so a picture without either loses it. Null gives null."""
    return let(x.cast("double"), lambda n: _numeric_picture(n, picture, culture, items or {}))


def _numeric_picture(x: Column, picture: str, culture: Culture, items: Mapping[str, Column]) -> Column:
    made = [_Section(tokens, x, culture, items).column() for tokens in numeric_sections(picture)]
    out = made[0]
    if len(made) > 2:
        out = F.when(x == 0, made[2]).otherwise(out)
    if len(made) > 1:
        out = F.when(x < 0, made[1]).otherwise(out)
    return F.when(x.isNotNull(), out)


def as_printed(x: Column, places: int, picture: Column) -> Column:
    """``picture`` (grouped, ``places`` digits behind the point), but as SQL's ``format`` and C's printf show it where they
    differ: halves, the sign of a zero, great numbers, NaN and infinity. From 2^63 on digits behind the 17th are zeros."""
    size = F.abs(x) * float(10**places)
    clear = (F.abs(size - F.floor(size) - 0.5) > 1e-6 * (1 + size / 1e6)) & (size < 9e9) & (size >= 0.5)
    whole = F.when((F.abs(x) >= 2.0**53) & (F.abs(x) < 2.0**63), F.format_number(x.cast("long"), places)).otherwise(F.format_number(x, places))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(whole)
    return F.when(clear & (x > 0), picture).otherwise(odd)


# ---- date pictures

#: Runs of a letter that are fields of a date; other runs are literal.
_DATE_FIELDS = "M MM MMM MMMM d dd ddd dddd yy yyyy h hh H HH m mm s ss".split()


def date_picture(t: Column, picture: str, culture: Culture = EN, items: Mapping[str, Column] | None = None) -> Column:
    """Null gives null."""
    held = {k.lower(): v for k, v in (items or {}).items()}

    def name(table: str, i: Column) -> Column:
        return F.get(F.array(*map(F.lit, table.split(" "))), i - 1)

    def one(run: str) -> Column:
        if run in ("MMM", "MMMM"):
            return name(culture.months_short if run == "MMM" else culture.months, F.month(t))
        if run in ("ddd", "dddd"):
            return name(culture.days_short if run == "ddd" else culture.days, F.dayofweek(t))
        if run in _DATE_FIELDS:
            return F.date_format(t, run)
        return F.lit(run)

    out = []
    for m in re.finditer(r"`([^`]*)`?|'([^']*)'?|(AM/PM|am/pm)|(.)\4*", picture, re.S):
        if m[1] is not None:
            out.append(F.coalesce(held[m[1].lower()].cast("string"), F.lit("")) if m[1].lower() in held else F.lit(""))
        elif m[2] is not None:
            out.append(F.lit(m[2]))
        elif m[3]:
            am, _, pm = culture.am_pm.partition(" ") if len(culture.am_pm.split(" ")) == 2 else ("AM", " ", "PM")
            half = F.when(F.hour(t) < 12, am).otherwise(pm)
            out.append(F.lower(half) if m[3].islower() else half)
        else:
            out.append(one(m[0]))
    return F.when(t.isNotNull(), F.concat(*out) if out else F.lit(""))


# ---- text transforms


def first_cap(x: Column, culture: Culture = EN) -> Column:
    """Upper case for the first character that isn't blank."""
    return F.concat(F.regexp_extract(x, r"(?s)^(\s*)", 1), culture.upper(F.regexp_extract(x, r"(?s)^\s*(.?)", 1)), F.regexp_extract(x, r"(?s)^\s*.?(.*)$", 1))


def caps(x: Column, culture: Culture = EN) -> Column:
    """Upper case for the first letter behind white space or the start; the rest stays."""
    parts = F.split(x, r"(?<=\s)(?=\S)")
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike(r"^\p{L}"), F.concat(culture.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)), "")


def alphabetic(n: Column) -> Column:
    """A to Z, AA and so on for 1 and above."""

    def digit(k: Column, i: int) -> Column:
        """The digit of 26^i: what is left after i steps of (n - 1) / 26, floored, is (n - (26^i - 1) / 25) / 26^i."""
        left = F.floor((k - (26**i - 1) // 25) / 26**i)
        return F.when(k >= (26 ** (i + 1) - 1) // 25, F.char(F.lit(65) + (left - 1) % 26)).otherwise("")

    return let(n.cast("long"), lambda k: F.concat(*(digit(k, i) for i in range(6, -1, -1))))  # 26^7 is above an int


#: Roman digits by decimal place.
ROMAN = (" I II III IV V VI VII VIII IX", " X XX XXX XL L LX LXX LXXX XC", " C CC CCC CD D DC DCC DCCC CM", " M MM MMM")


def roman(n: Column) -> Column:
    """1 to 3999."""
    return let(n, _roman)


def _roman(n: Column) -> Column:
    k = F.greatest(F.lit(0), F.least(n.cast("long"), F.lit(3999)))
    return F.concat(*(F.get(F.array(*map(F.lit, ROMAN[i].split(" "))), (F.floor(k / 10**i) % 10).cast("int")) for i in (3, 2, 1, 0)))


def ordinal(n: Column) -> Column:
    return let(n.cast("long"), _ordinal)


def _ordinal(k: Column) -> Column:
    last, two = F.abs(k) % 10, F.abs(k) % 100
    return F.concat(k.cast("string"), F.when(two.between(11, 13), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def _cased(x: Column, argument: str) -> Column:
    """A switch typed all in upper or lower case re-cases the result."""
    letters = [c for c in argument if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return F.upper(x)
    return F.lower(x) if letters and all(c.islower() for c in letters) else x


def text_transform(shown: Column, value: Value, argument: str, culture: Culture = EN, invariant: bool = False) -> Column:
    """One ``\\*`` switch on the text shown so far. Numbers come from the value, or else from the text; where there is
    none the text stays. Unknown switches mean Caps."""
    kind = argument.strip().lower()
    if kind in ("charformat", "mergeformat"):
        return shown
    if kind in ("upper", "lower"):
        return culture.upper(shown) if kind == "upper" else culture.lower(shown)
    if kind == "firstcap":
        return first_cap(shown, culture)
    number = value.column if value.kind == "number" else as_number(Value("text", shown), culture, invariant)
    whole = F.bround(number).cast("long") if kind in ("alphabetic", "roman", "hex", "ordinal", "cardtext", "ordtext") else number
    made = {
        "alphabetic": lambda: F.when(whole > 0, alphabetic(whole)),
        "roman": lambda: F.when(whole.between(1, 3999), roman(whole)),
        "hex": lambda: F.hex(whole),
        "ordinal": lambda: ordinal(whole),
        "cardtext": lambda: words.cardinal(number, culture),
        "ordtext": lambda: words.ordinal(number, culture),
        "dollartext": lambda: words.dollars(number, culture),
    }.get(kind)
    if made:
        return _cased(F.coalesce(F.when(number.isNotNull(), made()), shown), argument.strip())
    if kind in ("arabic", "arabicdash"):
        plain = F.coalesce(number_text(number, culture), shown)
        return plain if kind == "arabic" else F.concat(F.lit("-"), plain, F.lit("-"))
    return caps(shown, culture)


def apply_formats(shown: Column, value: Value, formats: list, culture: Culture = EN, invariant: bool = False, items: Mapping[str, Column] | None = None) -> Column:
    """Format switches from left to right: pictures show the value, transforms change the text shown so far. A value that is
    no number or no date leaves the text as it is."""
    for f in formats:
        if f.kind == "*":
            shown = text_transform(shown, value, f.argument, culture, invariant)
        elif f.kind == "#" and (n := as_number(value, culture, invariant)) is not None:
            shown = F.coalesce(numeric_picture(n, f.argument, culture, items), shown)
        elif f.kind == "@" and (t := as_date(value)) is not None:
            shown = F.coalesce(date_picture(t, f.argument, culture, items), shown)
    return shown


#: List number formats and what they show of a number n; ``decimalZero`` and runs of zeros pad.
def list_number(n: Column, style: str, culture: Culture = EN) -> Column:
    return F.lit("") if style in ("none", "bullet") else let(n.cast("long"), lambda k: _list_number(k, style, culture))


def _list_number(k: Column, style: str, culture: Culture) -> Column:
    plain = k.cast("string")
    if style in ("upperRoman", "lowerRoman"):
        shown = F.when(k.between(1, 3999), roman(k)).otherwise(plain)
        return F.lower(shown) if style == "lowerRoman" else shown
    if style in ("upperLetter", "lowerLetter"):
        shown = F.when(k > 0, alphabetic(k)).otherwise(plain)
        return F.lower(shown) if style == "lowerLetter" else shown
    if style == "decimalZero" or re.fullmatch("0+", style):
        width = max(2, len(style)) if style[0] == "0" else 2
        return F.lpad(plain, F.greatest(F.length(plain), F.lit(width)), "0")
    made = {"hex": lambda: F.hex(k), "cardinalText": lambda: words.cardinal(k, culture), "ordinalText": lambda: words.ordinal(k, culture), "ordinal": lambda: ordinal(k)}
    return made.get(style, lambda: plain)()


#: Symbol fonts put glyphs on the low byte of a code point; tables of them are a parameter, as dict of byte to text.
def symbol_text(x: Column, table: Mapping[int, str], replacement: str | None = None) -> Column:
    """Characters by the low byte of their code point, those the table lacks as they are. With ``replacement`` what can't be
    printed is replaced."""
    letters = F.split(x, "")
    held = F.create_map(*(v for k, t in sorted(table.items()) for v in (F.lit(k), F.lit(t)))) if table else None

    def one(c: Column) -> Column:
        code = F.ascii(c)
        shown = c if held is None else F.coalesce(F.try_element_at(held, F.when((code >= 0xF000) & (code <= 0xF0FF), code - 0xF000).when(code < 256, code)), c)
        return shown if replacement is None else F.when(shown.rlike(r"^[\p{Cc}\p{Co}\p{Cn}]$"), replacement).otherwise(shown)

    return F.when(F.length(x) > 0, F.array_join(F.transform(letters, one), "")).otherwise(x)
