"""Greeting lines and address blocks by locale, as columns over the fields of a merge record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fieldloom.functions.culture import EN, Culture


@dataclass(frozen=True)
class Locale:
    """``salutation`` before the name (empty for none), the name's ``suffix``, and how the parts of an address are written."""

    salutation: str
    default: str
    with_title: bool = False
    last_name_first: bool = False
    suffix: str = ""
    punctuation: str = ","
    #: Parts of the locality line with what separates each from the part before it.
    locality: tuple[tuple[str, str], ...] = (("PostalCode", ""), ("City", " "))
    upper: tuple[str, ...] = ("City", "Country")
    #: Fields by line; ``locality`` stands for the line above.
    lines: tuple[str, ...] = ("Company", "Address1", "Address2", "locality", "Country")


_STATE_FIRST = (("City", ""), ("State", " "), ("PostalCode", "  "))
_POSTAL_FIRST = (("PostalCode", ""), ("City", " "), ("State", " "))
#: Salutations, defaults and orders by locale.
LOCALES: dict[str, Locale] = {
    "en": Locale("Dear", "Hello,", with_title=True, locality=_STATE_FIRST, upper=("City", "State", "Country")),
    "en-CA": Locale("Dear", "Hello,", with_title=True, locality=_STATE_FIRST, upper=("City", "State", "PostalCode", "Country")),
    "fr": Locale("Cher·e", "Bonjour,", locality=(("PostalCode", ""), ("City", " "), ("Cedex", " CEDEX ")), upper=()),
    "fr-CA": Locale("Cher·e", "Bonjour,", locality=_STATE_FIRST, upper=("City", "State", "PostalCode", "Country")),
    "de": Locale("Sehr geehrte*r", "Guten Tag,"),
    "es": Locale("Estimado/a", "Hola,"),
    "it": Locale("Gentile", "Buongiorno,", with_title=True, locality=(("PostalCode", ""), ("City", " "), ("State", " ()")), upper=()),
    "pt": Locale("Prezado(a)", "Olá,"),
    "da": Locale("Kære", "Hej,", with_title=True),
    "fi": Locale("Hyvä", "Hei,", with_title=True),
    "el": Locale("Αγαπητέ/ή", "Γεια σας,"),
    "ja": Locale("", "ご担当者様", last_name_first=True, suffix="様", punctuation="", locality=(("State", ""), ("City", "")), upper=(), lines=("Company", "〒PostalCode", "locality", "Address1", "Address2", "Country")),
    "zh": Locale("尊敬的", "您好，", with_title=True, last_name_first=True, punctuation="，", locality=_POSTAL_FIRST, upper=()),
    "th": Locale("เรียน", "เรียน ผู้เกี่ยวข้อง,", with_title=True, locality=_POSTAL_FIRST, upper=()),
}


def locale(name: str | Culture | None, extra: dict[str, Locale] | None = None) -> Locale:
    """By exact name, then by language, else Canadian English, the first of all; ``extra`` ones come before."""
    known = LOCALES | (extra or {})
    full = name.name if isinstance(name, Culture) else name or EN.name
    return known.get(full) or known.get(full.split("-")[0].lower()) or known["en-CA"]


def _field(fields: dict[str, Column], name: str) -> Column:
    """The trimmed field, null if it is blank or missing."""
    held = {k.upper(): v for k, v in fields.items()}.get(name.upper())
    return F.lit(None).cast("string") if held is None else F.nullif(F.regexp_replace(held.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def _join(gap: str, *parts: Column) -> Column:
    return F.nullif(F.concat_ws(gap, *parts), F.lit(""))


def greeting_line(fields: dict[str, Column], name: str | Culture | None = None, extra: dict[str, Locale] | None = None) -> Column:
    """Fields Title, FirstName, LastName. The last name, or else the first, or both where the language puts the last first."""
    how = locale(name, extra)
    first, last = _field(fields, "FirstName"), _field(fields, "LastName")
    who = _join(" ", last, first) if how.last_name_first else F.coalesce(last, first)
    titled = _join(" ", _field(fields, "Title"), who) if how.with_title else who
    line = F.concat(F.lit(f"{how.salutation} " if how.salutation else ""), titled, F.lit(how.suffix + how.punctuation))
    return F.when(who.isNotNull(), line).otherwise(how.default)


def address_block(fields: dict[str, Column], name: str | Culture | None = None, extra: dict[str, Locale] | None = None) -> Column:
    """Fields Company, Address1, Address2, City, State, PostalCode, Country, Cedex. Blank parts and lines are left out; empty
    if all are."""
    how = locale(name, extra)
    part = {}
    for k in ("Company", "Address1", "Address2", "City", "State", "PostalCode", "Country", "Cedex"):
        part[k] = F.upper(_field(fields, k)) if k in how.upper else _field(fields, k)
    area: Column = F.lit(None).cast("string")
    for k, gap in how.locality:
        if gap == " ()":  # in parentheses behind others, bare alone
            area = F.coalesce(F.concat(area, F.lit(" ("), part[k], F.lit(")")), area, part[k])
        elif gap.strip():  # with a word of its own, in any place
            area = _join(" ", area, F.concat(F.lit(gap.lstrip()), part[k]))
        else:
            area = _join(gap, area, part[k])
    lines = []
    for k in how.lines:
        mark = "〒" if k.startswith("〒") else ""
        lines.append(area if k == "locality" else F.concat(F.lit(mark), part[k.removeprefix("〒")]))
    return F.concat_ws("\n", *lines)
