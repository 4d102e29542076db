"""Fields: instructions as text, compiled to columns over a table of records.

``Evaluator.field`` turns one instruction into a ``Field``: a status, a text and, where the kind is known, a typed value.
Instructions are read once, when the plan is built; a template's fields are compiled in order, so that SET, ASK and SEQ
change what later fields see. Only the arm of an IF that is taken counts, as both are columns under one condition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import macros
from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.formula import Function, FormulaError, Scope, compile_formula
from fieldloom.functions.pictures import apply_formats, list_number, text_transform
from fieldloom.functions.text import compare, digits_only
from fieldloom.functions.values import Value, as_number, as_text, date, number, of_type, parse_number, text
from fieldloom.lang.instruction import Instruction, comparison, parse, pieces, single_nested

RESOLVED, CACHED, SKIPPED, FAILED = "Resolved", "UsedCache", "Skipped", "Failed"
#: Error texts of fields.
ERRORS = {
    "REF": "Error! Reference source not found.",
    "DOCVARIABLE": "Error! No document variable supplied.",
    "DOCPROPERTY": "Error! Unknown document property name.",
    "=": "Error! Invalid formula.",
}
INVALID = "Error! Invalid field code."
#: Field types that are evaluated, and those that need a layout and keep their cached result.
KNOWN = "IF COMPARE SKIPIF NEXTIF NEXT = DATE TIME CREATEDATE SAVEDATE PRINTDATE SET REF DOCVARIABLE DOCPROPERTY MERGEFIELD MERGEREC MERGESEQ AUTONUM AUTONUMLGL AUTONUMOUT GREETINGLINE ADDRESSBLOCK NUMPAGES NUMWORDS NUMCHARS SEQ ASK FILLIN DATABASE INCLUDETEXT".split()
LAYOUT = "PAGE SECTION SECTIONPAGES PAGEREF".split()
#: Names under which core properties are known.
PROPERTY_NAMES = {
    "creator": ("Author", "Creator"),
    "description": ("Comments", "Description"),
    "lastModifiedBy": ("LastSavedBy", "Last Saved By", "LastModifiedBy"),
    "revision": ("Revision", "Revision Number"),
    "created": ("Created", "CreateDate", "Creation Date", "CreationDate"),
    "modified": ("Modified", "LastSaved", "Last Saved", "Last Save Time", "LastSavedTime"),
    "lastPrinted": ("LastPrinted", "Last Printed"),
}


def error_text(type_: str) -> str:
    return ERRORS.get(type_.upper(), INVALID)


def property_aliases(properties: Mapping[str, Value]) -> dict[str, Value]:
    """Core properties under all names that a DOCPROPERTY field may use."""
    out = dict(properties)
    for name, names in PROPERTY_NAMES.items():
        for k, v in properties.items():
            if k.lower() == name.lower():
                out |= dict.fromkeys(names, v)
    return out


@dataclass
class Reference:
    """What a bookmark stands for beside its text; every part may be missing."""

    text: Column | None = None
    number: Column | None = None  # of the current level
    full_number: Column | None = None
    numeric: Column | None = None
    order: Column | None = None
    footnote: Column | None = None
    endnote: Column | None = None
    target: Column | None = None


@dataclass
class Context:
    """What fields can see. Names are found without regard to case: in the record, then bookmarks, document variables,
    document properties, then by ``resolvers`` in their order."""

    record: Mapping[str, Value] = field(default_factory=dict)
    bookmarks: Mapping[str, Value] = field(default_factory=dict)
    variables: Mapping[str, Value] = field(default_factory=dict)
    properties: Mapping[str, Value] = field(default_factory=dict)
    references: Mapping[str, Reference] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)
    resolvers: tuple[Callable[[str, str], Value | None], ...] = ()
    functions: Mapping[str, Function] = field(default_factory=dict)
    cells: Callable[[str], Column | None] | None = None
    metrics: Mapping[str, Column] = field(default_factory=dict)  # NUMPAGES, NUMWORDS, NUMCHARS
    items: Mapping[str, Column] = field(default_factory=dict)
    now: Column | None = None
    created: Column | None = None
    saved: Column | None = None
    printed: Column | None = None
    record_number: Column | None = None
    sequence_number: Column | None = None
    outline_level: Column | None = None
    document_order: Column | None = None
    culture: Culture = EN
    list_separator: str | None = None
    invariant: bool = False
    #: What a missing document variable shows: its error text, the cached result, or nothing ("error", "cache", "skip").
    missing_variable: str = "error"
    use_cache: bool = False
    error_on_unsupported: bool = False
    #: Answers to prompts by prompt text, answers remembered from before, the last answer of all.
    answers: Mapping[str, Column] = field(default_factory=dict)
    remembered: Mapping[str, Column] = field(default_factory=dict)
    prior: Column | None = None
    #: Runs the query of a DATABASE field; gets its request, returns a value.
    database: Callable[[DatabaseRequest], Value] | None = None
    include: Callable[[str, str | None], Column] | None = None


@dataclass(frozen=True)
class DatabaseRequest:
    query: str
    parameters: Mapping[str, Value]
    source: str | None = None
    connection: str | None = None
    headings: bool = False
    first: int | None = None
    last: int | None = None
    layout: int | None = None
    borders: int | None = None


@dataclass
class Field:
    status: Column
    text: Column
    value: Value | None = None

    def column(self) -> Column:
        return F.struct(self.status.alias("status"), self.text.alias("text"))


def _resolved(shown: Column, value: Value | None = None) -> Field:
    return Field(F.lit(RESOLVED), shown, value)


class Evaluator:
    """Compiles fields one after the other; ``moves`` counts how far NEXT, NEXTIF and SKIPIF have moved the record, and
    ``skipped`` tells whether the output is dropped."""

    DEPTH = 32

    def __init__(self, context: Context, ahead: Callable[[Column | int], Mapping[str, Value]] | None = None):
        self.context = context
        self.bookmarks = {k.upper(): v for k, v in context.bookmarks.items()}
        self.items = {k.lower(): v for k, v in context.items.items()}
        self.sequences: dict[str, Column] = {}
        self.levels: dict[tuple[str, int], Column] = {}
        self.auto: dict[str, Column] = {}
        self.remembered, self.prior = dict(context.remembered), context.prior
        self.guard: Column | None = None  # the condition under which the current field counts
        self.depth = 0
        self.ahead = ahead
        self.moves: Column | int = 0
        self.moved = 0  # moves at most
        self.skipped: Column | None = None
        self.record_now = self._by_name(context.record)

    # ---- names

    @staticmethod
    def _by_name(values: Mapping[str, Value]) -> dict[str, Value]:
        return {k.upper(): v for k, v in values.items()}

    def candidates(self, name: str, hint: str = "any") -> list[Value]:
        out, key, c = [], name.upper(), self.context
        places = (("merge", self.record_now), ("bookmark", self.bookmarks), ("variable", self._by_name(c.variables)), ("property", self._by_name(c.properties)))
        for kind, held in places:
            if hint in ("any", kind) and key in held:
                out.append(held[key])
        for resolver in c.resolvers:
            if (v := resolver(name, hint)) is not None:
                out.append(v)
        return out

    def lookup(self, name: str, hint: str = "any") -> Value | None:
        """The first value that isn't null, of its kind if all have one kind; None if no place has the name."""
        found = self.candidates(name, hint)
        if len({v.kind for v in found}) > 1:
            return text(F.coalesce(*(as_text(v, self.context.culture) for v in found)))
        return Value(found[0].kind, F.coalesce(*(v.column for v in found)) if len(found) > 1 else found[0].column) if found else None

    def names(self) -> list[str]:
        c = self.context
        return sorted({*self.record_now, *self.bookmarks, *(k.upper() for k in c.variables), *(k.upper() for k in c.properties)})

    def shown(self, v: Value) -> Column:
        return F.coalesce(as_text(v, self.context.culture), F.lit(""))

    # ---- arguments

    def expand(self, token: str) -> tuple[str | None, Column]:
        """The token with nested fields replaced by their text; the plain text too if there are none."""
        parts = pieces(token)
        if not any(nested for nested, _ in parts):
            return token, F.lit(token)
        return None, F.concat(*(self.field(p).text if nested else F.lit(p) for nested, p in parts))

    def by_column(self, name: Column, hint: str) -> Column:
        """The text of the name that a column holds, null if it is the name of nothing."""
        out = F.lit(None).cast("string")
        for known in reversed(self.names()):
            if (v := self.lookup(known, hint)) is not None:
                out = F.when(F.upper(name) == known, as_text(v, self.context.culture)).otherwise(out)
        return out

    def argument(self, token: str) -> Value:
        """A nested field's value, what a name stands for, or the token itself."""
        if nested := single_nested(token):
            got = self.field(nested)
            return got.value if got.value is not None and got.value.kind != "text" else text(got.text)
        plain, column = self.expand(token)
        if plain is None:
            return text(F.coalesce(self.by_column(column, "any"), column))
        v = self.lookup(plain)
        if v is None:
            return text(plain)
        return v if v.kind != "text" else text(F.coalesce(v.column, F.lit(plain)))

    def argument_text(self, token: str) -> Column:
        if nested := single_nested(token):
            return F.coalesce(self.field(nested).text, F.lit(""))
        plain, _ = self.expand(token)
        v = self.argument(token)
        return F.coalesce(as_text(v, self.context.culture), F.lit(plain or "")) if v.kind != "text" else v.column

    def named(self, token: str, hint: str) -> tuple[str | None, Value | None]:
        """A name that may hold nested fields, and its value."""
        plain, column = self.expand(token)
        return (plain, self.lookup(plain, hint)) if plain is not None else (None, text(self.by_column(column, hint)))

    def condition(self, i: Instruction, least: int) -> tuple[Column, list[str]] | None:
        tokens = comparison(i.tokens, least)
        if tokens is None:
            return None
        left, op, right = tokens[:3]
        plain, _ = self.expand(right)
        a, b = self.argument(left), self.argument(right)
        if a.kind == b.kind == "number":  # numbers stay numbers, so that the filter can reach the file
            made = {"=": a.column == b.column, "<>": a.column != b.column, "<": a.column < b.column, ">": a.column > b.column, "<=": a.column <= b.column, ">=": a.column >= b.column}
            return F.coalesce(made.get(op, F.lit(False)), F.lit(False)), tokens
        if a.kind == "number" and plain is not None and self.lookup(plain) is None:
            try:
                return F.coalesce(compare(a.column, op, float(plain)), F.lit(False)), tokens
            except ValueError:
                pass
        is_name = plain is not None and self.lookup(plain) is not None
        other = plain if plain is not None and not is_name and not single_nested(right) else self.argument_text(right)
        return F.coalesce(compare(self.argument_text(left), op, other, self.context.culture, self.context.invariant), F.lit(False)), tokens

    def under(self, condition: Column, make: Callable[[], Field]) -> Field:
        """A field that counts only where the condition holds."""
        before, self.guard = self.guard, condition if self.guard is None else self.guard & condition
        try:
            return make()
        finally:
            self.guard = before

    def changed(self, new: Column, old: Column | None) -> Column:
        return new if self.guard is None else F.when(self.guard, new).otherwise(F.lit(None) if old is None else old)

    def format(self, v: Value, i: Instruction) -> Column:
        c = self.context
        return apply_formats(self.shown(v), v, i.formats, c.culture, c.invariant, self.items) if i.formats else self.shown(v)

    # ---- fields

    def field(self, instruction: str, cached: Column | None = None) -> Field:
        if self.depth >= self.DEPTH:
            return self.fallback(cached)
        self.depth += 1
        try:
            i = parse(instruction)
            if i.type and i.arguments is None and i.type not in KNOWN and i.type in self.bookmarks:
                i = replace(i, type="REF", arguments=i.type)
            if i.type in LAYOUT:
                return Field(F.when(F.lit(True) if cached is None else cached.isNull(), SKIPPED).otherwise(CACHED), F.lit(None).cast("string") if cached is None else cached)
            make = _FIELDS.get(i.type)
            made = make(self, i, cached) if make else None
            return made if made is not None else self.fallback(cached, i.type not in KNOWN)
        finally:
            self.depth -= 1

    def fallback(self, cached: Column | None, unknown: bool = True) -> Field:
        """The cached result where it is asked for, else nothing; or a failure for what isn't supported."""
        none = F.lit(None).cast("string")
        if self.context.error_on_unsupported:
            return Field(F.lit(FAILED), none)
        if self.context.use_cache and cached is not None:
            return Field(F.when(cached.isNotNull(), CACHED).otherwise(SKIPPED), cached)
        return Field(F.lit(SKIPPED), none)

    def value(self, v: Value, i: Instruction) -> Field:
        return _resolved(self.format(v, i), v)


def _formula(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    if i.arguments is None:
        return None
    c = e.context
    # A digit list separator of the culture; a comma always separates.
    scope = Scope(e.lookup, c.functions, lambda s: parse_number(e.field(s).text, c.culture, c.invariant), c.cells, (c.list_separator or c.culture.list_separator)[0], c.culture, c.invariant)
    try:
        got = compile_formula(i.arguments, scope)
    except FormulaError as error:
        return e.value(text(str(error)), i)
    shown = e.format(number(got.value), i)
    if got.error is None:
        return _resolved(shown, number(got.value))
    failed = e.format(text(got.error), i)
    return _resolved(F.when(got.error.isNull(), shown).otherwise(failed), number(F.when(got.error.isNull(), got.value)))


def _now(e: Evaluator) -> Column:
    return F.current_timestamp() if e.context.now is None else e.context.now


def _clock(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    return e.value(date(_now(e)), i)


def _dated(which: str):
    def make(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
        held = getattr(e.context, which)
        if held is None and which == "printed":
            held = _now(e)
        return None if held is None else e.value(date(held), i)

    return make


def _set(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    if not i.tokens:
        return None
    name, token = i.tokens[0].upper(), (i.tokens[1:] or [""])[0]
    v, old = e.argument(token), e.bookmarks.get(i.tokens[0].upper())
    shown = e.argument_text(token)
    if e.guard is not None and old is not None and old.kind != v.kind:
        v, old = text(shown), text(e.shown(old))
    e.bookmarks[name] = Value(v.kind, e.changed(v.column, None if old is None else old.column))
    return _resolved(shown, v)


def _reference(e: Evaluator, i: Instruction, r: Reference) -> Column:
    """The text of a reference by its switches; null if the reference has none."""
    wants_number = any(k in i.switches for k in "nrw") and r.number is not None
    if wants_number:
        out = r.full_number if "w" in i.switches and r.full_number is not None else r.number
        if "t" in i.switches and r.numeric is not None:
            out = r.numeric
    else:
        out = r.text if r.text is not None else F.lit(None).cast("string")
    if separator := i.switches.get("d"):
        out = F.replace(out, F.lit("."), F.lit(separator))
    if "p" in i.switches and wants_number and r.order is not None and e.context.document_order is not None:
        label = F.when(e.context.document_order < r.order, "below").when(e.context.document_order > r.order, "above")
        out = F.concat_ws(" ", F.nullif(out, F.lit("")), label)
    if "f" in i.switches and (note := r.footnote if r.footnote is not None else r.endnote) is not None:
        out = F.coalesce(F.nullif(note, F.lit("")), out)
    return digits_only(out) if "t" in i.switches else out


def _ref(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    missing = F.lit(error_text("REF"))
    if not i.tokens:
        return _resolved(missing, text(missing))
    plain, column = e.expand(i.tokens[0])
    known = {k.upper(): r for k, r in e.context.references.items()}
    if plain is None:
        return e.value(text(F.coalesce(e.by_column(column, "bookmark"), missing)), i)
    if plain.upper() in known:
        return e.value(text(F.coalesce(_reference(e, i, known[plain.upper()]), F.lit(""))), i)
    held = e.bookmarks.get(plain.upper())
    if held is None:
        return e.value(text(missing), i)
    if i.formats:
        return e.value(held if held.kind != "text" else text(F.coalesce(held.column, missing)), i)
    shown = F.coalesce(as_text(held, e.context.culture), missing)
    return _resolved(digits_only(shown) if "t" in i.switches else shown, held)


def _variable(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    error = text(error_text("DOCVARIABLE"))
    if not i.tokens:
        return e.value(error, i)
    _, v = e.named(i.tokens[0], "variable")
    how, none = e.context.missing_variable, F.lit(None).cast("string")
    gone = F.lit(True) if v is None else v.column.isNull()
    if how == "error":
        other = (F.lit(RESOLVED), e.format(error, i))
    elif how == "cache" and cached is not None:
        other = (F.when(cached.isNotNull(), CACHED).otherwise(SKIPPED), cached)
    else:
        other = (F.lit(SKIPPED), none)
    if v is None:
        return Field(*other, error if how == "error" else None)
    return Field(F.when(gone, other[0]).otherwise(RESOLVED), F.when(gone, other[1]).otherwise(e.format(v, i)), v)


def _property(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    error = text(error_text("DOCPROPERTY"))
    v = e.named(i.tokens[0], "property")[1] if i.tokens else None
    if v is None:
        return e.value(error, i)
    return _resolved(F.when(v.column.isNull(), e.format(error, i)).otherwise(e.format(v, i)), v)


def _merge_field(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    if not i.tokens:
        return None
    name = i.tokens[0]
    if "m" in i.switches:
        name = {k.upper(): v for k, v in e.context.aliases.items()}.get(name.upper()) or name
    v = e.named(name, "merge")[1] or text("")
    shown = e.format(v, i)
    if "v" in i.switches and i.switches["v"] is None:
        shown = F.array_join(F.split(shown, ""), "\n")
    before, after = i.switches.get("b") or "", i.switches.get("f") or ""
    return _resolved(F.when(F.length(shown) > 0, F.concat(F.lit(before), shown, F.lit(after))).otherwise(""), v)


def _number_of(which: str):
    def make(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
        held = getattr(e.context, which)
        if held is not None and which == "record_number":
            held = held + e.moves
        return e.value(text("") if held is None else number(held), i)

    return make


def _macro(make_line):
    def make(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
        if not e.record_now:
            return _resolved(F.lit(""), text(""))
        return e.value(text(make_line({k: as_text(v, e.context.culture) for k, v in e.record_now.items()}, e.context.culture)), i)

    return make


def _metric(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    """The stored count; empty if it is missing or 0."""
    held = {k.upper(): v for k, v in e.context.metrics.items()}.get(i.type)
    if held is None:
        return e.value(text(""), i)
    n = parse_number(held.cast("string"))
    v = number(F.when(n != 0, n))
    kept = F.trim(held.cast("string"))
    return _resolved(F.when(n.isNull(), F.coalesce(kept, F.lit(""))).when(n == 0, "").otherwise(e.format(v, i)), v)


def _if(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    held = e.condition(i, 4)
    if held is None:
        return None
    met, tokens = held
    arms = [tokens[3], tokens[4] if len(tokens) > 4 else ""]
    guards = (met, ~met)
    values = [e.under(g, lambda a=a: _resolved(F.lit(""), e.argument(a))).value for g, a in zip(guards, arms, strict=True)]
    if i.formats:
        shown = [e.format(v, i) for v in values]
    else:
        shown = [e.shown(v) if v.kind != "text" else F.coalesce(v.column, F.lit("")) for v in values]
    joined = F.when(met, shown[0]).otherwise(shown[1])
    same = values[0].kind == values[1].kind
    return _resolved(joined, Value(values[0].kind, F.when(met, values[0].column).otherwise(values[1].column)) if same else text(joined))


def _compare(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    held = e.condition(i, 3)
    return None if held is None else e.value(number(F.when(held[0], 1.0).otherwise(0.0)), i)


def _move(e: Evaluator, met: Column | None) -> None:
    """One record further, for the fields behind, where the condition holds."""
    step = 1 if met is None and e.guard is None else F.when(met if e.guard is None else e.guard if met is None else met & e.guard, 1).otherwise(0)
    e.moves = e.moves + step if isinstance(e.moves, int) and isinstance(step, int) else (F.lit(e.moves) if isinstance(e.moves, int) else e.moves) + step
    e.moved += 1
    if e.ahead is not None:
        e.record_now = e._by_name(e.ahead(e.moves))


def _next(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    _move(e, None)
    return _resolved(F.lit(""), text(""))


def _conditional_move(skip: bool):
    def make(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
        held = e.condition(i, 3)
        if held is None:
            return None
        met = held[0]
        if skip:
            here = met if e.guard is None else met & e.guard
            e.skipped = here if e.skipped is None else e.skipped | here
        _move(e, met)
        return Field(F.when(met, SKIPPED).otherwise(RESOLVED), F.when(~met, ""), None)

    return make


def _sequence(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    """The counter of this record or document: ``\\c`` repeats, ``\\r`` sets, ``\\s`` resets when the outline level changes,
    a bookmark sets it to its number, ``\\h`` hides."""
    if not i.tokens:
        return None
    name = i.tokens[0].upper()
    old = e.sequences.get(name, F.lit(0))
    now, step = old, 1
    reset = i.switches.get("r")
    if reset is not None and reset.strip().lstrip("+-").isdigit():
        now, step = F.lit(int(reset)), 0
    level = i.switches.get("s")
    if level is not None and level.strip().isdigit() and e.context.outline_level is not None:
        key, current = (name, int(level)), e.context.outline_level
        last = e.levels.get(key, F.lit(None).cast("int"))
        differs = (current > 0) & ~last.eqNullSafe(current)
        now = F.when(differs, 0).otherwise(now)
        e.levels[key] = e.changed(F.when(current > 0, current).otherwise(last), last)
    if "c" in i.switches:
        step = 0
    after = now + step
    if len(i.tokens) > 1 and (v := e.lookup(i.tokens[1], "bookmark")) is not None and (n := as_number(v, e.context.culture, e.context.invariant)) is not None:
        after = F.when(n.isNotNull(), F.floor(n)).otherwise(after)
    e.sequences[name] = e.changed(after, old)
    e.items[i.tokens[0].lower()] = after.cast("int").cast("string")
    hidden = "h" in i.switches and not any(f.kind == "*" for f in i.formats)
    return e.value(text("") if hidden else number(after), i)


def _auto_number(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    """The running number of body fields of one family; counters over a document are in ``operators.counters``."""
    old = e.auto.get(i.type, F.lit(0))
    now = old + 1
    e.auto[i.type] = e.changed(now, old)
    separator = auto_separator(i)
    if i.type == "AUTONUMOUT":
        shown = list_number(now, "upperRoman", e.context.culture)
    else:
        shown = e.format(number(now), i) if i.type == "AUTONUM" else now.cast("string")
    tail = "" if i.type == "AUTONUMLGL" and "e" in i.switches else separator
    return _resolved(F.lit("") if e.guard is not None else F.concat(shown, F.lit(tail)))


def auto_separator(i: Instruction) -> str:
    """One character behind ``\\s``, a full stop without the switch."""
    held = next((v for k, v in i.switches.items() if k.lower() == "s"), ".")
    return (held or "")[:1]


def _prompt(e: Evaluator, i: Instruction, cached: Column | None, at: int) -> tuple[Column | None, bool]:
    """The answer to a prompt: one remembered for ``\\o``, an answer given now, the cached result, the default, the prior
    answer. Also whether it comes from the cache alone."""
    tokens = i.tokens
    prompt = tokens[at] if len(tokens) > at else ""
    key = i.raw.strip()
    options = []
    if "o" in i.switches and key in e.remembered:
        options.append(e.remembered[key])
    answer = {k.upper(): v for k, v in e.context.answers.items()}.get(prompt.upper())
    if answer is not None:
        options.append(answer)
    if at == 0 and e.context.use_cache and cached is not None:
        options.append(F.when(F.trim(cached) != "", cached))
    if "d" in i.switches:
        options.append(e.argument_text(i.switches["d"] or ""))
    if e.prior is not None:
        options.append(e.prior)
    if not options:
        return None, False
    got = F.coalesce(*options) if len(options) > 1 else options[0]
    if answer is not None:
        e.prior = F.coalesce(answer, e.prior) if e.prior is not None else answer
    if "o" in i.switches:
        e.remembered[key] = got
    return got, False


def _fill_in(e: Evaluator, i: Instruction, cached: Column | None) -> Field:
    got, _ = _prompt(e, i, cached, 0)
    if got is None:
        return Field(F.lit(SKIPPED), F.lit(None).cast("string"))
    return Field(F.when(got.isNotNull(), RESOLVED).otherwise(SKIPPED), F.when(got.isNotNull(), e.format(text(got), i)))


def _ask(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    if not i.tokens:
        return None
    got, _ = _prompt(e, i, None, 1)
    answer = F.lit("") if got is None else F.coalesce(got, F.lit(""))
    old = e.bookmarks.get(i.tokens[0].upper())
    e.bookmarks[i.tokens[0].upper()] = text(e.changed(answer, None if old is None else e.shown(old)))
    return _resolved(F.lit(""), text(""))


def database_request(e: Evaluator, i: Instruction) -> DatabaseRequest | None:
    """The query behind ``\\s``, or else the first argument, which asks for headings too; further arguments are names and
    values of parameters."""
    switches = {k.lower(): v for k, v in i.switches.items()}
    tokens, query = i.tokens, (switches.get("s") or "").strip()
    legacy = not query and bool(tokens)
    if legacy:
        query = tokens[0]
    if not query:
        return None
    number_ = lambda k: int(switches[k]) if (switches.get(k) or "").strip().lstrip("-").isdigit() else None
    first, last = number_("f"), number_("t")
    pairs = {}
    for k in range(1, len(tokens), 2) if legacy else range(0, len(tokens), 2):
        pairs[tokens[k]] = text(e.argument_text(tokens[k + 1])) if k + 1 < len(tokens) else text("")
    return DatabaseRequest(query, pairs, switches.get("d"), switches.get("c"), "h" in switches or legacy, first if first and first > 0 else None, last if last and last > 0 else None, number_("l"), number_("b"))


def _database(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    request = database_request(e, i)
    if request is None:
        return None
    if e.context.database is None:  # without a provider the field is resolved and empty
        return _resolved(F.lit(""), text(""))
    return e.value(e.context.database(request), i)


def _include(e: Evaluator, i: Instruction, cached: Column | None) -> Field | None:
    if not i.tokens or e.context.include is None:
        return e.fallback(cached) if cached is None else Field(F.lit(CACHED), cached)
    got = e.context.include(i.tokens[0], i.tokens[1] if len(i.tokens) > 1 else None)
    shown = got if cached is None else F.coalesce(got, cached)
    return Field(F.when(got.isNotNull(), RESOLVED).when(shown.isNotNull(), CACHED).otherwise(SKIPPED), shown)


_FIELDS: dict[str, Callable[[Evaluator, Instruction, Column | None], Field | None]] = {
    "=": _formula, "DATE": _clock, "TIME": _clock, "CREATEDATE": _dated("created"), "SAVEDATE": _dated("saved"), "PRINTDATE": _dated("printed"),
    "SET": _set, "REF": _ref, "DOCVARIABLE": _variable, "DOCPROPERTY": _property, "MERGEFIELD": _merge_field,
    "MERGEREC": _number_of("record_number"), "MERGESEQ": _number_of("sequence_number"), "GREETINGLINE": _macro(macros.greeting_line), "ADDRESSBLOCK": _macro(macros.address_block),
    "NUMPAGES": _metric, "NUMWORDS": _metric, "NUMCHARS": _metric, "IF": _if, "COMPARE": _compare, "NEXT": _next, "NEXTIF": _conditional_move(False), "SKIPIF": _conditional_move(True),
    "SEQ": _sequence, "AUTONUM": _auto_number, "AUTONUMLGL": _auto_number, "AUTONUMOUT": _auto_number, "ASK": _ask, "FILLIN": _fill_in, "DATABASE": _database, "INCLUDETEXT": _include,
}


def record_values(df: DataFrame) -> dict[str, Value]:
    """The columns of a table as fields of a merge record."""
    return {name: of_type(F.col(f"`{name}`"), kind) for name, kind in df.dtypes}


def evaluate(df: DataFrame, fields: Mapping[str, str], context: Context | None = None, cached: Mapping[str, Column] | None = None, accepts: Callable[[str], bool] | None = None) -> DataFrame:
    """The table with one text column for each named instruction, evaluated in order on each row by itself. Instructions that
    ``accepts`` refuses pass through with their cached result. Fields that move the record belong into a merge."""
    e = Evaluator(context or Context(record=record_values(df)))
    out = {}
    for name, instruction in fields.items():
        held = (cached or {}).get(name)
        if accepts is not None and not accepts(instruction):
            out[name] = F.lit(None).cast("string") if held is None else held
        else:
            out[name] = e.field(instruction, held).text
    return df.select("*", *(v.alias(k) for k, v in out.items()))


def field_mode(instruction: str, cached: Column, evaluated: Callable[[], Column], mode: str) -> Column | None:
    """What a document shows for a field: nothing changed ("none"), its cached result ("cache", where SET and NEXT show
    nothing) or the evaluated text ("evaluate", where fields that need a layout keep the cached result)."""
    type_ = parse(instruction).type
    if mode == "evaluate":
        return cached if type_ in LAYOUT else evaluated()
    return F.lit("") if mode == "cache" and type_ in ("SET", "NEXT") else cached


def transformed(shown: Column, argument: str, culture: Culture = EN) -> Column:
    return text_transform(shown, text(shown), argument, culture)
