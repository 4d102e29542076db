"""The formula language, compiled to columns: arithmetic, comparisons, functions, cell ranges, with text errors.

Binding from loose to tight: comparisons, ``+ -``, ``* /``, ``^`` (right), postfix ``%``, signs (so ``-2^2`` is 4). A compiled
formula is a value and an error text; the error is null where there is none, and errors of an IF arm that isn't taken don't
count. Values are doubles; comparisons give 1 and 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from fieldloom.functions.culture import EN, Culture
from fieldloom.functions.values import Value, as_number, number, parse_number
from fieldloom.lang.instruction import nested_end

#: Error texts.
ZERO_DIVIDE, SYNTAX_ERROR = "!Zero Divide", "!Syntax Error"


class FormulaError(ValueError):
    """A formula that can't be read; its text is what the field shows."""


@dataclass(frozen=True)
class Result:
    value: Column
    error: Column | None = None


Function = Callable[[list[Column]], Column]


def _num(x: float) -> Column:
    return F.lit(float(x))


def _flag(x: Column) -> Column:
    return F.when(x, _num(1)).otherwise(_num(0))


def _round(a: list[Column]) -> Column:
    """Half away from zero, scaled in binary. Negative places round to tens and so on."""
    if not a:
        return _num(0)
    scale = F.pow(_num(10), F.floor(a[1])) if len(a) > 1 else _num(1)
    scaled = F.abs(a[0]) * scale
    return F.when(scaled < 9e15, F.signum(a[0]) * F.floor(scaled + 0.5).cast("double") / scale).otherwise(a[0])


def _fold(start: float, op: Callable[[Column, Column], Column]) -> Function:
    return lambda a: reduce(op, a) if a else _num(start)


#: Functions of a list of numbers known when the plan is built.
FUNCTIONS: dict[str, Function] = {
    "ABS": lambda a: F.abs(a[0]) if a else _num(0),
    "SIGN": lambda a: F.signum(a[0]) if a else _num(0),
    "INT": lambda a: F.when(F.abs(a[0]) < 9e15, F.floor(a[0]).cast("double")).otherwise(a[0]) if a else _num(0),
    "MOD": lambda a: F.when(a[1] == 0, _num(0)).otherwise(F.try_mod(a[0], a[1])) if len(a) > 1 else _num(0),
    "NOT": lambda a: _flag(a[0] == 0) if a else _num(1),
    "ROUND": _round,
    "FALSE": lambda a: _num(0),
    "SUM": _fold(0, lambda x, y: x + y),
    "PRODUCT": _fold(1, lambda x, y: x * y),
    "AVERAGE": lambda a: reduce(lambda x, y: x + y, a) / len(a) if a else _num(0),
    "COUNT": lambda a: _num(len(a)),
    "MIN": lambda a: F.least(*a) if len(a) > 1 else (a or [_num(0)])[0],
    "MAX": lambda a: F.greatest(*a) if len(a) > 1 else (a or [_num(0)])[0],
    "AND": lambda a: _flag(reduce(lambda x, y: x & y, [x != 0 for x in a])) if a else _num(1),
    "OR": lambda a: _flag(reduce(lambda x, y: x | y, [x != 0 for x in a])) if a else _num(0),
}


def _sum(a: Column) -> Column:
    return F.aggregate(a, _num(0), lambda x, y: x + y)


#: The same of an array, as ranges of cells are; functions without an entry get its first elements.
ARRAY_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "SUM": _sum,
    "PRODUCT": lambda a: F.aggregate(a, _num(1), lambda x, y: x * y),
    "AVERAGE": lambda a: F.when(F.size(a) > 0, _sum(a) / F.size(a)).otherwise(_num(0)),
    "COUNT": lambda a: F.size(a).cast("double"),
    "MIN": lambda a: F.coalesce(F.array_min(a), _num(0)),
    "MAX": lambda a: F.coalesce(F.array_max(a), _num(0)),
    "AND": lambda a: _flag(F.forall(a, lambda x: x != 0)),
    "OR": lambda a: _flag(F.exists(a, lambda x: x != 0)),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
DIRECTIONS = ("ABOVE", "BELOW", "LEFT", "RIGHT")
CELL = re.compile(r"[^\W\d_]+\d+\Z")


@dataclass
class Scope:
    """What a formula can see: names (case doesn't matter), functions over the built-in ones, nested fields, and cells.

    ``cells`` gets ``A1``, ``A1:C3`` or a direction and returns an array of the numbers there; without it ranges are empty.
    """

    names: Callable[[str], Value | None] = lambda _: None
    functions: Mapping[str, Function] = field(default_factory=dict)
    nested: Callable[[str], Column] | None = None
    cells: Callable[[str], Column | None] | None = None
    separator: str = ","
    culture: Culture = EN
    invariant: bool = False


# A parsed formula is nested tuples: ("number", text), ("name", name), ("field", instruction), ("range", text),
# ("sign", op, x), ("percent", x), ("binary", op, x, y), ("call", name, [x, ...]).


class _Parser:
    def __init__(self, text: str, separator: str):
        self.tokens, self.at = _tokens(text, separator), 0
        self.error: str | None = None

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, kind: str, *texts: str) -> str | None:
        k, t = self.peek()
        if k != kind or (texts and t not in texts):
            return None
        self.at += 1
        return t

    def fail(self) -> None:
        if self.error is None:
            token = self.peek()[1]
            self.error = f"{SYNTAX_ERROR}, {token}" if token.strip() else SYNTAX_ERROR

    def close(self) -> None:
        if self.take("mark", ")") is None:
            self.fail()

    def whole(self) -> tuple:
        tree = self.chain(0)
        if self.peek()[0] != "end":
            self.fail()
        if self.error:
            raise FormulaError(self.error)
        return tree

    _LEVELS = (tuple(_COMPARE), ("+", "-"), ("*", "/"))

    def chain(self, level: int) -> tuple:
        """Operators of one level, from the left."""
        if level == len(self._LEVELS):
            return self.power()
        left = self.chain(level + 1)
        while op := self.take("op", *self._LEVELS[level]):
            left = ("binary", op, left, self.chain(level + 1))
        return left

    def power(self) -> tuple:
        left = self.percent()
        return ("binary", "^", left, self.power()) if self.take("op", "^") else left

    def percent(self) -> tuple:
        value = self.signed()
        while self.take("op", "%"):
            value = ("percent", value)
        return value

    def signed(self) -> tuple:
        op = self.take("op", "+", "-")
        return ("sign", op, self.signed()) if op else self.primary()

    def primary(self) -> tuple:
        for kind in ("number", "field"):
            if (t := self.take(kind)) is not None:
                return (kind, t)
        if self.take("mark", "("):
            value = self.chain(0)
            self.close()
            return value
        name = self.take("name")
        if name is None:
            self.fail()
            return ("number", "0")
        if name.upper() in DIRECTIONS:
            return ("range", name.upper())
        if self.take("mark", "("):
            args = []
            if self.peek() != ("mark", ")"):
                args.append(self.chain(0))
                while self.take("mark", ","):
                    args.append(self.chain(0))
            self.close()
            return ("call", name, args)
        if CELL.match(name):
            if self.peek() == ("op", ":") and self.tokens[self.at + 1][0] == "name" and CELL.match(self.tokens[self.at + 1][1]):
                self.at += 2
                return ("range", f"{name}:{self.tokens[self.at - 1][1]}")
            return ("range", name)
        return ("name", name)


_LEXEMES = re.compile(r"(?P<blank>\s+)|(?P<number>[\d.]+)|(?P<name>[^\W\d][\w.]*)|(?P<op><=|>=|<>)|(?P<mark>[(),])|(?P<other>.)", re.S)


def _tokens(text: str, separator: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        if text[at] == "{":
            end = nested_end(text, at)
            out.append(("field", text[at + 1 : end - 1].strip()))
            at = end
            continue
        m = _LEXEMES.match(text, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "other":
            out.append(("mark", ",") if m[0] == separator else ("op", m[0]))
        elif kind != "blank":
            out.append((kind, m[0]))
    return [*out, ("end", "")]


def _first(*errors: Column | None) -> Column | None:
    held = [e for e in errors if e is not None]
    return F.coalesce(*held) if len(held) > 1 else held[0] if held else None


class _Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope
        self.functions = FUNCTIONS | {k.upper(): v for k, v in scope.functions.items()}
        self.own = {k.upper() for k in scope.functions}

    def __call__(self, node: tuple) -> Result:
        return getattr(self, node[0])(*node[1:])

    def number(self, text: str) -> Result:
        culture = self.scope.culture
        plain = text.replace(culture.decimal, ".") if culture.decimal in text else text
        try:
            return Result(_num(float(plain)))
        except ValueError:
            return Result(F.coalesce(parse_number(F.lit(text), culture, self.scope.invariant), _num(0)))

    def name(self, name: str) -> Result:
        held = self.scope.names(name)
        value = as_number(held, self.scope.culture, self.scope.invariant) if held else None
        return Result(_num(0) if value is None else F.coalesce(value, _num(0)))

    def field(self, instruction: str) -> Result:
        return Result(F.coalesce(self.scope.nested(instruction), _num(0)) if self.scope.nested else _num(0))

    def cells(self, text: str) -> Column | None:
        return self.scope.cells(text) if self.scope.cells else None

    def range(self, text: str) -> Result:
        held = self.cells(text)
        return Result(_num(0) if held is None else F.coalesce(_sum(held), _num(0)))

    def sign(self, op: str, x: tuple) -> Result:
        got = self(x)
        return Result(-got.value if op == "-" else got.value, got.error)

    def percent(self, x: tuple) -> Result:
        got = self(x)
        return Result(got.value / 100.0, got.error)

    def binary(self, op: str, x: tuple, y: tuple) -> Result:
        a, b = self(x), self(y)
        error = _first(a.error, b.error)
        if op in _COMPARE:
            return Result(_flag(_COMPARE[op](a.value, b.value)), error)
        if op == "/":
            return Result(F.coalesce(F.try_divide(a.value, b.value), _num(0)), _first(error, F.when(b.value == 0, ZERO_DIVIDE)))
        if op == "^":
            return Result(F.pow(a.value, b.value), error)
        return Result({"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[op], error)

    def call(self, name: str, args: list[tuple]) -> Result:
        key = name.upper()
        if key == "IF":
            return self.choice(args)
        if key == "TRUE":
            got = self(args[0]) if args else Result(_num(1))
            return Result(_flag(got.value != 0), got.error)
        if key == "DEFINED":
            return self.defined(args)
        if key not in self.functions:
            token = args[0][1] if args and args[0][0] in ("number", "name", "field") else ""
            return Result(_num(0), F.lit(f"{SYNTAX_ERROR}, {token}" if token else SYNTAX_ERROR))
        if not any(a[0] == "range" for a in args):
            got = [self(a) for a in args]
            return Result(self.functions[key]([g.value for g in got]), _first(*(g.error for g in got)))
        parts, error = [], None
        for a in args:
            if a[0] == "range":
                held = self.cells(a[1])
                if held is not None:
                    parts.append(F.coalesce(held, F.array().cast("array<double>")))
            else:
                got = self(a)
                parts.append(F.array(got.value))
                error = _first(error, got.error)
        array = F.concat(*parts) if parts else F.array().cast("array<double>")
        if key in ARRAY_FUNCTIONS and key not in self.own:
            return Result(ARRAY_FUNCTIONS[key](array), error)
        none = self.functions[key]([])
        one = self.functions[key]([F.get(array, 0)])
        two = self.functions[key]([F.get(array, 0), F.get(array, 1)])
        return Result(F.when(F.size(array) == 0, none).when(F.size(array) == 1, one).otherwise(two), error)

    def choice(self, args: list[tuple]) -> Result:
        if not args:
            return Result(_num(0))
        test, *arms = [self(a) for a in args[:3]]
        yes, no = [*arms, Result(_num(0)), Result(_num(0))][:2]
        error = test.error
        if yes.error is not None or no.error is not None:
            none = F.lit(None).cast("string")
            taken = F.when(test.value != 0, none if yes.error is None else yes.error).otherwise(none if no.error is None else no.error)
            error = _first(error, taken)
        return Result(F.when(test.value != 0, yes.value).otherwise(no.value), error)

    def defined(self, args: list[tuple]) -> Result:
        if not args:
            return Result(_num(0))
        if args[0][0] == "name":
            held = self.scope.names(args[0][1])
            return Result(_num(0) if held is None else _flag(held.column.isNotNull()))
        error = self(args[0]).error
        return Result(_num(1) if error is None else _flag(error.isNull()))


def compile_formula(text: str, scope: Scope) -> Result:
    """Raises FormulaError if the text can't be read."""
    return _Compiler(scope)(_Parser(text, scope.separator).whole())


def _scope(names: Mapping[str, Column] | None, functions: Mapping[str, Function] | None) -> Scope:
    held = {k.upper(): v for k, v in (names or {}).items()}
    find = lambda name: number(held[name.upper()].try_cast("double")) if name.upper() in held else None
    return Scope(names=find, functions=functions or {})


def formula(text: str, names: Mapping[str, Column] | None = None, functions: Mapping[str, Function] | None = None) -> Column:
    """A double column, null where the formula has an error. Unknown names and unparsable values count as 0."""
    got = compile_formula(text, _scope(names, functions))
    return got.value if got.error is None else F.when(got.error.isNull(), got.value)


def formula_text(text: str, names: Mapping[str, Column] | None = None, functions: Mapping[str, Function] | None = None) -> Column:
    """The formula's value as text, or the error text that the field shows."""
    from fieldloom.functions.values import number_text

    try:
        got = compile_formula(text, _scope(names, functions))
    except FormulaError as e:
        return F.lit(str(e))
    shown = number_text(got.value)
    return shown if got.error is None else F.coalesce(got.error, shown)
