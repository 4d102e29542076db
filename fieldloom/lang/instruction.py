"""The instruction of a field as data: its type, arguments, switches and format switches. No Spark here.

Quotes protect everything, braces protect nested fields; a backslash outside of both starts a switch. A format switch
(``\\*``, ``\\#``, ``\\@``) takes one quoted argument and ignores what follows it; of other switches the last of a letter wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Format:
    kind: str  # one of * # @
    argument: str


@dataclass
class Instruction:
    raw: str
    type: str  # upper case; empty if there is none
    arguments: str | None
    switches: dict[str, str | None] = field(default_factory=dict)
    formats: list[Format] = field(default_factory=list)

    @property
    def tokens(self) -> list[str]:
        return tokenize(self.arguments or "")


def _outside(text: str):
    """(position, character, nesting of braces) of every character outside of quotes; an escaped quote is inside."""
    quoted, depth, skip = False, 0, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted and c == "\\" and text[i + 1 : i + 2] == '"':
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            if c == "}" and depth:
                depth -= 1
            yield i, c, depth
            if c == "{":
                depth += 1


def _argument(text: str) -> str | None:
    """The first quoted argument without its quotes, else the trimmed text; None if there is nothing."""
    text = text.strip()
    if text.startswith('"'):
        end = 1
        while (end := text.find('"', end)) > 0 and text[end - 1] == "\\":
            end += 1
        if end > 0:
            return text[1:end].replace('\\"', '"')
    return text or None


def parse(text: str) -> Instruction:
    marks = [i for i, c, depth in _outside(text) if c == "\\" and not depth]
    main = text[: marks[0]] if marks else text
    first, _, rest = main.strip().partition(" ") if " " in main.strip() else (main.strip(), "", "")
    for i, c in enumerate(main.strip()):
        if c.isspace():
            first, rest = main.strip()[:i], main.strip()[i:]
            break
    out = Instruction(text, first.upper(), rest.strip() or None)
    if first.startswith("=") and len(first) > 1:  # no blank after the sign of a formula
        out.type, out.arguments = "=", main.strip()[1:].strip()
    for start, end in zip(marks, [*marks[1:], len(text)], strict=False):
        body = text[start:end].strip().lstrip("\\").lstrip()
        if not body:
            continue
        letter, value = body[0], body[1:]
        if letter in "*#@":
            if (argument := _argument(value)) and argument.strip():
                out.formats.append(Format(letter, argument))
        else:
            value = value.strip()
            quoted = len(value) >= 2 and value[0] == value[-1] == '"'
            out.switches[letter] = value[1:-1] if quoted else value or None
    return out


def tokenize(text: str) -> list[str]:
    """Arguments: blanks separate, quotes group (and may be empty), a nested field in braces is a token by itself."""
    tokens: list[str] = []
    word, open_word, i = "", False, 0
    quoted = False

    def flush() -> None:
        nonlocal word, open_word
        if word or open_word:
            tokens.append(word)
        word, open_word = "", False

    while i < len(text):
        c = text[i]
        if quoted and c == "\\" and text[i + 1 : i + 2] == '"':
            word += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
            open_word = not quoted and not word  # an empty pair of quotes is a token as well
        elif not quoted and c == "{":
            if word:
                flush()
            open_word = False
            end = nested_end(text, i)
            if token := text[i:end].strip():
                tokens.append(token)
            i = end - 1
        elif not quoted and c.isspace():
            flush()
        else:
            word += c
            open_word = False
        i += 1
    flush()
    return tokens


def nested_end(text: str, start: int) -> int:
    """Behind the brace that closes the one at ``start``; the end of the text if none does."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i + 1
    return len(text)


def single_nested(token: str) -> str | None:
    """The instruction of a token that is one nested field and nothing else."""
    token = token.strip()
    if token.startswith("{") and token.endswith("}") and nested_end(token, 0) == len(token):
        return token[1:-1].strip() or None
    return None


def pieces(text: str) -> list[tuple[bool, str]]:
    """(is a nested field, its instruction or the plain text) in order. An open brace that nothing closes is plain text."""
    out: list[tuple[bool, str]] = []
    i = 0
    while i < len(text):
        start = text.find("{", i)
        end = nested_end(text, start) if start >= 0 else -1
        if start < 0 or text[end - 1] != "}" or text[start:end].count("{") != text[start:end].count("}"):
            out.append((False, text[i:]))
            break
        if start > i:
            out.append((False, text[i:start]))
        out.append((True, text[start + 1 : end - 1].strip()))
        i = end
    return out


#: Comparison operators, longer ones first.
OPERATORS = ("<>", ">=", "<=", "=", ">", "<")


def comparison(tokens: list[str], least: int) -> list[str] | None:
    """left, operator, right and what follows; the operator may be written together with the right side."""
    if len(tokens) > 1:
        op = next((o for o in OPERATORS if tokens[1].startswith(o)), None)
        if op and tokens[1] != op:
            tokens = [tokens[0], op, tokens[1][len(op) :], *tokens[2:]]
    return tokens if len(tokens) >= least else None
