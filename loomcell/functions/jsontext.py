"""Strict JSON (RFC 8259) for Arrow workers: parse, classify, canonical text.

Numbers become exact decimals, never doubles. Nesting of any depth is read: where
the C parser's recursion ends, an iterative one takes over.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation
from typing import Any


class NotJson(ValueError):
    """The text is not one JSON value."""


def _refuse(name: str) -> None:
    raise NotJson(name)


class Vast(Decimal):
    """A number whose exponent no Decimal holds: it counts as a finite number that is
    no integer, and compares by its own digits and exponent."""

    spelling: str

    def __new__(cls, spelling: str, tiny: bool) -> "Vast":
        sign = "-" if spelling[0] == "-" else ""
        x = super().__new__(cls, f"{sign}0" if tiny else f"{sign}Infinity")  # as near as a double gets
        x.spelling = spelling
        return x


def _number(text: str) -> Decimal:
    try:
        return Decimal(text)
    except InvalidOperation:  # an exponent beyond 10^18
        mantissa, _, exponent = text.lower().partition("e")
        whole_, _, part = mantissa.lstrip("-").partition(".")
        digits = (whole_ + part).lstrip("0")
        if not digits:
            return Decimal(0)
        short = digits.rstrip("0")
        exp = int(exponent) - len(part) + len(digits) - len(short)
        return Vast(f"{'-' if text[0] == '-' else ''}{short}e{exp}", exp < 0)


_DECODER = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_refuse)
_SPACE = " \t\n\r"
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def parse(text: str) -> Any:
    """The value; raises NotJson. Of members of one name the last counts."""
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
        if text[end:].strip(_SPACE):
            raise NotJson("text after the value")
        return value
    except NotJson:
        raise
    except RecursionError:
        return _parse_deep(text)
    except ValueError as e:
        raise NotJson(str(e)) from e


def _parse_deep(text: str) -> Any:
    """The same without recursion: a stack of open containers."""
    root: list = []
    stack: list = [root]
    key: list[str | None] = [None]
    want, at, end = "value", 0, len(text.rstrip(_SPACE))

    def put(v: Any) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][key[-1]] = v
        else:
            stack[-1].append(v)

    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise NotJson(f"at {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        if mark in ("]", "}"):
            fits = want in ("comma", "first") and len(stack) > 1 and isinstance(stack[-1], dict) == (mark == "}")
            if not fits:
                raise NotJson(f"at {at}")
            stack.pop()
            key.pop()
            want = "comma" if len(stack) > 1 else "end"
        elif mark == ",":
            if want != "comma":
                raise NotJson(f"at {at}")
            want = "key" if isinstance(stack[-1], dict) else "value"
        elif mark == ":":
            if want != "colon":
                raise NotJson(f"at {at}")
            want = "value"
        elif want in ("key", "first") and isinstance(stack[-1], dict):
            if string is None:
                raise NotJson(f"at {at}")
            key[-1], want = json.loads(string), "colon"
        elif want in ("value", "first"):
            if mark is not None:
                new: Any = {} if mark == "{" else []
                put(new)
                stack.append(new)
                key.append(None)
                want = "first"
            else:
                put(json.loads(string) if string is not None else _number(number) if number is not None else _WORDS[word])
                want = "comma" if len(stack) > 1 else "end"
        else:
            raise NotJson(f"at {at}")
    if want != "end":
        raise NotJson("the text ends early")
    return root[0]


#: A number's exponent up to which its plain digits are written out.
_PLAIN = 40


def number_text(x: Decimal) -> str:
    """One spelling for each exact value: 1, 1.0 and 10e-1 are all "1"."""
    if isinstance(x, Vast):
        return x.spelling
    sign, digits, exp = x.as_tuple()
    d = "".join(map(str, digits)).lstrip("0")
    if not d:
        return "0"
    short = d.rstrip("0")
    exp += len(d) - len(short)
    minus = "-" if sign else ""
    if 0 <= exp <= _PLAIN:
        return minus + short + "0" * exp
    if exp < 0 and -exp <= _PLAIN:
        if len(short) > -exp:
            return f"{minus}{short[:exp]}.{short[exp:]}"
        return f"{minus}0.{'0' * (-exp - len(short))}{short}"
    return f"{minus}{short}e{exp}"


def canonical(value: Any) -> str:
    """Canonical text: members sorted by code point, no spaces, exact numbers,
    strings with only the escapes that JSON demands. Iterative."""
    out: list[str] = []
    todo: list[Any] = [("v", value)]
    while todo:
        kind, x = todo.pop()
        if kind == "t":
            out.append(x)
        elif isinstance(x, dict):
            todo.append(("t", "}"))
            names = sorted(x)
            for i in range(len(names) - 1, -1, -1):
                todo.append(("v", x[names[i]]))
                todo.append(("t", ("," if i else "") + json.dumps(names[i], ensure_ascii=False) + ":"))
            todo.append(("t", "{"))
        elif isinstance(x, list):
            todo.append(("t", "]"))
            for i in range(len(x) - 1, -1, -1):
                todo.append(("v", x[i]))
                if i:
                    todo.append(("t", ","))
            todo.append(("t", "["))
        elif isinstance(x, Decimal):
            out.append(number_text(x))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def safe(text: str) -> str:
    """Lone surrogates, legal as escapes but not in UTF-8, stay as escapes."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "backslashreplace").decode()


_NUMBER_TEXT = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_LOW, _HIGH = -(2**63), 2**63 - 1


def whole(x: Decimal) -> int | None:
    """x as a signed 64-bit integer, None if it isn't one (3.0 is)."""
    if isinstance(x, Vast):
        return None
    if not x:
        return 0
    if x.adjusted() > 18 or x.adjusted() < 0:
        return None
    n = int(x)
    return n if n == x and _LOW <= n <= _HIGH else None


#: Bits of the value types that a value fits.
TYPE_BITS = {"text": 1, "integer": 2, "number": 4, "boolean": 8, "array": 16, "object": 32, "json": 64}
IS_NULL, IS_JSON = 128, 256


def _number_bits(x: Decimal) -> int:
    return TYPE_BITS["number"] | (TYPE_BITS["integer"] if whole(x) is not None else 0)


def fit_bits(value: Any) -> int:
    """Of a parsed value: the types it fits."""
    bits = IS_JSON | TYPE_BITS["json"]
    if value is None:
        return bits | IS_NULL | 127
    if value is True or value is False:
        return bits | TYPE_BITS["text"] | TYPE_BITS["boolean"]
    if isinstance(value, Decimal):
        return bits | TYPE_BITS["text"] | _number_bits(value)
    if isinstance(value, list):
        return bits | TYPE_BITS["array"]
    if isinstance(value, dict):
        return bits | TYPE_BITS["object"]
    bits |= TYPE_BITS["text"]
    inner = value.strip(" ")
    if inner.lower() in ("true", "false"):
        bits |= TYPE_BITS["boolean"]
    elif _NUMBER_TEXT.fullmatch(inner):
        bits |= _number_bits(_number(inner))
    return bits


def typed(value: Any) -> tuple[str | None, int | None, float | None, bool | None, str]:
    """(text, whole number, number, truth, canonical JSON) of a parsed value."""
    c = safe(canonical(value))
    if value is None:
        return None, None, None, None, c
    if value is True or value is False:
        return c, None, None, value, c
    if isinstance(value, Decimal):
        return c, whole(value), float(value), None, c
    if isinstance(value, (list, dict)):
        return None, None, None, None, c
    inner = value.strip(" ")
    if inner.lower() in ("true", "false"):
        return safe(value), None, None, inner.lower() == "true", c
    if _NUMBER_TEXT.fullmatch(inner):
        d = _number(inner)
        return safe(value), whole(d), float(d), None, c
    return safe(value), None, None, None, c
