"""Rendering of query parameters, for stored results and reports."""

from __future__ import annotations

import re
from collections.abc import Iterable, Set
from decimal import Decimal
from functools import singledispatch
from typing import Any

STRING = re.compile(r"('(?:[^']|'')*')")
_NAME = re.compile(r"(?<!:):([A-Za-z_]\w*)")


@singledispatch
def literal(value: Any) -> str:
    """A value as SQL text; what has no rule of its own is quoted as its text (dates and timestamps, too)."""
    return "'{}'".format(str(value).replace("'", "''"))


literal.register(type(None), lambda _: "NULL")
literal.register(bool, lambda v: repr(v).upper())
literal.register(bytes, lambda v: f"X'{v.hex()}'")
for _kind in (int, float, Decimal):
    literal.register(_kind, format)


def render(sql: str | None, params: dict | None) -> str | None:
    """sql with its :names replaced; casts (::type), quoted text and unknown names stay."""
    if not sql or not params:
        return sql

    def value_of(name: re.Match) -> str:
        return literal(params[name[1]]) if name[1] in params else name[0]

    return "".join(part if part.startswith("'") else _NAME.sub(value_of, part) for part in STRING.split(sql))


def listing(values: Iterable | None) -> str:
    """Values on one report line: sets in order of their texts, others in their own order."""
    ordered = sorted(map(str, values)) if isinstance(values, Set) else map(str, values or ())
    return ", ".join(ordered)
