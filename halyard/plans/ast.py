"""Filter trees and their builder."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: What is wrong with a filter, by code.
CODES = {
    "E001": "syntax error",
    "E002": "unexpected end",
    "E003": "invalid character",
    "E004": "unclosed string",
    "E005": "unclosed parenthesis",
    "E006": "invalid escape",
    "E007": "invalid number",
    "E101": "type mismatch",
    "E105": "unknown field",
    "E204": "not a condition",
    "E301": "nested too deep",
    "E303": "input too long",
    "E401": "invalid strategy",
}
SYNTAX, LIMITS = ("E001", "E002", "E003", "E004", "E005", "E006", "E007"), ("E301", "E303")

COMPARE = ("=", "!=", "<", "<=", ">", ">=")
STRING = ("CONTAINS", "STARTS_WITH", "ENDS_WITH", "LIKE")
SETS = ("IN", "NOT IN")
ARRAYS = ("ANY", "ALL", "NONE")


class FilterError(ValueError):
    """A filter that cannot be read or bound."""

    def __init__(self, code: str, detail: str, position: int | None = None, suggestion: str | None = None) -> None:
        super().__init__(f"{code} {CODES[code]}: {detail}" + (f" at {position}" if position is not None else "") + (f" (did you mean {suggestion}?)" if suggestion else ""))
        self.code, self.detail, self.position, self.suggestion = code, detail, position, suggestion


@dataclass(frozen=True)
class Filter:
    """A node: an operator over arguments.

    Leaves are Filter("field", (name,)) and Filter("literal", (value,)), with
    a str, int, float, bool or a tuple of nodes as the value. Conditions are
    combined with &, | and ~."""

    op: str
    args: tuple

    def __and__(self, other: Filter) -> Filter:
        return Filter("AND", (self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("OR", (self, other))

    def __invert__(self) -> Filter:
        return Filter("NOT", (self,))

    def __str__(self) -> str:
        if self.op == "field":
            return self.args[0]
        if self.op == "literal":
            return literal_text(self.args[0])
        if self.op == "constant":
            return "true" if self.args[0] else "false"
        if self.op in ("AND", "OR"):
            return f"({self.args[0]} {self.op} {self.args[1]})"
        if self.op == "NOT":
            return f"NOT ({self.args[0]})"
        if self.op == "BETWEEN":
            return f"{self.args[0]} BETWEEN {self.args[1]} AND {self.args[2]}"
        if self.op in ("IS NULL", "IS NOT NULL"):
            return f"{self.args[0]} {self.op}"
        return f"{self.args[0]} {self.op} {self.args[1]}"

    # Trees.
    def children(self) -> tuple[Filter, ...]:
        found = []
        for a in self.args:
            if isinstance(a, Filter):
                found.append(a)
            elif isinstance(a, tuple):
                found += [x for x in a if isinstance(x, Filter)]
        return tuple(found)

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children()), default=0)

    def nodes(self) -> int:
        return 1 + sum(c.nodes() for c in self.children())

    def fields(self) -> set[str]:
        own = {self.args[0]} if self.op == "field" else set()
        return own.union(*(c.fields() for c in self.children()))

    def operators(self) -> set[str]:
        own = set() if self.op in ("field", "literal", "constant") else {self.op}
        return own.union(*(c.operators() for c in self.children()))

    # Builder.
    @staticmethod
    def _compare(op: str, name: str, value: Any) -> Filter:
        return Filter(op, (field(name), literal(value)))

    @classmethod
    def eq(cls, name: str, value: Any) -> Filter:
        return cls._compare("=", name, value)

    @classmethod
    def ne(cls, name: str, value: Any) -> Filter:
        return cls._compare("!=", name, value)

    @classmethod
    def lt(cls, name: str, value: Any) -> Filter:
        return cls._compare("<", name, value)

    @classmethod
    def le(cls, name: str, value: Any) -> Filter:
        return cls._compare("<=", name, value)

    @classmethod
    def gt(cls, name: str, value: Any) -> Filter:
        return cls._compare(">", name, value)

    @classmethod
    def ge(cls, name: str, value: Any) -> Filter:
        return cls._compare(">=", name, value)

    @classmethod
    def contains(cls, name: str, part: str) -> Filter:
        return cls._compare("CONTAINS", name, part)

    @classmethod
    def starts_with(cls, name: str, part: str) -> Filter:
        return cls._compare("STARTS_WITH", name, part)

    @classmethod
    def ends_with(cls, name: str, part: str) -> Filter:
        return cls._compare("ENDS_WITH", name, part)

    @classmethod
    def like(cls, name: str, pattern: str) -> Filter:
        return cls._compare("LIKE", name, pattern)

    @classmethod
    def is_in(cls, name: str, values: list) -> Filter:
        return cls._compare("IN", name, values)

    @classmethod
    def not_in(cls, name: str, values: list) -> Filter:
        return cls._compare("NOT IN", name, values)

    @classmethod
    def any_of(cls, name: str, values: list) -> Filter:
        return cls._compare("ANY", name, values)

    @classmethod
    def all_of(cls, name: str, values: list) -> Filter:
        return cls._compare("ALL", name, values)

    @classmethod
    def none_of(cls, name: str, values: list) -> Filter:
        return cls._compare("NONE", name, values)

    @classmethod
    def between(cls, name: str, low: float, high: float) -> Filter:
        return cls("BETWEEN", (field(name), literal(low), literal(high)))

    @classmethod
    def is_null(cls, name: str) -> Filter:
        return cls("IS NULL", (field(name),))

    @classmethod
    def is_not_null(cls, name: str) -> Filter:
        return cls("IS NOT NULL", (field(name),))

    @classmethod
    def match_all(cls) -> Filter:
        return cls("constant", (True,))

    @classmethod
    def match_none(cls) -> Filter:
        return cls("constant", (False,))

    @classmethod
    def every(cls, *conditions: Filter) -> Filter:
        """All conditions; none given matches all."""
        return _fold("AND", conditions, cls.match_all())

    @classmethod
    def some(cls, *conditions: Filter) -> Filter:
        """At least one condition; none given matches nothing."""
        return _fold("OR", conditions, cls.match_none())


def _fold(op: str, conditions: tuple[Filter, ...], empty: Filter) -> Filter:
    if not conditions:
        return empty
    tree = conditions[0]
    for c in conditions[1:]:
        tree = Filter(op, (tree, c))
    return tree


def field(name: str) -> Filter:
    return Filter("field", (name,))


def literal(value: Any) -> Filter:
    if isinstance(value, (list, tuple)):
        return Filter("literal", (tuple(literal(v) for v in value),))
    if isinstance(value, Filter):
        return value
    if not isinstance(value, (str, bool, int, float)):
        raise FilterError("E101", f"{type(value).__name__} is not a filter value")
    return Filter("literal", (value,))


def literal_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, tuple):
        return "[" + ", ".join(map(str, value)) + "]"
    if isinstance(value, str):
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            value = value.replace(plain, escaped)
        return f'"{value}"'
    if isinstance(value, float):
        return f"{value:.17g}" if "e" not in f"{value:.17g}" else f"{value:f}"
    return str(value)
