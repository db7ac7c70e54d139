"""Syntax trees. Expressions and statements are small immutable records."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Expr:
    #: literal, text (interpolated), attr, var, call, op, array, names, is_null, between
    kind: str
    value: Any = None
    args: tuple[Expr, ...] = ()
    negated: bool = False
    source: str = field(default="", compare=False)


@dataclass(frozen=True)
class Scope:
    """What FROM names: streams with partitions, combined by a join or union; wildcard: all streams with the prefix."""

    how: str | None  # inner, left, right, outer, left_anti, right_anti, cat, and, xor
    streams: tuple[tuple[str, Expr | None], ...]
    wildcard: bool = False


@dataclass(frozen=True)
class Invocation:
    verb: str
    params: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Columns:
    level: str
    names: tuple[str, ...] | None
    variable: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    level: str | None
    alias: str | None


@dataclass(frozen=True)
class Param:
    name: str
    default: Expr | None = None


@dataclass(frozen=True)
class Statement:
    kind: str
    data: dict[str, Any] = field(hash=False)
    line: int = 0

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["data"][name]
        except KeyError:
            raise AttributeError(name) from None
