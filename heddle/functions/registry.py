"""Scalar functions of scripts: a Column builder and, where scripts evaluate without a stream, a plain Python form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..operators.scalar import V


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    col: Callable[..., V]
    py: Callable | None
    record: bool = False
    sees_null: bool = False


FUNCTIONS: dict[str, Function] = {}


def function(name: str, arity: int | tuple[int, int | None], col: Callable[..., V], py: Callable | None = None, *, record: bool = False, sees_null: bool = False) -> None:
    """Register a function. Nulls give null unless sees_null. Record functions get the compiler's context first and have no Python form."""
    least, most = (arity, arity) if isinstance(arity, int) else arity
    FUNCTIONS[name] = Function(name, least, most, col, py, record, sees_null)
