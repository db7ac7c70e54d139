"""Transforms and operations by verb, with typed parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..lang.lexer import ScriptError
from .scalar import py_number, py_text, py_truth

REQUIRED = object()
EVERY = ("text", "columnar", "structured", "point", "polygon", "track")
ATTRIBUTED = EVERY[1:]
SIGNAL = ("columnar", "structured", "point")
SPATIAL = ("point", "polygon", "track")


@dataclass(frozen=True)
class Verb:
    name: str
    run: Callable
    params: dict[str, tuple[str, Any]] = field(default_factory=dict)
    accepts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    def configured(self, given: dict[str, Any]) -> dict[str, Any]:
        """Parameters by declared type; names that end in * take all with that prefix."""
        out: dict[str, Any] = {}
        prefixes = {p[:-1]: t for p, (t, _) in self.params.items() if p.endswith("*")}
        for k in given:
            if k not in self.params and not any(k.startswith(p) for p in prefixes):
                raise ScriptError(f"{self.name} has no parameter {k}")
        for p, (t, default) in self.params.items():
            if p.endswith("*"):
                out[p[:-1]] = {k[len(p) - 1 :]: typed(f"{self.name} {k}", v, t) for k, v in given.items() if k.startswith(p[:-1]) and k not in self.params}
            elif given.get(p) is not None:
                out[p] = typed(f"{self.name} {p}", given[p], t)
            elif default is REQUIRED:
                raise ScriptError(f"{self.name} needs @{p}")
            else:
                out[p] = default
        return out


def typed(what: str, v: Any, t: str) -> Any:
    if t == "list":
        return [py_text(x) for x in v] if isinstance(v, (list, tuple)) else [py_text(v)]
    if t == "text":
        return py_text(v)
    if t == "bool":
        return py_truth(v)
    if t in ("double", "int"):
        n = py_number(v)
        if n is None:
            raise ScriptError(f"{what} must be a number")
        return float(n) if t == "double" else int(n)
    choices = t.split("|")
    if py_text(v).upper() not in choices:
        raise ScriptError(f"{what} is one of {', '.join(choices)}")
    return py_text(v).upper()


TRANSFORMS: dict[str, Verb] = {}
OPERATIONS: dict[str, Verb] = {}
INPUTS: dict[str, Verb] = {}
OUTPUTS: dict[str, Verb] = {}


def transform(name: str, accepts: tuple[str, ...], **params: Any) -> Callable:
    def register(f: Callable) -> Callable:
        TRANSFORMS[name.lower()] = Verb(name, f, _named(params), {"": accepts})
        return f

    return register


def operation(name: str, accepts: tuple[str, ...] | dict[str, tuple[str, ...]], outputs: tuple[str, ...] = (), optional: tuple[str, ...] = (), also_transform: bool = False, **params: Any) -> Callable:
    """accepts: types of the one input, or of each named input; optional: inputs and outputs that may be missing."""

    def register(f: Callable) -> Callable:
        own = accepts if isinstance(accepts, dict) else {"": accepts}
        OPERATIONS[name.lower()] = Verb(name, f, _named(params), own, outputs, optional)
        if also_transform:
            TRANSFORMS[name.lower()] = Verb(name, lambda s, p, c: f({"": s}, p)[""], _named(params), own)
        return f

    return register


def _named(params: dict[str, Any]) -> dict[str, tuple[str, Any]]:
    return {k[:-4] + "*" if k.endswith("_ANY") else k: v for k, v in params.items()}
