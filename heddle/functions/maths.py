"""Numeric functions; all work on doubles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.scalar import V, double, py_number
from .registry import function


def _numeric(name: str, arity: int | tuple, col: Callable[..., Column], py: Callable, t: str = "double", **more: bool) -> None:
    def safe(*args: object) -> object:
        own = [py_number(a) for a in args]
        if None in own:
            return None
        try:
            return py(*map(float, own))
        except ZeroDivisionError:
            return math.nan
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    function(name, arity, lambda *args: V(col(*map(double, args)), t), safe, **more)


def _log(x: Column) -> Column:
    """Natural logarithm with -Infinity at 0 and NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-math.inf)).when(x.isNotNull(), F.lit(math.nan))


def _py_log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


_numeric("CEIL", 1, lambda x: F.ceil(x).cast("double"), lambda x: float(math.ceil(x)))
_numeric("FLOOR", 1, lambda x: F.floor(x).cast("double"), lambda x: float(math.floor(x)))
_numeric("ROUND", 1, lambda x: F.floor(x + 0.5).cast("long"), lambda x: math.floor(x + 0.5), "long")
_numeric("LOG", 2, lambda b, x: _log(x) / _log(b), lambda b, x: _py_log(x) / _py_log(b))
_numeric("LN", 1, _log, _py_log)
_numeric("LG", 1, lambda x: F.when(x > 0, F.log10(x)).otherwise(_log(x)), lambda x: math.log10(x) if x > 0 else _py_log(x))
for _name in ("SIN", "COS", "TAN", "SINH", "COSH", "TANH", "ASIN", "ACOS", "ATAN"):
    _numeric(_name, 1, getattr(F, _name.lower()), getattr(math, _name.lower()))
_numeric("ATAN2", 2, lambda a, b: F.atan2(a, b), math.atan2)
_numeric("E", 0, lambda: F.lit(math.e), lambda: math.e)
_numeric("PI", 0, lambda: F.lit(math.pi), lambda: math.pi)
_numeric("RAD", 1, F.radians, math.radians)
_numeric("DEG", 1, F.degrees, math.degrees)
_numeric("SIGN", 1, F.signum, lambda x: math.nan if math.isnan(x) else float((x > 0) - (x < 0)))
_numeric("ABS", 1, F.abs, abs)


def _fold(pick: Callable, py: Callable) -> tuple[Callable, Callable]:
    return (lambda *xs: V(pick(*map(double, xs)) if len(xs) > 1 else double(xs[0]), "double")), (lambda *xs: (lambda own: float(py(own)) if own else None)([x for x in map(py_number, xs) if x is not None]))


for _name, _pick, _py in (("MAX", F.greatest, max), ("MIN", F.least, min)):
    _col, _plain = _fold(_pick, _py)
    function(_name, (1, None), _col, _plain, sees_null=True)
