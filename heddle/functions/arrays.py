"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.scalar import NUMERIC, V, array, contains, double, long, py_in, py_number, py_text, text
from .registry import function


def _list(x: object) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [] if x is None else [x]


def common(args: tuple[V, ...]) -> tuple[list[Column], str]:
    """Values of several arguments in one type."""
    kinds = {a.t for a in args if a.t != "null"}
    if len(kinds) <= 1:
        return [a.c for a in args], next(iter(kinds), "null")
    if kinds <= set(NUMERIC):
        t = "long" if "double" not in kinds else "double"
        return [a.c.cast(t) for a in args], t
    return [text(a) for a in args], "str"


def element(a: V, v: V) -> Column:
    """v in the type of a's elements, as far as Spark can coerce it."""
    return v.c


def _slice(a: V, start: V, end: V) -> V:
    n = (long(end) - long(start)).cast("int")
    got = F.slice(array(a), long(start).cast("int") + 1, F.greatest(n, F.lit(0)))
    return V(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.get(got, i)), "arr")


def _py_slice(a: object, start: object, end: object) -> list:
    own, n = _list(a), int(end) - int(start)
    got = own[int(start) : int(end)]
    return got + [None] * (n - len(got))


def _py_range(a: object, b: object) -> list[int]:
    x, y = int(py_number(a)), int(py_number(b))
    return list(range(x, y + 1)) if x <= y else list(range(x, y - 1, -1))


def _py_insert(a: object, i: object, v: object) -> list:
    own = _list(a)
    own.insert(int(i), v)
    return own


def py_median(values: list) -> float | None:
    own = sorted(float(x) for x in map(py_number, values) if x is not None)
    n = len(own)
    return None if not n else own[n // 2] if n % 2 else (own[n // 2 - 1] + own[n // 2]) / 2


def py_mean(values: list) -> float | None:
    own = [float(x) for x in map(py_number, values) if x is not None]
    return sum(own) / len(own) if own else None


def median(values: Column) -> Column:
    own = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(own)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.get(own, half)).otherwise((F.get(own, half - 1) + F.get(own, half)) / 2)


def mean(values: Column) -> Column:
    own = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))


def doubles(a: V) -> Column:
    return F.transform(array(a), lambda x: x.try_cast("double"))


def _make(*args: V) -> V:
    own, _ = common(args)
    return V(F.array(*own), "arr")


def _py_put(a: list, i: object, v: object) -> object:
    old = a[int(i)]
    a[int(i)] = v
    return old


function("ARR_SLICE", 3, _slice, _py_slice)
function("ARR_ITEM", 2, lambda a, i: V(F.get(array(a), long(i).cast("int")), "str"), lambda a, i: _list(a)[int(i)])
function("ARR_PUT", 3, lambda a, i, v: V(F.get(array(a), long(i).cast("int")), "str"), _py_put)
function("ARR_LENGTH", 1, lambda a: V(F.coalesce(F.size(array(a)), F.lit(0)) if a.t != "null" else F.lit(0), "int"), lambda a: len(_list(a)), sees_null=True)
function("ARR_EMPTY", 1, lambda a: V(F.coalesce(F.size(array(a)), F.lit(0)) == 0 if a.t != "null" else F.lit(True), "bool"), lambda a: not _list(a), sees_null=True)
function("ARR_JOIN", 2, lambda a, s: V(F.call_function("array_join", array(a).cast("array<string>"), text(s)), "str"), lambda a, s: py_text(s).join(py_text(x) for x in _list(a) if x is not None))
function("ARR_MAKE", (0, None), _make, lambda *xs: list(xs), sees_null=True)
function("ARR_RANGE", 2, lambda a, b: V(F.sequence(a.c if a.t == "int" and b.t == "int" else long(a), b.c if a.t == "int" and b.t == "int" else long(b)), "arr"), _py_range)
function("ARR_INSERT", 3, lambda a, i, v: V(F.array_insert(array(a), long(i).cast("int") + 1, element(a, v)), "arr"), _py_insert)
function("ARR_ADD", 2, lambda a, v: V(F.array_append(array(a), element(a, v)), "arr"), lambda a, v: [*_list(a), v])
function("ARR_FILL", 2, lambda n, v: V(F.call_function("array_repeat", v.c, long(n).cast("int")), "arr"), lambda n, v: [v] * int(n))
function("ARR_CONTAINS", 2, lambda a, v: V(contains(v, a), "bool"), lambda a, v: py_in(v, a))
function("ARR_MEDIAN", 1, lambda a: V(median(doubles(a)), "double"), lambda a: py_median(_list(a)))
function("ARR_MEAN", 1, lambda a: V(mean(doubles(a)), "double"), lambda a: py_mean(_list(a)))
function("MEDIAN", (1, None), lambda *xs: V(median(F.array(*map(double, xs))), "double"), lambda *xs: py_median(list(xs)), sees_null=True)
function("MEAN", (1, None), lambda *xs: V(mean(F.array(*map(double, xs))), "double"), lambda *xs: py_mean(list(xs)), sees_null=True)
