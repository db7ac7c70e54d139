"""Functions on records and structured values. Record functions see the compiler's context: the stream's attributes by name."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.scalar import V, array, hashcode, py_text, text
from .registry import function


def path_of(name: str) -> str:
    """An attribute path (a.b[0].c) as a path of variants."""
    name = name.lstrip(".")
    return "$" + ("" if not name else name if name.startswith("[") else f".{name}")


def navigate(value: Any, path: str) -> Any:
    """a.b[1], [*], [l:r] in plain values; what is missing is None."""
    import re

    for part in re.findall(r"[^.\[\]]+|\[[^\]]*\]", path.lstrip(".")):
        if value is None:
            return None
        if part.startswith("["):
            inside = part[1:-1]
            own = value if isinstance(value, list) else [value]
            if inside in ("", "*"):
                value = own
            elif ":" in inside:
                a, b = inside.split(":", 1)
                value = own[int(a) if a else None : int(b) if b else None]
            else:
                i = int(inside)
                value = own[i] if -len(own) <= i < len(own) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def structured_get(v: Column, path: str) -> V:
    """The value at a path of a variant: [*] is the whole array, [l:r] a slice with ends as in Python."""
    import re

    m = re.fullmatch(r"(.*)\[(\*?|-?\d*:-?\d*)\]", path)
    if not m:
        return V(F.try_variant_get(v, path_of(path), "variant"), "var")
    own = F.try_variant_get(v, path_of(m[1]), "array<string>")
    own = F.coalesce(own, F.when(F.try_variant_get(v, path_of(m[1]), "variant").isNotNull(), F.array(F.try_variant_get(v, path_of(m[1]), "string"))))
    if m[2] in ("", "*"):
        return V(own, "arr")
    a, b = m[2].split(":")
    n = F.size(own)
    start = F.lit(int(a or 0))
    end = F.lit(int(b)) if b else n
    start = F.least(F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0)), n)
    end = F.least(F.greatest(F.when(end < 0, n + end).otherwise(end), F.lit(0)), n)
    return V(F.slice(own, start + 1, F.greatest(end - start, F.lit(0))), "arr")


def _values(ctx: Any) -> list[Column]:
    return [text(ctx.attr(n)) for n in ctx.names]


def _names(ctx: Any) -> Column:
    return F.array(*[F.lit(n) for n in ctx.names]).cast("array<string>")


def _record(ctx: Any) -> V:
    return V(F.struct(*[ctx.attr(n).c.alias(n) for n in ctx.names]), "rec")


def _attr(ctx: Any, name: V, source: Any = None) -> V:
    literal = ctx.literal(source)
    if literal is not None:
        return ctx.attr(literal)
    return V(F.map_from_arrays(_names(ctx), F.array(*_values(ctx)).cast("array<string>"))[text(name)], "str")


function("REC_KEY", 0, lambda ctx: ctx.key(), record=True)
function("REC_OBJECT", 0, _record, record=True)
function("REC_ATTR", 1, _attr, record=True)
function("REC_ATTRS", 0, lambda ctx: V(_names(ctx), "arr"), record=True)
function("REC_PIVOT", 0, lambda ctx: V(F.array(*_values(ctx)).cast("array<string>"), "arr"), record=True)
function("REC_HASHCODE", 0, lambda ctx: V(F.hash(*[ctx.attr(n).c if ctx.attr(n).t != "var" else F.to_json(ctx.attr(n).c) for n in ctx.names]), "int"), record=True)


def as_map(o: V) -> Column:
    """A record or structured value as a map of texts."""
    if o.t == "var":
        return F.coalesce(F.try_variant_get(o.c, "$", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.from_json(F.to_json(o.c), "map<string,string>")


function("ATTRS", 1, lambda o: V(F.map_keys(as_map(o)), "arr"), lambda o: list(o) if isinstance(o, dict) else [])
function("ATTR", 2, lambda o, n: V(F.get(F.transform(F.filter(F.map_entries(as_map(o)), lambda e: e["key"] == text(n)), lambda e: e["value"]), 0), "str"), lambda o, n: navigate(o, py_text(n)))


def _put(o: V, n: V, v: V) -> V:
    kept = F.map_filter(as_map(o), lambda k, _: k != text(n))
    return V(F.to_variant_object(F.map_concat(kept, F.create_map(text(n), text(v)))), "var")


function("ATTR_PUT", 3, _put, lambda o, n, v: {**o, py_text(n): v})
function("ATTR_REMOVE", 2, lambda o, n: V(F.to_variant_object(F.map_filter(as_map(o), lambda k, _: k != text(n))), "var"), lambda o, n: {k: v for k, v in o.items() if k != py_text(n)})
function("STRUCT_ATTRS", 1, lambda o: V(F.map_keys(as_map(o)), "arr"), lambda o: list(o))
function("STRUCT_PIVOT", 1, lambda o: V(F.map_values(as_map(o)), "arr"), lambda o: list(o.values()))


def _struct_attr(o: V, n: V) -> V:
    if o.t == "var":
        return V(F.call_function("try_variant_get", o.c, F.concat(F.when(F.startswith(text(n), F.lit("[")), "$").otherwise("$."), text(n)), F.lit("variant")), "var")
    return V(as_map(o)[text(n)], "str")


function("STRUCT_ATTR", 2, _struct_attr, lambda o, n: navigate(o, py_text(n)))


def _from_array(a: V, inverse: V) -> V:
    own = array(a).cast("array<string>")
    index = F.transform(own, lambda _, i: i.cast("string"))
    pairs = F.when(inverse.c.cast("boolean"), F.arrays_zip(own.alias("k"), index.alias("v"))).otherwise(F.arrays_zip(index.alias("k"), own.alias("v")))
    return V(F.map_from_entries(pairs), "rec")


function("STRUCT_FROM_ARRAY", 2, _from_array, lambda a, inv: {(py_text(x) if inv else str(i)): (i if inv else x) for i, x in enumerate(a)})
function("COLUMNAR_MAKE", 2, lambda n, v: V(F.map_from_arrays(array(n).cast("array<string>"), array(v).cast("array<string>")), "rec"), lambda n, v: dict(zip(map(py_text, n), v, strict=False)))
function("TO_JSON", 1, lambda o: V(F.to_json(o.c), "str"), lambda o: json.dumps(o))
function("HASH_CODE", 1, lambda o: V(hashcode(o), "int"), sees_null=True)
