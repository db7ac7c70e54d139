"""Two evaluators of expressions: to Columns for records, and to plain values where there is no record."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FUNCTIONS
from ..functions.records import navigate
from ..operators.scalar import NUMERIC, OPERATORS, V, digest, double, equal, java_pattern, py_number, py_text, text, truth
from ..stream import RecordContext
from .lexer import ScriptError
from .nodes import Expr
from .parser import parse_expression

_BRACES = re.compile(r"\\([{}])|\{([^{}]*)\}")


def literal(v: Any) -> V:
    if v is None:
        return V(F.lit(None), "null")
    if isinstance(v, bool):
        return V(F.lit(v), "bool")
    if isinstance(v, int):
        return V(F.lit(v), "int") if -(2**31) <= v < 2**31 else V(F.lit(v).cast("long"), "long")
    if isinstance(v, float):
        return V(F.lit(v), "double")
    if isinstance(v, (list, tuple)):
        own = list(v)
        if not own:
            return V(F.array().cast("array<string>"), "arr")
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in own):
            kind = "double" if any(isinstance(x, float) for x in own) else "long"
            return V(F.array(*[F.lit(x).cast(kind) for x in own]), "arr")
        return V(F.array(*[F.lit(None if x is None else py_text(x)).cast("string") for x in own]), "arr")
    if isinstance(v, dict):
        if not v:
            return V(F.create_map().cast("map<string,string>"), "rec")
        pairs = [y for k, x in v.items() for y in (F.lit(py_text(k)), F.lit(None if x is None else x if isinstance(x, int) else py_text(x)))]
        return V(F.create_map(*pairs), "rec")
    return V(F.lit(v), "str")


class Answer:
    """The values of a query (column v of type t), brought to the driver only where a script reads them."""

    def __init__(self, df: DataFrame, t: str):
        self.df, self.t = df, t

    @cached_property
    def values(self) -> list:
        return [r["v"] for r in self.df.collect()]

    def among(self, x: V) -> Column:
        """Whether a record's value is one of them, for filters: a semi-join, or an existence join where it is negated. Null if the value is."""
        found, v = self.df.filter("v is not null"), F.col("v")
        if x.t in NUMERIC:
            if self.t not in NUMERIC:
                return F.lit(False)
            if x.t == "double":
                return x.c.isin(found.select(v.cast("double")))
            if self.t == "double":
                found = found.filter((v == F.floor(v)) & (F.abs(v) < 2.0**63))
            return x.c.cast("long").isin(found.select(v.cast("long")))
        if x.t == "str" and self.t != "str":
            return F.lit(False)
        return text(x).isin(found.select(v.cast("string")))


class Evaluator:
    """Plain values. variables: a lookup by name. names_as: what a bare name stands for ('text', 'attr' or 'error')."""

    def __init__(self, variables: Callable[[str], Any], user: dict[str, Any] | None = None, names_as: str = "text", record: Any = None, key: Any = None, calls: Callable | None = None):
        self.variables, self.user, self.names_as, self.record, self.key_, self.calls = variables, user or {}, names_as, record, key, calls

    def interpolated(self, s: str) -> str:
        if "{" not in s and "\\" not in s:
            return s
        loose = Evaluator(self.variables, self.user, "error", calls=self.calls)

        def one(m: re.Match) -> str:
            if m[1]:
                return m[1]
            x = loose.value(parse_expression(m[2]))
            return "" if x is None else py_text(x)

        return _BRACES.sub(one, s)

    def variable(self, name: str) -> Any:
        got = self.variables(name)
        if got is None and "." in name:
            head, path = name.split(".", 1)
            got = self.variables(head)
            return navigate(got, path)
        return got

    def value(self, e: Expr) -> Any:
        k = e.kind
        if k == "literal":
            return e.value
        if k == "text":
            return self.interpolated(e.value)
        if k == "var":
            return self.variable(e.value)
        if k == "names":
            return [self.interpolated(x) for x in e.value]
        if k == "array":
            return [self.value(x) for x in e.args]
        if k == "attr":
            if self.names_as == "text":
                return self.interpolated(e.value)
            if self.names_as == "error":
                raise ScriptError(f"an attribute ({e.value}) can't be read here")
            if isinstance(self.record, str):
                return self.record
            return self.record[e.value] if isinstance(self.record, dict) and e.value in self.record else navigate(self.record, e.value)
        if k == "is_null":
            return (self.value(e.args[0]) is None) != e.negated
        if k == "between":
            x = py_number(self.value(e.args[0]))
            return None if x is None else (e.value[0] <= x <= e.value[1]) != e.negated
        if k == "op":
            op = OPERATORS[e.value, len(e.args)]
            args = [self.value(a) for a in e.args]
            if not op.sees_null and None in args:
                return None
            got = op.py(*args)
            return not got if e.negated else got
        if k == "call":
            return self.call(e)
        raise ScriptError(f"unknown expression {k}")

    def call(self, e: Expr) -> Any:
        name = e.value.upper()
        if self.calls is not None and (got := self.calls(e, self)) is not NotImplemented:
            return got
        if name in ("REC_KEY", "REC_OBJECT", "REC_ATTR", "REC_ATTRS", "REC_PIVOT") and self.names_as == "attr":
            own = self.record if isinstance(self.record, dict) else {"value": self.record}
            return {"REC_KEY": lambda: self.key_, "REC_OBJECT": lambda: self.record, "REC_ATTRS": lambda: list(own), "REC_PIVOT": lambda: list(own.values()), "REC_ATTR": lambda: navigate(own, py_text(self.value(e.args[0])))}[name]()
        f = FUNCTIONS.get(name)
        if f is None:
            raise ScriptError(f"unknown function {e.value}")
        if f.py is None:
            raise ScriptError(f"{e.value} needs a record")
        args = [self.value(a) for a in e.args]
        if len(args) < f.least or (f.most is not None and len(args) > f.most):
            raise ScriptError(f"{e.value} takes {f.least} to {f.most} arguments")
        if not f.sees_null and None in args:
            return None
        return f.py(*args)


class Compiler:
    """Columns. Variables are literals of the plan; user functions are inlined or become UDFs."""

    def __init__(self, plain: Evaluator, context: RecordContext, user: Callable | None = None, answer: Callable[[str], Answer | None] | None = None):
        self.plain, self.ctx, self.user, self.answer, self.filtering = plain, context, user, answer, False

    def literal_text(self, e: Expr) -> str | None:
        return py_text(self.plain.value(e)) if e.kind in ("text", "literal", "var") and self.plain.value(e) is not None else None

    def value(self, e: Expr) -> V:
        k = e.kind
        if k in ("literal", "text", "var"):
            return literal(self.plain.value(e))
        if k == "names":
            return literal(list(e.value))
        if k == "attr":
            return self.ctx.attr(self.plain.interpolated(e.value))
        if k == "array":
            from ..functions.arrays import common

            own, _ = common(tuple(self.value(x) for x in e.args))
            return V(F.array(*own) if own else F.array().cast("array<string>"), "arr")
        if k == "is_null":
            x = self.value(e.args[0])
            empty = x.c.isNull() | F.is_variant_null(x.c) if x.t == "var" else x.c.isNull()
            return V(~empty if e.negated else empty, "bool")
        if k == "between":
            x = self.value(e.args[0])
            low, high = e.value
            if x.t in ("int", "long") and max(abs(low), abs(high)) < 2**62:
                got = x.c.between(math.ceil(low), math.floor(high))
            else:
                got = double(x).between(float(low), float(high))
            return V(~got if e.negated else got, "bool")
        if k == "op":
            return self.operation(e)
        return self.call(e)

    def condition(self, e: Expr) -> Column:
        """A filter that passes what `e` is true of. A filter drops null, too, so tests stay bare where they aren't negated, and reach the source."""
        self.filtering = True
        try:
            return self._condition(e)
        finally:
            self.filtering = False

    def _condition(self, e: Expr) -> Column:
        if e.kind == "op" and not e.negated and len(e.args) == 2:
            if e.value in ("AND", "OR"):
                a, b = (self._condition(x) for x in e.args)
                return a & b if e.value == "AND" else a | b
            if e.value in ("=", "=="):
                return equal(*(self.value(x) for x in e.args))
            if e.value in ("!=", "<>"):
                a, b = (self.value(x) for x in e.args)
                if {a.t, b.t} <= set(NUMERIC) or a.t == b.t in ("str", "bool", "ts"):
                    return ~equal(a, b)
            if e.value == "IN" and e.args[1].kind in ("var", "array", "names"):
                got = self.membership(e, bare=True)
                return truth(got)
        return truth(self.value(e))

    def operation(self, e: Expr) -> V:
        op = OPERATORS[e.value, len(e.args)]
        if e.value in ("LIKE", "MATCH", "REGEX", "REGEXP") and (pattern := self.literal_text(e.args[1])) is not None:
            return V(text(self.value(e.args[0])).rlike(java_pattern(pattern)), "bool")
        if e.value in ("DIGEST", "HASH"):
            name = self.literal_text(e.args[1])
            if name is None:
                raise ScriptError("a digest's name must be known when the script runs")
            return V(digest(text(self.value(e.args[0])), name), "str")
        if e.value == "IN" and e.args[1].kind in ("var", "array", "names"):
            return self.membership(e)
        args = [self.value(a) for a in e.args]
        got = op.col(*args)
        if not op.sees_null and any(a.t == "null" for a in args):
            got = V(F.lit(None).cast("boolean" if got.t == "bool" else "double" if got.t in NUMERIC else "string"), got.t)
        return V(~got.c, "bool") if e.negated else got

    def membership(self, e: Expr, bare: bool = False) -> V:
        """bare: null where the value is null, for filters."""
        if self.filtering and self.answer is not None and e.args[1].kind == "var" and (found := self.answer(e.args[1].value)) is not None:
            got = found.among(self.value(e.args[0]))
            got = got if bare else F.coalesce(got, F.lit(False))
            return V(~got if e.negated else got, "bool")
        own = self.plain.value(e.args[1])
        own = list(own) if isinstance(own, (list, tuple)) else [] if own is None else [own]
        x = self.value(e.args[0])
        if x.t in NUMERIC:
            kept = [y for y in own if isinstance(y, (int, float)) and not isinstance(y, bool)]
            if x.t == "double":
                got = x.c.isin([float(y) for y in kept])
            else:
                kept = [int(y) for y in kept if y == y and abs(y) < 2**63 and y == int(y)]
                got = x.c.isin(kept)
        else:
            strict = x.t != "str"
            kept = [py_text(y) for y in own if y is not None and (strict or isinstance(y, str))]
            got = text(x).isin(kept)
        got = F.lit(False) if not kept else got if bare else F.coalesce(got, F.lit(False))
        return V(~got if e.negated else got, "bool")

    def call(self, e: Expr) -> V:
        name = e.value.upper()
        if self.user is not None and (got := self.user(e, self)) is not None:
            return got
        f = FUNCTIONS.get(name)
        if f is None:
            raise ScriptError(f"unknown function {e.value}")
        if len(e.args) < f.least or (f.most is not None and len(e.args) > f.most):
            raise ScriptError(f"{e.value} takes {f.least} to {f.most} arguments")
        args = [self.value(a) for a in e.args]
        if f.record:
            if name == "REC_ATTR" and (known := self.literal_text(e.args[0])) is not None:
                return self.ctx.attr(known)
            if name == "REC_ATTR":
                return f.col(_Bound(self.ctx), *args)
            if name == "REC_OBJECT":
                return self.ctx.record()
            return f.col(self.ctx, *args)
        if any(a.t == "null" for a in args) and not f.sees_null:
            return V(F.lit(None).cast("string"), "str")
        got = f.col(*args)
        if name in ("ARR_ITEM", "ARR_PUT") and args[0].t == "arr":
            return got
        return got


class _Bound:
    def __init__(self, ctx: RecordContext):
        self.ctx, self.names, self.attr = ctx, ctx.names, ctx.attr

    def literal(self, _: Any) -> None:
        return None
