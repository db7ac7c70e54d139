"""User-defined functions and transforms of scripts.

A function whose body is assignments, branches and a return becomes an expression: branches turn into CASE WHEN, loops
over arrays that are known when the script runs are unrolled. Other bodies run in Python, in Arrow batches. A transform
is a generator over the records of a partition.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scalar import V, py_text, py_truth, text, truth
from ..stream import GEO, KEY, OBJECT, VALUE, RecordContext, Stream, quoted
from .evaluate import Compiler, Evaluator
from .lexer import ScriptError
from .nodes import Expr, Param, Statement


@dataclass(frozen=True)
class UserFunction:
    name: str
    params: tuple[Param, ...]
    body: tuple[Statement, ...]
    record: bool = False
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class UserTransform:
    name: str
    params: tuple[Param, ...]
    types: tuple[str, ...]
    into: str
    columns: dict[str, list[str]]
    body: tuple[Statement, ...]


class Returned(Exception):
    def __init__(self, value: Any = None):
        self.value = value


class NotInline(Exception):
    """The body can't be an expression."""


def arguments(f: UserFunction, args: list) -> dict[str, Any]:
    if len(args) != len(f.params):
        raise ScriptError(f"{f.name} takes {len(f.params)} arguments")
    return {p.name: a for p, a in zip(f.params, args, strict=True)}


# -- plain
class Runner:
    """Runs function and transform bodies on plain values."""

    def __init__(self, functions: dict[str, UserFunction], outer: Callable[[str], Any], limit: int = 32):
        self.functions, self.outer, self.limit = functions, outer, limit

    def evaluator(self, env: dict[str, Any], record: Any = None, key: Any = None, names_as: str = "error") -> Evaluator:
        return Evaluator(lambda n: env[n] if n in env else self.outer(n), names_as=names_as, record=record, key=key, calls=self.call)

    def call(self, e: Expr, at: Evaluator) -> Any:
        f = self.functions.get(e.value.upper())
        if f is None:
            return NotImplemented
        own = arguments(f, [at.value(a) for a in e.args])
        return self.function(f, own, at.record, at.key_)

    def function(self, f: UserFunction, args: dict[str, Any], record: Any = None, key: Any = None) -> Any:
        env = {}
        for p in f.params:
            env[p.name] = args[p.name] if args[p.name] is not None or p.default is None else self.evaluator({}, names_as="text").value(p.default)
        for name, x in zip(f.names, (key, record), strict=False):
            env[name] = x
        try:
            for _ in self.run(f.body, env, record, key, "attr" if f.record else "error"):
                pass
        except Returned as r:
            return r.value
        raise ScriptError(f"{f.name} ended without RETURN")

    def run(self, body: Any, env: dict[str, Any], record: Any = None, key: Any = None, names_as: str = "error", fetch: Callable | None = None) -> Iterator[tuple[Any, Any]]:
        """Runs statements; YIELDs come out as (key, record)."""
        for s in body:
            at = self.evaluator(env, env.get("__record", record), env.get("__key", key), names_as)
            if s.kind == "let":
                x = at.value(s.expr)
                if s.name:
                    env[s.name] = x
            elif s.kind == "if":
                x = at.value(s.test)
                yield from self.run(s.body if x is not None and py_truth(x) else s.other, env, record, key, names_as, fetch)
            elif s.kind == "loop":
                own = at.value(s.over)
                own = list(own) if isinstance(own, (list, tuple)) else [] if own is None else [own]
                if own and len(own) > self.limit:
                    raise ScriptError(f"LOOP over {len(own)} values; the limit is {self.limit}")
                for x in own:
                    env[s.name] = x
                    yield from self.run(s.body, env, record, key, names_as, fetch)
                if not own and s.other:
                    yield from self.run(s.other, env, record, key, names_as, fetch)
            elif s.kind == "return":
                raise Returned(at.value(s.expr) if s.expr is not None else None)
            elif s.kind == "raise":
                message = py_text(at.value(s.expr))
                if s.level == "ERROR":
                    raise ScriptError(message)
            elif s.kind == "fetch" and fetch is not None:
                fetch(env, s.names)
            elif s.kind == "yield":
                yield at.value(s.key), at.value(s.record)
            else:
                raise ScriptError(f"{s.kind} can't be used here")


# -- expressions
class _Scoped(Compiler):
    """A compiler whose variables may be Columns."""

    def __init__(self, plain: Evaluator, ctx: RecordContext, user: Callable | None, env: dict[str, V]):
        super().__init__(plain, ctx, user)
        self.env = env

    def value(self, e: Expr) -> V:
        if e.kind == "var" and e.value in self.env:
            return self.env[e.value]
        if e.kind == "var" and "." in e.value and e.value.split(".", 1)[0] in self.env:
            raise NotInline
        return super().value(e)

    def literal_text(self, e: Expr) -> str | None:
        return None if e.kind == "var" and e.value in self.env else super().literal_text(e)

    def membership(self, e: Expr) -> V:
        if e.args[1].kind == "var" and e.args[1].value in self.env:
            from ..operators.scalar import contains

            got = contains(self.value(e.args[0]), self.value(e.args[1]))
            return V(~got if e.negated else got, "bool")
        return super().membership(e)


def inlined(f: UserFunction, args: list[V], outer: Compiler, depth: int = 0) -> V:
    if depth > 8:
        raise NotInline
    env = arguments(f, args)
    for p in f.params:
        if p.default is not None:
            x = outer.value(p.default)
            env[p.name] = V(F.coalesce(env[p.name].c, x.c), x.t if env[p.name].t == "null" else env[p.name].t)
    if f.names:
        raise NotInline
    user = (lambda e, c: outer.user(e, c, depth + 1)) if outer.user else None

    def block(body: tuple[Statement, ...], env: dict[str, V]) -> V | None:
        for i, s in enumerate(body):
            c = _Scoped(outer.plain, outer.ctx, user, env)
            if s.kind == "let":
                if s.name:
                    env = {**env, s.name: c.value(s.expr)}
            elif s.kind == "return":
                return c.value(s.expr)
            elif s.kind == "if":
                rest = tuple(body[i + 1 :])
                yes, no = block((*s.body, *rest), env), block((*s.other, *rest), env)
                if yes is None or no is None:
                    raise NotInline
                test = F.coalesce(truth(c.value(s.test)), F.lit(False))
                if yes.t == no.t or "null" in (yes.t, no.t):
                    return V(F.when(test, yes.c).otherwise(no.c), no.t if yes.t == "null" else yes.t)
                return V(F.when(test, text(yes)).otherwise(text(no)), "str")
            elif s.kind == "loop" and s.over.kind in ("array", "var", "names") and not (s.over.kind == "var" and s.over.value in env):
                own = outer.plain.value(s.over)
                own = list(own) if isinstance(own, (list, tuple)) else [] if own is None else [own]
                from .evaluate import literal

                unrolled: list[Statement] = []
                for x in own:
                    unrolled += [Statement("bind", {"name": s.name, "v": literal(x)}), *s.body]
                return block((*(unrolled if own else s.other or ()), *body[i + 1 :]), env)
            elif s.kind == "bind":
                env = {**env, s.name: s.v}
            else:
                raise NotInline
        return None

    got = block(f.body, env)
    if got is None:
        raise NotInline
    return got


def as_udf(f: UserFunction, args: list[V], functions: dict[str, UserFunction], values: dict[str, Any], ctx: RecordContext) -> V:
    """The function in Python; results are texts (arrays and maps as JSON)."""
    own = dict(functions)
    columns = [text(a) if a.t not in ("int", "long", "double", "bool", "arr") else a.c for a in args]
    names = [p.name for p in f.params]
    extra = [F.col(KEY).cast("string"), F.to_json(F.struct(*[ctx.attr(n).c.alias(n) for n in ctx.names]))] if f.record else []

    def run(*series: pd.Series) -> pd.Series:
        runner = Runner(own, values.get)
        out = []
        for row in zip(*series, strict=True):
            given = [None if x is None or (isinstance(x, float) and x != x) else list(x) if hasattr(x, "tolist") and not isinstance(x, (int, float, str, bool)) and getattr(x, "ndim", 0) else x.item() if hasattr(x, "item") else x for x in row]
            record, key = (json.loads(given[-1]), given[-2]) if f.record else (None, None)
            got = runner.function(f, dict(zip(names, given, strict=False)), record, key)
            out.append(None if got is None else json.dumps(got) if isinstance(got, (list, tuple, dict)) else py_text(got))
        return pd.Series(out, dtype=object)

    if not columns and not extra:
        extra = [F.lit("")]
    return V(F.pandas_udf(run, "string")(*columns, *extra), "str")


# -- transforms
def transformed(t: UserTransform, s: Stream, params: dict[str, Any], columns: dict[str, list[str]], functions: dict[str, UserFunction], values: dict[str, Any], limit: int) -> Stream:
    kind = s.kind if t.into == "any" else t.into
    attrs = columns or t.columns or ({s.level: s.names} if kind == s.kind else {})
    if kind not in ("text", "columnar", "structured"):
        raise ScriptError(f"a user transform into {kind} isn't supported")
    names = attrs.get("value", [])
    if kind == "columnar" and not names:
        raise ScriptError(f"{t.name} needs VALUE columns")
    fields = [T.StructField(KEY, T.StringType())] + ([T.StructField(VALUE, T.StringType())] if kind != "columnar" else [T.StructField(n, T.StringType()) for n in names])
    schema = T.StructType(fields)
    own = dict(functions)
    body = t.body
    given = dict(params)
    source = s.kind
    shown = [F.to_json(F.col(c)).alias(c) if c in (OBJECT, GEO) else F.col(quoted(c)) for c in s.df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def rows() -> Iterator[tuple[Any, Any]]:
            for frame in batches:
                keys = frame[KEY].tolist()
                for key, r in zip(keys, frame.drop(columns=[KEY]).to_dict("records"), strict=True):
                    if source == "text":
                        yield key, r[VALUE]
                    elif source == "structured":
                        yield key, json.loads(r[OBJECT]) if r[OBJECT] is not None else None
                    else:
                        yield key, {k: None if v is None or v != v else v.item() if hasattr(v, "item") else v for k, v in r.items()}

        stream = rows()
        env: dict[str, Any] = {**given, "PARTITION": TaskContext.get().partitionId() if TaskContext.get() else 0, "NOTFOUND": False}
        runner = Runner(own, values.get, limit)

        def fetch(env: dict[str, Any], targets: list[str]) -> None:
            key, record = next(stream, (None, None))
            env["NOTFOUND"] = record is None
            env["__key"], env["__record"] = key, record
            for name, x in zip(targets, (key, record), strict=False):
                env[name] = x

        def results() -> Iterator[tuple[Any, Any]]:
            try:
                while True:  # the body runs again until it returns
                    yield from runner.run(body, env, None, None, "attr", fetch)
                    if env["NOTFOUND"]:
                        return
            except Returned:
                return

        block: list[tuple] = []
        for key, record in results():
            k = None if key is None else py_text(key)
            if kind == "columnar":
                r = record if isinstance(record, dict) else {}
                block.append((k, *[None if r.get(n) is None else py_text(r[n]) for n in names]))
            else:
                block.append((k, None if record is None else json.dumps(record) if isinstance(record, (dict, list)) or kind == "structured" else py_text(record)))
            if len(block) >= 5000:
                yield pd.DataFrame(block, columns=[f.name for f in fields])
                block = []
        if block:
            yield pd.DataFrame(block, columns=[f.name for f in fields])

    df = s.df.select(*shown).mapInPandas(run, schema)
    if kind == "structured":
        df = df.select(KEY, F.try_parse_json(VALUE).alias(OBJECT))
    return s.made("TRANSFORMED", t.name, df=df, kind=kind, attrs={} if kind == "text" else attrs)
