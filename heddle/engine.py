"""The engine: named streams, variables and options, and the interpreter of scripts over them."""

from __future__ import annotations

import logging
import os
import sys
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions  # noqa: F401
from .lang.evaluate import Answer, Compiler, Evaluator
from .lang.lexer import ScriptError
from .lang.nodes import Columns, Expr, Invocation, Scope, Statement
from .lang.parser import parse, parse_expression
from .lang.user import NotInline, Runner, UserFunction, UserTransform, as_udf, inlined, transformed
from .operators import analytics, geo, relational, transforms  # noqa: F401
from .operators.registry import INPUTS, OPERATIONS, OUTPUTS, TRANSFORMS
from .operators.scalar import V, py_text, py_truth, text, truth, type_name
from .sources import adapters
from .stream import GEO, KEY, OBJECT, PART, VALUE, RecordContext, Stream, StructContext, quoted

log = logging.getLogger("heddle")
DEFAULTS = {"storage_level": "MEMORY_AND_DISK", "usage_threshold": 2, "log_level": "INFO", "batch_verbose": False, "loop_iteration_limit": 32, "loop_nesting_limit": 3, "exact_limit": False, "auto_persist": False}


class Scopes:
    """Nested variables. A name is set where it is already known, else in the innermost scope; null removes it."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Any]] = [{}]

    def get(self, name: str) -> Any:
        for level in reversed(self.levels):
            if name in level:
                return level[name]
        return None

    def set(self, name: str, value: Any, here: bool = False) -> None:
        level = self.levels[-1] if here else next((x for x in reversed(self.levels) if name in x), self.levels[-1])
        if value is None and not here:
            level.pop(name, None)
        else:
            level[name] = value

    def flat(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for level in self.levels:
            out.update(level)
        return out


class Engine:
    def __init__(self, spark: SparkSession, variables: dict[str, Any] | None = None):
        self.spark = spark
        spark.conf.set("spark.sql.ansi.enabled", "false")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.streams: dict[str, Stream] = {}
        self.uses: dict[str, int] = {}
        self.scopes = Scopes()
        for k, v in (variables or {}).items():
            self.scopes.set(k, v)
        self.options = dict(DEFAULTS)
        self.procedures: dict[str, Statement] = {}
        self.functions: dict[str, UserFunction] = {}
        self.transforms: dict[str, UserTransform] = {}
        self.metrics: list[DataFrame] = []
        self.depth = 0
        self.streams["dual"] = Stream("dual", spark.createDataFrame([("x",)], f"{VALUE} string").withColumn(KEY, F.lit(0)), "text")

    # -- streams
    def register(self, name: str, df: DataFrame, kind: str = "columnar", key: str | Column | None = None) -> Stream:
        """A stream from a DataFrame; a key names a column or is one, else records are keyed by their hash."""
        if isinstance(key, str):
            key = F.col(quoted(key))
        df = df.withColumn(KEY, key) if key is not None else adapters.keyed(df, "HASHCODE")
        names = [c for c in df.columns if c not in (KEY, PART, GEO, OBJECT)]
        s = Stream(name, df, kind, {("value" if kind in ("columnar", "structured", "text") else kind): names}, (("CREATED", name),))
        self.streams[name] = s
        return s

    def stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise ScriptError(f"there is no stream {name}")
        n = self.uses[name] = self.uses.get(name, 0) + 1
        s = self.streams[name]
        if self.options["auto_persist"] and n == int(self.options["usage_threshold"]):
            # a stream that is read again is kept
            s = self.streams[name] = s.but(df=s.df.persist(getattr(StorageLevel, py_text(self.options["storage_level"]).upper())))
        return s

    def family(self, prefix: str) -> list[str]:
        return [n for n in self.streams if n.startswith(prefix) and len(n) > len(prefix)]

    def put(self, s: Stream, name: str, replace: bool = False) -> None:
        if name in self.streams and not replace:
            raise ScriptError(f"stream {name} exists already")
        self.streams[name] = s.but(name=name)

    def renounce(self, name: str) -> None:
        self.streams.pop(name, None)

    def frame(self, name: str, key: bool = False) -> DataFrame:
        """A stream's attributes as a DataFrame."""
        s = self.streams[name]
        own = [KEY] if key else []
        own += [c for c in (GEO, OBJECT) if c in s.df.columns]
        return s.df.select(*own, *[F.col(quoted(c)) for c in s.columns])

    # -- expressions
    def variable(self, name: str) -> Any:
        if name == "CWD":
            return os.getcwd()
        if name.startswith("ENV:"):
            return os.environ.get(name[4:])
        if name.startswith("OPT:"):
            return self.options.get(name[4:])
        got = self.scopes.get(name)
        return got.values if isinstance(got, Answer) else got

    def answer(self, name: str) -> Answer | None:
        got = self.scopes.get(name)
        return got if isinstance(got, Answer) else None

    def plain(self, names_as: str = "text") -> Evaluator:
        runner = Runner(self.functions, self.variable, int(self.options["loop_iteration_limit"]))
        return Evaluator(self.variable, names_as=names_as, calls=runner.call)

    def loose(self, e: Expr) -> Any:
        return self.plain("error").value(e)

    def param(self, e: Expr) -> Any:
        return self.plain().value(e)

    def name(self, raw: str) -> str:
        return self.plain().interpolated(raw)

    def path(self, e: Expr) -> str:
        return py_text(self.loose(e))

    def compiler(self, context: RecordContext) -> Compiler:
        return Compiler(self.plain(), context, self.user_call, self.answer)

    def user_call(self, e: Expr, at: Compiler, depth: int = 0) -> V | None:
        f = self.functions.get(e.value.upper())
        if f is None:
            return None
        args = [at.value(a) for a in e.args]
        try:
            return inlined(f, args, at, depth)
        except NotInline:
            return as_udf(f, args, self.functions, self.plain_values(f), at.ctx)

    def plain_values(self, user: object = None) -> dict[str, Any]:
        """Variables that workers or the shell can have; answers of queries only if the code of a user's function or transform may read them."""
        code = repr((user, self.functions)) if user is not None else None
        known = {k: v for k, v in self.scopes.flat().items() if not isinstance(v, Answer) or code is None or repr(k) in code}
        known = {k: v.values if isinstance(v, Answer) else v for k, v in known.items()}
        return {k: v for k, v in known.items() if isinstance(v, (str, int, float, bool, list, dict, tuple, type(None)))}

    def evaluate(self, expression: str) -> Any:
        return self.param(parse_expression(expression))

    def columns(self, given: list[Columns]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for c in given:
            names = self.variable(c.variable) if c.variable else [self.name(n) for n in c.names]
            out.setdefault(c.level, []).extend(py_text(n) for n in names or [])
        return out

    def given(self, call: Invocation) -> dict[str, Any]:
        return {k: self.param(v) for k, v in call.params}

    # -- scopes of FROM
    def read(self, scope: Scope, name: str = "") -> Stream:
        own = []
        if scope.wildcard:
            prefix, part = scope.streams[0]
            names = self.family(self.name(prefix))
            if not names:
                raise ScriptError(f"no stream begins with {prefix}")
            pairs = [(n, part) for n in names]
        else:
            pairs = [(self.name(n), p) for n, p in scope.streams]
        for n, part in pairs:
            s = self.stream(n)
            own.append(s if part is None else relational.pruned(s, self.loose(part)))
        if scope.how is None:
            return own[0]
        if scope.how in ("cat", "and", "xor"):
            return own[0] if len(own) == 1 else relational.union(scope.how, own, name)
        return relational.join(scope.how, own, name)

    # -- scripts
    def execute(self, script: str) -> Engine:
        body = parse(script)
        for s in body:  # options hold before anything runs
            if s.kind == "options":
                self.do_options(s)
        self.run(body)
        return self

    def run(self, body: list[Statement]) -> None:
        for s in body:
            try:
                getattr(self, f"do_{s.kind}")(s)
            except ScriptError as e:
                if "line" in str(e) or not s.line:
                    raise
                raise ScriptError(f"line {s.line}: {e}") from e

    def do_options(self, s: Statement) -> None:
        for k, e in s.params:
            if k not in self.options:
                raise ScriptError(f"unknown option {k}")
            v = self.param(e)
            self.options[k] = py_truth(v) if isinstance(DEFAULTS[k], bool) else int(v) if isinstance(DEFAULTS[k], int) else py_text(v)

    def do_create(self, s: Statement) -> None:
        name, path = self.name(s.name), self.path(s.path)
        verb = INPUTS.get(s.call.verb.lower())
        if verb is None:
            raise ScriptError(f"unknown source {s.call.verb}")
        parts = int(self.loose(s.parts)) if s.parts is not None else None
        if parts is not None and parts < 1:
            raise ScriptError("PARTITION needs a positive number")
        params = {**verb.configured(self.given(s.call)), "__parts": parts, "__by": s.by}
        columns = self.columns(s.columns)
        found = {f"{name}/{k}": p for k, p in sorted(adapters.subfolders(self.spark, path).items())} if s.star else {name: path}
        for n, p in found.items():
            if n in self.streams:
                raise ScriptError(f"stream {n} exists already")
            df, kind, names = verb.run(self.spark, p, params, next(iter(columns.values()), []))
            if parts is not None:
                df = df.repartition(parts)
            out = Stream(n, adapters.keyed(df, s.by), kind, {"value": names} if kind != "text" else {}, (("CREATED", p),))
            self.streams[n] = out

    def do_alter(self, s: Statement) -> None:
        scope: Scope = s.scope
        wild = scope.wildcard and scope.how is None
        prefix = self.name(scope.streams[0][0])
        sources = self.family(prefix) if wild else [None]
        for source in sources:
            one = Scope(None, ((source, scope.streams[0][1]),)) if wild else scope
            if wild:
                target = source if s.into is None else self.name(s.into) + source[len(prefix) :]
            elif s.into is not None:
                target = self.name(s.into)
            elif scope.how is not None:
                raise ScriptError("ALTER of a join or union needs INTO")
            else:
                target = prefix
            if s.into is None and (target == "dual" or target.startswith("_metrics")):
                raise ScriptError(f"{target} can't be altered")
            out, keyed = self.read(one, target), False
            for item in s.items:
                if item[0] == "key":
                    v = self.compiler(RecordContext(out)).value(item[1])
                    key = F.to_json(v.c) if v.t == "rec" else F.try_variant_get(v.c, "$", "string") if v.t == "var" else v.c
                    if v.t == "var":
                        key = F.coalesce(F.try_variant_get(v.c, "$", "long").cast("string"), key)
                    out, keyed = relational.rekeyed(out, key, item[1].source).made("ALTERED", f"KEY {item[1].source}"), True
                elif item[0] == "partition":
                    n = int(self.loose(item[1])) if item[1] is not None else None
                    out = relational.repartitioned(out, n, keyed).made("ALTERED", "PARTITION")
                else:
                    out = self.apply(out, item[1], self.columns(item[2]))
            self.put(out, target, replace=s.into is None)

    def apply(self, s: Stream, call: Invocation, columns: dict[str, list[str]]) -> Stream:
        user = self.transforms.get(call.verb.upper())
        if user is not None:
            if s.kind not in user.types and "any" not in user.types:
                raise ScriptError(f"{call.verb} doesn't take {s.kind}")
            given = self.given(call)
            params = {p.name: given.get(p.name, self.param(p.default) if p.default is not None else None) for p in user.params}
            return transformed(user, s, params, columns, self.functions, self.plain_values(user), int(self.options["loop_iteration_limit"]))
        verb = TRANSFORMS.get(call.verb.lower())
        if verb is None:
            raise ScriptError(f"unknown transform {call.verb}")
        if s.kind not in verb.accepts[""]:
            raise ScriptError(f"{verb.name} doesn't take {s.kind}")
        return verb.run(s, verb.configured(self.given(call)), columns)

    def do_copy(self, s: Statement) -> None:
        verb = OUTPUTS.get(s.call.verb.lower())
        if verb is None:
            raise ScriptError(f"unknown sink {s.call.verb}")
        params, path = verb.configured(self.given(s.call)), self.path(s.path)
        columns = self.columns(s.columns)
        for scope in s.scopes:
            if scope.wildcard and scope.how is None:
                prefix, part = scope.streams[0]
                own = [self.read(Scope(None, ((n, part),))) for n in self.family(self.name(prefix))]
                if not own:
                    raise ScriptError(f"no stream begins with {prefix}")
            else:
                own = [self.read(scope, "copied")]
            for x in own:
                if x.kind not in verb.accepts[""]:
                    raise ScriptError(f"{verb.name} doesn't write {x.kind}")
                table = verb.name.lower().startswith("jdbc")
                verb.run(x, path if table else f"{path.rstrip('/')}/{x.name}", params, next(iter(columns.values()), []))

    # -- select
    def do_select(self, s: Statement) -> None:
        for scope, (into, star) in zip(s.scopes, s.targets, strict=True):
            into = self.name(into)
            if scope.wildcard and scope.how is None:
                if not star:
                    raise ScriptError("FROM with * needs INTO with *")
                prefix, part = scope.streams[0]
                prefix = self.name(prefix)
                for n in self.family(prefix):
                    self.put(self.selected(s, self.read(Scope(None, ((n, part),))), into + n[len(prefix) :]), into + n[len(prefix) :])
            else:
                if into in self.streams:
                    raise ScriptError(f"stream {into} exists already")
                self.put(self.selected(s, self.read(scope, into), into), into)

    def selected(self, s: Statement, source: Stream, name: str) -> Stream:
        out = source
        if out.kind == "track":
            out = self.select_track(s, out)
        else:
            c = self.compiler(RecordContext(out))
            df = out.df
            if s.where is not None and s.level in (None, out.level, "value"):
                df = df.filter(c.condition(s.where))
            elif s.where is not None:
                df = df.filter(F.lit(False))
            if s.items is not None:
                df, names = self.projected(df, out, c, [i for i in s.items if i.level in (None, out.level, "value")])
                kind = "columnar" if out.kind in ("text", "structured") else out.kind
                out = out.but(df=df, kind=kind, attrs={**({} if kind == "columnar" else out.attrs), ("value" if kind == "columnar" else out.level): names})
            else:
                out = out.but(df=df)
        if s.distinct:
            out = relational.distinct(out)
        if s.limit is not None:
            e, percent = s.limit
            out = out.but(df=relational.sampled(out.df, float(self.loose(e)), percent, bool(self.options["exact_limit"])))
        return out.made("FILTERED" if s.where is not None else "AUGMENTED" if s.items is not None else "PASSEDTHRU", source.name, name=name)

    def projected(self, df: DataFrame, source: Stream, c: Compiler, items: list) -> tuple[DataFrame, list[str]]:
        keep = [F.col(x) for x in (KEY, PART, GEO) if x in source.df.columns]
        names, own = [], []
        for i in items:
            alias = self.name(i.alias) if i.alias else self.name(i.expr.value) if i.expr.kind == "attr" else i.expr.source
            if i.expr.kind == "call" and i.expr.value.upper() in ("REC_ATTRS", "ATTRS") and i.expr.value.upper() == "REC_ATTRS":
                wide = c.ctx.names
                own += [F.lit(n).alias(f"{alias}{j}") for j, n in enumerate(wide)]
                names += [f"{alias}{j}" for j in range(len(wide))]
                continue
            if i.expr.kind == "var" and isinstance(self.variable(i.expr.value), list):
                wide = self.variable(i.expr.value)
                own += [F.lit(None if x is None else py_text(x)).cast("string").alias(f"{alias}{j}") for j, x in enumerate(wide)]
                names += [f"{alias}{j}" for j in range(len(wide))]
                continue
            v = c.value(i.expr)
            own.append((v.c.cast("string") if v.t == "null" else text(v) if v.t == "var" else v.c).alias(alias))
            names.append(alias)
        return df.select(*keep, *own), names

    def select_track(self, s: Statement, out: Stream) -> Stream:
        """Filters drop tracks, segments or points by level; segments and tracks left empty go, too."""
        segments = F.col(GEO)["segments"]
        level = s.level or "track"
        df = out.df
        if s.where is not None:
            if level in ("track", "value"):
                df = df.filter(self.compiler(RecordContext(out)).condition(s.where))
            else:
                passes = lambda names: lambda x: F.coalesce(truth(self.compiler(StructContext(out, x, names)).value(s.where)), F.lit(False))
                if level == "segment":
                    segments = F.filter(segments, passes(out.attrs.get("segment", [])))
                else:
                    inner = passes(out.attrs.get("point", []))
                    segments = F.filter(F.transform(segments, lambda g: F.struct(g["props"].alias("props"), F.filter(g["points"], inner).alias("points"))), lambda g: F.size(g["points"]) > 0)
                df = df.withColumn(GEO, F.struct(segments.alias("segments"))).filter(F.size(F.col(GEO)["segments"]) > 0)
        attrs = dict(out.attrs)
        if s.items is not None:
            by: dict[str, list] = {}
            for i in s.items:
                by.setdefault(i.level or "track", []).append(i)

            def rewritten(own: list, names: list[str]) -> tuple[Any, list[str]]:
                aliases = [self.name(i.alias) if i.alias else self.name(i.expr.value) if i.expr.kind == "attr" else i.expr.source for i in own]
                return (lambda x: F.map_from_arrays(F.array(*[F.lit(a) for a in aliases]), F.array(*[text(self.compiler(StructContext(out, x, names)).value(i.expr)) for i in own]))), aliases

            keep = lambda x: x["props"]
            seg, pnt = keep, keep
            if "segment" in by:
                seg, attrs["segment"] = rewritten(by["segment"], out.attrs.get("segment", []))
            if "point" in by:
                pnt, attrs["point"] = rewritten(by["point"], out.attrs.get("point", []))
            segments = F.transform(F.col(GEO)["segments"], lambda g: F.struct(seg(g).alias("props"), F.transform(g["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), pnt(p).alias("props"))).alias("points")))
            df = df.withColumn(GEO, F.struct(segments.alias("segments")))
            top = by.get("track", []) + by.get("value", [])
            if top:
                df, attrs["track"] = self.projected(df, out, self.compiler(RecordContext(out)), top)
        return out.but(df=df, attrs=attrs)

    # -- variables and flow
    def do_let(self, s: Statement) -> None:
        value = self.param(s.expr)
        if s.name and s.name not in ("CWD", "NOTFOUND") and not s.name.startswith("ENV:"):
            self.scopes.set(s.name, value)

    def do_let_query(self, s: Statement) -> None:
        """The values of one expression as an array. Filters join with it; it is brought to the driver where a script reads it, or samples it."""
        source = self.read(s.scope, "query")
        c = self.compiler(RecordContext(source))
        df = source.df
        if s.where is not None:
            df = df.filter(c.condition(s.where))
        v = c.value(s.item.expr)
        df = df.select((text(v) if v.t == "var" else v.c.cast("string") if v.t == "null" else v.c).alias("v"))
        if s.distinct:
            df = df.dropDuplicates()
        if s.limit is not None:
            df = relational.sampled(df, float(self.loose(s.limit[0])), s.limit[1], bool(self.options["exact_limit"]))
        got = Answer(df, "str" if v.t in ("var", "null") else v.t)
        self.scopes.set(s.name, got if s.limit is None else got.values)

    def do_loop(self, s: Statement) -> None:
        over = self.loose(s.over)
        values = list(over) if isinstance(over, (list, tuple)) else [] if over is None else [over]
        if len(values) > int(self.options["loop_iteration_limit"]):
            raise ScriptError(f"LOOP over {len(values)} values; the limit is {self.options['loop_iteration_limit']}")
        if self.depth >= int(self.options["loop_nesting_limit"]):
            raise ScriptError(f"LOOPs are nested deeper than {self.options['loop_nesting_limit']}")
        self.depth += 1
        self.scopes.levels.append({})
        try:
            for x in values:
                self.scopes.set(s.name, x, here=True)
                self.run(s.body)
            if not values and s.other:
                self.run(s.other)
        finally:
            self.scopes.levels.pop()
            self.depth -= 1

    def do_if(self, s: Statement) -> None:
        test = self.loose(s.test)
        self.run(s.body if test is not None and py_truth(test) else s.other)

    def do_raise(self, s: Statement) -> None:
        message = py_text(self.param(s.expr))
        if s.level == "ERROR":
            raise ScriptError(message)
        print(message, file=sys.stderr if s.level.startswith("WARN") else sys.stdout)

    # -- definitions
    def do_procedure(self, s: Statement) -> None:
        self.define(self.procedures, s, s)

    def do_function(self, s: Statement) -> None:
        self.define(self.functions, s, UserFunction(s.name, tuple(s.params), tuple(s.body), s.record, tuple(s.names)))

    def do_transform(self, s: Statement) -> None:
        self.define(self.transforms, s, UserTransform(s.name, tuple(s.params), tuple(s.types), s.into, self.columns(s.columns), tuple(s.body)))

    def define(self, table: dict, s: Statement, what: Any) -> None:
        if s.name.upper() in table and not s.replace:
            raise ScriptError(f"{s.name} is defined already")
        table[s.name.upper()] = what

    def do_drop(self, s: Statement) -> None:
        table = {"procedure": self.procedures, "function": self.functions, "transform": self.transforms}[s.what]
        for n in s.names:
            table.pop(n.upper(), None)

    # -- operations
    def do_call(self, s: Statement) -> None:
        call: Invocation = s.call
        if not s.inputs and not s.outputs:
            return self.call_procedure(call)
        verb = OPERATIONS.get(call.verb.lower())
        if verb is None:
            one = TRANSFORMS.get(call.verb.lower())
            if one is None:
                raise ScriptError(f"unknown operation {call.verb}")
        params = (verb or one).configured(self.given(call))
        wild = [x for _, x in s.inputs if x.wildcard and x.how is None]
        if wild:
            prefix = self.name(wild[0].streams[0][0])
            target = self.name(s.outputs[0][1])
            for n in self.family(prefix):
                self.put(self.operated(verb or one, {"": self.stream(n)}, params)[""], target + n[len(prefix) :])
            return None
        inputs = {alias: self.read(scope, alias or "input") for alias, scope in s.inputs}
        named = set((verb or one).accepts) - {""}
        if not named:
            own = [self.read(scope, "input") for _, scope in s.inputs]
            if len(own) != len(s.outputs):
                raise ScriptError(f"{call.verb} needs an OUTPUT for each INPUT")
            for x, (_, name, _) in zip(own, s.outputs, strict=True):
                self.put(self.operated(verb or one, {"": x}, params)[""], self.name(name))
            return None
        if None in inputs:
            raise ScriptError(f"{call.verb} has named inputs: {', '.join(sorted(named))}")
        for n in named - set(verb.optional):
            if n not in inputs:
                raise ScriptError(f"{call.verb} needs INPUT {n}")
        results = self.operated(verb, inputs, params)
        for alias, name, _ in s.outputs:
            key = alias if alias in results else "" if "" in results else alias or verb.outputs[0]
            if key not in results:
                raise ScriptError(f"{call.verb} has no OUTPUT {alias}")
            self.put(results[key], self.name(name))
        return None

    def operated(self, verb: Any, inputs: dict[str, Stream], params: dict[str, Any]) -> dict[str, Stream]:
        for alias, x in inputs.items():
            allowed = verb.accepts.get(alias)
            if allowed is None:
                raise ScriptError(f"{verb.name} has no INPUT {alias}")
            if x.kind not in allowed:
                raise ScriptError(f"{verb.name} doesn't take {x.kind}" + (f" as {alias}" if alias else ""))
        if verb.name.lower() in OPERATIONS:
            return verb.run(inputs, params)
        return {"": verb.run(inputs[""], params, {})}

    def call_procedure(self, call: Invocation) -> None:
        p = self.procedures.get(call.verb.upper())
        if p is None:
            raise ScriptError(f"unknown procedure {call.verb}")
        given = self.given(call)
        self.scopes.levels.append({})
        try:
            for x in p.params:
                if x.name not in given and x.default is None:
                    raise ScriptError(f"{call.verb} needs @{x.name}")
                self.scopes.set(x.name, given[x.name] if x.name in given else self.param(x.default), here=True)
            self.run(p.body)
        finally:
            self.scopes.levels.pop()

    def do_analyze(self, s: Statement) -> None:
        names = self.family(self.name(s.name)) if s.star else [self.name(s.name)]
        for n in names:
            x = self.stream(n)
            v = self.compiler(RecordContext(x)).value(s.key) if s.key is not None else V(F.col(KEY), type_name(x.df.schema[KEY].dataType))
            key = text(v) if v.t in ("var", "rec", "arr") else v.c
            label = s.key.source if s.key is not None else x.keyed or "_key"
            self.metrics.append(relational.analyzed(x, key, label, False))
            if s.deep:
                deep = relational.analyzed(x, key, label, True)
                self.streams.pop(f"_metrics_{n}", None)
                self.register(f"_metrics_{n}", deep, key="_name")
        own = self.metrics[0]
        for m in self.metrics[1:]:
            own = own.unionByName(m)
        self.streams.pop("_metrics", None)
        self.register("_metrics", own, key="_name")

    # -- what the shell shows
    def lineage(self, name: str) -> list[tuple[str, str]]:
        return list(self.streams[name].lineage)

    def describe(self, name: str) -> dict[str, Any]:
        s = self.streams[name]
        return {"name": name, "type": s.kind, "attributes": {k: list(v) for k, v in s.attrs.items()}, "key": s.keyed, "lineage": self.lineage(name)}
