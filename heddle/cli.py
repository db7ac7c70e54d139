"""Command line: run scripts, check them, an interactive shell, and JSON copy tasks."""

from __future__ import annotations

import argparse
import base64
import cmd
import json
import re
import sys
import threading
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .lang.lexer import ScriptError
from .lang.parser import parse
from .operators.registry import INPUTS, OPERATIONS, OUTPUTS, TRANSFORMS
from .stream import KEY, PART


def variables(text: str) -> dict[str, Any]:
    """name=value lines: numbers in brackets, quoted strings, lists of quoted strings, or plain text; # begins a comment."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        name, value = (x.strip() for x in line.split("=", 1))
        quoted = re.findall(r"'((?:[^']|'')*)'", value)
        if value.startswith("[") and value.endswith("]"):
            inside = value[1:-1].strip()
            if quoted:
                out[name] = [q.replace("''", "'") for q in quoted]
            else:
                out[name] = [float(x) if "." in x else int(x) for x in (y.strip() for y in inside.split(",")) if x]
        elif len(quoted) > 1:
            out[name] = [q.replace("''", "'") for q in quoted]
        elif quoted and value.startswith("'"):
            out[name] = quoted[0].replace("''", "'")
        else:
            out[name] = value or None
    return out


def run_tasks(engine: Engine, tasks: dict[str, list[dict[str, Any]]]) -> list[str]:
    """Copy tasks: {task: [{name, source: {adapter, path, params, columns}, transform: [{verb, params, columns}], dest: {...}}]}."""
    done = []
    for task, steps in tasks.items():
        for step in steps:
            shown = lambda p: ", ".join(f"@{k}={value(v)}" for k, v in (p or {}).items())
            columns = lambda c: " ".join(f"{level} ({', '.join(json.dumps(n) for n in names)})" for level, names in (c or {}).items())
            name = f'"{task}_{step["name"]}"'
            src, dst = step["source"], step["dest"]
            script = [f"CREATE {name} {src['adapter']}({shown(src.get('params'))}) {columns(src.get('columns'))} FROM {value(src['path'])};"]
            script += [f"ALTER {name} TRANSFORM {t['verb']}({shown(t.get('params'))}) {columns(t.get('columns'))};" for t in step.get("transform", [])]
            script.append(f"COPY {name} {dst['adapter']}({shown(dst.get('params'))}) {columns(dst.get('columns'))} INTO {value(dst['path'])};")
            engine.execute("\n".join(script))
            done.append(f"{task}_{step['name']}")
    return done


def value(v: Any) -> str:
    """A parameter as the script language writes it."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(value, v)) + "]"
    return "'" + str(v).replace("'", "''").replace("{", "\\{").replace("}", "\\}") + "'"


class Shell(cmd.Cmd):
    """Statements end with a semicolon; commands begin with a backslash."""

    prompt = "heddle> "

    def __init__(self, engine: Engine, out: Any = None):
        super().__init__(stdout=out or sys.stdout)
        self.engine, self.pending = engine, ""

    def say(self, *what: Any) -> None:
        print(*what, file=self.stdout)

    def emptyline(self) -> bool:
        return False

    def onecmd(self, line: str) -> bool:
        line = line.strip()
        if line in ("EOF", "\\quit", "\\q"):
            return True
        try:
            if line.startswith("\\"):
                self.command(line[1:])
            elif line:
                self.pending += line + "\n"
                if line.endswith(";"):
                    script, self.pending = self.pending, ""
                    self.engine.execute(script)
        except Exception as e:  # noqa: BLE001  a shell goes on after any failure
            self.say(f"{type(e).__name__}: {e}")
        return False

    def command(self, line: str) -> None:
        verb, _, rest = line.partition(" ")
        rest = rest.strip().rstrip(";")
        e = self.engine
        verb = verb.lower()
        if verb == "help":
            self.say("\\eval expr; \\print ds [n [partition]]; \\show ds|variables|options|procedures|functions|transforms|operations|inputs|outputs; \\describe ds; \\lineage ds; \\persist ds; \\renounce ds; \\script file; \\quit")
        elif verb == "eval":
            self.say(e.evaluate(rest))
        elif verb == "print":
            own = rest.split()
            s = e.streams[own[0]]
            df = s.df
            if len(own) > 2:
                df = df.filter((F.col(PART) if PART in df.columns else F.spark_partition_id()) == int(own[2]))
            for r in df.limit(int(own[1]) if len(own) > 1 else 5).collect():
                self.say(r[KEY], "=>", {k: v for k, v in r.asDict().items() if k not in (KEY, PART)})
        elif verb == "show":
            table = {"ds": e.streams, "variables": e.plain_values(), "options": e.options, "procedures": e.procedures, "functions": e.functions, "transforms": {**TRANSFORMS, **e.transforms}, "operations": OPERATIONS, "inputs": INPUTS, "outputs": OUTPUTS}
            for k, v in table[rest.lower() or "ds"].items():
                self.say(k if rest.lower() not in ("variables", "options") else f"{k} = {v}")
        elif verb == "describe":
            self.say(json.dumps(e.describe(rest), default=str))
        elif verb == "lineage":
            for origin, subject in e.lineage(rest):
                self.say(origin, subject)
        elif verb == "persist":
            e.streams[rest] = e.streams[rest].but(df=e.streams[rest].df.persist())
        elif verb == "renounce":
            e.renounce(rest)
        elif verb == "script":
            with open(rest, encoding="utf-8") as f:
                e.execute(f.read())
        else:
            self.say(f"unknown command {verb}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="heddle", description=__doc__)
    p.add_argument("script", nargs="*", help="script files, run as one")
    p.add_argument("-d", "--dry", action="store_true", help="only check the syntax")
    p.add_argument("-i", "--interactive", action="store_true", help="a shell, after the scripts")
    p.add_argument("-j", "--json", help="a file of copy tasks")
    p.add_argument("-v", "--variables", help="a file of name=value lines")
    p.add_argument("-V", "--variables-base64", help="the same, encoded")
    p.add_argument("-R", "--serve", metavar="HOST:PORT", help="answer over HTTP, after the scripts")
    p.add_argument("-l", "--local", nargs="?", const="*", help="run in this process on so many cores")
    a = p.parse_args(argv)
    text = "\n".join(open(f, encoding="utf-8").read() for f in a.script)
    try:
        parse(text)
    except ScriptError as e:
        print(e, file=sys.stderr)
        return 2
    if a.dry:
        return 0
    builder = SparkSession.builder.appName("heddle")
    if a.local:
        builder = builder.master(f"local[{a.local}]")
    given = variables(open(a.variables, encoding="utf-8").read()) if a.variables else {}
    if a.variables_base64:
        given |= variables(base64.b64decode(a.variables_base64).decode())
    engine = Engine(builder.getOrCreate(), given)
    try:
        engine.execute(text)
        if a.json:
            with open(a.json, encoding="utf-8") as f:
                run_tasks(engine, json.load(f))
    except ScriptError as e:
        print(e, file=sys.stderr)
        return 1
    if a.serve:
        from .server import serve

        host, _, port = a.serve.rpartition(":")
        server = serve(engine, host or "127.0.0.1", int(port))
        if not a.interactive:
            threading.Event().wait()
        Shell(engine).cmdloop()
        server.shutdown()
    elif a.interactive:
        Shell(engine).cmdloop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
