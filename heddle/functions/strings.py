"""String functions."""

from __future__ import annotations

import base64
import re

from pyspark.sql import functions as F

from ..operators.scalar import NUMERIC, V, long, py_text, text
from .registry import function


def _py_replacement(s: str) -> str:
    """Java's $1 as Python's group reference."""
    return re.sub(r"\$(\d)", r"\\\1", s.replace("\\", "\\\\"))


def _py_split(s: object, pattern: object, limit: object) -> list[str]:
    n = int(limit)
    if n == 1:
        return [py_text(s)]
    out = re.split(py_text(pattern), py_text(s), maxsplit=n - 1 if n > 0 else 0)
    if out and out[0] == "" and len(out) > 1 and re.match(py_text(pattern), py_text(s)) and re.match(py_text(pattern), py_text(s)).end() == 0:
        out = out[1:]
    if n == 0:
        while len(out) > 1 and out[-1] == "":
            out.pop()
    return out


def _split(s: V, pattern: V, limit: V) -> V:
    n = long(limit).cast("int")
    parts = F.split(text(s), text(pattern), n)
    # without a limit trailing empty strings go
    last = F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1))), F.lit(0))
    return V(F.when(n == 0, F.when(last == 0, F.slice(parts, 1, 1)).otherwise(F.slice(parts, 1, F.greatest(last, F.lit(1))))).otherwise(parts), "arr")


def _py_format(pattern: object, *args: object) -> str:
    return re.sub(r"%([-#+ 0,(]*)(\d*)(\.\d+)?n", "\n", py_text(pattern)) % tuple(args)


def _format(pattern: V, *args: V) -> V:
    return V(F.call_function("format_string", text(pattern), *[a.c if a.t in NUMERIC or a.t == "bool" else text(a) for a in args]), "str")


function("STR_REPLACE", 3, lambda s, p, r: V(F.regexp_replace(text(s), text(p), text(r)), "str"), lambda s, p, r: re.sub(py_text(p), _py_replacement(py_text(r)), py_text(s)))
function("STR_SLICE", 3, lambda s, a, b: V(F.substring(text(s), long(a).cast("int") + 1, (long(b) - long(a)).cast("int")), "str"), lambda s, a, b: py_text(s)[int(a) : int(b)])
function("STR_SPLIT", 3, _split, _py_split)
function("STR_LENGTH", 1, lambda s: V(F.length(text(s)), "int"), lambda s: len(py_text(s)))
function("STR_LOWER", 1, lambda s: V(F.lower(text(s)), "str"), lambda s: py_text(s).lower())
function("STR_UPPER", 1, lambda s: V(F.upper(text(s)), "str"), lambda s: py_text(s).upper())
function("STR_STARTS", 2, lambda s, x: V(F.startswith(text(s), text(x)), "bool"), lambda s, x: py_text(s).startswith(py_text(x)))
function("STR_ENDS", 2, lambda s, x: V(F.endswith(text(s), text(x)), "bool"), lambda s, x: py_text(s).endswith(py_text(x)))
function("STR_CONTAINS", 2, lambda s, x: V(F.contains(text(s), text(x)), "bool"), lambda s, x: py_text(x) in py_text(s))
function("STR_FORMAT", (1, None), _format, _py_format)
function("STR_DECODE64", 1, lambda s: V(F.unbase64(text(s)).cast("string"), "str"), lambda s: base64.b64decode(py_text(s)).decode())
function("STR_BASE64", 1, lambda s: V(F.translate(F.base64(text(s).cast("binary")), "\r\n", ""), "str"), lambda s: base64.b64encode(py_text(s).encode()).decode())
