"""Expression operators: priority, null rules, and two forms of each, a Column builder and a plain Python function."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class V:
    """A compiled value: its Column and what is known of its type (str int long double bool arr var rec null)."""

    c: Column
    t: str


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "str"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(t, T.LongType):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "arr"
    if isinstance(t, T.VariantType):
        return "var"
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "ts"
    return "rec"


NUMERIC = ("int", "long", "double")


# -- coercions of Columns
def double(v: V) -> Column:
    if v.t in NUMERIC:
        return v.c.cast("double")
    if v.t == "str":
        return v.c.try_cast("double")
    if v.t == "var":
        return F.try_variant_get(v.c, "$", "double")
    if v.t == "ts":
        return F.unix_micros(v.c.cast("timestamp")) / 1e6
    return F.lit(None).cast("double")


def long(v: V) -> Column:
    return v.c.cast("long") if v.t in ("int", "long") else double(v).cast("long")


def text(v: V) -> Column:
    return F.try_variant_get(v.c, "$", "string") if v.t == "var" else F.array_join(v.c.cast("array<string>"), ",") if v.t == "arr" else v.c.cast("string")


def truth(v: V) -> Column:
    return v.c if v.t == "bool" else F.lit(None).cast("boolean") if v.t == "null" else F.lower(text(v)) == "true"


def array(v: V) -> Column:
    if v.t == "arr":
        return v.c
    if v.t == "var":
        return F.coalesce(F.try_variant_get(v.c, "$", "array<string>"), F.array(F.try_variant_get(v.c, "$", "string")))
    return F.array(v.c)


def promoted(a: V, b: V) -> tuple[Column, Column, str]:
    t = "int" if a.t == b.t == "int" else "long" if {a.t, b.t} <= {"int", "long"} else "double"
    if t == "double":
        return double(a), double(b), t
    return a.c, b.c, t


# -- coercions of Python values
def py_number(x: object) -> int | float | None:
    from ..lang.lexer import number

    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return x
    return number(x) if isinstance(x, str) else None


def py_text(x: object) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (list, tuple)):
        return ",".join(map(py_text, x))
    return str(x)


def py_truth(x: object) -> bool:
    return x if isinstance(x, bool) else py_text(x).lower() == "true"


def wrapped(n: int, bits: int) -> int:
    return (n + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def _py_sum(f: Callable) -> Callable:
    def run(a: object, b: object) -> object:
        x, y = py_number(a), py_number(b)
        if x is None or y is None:
            return None
        if isinstance(x, int) and isinstance(y, int):
            small = -(2**31) <= x < 2**31 and -(2**31) <= y < 2**31
            return wrapped(f(x, y), 32 if small else 64)
        return f(float(x), float(y))

    return run


def _py_long(f: Callable) -> Callable:
    def run(*args: object) -> object:
        own = [py_number(a) for a in args]
        return None if None in own else wrapped(f(*(int(x) for x in own)), 64)

    return run


def _py_compare(f: Callable) -> Callable:
    def run(a: object, b: object) -> object:
        x, y = py_number(a), py_number(b)
        return None if x is None or y is None else f(x, y) if isinstance(x, int) and isinstance(y, int) else f(float(x), float(y))

    return run


def py_equal(a: object, b: object) -> bool:
    if isinstance(a, bool):
        return isinstance(b, (bool, str)) and a == py_truth(b)
    if isinstance(a, (int, float)):
        y = py_number(b)
        return y is not None and (a == y if isinstance(a, int) and isinstance(y, int) else float(a) == float(y))
    if isinstance(a, (list, tuple)):
        return isinstance(b, (list, tuple)) and len(a) == len(b) and all(py_equal(x, y) for x, y in zip(a, b, strict=True))
    return type(a) is type(b) and a == b


def ordered(f: Callable) -> Callable:
    """A comparison of numbers: of integers as such, of others as doubles."""

    def run(a: V, b: V) -> Column:
        x, y, _ = promoted(a, b)
        return f(x, y)

    return run


def equal(a: V, b: V) -> Column:
    """Directed by the left type: numbers compare with what parses as one (integers with integers as such), else types must agree. Null if unknown."""
    if a.t in ("int", "long") and b.t == "str":
        return F.coalesce(a.c == b.c.try_cast("long"), double(a) == double(b))
    if a.t in NUMERIC:
        return ordered(lambda x, y: x == y)(a, b)
    if a.t == "bool":
        return a.c == truth(b) if b.t in ("bool", "str", "var") else F.lit(False)
    if a.t == "arr":
        return a.c.cast("array<string>") == array(b).cast("array<string>") if b.t == "arr" else F.lit(False)
    if a.t == "var":
        return F.coalesce(double(a) == double(b) if b.t in NUMERIC else text(a) == text(b), F.lit(False))
    if a.t == "ts":
        return a.c == b.c.try_cast("timestamp") if b.t in ("ts", "str") else F.lit(False)
    return a.c == text(b) if b.t in ("str", "var") and a.t == "str" else a.c == b.c if a.t == b.t else F.lit(False)


def java_pattern(text: str) -> str:
    """A full match, multi-line; /re/flags form: i ignores case, and without s a dot takes line ends."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", text, re.DOTALL)
    if not m:
        return rf"(?m)\A(?:{text})\z"
    return rf"(?m{'i' if 'i' in m[2] else ''}{'' if 's' in m[2] else 's'})\A(?:{m[1]})\z"


def py_like(a: object, b: object) -> bool:
    return re.search(java_pattern(py_text(b)).replace(r"\z", r"\Z"), py_text(a)) is not None


def _like(a: V, b: V) -> Column:
    full = F.regexp_replace(F.regexp_replace(text(b), r"\A(?!/.*/[a-z]*\z)([\s\S]*)\z", r"(?m)\\A(?:$1)\\z"), r"\A/([\s\S]*)/[a-z]*\z", r"(?ms)\\A(?:$1)\\z")
    return F.call_function("rlike", text(a), full)


_DIGESTS = {"md5": "md5", "sha1": "sha1", "sha": "sha1", "sha224": "sha224", "sha256": "sha256", "sha384": "sha384", "sha512": "sha512", "sha3256": "sha3_256", "sha3384": "sha3_384", "sha3512": "sha3_512", "sha3224": "sha3_224"}


def digest_name(algorithm: str) -> str:
    """The hash behind `[provider ]name`."""
    key = algorithm.split()[-1].lower().replace("-", "").replace("_", "")
    if key not in _DIGESTS:
        raise ValueError(f"unknown digest {algorithm}")
    return _DIGESTS[key]


def digest(v: Column, algorithm: str) -> Column:
    name = digest_name(algorithm)
    if name == "md5":
        return F.md5(v.cast("binary"))
    if name == "sha1":
        return F.sha1(v.cast("binary"))
    if name.startswith("sha3_"):
        return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else hashlib.new(name, x.encode()).hexdigest()), "string")(v)
    return F.sha2(v.cast("binary"), int(name[3:]))


def py_hashcode(x: object) -> int:
    """Hash codes as Java has them for strings, numbers and booleans."""
    if x is None:
        return 0
    if isinstance(x, bool):
        return 1231 if x else 1237
    if isinstance(x, int):
        return x if -(2**31) <= x < 2**31 else wrapped((x ^ (x >> 32)) & 0xFFFFFFFF, 32)
    if isinstance(x, float):
        import struct

        bits = struct.unpack(">q", struct.pack(">d", x))[0]
        return wrapped((bits ^ (bits >> 32)) & 0xFFFFFFFF, 32)
    if isinstance(x, (list, tuple)):
        h = 1
        for y in x:
            h = h * 31 + py_hashcode(y)
        return wrapped(h, 32)
    units = py_text(x).encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + (units[i] << 8 | units[i + 1])) & 0xFFFFFFFF
    return wrapped(h, 32)


def hashcode(v: V) -> Column:
    if v.t == "int":
        return F.coalesce(v.c, F.lit(0))
    if v.t == "bool":
        return F.when(v.c, 1231).when(~v.c, 1237).otherwise(0)
    if v.t == "long":
        return F.coalesce(F.when(v.c == v.c.cast("int"), v.c.cast("int")).otherwise(v.c.bitwiseXOR(F.shiftrightunsigned(v.c, 32)).cast("int")), F.lit(0))
    step = lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF))
    def one(h: Column, ch: Column) -> Column:
        p = F.ascii(ch).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(p > 0xFFFF, step(step(h, high), low)).otherwise(step(h, p))

    h = F.aggregate(F.filter(F.split(text(v), ""), lambda x: x != ""), F.lit(0).cast("long"), one)
    return F.coalesce(h.cast("int"), F.lit(0))


def py_divide(a: object, b: object) -> float | None:
    x, y = py_number(a), py_number(b)
    if x is None or y is None:
        return None
    x, y = float(x), float(y)
    if y == 0:
        return math.nan if x == 0 or math.isnan(x) else math.copysign(math.inf, x)
    return x / y


def py_remainder(a: object, b: object) -> float | None:
    x, y = py_number(a), py_number(b)
    if x is None or y is None:
        return None
    return math.nan if y == 0 or math.isinf(x) else math.fmod(x, y)


def _divide(a: V, b: V) -> V:
    x, y = double(a), double(b)
    return V(F.when(y == 0, F.when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf)).when(x.isNull(), F.lit(None)).otherwise(F.lit(math.nan))).otherwise(x / y), "double")


def _remainder(a: V, b: V) -> V:
    x, y = double(a), double(b)
    return V(F.when((y == 0) & x.isNotNull(), F.lit(math.nan)).otherwise(x % y), "double")


def py_power(a: object, b: object) -> float | None:
    x, y = py_number(a), py_number(b)
    if x is None or y is None:
        return None
    try:
        return math.pow(x, y)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


def py_in(a: object, b: object) -> bool:
    own = list(b) if isinstance(b, (list, tuple)) else [] if b is None else [b]
    return a is not None and any(py_equal(a, x) and isinstance(a, (int, float)) == isinstance(x, (int, float)) for x in own)


def contains(a: V, b: V) -> Column:
    """Membership; false if either is null."""
    if b.t == "null" or a.t == "null":
        return F.lit(False)
    own = array(b)
    if a.t in ("int", "long"):
        exact = "decimal(38,18)"
        return F.coalesce(F.array_contains(F.transform(own, lambda x: x.try_cast(exact)), a.c.cast(exact)), F.lit(False))
    if a.t in NUMERIC:
        own = F.transform(own, lambda x: x.try_cast("double"))
        return F.coalesce(F.array_contains(own, double(a)), F.lit(False))
    return F.coalesce(F.array_contains(own.cast("array<string>"), text(a)), F.lit(False))


@dataclass(frozen=True)
class Op:
    name: str
    priority: int
    col: Callable[..., V]
    py: Callable
    prefix: bool = False
    right: bool = False
    sees_null: bool = False


OPERATORS: dict[tuple[str, int], Op] = {}
PRIORITY: dict[str, int] = {"IS": 35, "BETWEEN": 35}
PREFIX: set[str] = set()
RIGHT: set[str] = set()
LEVELS: frozenset[str] = frozenset()


def operator(names: str, priority: int, col: Callable, py: Callable, *, prefix: bool = False, right: bool = False, sees_null: bool = False) -> None:
    for n in names.split():
        OPERATORS[n, 1 if prefix else 2] = Op(n, priority, col, py, prefix, right, sees_null)
        PRIORITY[n] = priority
        if prefix:
            PREFIX.add(n)
        if right:
            RIGHT.add(n)


def _typed(f: Callable, t: str) -> Callable:
    return lambda *args: V(f(*args), t)


def _either(a: V, b: V, f: Callable) -> Column:
    x, y = truth(a), truth(b)
    no = F.lit(False)
    return F.when(x.isNotNull() | y.isNotNull(), f(F.coalesce(x, no), F.coalesce(y, no)))


def _common(a: V, b: V) -> str:
    return b.t if a.t == "null" else a.t if b.t in (a.t, "null") else "double" if a.t in NUMERIC and b.t in NUMERIC else "str"


def as_type(v: V, t: str) -> Column:
    return v.c if v.t == t else double(v) if t == "double" else text(v) if t == "str" else v.c


def _default(a: V, b: V) -> V:
    t = _common(a, b)
    return V(F.coalesce(as_type(a, t), as_type(b, t)), t)


def _both_bool(f: Callable) -> Callable:
    return lambda a, b: f(py_truth(a), py_truth(b))


operator(": DEFAULT", 0, _default, lambda a, b: b if a is None else a, right=True, sees_null=True)
operator("?", 5, lambda a, b: V(F.when(truth(a), b.c), b.t), lambda a, b: b if py_truth(a) else None)
operator("OR", 10, lambda a, b: V(_either(a, b, lambda x, y: x | y), "bool"), lambda a, b: None if a is None and b is None else (a is not None and py_truth(a)) or (b is not None and py_truth(b)), sees_null=True)
operator("XOR", 10, lambda a, b: V(_either(a, b, lambda x, y: x != y), "bool"), lambda a, b: None if a is None and b is None else (a is not None and py_truth(a)) != (b is not None and py_truth(b)), sees_null=True)
operator("AND", 20, lambda a, b: V(F.when(truth(a).isNotNull() & truth(b).isNotNull(), truth(a) & truth(b)), "bool"), _both_bool(lambda x, y: x and y))
operator("NOT", 30, lambda a: V(~truth(a), "bool"), lambda a: not py_truth(a), prefix=True, right=True)
operator("IN", 35, _typed(contains, "bool"), py_in, sees_null=True)
operator("=", 40, lambda a, b: V(F.coalesce(equal(a, b), F.lit(False)), "bool"), lambda a, b: a is not None and b is not None and py_equal(a, b), sees_null=True)
operator("==", 40, lambda a, b: V(F.when(a.c.isNotNull() & b.c.isNotNull(), F.coalesce(equal(a, b), F.lit(False))), "bool"), py_equal)
operator("!=", 40, lambda a, b: V(F.coalesce(a.c.isNotNull() & b.c.isNotNull() & ~F.coalesce(equal(a, b), F.lit(False)), F.lit(False)), "bool"), lambda a, b: a is not None and b is not None and not py_equal(a, b), sees_null=True)
operator("<>", 40, lambda a, b: V(F.when(a.c.isNotNull() & b.c.isNotNull(), ~F.coalesce(equal(a, b), F.lit(False))), "bool"), lambda a, b: not py_equal(a, b))
operator(">", 40, _typed(ordered(lambda x, y: x > y), "bool"), _py_compare(lambda x, y: x > y))
operator(">=", 40, _typed(ordered(lambda x, y: x >= y), "bool"), _py_compare(lambda x, y: x >= y))
operator("<", 40, _typed(ordered(lambda x, y: x < y), "bool"), _py_compare(lambda x, y: x < y))
operator("<=", 40, _typed(ordered(lambda x, y: x <= y), "bool"), _py_compare(lambda x, y: x <= y))
operator("LIKE MATCH REGEX REGEXP", 40, _typed(_like, "bool"), py_like)
operator("DIGEST HASH", 40, lambda a, b: V(digest(text(a), "md5"), "str"), lambda a, b: hashlib.new(digest_name(py_text(b)), py_text(a).encode()).hexdigest())
operator("|", 105, lambda a, b: V(long(a).bitwiseOR(long(b)), "long"), _py_long(lambda x, y: x | y))
operator("#", 110, lambda a, b: V(long(a).bitwiseXOR(long(b)), "long"), _py_long(lambda x, y: x ^ y))
operator("&", 115, lambda a, b: V(long(a).bitwiseAND(long(b)), "long"), _py_long(lambda x, y: x & y))
operator("<<", 120, lambda a, b: V(F.call_function("shiftleft", long(a), long(b).cast("int")), "long"), _py_long(lambda x, y: x << (y & 63)))
operator(">>", 120, lambda a, b: V(F.call_function("shiftright", long(a), long(b).cast("int")), "long"), _py_long(lambda x, y: x >> (y & 63)))


def _arithmetic(f: Callable) -> Callable:
    def run(a: V, b: V) -> V:
        x, y, t = promoted(a, b)
        return V(f(x, y), t)

    return run


operator("+", 125, _arithmetic(lambda x, y: x + y), _py_sum(lambda x, y: x + y))
operator("-", 125, _arithmetic(lambda x, y: x - y), _py_sum(lambda x, y: x - y))
operator("||", 125, lambda a, b: V(F.concat(text(a), text(b)), "str"), lambda a, b: py_text(a) + py_text(b))
operator("*", 130, _arithmetic(lambda x, y: x * y), _py_sum(lambda x, y: x * y))
operator("/", 130, _divide, py_divide)
operator("%", 130, _remainder, py_remainder)
operator("^", 135, lambda a, b: V(F.pow(double(a), double(b)), "double"), py_power, right=True)
operator("~", 140, lambda a: V(F.bitwise_not(long(a)), "long"), _py_long(lambda x: ~x), prefix=True, right=True)
operator("HASHCODE", 145, lambda a: V(hashcode(a), "int"), py_hashcode, prefix=True, right=True, sees_null=True)


def py_random(a: object) -> int | None:
    n = py_number(a)
    if n is None:
        return None
    n = int(n)
    return 0 if n == 0 else int(math.copysign(1, n)) * random.randrange(abs(n))


operator("RANDOM RAND", 145, lambda a: V(F.floor(F.rand() * F.abs(long(a))).cast("long") * F.signum(double(a)).cast("long"), "long"), py_random, prefix=True, right=True)
operator("BOOL BOOLEAN", 150, lambda a: V(F.when(a.c.isNotNull(), F.coalesce(truth(a), F.lit(False))), "bool"), py_truth, prefix=True, right=True)


def _py_cast(f: Callable) -> Callable:
    def run(a: object) -> object:
        x = py_number(a)
        return None if x is None else f(x)

    return run


operator("INT INTEGER", 150, lambda a: V(double(a).cast("int"), "int"), _py_cast(int), prefix=True, right=True)
operator("LONG", 150, lambda a: V(long(a), "long"), _py_cast(int), prefix=True, right=True)
operator("DOUBLE", 150, lambda a: V(double(a), "double"), _py_cast(float), prefix=True, right=True)
operator("STRING PLAINTEXT RAW PLAIN TEXT", 150, lambda a: V(text(a), "str"), py_text, prefix=True, right=True)


def _py_struct(a: object) -> object:
    import json

    return json.loads(a) if isinstance(a, str) else a


def _struct(a: V) -> V:
    return a if a.t == "var" else V(F.try_parse_json(a.c), "var") if a.t == "str" else V(F.to_variant_object(a.c), "var")


operator("STRUCT STRUCTURED JSON", 150, _struct, _py_struct, prefix=True, right=True)


def encoded(x: bytes) -> str:
    return base64.b64encode(x).decode()
