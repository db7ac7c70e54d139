"""Date-time functions. A moment is a number (below 1e11 seconds, else milliseconds, of the epoch), an ISO-8601 text or a timestamp."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.scalar import NUMERIC, V, double, py_number, py_text, text
from .registry import function

#: Below it a number counts seconds, from it on milliseconds.
SECONDS = 1e11


def _from_number(x: Column) -> Column:
    return F.timestamp_micros(F.when(F.abs(x) < SECONDS, x * 1_000_000).otherwise(x * 1000).cast("long"))


def moment(v: V) -> Column:
    if v.t == "ts":
        return v.c.cast("timestamp")
    if v.t in NUMERIC:
        return _from_number(double(v))
    return F.coalesce(_from_number(text(v).try_cast("double")), text(v).try_cast("timestamp"))


def py_moment(x: object) -> datetime | None:
    if isinstance(x, datetime):
        return x if x.tzinfo else x.replace(tzinfo=timezone.utc)
    n = py_number(x)
    if n is not None:
        return datetime.fromtimestamp(n if abs(n) < SECONDS else n / 1000, timezone.utc)
    d = datetime.fromisoformat(py_text(x).replace("Z", "+00:00").split("[")[0])
    return d if d.tzinfo else d.replace(tzinfo=timezone.utc)


def local(zone: V, at: V) -> Column:
    return F.from_utc_timestamp(moment(at), text(zone))


def _part(name: str, col: Callable[[Column], Column], py: Callable[[datetime], int]) -> None:
    function(name, 2, lambda z, t: V(col(local(z, t)), "int"), lambda z, t: py(py_moment(t).astimezone(ZoneInfo(py_text(z)))))


def java_format(pattern: str) -> str:
    """A strftime pattern for the common letters of Java's."""
    table = (("yyyy", "%Y"), ("uuuu", "%Y"), ("EEEE", "%A"), ("EEE", "%a"), ("MMMM", "%B"), ("MMM", "%b"), ("yy", "%y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("hh", "%I"), ("mm", "%M"), ("ss", "%S"), ("a", "%p"), ("XXX", "%:z"), ("Z", "%z"))
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "'":
            end = pattern.find("'", at + 1)
            end = len(pattern) if end < 0 else end
            out, at = out + (pattern[at + 1 : end] or "'"), end + 1
            continue
        for a, b in table:
            if pattern.startswith(a, at):
                out, at = out + b, at + len(a)
                break
        else:
            out, at = out + pattern[at].replace("%", "%%"), at + 1
    return out


def _offset(zone: V, at: V) -> Column:
    minutes = F.round((F.unix_seconds(local(zone, at)) - F.unix_seconds(moment(at))) / 60).cast("int")
    size = F.abs(minutes)
    return F.when(minutes == 0, F.lit("Z")).otherwise(F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0")))


def _zoned(zone: V, at: V) -> V:
    t = local(zone, at)
    seconds = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return V(F.concat(seconds, _offset(zone, at), F.lit("["), text(zone), F.lit("]")), "str")


def _py_zoned(zone: object, at: object) -> str:
    d = py_moment(at).astimezone(ZoneInfo(py_text(zone)))
    minutes = int(d.utcoffset().total_seconds() // 60)
    tail = "Z" if not minutes else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return f"{d:%Y-%m-%dT%H:%M:%S}{tail}[{py_text(zone)}]"


function("DT_BEFORE", 2, lambda a, b: V(moment(a) < moment(b), "bool"), lambda a, b: py_moment(a) < py_moment(b))
function("DT_AFTER", 2, lambda a, b: V(moment(a) > moment(b), "bool"), lambda a, b: py_moment(a) > py_moment(b))
_part("DT_DAY", F.dayofmonth, lambda d: d.day)
_part("DT_DOW", lambda t: F.weekday(t) + 1, lambda d: d.isoweekday())
_part("DT_MONTH", F.month, lambda d: d.month)
_part("DT_YEAR", F.year, lambda d: d.year)
_part("DT_HOUR", F.hour, lambda d: d.hour)
_part("DT_MINUTE", F.minute, lambda d: d.minute)
_part("DT_SECOND", F.second, lambda d: d.second)
function("DT_TZ", 2, _zoned, _py_zoned)
function("DT_EPOCH", 1, lambda t: V(F.unix_seconds(moment(t)), "long"), lambda t: int(py_moment(t).timestamp()))
function("DT_PARSE", 3, lambda z, f, s: V(F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(text(s), text(f)), text(z))), "long"), lambda z, f, s: int(datetime.strptime(py_text(s), java_format(py_text(f))).replace(tzinfo=ZoneInfo(py_text(z))).timestamp()))
function("DT_FORMAT", 3, lambda z, f, t: V(F.call_function("date_format", local(z, t), text(f)), "str"), lambda z, f, t: py_moment(t).astimezone(ZoneInfo(py_text(z))).strftime(java_format(py_text(f))))
