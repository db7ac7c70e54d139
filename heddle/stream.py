"""A stream: a DataFrame of keyed records with a type, its attributes by level, and how it came about."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.scalar import V, type_name

KEY, PART, GEO, OBJECT, VALUE = "_key", "_part", "_geo", "_object", "value"
RESERVED = (KEY, PART, GEO, OBJECT)
TOP = {"text": "value", "columnar": "value", "structured": "value", "point": "point", "polygon": "polygon", "track": "track"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Stream:
    """df holds _key, for text a column value, for structured records a variant _object, for spatial ones a struct _geo, else a column for each attribute."""

    name: str
    df: DataFrame
    kind: str
    attrs: dict[str, list[str]] = field(default_factory=dict)
    lineage: tuple[tuple[str, str], ...] = ()
    keyed: str | None = None

    @property
    def level(self) -> str:
        return TOP[self.kind]

    @property
    def columns(self) -> list[str]:
        """Columns that are attributes."""
        if self.kind == "structured":
            return []
        return [c for c in self.df.columns if c not in RESERVED and not (self.kind == "text" and c != VALUE)]

    @property
    def names(self) -> list[str]:
        return self.attrs.get(self.level) or self.columns

    def but(self, **changes: Any) -> Stream:
        return replace(self, **changes)

    def made(self, origin: str, subject: str, **changes: Any) -> Stream:
        return replace(self, lineage=(*self.lineage, (origin, subject)), **changes)


class RecordContext:
    """What expressions see of a stream: attributes become Columns; what it doesn't have is null."""

    def __init__(self, stream: Stream):
        self.stream = stream
        self.types = {f.name: type_name(f.dataType) for f in stream.df.schema.fields}
        self.names = stream.names

    def key(self) -> V:
        return V(F.col(KEY), self.types.get(KEY, "long"))

    def attr(self, name: str) -> V:
        if self.stream.kind == "text":
            return V(F.col(VALUE), "str")
        if name in self.types and (name not in RESERVED or name == KEY):
            return V(F.col(quoted(name)), self.types[name])
        if self.stream.kind == "structured":
            from .functions.records import structured_get

            return structured_get(F.col(OBJECT), name)
        if "." in name or "[" in name:
            from .functions.records import structured_get

            head = name.split(".")[0].split("[")[0]
            if self.types.get(head) == "var":
                return structured_get(F.col(quoted(head)), name[len(head) :])
        return V(F.lit(None), "null")

    def record(self) -> V:
        if self.stream.kind == "structured":
            return V(F.col(OBJECT), "var")
        if GEO in self.types:
            return V(F.col(GEO), "rec")
        return V(F.struct(*[F.col(quoted(c)) for c in self.stream.columns]), "rec")


class StructContext(RecordContext):
    """Attributes of an element of a nested array: a struct with a map of texts `props`, and lat, lon."""

    def __init__(self, stream: Stream, element: Any, names: list[str]):
        super().__init__(stream)
        self.element, self.names = element, names

    def attr(self, name: str) -> V:
        return V(self.element["props"][name], "str")
