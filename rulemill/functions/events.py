"""Events as flat, canonically named, typed columns.

Nested structs become dotted names and JSON text columns are parsed once, here, however many rules read them. Only the columns
that rules refer to are selected later, so the scan reads no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, NUMBER, BOOLEAN, OTHER = "string", "number", "boolean", "other"


def canonical(name: str) -> str:
    """Upper case, - as _; dots part nested names."""
    return name.upper().replace("-", "_")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(data_type, T.NumericType):
        return NUMBER
    return BOOLEAN if isinstance(data_type, T.BooleanType) else OTHER


@dataclass
class EventView:
    """``df`` has the event's key as ``event_id`` and attributes under @ and their canonical names, so none clashes with other columns; ``kinds`` tells how each may be tested."""

    df: DataFrame
    kinds: dict[str, str]

    def column(self, name: str) -> Column:
        return F.col(f"`@{name}`")

    def prune(self, fields: set[str]) -> EventView:
        """Keep the key and those of the fields that exist."""
        kept = [f for f in self.kinds if f in fields]
        return EventView(self.df.select("event_id", *[self.column(f) for f in kept]), {f: self.kinds[f] for f in kept})


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()):
    for f in schema.fields:
        here = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, here)
        else:
            yield here, f.dataType


def event_view(df: DataFrame, id_col: str = "event_id", json: dict[str, str] | None = None, attributes: str | None = None) -> EventView:
    """Flatten a DataFrame of events.

    ``json`` maps JSON text columns to DDL schemas; each is parsed once and flattened under its own name. ``attributes`` names a struct column whose members
    become top-level attributes, as in ``{eventId, attributes: {...}}``. A flat column and a nested one of the same canonical name collide by design: the first one wins.
    """
    parsed = {name: f"_json_{i}" for i, name in enumerate(json or {})}
    base = df.withColumns({alias: F.from_json(F.col(f"`{name}`"), json[name]) for name, alias in parsed.items()}) if parsed else df
    columns, kinds = [], {}

    def add(name: str, column: Column, data_type: T.DataType) -> None:
        if name not in kinds:
            kinds[name] = kind_of(data_type)
            columns.append(column.alias(f"@{name}"))

    for path, data_type in _leaves(base.schema):
        if path[0] == id_col and len(path) == 1:
            continue
        dotted = F.col(".".join(f"`{p}`" for p in path))
        names = path
        if path[0] in parsed.values():
            names = (next(n for n, a in parsed.items() if a == path[0]), *path[1:])
        elif attributes and path[0] == attributes and len(path) > 1:
            names = path[1:]
        add(canonical(".".join(names)), dotted, data_type)
    return EventView(base.select(F.col(f"`{id_col}`").alias("event_id"), *columns), kinds)
