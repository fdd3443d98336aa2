"""Declared schemas: ordered columns with one of seven kinds.

A schema is a StructType; each field's metadata holds its ``kind`` and, for
date-times, the ``format`` of its text.  Date-times stay text in a table, as
they were read, and become instants when an operator needs them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import types as T

INTEGER, FLOAT, DOUBLE, LONG, STRING, CATEGORICAL, DATE_TIME = "integer", "float", "double", "long", "string", "categorical", "date-time"

TYPES = {
    INTEGER: T.IntegerType(),
    FLOAT: T.FloatType(),
    DOUBLE: T.DoubleType(),
    LONG: T.LongType(),
    STRING: T.StringType(),
    CATEGORICAL: T.StringType(),
    DATE_TIME: T.StringType(),
}
NUMERIC = {INTEGER, FLOAT, DOUBLE, LONG}


def def_schema(*pairs: str, date_formats: dict[str, str] | None = None) -> T.StructType:
    """def_schema("x", DOUBLE, "day", DATE_TIME, date_formats={"day": "yyyy-MM-dd"})"""
    if len(pairs) % 2:
        raise ValueError("names and kinds have to alternate")
    formats = date_formats or {}
    fields = []
    for name, kind in zip(pairs[::2], pairs[1::2], strict=True):
        if kind not in TYPES:
            raise ValueError(f"unknown kind {kind!r}; one of {', '.join(TYPES)}")
        metadata = {"kind": kind}
        if kind == DATE_TIME:
            metadata["format"] = formats.get(name, "yyyy-MM-dd HH:mm:ss")
        fields.append(T.StructField(name, TYPES[kind], True, metadata))
    return T.StructType(fields)


def field_of(schema: T.StructType, name: str) -> T.StructField:
    """The field of that name, in any case of letters; exact spelling first."""
    for same in (lambda a: a == name, lambda a: a.lower() == name.lower()):
        for f in schema.fields:
            if same(f.name):
                return f
    raise KeyError(f"no column {name!r} among {', '.join(schema.names)}")


def kind_of(field: T.StructField) -> str:
    """The declared kind, or the one that fits the Spark type (tables from elsewhere declare none)."""
    if "kind" in (field.metadata or {}):
        return field.metadata["kind"]
    t = field.dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE_TIME
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(t, T.LongType):
        return LONG
    if isinstance(t, T.FloatType):
        return FLOAT
    if isinstance(t, (T.DoubleType, T.DecimalType)):
        return DOUBLE
    return STRING


def ordered_kinds(schema: T.StructType) -> list[str]:
    return [kind_of(f) for f in schema.fields]


def column_position(schema: T.StructType, name: str) -> int:
    return schema.fields.index(field_of(schema, name))


def numeric_columns(schema: T.StructType) -> list[str]:
    """Columns of the four numeric kinds; date-times don't count."""
    return [f.name for f in schema.fields if kind_of(f) in NUMERIC]


def vector_columns(schema: T.StructType) -> list[str]:
    """Columns that clustering takes by default: all but text."""
    return [f.name for f in schema.fields if kind_of(f) not in (STRING, CATEGORICAL) and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def make_row(schema: T.StructType, values: list) -> T.Row:
    """Values in the order of the columns as a row."""
    if len(values) != len(schema.fields):
        raise ValueError(f"{len(values)} values for {len(schema.fields)} columns")
    return T.Row(*schema.names)(*values)


def header(schema: T.StructType) -> list[tuple[str, str]]:
    """(name, kind) of the columns, in order."""
    return [(f.name, kind_of(f)) for f in schema.fields]


def build_dimensions(columns: list[str], n: int = 2) -> list[tuple[str, ...]]:
    """All unordered pairs or triples of distinct columns."""
    return list(combinations(sorted(set(columns)), n))
