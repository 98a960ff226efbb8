"""Field types: their Spark types and what may be done with them."""

from __future__ import annotations

import datetime as dt
from enum import Enum

from pyspark.sql import types as T


class FieldType(Enum):
    """name, Spark type, pool size, reserved places, sortable, pageable, counted automatically."""

    STRING = ("string", T.StringType(), 32, 1, True, True, True)
    TEXT = ("text", T.StringType(), 16, 0, True, False, False)
    INT = ("int", T.LongType(), 32, 1, True, True, True)
    DOUBLE = ("double", T.DoubleType(), 32, 0, True, True, True)
    TIMESTAMP = ("timestamp", T.TimestampType(), 32, 0, True, True, False)
    BYTES = ("bytes", T.BinaryType(), 16, 0, False, False, False)
    REFERENCE = ("reference", T.StringType(), 16, 0, False, False, True)
    STRING_LIST = ("stringList", T.ArrayType(T.StringType()), 8, 0, False, False, False)
    INT_LIST = ("intList", T.ArrayType(T.LongType()), 8, 0, False, False, False)
    DOUBLE_LIST = ("doubleList", T.ArrayType(T.DoubleType()), 8, 0, False, False, False)
    TIMESTAMP_LIST = ("timestampList", T.ArrayType(T.TimestampType()), 8, 0, False, False, False)
    REFERENCE_LIST = ("referenceList", T.ArrayType(T.StringType()), 8, 0, False, False, False)
    BYTES_LIST = ("bytesList", T.ArrayType(T.BinaryType()), 8, 0, False, False, False)

    def __init__(self, label, spark, capacity, reserved, sortable, pageable, counted):
        self.label, self.spark = label, spark
        self.capacity, self.reserved = capacity, reserved
        self.sortable, self.pageable, self.counted = sortable, pageable, counted

    @property
    def is_list(self) -> bool:
        return self.label.endswith("List")

    @property
    def element(self) -> FieldType:
        return FieldType.of(self.label.removesuffix("List"))

    @property
    def numeric(self) -> bool:
        return self in (FieldType.INT, FieldType.DOUBLE)

    @property
    def ordered(self) -> bool:
        """Whether a range filter has a meaning."""
        return self in (FieldType.STRING, FieldType.TEXT, FieldType.INT, FieldType.DOUBLE, FieldType.TIMESTAMP)

    @classmethod
    def of(cls, label: FieldType | str) -> FieldType:
        if isinstance(label, cls):
            return label
        return next(t for t in cls if t.label == label)


#: Payload fields share this many places, whatever their type.
PAYLOAD_CAPACITY = 16


def kind(value) -> str:
    """Which sort of literal a value is; true and false are 1 and 0."""
    if isinstance(value, (bool, int)):
        return "int"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "timestamp"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (list, tuple, set, frozenset)):
        return "list"
    raise TypeError(f"{value!r} is no value of a record")


#: The kind of literal that a value of each field type is.
_VALUE = {"text": "string", "reference": "string"}
#: What Spark's types hold, by the name of the type; a narrower whole number or a float loses nothing in a wider field.
_STORED = {
    "int": ("tinyint", "smallint", "int", "bigint", "boolean"), "double": ("float", "double", "tinyint", "smallint", "int"),
    "string": ("string",), "timestamp": ("timestamp", "timestamp_ntz", "date"), "bytes": ("binary",),
}


def takes(field: FieldType, value) -> bool:
    """Whether a Python value may be written in a field. Whole numbers are doubles too, true and false are 1 and 0."""
    if field.is_list:
        return kind(value) == "list" and all(v is not None and kind(v) != "list" and takes(field.element, v) for v in value)
    got, want = kind(value), _VALUE.get(field.label, field.label)
    return got == want or (want, got) == ("double", "int")


def takes_column(field: FieldType, stored: T.DataType) -> bool:
    """Whether a column of a Spark type may be written in a field without losing anything; one of nulls always may."""
    if isinstance(stored, T.NullType):
        return True
    if field.is_list:
        return isinstance(stored, T.ArrayType) and takes_column(field.element, stored.elementType)
    name = "string" if isinstance(stored, (T.VarcharType, T.CharType)) else stored.typeName() if not isinstance(stored, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else stored.simpleString()
    return name in _STORED[_VALUE.get(field.label, field.label)]


def fits(field: FieldType, value) -> bool:
    """Whether a scalar literal can be compared with a field (or a list field's element)."""
    base = (field.element if field.is_list else field).label
    got = kind(value)
    if base in ("int", "double"):
        return got in ("int", "double")
    if base in ("string", "text", "reference"):
        return got == "string"
    return got == base
