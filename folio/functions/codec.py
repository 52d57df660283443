"""Python values to and from documents: normalising, typed objects, schemas that grow."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T


def normal(value: Any) -> Any:
    """A value as a document holds it: null, bool, int, float, str, bytes, datetime, list or dict.

    Objects are taken by what they offer: ``to_date()``, latitude and longitude, ``path``, ``bytes``, ``to_json()``;
    anything else becomes its string.
    """
    if value is None or isinstance(value, bool | int | float | str | bytes):
        return value
    if isinstance(value, dt.datetime):
        return value if value.tzinfo is None else value.astimezone(dt.UTC).replace(tzinfo=None)
    if isinstance(value, bytearray | memoryview):
        return bytes(value)
    if isinstance(value, dict):
        return {str(k): normal(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [normal(v) for v in value]
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return normal(dataclasses.asdict(value))
    if callable(getattr(value, "to_date", None)):
        return normal(value.to_date())
    if hasattr(value, "latitude") and hasattr(value, "longitude"):
        return {"latitude": float(value.latitude), "longitude": float(value.longitude)}
    if isinstance(getattr(value, "path", None), str):
        return value.path
    if isinstance(getattr(value, "bytes", None), bytes | bytearray):
        return bytes(value.bytes)
    if callable(getattr(value, "to_json", None)):
        return normal(value.to_json())
    return str(value)


@dataclass
class Adapter:
    type_id: int
    kind: type
    write: Callable[[Any], dict]
    read: Callable[[dict], Any]


class Registry:
    """Codecs of typed objects. An id belongs to one class."""

    def __init__(self) -> None:
        self._by_id: dict[int, Adapter] = {}

    def register(self, type_id: int, kind: type, write: Callable[[Any], dict] | None = None, read: Callable[[dict], Any] | None = None) -> None:
        held = self._by_id.get(type_id)
        if held and held.kind is not kind:
            raise ValueError(f"type id {type_id} belongs to {held.kind.__name__}")
        if (write is None or read is None) and not dataclasses.is_dataclass(kind):
            raise ValueError("a class that is no dataclass needs write and read")
        self._by_id[type_id] = Adapter(type_id, kind, write or dataclasses.asdict, read or (lambda d: kind(**{f.name: d.get(f.name) for f in dataclasses.fields(kind)})))

    def encode(self, value: Any) -> dict:
        """A document; of a typed object with its type id in ``_type``."""
        for a in self._by_id.values():
            if type(value) is a.kind:
                return normal(a.write(value)) | {"_type": a.type_id}
        found = normal(value)
        return found if isinstance(found, dict) else {"value": found, "runtime_type": type(value).__name__}

    def decode(self, doc: dict) -> Any:
        a = self._by_id.get(doc.get("_type"))
        return a.read({k: v for k, v in doc.items() if k not in ("_type", "_id")}) if a else doc


_ATOMS = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (dt.datetime, T.TimestampType()))


def type_of(value: Any) -> T.DataType:
    for kind, found in _ATOMS:
        if isinstance(value, kind):
            return found
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, type_of(v)) for k, v in value.items()])
    if isinstance(value, list):
        element: T.DataType = T.NullType()
        for v in value:
            element = widest(element, type_of(v))
        return T.ArrayType(element)
    return T.NullType()


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both; what nothing else holds becomes a variant."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.VariantType) or isinstance(b, T.VariantType):
        return T.VariantType()
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    real = (*whole, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, real) and isinstance(b, real):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b)
    return T.VariantType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    fields = {f.name: f.dataType for f in a}
    for f in b:
        fields[f.name] = widest(fields[f.name], f.dataType) if f.name in fields else f.dataType
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def settled(kind: T.DataType) -> T.DataType:
    """A type that can be stored: fields only ever null are strings until a value says otherwise."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(settled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType)) for f in kind]) if kind.fields else T.StringType()
    return kind


def fitted(value: Any, kind: T.DataType) -> Any:
    """A normal value for a column of this type."""
    if value is None:
        return None
    if isinstance(kind, T.VariantType):
        return json.dumps(value, default=lambda v: v.isoformat() if isinstance(v, dt.datetime) else v.hex())
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value)
    return value
