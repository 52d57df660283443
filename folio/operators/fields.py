"""Fields of schemaless documents.

Any name may be asked for: a field that no document has is null in all. A value meets only literals of its own family
(numbers, strings, booleans, times, bytes); with any other literal it is known and matches nothing. A field whose
documents disagree on its type is a VARIANT, whose values each belong to the family that they have.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, STRING, BOOLEAN, TIME, BYTES = "number", "string", "boolean", "time", "bytes"
_LITERALS = ((bool, BOOLEAN), ((int, float, Decimal), NUMBER), (str, STRING), ((dt.datetime, dt.date), TIME), ((bytes, bytearray), BYTES))
_TYPES = ((T.NumericType, NUMBER), ((T.StringType, T.CharType, T.VarcharType), STRING), (T.BooleanType, BOOLEAN), ((T.TimestampType, T.TimestampNTZType, T.DateType), TIME), (T.BinaryType, BYTES))
#: The order of families in a sort by a VARIANT; all else comes after them.
_ORDER = (NUMBER, STRING, BOOLEAN)


def family(value: object) -> str | None:
    return next((f for kinds, f in _LITERALS if isinstance(value, kinds)), None)


def literal(value: object) -> Column:
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        value = float(value)
    return F.lit(bytearray(value) if isinstance(value, bytes) else value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Value:
    """A field's value as a Column, with its type; None is the type of a field that is nowhere."""

    column: Column
    kind: T.DataType | None

    @property
    def known(self) -> Column:
        if isinstance(self.kind, T.VariantType):
            return self.column.isNotNull() & ~F.is_variant_null(self.column)
        return F.lit(False) if self.kind is None else self.column.isNotNull()

    def _variant(self, wanted: str, test: Callable[[Column], Column]) -> Column:
        kind = F.schema_of_variant(self.column)
        get = lambda t: F.try_variant_get(self.column, "$", t)
        if wanted == NUMBER:
            # whole numbers keep all their digits
            return F.when(kind == "BIGINT", test(get("bigint"))).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), test(get("double")))
        if wanted == TIME:
            # what came as JSON holds a time as its ISO text
            return F.when(kind.startswith("TIMESTAMP") | (kind == "DATE"), test(get("timestamp"))).when(kind == "STRING", test(F.try_to_timestamp(get("string"))))
        name = {STRING: "STRING", BOOLEAN: "BOOLEAN", BYTES: "BINARY"}[wanted]
        return F.when(kind == name, test(get(name.lower())))

    def test(self, wanted: str | None, test: Callable[[Column], Column]) -> Column:
        """``test`` of the value where it is of the wanted family, else false or null."""
        if isinstance(self.kind, T.VariantType) and wanted is not None:
            return self._variant(wanted, test)
        own = next((f for kinds, f in _TYPES if isinstance(self.kind, kinds)), None)
        return test(self.column) if wanted is not None and own == wanted else F.lit(False)

    def text(self) -> Column:
        """The value where it is a string, else null."""
        if isinstance(self.kind, T.VariantType):
            return self._variant(STRING, lambda c: c)
        return self.column if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def number(self) -> Column:
        """The value where it is a number, else null."""
        if isinstance(self.kind, T.VariantType):
            return self._variant(NUMBER, lambda c: c.cast("double"))
        return self.column if isinstance(self.kind, T.NumericType) else F.lit(None).cast("double")

    def like(self, value: object) -> Column:
        """A literal as the field compares with it: a time takes the field's own type, so that the filter reaches the scan."""
        exact = isinstance(self.kind, T.TimestampType | T.TimestampNTZType) or (isinstance(self.kind, T.DateType) and not isinstance(value, dt.datetime))
        return literal(value).cast(self.kind) if exact and family(value) == TIME else literal(value)

    def order(self) -> list[Column]:
        """What to sort by. Values of mixed types go by family: numbers, strings, booleans, then others by their JSON."""
        if self.kind is None:
            return []
        if not isinstance(self.kind, T.VariantType):
            return [self.column]
        rank = F.lit(None).cast("int")
        parts: list[Column] = []
        for n, f in enumerate(_ORDER):
            rank = F.coalesce(rank, self._variant(f, lambda c, n=n: F.lit(n)))
            parts.append(self._variant(f, lambda c, f=f: c.cast("double") if f == NUMBER else c))
        rank = F.when(self.known, F.coalesce(rank, F.lit(len(_ORDER))))
        return [rank, *parts, F.when(rank == len(_ORDER), F.to_json(self.column))]

    def key(self) -> Column:
        """A value to group by: the field itself, or the JSON text of a VARIANT."""
        if isinstance(self.kind, T.VariantType):
            return F.when(self.known, F.to_json(self.column))
        return self.column


def resolve(schema: T.StructType, name: str) -> Value:
    """A field by its name, which may hold dots; else a path into an object or VARIANT; else a field that is nowhere."""
    if name in schema.names:
        return Value(F.col(quoted(name)), schema[name].dataType)
    parts = name.split(".")
    for n in range(len(parts) - 1, 0, -1):
        head, rest = ".".join(parts[:n]), parts[n:]
        if head in schema.names:
            return _inside(Value(F.col(quoted(head)), schema[head].dataType), rest)
    return Value(F.lit(None), None)


def _inside(value: Value, path: list[str]) -> Value:
    for n, part in enumerate(path):
        if isinstance(value.kind, T.VariantType):
            steps = "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path[n:])
            return Value(F.try_variant_get(value.column, "$" + steps, "variant"), T.VariantType())
        if isinstance(value.kind, T.StructType) and part in value.kind.names:
            value = Value(value.column.getField(part), value.kind[part].dataType)
        elif isinstance(value.kind, T.MapType) and isinstance(value.kind.keyType, T.StringType):
            value = Value(value.column.getItem(part), value.kind.valueType)
        else:
            return Value(F.lit(None), None)
    return value
