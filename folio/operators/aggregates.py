"""Scalar aggregates over a filtered set. Each is one row, from one partial and one final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.fields import Value, quoted, resolve


def _value(df: DataFrame, field: str) -> Value:
    return resolve(df.schema, field)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def total(df: DataFrame, field: str) -> DataFrame:
    """The sum of the numbers in a field; 0 of nothing."""
    return df.agg(F.coalesce(F.sum(_value(df, field).number()), F.lit(0)).alias("sum"))


def average(df: DataFrame, field: str) -> DataFrame:
    """The mean of the numbers in a field; null of nothing."""
    return df.agg(F.avg(_value(df, field).number()).alias("avg"))


def least(df: DataFrame, field: str) -> DataFrame:
    return _extreme(df, field, F.min, F.min_by).withColumnRenamed("x", "min")


def greatest(df: DataFrame, field: str) -> DataFrame:
    return _extreme(df, field, F.max, F.max_by).withColumnRenamed("x", "max")


def _extreme(df: DataFrame, field: str, plain, by) -> DataFrame:
    """The end of a field's sort order, nulls aside."""
    v = _value(df, field)
    if isinstance(v.kind, T.VariantType):
        return df.where(v.known).agg(by(v.column, F.struct(*v.order())).alias("x"))
    return df.agg(plain(v.column).alias("x"))


def cardinality(df: DataFrame, field: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values."""
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(f(_value(df, field).key()).alias("distinct"))


def grouped(df: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """Each distinct non-null value with the sorted keys that have it."""
    rows = df.select(_value(df, field).key().alias(field), key).where(F.col(quoted(field)).isNotNull())
    return rows.groupBy(quoted(field)).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def duplicates(df: DataFrame, field: str, top: int | None = None) -> DataFrame:
    """Values that occur more than once, the commonest first; ties by value."""
    rows = df.select(_value(df, field).key().alias(field)).where(F.col(quoted(field)).isNotNull())
    found = rows.groupBy(quoted(field)).agg(F.count("*").alias("count")).where("count > 1").orderBy(F.desc("count"), F.asc(quoted(field)))
    return found if top is None else found.limit(top)


def statistics(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, rows, nulls, distinct (approximate), least and greatest (as text) of each field, in one pass."""
    values = {f: _value(df, f) for f in fields}
    aggs = []
    for n, v in enumerate(values.values()):
        aggs += [F.count_if(~v.known).alias(f"n{n}"), F.approx_count_distinct(v.key()).alias(f"d{n}"), F.min(v.key()).cast("string").alias(f"a{n}"), F.max(v.key()).cast("string").alias(f"b{n}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    parts = [F.struct(F.lit(f).alias("field"), "rows", F.col(f"n{n}").alias("nulls"), F.col(f"d{n}").alias("distinct"), F.col(f"a{n}").alias("least"), F.col(f"b{n}").alias("greatest")) for n, f in enumerate(fields)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def rolled(df: DataFrame, fields: list[str], aggregates: dict[str, tuple[str, str]], how: str = "group", having: str | None = None) -> DataFrame:
    """Groups by several fields: ``aggregates`` gives each result a function (count, sum, avg, min, max) and its field.
    how: group, rollup or cube. having: a condition on the result."""
    if how not in ("group", "rollup", "cube"):
        raise ValueError(f"no such grouping: {how}")
    made = {"count": lambda v: F.count(v.key()), "sum": lambda v: F.sum(v.number()), "avg": lambda v: F.avg(v.number()), "min": lambda v: F.min(v.key()), "max": lambda v: F.max(v.key())}
    keys = [_value(df, f).key().alias(f) for f in fields]
    rows = df.select(*keys, *[_value(df, f).column.alias(f"__{n}") for n, (_, f) in enumerate(aggregates.values())])
    kinds = [_value(df, f).kind for _, f in aggregates.values()]
    groups = {"group": rows.groupBy, "rollup": rows.rollup, "cube": rows.cube}[how](*[quoted(f) for f in fields])
    out = groups.agg(*[made[how_](Value(F.col(f"__{n}"), kind)).alias(name) for n, ((name, (how_, _)), kind) in enumerate(zip(aggregates.items(), kinds))])
    return out if having is None else out.where(having)
