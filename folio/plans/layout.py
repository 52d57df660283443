"""Index declarations as physical layout: what a writer sorts, clusters and tags, and what a table says of itself."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from folio.operators.fields import quoted, resolve

KINDS = ("hash", "sorted", "bitmap", "composite", "fts")


@dataclass(frozen=True)
class Index:
    kind: str
    fields: tuple[str, ...]

    @property
    def name(self) -> str:
        return ("_fts_" if self.kind == "fts" else "") + "+".join(self.fields)

    def to_json(self) -> dict:
        return asdict(self) | {"fields": list(self.fields)}

    @staticmethod
    def of(kind: str, *fields: str) -> Index:
        if kind not in KINDS:
            raise ValueError(f"no such index: {kind}")
        if not fields:
            raise ValueError("an index needs a field")
        return Index("hash" if kind == "composite" and len(fields) == 1 else kind, tuple(fields))


def arranged(df: DataFrame, indexes: list[Index], files: int | None = None) -> DataFrame:
    """Rows in the order that the indexes ask for: ranges of the first sorted or composite one, else the values of the
    bitmap fields, else ``_id``.

    Row groups then hold narrow ranges or few values, and scans skip them by their statistics.
    """
    order = next((i.fields for i in indexes if i.kind in ("sorted", "composite")), ()) or tuple(f for i in indexes if i.kind == "bitmap" for f in i.fields)
    # a VARIANT has no order in files
    plain = {f.name for f in df.schema if isinstance(f.dataType, AtomicType)}
    keys = [quoted(f) for f in order if f in plain] + ["_id"]
    return (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def options(indexes: list[Index]) -> dict[str, str]:
    """Parquet writer options: Bloom filters for equality on hash fields and the key."""
    out = {"parquet.bloom.filter.enabled#_id": "true"}
    for i in indexes:
        for f in i.fields:
            if i.kind in ("hash", "composite"):
                out[f"parquet.bloom.filter.enabled#{f}"] = "true"
    return out


def describe(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, rows, nulls and distinct (exact) of each, in one pass over the table."""
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, rows long, nulls long, distinct long")
    aggs = []
    for n, f in enumerate(fields):
        v = resolve(df.schema, f)
        aggs += [F.count_if(~v.known).alias(f"n{n}"), F.countDistinct(v.key()).alias(f"d{n}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    parts = [F.struct(F.lit(f).alias("field"), "rows", F.col(f"n{n}").alias("nulls"), F.col(f"d{n}").alias("distinct")) for n, f in enumerate(fields)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
