"""The fluent query: an immutable description that compiles to one Catalyst plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.operators import aggregates, fts
from folio.operators.fields import resolve
from folio.operators.predicates import UNNEGATED, condition, disjunction


@dataclass(frozen=True)
class Condition:
    field: str
    verb: str
    args: tuple = ()
    negated: bool = False

    def column(self, schema: StructType) -> Column:
        return condition(resolve(schema, self.field), self.verb, self.args, self.negated)


@dataclass(frozen=True)
class Postings:
    """An inverted table of a field, the documents that it covers and those, if any, that it doesn't."""

    table: DataFrame
    covered: DataFrame
    rest: DataFrame | None = None


@dataclass(frozen=True)
class Query:
    """OR of AND groups over a DataFrame, with one sort key, skip and limit. Fields need not exist: see operators.fields.

    postings: inverted tables by field; in a lone AND group plain full-text conditions on one such field become semi-joins
    where the table covers the documents, and read the texts of the others alone.
    indexes: declared index of each field, for explain().
    """

    source: DataFrame
    key: str = "_id"
    groups: tuple[tuple[Condition, ...], ...] = ((),)
    sort_field: str | None = None
    descending: bool = False
    skipped: int = 0
    limited: int | None = None
    columns: tuple[str, ...] = ()
    postings: dict[str, Postings] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)

    def where(self, name: str) -> Field:
        return Field(self, name)

    and_ = where

    def or_(self) -> Query:
        """Open a new group. A group that gets no condition does not count."""
        return replace(self, groups=(*self.groups, ()))

    def range_search(self, low: int, high: int) -> Query:
        """Keys from low to high, both included."""
        return self.where(self.key).between(low, high)

    def sort_by(self, name: str, descending: bool = False) -> Query:
        return replace(self, sort_field=name, descending=descending)

    def skip(self, n: int) -> Query:
        return replace(self, skipped=max(0, n))

    def limit(self, n: int) -> Query:
        return replace(self, limited=max(0, n))

    def select(self, *names: str) -> Query:
        return replace(self, columns=names)

    def _filtered(self) -> DataFrame:
        live = [g for g in self.groups if g]
        schema = self.source.schema
        served = next((c.field for c in live[0] if c.verb == "fts" and not c.negated and c.field in self.postings), None) if len(live) == 1 else None
        if served is None:
            return _where(self.source, disjunction([[c.column(schema) for c in g] for g in live]))
        held = self.postings[served]
        df, rest = held.covered, []
        for c in live[0]:
            if c.verb == "fts" and not c.negated and c.field == served:
                df = df.join(fts.posting_keys(held.table, *c.args, key=self.key), self.key, "left_semi")
            else:
                rest.append(c.column(schema))
        found = _where(df, disjunction([rest]))
        if held.rest is None:
            return found
        return found.unionByName(_where(held.rest, disjunction([[c.column(schema) for c in live[0]]])))

    def df(self) -> DataFrame:
        """Sorted nulls last either way; ties by key, in the direction of the sort. Skip comes before limit."""
        df = self._filtered()
        if self.sort_field is not None:
            by, k = resolve(self.source.schema, self.sort_field).order(), F.col(self.key)
            df = df.orderBy(*[c.desc_nulls_last() for c in by], k.desc()) if self.descending else df.orderBy(*[c.asc_nulls_last() for c in by], k.asc())
        elif self.skipped or self.limited is not None:
            df = df.orderBy(self.key)
        if self.skipped:
            df = df.offset(self.skipped)
        if self.limited is not None:
            df = df.limit(self.limited)
        return df.select(*[resolve(self.source.schema, n).column.alias(n) for n in self.columns]) if self.columns else df

    def ids(self) -> DataFrame:
        return replace(self, columns=(self.key,)).df()

    def find(self) -> list[dict[str, Any]]:
        return [r.asDict(True) for r in self.df().collect()]

    def find_ids(self) -> list[int]:
        query = self if self.sort_field else self.sort_by(self.key)
        return [r[0] for r in query.ids().collect()]

    def find_first(self) -> dict[str, Any] | None:
        row = (self if self.sort_field else self.sort_by(self.key)).df().first()
        return row.asDict(True) if row else None

    def find_stream(self) -> Iterator[Row]:
        """Rows as they come, one partition ahead."""
        return self.df().toLocalIterator(prefetchPartitions=True)

    def count(self) -> int:
        """Rows of the result, after skip and limit."""
        return aggregates.count(self.df()).first()[0]

    def column(self) -> Column | None:
        """The filter alone, as one Column."""
        schema = self.source.schema
        return disjunction([[c.column(schema) for c in g] for g in self.groups])

    def explain(self, plan: bool = False) -> str:
        """The groups, what serves each condition, sort and page; with ``plan`` Spark's own plan as well."""
        lines = ["Query"]
        for n, group in enumerate(self.groups):
            lines.append(f"{'  OR ' if n else '  '}group {n}{'' if len(group) == 1 else ' AND' if group else ' empty'}")
            for c in group:
                how = "postings" if c.verb == "fts" and c.field in self.postings else self.indexes.get(c.field, "scan")
                lines.append(f"    {'not ' if c.negated and c.verb not in UNNEGATED else ''}{c.verb} {c.field}{''.join(f' {a!r}' for a in c.args)} [{how}]")
        if self.sort_field is not None:
            lines.append(f"  sort {self.sort_field} {'desc' if self.descending else 'asc'}")
        lines += [f"  skip {self.skipped}"] * bool(self.skipped) + [f"  limit {self.limited}"] * (self.limited is not None)
        if plan:
            df = self.df()
            lines.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(lines)


def _where(df: DataFrame, wanted: Column | None) -> DataFrame:
    return df if wanted is None else df.where(wanted)


@dataclass(frozen=True)
class Field:
    """A field that waits for its verb."""

    query: Query
    name: str
    negated: bool = False

    def not_(self) -> Field:
        return replace(self, negated=not self.negated)

    def _with(self, verb: str, *args: object) -> Query:
        added = Condition(self.name, verb, args, self.negated)
        *rest, last = self.query.groups
        return replace(self.query, groups=(*rest, (*last, added)))

    def equals(self, value: object) -> Query:
        return self._with("equals", value)

    def between(self, low: object, high: object) -> Query:
        return self._with("between", low, high)

    def greater_than(self, value: object) -> Query:
        return self._with("greater_than", value)

    def greater_or_equal_to(self, value: object) -> Query:
        return self._with("greater_or_equal_to", value)

    def less_than(self, value: object) -> Query:
        return self._with("less_than", value)

    def less_than_or_equal_to(self, value: object) -> Query:
        return self._with("less_than_or_equal_to", value)

    def contains(self, part: str, ignore_case: bool = False) -> Query:
        return self._with("contains", part, ignore_case)

    def starts_with(self, part: str, ignore_case: bool = False) -> Query:
        return self._with("starts_with", part, ignore_case)

    def is_in(self, values: list) -> Query:
        return self._with("is_in", tuple(values))

    def is_null(self) -> Query:
        return self._with("is_null")

    def is_not_null(self) -> Query:
        return self._with("is_not_null")

    def always_true(self) -> Query:
        """Every row whose field is not null."""
        return self._with("always_true")

    def fts(self, text: str) -> Query:
        return self._with("fts", text)

    def fts_prefix(self, text: str) -> Query:
        return self._with("fts_prefix", text)

    def search_prefix(self, text: str) -> Query:
        """As fts_prefix; a text without tokens finds every row that has any."""
        return self._with("search_prefix", text)

    def fts_contains(self, text: str) -> Query:
        return self._with("fts_contains", text)
