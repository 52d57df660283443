"""A collection of documents: queries, changes, transactions, indexes, migrations, listeners."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import codec
from folio.operators import aggregates, fts
from folio.operators.fields import quoted
from folio.plans import layout
from folio.plans.query import Postings, Query
from folio.sources.snapshot import KEY, Conflict, Manifest, Store, advanced

Filter = Callable[[Query], Query]
_RETRIES = 5


class Collection:
    """Documents in one folder. Every change publishes a version; a transaction publishes one for all its changes."""

    def __init__(
        self, spark: SparkSession, path: str, registry: codec.Registry | None = None, auto_compact_files: int | None = None, auto_compact_share: float | None = None,
        encryption_key: bytes | None = None,
    ) -> None:
        self.spark, self.store = spark, Store(spark, path, encryption_key)
        self.registry = registry or codec.Registry()
        self.auto_compact_files, self.auto_compact_share = auto_compact_files, auto_compact_share
        self._work: Manifest | None = None
        self._kinds: list[str] = []
        self._closed = False
        self._held: tuple[int, DataFrame] | None = None

    # lifecycle

    @classmethod
    def open(
        cls, spark: SparkSession, path: str, *, hash_indexes: Iterable[str] = (), sorted_indexes: Iterable[str] = (), bitmap_indexes: Iterable[str] = (),
        composite_indexes: Iterable[Iterable[str]] = (), fts_indexes: Iterable[str] = (), version: int = 1,
        migrations: dict[int, Callable[[DataFrame], DataFrame]] | None = None, registry: codec.Registry | None = None, auto_compact_files: int | None = None,
        auto_compact_share: float | None = None, encryption_key: bytes | None = None,
    ) -> Collection:
        """Open or create. ``migrations[v]`` takes the documents from schema version v to v + 1.

        auto_compact_files, auto_compact_share: compact after a change that leaves more files, or a larger share of
        deleted and replaced documents since the last time. encryption_key (16, 24 or 32 bytes): documents are stored
        as AES-GCM ciphertext, without inverted tables; it must be given again at each opening.
        """
        c = cls(spark, path, registry, auto_compact_files, auto_compact_share, encryption_key)
        wanted = [layout.Index.of(k, f) for k, fields in (("hash", hash_indexes), ("sorted", sorted_indexes), ("bitmap", bitmap_indexes), ("fts", fts_indexes)) for f in fields]
        wanted += [layout.Index.of("composite", *f) for f in composite_indexes]
        for i in wanted:
            c._add(i)
        c._migrate(version, migrations or {})
        return c

    @classmethod
    def memory(cls, spark: SparkSession, **options: Any) -> Collection:
        """A collection that lives as long as this machine's temporary folder; for local sessions."""
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs a shared folder")
        return cls.open(spark, tempfile.mkdtemp(prefix="folio-"), **options)

    def close(self) -> None:
        self._drop_cache()
        self._closed = True

    @property
    def is_open(self) -> bool:
        return not self._closed

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # state

    def _state(self) -> Manifest:
        if self._closed:
            raise RuntimeError("the collection is closed")
        return self._work or self.store.load()

    def _change(self, kind: str, step: Callable[[Manifest], tuple[Manifest | None, Any]]) -> Any:
        """Apply ``step`` to the state and publish what it returns; on a conflict start again from the new state."""
        for attempt in range(_RETRIES):
            before = self._state()
            after, result = step(before)
            if after is None:
                return result
            if self._work is not None:
                self._work = after
                self._kinds.append(kind)
                return result
            self._drop_cache()
            try:
                self.store.publish(advanced(after, version=before.version + 1), [kind])
            except Conflict:
                if attempt == _RETRIES - 1:
                    raise
                continue
            if kind != "compact" and self._crowded(after):
                self.compact()
            return result
        return None

    def _crowded(self, m: Manifest) -> bool:
        many = self.auto_compact_files is not None and len(m.files) > self.auto_compact_files
        return many or (self.auto_compact_share is not None and m.live >= 0 and m.dead > self.auto_compact_share * (m.live + m.dead))

    @contextmanager
    def transaction(self) -> Iterator[Collection]:
        """All changes inside become one version, or none if the block raises. Reads inside see them."""
        if self._work is not None:
            raise RuntimeError("a transaction is open")
        start = self._state()
        self._work, self._kinds = start, []
        try:
            yield self
            if self._work is not start:
                self.store.publish(advanced(self._work, version=start.version + 1), list(dict.fromkeys(self._kinds)))
        finally:
            self._work, self._kinds = None, []

    batch = transaction

    def transact(self, work: Callable[[Collection], Any]) -> Any:
        """What ``work(self)`` returns, run in a transaction, and again from the new state if another writer was first."""
        for attempt in range(_RETRIES):
            try:
                with self.transaction():
                    found = work(self)
                if self._crowded(self._state()):
                    self.compact()
                return found
            except Conflict:
                if attempt == _RETRIES - 1:
                    raise
        return None

    # reading

    def df(self, version: int | None = None) -> DataFrame:
        """The documents, or those of an earlier version."""
        return self.store.read(self._state() if version is None else self.store.load(version))

    def documents(self) -> DataFrame:
        """The documents with ``id``: the one the document brought, else its internal id."""
        df = self.df()
        if "id" not in df.columns:
            return df.withColumn("id", F.col("_id"))
        kind = df.schema["id"].dataType
        own = F.expr("cast(_id as variant)") if isinstance(kind, T.VariantType) else F.col("_id").cast(kind)
        return df.withColumn("id", F.coalesce("id", own))

    def query(self) -> Query:
        m = self._state()
        live, postings = set(m.files), {}
        for name, (path, covered) in m.postings.items():
            held = tuple(f for f in covered if f in live)
            rest = tuple(f for f in m.files if f not in set(held))
            if held:
                postings[name] = Postings(self.spark.read.parquet(f"{self.store.path}/{path}"), self.store.read(m, held), self.store.read(m, rest) if rest else None)
        kinds = {i.fields[0] if len(i.fields) == 1 else i.name: i.kind for i in self.indexes()}
        if self._held and self._held[0] == m.version and self._work is None:
            return Query(self._held[1], indexes=kinds)
        return Query(self.store.read(m), postings=postings, indexes=kinds)

    def cache(self) -> None:
        """Hold the documents of this version in the executors' memory. Queries read them there until a change."""
        self._drop_cache()
        m = self._state()
        self._held = (m.version, self.store.read(m).persist())

    def _drop_cache(self) -> None:
        if self._held:
            self._held[1].unpersist()
            self._held = None

    def _near(self, low: int, high: int) -> DataFrame:
        """The documents with keys from low to high, from the files that may hold them."""
        m = self._state()
        return self.store.read(m, m.holding(low, high)).where(F.col("_id").between(low, high))

    def _matching(self, q: Filter | None) -> DataFrame:
        return (q(self.query()) if q else self.query()).df()

    def get_all(self) -> DataFrame:
        return self.df().orderBy("_id")

    def find_by_id(self, key: int) -> dict[str, Any] | None:
        row = self._near(key, key).first()
        return row.asDict(True) if row else None

    def find_object(self, key: int) -> Any:
        """The typed object that was stored, if its adapter is registered."""
        doc = self.find_by_id(key)
        return None if doc is None else self.registry.decode({k: v for k, v in doc.items() if v is not None or k == "_id"})

    def find_by_ids(self, keys: Iterable[int]) -> DataFrame:
        return self.df().join(self.spark.createDataFrame([(int(k),) for k in dict.fromkeys(keys)], "_id long"), "_id", "left_semi")

    def exists(self, key: int) -> bool:
        return not self._near(key, key).isEmpty()

    def range_search(self, low: int, high: int) -> list[int]:
        return [r[0] for r in self._near(low, high).select("_id").orderBy("_id").collect()]

    def find(self, q: Filter) -> list[dict[str, Any]]:
        return q(self.query()).find()

    def find_stream(self, q: Filter) -> Iterator[Row]:
        return q(self.query()).find_stream()

    def stream(self) -> Iterator[Row]:
        return self.get_all().toLocalIterator(prefetchPartitions=True)

    def count(self) -> int:
        m = self._state()
        return m.live if m.live >= 0 else self.store.read(m).count()

    def count_where(self, q: Filter | None = None) -> int:
        return aggregates.count(self._matching(q)).first()[0]

    def sum_where(self, q: Filter | None, name: str) -> int | float:
        return aggregates.total(self._matching(q), name).first()[0]

    def avg_where(self, q: Filter | None, name: str) -> float | None:
        return aggregates.average(self._matching(q), name).first()[0]

    def min_where(self, q: Filter | None, name: str) -> Any:
        return aggregates.least(self._matching(q), name).first()[0]

    def max_where(self, q: Filter | None, name: str) -> Any:
        return aggregates.greatest(self._matching(q), name).first()[0]

    # writing

    def insert(self, doc: Any) -> int:
        return self.insert_all([doc])[0]

    def insert_all(self, docs: Iterable[Any] | DataFrame) -> range:
        """Append documents; their ids, contiguous and in input order."""
        if isinstance(docs, DataFrame):
            return self._change("insert", lambda m: self._append_df(m, docs))
        rows = [self.registry.encode(d) for d in docs]
        if not rows:
            return range(0)

        def step(m: Manifest) -> tuple[Manifest, range]:
            ids = range(m.next_id, m.next_id + len(rows))
            m, df = self._evolved(m, [{"_id": i} | {k: v for k, v in r.items() if k != "_id"} for i, r in zip(ids, rows)])
            return self._added(m, df, ids.start, ids.stop - 1, len(ids)), ids

        return self._change("insert", step)

    def _append_df(self, m: Manifest, df: DataFrame) -> tuple[Manifest | None, range]:
        """Ids follow the order of partitions and rows. Rows are written once, then numbered from what was written."""
        staged = self.store.write(df.drop("_id").withColumn("__at", F.monotonically_increasing_id()), clear="__at")
        if not staged:
            return None, range(0)
        schema = T.StructType([*df.drop("_id").schema, T.StructField("__at", T.LongType())])
        rows = self.store.read(advanced(m, schema=schema.json()), staged, clear="__at")
        part = F.shiftright("__at", 33)
        sizes = rows.groupBy(part.alias("p")).count().orderBy("p").collect()
        offsets, at = [], m.next_id
        for r in sizes:
            offsets.append((r["p"], at))
            at += r["count"]
        known = self.spark.createDataFrame(offsets, "p long, first long")
        numbered = rows.join(F.broadcast(known), part == F.col("p")).select((F.col("first") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("_id"), *map(quoted, df.drop("_id").columns))
        schema = codec.merged(m.struct, numbered.schema)
        m = self._with_schema(m, schema)
        after = self._added(m, self._as(numbered, m.struct), m.next_id, at - 1, at - m.next_id)
        self.store.discard(staged)
        return after, range(m.next_id, at)

    def _added(self, m: Manifest, df: DataFrame, low: int, high: int, n: int) -> Manifest:
        files = self._write(m, df)
        return advanced(m, files=m.files + files, keys=m.keys | dict.fromkeys(files, (low, high)), next_id=max(m.next_id, high + 1), live=m.live + n if m.live >= 0 else -1)

    def put(self, key: int, doc: Any) -> int:
        """Store a document under a key, in place of any other."""
        self.put_all({key: doc})
        return key

    def put_all(self, docs: dict[int, Any] | DataFrame) -> None:
        """Store documents under their keys: a dict, or a DataFrame with ``_id`` of any size, each key once."""
        if isinstance(docs, DataFrame):
            return self._change("put", lambda m: self._put_df(m, docs))
        if not docs:
            return
        if min(docs) < 1:
            raise ValueError("keys start at 1")
        rows = [{"_id": int(k)} | {f: v for f, v in self.registry.encode(d).items() if f != "_id"} for k, d in docs.items()]

        def step(m: Manifest) -> tuple[Manifest, None]:
            m, new = self._evolved(m, rows)
            return self._replaced(m, new, min(docs), max(docs), len(rows)), None

        self._change("put", step)

    def _put_df(self, m: Manifest, df: DataFrame) -> tuple[Manifest | None, None]:
        df = df.withColumn("_id", F.col("_id").cast("long"))
        seen = df.agg(F.count("*"), F.count("_id"), F.countDistinct("_id"), F.min("_id"), F.max("_id")).first()
        if not seen[0]:
            return None, None
        if not seen[0] == seen[1] == seen[2]:
            raise ValueError("each row needs a key of its own")
        if seen[3] < 1:
            raise ValueError("keys start at 1")
        m = self._with_schema(m, codec.merged(m.struct, df.schema))
        return self._replaced(m, self._as(df, m.struct), seen[3], seen[4], seen[0]), None

    def _replaced(self, m: Manifest, new: DataFrame, low: int, high: int, n: int) -> Manifest:
        """``new`` in place of what has its keys: an anti-join over the files that hold any of them."""
        files = self._write(m, new)
        keys = self.store.read(m, files).select("_id")
        near = m.holding(low, high)
        m, gone = self._rewrite(m, near, lambda df: df.join(keys, "_id", "left_semi"), lambda df: df.join(keys, "_id", "left_anti"))
        m = advanced(m, files=m.files + files, keys=m.keys | dict.fromkeys(files, (low, high)), next_id=max(m.next_id, high + 1))
        return advanced(m, live=m.live + n - gone if m.live >= 0 else -1, dead=m.dead + gone)

    def update(self, key: int, fields: dict[str, Any]) -> bool:
        """Merge fields into one document, top level only; whether there is one."""
        return self._update(lambda m: Hits(F.col("_id") == key, near=m.holding(key, key)), fields) > 0

    def update_where(self, q: Filter, fields: dict[str, Any]) -> int:
        """Merge fields into all matching documents in one version; how many."""
        return self._update(self._hits(q), fields)

    def _update(self, hits: Callable[[Manifest], Hits], fields: dict[str, Any]) -> int:
        values = {k: codec.normal(v) for k, v in fields.items() if k != "_id"}

        def step(m: Manifest) -> tuple[Manifest | None, int]:
            wanted = hits(m)
            near = m.files if wanted.near is None else wanted.near
            old = m.struct
            seen = T.StructType([T.StructField(k, codec.type_of(v)) for k, v in values.items() if v is not None or k not in old.names])
            m, widened = self._grown(m, codec.merged(old, storable(seen)))
            kinds = {f.name: f.dataType for f in m.struct}

            def change(df: DataFrame) -> DataFrame:
                # hits are found among the fields as they were, then these take their new types
                marked = wanted.marked(df)
                typed = self._as(marked, T.StructType([*m.struct.fields, T.StructField(Hits.MARK, T.BooleanType())]))
                new = [F.when(F.col(Hits.MARK), literal(values[f], kinds[f])).otherwise(F.col(quoted(f))).alias(f) if f in values else F.col(quoted(f)) for f in kinds]
                return typed.select(*new)

            after, n = self._rewrite(m, near, wanted.only, change, schema=old, everything=widened)
            return (advanced(after, dead=after.dead + n) if n else None), n

        return self._change("update", step)

    def delete(self, key: int) -> bool:
        return self._delete(lambda m: Hits(F.col("_id") == key, near=m.holding(key, key))) > 0

    def delete_where(self, q: Filter) -> int:
        return self._delete(self._hits(q))

    def _delete(self, hits: Callable[[Manifest], Hits]) -> int:
        def step(m: Manifest) -> tuple[Manifest | None, int]:
            wanted = hits(m)
            after, n = self._rewrite(m, m.files if wanted.near is None else wanted.near, wanted.only, wanted.others)
            return (advanced(after, live=after.live - n if after.live >= 0 else -1, dead=after.dead + n) if n else None), n

        return self._change("delete", step)

    def _hits(self, q: Filter) -> Callable[[Manifest], Hits]:
        """What a query finds, in the state that a change starts from; one with skip or limit is a table of keys."""

        def found(m: Manifest) -> Hits:
            query = q(Query(self.store.read(m)))
            if query.skipped or query.limited is not None:
                return Hits(keys=query.ids())
            wanted = query.column()
            return Hits(F.lit(True) if wanted is None else wanted)

        return found

    def _rewrite(
        self, m: Manifest, near: tuple[str, ...], only: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None, everything: bool = False,
    ) -> tuple[Manifest, int]:
        """Rewrite the files that hold wanted rows, ``near`` being those that may, or all files; how many rows were wanted.

        ``schema``: what the files have, where the state has gone on to another.
        """
        if not near:
            return m, 0
        read = lambda files: self.store.read(m if schema is None else advanced(m, schema=schema.json()), files)
        # one row for each file that is rewritten, and its name is what the manifest holds
        found = only(read(near).withColumn(Hits.FILE, F.input_file_name())).groupBy(Hits.FILE).count().collect()
        if not found:
            return m, 0
        files = m.files if everything else tuple("/".join(r[0].split("/")[-3:]) for r in found)
        new = self._write(m, change(read(files)))
        spans = [m.keys.get(f) for f in files]
        keys = m.keys | (dict.fromkeys(new, (min(s[0] for s in spans), max(s[1] for s in spans))) if all(spans) else {})
        return advanced(m, files=tuple(f for f in m.files if f not in set(files)) + new, keys=keys), sum(r[1] for r in found)

    def _write(self, m: Manifest, df: DataFrame) -> tuple[str, ...]:
        return self.store.write(df, layout.options(self._declared(m)))

    # schema

    def _evolved(self, m: Manifest, rows: list[dict]) -> tuple[Manifest, DataFrame]:
        seen = T.StructType([KEY])
        for r in rows:
            seen = codec.merged(seen, T.StructType([T.StructField(k, codec.type_of(v)) for k, v in r.items()]))
        # a field only ever null takes the type that it has
        schema = storable(codec.merged(m.struct, seen))
        m = self._with_schema(m, schema)
        variants = [f.name for f in m.struct if isinstance(f.dataType, T.VariantType)]
        plain = T.StructType([T.StructField(f.name, T.StringType() if f.name in variants else f.dataType) for f in m.struct])
        data = [tuple(codec.fitted(r.get(f.name), f.dataType) for f in m.struct) for r in rows]
        df = self.spark.createDataFrame(data, plain).coalesce(1 + len(data) // 100_000)
        return m, df.select(*[F.parse_json(quoted(f)).alias(f) if f in variants else F.col(quoted(f)) for f in m.struct.names])

    def _grown(self, m: Manifest, schema: T.StructType) -> tuple[Manifest, bool]:
        """The state under a wider schema, and whether files must be rewritten: for changed types, not for new fields."""
        schema = storable(T.StructType([KEY] + [f for f in schema if f.name != "_id"]))
        if schema == m.struct:
            return m, False
        return advanced(m, schema=schema.json()), any(f.name in schema.names and schema[f.name].dataType != f.dataType for f in m.struct)

    def _with_schema(self, m: Manifest, schema: T.StructType) -> Manifest:
        """The state under a wider schema, with its files."""
        after, changed = self._grown(m, schema)
        if changed and m.files:
            files = self._write(after, self._as(self.store.read(m), after.struct))
            spans = [m.keys.get(f) for f in m.files]
            keys = dict.fromkeys(files, (min(s[0] for s in spans), max(s[1] for s in spans))) if all(spans) else {}
            after = advanced(after, files=files, keys=keys)
        return after

    @staticmethod
    def _as(df: DataFrame, schema: T.StructType) -> DataFrame:
        def column(f: T.StructField) -> Column:
            if f.name not in df.columns:
                return F.lit(None).cast(f.dataType).alias(f.name)
            if df.schema[f.name].dataType == f.dataType:
                return F.col(quoted(f.name))
            if isinstance(f.dataType, T.VariantType) and isinstance(df.schema[f.name].dataType, T.StructType | T.ArrayType | T.MapType):
                return F.to_variant_object(quoted(f.name)).alias(f.name)
            return F.col(quoted(f.name)).cast(f.dataType).alias(f.name)

        return df.select(*[column(f) for f in schema])

    def _migrate(self, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> None:
        def step(m: Manifest) -> tuple[Manifest | None, None]:
            if m.schema_version >= version:
                return None, None
            df = self.store.read(m)
            for v in range(m.schema_version, version):
                df = steps[v](df) if v in steps else df
            m = advanced(m, schema_version=version)
            if not m.files or not any(v in steps for v in range(1, version)):
                return m, None
            m = advanced(m, schema=T.StructType([KEY] + [f for f in df.schema if f.name != "_id"]).json())
            return advanced(m, files=self._write(m, df.select(*[F.col(quoted(n)) for n in m.struct.names])), keys={}, live=-1), None

        self._change("migrate", step)

    # indexes and upkeep

    @staticmethod
    def _declared(m: Manifest) -> list[layout.Index]:
        return [layout.Index(i["kind"], tuple(i["fields"])) for i in m.indexes]

    def indexes(self) -> list[layout.Index]:
        return self._declared(self._state())

    def _add(self, index: layout.Index) -> None:
        self._change("index", lambda m: (None, None) if index in self._declared(m) else (advanced(m, indexes=(*m.indexes, index.to_json())), None))

    def add_index(self, name: str) -> None:
        self._add(layout.Index.of("hash", name))

    def add_sorted_index(self, name: str) -> None:
        self._add(layout.Index.of("sorted", name))

    def add_bitmap_index(self, name: str) -> None:
        self._add(layout.Index.of("bitmap", name))

    def add_composite_index(self, names: list[str]) -> None:
        self._add(layout.Index.of("composite", *names))

    def add_fts_index(self, name: str) -> None:
        self._add(layout.Index.of("fts", name))

    def reindex(self, name: str | None = None) -> None:
        """Lay the files out as the indexes ask and build the inverted tables."""
        if name is not None and name not in {i.name for i in self.indexes()} | {i.fields[0] for i in self.indexes()}:
            raise ValueError(f"no index: {name}")
        self.compact()

    def compact(self, files: int | None = None, vacuum: bool = False, grace: float = 3600.0) -> None:
        """Rewrite the documents in the order of the indexes; with ``vacuum`` drop what earlier versions alone use, but for
        data younger than ``grace`` seconds."""

        def step(m: Manifest) -> tuple[Manifest | None, None]:
            if not m.files:
                return None, None
            declared = self._declared(m)
            m = advanced(m, files=self._write(m, layout.arranged(self.store.read(m), declared, files)), dead=0)
            sizes = self.store.read(m).groupBy(F.input_file_name()).agg(F.min("_id"), F.max("_id"), F.count("*")).collect()
            m = advanced(m, keys={"/".join(r[0].split("/")[-3:]): (r[1], r[2]) for r in sizes}, live=sum(r[3] for r in sizes))
            tables = {}
            for i in declared:
                if i.kind == "fts" and i.fields[0] in m.struct.names and self.store.key is None:
                    # by hash: ranges would be drawn from a first pass over all texts
                    table = fts.postings(self.store.read(m), i.fields[0]).repartition("token").sortWithinPartitions("token", "_id")
                    names = self.store.write(table, {"parquet.bloom.filter.enabled#token": "true"})
                    if names:
                        tables[i.fields[0]] = (names[0].rsplit("/", 1)[0], m.files)
            return advanced(m, postings=tables), None

        self._change("compact", step)
        if vacuum and self._work is None:
            self.store.vacuum(self._state(), grace)

    def flush(self) -> None:
        """Nothing waits to be written: a change is durable when it returns."""
        self._state()

    checkpoint = flush

    def import_json(self, paths: str | list[str]) -> range:
        """Insert the documents of JSON files, one object a line; their ids. A line that is no object is an error."""
        df = self.spark.read.option("mode", "FAILFAST").json(paths)
        return self.insert_all(df) if df.columns else range(0)

    def export_json(self, path: str) -> None:
        """Write the documents, one JSON object a line."""
        self.df().write.json(path)

    def statistics(self) -> DataFrame:
        """field, rows, nulls, distinct (approximate), least and greatest of every field of the current version."""
        m = self._state()
        return aggregates.statistics(self.store.read(m), list(m.struct.names))

    def describe(self) -> DataFrame:
        """field, rows, nulls, distinct of every indexed field."""
        m = self._state()
        fields = [f for i in self._declared(m) for f in i.fields if f in m.struct.names and isinstance(m.struct[f].dataType, T.AtomicType)]
        return layout.describe(self.store.read(m), list(dict.fromkeys(fields)))


@dataclass(frozen=True)
class Hits:
    """Documents that a change is about: those of a condition, or of a table of keys. near: files that may hold them."""

    FILE: ClassVar[str] = "__file"
    MARK: ClassVar[str] = "__hit"
    wanted: Column | None = None
    keys: DataFrame | None = None
    near: tuple[str, ...] | None = None

    def only(self, df: DataFrame) -> DataFrame:
        return df.where(self.wanted) if self.keys is None else df.join(self.keys, "_id", "left_semi")

    def others(self, df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce(self.wanted, F.lit(False))) if self.keys is None else df.join(self.keys, "_id", "left_anti")

    def marked(self, df: DataFrame) -> DataFrame:
        if self.keys is None:
            return df.withColumn(self.MARK, F.coalesce(self.wanted, F.lit(False)))
        return df.join(self.keys.withColumn(self.MARK, F.lit(True)), "_id", "left").withColumn(self.MARK, F.coalesce(self.MARK, F.lit(False)))


def storable(schema: T.StructType) -> T.StructType:
    """Fields whose type holds a variant inside become variants as a whole; fields only ever null are left out."""

    def mixed(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return mixed(kind.elementType)
        if isinstance(kind, T.StructType):
            return any(mixed(f.dataType) for f in kind)
        return isinstance(kind, T.VariantType)

    return T.StructType([T.StructField(f.name, T.VariantType() if mixed(f.dataType) else codec.settled(f.dataType), f.nullable) for f in schema if not isinstance(f.dataType, T.NullType)])


def literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(codec.fitted(value, kind)))
    if isinstance(value, dict | list):
        return F.from_json(F.lit(json.dumps(codec.fitted(value, kind))), kind)
    if isinstance(value, bytes):
        return F.lit(bytearray(value))
    return F.lit(value).cast(kind)
