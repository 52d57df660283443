"""Versioned snapshots: immutable Parquet files and a manifest for each version, which is the change feed as well.

A version is published by naming its manifest, whole, which fails if another writer was first. Readers pin a version. A
change rewrites only the files that hold touched rows. A manifest knows the range of keys of each file, so that a key
opens the files that may hold it and no others.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.sealed import seal, unseal
from folio.operators.fields import quoted

KEY = T.StructField("_id", T.LongType(), False)


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    files: tuple[str, ...] = ()
    schema: str = field(default_factory=lambda: T.StructType([KEY]).json())
    next_id: int = 1
    schema_version: int = 1
    indexes: tuple[dict, ...] = ()
    #: inverted tables by field, with the files whose rows they cover
    postings: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    #: the least and the greatest key that a file may hold; a file that is not here may hold any
    keys: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: documents, and how many were deleted or replaced since the files were last compacted; -1: not known
    live: int = 0
    dead: int = 0
    #: what the version changed
    kinds: tuple[str, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def holding(self, low: int, high: int) -> tuple[str, ...]:
        """The files that may hold keys from low to high."""
        every = (low, high)
        return tuple(f for f in self.files if self.keys.get(f, every)[0] <= high and self.keys.get(f, every)[1] >= low)


class Store:
    """A folder of snapshots on a file system that Spark reaches and that renames without overwriting, as HDFS does.

    With a key every data file holds ciphertext but for ``_id``.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in ("manifest", "data"):
            self._fs.mkdirs(self._at(name))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _local(self, name: str) -> str | None:
        return os.path.join(self._root.toUri().getPath(), name) if self._fs.getScheme() == "file" else None

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int | None = None) -> Manifest:
        if version is None:
            known = self.versions()
            if not known:
                return Manifest()
            version = known[-1]
        stream = self._fs.open(self._at(f"manifest/v{version:012d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found = json.loads(text)
        lists = {k: tuple(found[k]) for k in ("files", "indexes")}
        return Manifest(
            **lists, **{k: found[k] for k in ("version", "schema", "next_id", "schema_version")}, postings={k: (v[0], tuple(v[1])) for k, v in found["postings"].items()},
            keys={k: tuple(v) for k, v in found.get("keys", {}).items()}, live=found.get("live", -1), dead=found.get("dead", 0), kinds=tuple(found.get("kinds", ())),
        )

    def publish(self, m: Manifest, kinds: list[str]) -> None:
        """Make ``m`` the next version, or raise Conflict. Readers see all of a manifest or none of it."""
        used = set(m.files)
        text = json.dumps(vars(m) | {"kinds": kinds, "keys": {f: k for f, k in m.keys.items() if f in used}})
        name = f"manifest/v{m.version:012d}.json"
        part = f"{name}.{uuid.uuid4().hex}"
        local = self._local(name)
        if local:
            with open(self._local(part), "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(self._local(part), local)  # all or nothing, and only if absent
            except FileExistsError as e:
                raise Conflict(name) from e
            finally:
                os.unlink(self._local(part))
            return
        out = self._fs.create(self._at(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            done = not self._fs.exists(self._at(name)) and self._fs.rename(self._at(part), self._at(name))
        except Exception as e:
            if self._fs.exists(self._at(name)):
                raise Conflict(name) from e
            raise
        if not done:
            self._fs.delete(self._at(part), False)
            raise Conflict(name)

    def read(self, m: Manifest, files: tuple[str, ...] | None = None, clear: str = "_id") -> DataFrame:
        files = m.files if files is None else files
        if not files:
            return self.spark.createDataFrame([], m.struct)
        paths = [f"{self.path}/{f}" for f in files]
        if self.key is None:
            return self.spark.read.schema(m.struct).parquet(*paths)
        rest = T.StructType([f for f in m.struct if f.name != clear])
        return unseal(self.spark.read.schema(f"{clear} long, sealed binary").parquet(*paths), self.key, rest, clear).select(*[F.col(quoted(n)) for n in m.struct.names])

    def write(self, df: DataFrame, options: dict[str, str] | None = None, clear: str = "_id") -> tuple[str, ...]:
        """Write rows to new files; their names under the folder."""
        name = f"data/{uuid.uuid4().hex}"
        if self.key is not None:
            df = seal(df, self.key, clear)
        df.write.options(**(options or {})).parquet(f"{self.path}/{name}")
        return tuple(sorted(f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(self._at(name)) if s.getPath().getName().endswith(".parquet") and s.getLen() > 0))

    def discard(self, files: tuple[str, ...]) -> None:
        """Delete files that no version has named."""
        for name in {f.rsplit("/", 1)[0] for f in files}:
            self._fs.delete(self._at(name), True)

    def vacuum(self, keep: Manifest, grace: float = 3600.0) -> int:
        """Delete data that this version doesn't use, and the manifests before it; how many folders went.

        Folders younger than ``grace`` seconds stay: another writer may be about to publish them.
        """
        used = {f.split("/")[1] for f in keep.files} | {p.split("/")[1] for p, _ in keep.postings.values()}
        gone, now = 0, time.time() * 1000
        for s in list(self._fs.listStatus(self._at("data"))):
            if s.getPath().getName() not in used and now - s.getModificationTime() >= grace * 1000:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in self.versions():
            if v < keep.version:
                self._fs.delete(self._at(f"manifest/v{v:012d}.json"), False)
        return gone


def advanced(m: Manifest, **changes) -> Manifest:
    return replace(m, **changes)
