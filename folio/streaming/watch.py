"""Listeners on a collection's change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.operators.fields import resolve
from folio.sources.collection import Collection

_MANIFEST = "version long, kinds array<string>"


def changes(collection: Collection) -> DataFrame:
    """The change feed as a stream: version and kind of every published change, read from the manifests themselves."""
    found = collection.spark.readStream.schema(_MANIFEST).option("pathGlobFilter", "v*.json").option("ignoreMissingFiles", "true").json(f"{collection.store.path}/manifest")
    return found.select("version", F.explode("kinds").alias("kind"))


def watch(collection: Collection, field: str, listener: Callable[[int, DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``listener(version, ids)`` after changes, with the ids of all documents whose field is not null.

    A micro-batch of several changes is one call, with the newest version in it. Each change is delivered once for a
    checkpoint folder, over restarts too. ``once`` handles what there is and stops. An unknown field counts for every
    document.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max("version")).first()[0]
        if newest is None:
            return
        df = collection.df(newest)
        known = df.where(resolve(df.schema, field).known) if field in df.columns else df
        listener(newest, known.select("_id").orderBy("_id"))

    writer = changes(collection).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
