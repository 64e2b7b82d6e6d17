"""Incremental keyed loading of landed payload files.

A scheduled loader that re-fetches a trailing window and upserts it maps
onto Structured Streaming: newly landed payload files are read as a file
stream, unnested (S3) and upserted (K5) into a keyed table from
``foreachBatch`` (a ``KeyedTable``, or a table of a ``TableStore``).  ``trigger(availableNow=True)`` processes whatever has
landed and stops, which is how a daily job runs it.

The upsert is idempotent: a batch that is replayed after a failure, or files
that are read again under a new stream checkpoint, write the same keys once
more and leave the same table, so no batch is ever skipped.  Inside one batch
a key that appears in several files keeps the row of the most recently
modified file (last landed load wins), so an incoming batch is always unique
on the key.  The stream checkpoint is the caller's to name: it has to live in
storage that survives the application.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablework.functions.columns import load_time
from tablework.operators.windows import latest_per_key
from tablework.sinks.keyed import KeyedTable
from tablework.sinks.store import TableStore
from tablework.sources.json_scan import unnest_items

# Layout of an item payload file (one JSON object per line).
ITEM_PAYLOAD_SCHEMA = (
    "article string, items array<struct<project: string, article: string, granularity: string, "
    "timestamp: string, access: string, agent: string, views: long>>"
)


def upsert_batch(
    store: TableStore | KeyedTable,
    table: str,
    batch: DataFrame,
    keys: Sequence[str],
    request_cols: Sequence[str] = ("article",),
    loaded_at: str | None = None,
) -> bool:
    """Upsert one micro-batch of landed payload rows (``batch`` carries the
    ``__mtime``/``__file`` metadata columns).  Returns False when the batch
    has no items."""
    stamp = loaded_at or load_time()
    rows = unnest_items(batch, [*request_cols, "__mtime", "__file"], stamp)
    rows = latest_per_key(rows, list(keys), [F.col("__mtime").desc(), F.col("__file").desc()]).drop("__mtime", "__file")
    if rows.isEmpty():
        return False
    if isinstance(store, KeyedTable):
        store.upsert(rows)
    else:
        store.upsert(table, rows, keys)
    return True


def stream_upsert(
    spark: SparkSession,
    landing_dir: str,
    store: TableStore | KeyedTable,
    table: str,
    keys: Sequence[str],
    checkpoint: str,
    payload_schema: StructType | str = ITEM_PAYLOAD_SCHEMA,
    request_cols: Sequence[str] = ("article",),
    max_files_per_trigger: int | None = None,
    loaded_at: str | None = None,
) -> int:
    """Run the incremental load until all landed files are processed.
    Returns the number of micro-batches committed in this run.
    ``loaded_at`` fixes the load time (default: now, one value per batch)."""
    reader = spark.readStream.schema(payload_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(landing_dir).select("*", F.col("_metadata.file_modification_time").alias("__mtime"), F.col("_metadata.file_path").alias("__file"))
    committed = []

    def process(batch: DataFrame, batch_id: int) -> None:
        if upsert_batch(store, table, batch, keys, request_cols, loaded_at):
            committed.append(batch_id)

    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(committed)
