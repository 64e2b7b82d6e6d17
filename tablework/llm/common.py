"""Helpers shared by the corpus operators.

Words are runs of bytes other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``); on UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The characters that separate words (fixed values).
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_LOWER_TABLE = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs; other columns cannot clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ascii_lower_bytes(text: bytes) -> bytes:
    return text.translate(_LOWER_TABLE)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its
    own; on a cluster a missing setting is an error, because executors do not
    see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tablework-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tablework-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """While this holds, Spark hands texts to Python tasks in Arrow batches of
    about ``size`` bytes (one row at least) instead of many rows at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release_memory() -> None:
    """Give a task's freed memory back to the system; Python workers outlive
    their tasks, and what they keep is missing in the stages that follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc; others return it themselves
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text", max_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``max_bytes`` of text (one row at
    least, however long) and hand out each slice with its texts as bytes."""
    for batch in batches:
        column = batch.column(text_col)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
        i, n = 0, batch.num_rows
        while i < n:
            total, j = int(sizes[i]), i + 1
            while j < n and total + int(sizes[j]) <= max_bytes:
                total += int(sizes[j])
                j += 1
            part = batch.slice(i, j - i)
            yield part, [x or b"" for x in part.column(text_col).cast(pa.binary()).to_pylist()]
            i = j
    release_memory()


def map_texts(df: DataFrame, fn: Callable[[list, list[bytes]], dict[str, object]], schema: str, id_col: str = "doc_id", max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over (id, text): ``fn(ids, texts)`` returns the output
    columns of a slice.  No shuffle; memory is one slice of texts."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, max_bytes=max_bytes):
            out = fn(part.column(id_col).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def crc32_text(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def range_splitters(keyed: DataFrame, key: Column, parts: list[str], ranges: int, rows: int, per_range: int = 64) -> list[dict]:
    """Borders of ``ranges`` ranges of about equally many rows: quantiles of a
    sample chosen by the hash of ``parts``, so equal rows give equal borders."""
    if ranges < 2 or not rows:
        return []
    chance = F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) <= int(min(1.0, per_range * ranges / rows) * (1 << 30))
    keys = keyed.where(chance).agg(F.sort_array(F.collect_list(key)).alias("ks"))
    step = F.size("ks") / F.lit(float(ranges))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("ks", F.floor(i * step).cast("int")))
    return [r.asDict() for r in keys.select(at.alias("s")).first().s if r is not None]


def range_number(borders: list[dict], key_type: str, key: Column) -> Column:
    """How many borders are at or below ``key``: binary search over a literal."""
    if not borders:
        return F.lit(0)
    literal = F.from_json(F.lit(json.dumps(borders)), f"array<{key_type}>")
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(literal, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


#: Ids are broadcast only while all of them fit this; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def join_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi", column: str | list[str] = "doc_id") -> DataFrame:
    """Semi or anti join of ``docs`` with a written table of long ids (or of a
    few narrow key columns)."""
    if 16 * len(ids.columns) * ids.count() <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return docs.join(ids, column, how)


def join_side(docs: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join ``docs`` with a table that has a row for some of them.  It is
    written first; while its files are small it is broadcast, else both sides
    are shuffled on ``on``."""
    side = materialise(side, "side")
    files = side.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).distinct()
    stored = files.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    return docs.join(F.broadcast(side) if 4 * stored <= BROADCAST_BYTES else side, on, how)


def sample_rows(docs: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct rows of (doc_id, text), by the smallest hashes: the
    hashes are chosen first, so that only the chosen texts move."""
    hashed = docs.withColumn("_h", F.xxhash64("doc_id", "text"))
    chosen = hashed.select("_h").orderBy("_h").limit(n)
    return hashed.join(F.broadcast(chosen), "_h", "left_semi").dropDuplicates(["_h"]).drop("_h")
