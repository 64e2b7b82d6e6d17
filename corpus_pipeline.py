"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read again as the next stage's ``docs``.

1. toxicity: documents that the nearest labelled examples score as toxic go;
2. exact dedup: of equal texts (A-Z lower-cased) the largest ``doc_id`` stays;
3. near duplicates: of each component of the 5-word-shingle join at a
   similarity of 0.75 the smallest ``doc_id`` stays;
4. secret scan: secrets in the texts are replaced by a mask;
5. packing: the remaining texts are packed into sequences of 2048 ids, one row
   per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablework.llm import content_sort, packing, parity_join, secret_scan, toxicity
from tablework.llm.common import materialise, table
from tablework.llm.queries import tokenizer_file


def small_batches(spark: SparkSession) -> None:
    """Settings of this job: every stage hands whole texts to Python tasks, so
    an Arrow batch is bounded by bytes (4 MB, one row at least), not by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return content_sort.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return parity_join.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), keep=False, cached=100_000, slice_bytes=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_duplicates", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The stages hold a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
