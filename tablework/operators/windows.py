"""Window operators.

``latest_per_key`` is a ``row_number() = 1`` filter over a key window.
Catalyst rewrites that shape into a ``WindowGroupLimit``: a *partial*
limit runs before the shuffle, so every map task sends at most one row
per key.  A hot key holding a third of the table therefore ships one row
per input partition, not a third of the table, to a single reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.columns import split_first

_RN = "__tw_rn"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per ``keys`` under ``order``.

    ``order`` must end in a unique tie-break so the pick is deterministic,
    e.g. ``[F.col('version').desc_nulls_last(), F.col('id').desc()]``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    cols = df.columns
    return df.select(*cols, F.row_number().over(w).alias(_RN)).where(F.col(_RN) == 1).select(*cols)


# Terminal run states of the reference.
SUCCESS_STATES = ("RUN_STATUS_SUCCEEDED",)
FAILURE_STATES = ("RUN_STATUS_FAILED", "RUN_STATUS_CANCELLED")


def latest_run(runs: DataFrame, key: str, run_number: str, status: str) -> DataFrame:
    """Latest run per ``key``.

    The reference keeps ``run_number || '|' || status`` and splits it at
    the first ``|``; we do the same so a status that itself contains ``|``
    survives.  ``outcome`` is ``succeeded`` / ``failed`` for terminal
    states and ``running`` otherwise.
    """
    tagged = runs.select(key, F.concat_ws("|", F.col(run_number).cast("string"), F.col(status)).alias("run_tag"), run_number)
    latest = latest_per_key(tagged, [key], [F.col(run_number).desc_nulls_last()])
    head, rest = split_first(F.col("run_tag"), "|")
    return latest.select(
        key,
        head.cast("bigint").alias("run_number"),
        rest.alias("status"),
        F.when(rest.isin(*SUCCESS_STATES), F.lit("succeeded"))
        .when(rest.isin(*FAILURE_STATES), F.lit("failed"))
        .otherwise(F.lit("running"))
        .alias("outcome"),
    )
