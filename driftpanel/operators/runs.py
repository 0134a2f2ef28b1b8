"""Rolling windows split by time. A series' history is cut into runs of dates that overlap by a
window, so that a few long series still fill many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 256


def chunk_of(window: int, chunk: int = CHUNK) -> int:
    """Dates in a run: enough that the overlap is a quarter at most."""
    return max(chunk, 4 * window)


def in_runs(df: DataFrame, window: int, chunk: int) -> DataFrame:
    """``df`` with ``run``: each row once for its own run and once for each that it leads into."""
    first, last = (F.floor((F.col("time_idx") + k) / chunk).cast("int") for k in (0, window - 1))
    return df.withColumn("run", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, chunk: int) -> DataFrame:
    """Each row in its own run only, where its window is whole."""
    return df.filter(F.floor(F.col("time_idx") / chunk) == F.col("run")).drop("run")
