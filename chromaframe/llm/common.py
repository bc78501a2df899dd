"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_folder

__all__ = ["fresh", "giving_back", "kept", "materialise", "shared_folder", "shuffle_partitions", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, or an empty string where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(frames: DataFrame | list[DataFrame], *names: str) -> list[str]:
    """Names for internal columns that no column of the given tables has, in any case of letters."""
    taken = {c.lower() for df in ([frames] if isinstance(frames, DataFrame) else frames) for c in df.columns}
    out = []
    for name in names:
        out.append(next(n for n in (f"_{name}{k or ''}" for k in count()) if n.lower() not in taken))
        taken.add(out[-1].lower())
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of the table that it stems from for each file of an intermediate table.
FILE_ROWS = 10_000


def kept(df: DataFrame, rows: int) -> DataFrame:
    """materialise(), in fewer files than there are shuffle partitions if the table that df stems from has few rows; at least one
    for each core."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return materialise(df.coalesce(n) if n < shuffle_partitions(df.sparkSession) else df)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a worker serves many tasks and stages, so what one of them has freed goes back to the system at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped
