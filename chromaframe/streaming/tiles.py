"""Tile updates: the last write of a pixel wins, in batch and as a stream.

There is no event time: order is the sequence number. A stream keeps its result in a table of its batches instead of
a state store, so state is not bounded by memory. Nothing is kept on the driver, so a stream goes on after a restart, and a
batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def last_write(tiles: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def fitting(tiles: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Tiles (x, y, w, h) of known images (width, height) that lie wholly inside; others are dropped, not clipped."""
    known = tiles.join(sizes, by)
    return known.where("x >= 0 and y >= 0 and x + w <= width and y + h <= height and size(data) >= w * h").drop("width", "height")


def explode_tiles(tiles: DataFrame) -> DataFrame:
    """One row per pixel of tiles (..., x, y, w, h, data)."""
    other = [c for c in tiles.columns if c not in ("x", "y", "w", "h", "data")]
    pixels = tiles.select(*other, "x", "y", "w", "h", F.posexplode("data").alias("k", "value")).where("k < w * h")
    return pixels.select(*other, (F.col("x") + F.col("k") % F.col("w")).cast("int").alias("x"), (F.col("y") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("y"), F.col("value").cast("double").alias("value"))


class TileTable:
    """The latest value of each key under a folder: what each batch of the stream has brought, and from time to time a
    base that stands for all batches up to one.

    A batch writes its own newest values only, into a folder named by its number; reading takes the newest base and the
    batches after it. Of equal orders the later batch wins.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, value: str) -> None:
        self.spark, self.folder, self.keys, self.order, self.value = spark, folder, keys, order, value

    def _newest(self, rows: DataFrame) -> DataFrame:
        rank = F.struct(self.order, "batch_id")
        return rows.groupBy(*self.keys).agg(F.max_by(self.value, rank).alias(self.value), F.max(rank).alias("_rank")).select(*self.keys, self.value, f"_rank.{self.order}", "_rank.batch_id")

    def _numbers(self, kind: str) -> list[int]:
        """Batches or bases whose writers have committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [status.getPath() for status in system.listStatus(path)]
        done = [p.getName() for p in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n) for n in done if n.isdigit())

    def _parts(self, through: int | None = None) -> list[str]:
        bases = [n for n in self._numbers("base") if through is None or n <= through]
        after = [n for n in self._numbers("batch") if (not bases or n > bases[-1]) and (through is None or n <= through)]
        return [f"{self.folder}/base/{n}" for n in bases[-1:]] + [f"{self.folder}/batch/{n}" for n in after]

    def read(self) -> DataFrame | None:
        """Keys, value and order, or nothing before the first batch."""
        parts = self._parts()
        return self._newest(self.spark.read.parquet(*parts)).drop("batch_id") if parts else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Give to foreachBatch."""
        rows = batch.select(*self.keys, self.order, self.value, F.lit(batch_id).cast("long").alias("batch_id"))
        self._newest(rows).write.mode("overwrite").parquet(f"{self.folder}/batch/{batch_id}")

    def compact(self, through: int) -> None:
        """Write a base for all batches up to one that has been committed; those may then be deleted."""
        parts = self._parts(through)
        if len(parts) > 1:
            self._newest(self.spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{self.folder}/base/{through}")


def replay_tiles(spark: SparkSession, tiles: DataFrame, keys: tuple[str, ...] = ("image_id", "channel", "x", "y")) -> DataFrame:
    """Tiles through a file stream in several batches until all are read; the result is that of last_write."""
    shared = shared_folder(spark, "tiles")
    tiles.repartition(4).write.parquet(f"{shared}/in")
    table = TileTable(spark, f"{shared}/table", list(keys), "seq", "value")
    stream = spark.readStream.schema(tiles.schema).option("maxFilesPerTrigger", 2).parquet(f"{shared}/in")
    stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{shared}/progress").trigger(availableNow=True).start().awaitTermination()
    return table.read().select(*keys, "value")


def loaded_in_order(arrivals: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Rows that can be published: the gap-free prefix of the identifiers of each group."""
    from ..operators.catalog import contiguous_prefix

    return contiguous_prefix(arrivals, by, ident)


def watch_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files of a folder as they appear, each once: path, modificationTime, length, content."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def sticky_selectors(lines: DataFrame, by: list[str], order: str = "n", line: str = "line") -> DataFrame:
    """Paths of each stream of lines with the selector in force: a line ':selector' sets it for those that follow, blank lines are skipped."""
    from pyspark.sql import Window

    text = F.trim(F.col(line))
    selector = F.when(text.startswith(":"), F.substring(text, 2, 1 << 30))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.where(text != "").withColumn("selector", F.coalesce(F.last(selector, ignorenulls=True).over(w), F.lit("")))
    return rows.where(~text.startswith(":")).select(*by, order, text.alias("path"), "selector")
