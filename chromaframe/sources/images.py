"""Image files as pixel tables, and pixel tables as image files.

Files are scanned by Spark's binaryFile source, so any store that Spark reads will do, and decoded where their
bytes are. Channels that are not asked for are dropped before rows are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.names import natural_key
from ..schema import READER
from ..storage import numbered
from . import formats

#: Media types by preference. Fixed values.
MEDIA_TYPES = ("image/x-exr", "image/png", "image/qoi", "image/bmp", "image/x-hdr", "image/x-portable-anymap", "image/fits", "image/x-tga")
_ROWS = 1 << 16


def scan_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def in_natural_order(files: DataFrame) -> DataFrame:
    """path, modificationTime, length and ordinal, from 0 in the natural order of paths; contents are not moved."""
    rows = files.select("path", "modificationTime", "length", natural_key(F.col("path")).alias("_natural"))
    return numbered(rows, ["_natural", "path"], "ordinal").drop("_natural")


def wanted_channel(name: str, selector: str) -> bool:
    """Whether the selector keeps the channel; its words are alternatives."""
    words = [w for w in re.split("[, ]", selector) if w]
    if not selector:
        return True
    if selector.startswith("^") or selector.endswith("$"):
        return re.search(selector, name, re.IGNORECASE) is not None
    subject = name.lower() if re.fullmatch("[a-z]+", selector) else name
    return any(w in subject for w in words)


def decode_images(files: DataFrame, selector: str = "", first_part: bool = False) -> DataFrame:
    """path, part, channel, x, y, value, error. A file that cannot be decoded is one row with an error and no pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("channel", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("value", pa.float64()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    parts = formats.decode(content or b"", path)
                except formats.UnsupportedFormat as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], schema=schema)
                    continue
                for part, names, pixels in parts[:1] if first_part else parts:
                    h, w, _ = pixels.shape
                    for k, name in enumerate(names):
                        if not wanted_channel(f"{part}.{name}" if part else name, selector):
                            continue
                        values = np.ascontiguousarray(pixels[:, :, k]).ravel()
                        for at in range(0, len(values), _ROWS):
                            own = values[at : at + _ROWS]
                            place = np.arange(at, at + len(own))
                            same = lambda v: pa.array([v] * len(own), pa.string())  # noqa: B023, E731
                            yield pa.RecordBatch.from_arrays([same(path), same(part), same(name), pa.array((place % w).astype(np.int32)), pa.array((place // w).astype(np.int32)), pa.array(own), same(None)], schema=schema)

    return files.select("path", "content").mapInArrow(run, READER + ", error string")


def read_images(spark: SparkSession, path: str, selector: str = "", recursive: bool = False, on_error: str = "raise") -> DataFrame:
    """path, part, channel, x, y, value of all images.

    A file that cannot be decoded ends the query that meets it ("raise"), is a row with an error ("keep", which adds that
    column) or is left out ("skip").
    """
    rows = decode_images(scan_files(spark, path, recursive=recursive), selector)
    if on_error == "keep":
        return rows
    if on_error == "skip":
        return rows.where("error is null").drop("error")
    if on_error != "raise":
        raise ValueError(f"not a way to treat errors: {on_error}")
    failed = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string")
    return rows.withColumn("path", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("path"))).drop("error")


def empty_image(spark: SparkSession, width: int, height: int, channels: list[str]) -> DataFrame:
    """channel, x, y, value of an image of zeros."""
    if width * height <= 0:
        raise ValueError("an image without pixels")
    at = spark.range(width * height)
    return at.select(F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), F.lit(0.0).alias("value"))


def encode_images(pixels: DataFrame, extension: str, key: str = "path") -> DataFrame:
    """key, content and error from wide pixels (key, x, y, r, g, b, a and error) with premultiplied alpha.

    One file is encoded by one task, as a file must be. Alpha is divided out for formats with straight alpha. A key with an
    error has no content.
    """
    if extension not in formats.ENCODERS:
        raise formats.UnsupportedFormat(f"no encoder for {extension}")
    encoder, _, straight = formats.ENCODERS[extension]

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        failed = [e for e in rows["error"] if e]
        if failed:
            return pd.DataFrame({key: [group[0]], "content": [None], "error": failed[:1]})
        w, h = int(rows["x"].max()) + 1, int(rows["y"].max()) + 1
        out = np.zeros((h, w, 4))
        out[rows["y"], rows["x"]] = rows[["r", "g", "b", "a"]].to_numpy()
        if straight:
            alpha = out[:, :, 3:]
            out[:, :, :3] = np.where(alpha != 0, out[:, :, :3] / np.where(alpha != 0, alpha, 1), 0)
        return pd.DataFrame({key: [group[0]], "content": [encoder(out)], "error": [None]})

    named = pixels if "error" in pixels.columns else pixels.withColumn("error", F.lit(None).cast("string"))
    return named.groupBy(key).applyInPandas(run, f"{key} string, content binary, error string")


def path_inside(name: str) -> str:
    """A target's name as a relative path: without scheme and leading slashes, all folders kept."""
    parts = [p for p in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", name).split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"not a file inside the target folder: {name}")
    return "/".join(parts)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder.removeprefix("file:"))
        for row in iterator:
            target = f"{top}/{path_inside(row['path'])}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            with system.open_output_stream(target + ".part") as f:
                f.write(row["content"])
            system.move(target + ".part", target)  # a task that runs again writes the same bytes
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class ImageFiles(DataSource):
    """Sink for path and content: df.write.format("imagefiles").mode("append").save(folder).

    The folder is a URI of a store that Arrow's file systems reach, or a path that all executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "imagefiles"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_images(files: DataFrame, folder: str) -> None:
    files.sparkSession.dataSource.register(ImageFiles)
    files.write.format("imagefiles").mode("append").save(folder)
