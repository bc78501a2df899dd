"""Demosaicing of colour filter arrays by weighted neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Filter letter to the channels that it passes.
PASSES = {"R": (1, 0, 0), "G": (0, 1, 0), "B": (0, 0, 1), "C": (0, 1, 1), "M": (1, 0, 1), "Y": (1, 1, 0), "W": (1, 1, 1)}
#: Neighbours up to this multiple of the nearest distance count.
REACH = 1.6
EPSILON = 1e-10
#: Rows of an image that one task works on; each such band also gets the rows that its first and last ones look at.
BAND = 64
#: Pixels that are worked on at once, besides what is left of a band.
BATCH_PIXELS = 1 << 18


def sample_offsets(pattern: list[str]) -> list[tuple[int, int, str, int, int, float]]:
    """(cell x, cell y, channel, dx, dy, weight) of the samples of each cell of the pattern; its own is at 0, 0."""
    h, w = len(pattern), len(pattern[0])
    radius, out = max(w, h) + 1, []
    for ty in range(h):
        for tx in range(w):
            for k, channel in enumerate("RGB"):
                if PASSES[pattern[ty][tx]][k]:
                    out.append((tx, ty, channel, 0, 0, 1.0))
                    continue
                near = [(math.hypot(dx, dy), dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if (dx or dy) and PASSES[pattern[(ty + dy) % h][(tx + dx) % w]][k]]
                least = min((d for d, _, _ in near), default=0.0)
                out += [(tx, ty, channel, dx, dy, 1.0 / d) for d, dx, dy in near if d <= REACH * least]
    return out


def demosaic(pixels: DataFrame, by: list[str], pattern: list[str], width: int, height: int, value: str = "value") -> DataFrame:
    """by, x, y, channel (R, G, B), value. A neighbour weighs less the farther it is and the more it differs; beyond
    the border the nearest pixel counts. Images are whole: each place from 0 to width and height has a pixel.

    Images are dealt out in bands of rows, each with the rows above and below that its own ones look at, by one shuffle. A task
    works on as many whole bands at once as a batch holds.
    """
    offsets = sample_offsets(pattern)
    reach = max(abs(dy) for *_, dy, _ in offsets)
    size = BAND  # as it is here, for the tasks
    bands = F.sequence(F.floor(F.greatest(F.col("y") - reach, F.lit(0)) / size), F.floor(F.least(F.col("y") + reach, F.lit(height - 1)) / size))
    dealt = pixels.select(*by, "x", "y", F.col(value).cast("double").alias("_v"), F.explode(bands).alias("_band"))
    keys = [*by, "_band"]
    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "y", "x").select(*by, "_band", "y", "_v")
    fields = T.StructType([*pixels.select(*by).schema.fields, T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("channel", T.StringType()), T.StructField(value, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH_PIXELS:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = _whole_bands(table, len(keys), width)
                yield from _mixed(table.slice(0, whole), fields, pattern, offsets, width, size)
                rest = table.slice(whole)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from _mixed(pa.Table.from_batches(held).combine_chunks(), fields, pattern, offsets, width, size)

    return ordered.mapInArrow(run, fields)


def _lines(table: pa.Table, keys: int, width: int) -> tuple[pa.Table, np.ndarray]:
    """One row for each row of pixels, and which of them begin a band."""
    lines = table.take(pa.array(np.arange(0, table.num_rows, width)))
    columns = [lines.column(k).combine_chunks() for k in range(keys)]
    begins = np.zeros(lines.num_rows, bool)
    begins[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        begins[1:] |= differs.to_numpy(zero_copy_only=False)
    return lines, begins


def _whole_bands(table: pa.Table, keys: int, width: int) -> int:
    """Pixels up to the start of the last band, which may go on."""
    _, begins = _lines(table.slice(0, table.num_rows // width * width), keys, width)
    return int(np.flatnonzero(begins)[-1]) * width


def _mixed(table: pa.Table, fields: T.StructType, pattern: list[str], offsets: list[tuple], width: int, size: int) -> Iterator[pa.RecordBatch]:
    """All channels of the pixels of whole bands; rows that only border a band give none."""
    if not table.num_rows:
        return
    if table.num_rows % width:
        raise ValueError("an image lacks pixels")
    keys = len(table.column_names) - 2
    lines, begins = _lines(table, keys, width)
    group = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)[group]
    last = np.append(np.flatnonzero(begins)[1:], len(begins))[group] - 1
    y, band = lines.column("y").to_numpy(), lines.column("_band").to_numpy()
    values = table.column("_v").to_numpy().reshape(-1, width)
    h, w, here, across = len(pattern), len(pattern[0]), np.arange(len(begins)), np.arange(width)
    found = {c: np.full(values.shape, np.nan) for c in dict.fromkeys(c for _, _, c, *_ in offsets)}
    own = y // size == band
    for ty in range(h):
        rows = here[own & (y % h == ty)]
        for tx in range(w):
            columns = across[across % w == tx]
            centre = values[np.ix_(rows, columns)]
            for channel, out in found.items():
                samples = [(dx, dy, wt) for cx, cy, c, dx, dy, wt in offsets if (cx, cy, c) == (tx, ty, channel)]
                if samples == [(0, 0, 1.0)]:
                    out[np.ix_(rows, columns)] = centre
                elif samples:
                    total, weights = 0.0, 0.0
                    for dx, dy, wt in samples:
                        v = values[np.ix_(np.clip(rows + dy, first[rows], last[rows]), np.clip(columns + dx, 0, width - 1))]
                        k = wt / (np.abs(v - centre) + EPSILON)
                        total, weights = total + v * k, weights + k
                    out[np.ix_(rows, columns)] = total / weights
    kept = np.flatnonzero(own)
    place = pa.array(np.repeat(kept, width))
    keyed = [lines.column(k).combine_chunks().take(place) for k in range(keys - 1)]
    at = [pa.array(np.tile(across, len(kept)).astype(np.int32)), pa.array(np.repeat(y[kept], width).astype(np.int32))]
    for channel, out in found.items():
        flat = pa.array(out[kept].ravel())
        yield pa.RecordBatch.from_arrays([*keyed, *at, pa.repeat(channel, len(flat)), flat], names=fields.names)
