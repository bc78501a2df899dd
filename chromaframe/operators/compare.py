"""Comparison with a reference, gain maps, tables of values and frame compositing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.color import metric
from .geometry import resize_bilinear


def centre_offset(image: tuple[int, int], reference: tuple[int, int]) -> tuple[int, int]:
    """Shift that centres the reference; halves are cut toward 0."""
    return int((reference[0] - image[0]) / 2), int((reference[1] - image[1]) / 2)


def against_reference(image: DataFrame, reference: DataFrame, by: list[str], offset: tuple[int, int] = (0, 0), value: str = "value") -> DataFrame:
    """Adds reference: the reference's value at the shifted place, 0 where it has none. by are further equal columns.

    Spark broadcasts the reference if statistics show that it is small, and shuffles both sides otherwise.
    """
    shifted = reference.select(*by, (F.col("x") - offset[0]).cast("int").alias("x"), (F.col("y") - offset[1]).cast("int").alias("y"), F.col(value).alias("reference"))
    return image.join(shifted, [*by, "x", "y"], "left").withColumn("reference", F.coalesce("reference", F.lit(0.0)))


def compare(image: DataFrame, reference: DataFrame, name: str, by: list[str], offset: tuple[int, int] = (0, 0), value: str = "value") -> DataFrame:
    met = against_reference(image, reference, by, offset, value)
    return met.withColumn("error", metric(name, F.col(value), F.col("reference"))).drop("reference")


def probe_error(image: DataFrame, reference: DataFrame, by: list[str], on: list[str], name: str, place: tuple[float, float], image_view: tuple[float, float, float], reference_view: tuple[float, float, float], value: str = "value") -> DataFrame:
    """by and error of the values that images and their references (equal in on, a part of by) show at one place of the canvas.

    A view is (scale, x, y): a pixel's corner lies at scale times its coordinates from (x, y), so the pixel at a place is the
    floor of the inverse. Places outside an image count as 0, as does a missing reference; each group of by has a row.
    """
    at = lambda view: tuple(math.floor((p - o) / view[0]) for p, o in zip(place, view[1:], strict=True))
    own, other = at(image_view), at(reference_view)
    shown = lambda rows, key, c, xy: rows.groupBy(*key).agg(F.coalesce(F.max(F.when((F.col("x") == xy[0]) & (F.col("y") == xy[1]), F.col(value))), F.lit(0.0)).alias(c))
    met = shown(image, by, "_v", own).join(shown(reference, on, "_r", other), on, "left")
    return met.select(*by, metric(name, F.col("_v"), F.coalesce("_r", F.lit(0.0))).alias("error"))


def compare_alpha(alpha: Column, reference_alpha: Column, reference_has_alpha: bool, inside: Column) -> Column:
    """Half the sum; a reference without an alpha channel counts as 1, a place outside it as 0."""
    there = reference_alpha if reference_has_alpha else F.lit(1.0)
    return 0.5 * (alpha + F.when(inside, F.coalesce(there, F.lit(0.0))).otherwise(F.lit(0.0)))


def apply_vendor_gain(v: Column, gain: Column, headroom: float) -> Column:
    return v * (1.0 + (headroom - 1.0) * gain)


def gain_weight(target: float, base: float, alternate: float) -> float:
    """How far the target headroom lies from the base to the alternate one; 0 if they are the same."""
    if alternate == base:
        return 0.0
    held = min(max((target - base) / (alternate - base), 0.0), 1.0)
    return held if alternate > base else -held


def iso_log_boost(gain: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """Log2 of the gain. Resize this, not the coded gain."""
    r = F.when(gain < 0, -F.pow(-gain, F.lit(1 / gamma))).otherwise(F.pow(gain, F.lit(1 / gamma)))
    return low * (1.0 - r) + high * r


def apply_iso_gain(v: Column, boost: Column, weight: float, base_offset: float, alternate_offset: float) -> Column:
    return (v + base_offset) * F.pow(F.lit(2.0), boost * weight) - alternate_offset


def gain_pictures(pictures: DataFrame, by: list[str], index: str = "index", parent: str = "parent") -> DataFrame:
    """by, index and parent of the gain maps (is_gain) whose parent is an earlier picture that is no gain map itself."""
    mains = pictures.where(~F.col("is_gain")).select(*by, F.col(index).alias(parent))
    return pictures.where(F.col("is_gain") & (F.col(parent) < F.col(index))).join(mains, [*by, parent], "left_semi").select(*by, index, parent)


def gain_table(rgb: tuple[Column, Column, Column], x: Column, y: Column, size: tuple[int, int], points: tuple[int, int, int], spacing: tuple[float, float], origin: tuple[float, float], weights: tuple[float, float, float, float, float], table: list[float]) -> Column:
    """The gain at a pixel: trilinear in a table over the place and a mix of its colours, their least and their greatest.

    points are those along x, y and the mix; the table runs over y, then x, then the mix. Spacing and origin are in shares of
    the image. The last axis has 255 steps from 0 to 1, of which the table holds the first ones.
    """
    mixed = sum((c * w for c, w in zip(rgb[1:], weights[1:3], strict=True)), rgb[0] * weights[0]) + F.least(*rgb) * weights[3] + F.greatest(*rgb) * weights[4]
    held = F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0))
    at = [((c + 0.5) / n - o) / s for c, n, o, s in zip((x, y), size, origin, spacing, strict=True)] + [held * 255.0]
    cells = []
    for v, n in zip(at, points, strict=True):
        inside = F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.0))
        low = F.least(F.floor(inside), F.lit(max(n - 2, 0))).cast("int")
        cells.append((low, F.least(low + 1, F.lit(n - 1)), inside - low))
    (x0, x1, fx), (y0, y1, fy), (z0, z1, fz) = cells
    entry = lambda i, j, k: lookup((j * points[0] + i) * points[2] + k, table)
    along_z = lambda i, j: entry(i, j, z0) * (1.0 - fz) + entry(i, j, z1) * fz
    along_y = lambda i: along_z(i, y0) * (1.0 - fy) + along_z(i, y1) * fy
    return along_y(x0) * (1.0 - fx) + along_y(x1) * fx


def black_level(pattern: list[list[float]], by_column: list[float], by_row: list[float]) -> Column:
    """The level of a place: the pattern's, repeated, and those of its column and row."""
    return periodic(F.col("x"), F.col("y"), pattern) + lookup(F.col("x"), by_column) + lookup(F.col("y"), by_row)


def overlay_channel(pixels: DataFrame, mask: DataFrame, by: list[str], origin: tuple[int, int], name: str) -> DataFrame:
    """Pixels with a further channel: 1 where the mask (x, y, value) placed at an origin of (row, column) from 1 is set, else 0."""
    row, column = max(origin[0] - 1, 0), max(origin[1] - 1, 0)
    placed = mask.where("value <> 0").select(*by, (F.col("x") + column).cast("int").alias("x"), (F.col("y") + row).cast("int").alias("y"), F.lit(1.0).alias("_set")).distinct()
    met = pixels.select(*by, "x", "y").distinct().join(placed, [*by, "x", "y"], "left")
    drawn = met.select(*by, "x", "y", F.lit(name).alias("channel"), F.coalesce("_set", F.lit(0.0)).alias("value"))
    return pixels.select(*by, "x", "y", "channel", "value").unionByName(drawn)


def place_frame(canvas: DataFrame, frame: DataFrame, by: list[str], offset: tuple[int, int], over: bool = True) -> DataFrame:
    """by, x, y, value: the frame (x, y, value, alpha) drawn at an offset over what the canvas (x, y, value) has, or in its place.
    Places that either has are there."""
    moved = frame.select(*by, (F.col("x") + offset[0]).cast("int").alias("x"), (F.col("y") + offset[1]).cast("int").alias("y"), F.col("value").alias("_v"), F.col("alpha").alias("_a"))
    met = canvas.select(*by, "x", "y", "value").join(moved, [*by, "x", "y"], "full_outer")
    under = F.coalesce("value", F.lit(0.0))
    drawn = F.col("_v") + under * (1.0 - F.col("_a")) if over else F.col("_v")
    return met.select(*by, "x", "y", F.when(F.col("_v").isNull(), under).otherwise(drawn).alias("value"))


# Tables of values are array literals: a lookup needs no join.


def lookup(index: Column, table: list[float]) -> Column:
    held = F.least(F.greatest(index, F.lit(0)), F.lit(len(table) - 1))
    return F.element_at(F.array(*[F.lit(float(v)) for v in table]), held.cast("int") + 1)


def lookup_linear(v: Column, table: list[float]) -> Column:
    """A table over 0 to 1, linear between entries."""
    at = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (len(table) - 1)
    first = F.least(F.floor(at), F.lit(len(table) - 2)).cast("int")
    return lookup(first, table) + (lookup(first + 1, table) - lookup(first, table)) * (at - first)


def piecewise_linear(v: Column, points: list[tuple[float, float]]) -> Column:
    """Through the points, with the end slopes carried on."""
    line = lambda a, b: F.lit(a[1]) + (v - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))
    out = line(points[-2], points[-1])
    for a, b in reversed(list(zip(points[:-2], points[1:-1], strict=True))):
        out = F.when(v < b[0], line(a, b)).otherwise(out)
    return out


def periodic(x: Column, y: Column, pattern: list[list[float]]) -> Column:
    """The pattern's value at (x mod width, y mod height): colour filters, black levels, dither cells."""
    w, h = len(pattern[0]), len(pattern)
    return lookup(F.pmod(y, F.lit(h)) * w + F.pmod(x, F.lit(w)), [v for row in pattern for v in row])


def composite_frames(frames: DataFrame, by: list[str], order: str, value: str = "value", alpha: str = "alpha") -> DataFrame:
    """Adds canvas: what shows once each frame is drawn on what the frame before it left.

    blend 0 replaces, 1 draws over. dispose 0 keeps the canvas for the next frame, 1 clears it, 2 leaves what was
    before. A pixel's frames are folded in order; they are as many as the animation has.
    """
    frame = F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(alpha).alias("a"), "dispose", "blend")
    listed = frames.groupBy(*by).agg(F.array_sort(F.collect_list(frame)).alias("f"))
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<o:bigint,canvas:double>>").alias("out"))

    def draw(acc: Column, f: Column) -> Column:
        canvas = F.when(f["blend"] == 0, f["v"]).otherwise(f["v"] + acc["left"] * (1.0 - f["a"]))
        left = F.when(f["dispose"] == 0, canvas).when(f["dispose"] == 1, F.lit(0.0)).otherwise(acc["left"])
        return F.struct(left.alias("left"), F.array_append(acc["out"], F.struct(f["o"].cast("bigint").alias("o"), canvas.alias("canvas"))).alias("out"))

    folded = listed.select(*by, F.explode(F.aggregate("f", start, draw, lambda acc: acc["out"])).alias("r"))
    return folded.select(*by, F.col("r.o").alias(order), F.col("r.canvas").alias("canvas"))


def neighbours(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds previous and next of name in the order, around the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag(name).over(w), F.last(name).over(whole))).withColumn("next", F.coalesce(F.lead(name).over(w), F.first(name).over(whole)))


def match_auxiliary(pixels: DataFrame, by: list[str], straight: bool, wanted_straight: bool, matrix: C.Matrix, size: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """by, x, y, channel (R, G, B, A) and value of wide pixels (r, g, b, a) with the alpha state, colours and size of the image that they
    are added to. The matrix leads from their colours to those; each step is left out where nothing differs."""
    colours = tuple(F.col(c) for c in "rgb")
    if straight and not wanted_straight:
        colours = tuple(v * F.col("a") for v in colours)
    elif wanted_straight and not straight:
        colours = tuple(C.unpremultiply(v, F.col("a")) for v in colours)
    cells = zip("RGBA", (*C.apply_matrix(matrix, colours), F.col("a")), strict=True)
    rows = pixels.select(*by, "x", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("value")) for c, v in cells])).alias("s")).select(*by, "x", "y", "s.*")
    return rows if size == wanted else resize_bilinear(rows, [*by, "channel"], size, wanted)
