"""Boxes, crops, orientations, resizing and reduction of pixel tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Half-open: the minimum is inside, the maximum is not. Empty boxes are valid."""

    min_x: int
    min_y: int
    max_x: int
    max_y: int

    @property
    def valid(self) -> bool:
        return self.max_x >= self.min_x and self.max_y >= self.min_y

    @property
    def size(self) -> tuple[int, int]:
        return self.max_x - self.min_x, self.max_y - self.min_y

    @property
    def area(self) -> int:
        return self.size[0] * self.size[1]

    @property
    def middle(self) -> tuple[int, int]:
        return (self.min_x + self.max_x) // 2, (self.min_y + self.max_y) // 2

    def contains(self, x: int, y: int, inclusive: bool = False) -> bool:
        return self.min_x <= x < self.max_x + inclusive and self.min_y <= y < self.max_y + inclusive

    def contains_box(self, other: Box) -> bool:
        return self.contains(other.min_x, other.min_y, True) and self.contains(other.max_x, other.max_y, True)

    def translate(self, dx: int, dy: int) -> Box:
        return Box(self.min_x + dx, self.min_y + dy, self.max_x + dx, self.max_y + dy)

    def inflate(self, by: int) -> Box:
        return Box(self.min_x - by, self.min_y - by, self.max_x + by, self.max_y + by)

    def intersect(self, other: Box) -> Box:
        """An empty box at the origin if they do not meet."""
        b = Box(max(self.min_x, other.min_x), max(self.min_y, other.min_y), min(self.max_x, other.max_x), min(self.max_y, other.max_y))
        return b if b.valid else Box(0, 0, 0, 0)


def box_from_points(*points: tuple[int, int], drag: bool = False) -> Box:
    """Bounding box; one that is dragged also takes in its last column and row."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return Box(min(xs), min(ys), max(xs) + drag, max(ys) + drag)


def inside(box: Box, x: str = "x", y: str = "y") -> Column:
    """A range predicate that reaches the scan."""
    return (F.col(x) >= box.min_x) & (F.col(x) < box.max_x) & (F.col(y) >= box.min_y) & (F.col(y) < box.max_y)


def crop(pixels: DataFrame, box: Box | None, image: Box) -> DataFrame:
    """Without a box the whole image, with an invalid one nothing."""
    chosen = image if box is None else box.intersect(image) if box.valid else Box(0, 0, 0, 0)
    return pixels.where(inside(chosen))


def oriented(x: Column, y: Column, orientation: int, width: int, height: int) -> tuple[Column, Column]:
    """Where a source pixel comes to lie when an image of that EXIF orientation is turned upright."""
    right, bottom = F.lit(width - 1) - x, F.lit(height - 1) - y
    places = {2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}
    return places.get(orientation, (x, y))


def oriented_box(box: Box, orientation: int, width: int, height: int) -> Box:
    """A window of an image that is turned upright: the box of where its corner pixels come to lie."""
    if orientation in (0, 1):
        return box
    places = {2: lambda x, y: (width - x, y), 3: lambda x, y: (width - x, height - y), 4: lambda x, y: (x, height - y), 5: lambda x, y: (y, x), 6: lambda x, y: (height - y, x), 7: lambda x, y: (height - y, width - x), 8: lambda x, y: (y, width - x)}
    move = places[orientation]
    return box_from_points(move(box.min_x, box.min_y), move(box.max_x, box.max_y))


def orient(pixels: DataFrame, orientation: int, width: int, height: int) -> DataFrame:
    if orientation in (0, 1):
        return pixels
    x, y = oriented(F.col("x"), F.col("y"), orientation, width, height)
    return pixels.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def resize_bilinear(pixels: DataFrame, by: list[str], source: tuple[int, int], target: tuple[int, int], value: str = "value", clamp: bool = False) -> DataFrame:
    """by, x, y, value on the target grid.

    Places map by pixel centres. The first neighbour is held at 0 but its weight is not, so the left and top edge
    extrapolate unless clamp is set. A source row is one array: two of them meet each target row, in one join.
    """
    (w, h), (tw, th) = source, target
    if source == target:
        return pixels.select(*by, "x", "y", value)
    packed = pixels.groupBy(*by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v")))), lambda s: s["v"]).alias("row"))

    def neighbour(at: Column, scale: float, last: int) -> tuple[Column, Column, Column]:
        s = (at.cast("double") + 0.5) * scale - 0.5
        first = F.greatest(F.floor(s), F.lit(0)).cast("int")
        weight = s - first
        return first, F.least(first + 1, F.lit(last)).cast("int"), F.greatest(weight, F.lit(0.0)) if clamp else weight

    rows = packed.select(*by).distinct().withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(th - 1))))
    y0, y1, wy = neighbour(F.col("ty"), h / th, h - 1)
    wanted = rows.withColumn("wy", wy).withColumn("need", F.explode(F.array(F.struct(F.lit(0).alias("k"), y0.alias("y")), F.struct(F.lit(1).alias("k"), y1.alias("y")))))
    met = wanted.select(*by, "ty", "wy", "need.k", "need.y").join(packed, [*by, "y"]).groupBy(*by, "ty", "wy")
    both = met.agg(F.max(F.when(F.col("k") == 0, F.col("row"))).alias("r0"), F.max(F.when(F.col("k") == 1, F.col("row"))).alias("r1"))
    cells = both.withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(tw - 1))))
    x0, x1, wx = neighbour(F.col("tx"), w / tw, w - 1)
    get = lambda row, x: F.element_at(row, x + 1)
    across = lambda row: get(row, x0) * (1.0 - wx) + get(row, x1) * wx
    v = across("r0") * (1.0 - F.col("wy")) + across("r1") * F.col("wy")
    return cells.select(*by, F.col("tx").alias("x"), F.col("ty").alias("y"), v.alias(value))


def mip_reduce(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The next smaller level: means of 2 x 2 pixels, fewer at odd edges."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy(*by, half("x"), half("y")).agg(F.avg(value).alias(value))


def replicate_nearest(pixels: DataFrame, factor_x: int, factor_y: int) -> DataFrame:
    """Sub-sampled channels at full size: each sample fills its cell."""
    wide = pixels.withColumn("_dx", F.explode(F.sequence(F.lit(0), F.lit(factor_x - 1)))).withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(factor_y - 1))))
    return wide.withColumns({"x": (F.col("x") * factor_x + F.col("_dx")).cast("int"), "y": (F.col("y") * factor_y + F.col("_dy")).cast("int")}).drop("_dx", "_dy")


def probe(pixels: DataFrame, by: list[str], x: int, y: int, value: str = "value") -> DataFrame:
    """The value of each group at one place, 0 outside."""
    return pixels.groupBy(*by).agg(F.coalesce(F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col(value))), F.lit(0.0)).alias(value))
