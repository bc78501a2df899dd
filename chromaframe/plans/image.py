"""A lazy pipeline over wide pixel tables: each step adds to the plan, and nothing runs until a result is read.

Steps that would change nothing (a matrix of the identity, a size or orientation that is there already) leave the
plan as it is, and matrices that follow each other are multiplied before they reach it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import compare as J
from ..operators import geometry as G
from ..operators import stats as S

#: Statistics that have been asked for and are kept, by what they depend on.
_kept: dict[tuple, DataFrame] = {}


def forget(image_key: str | None = None) -> None:
    """Drop kept statistics: all, or those of an image that has changed."""
    for key in [k for k in _kept if image_key is None or image_key in k[:2]]:
        _kept.pop(key).unpersist()


@dataclass(frozen=True)
class Image:
    """pixels: x, y, r, g, b, a with premultiplied alpha. key names the content, for statistics that are kept."""

    pixels: DataFrame
    size: tuple[int, int]
    key: str
    steps: tuple = field(default=())
    matrix: tuple | None = None

    def _with(self, pixels: DataFrame, *step, size: tuple[int, int] | None = None) -> Image:
        return replace(self, pixels=pixels, size=size or self.size, steps=(*self.steps, step), matrix=None)

    def _flat(self) -> Image:
        """With a pending matrix in the plan."""
        if self.matrix is None or C.is_identity(self.matrix):
            return replace(self, matrix=None)
        out = C.apply_matrix(self.matrix, (F.col("r"), F.col("g"), F.col("b")))
        return replace(self, pixels=self.pixels.withColumns(dict(zip("rgb", out, strict=True))), matrix=None)

    def crop(self, box: G.Box) -> Image:
        held = box.intersect(G.Box(0, 0, *self.size))
        if held == G.Box(0, 0, *self.size):
            return self
        image = self._flat()
        moved = G.crop(image.pixels, held, held).withColumns({"x": F.col("x") - held.min_x, "y": F.col("y") - held.min_y})
        return image._with(moved, "crop", held, size=held.size)

    def orient(self, orientation: int) -> Image:
        if orientation in (0, 1):
            return self
        image = self._flat()
        turned = image.size[::-1] if orientation >= 5 else image.size
        return image._with(G.orient(image.pixels, orientation, *image.size), "orient", orientation, size=turned)

    def convert(self, source: str, target: str, intent: str = "relative") -> Image:
        own = np.array(C.conversion_matrix(source, target, intent))
        both = own @ np.array(self.matrix) if self.matrix is not None else own
        return replace(self, matrix=tuple(map(tuple, both.tolist())), steps=(*self.steps, ("matrix", source, target, intent)))

    def expose(self, exposure: float = 0.0, offset: float = 0.0) -> Image:
        if exposure == 0 and offset == 0:
            return self
        image = self._flat()
        return image._with(image.pixels.withColumns({c: C.expose(F.col(c), exposure, offset) for c in "rgb"}), "expose", exposure, offset)

    def tonemap(self, name: str = "gamma", gamma: float = 2.2) -> Image:
        image = self._flat()
        out = C.tonemap(name, (F.col("r"), F.col("g"), F.col("b")), gamma)
        return image._with(image.pixels.withColumns(dict(zip("rgb", out, strict=True))), "tonemap", name, gamma)

    def resize(self, width: int, height: int) -> Image:
        if (width, height) == self.size:
            return self
        image = self._flat()
        entry = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("value")) for c in "rgba"])
        long = image.pixels.select("x", "y", F.explode(entry).alias("s")).select("x", "y", "s.c", "s.value")
        small = G.resize_bilinear(long, ["c"], image.size, (width, height))
        wide = small.groupBy("x", "y").agg(*[F.max(F.when(F.col("c") == c, F.col("value"))).alias(c) for c in "rgba"])
        return image._with(wide, "resize", width, height, size=(width, height))

    def compare(self, reference: Image, metric: str) -> Image:
        """Colours become the error, alpha half the sum."""
        image, other = self._flat(), reference._flat()
        dx, dy = J.centre_offset(image.size, other.size)
        there = other.pixels.select((F.col("x") - dx).cast("int").alias("x"), (F.col("y") - dy).cast("int").alias("y"), *[F.col(c).alias(f"_{c}") for c in "rgba"])
        met = image.pixels.join(there, ["x", "y"], "left")
        inside = F.col("_a").isNotNull()
        errors = {c: C.metric(metric, F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0.0))) for c in "rgb"}
        errors["a"] = J.compare_alpha(F.col("a"), F.col("_a"), True, inside)
        return image._with(met.withColumns(errors).drop("_r", "_g", "_b", "_a"), "compare", other.key, other.steps, metric)

    def dataframe(self) -> DataFrame:
        return self._flat().pixels

    def _samples(self) -> DataFrame:
        entry = F.array(*[F.struct(F.lit(c.upper()).alias("channel"), F.col(c).alias("value")) for c in "rgb"])
        return self.dataframe().select(F.lit(1).alias("one"), "a", F.explode(entry).alias("s")).select("one", "a", "s.channel", "s.value")

    def stats(self) -> DataFrame:
        """min, max, mean and samples over the colours; kept until forget()."""
        other = next((s[1] for s in self.steps if s[0] == "compare"), None)
        key = (self.key, other, self.steps)
        if key not in _kept:
            _kept[key] = S.canvas_stats(self._samples(), ["one"]).drop("one").cache()
        return _kept[key]

    def histogram(self, bins: int = S.BINS) -> DataFrame:
        """channel, bin and alpha-weighted height."""
        return S.symlog_histogram(self._samples(), ["one"], weight=F.col("a"), bins=bins, dense=True).drop("one")
