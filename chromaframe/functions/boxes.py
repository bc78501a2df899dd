"""Half-open boxes as columns, struct<min_x, min_y, max_x, max_y>: the rules of geometry.Box for a box in each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("min_x", "min_y", "max_x", "max_y")


def box(*ends: Column) -> Column:
    return F.struct(*[v.cast("int").alias(c) for c, v in zip(FIELDS, ends, strict=True)])


def from_points(a: Column, b: Column, drag: bool = False) -> Column:
    """Bounding box of two points (x, y); one that is dragged also takes in its last column and row."""
    return box(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]) + int(drag), F.greatest(a["y"], b["y"]) + int(drag))


def valid(b: Column) -> Column:
    return (b["max_x"] >= b["min_x"]) & (b["max_y"] >= b["min_y"])


def area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]).cast("long") * (b["max_y"] - b["min_y"])


def contains(b: Column, x: Column, y: Column, inclusive: bool = False) -> Column:
    return (x >= b["min_x"]) & (x < b["max_x"] + int(inclusive)) & (y >= b["min_y"]) & (y < b["max_y"] + int(inclusive))


def contains_box(b: Column, other: Column) -> Column:
    return contains(b, other["min_x"], other["min_y"], True) & contains(b, other["max_x"], other["max_y"], True)


def intersect(a: Column, b: Column) -> Column:
    """An empty box at the origin if they do not meet."""
    ends = F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"]), F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"])
    return F.when((ends[2] >= ends[0]) & (ends[3] >= ends[1]), box(*ends)).otherwise(box(*[F.lit(0)] * 4))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["min_x"], b["min_x"]), F.least(a["min_y"], b["min_y"]), F.greatest(a["max_x"], b["max_x"]), F.greatest(a["max_y"], b["max_y"]))


def bounding(b: Column) -> Column:
    """An aggregate: the box around all boxes of a group."""
    return box(F.min(b["min_x"]), F.min(b["min_y"]), F.max(b["max_x"]), F.max(b["max_y"]))


def translate(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["min_x"] + dx, b["min_y"] + dy, b["max_x"] + dx, b["max_y"] + dy)


def inflate(b: Column, by: Column) -> Column:
    return box(b["min_x"] - by, b["min_y"] - by, b["max_x"] + by, b["max_y"] + by)
