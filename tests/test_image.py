import pytest
from pyspark.sql import functions as F

from chromaframe.operators.geometry import Box
from chromaframe.plans import image as I


@pytest.fixture
def picture(spark):
    rows = [(x, y, 0.1 * x, 0.1 * y, 0.5, 1.0) for y in range(3) for x in range(4)]
    return I.Image(spark.createDataFrame(rows, "x int, y int, r double, g double, b double, a double"), (4, 3), "one")


def test_steps_without_effect_leave_the_plan(picture):
    same = picture.crop(Box(0, 0, 9, 9)).orient(1).expose().resize(4, 3).convert("rec709", "rec709")
    assert same.dataframe() is picture.pixels


def test_matrices_are_composed(picture):
    there_and_back = picture.convert("rec709", "bt2020").convert("bt2020", "rec709")
    assert there_and_back.dataframe() is picture.pixels
    grey = picture.convert("rec709", "bt2020").dataframe().where("x = 0 and y = 0").first()
    assert grey.b == pytest.approx(0.5 * 0.8956, abs=1e-3)


def test_geometry_and_statistics(picture):
    part = picture.crop(Box(1, 0, 3, 2))
    assert part.size == (2, 2)
    got = part.stats().first()
    assert (got.min, got.max, got.samples) == (0.0, 0.5, 12)
    assert part.stats() is part.stats()
    I.forget("one")
    turned = picture.orient(6)
    assert turned.size == (3, 4)
    assert turned.dataframe().agg(F.max("x"), F.max("y")).first()[:] == (2, 3)
    assert picture.resize(2, 2).dataframe().count() == 4


def test_comparison_with_itself_is_nothing(picture):
    error = picture.compare(picture, "ae")
    assert error.stats().first().max == 0
    assert error.histogram().where("weight > 0").count() == 3
    smaller = picture.compare(picture.crop(Box(0, 0, 2, 3)), "e").dataframe()
    assert smaller.where("a < 1").count() == 6
    I.forget()
