import random

from pyspark.sql import functions as F

from chromaframe.functions import boxes as B
from chromaframe.operators.geometry import Box, box_from_points


def test_columns_are_the_boxes(spark):
    random.seed(3)
    rows = [tuple(random.randint(-3, 6) for _ in range(8)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int, g int, h int")
    one, two = B.box(*[F.col(c) for c in "abcd"]), B.box(*[F.col(c) for c in "efgh"])
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    got = df.select(
        *"abcdefgh", B.valid(one).alias("valid"), B.area(one).alias("area"), B.contains(one, F.col("e"), F.col("f")).alias("inside"), B.contains(one, F.col("e"), F.col("f"), True).alias("edge"),
        B.contains_box(one, two).alias("holds"), B.intersect(one, two).alias("both"), B.union(one, two).alias("all"), B.translate(one, F.col("e"), F.col("f")).alias("moved"), B.inflate(one, F.col("e")).alias("grown"),
        B.from_points(point("a", "b"), point("c", "d"), True).alias("dragged"),
    ).collect()
    for r in got:
        p, q = Box(*r[:4]), Box(*r[4:8])
        assert (r.valid, r.area, r.inside, r.edge, r.holds) == (p.valid, p.area, p.contains(q[0], q[1]), p.contains(q[0], q[1], True), p.contains_box(q))
        assert (tuple(r.both), tuple(r.moved), tuple(r.grown)) == (p.intersect(q), p.translate(q[0], q[1]), p.inflate(q[0]))
        assert tuple(r.all) == (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])) and tuple(r.dragged) == box_from_points(p[:2], p[2:], drag=True)
    around = df.agg(B.bounding(one).alias("b")).first().b
    assert tuple(around) == (min(r[0] for r in rows), min(r[1] for r in rows), max(r[2] for r in rows), max(r[3] for r in rows))
