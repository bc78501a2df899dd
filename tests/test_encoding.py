import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.functions import attributes as A
from chromaframe.functions import color as C
from chromaframe.functions import encoding as E
from chromaframe.operators import catalog as K
from chromaframe.operators import compare as J
from chromaframe.operators import geometry as G


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_half_floats_against_numpy(spark):
    values = [0.0, 1.0, -2.5, 65504.0, 6e-8, 2.9e-8, 1 / 3, 1023.9, 2049.0, 2051.0, -1e-5, 0.1, 4096.5] + [float(v) for v in np.random.default_rng(1).normal(0, 300, 200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", E.to_half(F.col("v")).alias("h")).collect()
    assert [r.h for r in rows] == [float(np.float16(r.v)) for r in rows]
    assert one(spark, E.to_half(F.lit(70000.0))) is None
    assert one(spark, E.to_half(F.lit(2049.0), half_up=True)) == 2050.0


@pytest.mark.parametrize("width", [1, 3, 8, 12, 24, 62])
def test_bit_fields(spark, width):
    data = bytes(np.random.default_rng(width).integers(0, 256, 23, dtype=np.uint8))
    bits = "".join(f"{b:08b}" for b in data)
    want = [int(bits[k : k + width], 2) for k in range(0, len(bits) - width + 1, width)]
    assert one(spark, E.unpack_bits(F.lit(data), width)) == want
    assert one(spark, E.unpack_bits(F.lit(data), width, signed=True)) == [v - (1 << width) if v >> width - 1 else v for v in want]
    assert one(spark, E.unpack_bits(F.lit(b""), width)) == []


@pytest.mark.parametrize("width", [7, 12, 48, 49, 57])
def test_bit_fields_look_at_their_own_bytes(spark, width):
    data = bytes(np.random.default_rng(width).integers(0, 256, 200, dtype=np.uint8))
    bits = "".join(f"{b:08b}" for b in data)
    fields = E.unpack_bits(F.col("d"), width)
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(b"\xff" * 20),), (None,)], "d binary").select(fields.alias("v"))
    assert "array_join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = [r.v for r in rows.collect()]
    assert got == [[int(bits[k : k + width], 2) for k in range(0, len(bits) - width + 1, width)], [(1 << width) - 1] * (160 // width), []]


def test_sizes_and_texts(spark):
    assert one(spark, E.positive_product(F.lit(3), F.lit(4))) == 12
    with pytest.raises(Exception, match="negative size"):
        one(spark, E.positive_product(F.lit(3), F.lit(-4)))
    assert one(spark, E.four_cc(F.lit("ab"))) == int.from_bytes(b"ab\0\0", "big")
    assert one(spark, E.repaired_utf8(F.lit(b"a\xffb"))) == "a�b"
    assert E.almost_equal(np.eye(3), np.eye(3) + 1e-8) and not E.almost_equal(np.eye(3), np.eye(3) + 1e-3)
    assert E.scale_of([[0, -3, 5], [3, 0, 7], [0, 0, 1]]) == pytest.approx(3)


def test_headrooms(spark):
    target = lambda t: E.headroom(F.lit(t))
    assert one(spark, target("50%")).asDict() == {"value": 0.5, "percent": True}
    assert one(spark, target("x%")) is None and one(spark, target("")) is None
    stops = E.maker_stops(F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert one(spark, stops) == pytest.approx(1.601 - 0.808)
    assert one(spark, E.vendor_headroom(F.lit(2.0), target("300%"))) == 4.0
    assert one(spark, E.vendor_headroom(F.lit(2.0), target("1"))) == 2.0
    assert one(spark, E.vendor_headroom(F.lit(2.0), target("-1"))) == 1.0


def test_primaries_by_code():
    assert {C.H273_PRIMARIES[k] for k in C.H273_PRIMARIES} <= set(C.PRIMARIES)
    assert set(C.EXIF_LIGHTS.values()) <= set(C.ILLUMINANTS)


def test_alpha_kinds(spark):
    coded, alpha = 0.5 * 0.25, 0.25
    linear = ((0.5 + 0.055) / 1.055) ** 2.4
    v = lambda kind, a=alpha, c=coded: one(spark, E.decode_alpha(F.lit(c), F.lit(a), "srgb", kind))
    assert v("premultiplied_nonlinear") == pytest.approx(linear * alpha)
    assert v("premultiplied_nonlinear", 0.0, 0.5) == pytest.approx(linear)
    assert v("straight", c=0.5) == pytest.approx(linear * alpha)
    assert v("none", c=0.5) == v("premultiplied", c=0.5) == pytest.approx(linear)


def test_captions_and_trees(spark):
    caption = E.probe_caption(F.lit("a.exr"), F.lit("(R,G,B)"), 2.0, F.lit(1), F.lit(2), (4, 8), [F.lit(0.5)] * 3, [F.lit(0.0), F.lit(1.0), F.lit(2.0)])
    assert one(spark, caption) == "a.exr – (R,G,B) – 200% – @1,2 (0.250,0.250) / 4x8: 0.50,0.50,0.50 / 0x00FFFF"
    rows = A.hdr_attributes(spark.createDataFrame([(1, 203.0, None)], "k long, white_level double, max_cll double"), "k").orderBy("ord").collect()
    assert len(rows) == 9 and rows[0].value == "203.000000" and {r.value for r in rows[1:5]} == {"n/a"}
    assert one(spark, A.printed(F.lit(1), F.lit("name"), F.lit(""))) == "  name"


def test_list_upkeep(spark):
    rows = spark.createDataFrame([(k, f"i{k}") for k in range(5)], "ordinal long, name string")
    new = spark.createDataFrame([(7, "b"), (3, "a")], "ordinal long, name string")
    assert [r.name for r in K.insert_at(rows, new, 2).orderBy("ordinal").collect()] == ["i0", "i1", "a", "b", "i2", "i3", "i4"]
    assert [r.name for r in K.insert_at(rows.limit(0), new, 0).orderBy("ordinal").collect()] == ["a", "b"]
    shown = rows.withColumn("g", F.lit(1))
    chosen = lambda gone, visible: K.selected_after_delete(shown, ["g"], F.col("ordinal") == gone, F.expr(visible)).first().selected
    assert (chosen(1, "true"), chosen(4, "true"), chosen(2, "ordinal in (0, 2)"), chosen(2, "ordinal = 2")) == (2, 3, 0, None)
    assert K.lookup_first(shown, ["g"], F.lit(False), "name").first().name is None
    assert K.lookup_first(shown, ["g"], F.lit(False), "name", fallback=True).first().name == "i0"


def test_gain_pictures_need_an_earlier_main_picture(spark):
    pictures = spark.createDataFrame([(0, False, 0), (1, True, 0), (2, True, 1), (3, True, 3), (4, True, 5), (5, False, 0), (6, True, 9)], "index int, is_gain boolean, parent int").withColumn("f", F.lit(1))
    assert [(r["index"], r["parent"]) for r in J.gain_pictures(pictures, ["f"]).collect()] == [(1, 0)]


def test_frames_and_overlays_reach_over_the_border(spark):
    canvas = spark.createDataFrame([(x, y, 1.0, 1, "L") for x in (0, 1) for y in (0, 1)], "x int, y int, value double, f int, channel string")
    frame = spark.createDataFrame([(0, 0, 0.5, 0.5, 1), (1, 0, 0.25, 1.0, 1)], "x int, y int, value double, alpha double, f int")
    got = {(r.x, r.y): r.value for r in J.place_frame(canvas, frame, ["f"], (1, 1)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0, (2, 1): 0.25}
    mask = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 1), (0, 1, 0, 1)], "x int, y int, value int, f int")
    drawn = {(r.x, r.y): r.value for r in J.overlay_channel(canvas, mask, ["f"], (0, 2), "o").where("channel = 'o'").collect()}
    assert drawn == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 1.0, (1, 1): 0.0}


@pytest.mark.parametrize("orientation", range(9))
def test_windows_turn_with_their_pixels(spark, orientation):
    box, (w, h) = G.Box(1, 2, 4, 4), (7, 5)
    rows = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y")).withColumn("in", G.inside(box))
    turned, moved = G.orient(rows, orientation, w, h), G.oriented_box(box, orientation, w, h)
    assert turned.where(F.col("in") != G.inside(moved)).count() == 0


def test_a_missing_sample_stays_missing(spark):
    v, none = F.lit(0.5), F.lit(None).cast("double")
    for f in (C.srgb_to_linear, C.linear_to_srgb):
        assert one(spark, f(none)) is None
    assert one(spark, E.decode_alpha(none, v, "srgb", "premultiplied")) is None and one(spark, E.decode_alpha(none, v, "srgb", "premultiplied_nonlinear")) is None


def test_caption_of_a_missing_sample(spark):
    v, none = F.lit(0.5), F.lit(None).cast("double")
    caption = lambda values: E.probe_caption(F.lit("n"), F.lit("g"), 1.0, F.lit(1), F.lit(2), (8, 8), values, values)
    assert one(spark, caption([v, none])) is None and one(spark, caption([v, v])).startswith("n – g – 100% – @1,2")


def test_inspected_values_of_a_missing_sample(spark):
    v, none = F.lit(0.5), F.lit(None).cast("double")
    assert one(spark, F.array(*E.inspected((v, none, v), v, C.conversion_matrix("rec709", "bt2020"), "srgb"))) == [None] * 3
