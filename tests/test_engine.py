import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions import names as N
from chromaframe.functions import numeric as M
from chromaframe.operators import catalog as K
from chromaframe.operators import compare as J
from chromaframe.operators import demosaic as D
from chromaframe.operators import geometry as G
from chromaframe.operators import stats as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def image(spark, rows, channel="L"):
    return spark.createDataFrame([(1, channel, x, y, float(v)) for y, line in enumerate(rows) for x, v in enumerate(line)], "image_id long, channel string, x int, y int, value double")


def grid(df, value="value"):
    got = {(r["x"], r["y"]): r[value] for r in df.collect()}
    return [[got[x, y] for x in range(max(k[0] for k in got) + 1)] for y in range(max(k[1] for k in got) + 1)]


@pytest.mark.parametrize("name", sorted(C.TRANSFERS))
def test_transfers_invert(spark, name):
    values = [0.05, 0.25, 0.5, 0.9]
    back = one(spark, *[C.to_linear(name, C.from_linear(name, F.lit(v))).alias(f"v{k}") for k, v in enumerate(values)])
    assert back == pytest.approx(values, abs=1e-4)


def test_hlg_pixels_invert_and_greys_agree(spark):
    rgb = tuple(F.lit(v) for v in (0.2, 0.5, 0.8))
    assert one(spark, *[c.alias(str(k)) for k, c in enumerate(C.hlg_to_linear_rgb(C.linear_to_hlg_rgb(rgb)))]) == pytest.approx((0.2, 0.5, 0.8), abs=1e-6)
    grey = F.lit(0.3)
    assert one(spark, C.linear_to_hlg_rgb((grey, grey, grey))[0].alias("a"), C.linear_to_hlg(grey).alias("b")) == pytest.approx((0.5, 0.5), abs=0.5)


def test_powers_of_negatives_are_nothing(spark):
    assert one(spark, C.power(F.lit(-1.0), 0.45).alias("a"), C.power(F.lit(0.0), 0.45).alias("b"), C.signed_power(F.lit(-4.0), 0.5).alias("c")) == pytest.approx((0, 0, -2), abs=1e-6)


def test_matrices():
    there, back = np.array(C.conversion_matrix("rec709", "bt2020")), np.array(C.conversion_matrix("bt2020", "rec709"))
    assert np.allclose(there @ back, np.eye(3), atol=1e-9)
    assert np.allclose(there.sum(axis=1), 1, atol=1e-9)
    assert there[0] == pytest.approx([0.6274, 0.3293, 0.0433], abs=1e-3)
    assert C.is_identity(C.conversion_matrix("rec709", "rec709"))
    white = C.rgb_to_xyz_matrix(C.PRIMARIES["rec709"]).sum(axis=1)
    assert white == pytest.approx(C._white_xyz(C.ILLUMINANTS["D65"]), abs=1e-9)


def test_metrics(spark):
    i, r = F.lit(1.0), F.lit(-0.01)
    assert one(spark, C.metric("rae", i, r).alias("a"))[0] is None
    assert one(spark, *[C.metric(m, F.lit(0.5), F.lit(0.25)).alias(m) for m in ("e", "ae", "se", "rae", "rse")]) == pytest.approx((0.25, 0.25, 0.0625, 0.25 / 0.26, 0.0625 / 0.0725))


def test_quantise(spark):
    got = one(spark, *[M.quantise(F.lit(v), t).alias(f"c{k}") for k, (v, t) in enumerate([(0.5, "u8"), (2.0, "u8"), (-1.0, "u8"), (-1.0, "i8"), (-0.5, "i8"), (1.0, "u16")])])
    assert got == (128, 255, 0, -127, -64, 65535)
    assert one(spark, M.normalise(F.lit(-128), "i8").alias("n"))[0] == pytest.approx(-128 / 127)
    assert one(spark, *[M.next_power_of_two(F.lit(v).cast("long")).alias(f"c{v}") for v in (0, 1, 3, 4, 5)]) == (1, 1, 4, 4, 8)


def test_statistics_of_non_finite_samples(spark):
    rows = spark.createDataFrame([("a", v) for v in (math.nan, math.inf, -math.inf, 2.0)] + [("b", math.nan), ("c", 0.25), ("c", 0.25)], "g string, value double")
    got = {r.g: r for r in S.canvas_stats(rows, ["g"]).collect()}
    assert (got["a"].min, got["a"].max, got["a"].mean, got["a"].samples) == (2, 2, 0.5, 4)
    assert (got["b"].min, got["b"].mean) == (None, 0)
    assert math.isnan({r.g: r.mean for r in S.channel_min_max_mean(rows, ["g"]).collect()}["b"])
    assert {r.g: r.exposure for r in S.auto_exposure(rows.where("g = 'c'"), ["g"]).collect()} == {"c": None}


def test_constant_image_has_one_bin(spark):
    rows = image(spark, [[0.25, 0.25]])
    got = S.symlog_histogram(rows, ["image_id"], dense=True)
    assert got.count() == 400
    assert [(r.bin, r.weight) for r in got.where("weight > 0").collect()] == [(0, 2.0)]


def test_symlog_inverse(spark):
    values = (-3.0, -0.2, 0.0, 0.001, 5.0)
    assert one(spark, *[S.symlog_inverse(S.symlog(F.lit(v))).alias(str(k)) for k, v in enumerate(values)]) == pytest.approx(values, abs=1e-9)


@pytest.mark.parametrize("rank", [0, 7, 500, 999])
def test_order_statistic(spark, rank):
    rows = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") * 37 % 1000 / 10.0).alias("v"))
    assert S.order_statistic(rows, ["g"], "v", F.lit(rank)).first()[1] == rank / 10
    flat = spark.range(50).select(F.lit("a").alias("g"), F.lit(3.0).alias("v"))
    assert S.order_statistic(flat, ["g"], "v", F.lit(rank)).first()[1] == 3


def test_orientations(spark):
    rows = image(spark, [[1, 2, 3], [4, 5, 6]])
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    for o, rows_ in want.items():
        assert grid(G.orient(rows, o, 3, 2)) == rows_
    assert grid(G.orient(G.orient(rows, 6, 3, 2), 8, 2, 3)) == want[1]


def test_resize_extrapolates_at_the_edge(spark):
    rows = image(spark, [[0, 1], [0, 1]])
    wide = grid(G.resize_bilinear(rows, ["image_id"], (2, 2), (4, 2)))
    assert wide[0] == pytest.approx([-0.25, 0.25, 0.75, 1.0])
    assert grid(G.resize_bilinear(rows, ["image_id"], (2, 2), (4, 2), clamp=True))[0][0] == 0
    assert grid(G.resize_bilinear(rows, ["image_id"], (2, 2), (1, 1))) == [[0.5]]


def test_boxes():
    assert G.Box(0, 0, 4, 4).intersect(G.Box(5, 5, 6, 6)) == G.Box(0, 0, 0, 0)
    assert G.box_from_points((3, 1), (0, 2), drag=True) == G.Box(0, 1, 4, 3)
    assert not G.Box(0, 0, 2, 2).contains(2, 0) and G.Box(0, 0, 2, 2).contains(2, 0, True)
    assert G.Box(0, 0, 4, 4).contains_box(G.Box(1, 1, 4, 4)) and not G.Box(1, 1, 0, 0).valid


@pytest.mark.parametrize(("size", "offset"), [((4, 4), (0, 0)), ((6, 6), (1, 1)), ((2, 2), (0, 0))])
def test_reference_is_centred_by_cut_halves(spark, size, offset):
    assert J.centre_offset((3, 3), size) == offset
    reference = image(spark, [[10 * y + x for x in range(size[0])] for y in range(size[1])]).drop("image_id")
    got = grid(J.compare(image(spark, [[0] * 3] * 3), reference, "ae", ["channel"], offset), "error")
    at = lambda x, y: 10 * (y + offset[1]) + x + offset[0] if x + offset[0] < size[0] and y + offset[1] < size[1] else 0
    assert got == [[at(x, y) for x in range(3)] for y in range(3)]


def test_gain_weight():
    assert [J.gain_weight(t, 0, 4) for t in (-1, 2, 9)] == [0, 0.5, 1]
    assert J.gain_weight(1, 4, 0) == -0.75 and J.gain_weight(3, 2, 2) == 0


@pytest.mark.parametrize(("dispose", "blend", "want"), [(0, 1, [1.0, 1.5, 1.75]), (1, 1, [1.0, 1.0, 1.0]), (2, 1, [1.0, 1.0, 1.0]), (0, 0, [1.0, 1.0, 1.0])])
def test_frames(spark, dispose, blend, want):
    rows = spark.createDataFrame([(1, k, 1.0, 0.5, dispose, blend) for k in range(3)], "image_id long, frame long, value double, alpha double, dispose int, blend int")
    assert [r.canvas for r in J.composite_frames(rows, ["image_id"], "frame").orderBy("frame").collect()] == want


def test_demosaic_of_a_flat_image(spark):
    got = D.demosaic(image(spark, [[0.5] * 4] * 4), ["image_id"], ["RG", "GB"], 4, 4)
    assert got.count() == 48
    assert {round(r.value, 9) for r in got.collect()} == {0.5}
    offsets = D.sample_offsets(["RG", "GB"])
    assert {(dx, dy) for tx, ty, c, dx, dy, _ in offsets if (tx, ty, c) == (0, 0, "G")} == {(1, 0), (-1, 0), (0, 1), (0, -1)}


NAMES = ["R", "a.R", "a.b.R", "a.b.", "depth.Z", "A", "a"]


def test_name_grammar(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    c = F.col("n")
    got = {r.n: (r.layer, r.tail, r.alpha, r.own) for r in rows.select("n", N.layer_of(c).alias("layer"), N.tail_of(c).alias("tail"), N.is_alpha(c).alias("alpha"), N.in_layer(c, "a.").alias("own")).collect()}
    assert got["a.b.R"] == ("a.b.", "R", False, False) and got["a.R"] == ("a.", "R", False, True)
    assert got["a.b."] == ("a.b.", "", False, False) and got["A"][2] and got["a"][2]


@pytest.mark.parametrize(("pattern", "want"), [("", NAMES), ("^a", ["a.R", "a.b.R", "a.b.", "A", "a"]), ("Z$", ["depth.Z"]), ("r", ["R", "a.R", "a.b.R"]), ("R,Z", ["R", "a.R", "a.b.R", "depth.Z"]), ("b z", ["a.b.R", "a.b."]), ("[", [])])
def test_fuzzy_filters(spark, pattern, want):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert [r.n for r in rows.where(N.fuzzy_match(F.col("n"), pattern)).collect()] == want


def test_regex_filters(spark):
    assert one(spark, N.regex_match(F.lit("Foo"), "fO+").alias("a"), N.regex_match(F.lit("x"), "[").alias("b")) == (True, False)


def test_natural_order(spark):
    files = ["file10", "file2", "File3", "file02", "file", "file1"]
    rows = spark.createDataFrame([(n,) for n in files], "n string").orderBy(N.natural_key(F.col("n")), "n")
    assert [r.n for r in rows.collect()] == ["file", "file1", "file02", "file2", "File3", "file10"]


def test_colours():
    assert N.parse_color("#f00") == (1, 0, 0, 1) and N.parse_color("") == (0, 0, 0, 0)
    assert N.parse_color("#ff000080")[3] == pytest.approx(128 / 255)
    assert N.parse_color("0.1, 0.2,0.3") == (0.1, 0.2, 0.3, 1.0)
    for bad in ("#12", "1,2", "#xyz"):
        with pytest.raises(ValueError):
            N.parse_color(bad)


def test_paths(spark):
    path = F.lit("/a/b/file.x.exr:r,g")
    assert one(spark, N.short_name(path).alias("s"), *[c.alias(k) for c, k in zip(N.split_selector(path), "ab", strict=True)]) == ("file.x.exr", "/a/b/file.x.exr", "r,g")
    assert one(spark, *[c.alias(k) for c, k in zip(N.split_selector(F.lit("C:/x.exr")), "ab", strict=True)]) == ("C:/x.exr", "")
    assert one(spark, N.fill_template("{dir}/{file}-{idx:3}{ext}", F.lit("/d/f.g.png"), F.lit(7)).alias("t"))[0] == "/d/f.g-007.png"
    with pytest.raises(ValueError):
        N.fill_template("{nope}", path, F.lit(1))


def test_groups(spark):
    rows = spark.createDataFrame([(1, n, k) for k, n in enumerate(["R", "B", "A", "Z", "q", "l.A", "m.Y", "m.k"])], "image_id long, channel string, ordinal long")
    got = {(r.layer, r.group_name): r.channels for r in K.channel_groups(rows, ["image_id"]).collect()}
    assert got == {("", "R,B,A"): ["R", "B", "A"], ("", "Z,A"): ["Z", "A"], ("", "q,A"): ["q", "A"], ("l.", "l.A"): ["l.A"], ("m.", "m.Y"): ["m.Y"], ("m.", "m.k"): ["m.k"]}


def test_repeated_names_and_moves(spark):
    rows = spark.createDataFrame([(1, "x.R", k) for k in range(3)], "image_id long, channel string, ordinal long")
    assert [r.unique_name for r in K.suffix_duplicates(rows, ["image_id"]).orderBy("ordinal").collect()] == ["x.R", "x.1.R", "x.2.R"]
    assert one(spark, *[K.moved(F.lit(k), 1, 3).alias(f"c{k}") for k in range(5)]) == (0, 3, 1, 2, 4)
    assert one(spark, *[K.moved(F.lit(k), 3, 1).alias(f"c{k}") for k in range(5)]) == (0, 2, 3, 1, 4)


def test_comparison_plan_has_no_product(spark, sf_dir):
    from chromaframe.plans.catalogue import QUERIES

    plan = QUERIES["metric_ae"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("rank", [0, 7, 499, 990, 999])
def test_order_statistic_narrows_until_little_is_left(spark, monkeypatch, rank):
    monkeypatch.setattr(S, "SORTED_ROWS", 5)
    monkeypatch.setattr(S, "SEARCH_BINS", 4)
    values = sorted([1e30, -1e30] + [0.5] * 300 + [float(v) for v in np.random.default_rng(3).lognormal(0, 9, 600)] + [1.0 + k * 1e-15 for k in range(98)])
    rows = spark.createDataFrame([(g, v) for g in (1, 2) for v in values] + [(3, 2.0)] * 50 + [(4, float("nan"))], "g int, v double")
    got = {r.g: r.value_at_rank for r in S.order_statistic(rows, ["g"], "v", F.lit(rank)).collect()}
    assert got == {1: values[rank], 2: values[rank], 3: 2.0}


@pytest.mark.parametrize("band", [1, 3, 64])
def test_demosaic_by_bands(spark, monkeypatch, band):
    monkeypatch.setattr(D, "BAND", band)
    w, h, pattern = 7, 9, ["RG", "GB"]
    values = np.random.default_rng(5).random((h, w))
    rows = spark.createDataFrame([(k, x, y, float(values[y, x] + k)) for k in (0, 1) for y in range(h) for x in range(w)], "image long, x int, y int, value double")
    got = {(r.image, r.x, r.y, r.channel): r.value for r in D.demosaic(rows, ["image"], pattern, w, h).collect()}
    assert len(got) == 2 * 3 * w * h
    for k, x, y, c in got:
        near = [(wt, values[min(max(y + dy, 0), h - 1), min(max(x + dx, 0), w - 1)] + k, dx or dy) for tx, ty, n, dx, dy, wt in D.sample_offsets(pattern) if (tx, ty, n) == (x % 2, y % 2, c)]
        weights = [wt / (abs(v - values[y, x] - k) + D.EPSILON) if away else 1.0 for wt, v, away in near]
        assert abs(got[k, x, y, c] - sum(a * v for a, (_, v, _) in zip(weights, near, strict=True)) / sum(weights)) < 1e-9


def test_numbers_over_partitions(spark):
    from chromaframe.storage import numbered

    rows = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"), F.lit("x").alias("o"))
    assert all(r.v == r.at for r in numbered(rows, ["v"], "at").collect())
    assert numbered(rows.limit(0), ["v"], "at").count() == 0


def test_auxiliary_takes_on_alpha_colours_and_size(spark):
    rows = spark.createDataFrame([(1, x, y, 0.1 * x, 0.2 * y, 0.5, 0.5 if x else 0.0) for x in range(2) for y in range(2)], "image_id long, x int, y int, r double, g double, b double, a double")
    one = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    turned = ((0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 2.0))
    got = lambda *args: {(r.x, r.y, r.channel): r.value for r in J.match_auxiliary(rows, ["image_id"], *args).collect()}
    same = got(True, True, one, (2, 2), (2, 2))
    assert len(same) == 16 and same[1, 1, "G"] == 0.2 and same[0, 0, "B"] == 0.5
    assert got(True, False, turned, (2, 2), (2, 2))[1, 1, "R"] == 0.1 and got(True, False, turned, (2, 2), (2, 2))[0, 1, "B"] == 0.0
    straight = got(False, True, one, (2, 2), (2, 2))
    assert straight[1, 0, "B"] == 1.0 and straight[0, 0, "B"] == 0.0 and straight[1, 0, "A"] == 0.5
    large = got(True, True, one, (2, 2), (4, 4))
    want = {(r.x, r.y): r.value for r in G.resize_bilinear(rows.select("image_id", "x", "y", F.col("r").alias("value")), ["image_id"], (2, 2), (4, 4)).collect()}
    assert len(large) == 64 and {(x, y): v for (x, y, c), v in large.items() if c == "R"} == want


def test_colours_of_a_column(spark):
    texts = ["", " ", "#f00", "#ff000080", "#0F0a", "0.1, 0.2,0.3", "1,2,3,4", "1e3,-2,.5", "#12", "#ggg", "1,2", "1,2,3,4,5", "a,b,c", "1,,2", None, "#f00 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", N.color_values(F.col("t")).alias("v")).collect()
    for r in rows:
        try:
            want = N.parse_color(texts[r.k]) if texts[r.k] is not None else None
        except ValueError:
            want = None
        assert (r.v is None) == (want is None) and (want is None or r.v == pytest.approx(want)), texts[r.k]


def test_missing_samples_come_last(spark):
    rows = spark.createDataFrame([("a", "R", 0.25, 1.0), ("a", "R", 4.0, 2.0), ("a", "R", None, 0.5), ("a", "B", None, 3.0)], "g string, channel string, value double, w double")
    assert [tuple(r) for r in S.order_statistic(rows, ["g"], "value", F.lit(1)).collect()] == [("a", 4.0)]
    assert [tuple(r) for r in S.order_statistic(rows, ["g"], "value", F.col("n") - 2).collect()] == [("a", None)]
    (level,) = S.white_level(rows, ["g"], "value", 1000.0, 200.0).collect()
    assert (level.p9999, level.mean, level.white_level) == (None, 2.125, 200 / 2.125)


def test_missing_samples_count_in_the_first_bin(spark):
    rows = spark.createDataFrame([("a", "R", 0.25, 1.0), ("a", "R", 4.0, 2.0), ("a", "R", None, 0.5), ("a", "B", None, 3.0)], "g string, channel string, value double, w double")
    got = {(r.channel, r.bin): r.weight for r in S.symlog_histogram(rows, ["g"], weight=F.col("w")).collect()}
    assert got == {("R", 0): 1.5, ("R", 399): 2.0, ("B", 0): 3.0}
