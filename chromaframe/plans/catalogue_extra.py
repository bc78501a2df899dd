"""Further registered queries: list upkeep, lookups, readers' scalings and joins, metadata trees, bits and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import color as C
from ..functions import encoding as E
from ..functions import names as N
from ..operators import catalog as K
from ..operators import compare as J
from ..operators import geometry as G
from ..streaming.recompute import recomputed
from . import views as V
from .catalogue import KEY, SRGB, UNSRGB, _resize_sql, query, r, rgb
from .convert import wide_pixels

PROMO = "contains(channel, 'PROMO')"

# List upkeep and lookups.


@query(
    "WITH n AS (SELECT ordinal, path || '.new' AS path FROM names WHERE ordinal % 50 = 3), c AS (SELECT count(*) AS n FROM n) "
    "SELECT path, CASE WHEN ordinal >= 7 THEN ordinal + n ELSE ordinal END AS ordinal FROM names, c UNION ALL SELECT path, 6 + row_number() OVER (ORDER BY ordinal) FROM n",
    "names",
)
def insert_images(spark, sf_dir):
    rows = V.names(spark, sf_dir).select("path", "ordinal")
    return K.insert_at(rows, rows.where("ordinal % 50 = 3").withColumn("path", F.concat("path", F.lit(".new"))), 7)


@query(
    f"WITH v AS (SELECT image_id, ordinal, {PROMO} AS visible FROM names), g AS (SELECT image_id, min(ordinal) + 400 AS gone FROM v GROUP BY 1), w AS (SELECT v.*, gone FROM v JOIN g USING (image_id)), h AS (SELECT image_id, gone FROM w WHERE ordinal = gone) "
    "SELECT h.image_id, coalesce(min(CASE WHEN visible AND ordinal > h.gone THEN ordinal END), max(CASE WHEN visible AND ordinal < h.gone THEN ordinal END)) AS selected FROM h JOIN w USING (image_id) GROUP BY 1",
    "names",
)
def selected_after_delete(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    first = rows.groupBy("image_id").agg((F.min("ordinal") + 400).alias("gone"))
    return K.selected_after_delete(rows.join(first, "image_id"), ["image_id"], F.col("ordinal") == F.col("gone"), N.fuzzy_match(F.col("channel"), "PROMO"))


@query(
    f"SELECT image_id, coalesce(max(CASE WHEN {PROMO} AND ordinal // 50 = 3 THEN ordinal END), min(CASE WHEN {PROMO} THEN ordinal END)) AS current, max(CASE WHEN {PROMO} AND ordinal // 50 = 2 THEN ordinal END) AS reference FROM names GROUP BY 1",
    "names",
)
def reselected_after_filter(spark, sf_dir):
    nth = F.floor(F.col("ordinal") / 50)
    return K.reselected(V.names(spark, sf_dir), ["image_id"], N.fuzzy_match(F.col("channel"), "PROMO"), nth == 3, nth == 2)


@query(
    "WITH a AS (SELECT DISTINCT user_id, event_type AS tab, props AS name FROM events) SELECT user_id, tab, name, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY tab) - 1 AS INTEGER) AS tab_position, CAST(row_number() OVER (PARTITION BY user_id, tab ORDER BY name) - 1 AS INTEGER) AS \"position\" FROM a"
)
def sorted_attributes(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tab"), F.col("props").alias("name")).distinct()
    return K.sorted_attributes(rows, ["user_id"], "tab", "name")


@query("WITH q AS (SELECT image_id, value FROM px WHERE x = 5 AND y = 6 AND image_id < 10) SELECT p.image_id, p.image_id % 10 AS label, round(abs(p.value - q.value), 6) + 0 AS error FROM px p JOIN q ON p.image_id % 10 = q.image_id WHERE p.x = 3 AND p.y = 1", "px")
def probe_error(spark, sf_dir):
    rows = V.px(spark, sf_dir).withColumn("label", F.col("image_id") % 10)
    # The reference lies half as large and further up.
    out = J.probe_error(rows, rows.where("image_id < 10"), ["image_id", "label"], ["label"], "ae", (35.0, 21.5), (10.0, 0.5, 2.0), (5.0, 7.0, -11.0))
    return out.withColumn("error", r("error"))


@query(f"SELECT image_id, ordinal FROM names WHERE NOT {PROMO}", "names")
def delete_visible(spark, sf_dir):
    return K.delete_visible(V.names(spark, sf_dir), N.fuzzy_match(F.col("channel"), "PROMO")).select("image_id", "ordinal")


@query(
    "SELECT image_id, arg_min(path, CASE WHEN contains(path, 'SMALL') THEN ordinal END) AS path, coalesce(arg_min(channel, CASE WHEN ends_with(channel, '.R') AND contains(channel, 'Brand#1') THEN ordinal END), arg_min(channel, ordinal)) AS channel FROM names GROUP BY 1",
    "names",
)
def lookup_names(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    found = K.lookup_first(rows, ["image_id"], F.col("path").contains("SMALL"), "path")
    group = K.lookup_first(rows, ["image_id"], F.col("channel").endswith(".R") & F.col("channel").contains("Brand#1"), "channel", fallback=True)
    return found.join(group, "image_id")


@query("SELECT image_id, ordinal AS position, channel AS group_name, channel || ' ' || channel || ' ' || channel AS channels FROM names", "names")
def single_groups(spark, sf_dir):
    return K.single_groups(V.names(spark, sf_dir), ["image_id"]).withColumn("channels", F.array_join("channels", " "))


@query(
    r"""WITH f AS (SELECT DISTINCT image_id, regexp_extract(path, '([^/]*)$', 1) AS file FROM names), k AS (SELECT *, regexp_replace(file, '[0-9]+\.exr$', '') AS head, CAST(regexp_extract(file, '([0-9]+)\.exr$', 1) AS INTEGER) AS n FROM f)
        SELECT image_id, file, CAST(row_number() OVER (PARTITION BY image_id ORDER BY file) - 1 AS INTEGER) AS by_bytes, CAST(row_number() OVER (PARTITION BY image_id ORDER BY lower(head), n) - 1 AS INTEGER) AS by_nature FROM k""",
    "names",
)
def sorted_parts(spark, sf_dir):
    files = V.names(spark, sf_dir).select("image_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).distinct()
    plain = K.sorted_parts(files, ["image_id"], "file", natural=False).withColumnRenamed("position", "by_bytes")
    return K.sorted_parts(plain, ["image_id"], "file", natural=True).withColumnRenamed("position", "by_nature")


@query(r"SELECT image_id, channel FROM names WHERE starts_with(channel, 'Brand#1') AND NOT contains(substr(channel, 8), '.') UNION ALL SELECT image_id, channel FROM names WHERE starts_with(channel, 'Brand#12.PROMO.') AND NOT contains(substr(channel, 16), '.')", "names")
def channels_in_layer(spark, sf_dir):
    rows = V.names(spark, sf_dir).select("image_id", "channel")
    return rows.where(N.in_layer(F.col("channel"), "Brand#1")).unionAll(rows.where(N.in_layer(F.col("channel"), "Brand#12.PROMO.")))


@query("SELECT DISTINCT image_id, regexp_extract(channel, '^(.*\\.)?[^.]*$', 1) AS layer, channel AS group_name FROM names", "names")
def ungrouped_channels(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    groups = rows.groupBy("image_id", N.layer_of(F.col("channel")).alias("layer")).agg(F.collect_list("channel").alias("channels"), F.lit("all").alias("group_name"))
    return K.ungroup(groups)


@query("SELECT image_id, x, y, 'L' AS channel, value FROM px UNION ALL SELECT image_id, x, y, 'depth.Z', value * 2 FROM px UNION ALL SELECT image_id, x, y, unnest(['R', 'G', 'B']), CAST(0 AS DOUBLE) FROM px", "px")
def appended_channels(spark, sf_dir):
    rows = V.px(spark, sf_dir).select(*KEY, "channel", "value")
    aux = rows.withColumns({"channel": F.lit("Z"), "value": F.col("value") * 2})
    empty = rows.select(*KEY, F.explode(F.array(*[F.lit(c) for c in "RGB"])).alias("channel"), F.lit(0.0).alias("value"))
    return K.append_channels(K.append_channels(rows, aux, "depth"), empty, "")


P3 = [[float(x) for x in row] for row in C.conversion_matrix("bt2020", "display_p3")]


@query(
    "WITH m AS (SELECT image_id, x // 2 AS x, y // 2 AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM rgba GROUP BY 1, 2, 3), "
    "c AS (SELECT image_id, x, y, unnest(['R', 'G', 'B', 'A']) AS channel, unnest([" + ", ".join(f"(CAST({row[0]!r} AS DOUBLE) * r + CAST({row[1]!r} AS DOUBLE) * g + CAST({row[2]!r} AS DOUBLE) * b) * a" for row in P3) + ", a]) AS value FROM m), "
    "SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, channel, round(value, 6) + 0 AS value FROM c",
    "rgba",
)
def matched_auxiliary(spark, sf_dir):
    """Half-size pictures with straight alpha in wide primaries, as they are added to an image with premultiplied alpha in others."""
    small = V.rgba(spark, sf_dir).groupBy("image_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(*[F.avg(c).alias(c) for c in "rgba"])
    found = J.match_auxiliary(small, ["image_id"], True, False, C.conversion_matrix("bt2020", "display_p3"), (4, 4), (4, 4))
    return found.withColumn("value", r("value"))


MIP = "SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, avg(value) AS value FROM px GROUP BY 1, 2, 3"


@query(f"WITH m AS ({MIP}) SELECT image_id, x, y, 'gain.L' AS channel, value FROM ({_resize_sql(4, 8).replace(' px ', ' m ')}) UNION ALL SELECT image_id, x, y, channel, round(value, 6) + 0 FROM px", "px")
def attached_auxiliary(spark, sf_dir):
    main = V.px(spark, sf_dir).select(*KEY, "channel", "value")
    small = G.mip_reduce(main, ["image_id"])
    fitted = G.resize_bilinear(small, ["image_id"], (4, 4), (8, 8)).withColumn("channel", F.lit("L"))
    return K.append_channels(main, fitted, "gain").withColumn("value", r("value"))


@query("SELECT p_brand AS brand, max(p_size) AS width, max(50 - p_size) AS height FROM part GROUP BY 1")
def size_to_fit(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("width"), (50 - F.col("p_size")).alias("height"))
    return K.size_to_fit(sizes, ["brand"])


@query("SELECT event_type, count(*) AS images, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY 1")
def load_batches(spark, sf_dir):
    return K.load_batches(V.table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT event_type, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(*) AS packets, count(DISTINCT user_id) AS connections FROM events GROUP BY 1")
def traffic(spark, sf_dir):
    return K.traffic(V.table(spark, sf_dir, "events"), ["event_type"], "props", "user_id")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, user_id % 2 = 0 AS shown, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (
        SELECT user_id, k, t, t AS planned FROM o WHERE k = 1 UNION ALL
        SELECT o.user_id, o.k, o.t, CASE WHEN o.t <= f.planned THEN f.planned WHEN o.shown THEN greatest(o.t, f.planned + 86400000000) ELSE o.t END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1
    ) SELECT user_id, planned AS recomputed_us, count(*) AS updates, max(t) AS last_us FROM f GROUP BY 1, 2"""
)
def recomputed_statistics(spark, sf_dir):
    """Statistics of a shown image that stand for a day, as events of a user are hours apart."""
    rows = V.table(spark, sf_dir, "events").withColumn("shown", F.col("user_id") % 2 == 0)
    out = recomputed(rows, ["user_id"], "ts", "shown", 86400.0)
    return out.select("user_id", F.unix_micros("recomputed_at").alias("recomputed_us"), "updates", F.unix_micros("last_update").alias("last_us"))


# Joins of readers.


@query("WITH p AS (SELECT image_id, frame AS index, frame % 2 = 1 AS is_gain, (frame * 7) % 5 AS parent FROM frames) SELECT g.image_id, g.index, g.parent FROM p g JOIN p m ON m.image_id = g.image_id AND m.index = g.parent AND NOT m.is_gain WHERE g.is_gain AND g.parent < g.index", "frames")
def gain_pictures(spark, sf_dir):
    pictures = V.frames(spark, sf_dir).select("image_id", F.col("frame").alias("index"), (F.col("frame") % 2 == 1).alias("is_gain"), (F.col("frame") * 7 % 5).alias("parent"))
    return J.gain_pictures(pictures, ["image_id"])


GAINS = [round(1 + (k * 7 % 12) / 8, 4) for k in range(12)]  # 2 by 2 places, 3 steps


def _gain_table_sql() -> str:
    table = "[" + ", ".join(f"CAST({g!r} AS DOUBLE)" for g in GAINS) + "]"
    entry = lambda i, j, k: f"t[({j} * 2 + {i}) * 3 + {k} + 1]"
    z = lambda i, j: f"({entry(i, j, 'z0')} * (1 - fz) + {entry(i, j, 'z1')} * fz)"
    y = lambda i: f"({z(i, 'y0')} * (1 - fy) + {z(i, 'y1')} * fy)"
    held = "least(greatest(0.002 * r + 0.001 * g + 0.003 * b + 0.001 * least(r, g, b) + 0.002 * greatest(r, g, b), 0), 1)"
    low = lambda v, n: f"CAST(least(floor({v}), {n}) AS INTEGER)"
    return (
        f"WITH a AS (SELECT *, {table} AS t, least(greatest(((x + 0.5) / 8 - 0.1) / 0.75, 0), 1) AS px, least(greatest(((y + 0.5) / 8 - 0.2) / 0.5, 0), 1) AS py, least(greatest({held} * 255, 0), 2) AS pz FROM rgba), "
        f"c AS (SELECT *, {low('px', 0)} AS x0, {low('py', 0)} AS y0, {low('pz', 1)} AS z0 FROM a), d AS (SELECT *, least(x0 + 1, 1) AS x1, least(y0 + 1, 1) AS y1, least(z0 + 1, 2) AS z1, px - x0 AS fx, py - y0 AS fy, pz - z0 AS fz FROM c) "
        f"SELECT image_id, x, y, round({y('x0')} * (1 - fx) + {y('x1')} * fx, 6) + 0 AS gain FROM d"
    )


@query(_gain_table_sql(), "rgba")
def gain_table(spark, sf_dir):
    gain = J.gain_table(rgb(), F.col("x"), F.col("y"), (8, 8), (2, 2, 3), (0.75, 0.5), (0.1, 0.2), (0.002, 0.001, 0.003, 0.001, 0.002), GAINS)
    return V.rgba(spark, sf_dir).select(*KEY, r(gain).alias("gain"))


@query(
    "WITH m AS (SELECT image_id, x + 2 AS x, y + 1 AS y FROM px WHERE x < 4 AND y < 3 AND image_id % 3 = 1 AND (x + y + image_id) % 2 = 0) "
    "SELECT image_id, x, y, 'overlay.0.L' AS channel, CASE WHEN m.image_id IS NULL THEN CAST(0 AS DOUBLE) ELSE 1 END AS value FROM px LEFT JOIN m USING (image_id, x, y) UNION ALL SELECT image_id, x, y, channel, value FROM px",
    "px",
)
def overlay_channel(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    mask = rows.where("x < 4 and y < 3 and image_id % 3 = 1").select(*KEY, ((F.col("x") + F.col("y") + F.col("image_id") + 1) % 2).alias("value"))
    return J.overlay_channel(rows, mask, ["image_id"], (2, 3), "overlay.0.L")


@query(
    f"WITH m AS ({MIP}), f AS (SELECT image_id, x + 5 AS x, y + 6 AS y, value AS v, 0.25 + (image_id % 3) * 0.25 AS a FROM m) "
    "SELECT image_id, x, y, round(CASE WHEN v IS NULL THEN coalesce(value, 0) ELSE v + coalesce(value, 0) * (1 - a) END, 6) + 0 AS value FROM (SELECT image_id, x, y, value FROM px) FULL JOIN f USING (image_id, x, y)",
    "px",
)
def placed_frame(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    frame = G.mip_reduce(rows, ["image_id"]).withColumn("alpha", 0.25 + F.col("image_id") % 3 * 0.25)
    return J.place_frame(rows, frame, ["image_id"], (5, 6)).withColumn("value", r("value"))


BLACK, BY_COLUMN, BY_ROW = [[0.01, 0.02], [0.03, 0.04]], [k / 1000 for k in range(8)], [k * k / 2000 for k in range(8)]


@query(
    f"WITH b AS (SELECT image_id, (['R', 'G', 'G', 'B'])[CAST((y % 2) * 2 + x % 2 AS INTEGER) + 1] AS channel, ([0.01, 0.02, 0.03, 0.04])[CAST((y % 2) * 2 + x % 2 AS INTEGER) + 1] + ({BY_COLUMN})[x + 1] + ({BY_ROW})[y + 1] AS black FROM px) "
    "SELECT image_id, channel, round(CAST(max(black) AS DOUBLE), 6) + 0 AS black FROM b GROUP BY 1, 2",
    "px",
)
def greatest_black_level(spark, sf_dir):
    letter = F.element_at(F.array(*[F.lit(c) for c in "RGGB"]), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"))
    rows = V.px(spark, sf_dir).select("image_id", letter.alias("channel"), J.black_level(BLACK, BY_COLUMN, BY_ROW).alias("black"))
    return rows.groupBy("image_id", "channel").agg(r(F.max("black")).alias("black"))


# Scalings and display rules.


@query(
    f"SELECT image_id, x, y, round(least(r, g, b), 6) + 0 AS low, round(greatest(r, g, b), 6) + 0 AS high, round((r * 255 - 16) * (1 / CAST(219 AS DOUBLE)), 6) + 0 AS luma, round((g * 255 - 128) * 127 / (CAST(240 AS DOUBLE) - 128) / 255 + 0.5, 6) + 0 AS chroma, "
    f"round((r - 0.1) / CAST(0.7 AS DOUBLE), 6) + 0 AS hinted, round({UNSRGB('(1 - g)')}, 6) + 0 AS monochrome, round(1 - b, 6) + 0 AS ink FROM rgba",
    "rgba",
)
def reader_scalings(spark, sf_dir):
    red, green, blue = rgb()
    luma, chroma, _ = E.reference_black_white(rgb(), 8, (16, 128, 128), (235, 240, 240), ycbcr=True)
    ink = E.uninvert_inks((red, green, blue, blue), ycck=True)[3]
    shown = {"low": F.least(*rgb()), "high": F.greatest(*rgb()), "luma": luma, "chroma": chroma, "hinted": E.between_levels(red, 0.1, 0.8), "monochrome": E.grey_to_linear(green, inverted=True), "ink": ink}
    return V.rgba(spark, sf_dir).select(*KEY, *[r(v).alias(n) for n, v in shown.items()])


@query(
    f"SELECT image_id, x, y, round({UNSRGB('r')} * a, 6) + 0 AS straight, round({UNSRGB('g')}, 6) + 0 AS premultiplied, round(CASE WHEN a > 0.0001 THEN {UNSRGB('(b / a)')} * a ELSE {UNSRGB('b')} END, 6) + 0 AS nonlinear FROM rgba",
    "rgba",
)
def decoded_alpha(spark, sf_dir):
    kinds = {"straight": ("r", "straight"), "premultiplied": ("g", "premultiplied"), "nonlinear": ("b", "premultiplied_nonlinear")}
    return V.rgba(spark, sf_dir).select(*KEY, *[r(E.decode_alpha(F.col(c), F.col("a"), "srgb", kind)).alias(n) for n, (c, kind) in kinds.items()])


TO_2020 = C.conversion_matrix("rec709", "bt2020")


def _inspected_sql() -> str:
    mixed = [" + ".join(f"{m!r} * {c}" for m, c in zip(row, ("sr", "sg", "sb"), strict=True)) for row in TO_2020]
    return (
        "WITH s AS (SELECT image_id, x, y, CASE WHEN a <> 0 THEN r / a ELSE 0 END AS sr, CASE WHEN a <> 0 THEN g / a ELSE 0 END AS sg, CASE WHEN a <> 0 THEN b / a ELSE 0 END AS sb FROM (SELECT * REPLACE (CASE WHEN a < 0.1 THEN 0 ELSE a END AS a) FROM rgba)), "
        f"m AS (SELECT image_id, x, y, {', '.join(f'{v} AS {n}' for v, n in zip(mixed, 'rgb', strict=True))} FROM s) SELECT image_id, x, y, {', '.join(f'round({SRGB(n)}, 5) + 0 AS {n}' for n in 'rgb')} FROM m"
    )


@query(_inspected_sql(), "rgba")
def inspected_values(spark, sf_dir):
    alpha = F.when(F.col("a") < 0.1, 0.0).otherwise(F.col("a"))
    return V.rgba(spark, sf_dir).select(*KEY, *[r(v, 5).alias(n) for n, v in zip("rgb", E.inspected(rgb(), alpha, TO_2020, "srgb"), strict=True)])


G22 = "pow(greatest(8 * r, 1.17549435e-38), CAST(2.2 AS DOUBLE))"


@query(
    f"WITH v AS (SELECT image_id, x, y, {G22} AS v FROM rgba), h AS (SELECT *, CASE WHEN v <= 0.5 THEN v ELSE pow(2, 1.0 - 2.0 * exp(-(ln(v) / ln(CAST(2 AS DOUBLE)) + 1) / 2)) END AS h FROM v) "
    "SELECT image_id, x, y, round(least(greatest(pow(greatest(h, 1.17549435e-38), 1 / CAST(2.2 AS DOUBLE)), 0), 1), 5) + 0 AS ldr, round(least(pow(greatest(h, 1.17549435e-38), 1 / CAST(2.2 AS DOUBLE)), 64), 5) + 0 AS hdr FROM h",
    "rgba",
)
def display_clamp(spark, sf_dir):
    v = F.col("r") * 8
    return V.rgba(spark, sf_dir).select(*KEY, r(E.display_clamp(v, 1.0, 2.0, True), 5).alias("ldr"), r(E.display_clamp(v, 1.0, 2.0, False), 5).alias("hdr"))


@query(
    "WITH s AS (SELECT p_partkey, (['system', 'custom', 'image'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS s, CAST(p_size * 4 AS DOUBLE) AS custom, CAST(p_retailprice - 1000 AS DOUBLE) AS image FROM part) "
    "SELECT p_partkey, round(coalesce(CASE WHEN s = 'custom' AND custom > 0 THEN custom / 80 WHEN s = 'image' AND image > 0 THEN image / 80 END, 1), 6) + 0 AS multiplier FROM s"
)
def white_multiplier(spark, sf_dir):
    setting = F.element_at(F.array(*[F.lit(s) for s in ("system", "custom", "image")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return V.table(spark, sf_dir, "part").select("p_partkey", r(E.white_multiplier(setting, F.col("p_size") * 4.0, F.col("p_retailprice") - 1000.0, 80.0)).alias("multiplier"))


@query(
    "WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 150) || '%' WHEN 1 THEN CAST(event_id % 6 AS VARCHAR) WHEN 2 THEN 'half' ELSE '%' END AS text, event_id % 3 / CAST(2 AS DOUBLE) AS a, value / 500 * 1.5 AS b FROM events), "
    "p AS (SELECT *, ends_with(text, '%') AS percent, TRY_CAST(CASE WHEN ends_with(text, '%') THEN substr(text, 1, length(text) - 1) ELSE text END AS DOUBLE) AS n FROM t), "
    "s AS (SELECT *, CASE WHEN percent THEN n / 100 ELSE n END AS v, CASE WHEN a < 1 THEN CASE WHEN b <= 0.01 THEN -20 * b + 1.8 ELSE -0.101 * b + 1.601 END ELSE CASE WHEN b <= 0.01 THEN -70 * b + 3 ELSE -0.303 * b + 2.303 END END AS stops FROM p) "
    "SELECT event_id, round(v, 6) + 0 AS value, round(stops, 8) + 0 AS stops, CASE WHEN v IS NULL THEN NULL WHEN percent THEN round(pow(2, greatest(0, least(stops * v, stops))), 6) + 0 ELSE round(pow(2, greatest(0, least(stops, v))), 6) + 0 END AS linear FROM s"
)
def gain_headroom(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat((e % 150).cast("string"), F.lit("%"))).when(e % 4 == 1, (e % 6).cast("string")).when(e % 4 == 2, "half").otherwise("%")
    target, stops = E.headroom(text), E.maker_stops(e % 3 / 2.0, F.col("value") / 500 * 1.5)
    return V.table(spark, sf_dir, "events").select("event_id", r(target["value"]).alias("value"), r(stops, 8).alias("stops"), F.when(target.isNotNull(), r(E.vendor_headroom(stops, target))).alias("linear"))


# Text, bits and captions.


@query("SELECT p_partkey, p_name AS utf16, p_name || chr(65533) AS repaired, CAST(ascii(p_type[1]) * 16777216 + ascii(p_type[2]) * 65536 + ascii(p_type[3]) * 256 + ascii(p_type[4]) AS BIGINT) AS code, CAST(p_size AS BIGINT) * 3 * 2 AS samples FROM part")
def text_and_sizes(spark, sf_dir):
    name = F.col("p_name")
    broken = F.concat(F.encode(name, "UTF-8"), F.unhex(F.lit("FF")))
    return V.table(spark, sf_dir, "part").select("p_partkey", F.decode(F.encode(name, "UTF-16LE"), "UTF-16LE").alias("utf16"), E.repaired_utf8(broken).alias("repaired"), E.four_cc(F.col("p_type")).alias("code"), E.positive_product(F.col("p_size").cast("long"), F.lit(3), F.lit(2)).alias("samples"))


@query(
    "WITH d AS (SELECT event_id, array_to_string(list_transform(range(1, length(props) + 1), lambda i: lpad(bin(ascii(props[i])), 8, '0')), '') AS d FROM events), "
    "f AS (SELECT event_id, list_transform(range(0, length(d) // 12), lambda k: CAST('0b' || d[k * 12 + 1:k * 12 + 12] AS BIGINT)) AS v FROM d) "
    "SELECT event_id, array_to_string(v, ',') AS fields, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 2048 THEN x - 4096 ELSE x END), ',') AS signed FROM f"
)
def unpacked_bits(spark, sf_dir):
    data = F.encode("props", "UTF-8")
    shown = lambda fields: F.array_join(F.transform(fields, lambda v: v.cast("string")), ",")
    events = V.spread(V.table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    return events.select("event_id", shown(E.unpack_bits(data, 12)).alias("fields"), shown(E.unpack_bits(data, 12, signed=True)).alias("signed"))


UNIT = "pow(2, greatest(floor(ln(greatest(abs(v), 5e-8)) / ln(CAST(2 AS DOUBLE)) + 1e-12), -14) - 10)"


@query(
    f"WITH s AS (SELECT image_id, x, y, value * 100 AS v FROM px), u AS (SELECT *, {UNIT} AS u FROM s) SELECT image_id, x, y, sign(v) * round_even(abs(v) / u, 0) * u + 0 AS half, sign(v) * floor(abs(v) / u + 0.5) * u + 0 AS half_up FROM u",
    "px",
)
def half_floats(spark, sf_dir):
    v = F.col("value") * 100
    return V.px(spark, sf_dir).select(*KEY, (E.to_half(v) + F.lit(0.0)).alias("half"), (E.to_half(v, half_up=True) + F.lit(0.0)).alias("half_up"))


@query(
    "SELECT image_id, channel, ordinal, CASE tail WHEN 'r' THEN '#ff0000' WHEN 'g' THEN '#00ff00' WHEN 'b' THEN '#0000ff' ELSE '#ffffff' END AS plain, CASE tail WHEN 'r' THEN '#cc3333' WHEN 'g' THEN '#33cc33' WHEN 'b' THEN '#334dff' ELSE '#ffffff' END AS pastel FROM (SELECT *, lower(split_part(channel, '.', 3)) AS tail FROM names)",
    "names",
)
def channel_colours(spark, sf_dir):
    tail = N.tail_of(F.col("channel"))
    return V.names(spark, sf_dir).select("image_id", "channel", "ordinal", E.channel_colour(tail).alias("plain"), E.channel_colour(tail, pastel=True).alias("pastel"))


def _caption_sql() -> str:
    digits = " || ".join([f"printf('%02X', CAST(floor(least(greatest({SRGB(c)} * 255 + 0.5, 0), 255)) AS INTEGER))" for c in "rgb"] + ["printf('%02X', CAST(floor(least(greatest(a * 255 + 0.5, 0), 255)) AS INTEGER))"])
    return (
        "SELECT image_id, x, y, 'image' || image_id || ' – RGBA – 150% – ' || printf('@%d,%d (%.3f,%.3f) / 8x8: ', x, y, x / CAST(8 AS DOUBLE), y / CAST(8 AS DOUBLE)) || "
        f"printf('%.2f,%.2f,%.2f,%.2f', r, g, b, a) || ' / 0x' || {digits} AS caption FROM rgba"
    )


@query(_caption_sql(), "rgba")
def probe_captions(spark, sf_dir):
    values = [*rgb(), F.col("a")]
    caption = E.probe_caption(F.concat(F.lit("image"), F.col("image_id").cast("string")), F.lit("RGBA"), 1.5, F.col("x"), F.col("y"), (8, 8), values, values, has_alpha=True)
    return V.rgba(spark, sf_dir).select(*KEY, caption.alias("caption"))


def _colour_sql() -> str:
    linear = lambda v: f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"
    byte, digit = lambda n: f"(({n}) / CAST(255 AS DOUBLE))", lambda n: f"(({n}) / CAST(15 AS DOUBLE))"
    by_form = [
        [linear(byte("k % 256")), linear(byte("k * 7 % 256")), linear(byte("s")), "1"],
        [linear(digit("k % 16")), linear(digit("s % 16")), linear(digit("3")), digit("k * 5 % 16")],
        ["s / CAST(8 AS DOUBLE)", "-0.5", "2", "1"], ["0.25", "1e-3", "s * CAST(1 AS DOUBLE)", "0.5"], ["0"] * 4, ["NULL"] * 4, ["NULL"] * 4,
    ]
    channels = [f"round(CAST(CASE k % 7 {' '.join(f'WHEN {n} THEN {form[c]}' for n, form in enumerate(by_form))} END AS DOUBLE), 6) + 0 AS c{c}" for c in range(4)]
    return f"WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS p_partkey, {', '.join(channels)} FROM p"


@query(_colour_sql())
def parsed_colours(spark, sf_dir):
    """A colour for each part, written in one of seven ways, the last two of which are none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    byte, digit = lambda v: F.lpad(F.hex(v), 2, "0"), lambda v: F.lower(F.hex(v % 16))
    forms = [
        F.concat(F.lit("#"), byte(k % 256), byte(k * 7 % 256), byte(size)), F.concat(F.lit(" #"), digit(k), digit(size), F.lit("3"), digit(k * 5)),
        F.concat((size / 8).cast("string"), F.lit(", -0.5,2 ")), F.concat(F.lit("0.25,1e-3,"), size.cast("string"), F.lit(",.5")), F.lit(" "), F.concat(F.lit("#"), byte(size)), F.lit("1,2,x"),
    ]
    text = F.element_at(F.array(*forms), (k % 7 + 1).cast("int"))
    rows = V.table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", N.color_values(F.col("text")).alias("v"))
    return rows.select("p_partkey", *[r(F.col("v")[c]).alias(f"c{c}") for c in range(4)])


@query("SELECT image_id, x, y, value AS r, value AS g, value AS b, CAST(1 AS DOUBLE) AS a FROM px WHERE image_id % 2 = 0 UNION ALL SELECT image_id, x, y, value AS r, value * 2 AS g, CAST(0 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS a FROM px WHERE image_id % 2 = 1", "px")
def padded_channels(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    two = F.array(F.struct(F.lit("R").alias("channel"), F.col("value").alias("value")), F.struct(F.lit("G").alias("channel"), (F.col("value") * 2).alias("value")))
    one = F.array(F.struct("channel", "value"))
    long = rows.select(*KEY, F.explode(F.when(F.col("image_id") % 2 == 1, two).otherwise(one)).alias("s")).select(*KEY, "s.channel", "s.value")
    return wide_pixels(long, ["image_id"])


# Metadata.


@query(
    "WITH i AS (SELECT p_partkey, p_size - 10 AS white, p_retailprice - 1000 AS cll, p_size / CAST(50 AS DOUBLE) AS rx FROM part), f AS (SELECT *, CASE WHEN white > 0 THEN printf('%.6f', CAST(white AS DOUBLE)) ELSE 'n/a' END AS w, CASE WHEN cll > 0 THEN printf('%.6f', CAST(cll AS DOUBLE)) ELSE 'n/a' END AS c, CASE WHEN rx > 0 THEN printf('%.6f', rx) ELSE 'n/a' END AS x FROM i) "
    "SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS ord, unnest(['    Best guess white level: ' || w, '    Max content light level: ' || c, '    Max frame average light level: n/a', '    Min luminance: n/a', '    Max luminance: n/a', "
    "'    Red primary: (' || x || ', n/a)', '    Green primary: (n/a, n/a)', '    Blue primary: (n/a, n/a)', '    White point: (n/a, n/a)']) AS line FROM f"
)
def hdr_attributes(spark, sf_dir):
    images = V.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 10).alias("white_level"), (F.col("p_retailprice") - 1000).alias("max_cll"), (F.col("p_size") / 50.0).alias("red_x"))
    return A.hdr_attributes(images, "p_partkey").select("p_partkey", "ord", A.printed(F.col("depth"), F.col("name"), F.col("value")).alias("line"))


@query(
    "WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'icc' END AS icc, (['bt2020', 'unspecified', NULL])[CAST(p_size % 3 AS INTEGER) + 1] AS prim, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_partkey % 2 = 0 THEN 'pq' ELSE 'bt709' END AS transfer FROM part) "
    "SELECT p_partkey, coalesce(CASE WHEN prim <> 'unspecified' THEN prim END, icc) AS chroma, transfer, CAST(CASE transfer WHEN 'pq' THEN 203 WHEN 'bt709' THEN 100 END AS DOUBLE) AS white_level FROM i"
)
def colour_metadata(spark, sf_dir):
    size, key = F.col("p_size") % 3, F.col("p_partkey")
    transfer = F.when(size == 2, None).when(key % 2 == 0, "pq").otherwise("bt709")
    primaries = F.when(size == 0, "bt2020").when(size == 1, "unspecified")
    whites = F.when(transfer == "pq", C.reference_white("pq")).when(transfer == "bt709", C.reference_white("bt709"))
    out = A.colour_metadata({"chroma": F.when(key % 3 != 0, "icc")}, {"primaries": primaries, "transfer": transfer}, whites)
    return V.table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in out.items()])


@query("SELECT image_id, x, y, round(value, 6) + 0 AS value, 8 - 6 AS min_x, 1 AS min_y, 8 - 2 AS max_x, 5 AS max_y FROM (SELECT image_id, 7 - x AS x, y, value FROM px)", "px")
def oriented_window(spark, sf_dir):
    turned = G.orient(V.px(spark, sf_dir), 2, 8, 8)
    box = G.oriented_box(G.Box(2, 1, 6, 5), 2, 8, 8)
    return turned.select(*KEY, r("value").alias("value"), *[F.lit(v).alias(n) for n, v in zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True)])
