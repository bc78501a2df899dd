"""Further registered queries: probes, text, list upkeep, colour encodings, playback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import names as N
from ..functions import numeric as M
from ..operators import catalog as K
from ..operators import compare as J
from ..operators import geometry as G
from . import views as V
from .catalogue import KEY, query, r, rgb


@query("SELECT image_id, max(CASE WHEN x = 3 AND y = 5 THEN value END) AS inside, CAST(0 AS DOUBLE) AS outside FROM px GROUP BY 1", "px")
def probe_point(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    inside = G.probe(rows, ["image_id"], 3, 5).withColumnRenamed("value", "inside")
    return inside.join(G.probe(rows, ["image_id"], 30, 5).withColumnRenamed("value", "outside"), "image_id")


@query(
    "SELECT image_id, x, y, printf('%02X', CAST(floor(least(greatest(value, 0), 1) * 255 + 0.5) AS INTEGER)) AS hex, "
    "CASE WHEN value <> 0 AND (abs(value) < 0.01 OR abs(value) >= 1000) THEN printf('%.2e', value) ELSE printf('%.3f', value) END AS shown FROM px",
    "px",
)
def pixel_texts(spark, sf_dir):
    v = F.col("value")
    return V.px(spark, sf_dir).select(*KEY, N.pixel_text(v).alias("hex"), N.statistic_text(v).alias("shown"))


@query(
    r"""SELECT ordinal, path, 'R,G' AS selector, (string_split_regex(path, '[/_]'))[3] AS second_part, len(string_split_regex(path, '[/_]')) AS parts, regexp_replace(path, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS trimmed,
        TRY_CAST(regexp_extract(path, '([0-9]+)\.exr$', 1) AS DOUBLE) AS number FROM names""",
    "names",
)
def path_parts(spark, sf_dir):
    full = F.concat("path", F.lit(":R,G"))
    path, selector = N.split_selector(full)
    parts = N.split_any(F.col("path"), "/_")
    padded = F.concat(F.lit(" \t"), F.col("path"), F.lit("\n "))
    number = N.parse_number(F.regexp_extract("path", r"([0-9]+)\.exr$", 1))
    return V.names(spark, sf_dir).select("ordinal", path.alias("path"), selector.alias("selector"), parts[2].alias("second_part"), F.size(parts).cast("long").alias("parts"), N.trim_blanks(padded).alias("trimmed"), number.alias("number"))


@query(
    "WITH g AS (SELECT image_id, min(path) AS a, max(path) AS b, min(reverse(path)) AS c, max(reverse(path)) AS d FROM names GROUP BY 1) SELECT image_id, "
    "CAST(coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(length(a), length(b))) AS INTEGER) AS prefix, "
    "CAST(coalesce(list_position(list_transform(range(1, least(length(c), length(d)) + 1), lambda i: c[i] = d[i]), false) - 1, least(length(c), length(d))) AS INTEGER) AS suffix FROM g",
    "names",
)
def common_affixes(spark, sf_dir):
    return K.common_affixes(V.names(spark, sf_dir), ["image_id"], "path")


@query("SELECT DISTINCT image_id, split_part(channel, '.', 2) AS kind, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY kind) - 1 AS INTEGER) AS \"position\", (SELECT count(DISTINCT split_part(channel, '.', 2)) FROM names m WHERE m.image_id = names.image_id) AS distinct_values FROM names", "names")
def numbered_distinct(spark, sf_dir):
    rows = V.names(spark, sf_dir).withColumn("kind", F.split_part("channel", F.lit("."), F.lit(2)))
    return K.numbered_distinct(rows, ["image_id"], "kind")


@query(
    r"""WITH t AS (SELECT DISTINCT image_id, regexp_extract(channel, '^(.*\.)?[^.]*$', 1) AS layer, regexp_extract(channel, '([^.]*)$', 1) AS tail FROM names),
        l AS (SELECT image_id, layer || ': ' || string_agg(tail, ',' ORDER BY tail) AS line FROM t GROUP BY image_id, layer)
        SELECT image_id, string_agg(line, '; ' ORDER BY line) AS summary, count(*) AS layers FROM l GROUP BY 1""",
    "names",
)
def image_summary(spark, sf_dir):
    return K.summaries(V.names(spark, sf_dir), ["image_id"])


@query("SELECT image_id, path, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS k FROM names) WHERE k = 1", "names")
def first_of_each_path(spark, sf_dir):
    return K.first_of_each(V.names(spark, sf_dir), ["path"], ["ordinal"]).select("image_id", "path", "ordinal")


@query("SELECT image_id, seq, channel FROM (SELECT *, lag(channel) OVER w AS b, row_number() OVER w AS k FROM tiles WINDOW w AS (PARTITION BY image_id ORDER BY seq)) WHERE k = 1 OR b IS DISTINCT FROM channel", "tiles")
def adjacent_distinct(spark, sf_dir):
    return K.drop_repeats_in_a_row(V.tiles(spark, sf_dir), ["image_id"], "channel", ["seq"]).select("image_id", "seq", "channel")


@query("SELECT image_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ordinal) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM names) WHERE k = least(36, n)", "names")
def nth_visible(spark, sf_dir):
    return K.nth_visible(V.names(spark, sf_dir), ["image_id"], ["ordinal"], 35).select("image_id", "ordinal")


@query("SELECT ordinal, CASE WHEN ordinal = 5 THEN 40 WHEN ordinal > 5 AND ordinal <= 40 THEN ordinal - 1 ELSE ordinal END AS down, CASE WHEN ordinal = 40 THEN 5 WHEN ordinal >= 5 AND ordinal < 40 THEN ordinal + 1 ELSE ordinal END AS up FROM names", "names")
def moved_rows(spark, sf_dir):
    o = F.col("ordinal")
    return V.names(spark, sf_dir).select("ordinal", K.moved(o, 5, 40).cast("long").alias("down"), K.moved(o, 40, 5).cast("long").alias("up"))


@query(
    "WITH l AS (SELECT user_id, event_id AS n, CASE WHEN event_id % 5 = 0 THEN ':' || event_type WHEN event_id % 7 = 0 THEN '  ' ELSE 'file' || event_id END AS line FROM events), "
    "s AS (SELECT *, last_value(CASE WHEN starts_with(line, ':') THEN substr(line, 2) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS sel FROM l WHERE trim(line) <> '') "
    "SELECT user_id, n, line AS path, coalesce(sel, '') AS selector FROM s WHERE NOT starts_with(line, ':')"
)
def sticky_selectors(spark, sf_dir):
    from ..streaming.tiles import sticky_selectors as sticky

    e = F.col("event_id")
    line = F.when(e % 5 == 0, F.concat(F.lit(":"), "event_type")).when(e % 7 == 0, "  ").otherwise(F.concat(F.lit("file"), e.cast("string")))
    return sticky(V.table(spark, sf_dir, "events").select("user_id", e.alias("n"), line.alias("line")), ["user_id"])


@query(
    "WITH o AS (SELECT user_id, event_id, CAST(event_id % 4 AS INTEGER) AS op FROM events), s AS (SELECT *, sum(CASE op WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS raw FROM o) "
    "SELECT user_id, event_id, op, CAST(raw - least(min(raw) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS BIGINT) AS depth FROM s"
)
def command_balance(spark, sf_dir):
    from ..streaming.packets import balanced

    ops = V.table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("op"))
    return balanced(ops, ["user_id"], "event_id").withColumn("depth", F.col("depth").cast("long"))


@query(
    "SELECT image_id, x, y, round((1 - r) * (1 - a), 6) + 0 AS cmyk_r, round((1 - g) * (1 - a), 6) + 0 AS cmyk_g, round((1 - b) * (1 - a), 6) + 0 AS cmyk_b, "
    "round((r * 255 - 16) / 219, 6) + 0 AS full_range, round((r * 255 - 16) / 224, 6) + 0 AS full_chroma, round((r - (0.25 - 0.5)) / (3 - 1) + 0.5, 6) + 0 AS windowed FROM rgba",
    "rgba",
)
def colour_encodings(spark, sf_dir):
    red, green, blue = rgb()
    c = C.cmyk_to_rgb(red, green, blue, F.col("a"))
    shown = [r(v).alias(f"cmyk_{n}") for n, v in zip("rgb", c, strict=True)]
    return V.rgba(spark, sf_dir).select(*KEY, *shown, r(C.full_range(red, 8)).alias("full_range"), r(C.full_range(red, 8, True)).alias("full_chroma"), r(C.dicom_window(red, 0.25, 3)).alias("windowed"))


CUBE = lambda f: f"(CASE WHEN {f} > {6 / 29!r} THEN {f} * {f} * {f} ELSE {3 * (6 / 29) ** 2!r} * ({f} - {4 / 29!r}) END)"


@query(
    f"WITH f AS (SELECT image_id, x, y, (r * 100 + 16) / 116 AS fy, g * 100 / 500 AS da, b * 100 / 200 AS db FROM rgba) "
    f"SELECT image_id, x, y, round({CUBE('(fy + da)')} * 0.9642, 6) + 0 AS cx, round({CUBE('fy')}, 6) + 0 AS cy, round({CUBE('(fy - db)')} * 0.8249, 6) + 0 AS cz FROM f",
    "rgba",
)
def lab_decode(spark, sf_dir):
    out = C.lab_to_xyz(tuple(c * 100 for c in rgb()))
    return V.rgba(spark, sf_dir).select(*KEY, *[r(v).alias(n) for n, v in zip(("cx", "cy", "cz"), out, strict=True)])


@query(
    "WITH q AS (SELECT image_id, x, y, floor(r * 255) AS luma, floor(g * 255) AS u, floor(b * 255) AS v FROM rgba), g AS (SELECT *, luma - floor((u + v) / 4) AS green FROM q) "
    "SELECT image_id, x, y, CAST(v + green AS DOUBLE) AS r, CAST(green AS DOUBLE) AS g, CAST(u + green AS DOUBLE) AS b FROM g",
    "rgba",
)
def reversible_transform(spark, sf_dir):
    out = C.rct_to_rgb(tuple(F.floor(c * 255).cast("double") for c in rgb()))
    return V.rgba(spark, sf_dir).select(*KEY, *[v.cast("double").alias(n) for n, v in zip("rgb", out, strict=True)])


DITHER_SQL = "[" + ", ".join(str(v) for row in C.DITHER for v in row) + "]"


@query(f"SELECT image_id, x, y, CAST(least(greatest(floor(abs(value) * 15 + (({DITHER_SQL})[y * 8 + x + 1] + 0.5) / 64), 0), 15) AS INTEGER) AS level FROM px", "px")
def ordered_dither(spark, sf_dir):
    threshold = J.periodic(F.col("x"), F.col("y"), C.DITHER)
    return V.px(spark, sf_dir).select(*KEY, C.ordered_dither(F.abs("value"), threshold, 4).alias("level"))


@query("SELECT image_id, frame, CAST((frame + floor(value * 24)) % 5 AS BIGINT) AS shown FROM frames", "frames")
def playback_step(spark, sf_dir):
    return V.frames(spark, sf_dir).select("image_id", "frame", F.pmod(F.col("frame") + F.floor(F.col("value") * 24), F.lit(5)).cast("long").alias("shown"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 1 THEN 1 ELSE pow(2, ceil(log2(p_size))) END AS BIGINT) AS next_power, p_size > 0 AND bit_count(p_size) = 1 AS is_power, CAST(ceil(p_size / CAST(7 AS DOUBLE)) AS BIGINT) AS groups, CAST(ceil(p_size / CAST(7 AS DOUBLE)) * 7 AS BIGINT) AS padded FROM part")
def size_rounding(spark, sf_dir):
    v = F.col("p_size").cast("long")
    return V.table(spark, sf_dir, "part").select("p_partkey", M.next_power_of_two(v).alias("next_power"), M.is_power_of_two(v).alias("is_power"), M.divide_round_up(v, F.lit(7)).alias("groups"), M.next_multiple(v, F.lit(7)).cast("long").alias("padded"))


@query("SELECT image_id, x * 2 + dx AS x, y * 3 + dy AS y, value FROM px, (SELECT CAST(unnest(range(2)) AS INTEGER) AS dx), (SELECT CAST(unnest(range(3)) AS INTEGER) AS dy)", "px")
def replicate_samples(spark, sf_dir):
    return G.replicate_nearest(V.px(spark, sf_dir), 2, 3).select("image_id", "x", "y", "value")
