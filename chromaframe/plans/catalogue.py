"""The registered queries over the sample tables and SQL that gives the same rows.

Both sides compute in double, round what depends on the order of sums, and write no NaN, infinity or negative zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import names as N
from ..functions import numeric as M
from ..operators import catalog as K
from ..operators import compare as J
from ..operators import demosaic as D
from ..operators import geometry as G
from ..operators import stats as S
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = V.sql(sql, *views) if views else sql
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


KEY = ["image_id", "x", "y"]
LOG = f"(ln(abs({{v}}) + 0.001) - {math.log(0.001)!r}) / {math.log(2.0)!r}"
SYMLOG = lambda v: f"CASE WHEN {v} > 0 THEN {LOG.format(v=v)} ELSE -({LOG.format(v=v)}) END"
BIN = lambda v, lo, hi: f"CASE WHEN {hi} > {lo} THEN least(greatest(trunc(400 * (({SYMLOG(v)}) - ({SYMLOG(lo)})) / (({SYMLOG(hi)}) - ({SYMLOG(lo)}))), 0), 399) ELSE 0 END"
POW = lambda v, e: f"(CASE WHEN ({v}) = 0 THEN CAST(0 AS DOUBLE) ELSE pow(greatest(CAST({v} AS DOUBLE), 1.17549435e-38), CAST({e!r} AS DOUBLE)) END)"
SPOW = lambda v, e: f"(CASE WHEN ({v}) < 0 THEN -{POW(f'-({v})', e)} ELSE {POW(v, e)} END)"
R6 = lambda v, n=6: f"round({v}, {n}) + 0"

# Statistics.


@query("SELECT image_id, channel, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0 AS mean FROM px GROUP BY ALL", "px")
def channel_min_max_mean(spark, sf_dir):
    return S.channel_min_max_mean(V.px(spark, sf_dir), ["image_id", "channel"]).withColumn("mean", r("mean"))


RGBA_SAMPLES = "SELECT image_id, x, y, c AS channel, v AS value, a FROM (SELECT *, unnest(['R', 'G', 'B']) AS c, unnest([r, g, b]) AS v FROM rgba)"


def rgba_samples(spark, sf_dir) -> DataFrame:
    wide = V.rgba(spark, sf_dir)
    entry = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("value")) for n, c in zip("RGB", "rgb", strict=True)])
    return wide.select(*KEY, "a", F.explode(entry).alias("s")).select(*KEY, "s.channel", "s.value", "a")


@query(f"WITH s AS ({RGBA_SAMPLES}) SELECT image_id, min(value) AS min, max(value) AS max, round(sum(value) / count(*), 6) + 0 AS mean, count(*) AS samples FROM s GROUP BY image_id", "rgba")
def canvas_stats(spark, sf_dir):
    return S.canvas_stats(rgba_samples(spark, sf_dir), ["image_id"]).withColumn("mean", r("mean"))


@query(
    f"WITH m AS (SELECT image_id % 10 AS label, min(value) AS lo, max(value) AS hi FROM px GROUP BY 1) "
    f"SELECT label, channel, CAST({BIN('value', 'lo', 'hi')} AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT *, image_id % 10 AS label FROM px) JOIN m USING (label) GROUP BY ALL",
    "px",
)
def histogram_symlog(spark, sf_dir):
    return S.symlog_histogram(V.px(spark, sf_dir).withColumn("label", F.col("image_id") % 10), ["label"])


@query(
    f"WITH s AS ({RGBA_SAMPLES}), m AS (SELECT min(value) AS lo, max(value) AS hi FROM s) "
    f"SELECT channel, CAST({BIN('value', 'lo', 'hi')} AS INTEGER) AS bin, round(sum(a), 6) + 0 AS weight FROM s, m GROUP BY ALL",
    "rgba",
)
def histogram_alpha_weighted(spark, sf_dir):
    rows = rgba_samples(spark, sf_dir).withColumn("one", F.lit(1))
    return S.symlog_histogram(rows, ["one"], weight=F.col("a")).select("channel", "bin", r("weight").alias("weight"))


INVERSE = lambda s: f"(CASE WHEN {s} > 0 THEN 1 ELSE -1 END) * (exp(abs({s}) * {math.log(2.0)!r} + {math.log(0.001)!r}) - 0.001)"
EDGE = lambda k: INVERSE(f"(slo + (bin + {k}) / CAST(400 AS DOUBLE) * (shi - slo))")


@query(
    f"WITH l AS (SELECT *, image_id % 10 AS label FROM px), m AS (SELECT label, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1), "
    f"h AS (SELECT label, CAST({BIN('value', 'lo', 'hi')} AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS w FROM l JOIN m USING (label) GROUP BY ALL), "
    f"e AS (SELECT label, lo, hi, {SYMLOG('lo')} AS slo, {SYMLOG('hi')} AS shi, CAST(unnest(range(400)) AS INTEGER) AS bin FROM m), "
    f"d AS (SELECT label, bin, lo, hi, coalesce(w, CAST(0 AS DOUBLE)) AS weight, coalesce(w, CAST(0 AS DOUBLE)) / ({EDGE(1)} - ({EDGE(0)})) AS density FROM e LEFT JOIN h USING (label, bin)), "
    f"k AS (SELECT label, list_sort(list(density))[400 - 4] AS k FROM d GROUP BY 1) "
    f"SELECT label, bin, weight, round(density, 4) + 0 AS density, round(density / (1.3 * greatest(k, CAST(0.1 AS DOUBLE))), 6) + 0 AS height, CAST({BIN('CAST(0 AS DOUBLE)', 'lo', 'hi')} AS INTEGER) AS zero_bin FROM d JOIN k USING (label)",
    "px",
)
def histogram_density_norm(spark, sf_dir):
    rows = V.px(spark, sf_dir).withColumn("label", F.col("image_id") % 10)
    histogram = S.symlog_histogram(rows, ["label"], dense=True)
    out = S.histogram_density(histogram, S.canvas_stats(rows, ["label"]), ["label"])
    return out.select("label", "bin", "weight", r("density", 4).alias("density"), r("height").alias("height"), "zero_bin")


LUMA = "CAST(0.2126 AS DOUBLE) * r + CAST(0.7152 AS DOUBLE) * g + CAST(0.0722 AS DOUBLE) * b"


@query(
    f"WITH l AS (SELECT image_id % 16 AS part, {LUMA} AS luma FROM rgba), o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY luma) - 1 AS k, count(*) OVER (PARTITION BY part) AS n FROM l), "
    f"m AS (SELECT part, avg(luma) AS mean FROM l GROUP BY part) SELECT part, round(luma, 9) + 0 AS p9999, round(mean, 6) + 0 AS mean, round(CAST(200 AS DOUBLE) / mean, 4) + 0 AS white_level FROM o JOIN m USING (part) WHERE k = floor(n * CAST(0.9999 AS DOUBLE))",
    "rgba",
)
def percentile_luminance(spark, sf_dir):
    luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    rows = V.rgba(spark, sf_dir).select((F.col("image_id") % 16).alias("part"), luma.alias("luma"))
    out = S.white_level(rows, ["part"], "luma", 1000.0, 200.0)
    return out.select("part", r("p9999", 9).alias("p9999"), r("mean").alias("mean"), r("white_level", 4).alias("white_level"))


@query(
    "WITH s AS (SELECT image_id, unnest([r, g, b, a]) AS v FROM rgba), m AS (SELECT image_id, min(v) AS lo, greatest(max(v), CAST(1.17549435e-38 AS DOUBLE)) AS hi FROM s GROUP BY 1) "
    f"SELECT image_id, round(ln(CASE WHEN hi > lo THEN 1.0 / (hi - lo) END) / {math.log(2.0)!r}, 1) + 0 AS exposure, round(-lo * (CASE WHEN hi > lo THEN CAST(1 AS DOUBLE) / (hi - lo) END), 2) + 0 AS \"offset\" FROM m",
    "rgba",
)
def auto_exposure(spark, sf_dir):
    samples = V.rgba(spark, sf_dir).select("image_id", F.explode(F.array("r", "g", "b", "a")).alias("value"))
    out = S.auto_exposure(samples, ["image_id"])
    return out.select("image_id", r("exposure", 1).alias("exposure"), r("offset", 2).alias("offset"))


# Comparison with a reference.

METRIC_SQL = {"e": "d", "ae": "abs(d)", "se": "d * d", "rae": "CASE WHEN ref + 0.01 <> 0 THEN abs(d) / (ref + CAST(0.01 AS DOUBLE)) END", "rse": "d * d / (ref * ref + CAST(0.01 AS DOUBLE))"}


def _register_metric(metric: str) -> None:
    @query(
        f"WITH p AS (SELECT p.image_id, p.value - coalesce(q.value, 0) AS d, coalesce(q.value, 0) AS ref FROM px p LEFT JOIN (SELECT x, y, value FROM px WHERE image_id = 0) q ON p.x = q.x AND p.y = q.y) "
        f"SELECT image_id, round(avg({METRIC_SQL[metric]}), 5) + 0 AS mean_error, count(*) AS n FROM p GROUP BY image_id",
        "px",
        name=f"metric_{metric}",
    )
    def run(spark, sf_dir):
        image = V.px(spark, sf_dir)
        reference = image.where("image_id = 0").select("channel", "x", "y", "value")
        return J.compare(image, reference, metric, ["channel"]).groupBy("image_id").agg(r(F.avg("error"), 5).alias("mean_error"), F.count(F.lit(1)).alias("n"))


for _metric in ("e", "ae", "se", "rae", "rse"):
    _register_metric(_metric)

BIG_REFERENCE = "SELECT CAST(k % 12 AS INTEGER) AS x, CAST(k // 12 AS INTEGER) AS y, CAST((k * 7) % 11 AS DOUBLE) / 11 AS value FROM (SELECT unnest(range(120)) AS k)"


@query(
    f"WITH ref AS ({BIG_REFERENCE}) SELECT p.image_id, p.x, p.y, round(abs(p.value - coalesce(q.value, 0)), 6) + 0 AS error FROM px p LEFT JOIN ref q ON p.x + 2 = q.x AND p.y + 1 = q.y",
    "px",
)
def metric_offset_reference(spark, sf_dir):
    k = F.col("id")
    reference = spark.range(120).select((k % 12).cast("int").alias("x"), F.floor(k / 12).cast("int").alias("y"), ((k * 7) % 11 / 11.0).alias("value"))
    out = J.compare(V.px(spark, sf_dir), reference, "ae", [], J.centre_offset((8, 8), (12, 10)))
    return out.select(*KEY, r("error").alias("error"))


@query(
    "SELECT p.image_id, p.x, p.y, round(0.5 * (p.a + CASE WHEN p.x < 6 AND p.y < 6 THEN 1 ELSE 0 END), 6) + 0 AS missing_channel, round(0.5 * (p.a + CASE WHEN p.x < 6 AND p.y < 6 THEN coalesce(q.a, 0) ELSE 0 END), 6) + 0 AS with_channel "
    "FROM rgba p LEFT JOIN (SELECT x, y, a FROM rgba WHERE image_id = 0) q ON p.x = q.x AND p.y = q.y",
    "rgba",
)
def metric_missing_alpha(spark, sf_dir):
    image = V.rgba(spark, sf_dir)
    reference = image.where("image_id = 0").select("x", "y", F.col("a").alias("ra"))
    met, inside = image.join(reference, ["x", "y"], "left"), G.inside(G.Box(0, 0, 6, 6))
    return met.select(*KEY, r(J.compare_alpha(F.col("a"), F.col("ra"), False, inside)).alias("missing_channel"), r(J.compare_alpha(F.col("a"), F.col("ra"), True, inside)).alias("with_channel"))


@query("SELECT image_id, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0 AS mean, count(*) AS samples FROM px WHERE x >= 2 AND x < 8 AND y >= 1 AND y < 5 GROUP BY 1", "px")
def crop_stats(spark, sf_dir):
    part = G.crop(V.px(spark, sf_dir), G.Box(2, 1, 12, 5), G.Box(0, 0, 8, 8))
    return S.canvas_stats(part, ["image_id"]).withColumn("mean", r("mean"))


# Names and the catalogue.


@query(
    "WITH w AS (SELECT *, CASE WHEN contains(channel, 'PROMO') THEN 0 WHEN contains(channel, '.Z') THEN 1 WHEN contains(channel, 'LARGE') THEN 2 END AS word FROM names) "
    'SELECT image_id, channel, ordinal, CAST(row_number() OVER (PARTITION BY image_id ORDER BY word, ordinal) - 1 AS INTEGER) AS "position" FROM w WHERE word IS NOT NULL',
    "names",
)
def channel_select_fuzzy(spark, sf_dir):
    return K.select_channels(V.names(spark, sf_dir), "PROMO .Z,LARGE", ["image_id"]).select("image_id", "channel", "ordinal", "position")


@query("SELECT image_id, channel, ordinal FROM names WHERE regexp_matches(channel, '^brand#1[0-9]\\..*\\.(r|depth)$', 'i')", "names")
def channel_select_regex(spark, sf_dir):
    return V.names(spark, sf_dir).where(N.regex_match(F.col("channel"), r"^brand#1[0-9]\..*\.(r|depth)$")).select("image_id", "channel", "ordinal")


@query(
    "WITH i AS (SELECT DISTINCT image_id, path AS name FROM names) SELECT image_id, name FROM i WHERE contains(lower(name), 'widget') AND image_id IN (SELECT image_id FROM names WHERE contains(channel, 'Brand#7'))",
    "names",
)
def catalog_filter_semi(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    images = rows.select("image_id", F.col("path").alias("name")).distinct()
    groups = rows.select("image_id", F.col("channel").alias("group_name"))
    return K.filter_catalog(images, groups, "widget:Brand#7")


@query(
    r"""WITH c AS (SELECT DISTINCT image_id % 5 AS image, p_type AS layer_name, channel, ordinal FROM (SELECT n.*, split_part(channel, '.', 2) AS p_type FROM names n)),
        t AS (SELECT image, regexp_extract(channel, '^(.*\.)?[^.]*$', 1) AS layer, channel, ordinal, regexp_extract(channel, '([^.]*)$', 1) AS tail FROM (SELECT image, channel, min(ordinal) AS ordinal FROM c GROUP BY ALL)),
        k AS (SELECT *, CASE tail WHEN 'R' THEN 0 WHEN 'G' THEN 1 WHEN 'B' THEN 2 WHEN 'Z' THEN 62 ELSE 1000 + ordinal * 10 END AS rank,
                     max(CASE WHEN tail = 'A' THEN channel END) OVER w AS alpha, count(CASE WHEN tail <> 'A' THEN 1 END) OVER w AS colours FROM t WINDOW w AS (PARTITION BY image, layer)),
        g AS (SELECT image, layer, rank // 10 AS grp, list(channel ORDER BY rank, channel) AS m, list(tail ORDER BY rank, channel) AS tails, max(alpha) AS alpha, max(colours) AS colours FROM k WHERE tail <> 'A' OR colours = 0 GROUP BY 1, 2, 3),
        o AS (SELECT *, CASE WHEN alpha IS NOT NULL AND colours > 0 THEN list_append(m, alpha) ELSE m END AS chs, CASE WHEN alpha IS NOT NULL AND colours > 0 THEN list_append(tails, 'A') ELSE tails END AS ts FROM g)
        SELECT image, layer, CAST(row_number() OVER (PARTITION BY image, layer ORDER BY grp) - 1 AS INTEGER) AS "position",
               CASE WHEN len(chs) = 1 THEN layer || ts[1] ELSE layer || '(' || array_to_string(ts, ',') || ')' END AS group_name, array_to_string(chs, ' ') AS channels FROM o""",
    "names",
)
def channel_groups(spark, sf_dir):
    rows = V.names(spark, sf_dir).groupBy((F.col("image_id") % 5).alias("image"), "channel").agg(F.min("ordinal").alias("ordinal"))
    out = K.channel_groups(rows, ["image"])
    return out.select("image", "layer", "position", "group_name", F.array_join("channels", " ").alias("channels"))


@query(
    r"""WITH l AS (SELECT DISTINCT image_id, regexp_extract(channel, '^(.*\.)?[^.]*$', 1) AS layer FROM names)
        SELECT image_id, layer, CAST(row_number() OVER (PARTITION BY image_id ORDER BY lpad(regexp_extract(layer, '#([0-9]+)', 1), 20, '0'), lower(layer)) - 1 AS INTEGER) AS "position" FROM l""",
    "names",
)
def layer_list(spark, sf_dir):
    return K.layers(V.names(spark, sf_dir), ["image_id"])


@query(
    r"""WITH k AS (SELECT image_id, channel, ordinal, row_number() OVER (PARTITION BY image_id, channel ORDER BY ordinal) - 1 AS k FROM names)
        SELECT image_id, channel, ordinal, CASE WHEN k = 0 THEN channel ELSE regexp_extract(channel, '^(.*\.)?[^.]*$', 1) || k || '.' || regexp_extract(channel, '([^.]*)$', 1) END AS unique_name FROM k""",
    "names",
)
def dedupe_names(spark, sf_dir):
    return K.suffix_duplicates(V.names(spark, sf_dir), ["image_id"]).select("image_id", "channel", "ordinal", "unique_name")


@query(
    r"""WITH f AS (SELECT DISTINCT image_id, regexp_extract(path, '([^/]*)$', 1) AS file FROM names),
        k AS (SELECT *, regexp_replace(file, '[0-9]+\.exr$', '') AS head, CAST(regexp_extract(file, '([0-9]+)\.exr$', 1) AS INTEGER) AS n FROM f)
        SELECT image_id, file, row_number() OVER (PARTITION BY image_id ORDER BY lower(head), n) AS rank FROM k""",
    "names",
)
def natural_sort_rank(spark, sf_dir):
    from pyspark.sql import Window

    files = V.names(spark, sf_dir).select("image_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).distinct()
    return files.select("image_id", "file", F.row_number().over(Window.partitionBy("image_id").orderBy(N.natural_key(F.col("file")), "file")).cast("long").alias("rank"))


@query(
    r"""SELECT ordinal, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/out_' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') || '_' || lpad(CAST(ordinal AS VARCHAR), 5, '0') || '.exr' AS target,
        regexp_replace(regexp_extract(path, '([^/]*)$', 1), ':[^:]*$', '') AS short_name FROM names""",
    "names",
)
def path_template(spark, sf_dir):
    path = F.col("path")
    return V.names(spark, sf_dir).select("ordinal", N.fill_template("{dir}/out_{file}_{idx:05d}{ext}", path, F.col("ordinal")).alias("target"), N.short_name(path).alias("short_name"))


@query("SELECT DISTINCT path FROM names WHERE ordinal % 2 = 1 AND path NOT IN (SELECT path FROM names WHERE ordinal % 2 = 0)", "names")
def new_files_anti(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    return K.new_files(rows.where("ordinal % 2 = 1").select("path").distinct(), rows.where("ordinal % 2 = 0"), ["path"])


# Colour.


@query(
    f"SELECT image_id, x, y, {R6('r * pow(2, CAST(1.5 AS DOUBLE)) - 0.1')} AS exposed, {R6(SPOW('r - 0.1', 1.8))} AS signed_gamma, {R6(SPOW('r - 0.1', 1 / 2.2))} AS tonemapped FROM rgba",
    "rgba",
)
def exposure_gamma(spark, sf_dir):
    v = F.col("r")
    mapped = C.tonemap("gamma", (v - 0.1, v, v))[0]
    return V.rgba(spark, sf_dir).select(*KEY, r(C.expose(v, 1.5, -0.1)).alias("exposed"), r(C.signed_power(v - 0.1, 1.8)).alias("signed_gamma"), r(mapped).alias("tonemapped"))


SHIFTED = "SELECT image_id, x, y, r - 0.05 AS r, g - 0.05 AS g, b - 0.05 AS b FROM rgba"


@query(
    f"WITH s AS ({SHIFTED}) SELECT image_id, x, y, {R6('-2 * (least(r, 0) + least(g, 0) + least(b, 0)) / 3')} AS red, {R6('2 * (greatest(r, 0) + greatest(g, 0) + greatest(b, 0)) / 3')} AS green, CAST(0 AS DOUBLE) AS blue FROM s",
    "rgba",
)
def tonemap_posneg(spark, sf_dir):
    red, green, blue = C.tonemap("posneg", tuple(c - 0.05 for c in rgb()))
    return V.rgba(spark, sf_dir).select(*KEY, r(red).alias("red"), r(green).alias("green"), r(blue).alias("blue"))


@query(
    f"SELECT image_id, x, y, CAST(least(greatest(floor(256 * (ln((r + g + b) / 3 + 0.03125) / {math.log(2.0)!r} / 10 + 0.5)), 0), 255) AS INTEGER) AS entry FROM rgba",
    "rgba",
)
def tonemap_falsecolor_index(spark, sf_dir):
    return V.rgba(spark, sf_dir).select(*KEY, C.false_color_index(rgb()).alias("entry"))


SRGB = lambda v: f"(CASE WHEN abs({v}) <= 0.0031308 THEN ({v}) * 12.92 ELSE sign({v}) * (1.055 * {POW(f'abs({v})', 1 / 2.4)} - 0.055) END)"
UNSRGB = lambda v: f"(CASE WHEN abs({v}) <= 0.04045 THEN ({v}) / CAST(12.92 AS DOUBLE) ELSE sign({v}) * {POW(f'(abs({v}) + 0.055) / CAST(1.055 AS DOUBLE)', 2.4)} END)"
LDR = lambda v: f"CAST(floor(least(greatest({SRGB(SPOW(SPOW(f'({v}) * 2', 1 / 2.2), 2.2))} * 255 + 0.5, 0), 255)) AS INTEGER)"


@query(
    f"SELECT image_id, x, y, {', '.join(f'{LDR(f"({c} + (1 - a) * 0.25)")} AS {c}' for c in 'rgb')}, CAST(floor(least(greatest(255 * (a + (1 - a) * 0.5) + 0.5, 0), 255)) AS INTEGER) AS a FROM rgba",
    "rgba",
)
def ldr_quantize(spark, sf_dir):
    a = F.col("a")
    flat = {c: C.over_background(F.col(c), a, 0.25) for c in "rgb"}
    return V.rgba(spark, sf_dir).select(*KEY, *[C.ldr_byte(v, exposure=1.0).alias(c) for c, v in flat.items()], C.to_byte(a + (1 - a) * 0.5).alias("a"))


@query(f"SELECT image_id, x, y, {R6(SRGB('value'))} AS encoded, {R6(UNSRGB('value'))} AS decoded, {R6('value')} AS roundtrip FROM px", "px")
def srgb_roundtrip(spark, sf_dir):
    v = F.col("value")
    return V.px(spark, sf_dir).select(*KEY, r(C.linear_to_srgb(v)).alias("encoded"), r(C.srgb_to_linear(v)).alias("decoded"), r(C.srgb_to_linear(C.linear_to_srgb(v))).alias("roundtrip"))


def _transfer_sql() -> str:
    b, a = C.BT709_BETA, C.BT709_ALPHA
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    to709 = lambda v: f"(CASE WHEN {v} <= {d(4.5 * b)} THEN ({v}) / 4.5 ELSE {POW(f'(({v}) + {d(a - 1)}) / {d(a)}', 1 / 0.45)} END)"
    from709 = lambda v: f"(CASE WHEN {v} <= {d(b)} THEN ({v}) * 4.5 ELSE {d(a)} * {POW(v, 0.45)} - {d(a - 1)} END)"
    odd = lambda f, v: f"(CASE WHEN {v} < 0 THEN -{f(f'(-({v}))')} ELSE {f(v)} END)"
    scene = lambda v: f"(CASE WHEN {v} <= 0.5 THEN ({v}) * ({v}) / 3 ELSE (exp((({v}) - {d(C.HLG_C)}) / {d(C.HLG_A)}) + {d(C.HLG_B)}) / 12 END)"
    signal = lambda v: f"(CASE WHEN {v} <= {d(1 / 12)} THEN sqrt(greatest(({v}) * 3, 0)) ELSE {d(C.HLG_A)} * ln(greatest(12 * ({v}) - {d(C.HLG_B)}, 1.17549435e-38)) + {d(C.HLG_C)} END)"
    p = POW("least(greatest(v, 0), 1)", 1 / C.PQ_M2)
    q = POW(f"greatest(v * {d(203 / 10000)}, 0)", C.PQ_M1)
    tl = f"(v * {d(203 / 1000)})"
    both = {
        "linear": ("v", "v"),
        "bt709": (to709("v"), from709("v")),
        "iec61966_2_4": (odd(to709, "v"), odd(from709, "v")),
        "bt1361": (f"CASE WHEN v < {d(-4.5 * b / 4)} THEN -0.25 * {POW(f'(v * -4 + {d(a - 1)}) / {d(a)}', 1 / 0.45)} ELSE {to709('v')} END", f"CASE WHEN v < {d(-b / 4)} THEN -0.25 * ({d(a)} * {POW('(v * -4)', 0.45)} - {d(a - 1)}) ELSE {from709('v')} END"),
        "gamma22": (POW("greatest(v, 0)", 2.2), POW("greatest(v, 0)", 1 / 2.2)),
        "gamma28": (POW("greatest(v, 0)", 2.8), POW("greatest(v, 0)", 1 / 2.8)),
        "log100": (f"CASE WHEN v > 0 THEN exp((v - 1) * {d(2 * math.log(10))}) ELSE 0 END", "CASE WHEN v >= 0.01 THEN 1 + log10(greatest(v, 1.17549435e-38)) / 2 ELSE 0 END"),
        "log100_sqrt10": (f"CASE WHEN v > 0 THEN exp((v - 1) * {d(2.5 * math.log(10))}) ELSE 0 END", f"CASE WHEN v >= {d(10**-2.5)} THEN 1 + log10(greatest(v, 1.17549435e-38)) / 2.5 ELSE 0 END"),
        "smpte240": (f"CASE WHEN v <= 0.0913 THEN v / 4 ELSE {POW('(v + 0.1115) / CAST(1.1115 AS DOUBLE)', 1 / 0.45)} END", f"CASE WHEN v <= 0.022825 THEN v * 4 ELSE 1.1115 * {POW('v', 0.45)} - 0.1115 END"),
        "srgb": (UNSRGB("v"), SRGB("v")),
        "pq": (f"{d(10000 / 203)} * {POW(f'greatest({p} - {d(C.PQ_C1)}, 0) / greatest({d(C.PQ_C2)} - {d(C.PQ_C3)} * {p}, 1e-5)', 1 / C.PQ_M1)}", POW(f"({d(C.PQ_C1)} + {d(C.PQ_C2)} * {q}) / (1 + {d(C.PQ_C3)} * {q})", C.PQ_M2)),
        "smpte428": (f"{POW('v', 2.6)} * {d(52.37 / 48)}", POW(f"v * {d(48 / 52.37)}", 1 / 2.6)),
        "hlg": (f"{POW(scene('v'), C.HLG_GAMMA - 1)} * {scene('v')} * {d(1000 / 203)}", signal(f"({POW(tl, (1 - C.HLG_GAMMA) / C.HLG_GAMMA)} * {tl})")),
    }
    columns = ", ".join(f"{R6(to)} AS {n}_to, {R6(back)} AS {n}_from" for n, (to, back) in both.items())
    return f"WITH s AS (SELECT image_id, x, y, value * 2 AS v FROM px) SELECT image_id, x, y, {columns} FROM s"


@query(_transfer_sql(), "px")
def transfer_all(spark, sf_dir):
    v = F.col("value") * 2
    shown = [n for n in C.TRANSFERS if n not in ("bt601", "bt2020_10bit", "bt2020_12bit")]
    return V.px(spark, sf_dir).select(*KEY, *[c for n in shown for c in (r(C.to_linear(n, v)).alias(f"{n}_to"), r(C.from_linear(n, v)).alias(f"{n}_from"))])


MATRIX = C.conversion_matrix("rec709", "bt2020")


@query(f"SELECT image_id, x, y, {', '.join(f'{R6(f"{row[0]!r} * r + {row[1]!r} * g + {row[2]!r} * b")} AS {c}' for c, row in zip('rgb', MATRIX, strict=True))} FROM rgba", "rgba")
def matrix_rec709_to_bt2020(spark, sf_dir):
    out = C.apply_matrix(C.conversion_matrix("rec709", "bt2020"), rgb())
    return V.rgba(spark, sf_dir).select(*KEY, *[r(c).alias(n) for n, c in zip("rgb", out, strict=True)])


@query(
    "WITH s AS (SELECT image_id, x, y, r, CASE WHEN a < 0.05 THEN 0 ELSE a END AS a FROM rgba) "
    "SELECT image_id, x, y, round(r * a, 6) + 0 AS premultiplied, round(CASE WHEN a <> 0 THEN r / a ELSE 0 END, 6) + 0 AS straight, round(CASE WHEN a <> 0 THEN r * a / a ELSE 0 END, 6) + 0 AS roundtrip FROM s",
    "rgba",
)
def alpha_premul_unpremul(spark, sf_dir):
    v, a = F.col("r"), F.when(F.col("a") < 0.05, 0.0).otherwise(F.col("a"))
    return V.rgba(spark, sf_dir).select(*KEY, r(v * a).alias("premultiplied"), r(C.unpremultiply(v, a)).alias("straight"), r(C.unpremultiply(v * a, a)).alias("roundtrip"))


@query("SELECT image_id, x, y, round(r + (1 - a) * 0.5, 6) + 0 AS r, round((1 - a) * 0.5, 6) + 0 AS g, round(b + (1 - a) * 0.5, 6) + 0 AS b, round(a + (1 - a) * 1, 6) + 0 AS a FROM rgba", "rgba")
def channel_mask_background(spark, sf_dir):
    a = F.col("a")
    mask = 1 | 4 | 8
    shown = [r(C.over_background(C.mask_channel(F.col(c), mask, bit), a, 0.5)).alias(c) for c, bit in zip("rgb", (1, 2, 4), strict=True)]
    alpha = C.mask_channel(a, mask, 8, alpha=True)
    return V.rgba(spark, sf_dir).select(*KEY, *shown, r(alpha + (1 - alpha) * 1.0).alias("a"))


@query(
    "WITH t AS (SELECT image_id, x, y, 0.299 * r + 0.587 * g + 0.114 * b AS luma, 0.5 - 0.168736 * r - 0.331264 * g + 0.5 * b AS cb, 0.5 + 0.5 * r - 0.418688 * g - 0.081312 * b AS cr FROM rgba) "
    "SELECT image_id, x, y, round(luma, 6) + 0 AS luma, round(cb, 6) + 0 AS cb, round(cr, 6) + 0 AS cr, round(luma + 1.402 * (cr - 0.5), 6) + 0 AS r, "
    "round(luma - 0.344136 * (cb - 0.5) - 0.714136 * (cr - 0.5), 6) + 0 AS g, round(luma + 1.772 * (cb - 0.5), 6) + 0 AS b FROM t",
    "rgba",
)
def ycbcr_rgb(spark, sf_dir):
    coded = C.rgb_to_ycbcr(rgb())
    back = C.ycbcr_to_rgb(coded)
    return V.rgba(spark, sf_dir).select(*KEY, *[r(c).alias(n) for n, c in zip(("luma", "cb", "cr"), coded, strict=True)], *[r(c).alias(n) for n, c in zip("rgb", back, strict=True)])


@query(
    "WITH s AS (SELECT image_id, x, y, value * 3 AS v FROM px), q AS (SELECT *, floor(least(greatest(v, 0), 1) * 255 + 0.5) AS u, least(greatest(v, -1), 1) * 127 AS h FROM s) "
    "SELECT image_id, x, y, CAST(u AS BIGINT) AS u8, CAST(CASE WHEN h < 0 THEN ceil(h - 0.5) ELSE floor(h + 0.5) END AS BIGINT) AS i8, round(u / 255, 9) + 0 AS u8_back, round((CASE WHEN h < 0 THEN ceil(h - 0.5) ELSE floor(h + 0.5) END) / 127, 9) + 0 AS i8_back FROM q",
    "px",
)
def quantize_u8_i8(spark, sf_dir):
    v = F.col("value") * 3
    u, i = M.quantise(v, "u8"), M.quantise(v, "i8")
    return V.px(spark, sf_dir).select(*KEY, u.alias("u8"), i.alias("i8"), r(M.normalise(u, "u8"), 9).alias("u8_back"), r(M.normalise(i, "i8"), 9).alias("i8_back"))


# Geometry.

PLACES = {1: "x, y", 2: "7 - x, y", 3: "7 - x, 7 - y", 4: "x, 7 - y", 5: "y, x", 6: "7 - y, x", 7: "7 - y, 7 - x", 8: "y, 7 - x"}


@query(" UNION ALL ".join(f"SELECT {o} AS orientation, image_id, CAST(nx AS INTEGER) AS x, CAST(ny AS INTEGER) AS y, value FROM (SELECT image_id, value, {p.split(', ')[0]} AS nx, {p.split(', ')[1]} AS ny FROM px)" for o, p in PLACES.items()), "px")
def orient_all(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    turns = [F.struct(F.lit(o).alias("orientation"), *[c.cast("int").alias(n) for n, c in zip("xy", G.oriented(F.col("x"), F.col("y"), o, 8, 8), strict=True)]) for o in range(1, 9)]
    return rows.select("image_id", "value", F.explode(F.array(*turns)).alias("t")).select("t.orientation", "image_id", "t.x", "t.y", "value")


def _resize_sql(w: int, t: int) -> str:
    s = f"((k + CAST(0.5 AS DOUBLE)) * {w / t!r} - 0.5)"
    axis = f"SELECT CAST(k AS INTEGER) AS k, greatest(floor({s}), 0) AS a, least(greatest(floor({s}), 0) + 1, {w - 1}) AS b, {s} - greatest(floor({s}), 0) AS f FROM (SELECT unnest(range({t})) AS k)"
    corners = " ".join(f"JOIN px {n} ON {n}.x = i.{n[1]} AND {n}.y = j.{n[2]} AND {n}.image_id = paa.image_id" if n != "paa" else "JOIN px paa ON paa.x = i.a AND paa.y = j.a" for n in ("paa", "pba", "pab", "pbb"))
    value = "(paa.value * (1 - i.f) + pba.value * i.f) * (1 - j.f) + (pab.value * (1 - i.f) + pbb.value * i.f) * j.f"
    return f"SELECT {t} AS size, paa.image_id, i.k AS x, j.k AS y, round({value}, 6) + 0 AS value FROM ({axis}) i CROSS JOIN ({axis}) j {corners}"


@query(_resize_sql(8, 12) + " UNION ALL " + _resize_sql(8, 5), "px")
def resize_bilinear(spark, sf_dir):
    rows = V.px(spark, sf_dir)
    parts = [G.resize_bilinear(rows, ["image_id"], (8, 8), (t, t)).select(F.lit(t).alias("size"), *KEY, r("value").alias("value")) for t in (12, 5)]
    return parts[0].unionByName(parts[1])


@query("SELECT image_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, round(avg(value), 6) + 0 AS value FROM px GROUP BY 1, 2, 3", "px")
def mip_reduce(spark, sf_dir):
    return G.mip_reduce(V.px(spark, sf_dir), ["image_id"]).withColumn("value", r("value"))


# Gain maps, tables, colour filters, frames.

GAIN = "SELECT CAST(k % 4 AS INTEGER) AS gx, CAST(k // 4 AS INTEGER) AS gy, CAST((k * 5) % 16 AS DOUBLE) / 16 AS g FROM (SELECT unnest(range(16)) AS k)"


@query(
    f"WITH m AS ({GAIN}) SELECT image_id, x, y, round(abs(value) * (1 + (4 - 1) * g), 6) + 0 AS vendor, round((abs(value) + 0.015625) * pow(CAST(2 AS DOUBLE), (0.5 * (1 - g) + 3 * g) * 0.75) - 0.015625, 6) + 0 AS iso FROM px JOIN m ON x // 2 = gx AND y // 2 = gy",
    "px",
)
def gainmap_apply(spark, sf_dir):
    k = F.col("id")
    gains = spark.range(16).select((k % 4).cast("int").alias("x"), F.floor(k / 4).cast("int").alias("y"), ((k * 5) % 16 / 16.0).alias("g"))
    met = V.px(spark, sf_dir).join(G.replicate_nearest(gains, 2, 2), ["x", "y"])
    v, g = F.abs("value"), F.col("g")
    boost = J.iso_log_boost(g, 0.5, 3.0)
    return met.select(*KEY, r(J.apply_vendor_gain(v, g, 4.0)).alias("vendor"), r(J.apply_iso_gain(v, boost, J.gain_weight(3.0, 0.0, 4.0), 1 / 64, 1 / 64)).alias("iso"))


TABLE = [round(k * k / 15.0, 6) for k in range(16)]
CURVE = [(0.0, 0.0), (0.1, 0.3), (0.25, 0.5), (0.5, 1.0)]


def _lut_sql() -> str:
    table = "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in TABLE) + "]"
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = CURVE
    line = lambda ax, ay, bx, by: f"{ay!r} + (v - {ax!r}) * {(by - ay) / (bx - ax)!r}"
    curve = f"CASE WHEN v < {x1!r} THEN {line(x0, y0, x1, y1)} WHEN v < {x2!r} THEN {line(x1, y1, x2, y2)} ELSE {line(x2, y2, x3, y3)} END"
    at = "least(greatest(v * 2, 0), 1) * 15"
    first = f"CAST(least(floor({at}), 14) AS INTEGER)"
    return (
        f"WITH s AS (SELECT image_id, x, y, abs(value) AS v FROM px), t AS (SELECT *, {table} AS t, {at} AS place, {first} AS i FROM s) SELECT image_id, x, y, t[CAST(least(floor(v * 40), 15) AS INTEGER) + 1] AS palette, "
        f"round(t[i + 1] + (t[i + 2] - t[i + 1]) * (place - i), 6) + 0 AS interpolated, round({curve}, 6) + 0 AS curve FROM t"
    )


@query(_lut_sql(), "px")
def lut_apply(spark, sf_dir):
    v = F.abs("value")
    return V.px(spark, sf_dir).select(*KEY, J.lookup(F.floor(v * 40), TABLE).alias("palette"), r(J.lookup_linear(v * 2, TABLE)).alias("interpolated"), r(J.piecewise_linear(v, CURVE)).alias("curve"))


@query(
    "WITH b AS (SELECT *, ([0.01, 0.02, 0.03, 0.04])[CAST((y % 2) * 2 + x % 2 AS INTEGER) + 1] AS black, (['R', 'G', 'G', 'B'])[CAST((y % 2) * 2 + x % 2 AS INTEGER) + 1] AS filter FROM px) "
    "SELECT image_id, x, y, filter, round((abs(value) - black) / (CAST(1 AS DOUBLE) - CAST(0.04 AS DOUBLE)), 6) + 0 AS value FROM b",
    "px",
)
def cfa_black_level(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    black = J.periodic(x, y, [[0.01, 0.02], [0.03, 0.04]])
    letter = F.element_at(F.array(*[F.lit(c) for c in "RGGB"]), (y % 2 * 2 + x % 2 + 1).cast("int"))
    return V.px(spark, sf_dir).select(*KEY, letter.alias("filter"), r((F.abs("value") - black) / (1.0 - 0.04)).alias("value"))


def _demosaic_sql() -> str:
    rows = ", ".join(f"({tx}, {ty}, '{c}', {dx}, {dy}, CAST({w!r} AS DOUBLE))" for tx, ty, c, dx, dy, w in D.sample_offsets(["RG", "GB"]))
    return (
        f"WITH o(tx, ty, c, dx, dy, w) AS (VALUES {rows}), n AS (SELECT p.image_id, p.x, p.y, c AS channel, CASE WHEN dx = 0 AND dy = 0 THEN CAST(1 AS DOUBLE) ELSE w / (abs(q.value - p.value) + 1e-10) END AS k, q.value AS v "
        "FROM px p JOIN o ON p.x % 2 = tx AND p.y % 2 = ty JOIN px q ON q.image_id = p.image_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7)) "
        "SELECT image_id, x, y, channel, round(sum(v * k) / sum(k), 5) + 0 AS value FROM n GROUP BY ALL"
    )


@query(_demosaic_sql(), "px")
def demosaic_generic(spark, sf_dir):
    return D.demosaic(V.px(spark, sf_dir), ["image_id"], ["RG", "GB"], 8, 8).withColumn("value", r("value", 5))


@query(
    "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY frame) AS k FROM frames), f AS ("
    "SELECT image_id, frame, k, canvas, CASE dispose WHEN 0 THEN canvas WHEN 1 THEN 0 ELSE 0 END AS kept FROM (SELECT *, CASE blend WHEN 0 THEN value ELSE value END AS canvas FROM o WHERE k = 1) "
    "UNION ALL SELECT image_id, frame, k, canvas, CASE dispose WHEN 0 THEN canvas WHEN 1 THEN CAST(0 AS DOUBLE) ELSE kept END FROM (SELECT o.*, f.kept, CASE o.blend WHEN 0 THEN o.value ELSE o.value + f.kept * (1 - o.alpha) END AS canvas FROM o JOIN f ON o.image_id = f.image_id AND o.k = f.k + 1)) "
    "SELECT image_id, frame, round(canvas, 6) + 0 AS canvas FROM f",
    "frames",
)
def frame_composite(spark, sf_dir):
    return J.composite_frames(V.frames(spark, sf_dir), ["image_id"], "frame").withColumn("canvas", r("canvas"))


ORACLE_SQL["frame_composite"] = "WITH RECURSIVE " + ORACLE_SQL["frame_composite"].replace("WITH frames", "frames", 1).replace("RECURSIVE o AS", "o AS", 1)

# Tiles, publishing, list maintenance.

UPSERT = "SELECT image_id, channel, x, y, arg_max(value, seq) AS value FROM tiles GROUP BY ALL"


@query(UPSERT, "tiles")
def tile_upsert(spark, sf_dir):
    from ..streaming.tiles import last_write

    return last_write(V.tiles(spark, sf_dir), ["image_id", "channel", "x", "y"], "seq", "value")


@query(UPSERT, "tiles")
def tile_upsert_stream(spark, sf_dir):
    from ..streaming.tiles import replay_tiles

    return replay_tiles(spark, V.tiles(spark, sf_dir))


def numbered_loads(spark, sf_dir):
    """Loads of each image, numbered from 1 with one number missing."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("image_id").orderBy("seq")).cast("long")
    rows = V.tiles(spark, sf_dir).where("not (image_id % 3 = 0 and seq % 50 = 7)").select("image_id", k.alias("k"))
    return rows.select("image_id", (F.col("k") + F.when(F.col("k") > 5 + F.col("image_id") % 7, 1).otherwise(0)).alias("load_id"))


LOAD_ORDER = (
    "WITH i AS (SELECT image_id, seq FROM tiles WHERE NOT (image_id % 3 = 0 AND seq % 50 = 7)), d AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY seq) + CASE WHEN row_number() OVER (PARTITION BY image_id ORDER BY seq) > 5 + image_id % 7 THEN 1 ELSE 0 END AS load_id FROM i), "
    "g AS (SELECT *, load_id - row_number() OVER (PARTITION BY image_id ORDER BY load_id) AS gap FROM d) SELECT image_id, load_id FROM g WHERE gap = 0"
)


@query(LOAD_ORDER, "tiles")
def load_order_prefix(spark, sf_dir):
    return K.contiguous_prefix(numbered_loads(spark, sf_dir), ["image_id"], "load_id")


@query(
    "WITH v AS (SELECT image_id, channel, ordinal FROM names WHERE contains(channel, 'PROMO')), o AS (SELECT *, lag(ordinal) OVER w AS p, lead(ordinal) OVER w AS n, first(ordinal) OVER (PARTITION BY image_id ORDER BY ordinal) AS f, max(ordinal) OVER (PARTITION BY image_id) AS l FROM v WINDOW w AS (PARTITION BY image_id ORDER BY ordinal)) "
    "SELECT image_id, ordinal, coalesce(p, l) AS previous, coalesce(n, f) AS next FROM o",
    "names",
)
def visible_neighbour(spark, sf_dir):
    shown = V.names(spark, sf_dir).where(N.fuzzy_match(F.col("channel"), "PROMO")).select("image_id", "ordinal")
    return J.neighbours(shown, ["image_id"], ["ordinal"], "ordinal")


@query(
    "WITH c AS (SELECT ordinal AS id, path, ordinal FROM names WHERE ordinal % 3 <> 0), n AS (SELECT ordinal AS id, path || '.new' AS path FROM names WHERE ordinal % 5 = 0), l AS (SELECT max(ordinal) AS last FROM c), "
    "u AS (SELECT id, coalesce(n.path, c.path) AS path, c.ordinal FROM c FULL JOIN n USING (id)), d AS (SELECT id, path, coalesce(ordinal, last + row_number() OVER (PARTITION BY ordinal IS NULL ORDER BY id)) AS ordinal FROM u, l) "
    "SELECT id, path, ordinal FROM d WHERE id NOT IN (SELECT ordinal FROM names WHERE ordinal % 7 = 0)",
    "names",
)
def upsert_catalog(spark, sf_dir):
    rows = V.names(spark, sf_dir)
    current = rows.where("ordinal % 3 <> 0").select(F.col("ordinal").alias("id"), "path", "ordinal")
    changes = rows.where("ordinal % 5 = 0").select(F.col("ordinal").alias("id"), F.concat("path", F.lit(".new")).alias("path"))
    return K.delete(K.upsert(current, changes, "id"), rows.where("ordinal % 7 = 0").select(F.col("ordinal").alias("id")), "id")


@query("SELECT event_id, event_type AS tab, 'k' AS name, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, 1 AS depth, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) <= 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS shown FROM events")
def attribute_flatten(spark, sf_dir):
    value = F.get_json_object("props", "$.k")
    return V.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tab"), F.lit("k").alias("name"), value.alias("value"), F.lit(1).alias("depth"), F.when(value.cast("int") <= 0, "n/a").otherwise(value).alias("shown"))


@query("SELECT seq, image_id, channel, x, y, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM tiles", "tiles")
def packet_decode(spark, sf_dir):
    """Tiles are encoded as update packets, and the packets are decoded again."""
    from ..streaming.packets import decode_tiles, encode_tiles

    return decode_tiles(encode_tiles(V.tiles(spark, sf_dir)))


# Larger inputs.


@query(
    "SELECT grp, round(avg(abs(img - ref)), 4) + 0 AS mae, round(avg((img - ref) * (img - ref) / (ref * ref + 0.01)), 6) + 0 AS rse, min(img - ref) AS low, max(img - ref) AS high, count(*) AS n FROM bigpx GROUP BY grp",
    "bigpx",
)
def big_compare(spark, sf_dir):
    img, ref = F.col("img"), F.col("ref")
    return V.bigpx(spark, sf_dir).groupBy("grp").agg(r(F.avg(C.metric("ae", img, ref)), 4).alias("mae"), r(F.avg(C.metric("rse", img, ref))).alias("rse"), F.min(img - ref).alias("low"), F.max(img - ref).alias("high"), F.count(F.lit(1)).alias("n"))


@query(
    f"WITH l AS (SELECT l_returnflag AS grp, l_extendedprice AS v FROM lineitem), m AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM l GROUP BY grp) SELECT grp, CAST({BIN('v', 'lo', 'hi')} AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS weight FROM l JOIN m USING (grp) GROUP BY ALL"
)
def big_histogram(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("value"), F.lit("L").alias("channel"))
    return S.symlog_histogram(rows, ["grp"]).drop("channel")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and symmetric-log histogram of the absolute error of all images against the first."""
    image = V.px(spark, sf_dir)
    reference = image.where("image_id = 0").select("channel", "x", "y", "value")
    error = J.compare(image, reference, "ae", ["channel"]).select("image_id", "channel", "error")
    histogram = S.symlog_histogram(error, ["image_id"], value="error")
    return histogram.join(S.canvas_stats(error, ["image_id"], "error"), "image_id")
