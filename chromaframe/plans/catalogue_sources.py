"""Registered queries that go through the registered sources and the stateful streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import boxes
from ..sources import bands, images
from ..streaming import graphics, packet_log, packets, publish, tiles
from ..storage import shared_folder
from . import views as V
from .catalogue import LOAD_ORDER, numbered_loads, query


@query(
    "SELECT image_id, 'R' AS channel, x, y, r AS value FROM rgba WHERE y >= 2 AND x < 6 UNION ALL SELECT image_id, 'A', x, y, a FROM rgba WHERE y >= 2 AND x < 6",
    "rgba",
)
def image_bands(spark, sf_dir):
    """All images as float files, and two channels of a part of each back."""
    folder = shared_folder(spark, "image-bands")
    pixels = V.rgba(spark, sf_dir).withColumn("path", F.concat(F.col("image_id").cast("string"), F.lit(".pfm")))
    images.write_images(images.encode_images(pixels, "pfm").select("path", "content"), folder)
    samples = bands.read_bands(spark, folder).where("channel in ('R', 'A') and y >= 2 and x < 6")
    image_id = F.regexp_extract("path", r"([0-9]+)\.pfm$", 1).cast("long")
    return bands.linear_values(samples).select(image_id.alias("image_id"), "channel", "x", "y", "value")


@query("SELECT image_id, channel, x, y, CAST(CAST(arg_max(value, seq) AS FLOAT) AS DOUBLE) AS value FROM tiles GROUP BY ALL", "tiles")
def tile_packet_log(spark, sf_dir):
    """All tiles as packets into a log, in their order, and from the log as a stream into a table."""
    folder = shared_folder(spark, "packets")
    packet_log.write_packets(packets.encode_tiles(V.tiles(spark, sf_dir)), f"{folder}/log", ["seq"])
    keys = ["image_id", "channel", "x", "y"]
    table = tiles.TileTable(spark, f"{folder}/table", keys, "seq", "value")
    received = packets.decode_tiles(packet_log.stream_packets(spark, f"{folder}/log"))
    received.writeStream.foreachBatch(table.merge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return table.read().select(*keys, "value")


@query(LOAD_ORDER, "tiles")
def load_order_stream(spark, sf_dir):
    """Loads that come in no order, as a stream of several batches that publishes them in order."""
    folder = shared_folder(spark, "publish")
    numbered_loads(spark, sf_dir).repartition(4, F.xxhash64("image_id", "load_id")).write.parquet(f"{folder}/in")
    arrivals = spark.readStream.schema("image_id long, load_id long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out = publish.published(arrivals, ["image_id"], "load_id", 1).writeStream.format("parquet").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# Vector graphics and focus: events as packets for the image of their user.

PACKETS = """p AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS image, user_id % 5 AS host, event_id % 3 AS n, event_id % 4 = 0 AS focus, event_type = 'click' OR value >= 250 AS append,
        CASE event_type WHEN 'signup' THEN 'begin' WHEN 'error' THEN 'end' WHEN 'view' THEN 'update' ELSE 'draw' END AS what FROM events)"""
TRACED = f"""{PACKETS}, w AS (
        SELECT *, last_value(CASE WHEN what IN ('begin', 'end') THEN what END IGNORE NULLS) OVER o = 'begin' AS there, max(CASE WHEN what = 'begin' OR (what = 'draw' AND NOT append) THEN seq END) OVER o AS since
        FROM p WINDOW o AS (PARTITION BY image ORDER BY seq)
    ), t AS (
        SELECT image, host, seq, focus, coalesce(there, false) AS exists, CASE WHEN there THEN (SELECT coalesce(sum(q.n), 0) FROM p q WHERE q.image = w.image AND q.what = 'draw' AND q.seq BETWEEN w.since AND w.seq) ELSE 0 END AS commands FROM w
    )"""


def event_packets(spark, sf_dir):
    op = F.when(F.col("event_type") == "signup", packets.CREATE).when(F.col("event_type") == "error", packets.CLOSE).when(F.col("event_type") == "view", packets.UPDATE_V3).otherwise(packets.VECTOR)
    command = F.struct((F.col("event_id") % 27).cast("int").alias("op"), F.array(F.col("value").cast("float")).alias("args"), F.lit(None).cast("string").alias("text"))
    return V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("image"), (F.col("user_id") % 5).alias("host"), op.alias("op"),
        ((F.col("event_type") == "click") | (F.col("value") >= 250)).alias("append"), (F.col("event_id") % 4 == 0).alias("grab_focus"),
        F.array_repeat(command, (F.col("event_id") % 3).cast("int")).alias("commands"),
    )


@query(
    f"WITH {PACKETS}, l AS (SELECT image, arg_max(what, seq) FILTER (what IN ('begin', 'end')) AS state, max(seq) FILTER (what = 'begin' OR (what = 'draw' AND NOT append)) AS since FROM p GROUP BY 1) "
    "SELECT image, seq, CAST(k AS INTEGER) AS position, CAST(seq % 27 AS INTEGER) AS op FROM p JOIN l USING (image), unnest(range(n)) AS u(k) WHERE state = 'begin' AND what = 'draw' AND seq >= since"
)
def vector_graphics(spark, sf_dir):
    return graphics.drawn(event_packets(spark, sf_dir)).select("image", "seq", "position", F.col("command.op").alias("op"))


@query(f"WITH {TRACED} SELECT image, seq, exists, CAST(commands AS BIGINT) AS commands FROM t")
def vector_graphics_trace(spark, sf_dir):
    return graphics.traced(event_packets(spark, sf_dir)).select("image", "seq", "exists", "commands")


@query(f"WITH {TRACED} SELECT host, arg_max(image, seq) AS selected FROM t WHERE exists AND focus GROUP BY 1")
def focused_images(spark, sf_dir):
    return graphics.focused(event_packets(spark, sf_dir), ["host"])


@query(
    f"WITH {PACKETS}, l AS (SELECT image, arg_max(what, seq) FILTER (what IN ('begin', 'end')) AS state, max(seq) FILTER (what = 'begin' OR (what = 'draw' AND NOT append)) AS since FROM p GROUP BY 1) "
    "SELECT image, max(p.seq) AS seq, CASE WHEN any_value(state) = 'begin' THEN coalesce(sum(n) FILTER (what = 'draw' AND p.seq >= since), 0) ELSE -1 END::INTEGER AS commands FROM p JOIN l USING (image) GROUP BY 1"
)
def vector_graphics_stream(spark, sf_dir):
    """The same packets as a stream that is stopped half-way, and what each image bears after its last packet."""
    folder = shared_folder(spark, "graphics")
    sent = event_packets(spark, sf_dir)
    half = sent.agg(F.max("seq")).first()[0] or 0
    table = tiles.TileTable(spark, f"{folder}/table", ["image"], "seq", "commands")
    for part in (F.col("seq") * 2 <= half, F.col("seq") * 2 > half):
        sent.where(part).write.mode("append").parquet(f"{folder}/in")
        borne = graphics.drawn_stream(spark.readStream.schema(sent.schema).parquet(f"{folder}/in"))
        counted = borne.select("image", "seq", F.coalesce(F.size("commands"), F.lit(-1)).alias("commands"))
        counted.writeStream.foreachBatch(table.merge).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("image", "seq", "commands")


# Packets of all kinds, as bytes and back; some lack their last byte.


def _payloads(op: pd.Series, image: pd.Series, seq: pd.Series) -> pd.Series:
    made = {
        packets.CREATE: lambda i, k: packets.create_image(i, k % 100 + 1, k % 50 + 1, ["R", "G"][: k % 2 + 1]), packets.CLOSE: lambda i, k: packets.close_image(i), packets.RELOAD: lambda i, k: packets.reload_image(i, k % 2 == 1),
        packets.OPEN_V2: lambda i, k: packets.open_image(i, "r,g" if k % 3 else "", k % 2 == 1), packets.VECTOR: lambda i, k: packets.vector_graphics(i, [(12, [1.0, 2.0], None)] * (k % 4), k % 5 == 0, k % 2 == 1),
    }
    out = []
    for o, i, k in zip(op, image, seq, strict=True):
        (payload,), _ = packets.split_frames(packets.frame(made[o](i, k)))
        out.append(payload[:-1] if k % 17 == 3 else payload)
    return pd.Series(out)


@query(
    """WITH p AS (SELECT event_id AS k, 'image ' || user_id AS image, CASE event_type WHEN 'signup' THEN 4 WHEN 'error' THEN 2 WHEN 'view' THEN 1 WHEN 'click' THEN 7 ELSE 8 END AS op, event_id % 17 = 3 AS cut FROM events)
        SELECT k AS seq, CASE WHEN NOT cut THEN op END AS op, CASE WHEN NOT cut THEN image END AS image, CASE WHEN NOT cut AND op <> 2 AND op <> 4 THEN k % 2 = 1 WHEN NOT cut AND op = 4 THEN false END AS grab_focus,
            CASE WHEN NOT cut AND op = 7 THEN CASE WHEN k % 3 > 0 THEN 'r,g' ELSE '' END END AS selector, CASE WHEN NOT cut AND op = 4 THEN CAST(k % 100 + 1 AS INTEGER) END AS width, CASE WHEN NOT cut AND op = 4 THEN CAST(k % 50 + 1 AS INTEGER) END AS height,
            CASE WHEN NOT cut AND op = 4 THEN CASE WHEN k % 2 = 1 THEN 'R,G' ELSE 'R' END END AS channels, CASE WHEN NOT cut AND op = 8 THEN k % 5 = 0 END AS append, CASE WHEN NOT cut AND op = 8 THEN CAST(k % 4 AS INTEGER) END AS commands,
            CASE WHEN cut THEN CASE WHEN op = 8 THEN 'the packet ends early' ELSE 'a string without its end' END END AS error FROM p"""
)
def packet_fields(spark, sf_dir):
    kind = F.col("event_type")
    op = F.when(kind == "signup", packets.CREATE).when(kind == "error", packets.CLOSE).when(kind == "view", packets.RELOAD).when(kind == "click", packets.OPEN_V2).otherwise(packets.VECTOR)
    sent = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.pandas_udf(_payloads, "binary")(op, F.concat(F.lit("image "), F.col("user_id").cast("string")), "event_id").alias("payload"))
    got = packets.decode_packets(sent)
    commands = F.when(F.col("commands").isNotNull(), F.size("commands"))
    return got.select("seq", "op", "image", "grab_focus", "selector", "width", "height", F.array_join("channels", ",").alias("channels"), "append", commands.alias("commands"), "error")


# A box for each part, its area shared with a fixed one, and the box around all of a brand.

BOXED = "b AS (SELECT p_partkey AS k, p_brand AS brand, least(p_size % 7, p_size % 11) AS x0, p_size % 5 AS y0, greatest(p_size % 7, p_size % 11) + 1 AS x1, p_size % 5 + p_size % 4 AS y1 FROM part)"


def part_boxes(spark, sf_dir):
    size = F.col("p_size")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    across = boxes.from_points(point(size % 7, size % 5), point(size % 11, size % 5 + size % 4), drag=True)
    shorter = boxes.box(across["min_x"], across["min_y"], across["max_x"], across["max_y"] - 1)
    return V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), shorter.alias("box"))


@query(
    f"WITH {BOXED}, i AS (SELECT *, greatest(x0, 2) AS a, greatest(y0, 1) AS b, least(x1, 8) AS c, least(y1, 5) AS d FROM b) SELECT k AS p_partkey, CASE WHEN c >= a AND d >= b THEN (c - a) * (d - b) ELSE 0 END::BIGINT AS shared, "
    "(x1 - x0)::BIGINT * (y1 - y0) AS area, 4 >= x0 AND 4 < x1 AND 3 >= y0 AND 3 < y1 AS has_point, x0 >= 2 AND x0 < 9 AND y0 >= 1 AND y0 < 6 AND x1 >= 2 AND x1 < 9 AND y1 >= 1 AND y1 < 6 AS held FROM i"
)
def box_overlaps(spark, sf_dir):
    fixed, own = boxes.box(*[F.lit(v) for v in (2, 1, 8, 5)]), F.col("box")
    rows = part_boxes(spark, sf_dir).withColumn("both", boxes.intersect(own, fixed))
    return rows.select("p_partkey", boxes.area(F.col("both")).alias("shared"), boxes.area(own).alias("area"), boxes.contains(own, F.lit(4), F.lit(3)).alias("has_point"), boxes.contains_box(fixed, own).alias("held"))


@query(f"WITH {BOXED} SELECT brand, min(x0)::INTEGER AS min_x, min(y0)::INTEGER AS min_y, max(x1)::INTEGER AS max_x, max(y1)::INTEGER AS max_y FROM b GROUP BY 1")
def bounding_boxes(spark, sf_dir):
    return part_boxes(spark, sf_dir).groupBy("brand").agg(boxes.bounding(F.col("box")).alias("b")).select("brand", "b.*")
