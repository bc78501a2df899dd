"""Pixel, name, tile and frame views over the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all shuffle partitions, for work that is heavy by row: a small file of many rows is one task otherwise."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 single-channel images: image_id, x, y, channel, value. Samples that a vector lacks are null."""
    v = F.col("embedding")
    padded = F.slice(F.concat(F.coalesce(v, F.array().cast("array<float>")), F.array_repeat(F.lit(None).cast("float"), 64)), 1, 64)
    at = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.when(F.size(v) == 64, v).otherwise(padded)).alias("pos", "v"))
    return at.select("image_id", (F.col("pos") % 8).cast("int").alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.lit("L").alias("channel"), F.col("v").cast("double").alias("value"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors as the channels of one image: image_id, x, y, r, g, b, a."""
    v, k = F.col("value"), F.col("image_id") % 4
    rows = px(spark, sf_dir)
    pick = lambda n: F.max(F.when(k == n, F.abs(v)))
    return rows.groupBy(F.expr("image_id div 4").alias("image_id"), "x", "y").agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), F.least(2.0 * pick(3), F.lit(1.0)).alias("a"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and channel names: image_id, path, channel, ordinal."""
    tail = F.element_at(F.array(*[F.lit(t) for t in ("R", "G", "B", "A", "Z", "depth")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "p_type", F.lit("/"), F.translate("p_name", " ", "_"), F.col("p_size").cast("string"), F.lit(".exr"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("long").alias("image_id"), path.alias("path"), F.concat_ws(".", "p_brand", "p_type", tail).alias("channel"), F.col("p_partkey").alias("ordinal"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-pixel tiles in order of arrival: seq, image_id, channel, x, y, value."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("seq"), F.col("user_id").alias("image_id"), F.col("event_type").alias("channel"), (e % 8).cast("int").alias("x"), (F.floor(e / 8) % 8).cast("int").alias("y"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per frame: image_id, frame, value, alpha, dispose, blend."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("frame"), ((n % 7) / 7.0).alias("value"), ((n % 10) / 10.0).alias("alpha"), (F.col("turn") % 3).cast("int").alias("dispose"), (F.col("turn") % 2).cast("int").alias("blend"))


def bigpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and reference values: grp, img, ref."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("img"), (F.col("l_quantity") * F.col("p_retailprice")).alias("ref"))


SQL = {
    "px": """SELECT vec_id AS image_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, 'L' AS channel, CAST(embedding[pos + 1] AS DOUBLE) AS value
             FROM embeddings, (SELECT unnest(range(64)) AS pos)""",
    "rgba": """SELECT vec_id // 4 AS image_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
               max(CASE WHEN vec_id % 4 = 0 THEN abs(CAST(embedding[pos + 1] AS DOUBLE)) END) AS r, max(CASE WHEN vec_id % 4 = 1 THEN abs(CAST(embedding[pos + 1] AS DOUBLE)) END) AS g,
               max(CASE WHEN vec_id % 4 = 2 THEN abs(CAST(embedding[pos + 1] AS DOUBLE)) END) AS b,
               least(CAST(2 AS DOUBLE) * max(CASE WHEN vec_id % 4 = 3 THEN abs(CAST(embedding[pos + 1] AS DOUBLE)) END), CAST(1 AS DOUBLE)) AS a
               FROM embeddings, (SELECT unnest(range(64)) AS pos) GROUP BY 1, 2, 3""",
    "names": """SELECT CAST(p_partkey % 50 AS BIGINT) AS image_id, '/data/' || p_type || '/' || replace(p_name, ' ', '_') || p_size || '.exr' AS path,
                p_brand || '.' || p_type || '.' || (['R', 'G', 'B', 'A', 'Z', 'depth'])[p_partkey % 6 + 1] AS channel, p_partkey AS ordinal FROM part""",
    "tiles": "SELECT event_id AS seq, user_id AS image_id, event_type AS channel, CAST(event_id % 8 AS INTEGER) AS x, CAST((event_id // 8) % 8 AS INTEGER) AS y, value FROM events",
    "frames": """SELECT conv_id AS image_id, turn AS frame, (length(text) % 7) / CAST(7 AS DOUBLE) AS value, (length(text) % 10) / CAST(10 AS DOUBLE) AS alpha,
                 CAST(turn % 3 AS INTEGER) AS dispose, CAST(turn % 2 AS INTEGER) AS blend FROM conversations""",
    "bigpx": "SELECT l_returnflag AS grp, l_extendedprice AS img, l_quantity * p_retailprice AS ref FROM lineitem JOIN part ON l_partkey = p_partkey",
}


def sql(query: str, *views: str) -> str:
    """The query with those views in front of it."""
    parts = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    query = query.strip()
    return f"WITH {parts}, {query[5:]}" if query.upper().startswith("WITH ") else f"WITH {parts} {query}"
