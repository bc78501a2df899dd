"""Registered queries over metadata in bytes and markup: blocks are built from table columns and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import camera, gainmap, header, ifd, rdf
from ..functions.binary import packed
from ..functions.color import BRADFORD, ILLUMINANTS, lit
from . import views as V
from .catalogue import query, r


def tagged_blocks(spark, sf_dir):
    """A block of two directories for each part, in either byte order; some loop, some are cut."""
    part = V.spread(V.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    key = F.col("p_partkey")
    little = key % 2 == 0
    number = lambda v, size: packed(F.lit(v) if isinstance(v, int) else v.cast("bigint"), size, little)
    entry = lambda tag, kind, count, value: F.concat(number(tag, 2), number(kind, 2), number(count, 4), value)
    pad = F.unhex(F.lit("0000"))
    make = F.concat(F.encode("p_brand", "UTF-8"), F.unhex(F.lit("00")))
    block = F.concat(
        F.when(little, F.unhex(F.lit("4949"))).otherwise(F.unhex(F.lit("4D4D"))), number(42, 2), number(8, 4),
        number(4, 2), entry(0x0100, 4, 1, number(key, 4)), entry(0x010F, 2, F.length(make), number(92, 4)), entry(0x0112, 3, 1, F.concat(number(F.col("p_size") % 10, 2), pad)), entry(0x8769, 4, 1, number(62, 4)),
        number(F.when(key % 7 == 3, 62).otherwise(0), 4),
        number(2, 2), entry(0x829A, 5, 1, number(92 + F.length(make), 4)), entry(0xA001, 3, 1, F.concat(number(key % 3, 2), pad)), number(0, 4),
        make, number(F.col("p_size"), 4), number(7, 4),
    )
    return part.select("p_partkey", F.when(key % 11 == 5, F.substring(block, 1, 70)).otherwise(block).alias("block"))


TAGGED = r"""e AS (
        SELECT p_partkey, '0' AS path, 256 AS tag, CAST(p_partkey AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM part
        UNION ALL SELECT p_partkey, '0', 271, CASE WHEN p_partkey % 11 <> 5 THEN p_brand END, CASE WHEN p_partkey % 11 = 5 THEN 'offset overflow 92+' || (length(p_brand) + 1) || ' vs. 70' END FROM part
        UNION ALL SELECT p_partkey, '0', 274, CAST(p_size % 10 AS VARCHAR), NULL FROM part UNION ALL SELECT p_partkey, '0', 34665, '62', NULL FROM part
        UNION ALL SELECT p_partkey, '0/EXIF', 33434, regexp_replace(printf('%.6f', p_size / CAST(7 AS DOUBLE)), '\.?0+$', ''), NULL FROM part WHERE p_partkey % 11 <> 5
        UNION ALL SELECT p_partkey, '0/EXIF', 40961, CAST(p_partkey % 3 AS VARCHAR), NULL FROM part WHERE p_partkey % 11 <> 5
        UNION ALL SELECT p_partkey, NULL, NULL, NULL, CASE WHEN p_partkey % 11 = 5 THEN 'too short for 2 tags' ELSE 'directory at 62 twice' END FROM part WHERE p_partkey % 11 = 5 OR p_partkey % 7 = 3
    )"""


@query(f"WITH {TAGGED} SELECT * FROM e")
def tag_directories(spark, sf_dir):
    rows = ifd.directory_rows(tagged_blocks(spark, sf_dir), "p_partkey", "block")
    return rows.select("p_partkey", "path", "tag", ifd.shown_value(F.col("numbers"), F.col("text"), F.col("bytes")).alias("value"), "error")


@query(
    f"WITH {TAGGED} SELECT p_partkey, 'EXIF/' || path AS path, CASE tag WHEN 256 THEN 'ImageWidth' WHEN 271 THEN 'Make' WHEN 274 THEN 'Orientation' WHEN 34665 THEN 'ExifIfdPointer' WHEN 33434 THEN 'ExposureTime' ELSE 'ColorSpace' END AS name, value, "
    "CASE tag WHEN 256 THEN 'LONG' WHEN 271 THEN 'ASCII' WHEN 274 THEN 'SHORT' WHEN 34665 THEN 'LONG' WHEN 33434 THEN 'RATIONAL' ELSE 'SHORT' END AS type FROM e WHERE error IS NULL"
)
def exif_attributes(spark, sf_dir):
    return ifd.attribute_rows(ifd.directory_rows(tagged_blocks(spark, sf_dir), "p_partkey", "block"), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 10 BETWEEN 1 AND 8 THEN p_size % 10 ELSE 0 END::INTEGER AS orientation, false AS force_srgb FROM part")
def exif_picture(spark, sf_dir):
    """The colour space stands in the second directory here, where it does not count."""
    return ifd.picture_rows(ifd.directory_rows(tagged_blocks(spark, sf_dir), "p_partkey", "block"), "p_partkey")


# Markup: a packet for each page.


def page_packets(spark, sf_dir):
    """Some packets have a second description that says a property again, some leave an element open."""
    page = V.table(spark, sf_dir, "pages").where("url is not null")
    text = lambda v: F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number, host = F.col("page_id"), F.split_part("url", F.lit("/"), F.lit(3))
    shown = lambda v: v.cast("string")
    again = F.when(number % 4 == 1, F.concat(F.lit('<rdf:Description xmp:Rating="'), shown(number % 6 + 10), F.lit('"/>'))).otherwise("")
    items = F.array_join(F.transform(F.split(host, r"\."), lambda p: F.concat(F.lit("<rdf:li>"), text(p), F.lit("</rdf:li>"))), "")
    xml = F.concat(
        F.lit('<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><rdf:Description rdf:about="" xmp:Rating="'), shown(number % 6), F.lit('" tiff:Orientation="'), shown(number % 10),
        F.lit('" hdrgm:Version="1.0" hdrgm:HDRCapacityMax="'), shown(number % 5), F.lit('" hdrgm:GainMapMax="'), shown(number % 7 / 2.0), F.lit(',3,1.5">\n <dc:source>'), text(F.col("url")), F.lit("</dc:source><dc:subject><rdf:Bag>"), items,
        F.lit('</rdf:Bag></dc:subject><a:b rdf:parseType="Resource"><c:d>'), shown(number), F.lit("</c:d></a:b>"), F.when(number % 9 == 2, "").otherwise("</rdf:Description>"), again, F.lit("</rdf:RDF></x:xmpmeta>"),
    )
    return page.select("page_id", xml.alias("xml"))


PROPERTIES = """g AS (SELECT page_id, url, split_part(url, '/', 3) AS host, page_id % 9 = 2 AS bad FROM pages WHERE url IS NOT NULL), l AS (
        SELECT page_id, 0 AS ord, 'xmp:Rating' AS property, CAST(CASE WHEN page_id % 4 = 1 THEN page_id % 6 + 10 ELSE page_id % 6 END AS VARCHAR) AS value FROM g WHERE NOT bad
        UNION ALL SELECT page_id, 1, 'tiff:Orientation', CAST(page_id % 10 AS VARCHAR) FROM g WHERE NOT bad UNION ALL SELECT page_id, 2, 'hdrgm:Version', '1.0' FROM g WHERE NOT bad
        UNION ALL SELECT page_id, 3, 'hdrgm:HDRCapacityMax', CAST(page_id % 5 AS VARCHAR) FROM g WHERE NOT bad
        UNION ALL SELECT page_id, 4, 'hdrgm:GainMapMax', printf('%.1f', (page_id % 7) / CAST(2 AS DOUBLE)) || ',3,1.5' FROM g WHERE NOT bad
        UNION ALL SELECT page_id, 5, 'dc:source', url FROM g WHERE NOT bad
        UNION ALL SELECT page_id, CAST(5 + k AS INTEGER), 'dc:subject[' || k || ']', string_split(host, '.')[k] FROM g, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(k) WHERE NOT bad AND string_split(host, '.')[k] <> ''
        UNION ALL SELECT page_id, CAST(6 + len(list_filter(string_split(host, '.'), lambda x: x <> '')) AS INTEGER), 'a:b/c:d', CAST(page_id AS VARCHAR) FROM g WHERE NOT bad
    )"""


@query(f"WITH {PROPERTIES} SELECT page_id, ord, property, value, CAST(NULL AS VARCHAR) AS error FROM l UNION ALL SELECT page_id, NULL, NULL, NULL, 'elements are not closed in order' FROM g WHERE bad")
def packet_properties(spark, sf_dir):
    return rdf.leaf_rows(page_packets(spark, sf_dir), "page_id", "xml").select("page_id", "ord", "property", "value", "error")


@query(
    f"WITH {PROPERTIES}, t AS (SELECT *, regexp_extract_all(property, '[^:/]*[:/]|[^:/]+') AS parts FROM l) "
    "SELECT page_id, ord, array_to_string(list_concat(['XMP'], parts[1:len(parts) - 1]), '/') AS path, CAST(len(parts) AS INTEGER) AS depth, parts[len(parts)] AS name, value FROM t"
)
def packet_tree(spark, sf_dir):
    return rdf.tree_rows(rdf.leaf_rows(page_packets(spark, sf_dir), "page_id", "xml"), "page_id")


@query(
    f"WITH {PROPERTIES} SELECT page_id, CAST(page_id % 5 AS DOUBLE) AS headroom, array_to_string(list_transform([greatest((page_id % 7) / CAST(2 AS DOUBLE), 0), 3, 1.5], lambda v: printf('%.3f', v)), ',') AS gain_max, "
    "'0.016,0.016,0.016' AS base_offset, CAST(NULL AS VARCHAR) AS error FROM g WHERE NOT bad"
)
def packet_gain_maps(spark, sf_dir):
    found = gainmap.property_gain_map(rdf.leaf_rows(page_packets(spark, sf_dir), "page_id", "xml"), "page_id")
    shown = lambda c: F.array_join(F.transform(f"gain_map.{c}", lambda v: F.format_string("%.3f", v)), ",")
    return found.select("page_id", F.col("gain_map.alternate_headroom").alias("headroom"), shown("gain_max").alias("gain_max"), shown("base_offset").alias("base_offset"), F.col("gain_map.error").alias("error"))


# Gain-map records: one for each part, with one channel or three, fractions or a common denominator; some lead backward, some are cut.


@query(
    r"""WITH p AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 3 = 0 THEN 1000 ELSE 64 END AS d, p_partkey % 4 = 1 AS backward, p_partkey % 13 = 5 AS cut, p_partkey % 2 = 1 AS three FROM part)
        SELECT k AS p_partkey, CASE WHEN NOT cut THEN CASE WHEN backward THEN (k % 9) ELSE s END / CAST(d AS DOUBLE) END AS base_headroom, CASE WHEN NOT cut THEN CASE WHEN backward THEN s ELSE (k % 9) END / CAST(d AS DOUBLE) END AS alternate_headroom,
            CASE WHEN NOT cut THEN array_to_string(list_transform(range(3), lambda c: printf('%.6f', (-s - CASE WHEN three THEN c ELSE 0 END) / CAST(d AS DOUBLE))), ',') END AS gain_min,
            CASE WHEN NOT cut THEN array_to_string(list_transform(range(3), lambda c: printf('%.6f', (CASE WHEN backward THEN -7 ELSE 5 END + CASE WHEN three THEN c ELSE 0 END) / CAST(d AS DOUBLE))), ',') END AS base_offset,
            CASE WHEN cut THEN 'not enough data' END AS error FROM p"""
)
def gain_map_records(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    channel = lambda c: [-s - c, s + c, F.lit(100 + c), F.lit(5 + c), F.lit(-7 + c)]
    record = lambda n, d, common: gainmap.packed_gain_map([s, k % 9], [channel(c) for c in range(n)], d, F.when(k % 4 == 1, gainmap.BACKWARD).otherwise(0), common)
    common = lambda n: F.when(k % 3 == 0, record(n, 1000, True)).otherwise(record(n, 64, False))
    data = F.when(k % 2 == 1, common(3)).otherwise(common(1))
    data = F.when(k % 13 == 5, F.substring(data, 1, 20)).otherwise(data)
    part = V.spread(V.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    found = part.select("p_partkey", data.alias("data")).select("p_partkey", gainmap.iso_gain_map(F.col("data")).alias("g"))
    shown = lambda c: F.array_join(F.transform(f"g.{c}", lambda v: F.format_string("%.6f", v)), ",")
    return found.select("p_partkey", "g.base_headroom", "g.alternate_headroom", shown("gain_min").alias("gain_min"), shown("base_offset").alias("base_offset"), "g.error")


# Camera matrices: one camera for each vector, some without one or another of the matrices.


def _camera_sql() -> str:
    product = lambda a, b: "[" + ", ".join(f"{a}[{3 * i + 1}] * {b}[{j + 1}] + {a}[{3 * i + 2}] * {b}[{j + 4}] + {a}[{3 * i + 3}] * {b}[{j + 7}]" for i in range(3) for j in range(3)) + "]"
    times = lambda m, v: "[" + ", ".join(f"{m}[{3 * i + 1}] * {v}[1] + {m}[{3 * i + 2}] * {v}[2] + {m}[{3 * i + 3}] * {v}[3]" for i in range(3)) + "]"
    at = lambda i, j: f"m[{3 * (i % 3) + j % 3 + 1}]"
    minor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    numbers = lambda m: "[" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in np.asarray(m).ravel()) + "]"
    matrix = lambda first, by: "[" + ", ".join(f"CAST({int(k % 4 == 0)} AS DOUBLE) + CAST({by} AS DOUBLE) * v[{first + k}]" for k in range(9)) + "]"
    bx, by = ILLUMINANTS["D50"]
    white = numbers([bx / by, 1.0, (1 - bx - by) / by])
    return f"""
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (
            SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 3 WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS source, {matrix(1, 0.3)} AS m1, {matrix(19, 0.3)} AS m2, {matrix(10, 0.3)} AS m3, {matrix(28, 0.1)} AS c2, {numbers(np.eye(3))} AS one,
                [1 + CAST(0.2 AS DOUBLE) * v[37], 1 + CAST(0.2 AS DOUBLE) * v[38], 1 + CAST(0.2 AS DOUBLE) * v[39]] AS b, CASE WHEN vec_id % 5 <> 0 THEN [CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * v[40], CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * v[41], CAST(0.8 AS DOUBLE) + CAST(0.2 AS DOUBLE) * v[42]] END AS neutral,
                CASE WHEN vec_id % 2 = 0 THEN [CAST(0.31 AS DOUBLE) + CAST(0.01 AS DOUBLE) * v[43], CAST(0.33 AS DOUBLE)] END AS given FROM e
        ), q AS (SELECT *, CASE source WHEN 3 THEN m3 WHEN 2 THEN m2 ELSE m1 END AS cm, CASE source WHEN 2 THEN c2 ELSE one END AS c FROM p), q1 AS (SELECT *, {product("c", "cm")} AS x FROM q),
        q2 AS (SELECT * EXCLUDE (m1, m2, m3), list_transform(range(1, 10), lambda k: b[(k - 1) // 3 + 1] * x[k]) AS m FROM q1), q3 AS (SELECT *, m[1] * {minor(0, 0)} + m[2] * {minor(0, 1)} + m[3] * {minor(0, 2)} AS det FROM q2),
        q4 AS (SELECT *, [{", ".join(f"{minor(j, i)} / det" for i in range(3) for j in range(3))}] AS inv FROM q3), q5 AS (SELECT *, {times("inv", "neutral")} AS seen FROM q4),
        q6 AS (SELECT *, CASE WHEN neutral IS NOT NULL THEN [seen[1] / (seen[1] + seen[2] + seen[3]), seen[2] / (seen[1] + seen[2] + seen[3])] ELSE given END AS w, {numbers(BRADFORD)} AS cone, {white} AS d50 FROM q5),
        q7 AS (SELECT *, [w[1] / w[2], 1, (1 - w[1] - w[2]) / w[2]] AS wx FROM q6), q8 AS (SELECT *, {times("cone", "d50")} AS target, {times("cone", "wx")} AS own FROM q7),
        q9 AS (SELECT *, list_transform(range(1, 10), lambda k: CASE WHEN w IS NULL THEN 1 ELSE target[(k - 1) // 3 + 1] / own[(k - 1) // 3 + 1] END * cone[k]) AS scaled, {numbers(np.linalg.inv(np.array(BRADFORD)))} AS back FROM q8),
        q10 AS (SELECT *, {product("back", "scaled")} AS adapt FROM q9), q11 AS (SELECT *, {product("adapt", "inv")} AS y, {numbers(camera.rec709_from_d50())} AS last FROM q10), q12 AS (SELECT vec_id, source, {product("last", "y")} AS z FROM q11)
        SELECT vec_id, source, CAST(k AS INTEGER) AS place, round(z[k + 1], 5) + 0 AS value FROM q12, unnest(range(9)) AS u(k)
    """


@query(_camera_sql())
def camera_matrices(spark, sf_dir):
    v = lambda k: F.col("embedding")[k - 1].cast("double")
    matrix = lambda first, by: F.array(*[lit(float(k % 4 == 0)) + lit(by) * v(first + k) for k in range(9)])
    three = lambda first, start: F.array(*[lit(start) + lit(0.2) * v(first + k) for k in range(3)])
    none = F.lit(None).cast("array<double>")
    key = F.col("vec_id")
    cameras = V.table(spark, sf_dir, "embeddings").select(
        "vec_id", three(37, 1.0).alias("analog_balance"), matrix(1, 0.3).alias("color_matrix1"), F.when(key % 3 == 0, matrix(19, 0.3)).alias("color_matrix2"), F.when(key % 4 == 3, matrix(10, 0.3)).alias("color_matrix3"),
        none.alias("calibration1"), matrix(28, 0.1).alias("calibration2"), none.alias("calibration3"), F.when(key % 5 != 0, three(40, 0.8)).alias("as_shot_neutral"),
        F.when(key % 2 == 0, F.array(lit(0.31) + lit(0.01) * v(43), lit(0.33))).alias("as_shot_white"),
    )
    found = camera.camera_matrices(cameras, "vec_id")
    return found.select("vec_id", "source", F.posexplode("to_rec709").alias("place", "value")).withColumn("value", r("value", 5))


# Headers of attributes: one for each part, some without their last bytes.

PACKINGS = header.NAMED["compression"]


@query(
    f"""WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey % 9 = 4 AS cut, ({list(PACKINGS)})[p_partkey % 12 + 1] AS packing FROM part)
        SELECT p_partkey, 0 AS position, 'owner' AS name, 'string' AS type, CAST(NULL AS DOUBLE) AS number, p_brand AS text, CAST(NULL AS VARCHAR) AS error FROM p
        UNION ALL SELECT p_partkey, 1, 'size', 'int', CAST(p_size AS DOUBLE), NULL, NULL FROM p
        UNION ALL SELECT p_partkey, 2, 'packing', 'compression', NULL, coalesce(packing, 'invalid'), NULL FROM p WHERE NOT cut
        UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'no 1 bytes for packing' FROM p WHERE cut"""
)
def header_attributes(spark, sf_dir):
    little = F.lit(True)
    text = lambda s: F.encode(F.lit(s), "UTF-8")
    part = V.spread(V.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    brand = F.encode("p_brand", "UTF-8")
    block = F.concat(
        F.unhex(F.lit(header.MAGIC + "02000000")), text("owner\0string\0"), packed(F.length(brand), 4, little), brand, text("size\0int\0"), packed(F.lit(4), 4, little), packed(F.col("p_size"), 4, little),
        text("packing\0compression\0"), packed(F.lit(1), 4, little), packed(F.col("p_partkey") % 12, 1, little), F.unhex(F.lit("00")),
    )
    cut = F.when(F.col("p_partkey") % 9 == 4, F.substring(block, 1, F.length(block) - 2)).otherwise(block)
    rows = header.header_rows(part.select("p_partkey", cut.alias("block")), "p_partkey", "block")
    return rows.select("p_partkey", "position", "name", "type", F.col("numbers")[0].alias("number"), "text", "error")
