import math
import random
import re
import struct

from pyspark.sql import functions as F

from chromaframe.functions import ifd
from chromaframe.plans import catalogue_metadata as metadata


def tiff(directories, order="<", links=None):
    """A block of directories [(tag, type, count, bytes)], chained as links say (place in the list of the next one)."""
    places, at = [], 8
    for entries in directories:
        places.append(at)
        at += 2 + 12 * len(entries) + 4
    body, tail = b"", b""
    for k, entries in enumerate(directories):
        body += struct.pack(order + "H", len(entries))
        for tag, kind, count, data in entries:
            if isinstance(data, int):
                data = struct.pack(order + "I", places[data])
            elif len(data) > 4:
                tail, data = tail + data, struct.pack(order + "I", at + len(tail))
            body += struct.pack(order + "HHI", tag, kind, count) + data.ljust(4, b"\0")
        following = (links or {}).get(k)
        body += struct.pack(order + "I", 0 if following is None else places[following])
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + tail


FORMS = {1: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


def plain(data):
    """The walk in plain Python: entries by path, and the error that ends it."""
    if data is None or len(data) < 8 or data[:2] not in (b"II", b"MM"):
        return {}, "no byte order"
    order = "<" if data[:2] == b"II" else ">"
    get = lambda form, at: struct.unpack_from(order + form, data, at)
    queue, seen, out = [("0", get("I", 4)[0])], [], {}
    for _ in range(ifd.MOST_DIRECTORIES):
        if not queue:
            return out, None
        path, at = queue.pop(0)
        if at in seen:
            return out, f"directory at {at} twice"
        if at + 2 > len(data):
            return out, "too short for tag count"
        (n,) = get("H", at)
        if at + 2 + 12 * n + 4 > len(data):
            return out, f"too short for {n} tags"
        seen.append(at)
        for k in range(n):
            tag, kind, count, place = get("HHII", at + 2 + 12 * k)
            size = count * ifd.TYPES.get(kind, ("", 1))[1]
            start = place if size > 4 else at + 2 + 12 * k + 8
            if tag in ifd.POINTERS:
                queue.append((f"{path}/{ifd.POINTERS[tag]}", place))
            if start + size > len(data):
                out[path, tag] = f"offset overflow {start}+{size} vs. {len(data)}"
                continue
            raw = data[start : start + size]
            if kind in FORMS:
                values = [v for v in struct.iter_unpack(order + FORMS[kind], raw)]
                out[path, tag] = [float(v[0]) if len(v) == 1 else v[0] / v[1] if v[1] else None for v in values] or None
            else:
                out[path, tag] = raw.split(b"\0")[0].decode(errors="replace") if kind == 2 else raw
        following = get("I", at + 2 + 12 * n)[0]
        if following and path.isdigit():
            queue.append((str(int(path) + 1), following))
    return (out, None) if not queue else (out, f"more than {ifd.MOST_DIRECTORIES} directories")


def blocks():
    random.seed(4)
    for order in "<>":
        pack = lambda form, *v, order=order: struct.pack(order + form, *v)
        main = [
            (0x0100, 4, 1, pack("I", 4_000_000_000)), (0x010F, 2, 6, "Mäk\0".encode() + b"\0"), (0x0112, 3, 1, pack("H", 6)), (0x011A, 5, 2, pack("IIII", 72, 1, 1, 0)),
            (0x8769, 4, 1, 1), (0x8825, 4, 1, 2), (0x9999, 99, 3, b"abc"), (0x0101, 3, 3, pack("HHH", 1, 2, 65535)), (0x0112, 3, 1, pack("H", 8)),
        ]
        exif = [(0x9204, 10, 1, pack("ii", -1, 3)), (0xA001, 3, 1, pack("H", 1)), (0x9201, 11, 3, pack("fff", -1.5, 1e-40, math.inf)), (0x9202, 12, 2, pack("dd", math.pi, -5e-324)), (0x9207, 9, 1, pack("i", -7)), (0x9209, 8, 2, pack("hh", -2, 3)), (0xA402, 6, 4, pack("bbbb", -1, 2, -128, 127)), (0x927C, 7, 300, bytes(300)), (0x0131, 2, 0, b""), (0x0132, 1, 2, b"\1\xff")]
        gps = [(1, 2, 2, b"N\0")]
        thumb = [(0x0103, 3, 1, pack("H", 6))]
        whole = tiff([main, exif, gps, thumb], order, {0: 3})
        yield whole
        yield from (whole[:n] for n in range(0, len(whole), 23))
        yield tiff([main[:3], thumb], order, {0: 1, 1: 0})
        yield tiff([[(0x8769, 4, 1, 1)], [(0xA005, 4, 1, 0)]], order)
        yield tiff([thumb] * 70, order, {k: k + 1 for k in range(69)})
        yield whole[:60] + bytes(random.randrange(256) for _ in range(40)) + whole[100:]
    yield from (None, b"II", b"XX*\0\x08\0\0\0\0\0\0\0\0\0", b"II*\0\xff\xff\xff\xff")


def same(a, b):
    return a == b or (isinstance(a, list) and isinstance(b, list) and len(a) == len(b) and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True)))


def test_walk_is_the_plain_one(spark):
    data = list(blocks())
    rows = ifd.directory_rows(spark.createDataFrame([(k, None if b is None else bytearray(b), 1) for k, b in enumerate(data)], "id int, block binary, path int"), "id", "block").collect()
    got = {k: {} for k in range(len(data))}
    errors = dict.fromkeys(range(len(data)))
    for r in rows:
        if r.tag is None:
            errors[r.id] = r.error
        else:
            assert (r.path, r.tag) not in got[r.id]
            got[r.id][r.path, r.tag] = r.error or (r.numbers if r.type in FORMS else r.text if r.type == 2 else bytes(r.bytes))
    for k, b in enumerate(data):
        want, error = plain(b)
        assert errors[k] == error, (k, errors[k], error)
        assert got[k].keys() == want.keys()
        assert all(same(got[k][e], want[e]) for e in want), (k, [(e, got[k][e], want[e]) for e in want if not same(got[k][e], want[e])])


def test_attributes_and_picture(spark):
    block = next(iter(blocks()))
    entries = ifd.directory_rows(spark.createDataFrame([(1, bytearray(block))], "id int, block binary"), "id", "block")
    named = {(r.path, r.name): (r.value, r.type) for r in ifd.attribute_rows(entries, "id").collect()}
    assert named["EXIF/0", "Make"] == ("Mäk", "ASCII") and named["EXIF/0", "XResolution"] == ("72, n/a", "RATIONAL")
    assert named["EXIF/0/EXIF", "ExposureBiasValue"] == ("-0.333333", "SRATIONAL") and named["EXIF/0/EXIF", "Software"] == ("n/a", "ASCII")
    assert len(named["EXIF/0/EXIF", "MakerNote"][0]) == 256 and named["EXIF/1", "Compression"] == ("6", "SHORT")
    assert [tuple(r) for r in ifd.picture_rows(entries, "id").collect()] == [(1, 8, False)]
    assert ifd.directory_rows(spark.range(0).select(F.col("id"), F.lit(None).cast("binary").alias("block")), "id", "block").collect() == []


def test_a_block_is_walked_once(spark):
    entries = ifd.directory_rows(spark.range(3).select("id", F.unhex(F.concat(F.lit("49492A00080000000000"), F.hex("id"))).alias("block")), "id", "block")
    for rows in (entries, entries.select("id", ifd.shown_value(F.col("numbers"), F.col("text"), F.col("bytes"))), ifd.attribute_rows(entries, "id"), ifd.picture_rows(entries, "id")):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_narrow_rows_are_spread(spark, sf_dir):
    assert metadata.tagged_blocks(spark, sf_dir).rdd.getNumPartitions() > 1


def test_picture_reads_the_numbers_of_few_entries(spark):
    entries = ifd.directory_rows(spark.createDataFrame([(1, bytearray(next(iter(blocks()))))], "id int, block binary"), "id", "block")
    plan = ifd.picture_rows(entries, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS said#" in plan and "AS numbers#" not in plan


def test_entries_are_read_in_compiled_code(spark):
    """Java never compiles a method of more than 8000 bytes, so each row would be interpreted."""
    blocks = spark.range(3).select("id", F.unhex(F.concat(F.lit("49492A00080000000000"), F.hex("id"))).alias("block"))
    rows = ifd.attribute_rows(ifd.directory_rows(blocks, "id", "block"), "id")
    shown = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000


def test_pointers_that_come_twice(spark):
    """Two directories of one path: of a tag in both the later position counts, equal positions stay."""
    for order in "<>":
        short = lambda v, order=order: struct.pack(order + "H", v)
        main = [(0x8769, 4, 1, 1), (0x8769, 4, 1, 2)]
        one = [(0x0112, 3, 1, short(1)), (0x0103, 3, 1, short(2)), (0x0101, 3, 1, short(3))]
        two = [(0x0103, 3, 1, short(4)), (0x0112, 3, 1, short(5)), (0x0101, 3, 1, short(6))]
        rows = ifd.directory_rows(spark.createDataFrame([(1, bytearray(tiff([main, one, two], order)))], "id int, block binary"), "id", "block").collect()
        got = sorted((r.path, r.tag, r.position, r.numbers[0]) for r in rows if r.path != "0")
        assert got == [("0/EXIF", 0x0101, 2, 3.0), ("0/EXIF", 0x0101, 2, 6.0), ("0/EXIF", 0x0103, 1, 2.0), ("0/EXIF", 0x0112, 1, 5.0)]
        assert [(r.tag, r.position) for r in rows if r.path == "0"] == [(0x8769, 1)]


def test_entries_are_not_compared_with_each_other(spark):
    """A long directory: work that grows with the square of its entries would not end soon."""
    tags = [k * 7 % 4001 + 1 for k in range(4500)]
    block = tiff([[(tag, 3, 1, struct.pack("<H", k)) for k, tag in enumerate(tags)]])
    rows = ifd.directory_rows(spark.createDataFrame([(1, bytearray(block))], "id int, block binary"), "id", "block")
    # The walk looks for a directory among those met, once for the error and once for its text.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("exists(") == 2
    assert {(r.path, r.tag): r.numbers for r in rows.collect()} == plain(block)[0]
