import struct

import pytest
from pyspark.sql import functions as F

from chromaframe.streaming import packets as P
from chromaframe.streaming import tiles as T

ALL = [
    P.open_image("/a/b.exr", "r,g", True), P.reload_image("x"), P.close_image("x"), P.create_image("x", 2, 3, ["R", "G"]),
    P.update_image("x", [("R", 0, 2), ("G", 1, 2)], (1, 1, 2, 1), [1, 2, 3, 4]), P.vector_graphics("x", [(P.SAVE, [], None), (12, [1, 2], None), (23, [0, 0], "hi")]),
]


def test_decoding():
    opened, _, closed, made, updated, drawn = map(P.decode, ALL)
    assert (opened["image"], opened["selector"], opened["grab_focus"]) == ("/a/b.exr", "r,g", True)
    assert closed["image"] == "x" and "grab_focus" not in closed
    assert (made["width"], made["height"], made["channels"]) == (2, 3, ["R", "G"])
    assert updated["data"] == [[1, 3], [2, 4]]
    assert [c["text"] for c in drawn["commands"]] == [None, None, "hi"]
    old = bytes([P.UPDATE, 0]) + b"x\0R\0" + struct.pack("<iiii", 0, 0, 2, 1) + struct.pack("<2f", 5, 6)
    assert P.decode(old)["data"] == [[5, 6]]
    assert P.decode(bytes([P.OPEN, 0]) + b"C:/x:r\0")["selector"] == "r"
    assert "selector" not in P.decode(bytes([P.OPEN, 0]) + b"C:/x\0")


@pytest.mark.parametrize("k", range(len(ALL)))
def test_truncated_packets_are_malformed(k):
    for cut in range(1, min(len(ALL[k]), 40)):
        with pytest.raises(P.Malformed):
            P.decode(ALL[k][:-cut])


def test_framing():
    stream = b"".join(map(P.frame, ALL))
    assert P.split_frames(stream) == (ALL, b"")
    chunks = [stream[i : i + 7] for i in range(0, len(stream), 7)]
    assert list(P.framed_chunks(iter(chunks))) == ALL
    assert P.split_frames(stream[:-1])[1]
    with pytest.raises(P.Malformed):
        P.split_frames(struct.pack("<I", 3) + b"xx")


def test_dead_letters(spark):
    rows = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate([*ALL, b"\x09\x00", b"", ALL[4][:-1]])], "seq long, payload binary")
    got = P.decode_packets(rows).orderBy("seq").collect()
    assert [r.error is None for r in got] == [True] * 6 + [False] * 3
    pixels = P.explode_updates(P.decode_packets(rows)).orderBy("channel", "x").collect()
    assert [(p.channel, p.x, p.y, p.value) for p in pixels] == [("G", 1, 1, 2), ("G", 2, 1, 4), ("R", 1, 1, 1), ("R", 2, 1, 3)]


def test_balanced_commands(spark):
    ops = spark.createDataFrame([(1, k, op) for k, op in enumerate([2, 1, 1, 2, 2, 2, 1])], "image_id long, ord int, op int")
    assert [r.depth for r in P.balanced(ops, ["image_id"], "ord").orderBy("ord").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_tiles_outside_are_dropped_whole(spark):
    tiles = spark.createDataFrame([(1, "i", "R", 0, 0, 2, 1, [1.0, 2.0]), (2, "i", "R", 1, 0, 2, 1, [8.0, 9.0]), (3, "?", "R", 0, 0, 1, 1, [7.0]), (4, "i", "R", 0, 0, 1, 1, [5.0])], "seq long, image string, channel string, x int, y int, w int, h int, data array<double>")
    sizes = spark.createDataFrame([("i", 2, 1)], "image string, width int, height int")
    pixels = T.explode_tiles(T.fitting(tiles, sizes, ["image"]))
    got = T.last_write(pixels, ["image", "channel", "x", "y"], "seq", "value").orderBy("x").collect()
    assert [(r.x, r.value) for r in got] == [(0, 5.0), (1, 2.0)]


def test_stream_is_the_batch(spark):
    tiles = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("image_id"), F.lit("R").alias("channel"), (F.col("id") % 3).cast("int").alias("x"), F.lit(0).alias("y"), F.rand(1).alias("value"))
    keys = ["image_id", "channel", "x", "y"]
    assert sorted(T.replay_tiles(spark, tiles).collect()) == sorted(T.last_write(tiles, keys, "seq", "value").collect())


def test_sticky_selectors(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a", "", ":r", "b", " c ", ":", "d"])], "s long, n long, line string")
    assert [(r.path, r.selector) for r in T.sticky_selectors(lines, ["s"]).orderBy("n").collect()] == [("a", ""), ("b", "r"), ("c", "r"), ("d", "")]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    keys = ["k"]
    batch = lambda rows: spark.createDataFrame(rows, "k long, seq long, value double")
    table = lambda: T.TileTable(spark, str(tmp_path / "t"), keys, "seq", "value")
    assert table().read() is None
    table().merge(batch([(1, 1, 1.0), (2, 2, 2.0), (1, 3, 3.0)]), 0)
    table().merge(batch([(2, 1, 9.0), (3, 4, 4.0)]), 1)  # a new object, as after a restart
    for _ in range(2):  # a batch that is run again
        table().merge(batch([(3, 5, 5.0), (4, 6, 6.0)]), 2)
    want = {1: 3.0, 2: 2.0, 3: 5.0, 4: 6.0}
    assert {r.k: r.value for r in table().read().collect()} == want
    table().compact(1)
    assert {r.k: r.value for r in table().read().collect()} == want
    table().merge(batch([(1, 7, 7.0)]), 3)
    table().compact(3)
    (tmp_path / "t" / "base" / "9").mkdir()  # not committed
    assert {r.k: r.value for r in table().read().collect()} == want | {1: 7.0}
    assert len(table()._parts()) == 1


def test_a_stopped_stream_loses_nothing(spark, tmp_path):
    schema = "k long, seq long, value double"
    table = lambda: T.TileTable(spark, str(tmp_path / "t"), ["k"], "seq", "value")
    for n in range(3):
        spark.createDataFrame([(k, 10 * n + k, float(10 * n + k)) for k in range(n, n + 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table().merge).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.value for r in table().read().collect()} == {0: 0.0, 1: 11.0, 2: 22.0, 3: 23.0, 4: 24.0}
