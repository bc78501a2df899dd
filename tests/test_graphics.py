import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from chromaframe.streaming import graphics as G
from chromaframe.streaming import packets as P

FIELDS = "seq long, host int, image string, op int, append boolean, grab_focus boolean, commands array<struct<op:int,args:array<float>,text:string>>"


def packet_rows(n, seed):
    random.seed(seed)
    rows = []
    for k in range(n):
        op = random.choice([P.VECTOR] * 6 + [P.CREATE, P.OPEN, P.OPEN_V2, P.CLOSE, P.RELOAD, P.UPDATE_V3, 99])
        commands = [(random.choice([3, 12, 23]), [float(k), float(c)], "t" if c % 2 else None) for c in range(random.randint(0, 3))] if op == P.VECTOR else None
        rows.append((k, k % 2, random.choice(["a", "a", "a", "b", "c", None]), op, random.choice([True, True, True, False, None]), random.choice([True, False, None]), commands))
    return rows


def plain(rows, upto=None):
    """Packet by packet: images with their commands, and the selected one."""
    there, selected, counts = {}, None, []
    for seq, host, image, op, append, focus, commands in sorted(rows, key=lambda r: r[0])[:upto]:
        if image is None or op not in (*G._BEGINS, *G._GOES_ON, P.CLOSE):
            continue
        if op in G._BEGINS:
            there[image] = []
        elif op == P.CLOSE:
            there.pop(image, None)
        elif image in there:
            if op == P.RELOAD or (op == P.VECTOR and not append):
                there[image] = []
            if op == P.VECTOR:
                there[image] = there[image] + [(seq, k, c) for k, c in enumerate(commands)]
        counts.append((image, seq, image in there, len(there.get(image, []))))
        if focus and image in there:
            selected = image
    return there, selected, counts


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(3)


def test_batch_is_the_fold(spark):
    for seed in range(3):
        rows = packet_rows(150, seed)
        df = frame(spark, rows).withColumn("key__x", F.lit(1)).withColumn("since", F.lit(2)).withColumn("begins", F.lit(3))
        there, selected, counts = plain(rows)
        got = [(r.image, r.seq, r.position, tuple(r.command)) for r in G.drawn(df).orderBy("image", "seq", "position").collect()]
        assert got == sorted((i, s, k, c) for i, own in there.items() for s, k, c in own)
        assert sorted((r.image, r.seq, r.exists, r.commands) for r in G.traced(df).collect()) == sorted(counts)
        assert [r.selected for r in G.focused(df).collect()] == [selected]
        by_host = {r.host: r.selected for r in G.focused(df, ["host"]).collect()}
        assert by_host == {h: plain([r for r in rows if r[1] == h])[1] for h in (0, 1)}
    assert G.drawn(df.limit(0)).collect() == [] and G.traced(df.limit(0)).collect() == []


def test_stream_is_the_fold_after_every_batch(spark, tmp_path):
    rows = packet_rows(90, 7)
    for k in range(0, 90, 30):
        frame(spark, rows[k : k + 30]).write.mode("append").parquet(str(tmp_path / "in"))
        got = {}

        def take(batch, number, got=got):
            got.update({r.image: r.commands and [tuple(c) for c in r.commands] for r in batch.collect()})

        stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
        G.drawn_stream(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
        there, _, _ = plain(rows, k + 30)
        assert set(got) == {"a", "b", "c"}
        assert {i: c or [] for i, c in got.items() if c is not None} == {i: [c for _, _, c in own] for i, own in there.items()}


def test_from_bytes(spark):
    drawn = [(12, [1.0, 2.0], None), (23, [0.0, 0.0], "hi")]
    sent = [P.create_image("x", 2, 2, ["R"]), P.vector_graphics("x", drawn[:1]), P.vector_graphics("y", drawn), P.vector_graphics("x", drawn, append=False, grab_focus=True), P.vector_graphics("x", drawn[:1]), b"\x08"]
    df = P.decode_packets(spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(sent)], "seq long, payload binary"))
    assert [(r.seq, r.position, r.command.op) for r in G.drawn(df).orderBy("seq", "position").collect()] == [(3, 0, 12), (3, 1, 23), (4, 0, 12)]
    assert [r.selected for r in G.focused(df).collect()] == ["x"]


def test_stream_keeps_odd_commands(spark, tmp_path):
    odd = [(None, [0.1, 1e-45, 3.4028235e38, float("inf"), -0.0], 'a "b", [c]\n\t\\ \x01 é 😀'), (1, [], ""), (None, None, None), (2, [None, 16777216.0], "]")]
    for n, rows in enumerate(([(0, 0, "a", P.CREATE, None, None, None), (1, 0, "a", P.VECTOR, True, None, odd[:2]), (2, 0, "a", P.VECTOR, True, None, [])], [(3, 0, "a", P.VECTOR, True, None, odd[2:]), (4, 0, "b", P.CLOSE, None, None, None)])):
        frame(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        stream = G.drawn_stream(spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda batch, _, got=got: got.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
        assert {r.image for r in got} == ({"a", "b"} if n else {"a"})
    want = [tuple(r) for r in spark.createDataFrame([(odd,)], "commands array<struct<op:int,args:array<float>,text:string>>").first()[0]]
    assert {r.image: r.commands and [tuple(c) for c in r.commands] for r in got} == {"a": want, "b": None}
    assert repr(got[[r.image for r in got].index("a")].commands[0].args) == repr(want[0][1])


def test_stream_asks_the_state_seldom():
    asked = []

    class Kept:
        held = []

        def __getattr__(self, name):
            asked.append(name)
            return {"get": lambda: iter(self.held), "put": self.put_, "appendList": lambda v: self.held.extend(v)}[name]

        def put_(self, rows):
            self.held = rows

    class Handle:
        def getListState(self, *_):
            return Kept()

        getValueState = getListState

    draw = G._processor()
    draw.init(Handle())
    row = lambda seq, mark, text=None: Row(seq=seq, mark=mark, text=text)
    assert [tuple(r) for r in draw.handleInputRows(("a",), iter([row(2, 0, '[{"op":1}]'), row(1, G._BEGUN)]), None)] == [("a", 2, '[{"op":1}]')]
    assert [tuple(r) for r in draw.handleInputRows(("a",), iter([row(3, 0, '[{"op":2},{"op":3}]')]), None)] == [("a", 3, '[{"op":1},{"op":2},{"op":3}]')]
    assert asked == ["get", "put", "get", "appendList"]
