import pytest

from chromaframe.streaming import packet_log as L
from chromaframe.streaming import packets as P


def numbered(n, start=0):
    return [f"packet {k}".encode() for k in range(start, start + n)]


def run(spark, folder, out, progress):
    L.stream_packets(spark, str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(progress)).trigger(availableNow=True).start().awaitTermination()
    return [(r.seq, bytes(r.payload)) for r in spark.read.parquet(str(out)).orderBy("seq").collect()]


def want(n):
    return list(enumerate(numbered(n)))


def test_log_and_connection(tmp_path):
    log = L.PacketLog(str(tmp_path / "log"))
    assert (log.begin(), log.end(), log.segments()) == (0, 0, [])
    stream = b"".join(map(P.frame, numbered(50)))
    end = L.receive((stream[k : k + 7] for k in range(0, len(stream) - 7, 7)), log, 100)  # the last packet is cut
    assert end == log.end() == 49 and len(log.segments()) > 5
    assert log.append(numbered(5, end)) == end + 5 and log.append([]) == end + 5
    assert [row for s in log.segments() for row in log.read(s, 0, 10**9)] == want(end + 5)
    assert [row for s in log.segments() for row in log.read(s, 3, 8)] == want(8)[3:]


def test_batch_sink_and_source(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(numbered(500))], "k long, payload binary").repartition(7)
    L.write_packets(rows, folder, ["k"])
    got = L.read_packets(spark, folder).orderBy("seq").collect()
    assert [(r.seq, bytes(r.payload)) for r in got] == want(500)
    with pytest.raises(Exception, match="only appended"):
        rows.select("payload").write.format("packetlog").mode("overwrite").save(folder)
    failing = rows.selectExpr("if(k = 321, raise_error('no'), payload) payload").repartition(5)
    with pytest.raises(Exception, match="no"):
        L.write_packets(failing, folder)
    assert L.read_packets(spark, folder).count() == 500


def test_stream_stops_and_starts_again(spark, tmp_path):
    log = L.PacketLog(str(tmp_path / "log"))
    log.append(numbered(30))
    places = tmp_path / "log", tmp_path / "out", tmp_path / "progress"
    assert run(spark, *places) == want(30)
    assert run(spark, *places) == want(30)
    log.append(numbered(40, 30))
    log.append(numbered(1, 70))
    assert run(spark, *places) == want(71)
    log.trim(70)  # packets that were read may go
    log.append(numbered(9, 71))
    assert run(spark, *places) == want(80)


def test_a_failed_batch_is_read_again_as_it_was(spark, tmp_path):
    log = L.PacketLog(str(tmp_path / "log"))
    log.append(numbered(20))
    seen, fails = [], [True]

    def take(batch, number):
        rows = sorted((r.seq, bytes(r.payload)) for r in batch.collect())
        if fails.pop() if fails else False:
            log.append(numbered(20, 20))  # more comes in before the stream starts again
            seen.append((number, rows))
            raise RuntimeError("lost")
        seen.append((number, rows))

    def start():
        L.stream_packets(spark, str(tmp_path / "log")).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        start()
    start()
    start()
    assert seen[0] == seen[1] == (0, want(20))
    assert [r for n, rows in seen[1:] for r in rows] == want(40)


def test_missing_and_broken_segments(spark, tmp_path):
    log = L.PacketLog(str(tmp_path / "log"))
    for k in range(3):
        log.append(numbered(4, 4 * k))
    ranges = L.PacketStreamReader({"path": str(tmp_path / "log"), "taskBytes": "70"})
    assert [len(r.segments) for r in ranges.partitions({"next": 0}, {"next": 12})] == [1, 1, 1]
    assert [row for r in ranges.partitions({"next": 2}, {"next": 9}) for b in ranges.read(r) for row in b.column(0).to_pylist()] == list(range(2, 9))
    assert ranges.partitions({"next": 12}, {"next": 12}) == []
    middle = log.segments()[1]
    data = (tmp_path / "log" / middle.path.rsplit("/", 1)[1]).read_bytes()
    (tmp_path / "log" / middle.path.rsplit("/", 1)[1]).write_bytes(data[:-1])
    with pytest.raises(P.Malformed, match="ends after 3 of 4"):
        list(log.read(middle, 0, 100))
    log.system.delete_file(middle.path)
    with pytest.raises(ValueError, match="no packet 4"):
        ranges.partitions({"next": 0}, {"next": 12})
