import random

from chromaframe.operators.catalog import contiguous_prefix
from chromaframe.streaming import publish
from chromaframe.streaming.publish import published

FIELDS = "kind string, load_id long, name string, size double"


def test_stream_is_the_prefix_after_every_batch(spark, tmp_path):
    """Any order of arrival, batches that bring nothing new, a restart after each one, gaps that never close, repeats, nulls."""
    random.seed(1)
    rows = [(k, i, f"{k}{i}" if i % 5 else None, i / 2 if i % 3 else None) for k, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n)]
    rows += [(None, i, "n", 1.0) for i in range(3)]
    rows = [r for r in rows if r[:2] != ("a", 33)]
    random.shuffle(rows)
    rows += [("a", 0, "again", 9.0), ("b", -1, "low", 1.0), ("b", None, "none", 1.0), ("d", 2, "early", 1.0)]
    out, seen = None, []

    def run():
        stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
        published(stream, ["kind"], "load_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect()))

    for k in range(0, len(rows), 14):
        seen += rows[k : k + 14]
        spark.createDataFrame(rows[k : k + 14], FIELDS).write.mode("append").parquet(str(tmp_path / "in"))
        out = run()
        there = {}
        for r in seen:
            there.setdefault(r[:2], r)
        arrived = spark.createDataFrame(list(there.values()), FIELDS).where("load_id >= 0")
        least = arrived.groupBy("kind").agg({"load_id": "min"}).where("`min(load_id)` = 0").select("kind")
        want = contiguous_prefix(arrived, ["kind"], "load_id").alias("p").join(least.alias("l"), least["kind"].eqNullSafe(arrived["kind"]), "left_semi")
        assert out == sorted(map(repr, want.select("p.*").collect()))
    assert sum("'a'" in r for r in out) == 33 and not any("'d'" in r for r in out)


def test_waiting_rows_share_entries_of_the_state(spark, tmp_path):
    """Rows that come backward, over several batches: an entry holds many, and none is left or lost."""
    n = 5 * publish.BLOCK + 3
    for k in range(4):
        spark.range(n).where(f"pmod(id, 4) = {3 - k}").selectExpr("'a' AS kind", "id AS load_id", "concat('n', id) AS name", "id / 2 AS size").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
        published(stream, ["kind"], "load_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "progress"))
        assert state.count() == (5, 6, 6, 0)[k]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", i, f"n{i}", i / 2) for i in range(n)]
