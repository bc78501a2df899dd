import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chromaframe.streaming import recompute as R

T0 = datetime(2024, 5, 1)
FIELDS = "image string, ts timestamp, shown boolean"


def at(seconds):
    return T0 + timedelta(microseconds=round(seconds * 1e6))


def plain(rows, least=0.2):
    """The rule, image by image and update by update."""
    out = {}
    for image in {r[0] for r in rows}:
        planned = None
        for _, t, shown in sorted((r for r in rows if r[0] == image and r[1] is not None), key=lambda r: r[1]):
            if planned is None or t > planned:
                planned = t if planned is None or shown is False else max(t, planned + timedelta(seconds=least))
            n, last = out.get((image, planned), (0, t))
            out[image, planned] = n + 1, max(last, t)
    return sorted(((i or "", p, n, last) for (i, p), (n, last) in out.items()))


def result(df):
    return sorted((r[0] or "", *r[1:]) for r in df.select("image", "recomputed_at", "updates", "last_update").collect())


def test_a_burst_is_thinned_and_its_last_update_counts(spark):
    rows = [("a", at(0.1 * k), True) for k in range(8)] + [("b", at(0.1 * k), False) for k in range(3)]
    got = result(R.recomputed(spark.createDataFrame(rows, FIELDS), ["image"], "ts", "shown"))
    a = [(r[1], r[2]) for r in got if r[0] == "a"]
    assert a == [(at(0), 1), (at(0.2), 2), (at(0.4), 2), (at(0.6), 2), (at(0.8), 1)]
    assert [(r[1], r[2]) for r in got if r[0] == "b"] == [(at(0.1 * k), 1) for k in range(3)]


@pytest.mark.parametrize("seed", range(2))
def test_batch_is_the_rule(spark, seed):
    """A hot image over many partitions, pauses, ties, nulls."""
    random.seed(seed)
    rows, t = [], 0.0
    for _ in range(3000):
        t += random.choice([0, 0.01, 0.05, 0.1, 0.19, 0.2, 0.2 if seed else 0.9])
        rows.append(("hot", at(t), True))
    rows += [(random.choice("abc"), at(random.random() * 40), True) for _ in range(900)]
    rows += [("hidden", at(random.random() * 4), False) for _ in range(200)] + [(None, at(1), None), (None, at(1.1), None), ("a", None, True)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, FIELDS).withColumn("updates", F.lit(1)).withColumn("_at", F.lit(2))
    assert result(R.recomputed(df, ["image"], "ts", "shown")) == plain(rows)
    assert R.recomputed(df.limit(0), ["image"], "ts").collect() == []


def test_stream_is_the_batch(spark, tmp_path):
    """Updates in order of time over several batches and a restart; timers give what is still planned when the time has come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    random.seed(6)
    rows = sorted(((random.choice("abc"), at(random.random() * 6), True) for _ in range(120)), key=lambda r: r[1]) + [("h", at(6.1 + 0.05 * k), False) for k in range(3)]
    end = [("clock", at(60), True)]
    batches = [rows[:40], rows[40:90], rows[90:], end]

    def run():
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = R.recomputed_stream(stream, ["image"], "ts", "shown").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p"))
        out.trigger(availableNow=True).start().awaitTermination()

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 3):
            run()
    assert result(spark.read.parquet(str(tmp_path / "out")).where("image <> 'clock'")) == plain(rows)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
