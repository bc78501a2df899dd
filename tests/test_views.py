import duckdb
import pytest

import __spark_entry__ as entry

#: By image of four vectors: whole, one null, all null, some short or long or with null components, and numbers below 0.
VECTORS = [(k, [(k * 64 + c) % 97 / 97 - 0.5 for c in range(64)]) for k in range(-6, 4)]
VECTORS += [(4, None), *[(k, [0.3] * 64) for k in (5, 6, 7)], *[(k, None) for k in range(8, 12)], (12, [0.1] * 10), (13, [0.2] * 70), (14, []), (15, [None, 0.4] * 32), (16, [0.5] * 3)]


@pytest.mark.parametrize("name", ["inspected_values", "probe_captions"])
def test_vectors_that_are_not_whole(spark, tmp_path, name):
    spark.createDataFrame([(k, v, 0) for k, v in VECTORS], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(want) == 6 * 64
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
