import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def values(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in entry.queries()])
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in duck.description]
    assert sorted(got.columns) == sorted(columns)
    assert values(got.columns, [tuple(r) for r in got.collect()]) == values(columns, duck.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
