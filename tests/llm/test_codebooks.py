import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.llm import codebooks, queries

FIELDS = "vec_id long, embedding array<float>, label int"


def brute(rows, width):
    """code, error, label_error of each row, and the codebooks, by comparing with all entries."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    size = width // 16
    first = {}
    for i, v, _ in own:
        first[i] = min(first.get(i, v), v)
    seeds = sorted(first, key=lambda i: (i is None, i or 0))[:64]
    books = [[first[i][p * size : (p + 1) * size] for i in seeds] for p in range(16)]

    def nearest(v, p):
        part = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        given = defaultdict(list)
        for _, v, _ in own:
            for p in range(16):
                given[p, nearest(v, p)[1]].append(v[p * size : (p + 1) * size])
        for (p, k), parts in given.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, v, label in own:
        found = [nearest(v, p) for p in range(16)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][-1]
    return [(*r, by_label[r[1]]) for r in out], books


def result(spark, rows, fields=FIELDS):
    coded, books = codebooks.compress(spark.createDataFrame(rows, fields))
    return sorted((tuple(r) for r in coded.select("vec_id", "label", "code", "error", "label_error").collect()), key=repr), books


def test_query_against_all_entries(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute(rows, 64)
    got = queries.op11_vector_codes(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, t) for i, _, c, e, t in want)
    assert {r.codebooks_sha256 for r in got} == {codebooks.codebooks_digest(books)}


def test_sql_is_the_query(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_vector_codes"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op11_vector_codes(spark, sf_dir).collect())


@pytest.mark.parametrize("seed", range(4))
def test_annulus_is_exact_and_pruned(seed):
    random = np.random.default_rng(seed)
    entries = random.integers(-30, 30, (64, 4)) * (1 + 10 * (np.arange(64)[:, None] % 7 == 0))
    entries[40] = entries[3]
    points = np.concatenate([random.integers(-60, 60, (500, 4)), entries, np.zeros((3, 4), np.int64), np.full((2, 4), 10**8)])
    index, distance, seen = codebooks.Codebook(entries).nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen < 0.8 * every.size


def test_odd_rows(spark):
    random = np.random.default_rng(3)
    some = lambda n=64, by=1.0: [float(np.float32(x)) for x in random.normal(0, by, n)]
    same = some()
    rows = [(i, some(), i % 3 if i % 4 else None) for i in range(90, 0, -1)] + [(i, same, 1) for i in range(200, 260)]
    rows += [(7, some(), 1), (7, rows[5][1], 1), (None, some(), 2), (None, some(), None)]
    rows += [(-3, None, 1), (-2, [], 1), (-1, [float("nan"), *some(63)], 1), (0, [None, *some(63)], 1), (-5, [float("-inf"), *some(63)], 1), (-6, some(48), 1), (-7, some(5), 0)]
    want, books = brute(rows, 64)
    got, got_books = result(spark, rows)
    assert got == sorted(want, key=repr) and got_books == books
    many = spark.createDataFrame(rows, FIELDS).select("*", F.lit(1).alias("code"), F.lit(2).alias("v"), F.lit(3).alias("_n"))
    assert codebooks.compress(many)[1] == books


def test_few_and_far_rows(spark):
    far = [(1, [3e38] * 16, 0), (2, [-3e38] * 16, 0), (3, [0.0] * 16, 0)]
    got, books = result(spark, far)
    assert [r[:3] for r in got] == [(1, 0, "00" * 16), (2, 0, "01" * 16), (3, 0, "02" * 16)]
    assert all(r[3] == 0 for r in got) and books[0][2] == [0]
    assert result(spark, [(1, None, 0), (2, [1.0], 0)]) == ([], [])
    assert result(spark, []) == ([], [])
    assert codebooks.decode("02" * 16, books) == [0.5 / 256] * 16


def test_many_cold_labels(spark):
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(0, 1, 16).astype(np.float32)], i // 2 if i > 300 else None) for i in range(2600)]
    assert result(spark, rows)[0] == sorted(brute(rows, 16)[0], key=repr)
