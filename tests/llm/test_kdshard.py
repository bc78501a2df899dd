import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from chromaframe.llm.kdshard import kd_shards
from chromaframe.llm.queries import op2_kd_sharding


def check(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r.size for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
    return by


def test_query(spark, sf_dir, texts):
    rows = op2_kd_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check(rows, texts, 24)


def test_equal_texts_stay_together_or_spread(make_docs):
    texts = {k: f"text number {k} " * (k % 17 + 1) for k in range(600)} | {1000 + k: "copied twice" for k in range(2)} | {2000 + k: "a hot text with many copies" for k in range(900)}
    rows = kd_shards(make_docs(texts.items()).withColumn("shard", F.lit("x")).withColumn("size", F.lit("y")), 7).collect()
    check(rows, texts, 7)
    assert len({r.shard for r in rows if 1000 <= r.doc_id < 2000}) == 1


def test_cases(make_docs):
    texts = {1: None, 2: "", None: "x", 3: "long " * 50_000}
    rows = kd_shards(make_docs(texts.items()), 3).collect()
    assert len(rows) == 4
    assert kd_shards(make_docs([]), 5).count() == 0
    assert len(kd_shards(make_docs([(1, "a")] * 5), target_bytes=20).collect()) == 5


def test_every_cut_is_a_weighted_median_on_the_widest_dimension(make_docs):
    """Follows the tree over the shards that came out, without the operator."""
    import math
    import random

    random.seed(12)
    letters = ["a", "b", "é", "\n", "字"]
    texts = {k: "".join(random.choice(letters[: random.randint(1, 5)]) for _ in range(random.randint(0, 300))) for k in range(800)}
    texts |= {1000 + k: texts[k % 40] for k in range(120)}
    shards = 7

    def place(text):
        size = len(text.encode())
        return (math.log(1 + size), (size - len(text)) / max(size, 1), math.log(1 + text.count("\n")) / math.log(2 + size))

    at = {r.doc_id: r.shard for r in kd_shards(make_docs(texts.items()), shards).collect()}
    points, sizes = {i: place(t) for i, t in texts.items()}, {i: len(t.encode()) + 8 for i, t in texts.items()}
    spans = [max(p[d] for p in points.values()) - min(p[d] for p in points.values()) for d in range(3)]
    total, slack = sum(sizes.values()), max(sizes.values())

    def follow(ids, low, k):
        if k == 1:
            assert all(at[i] == low for i in ids)
            return
        extents = [max(points[i][d] for i in ids) - min(points[i][d] for i in ids) for d in range(3)]
        widest = max(range(3), key=lambda d: (extents[d] / spans[d], -d))
        left, right = [i for i in ids if at[i] < low + k // 2], [i for i in ids if at[i] >= low + k // 2]
        target = sum(sizes[i] for i in ids) * (k // 2) / k
        assert abs(sum(sizes[i] for i in left) - target) <= slack + 0.03 * total / shards
        assert max(points[i][widest] for i in left) <= min(points[i][widest] for i in right) + extents[widest] / (1 << 14)
        follow(left, low, k // 2)
        follow(right, low + k // 2, k - k // 2)

    follow(list(texts), 0, shards)
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(at[i])
    assert all(len(s) == 1 for s in by_text.values())


def test_rows_that_repeat_an_id_and_tables_joined_by_a_shuffle(make_docs, monkeypatch):
    from chromaframe.llm import kdshard

    monkeypatch.setattr(kdshard, "BROADCAST_NODES", 0)
    monkeypatch.setattr(kdshard, "SLOT_ROWS", 20)
    rows = kd_shards(make_docs([(1, "same")] * 300 + [(k, f"text {k}") for k in range(300)]), 5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 600 and all(sorted(s) == list(range(len(s))) for s in by.values())
