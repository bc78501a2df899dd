import re
from collections import defaultdict

from pyspark.sql import functions as F

from chromaframe.llm.content_sort import drop_exact_copies, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {i: (min(g)[2], len(g)) for g in groups.values() for _, _, i in g}


def test_cases_and_borders(make_docs):
    rows = [(i, "same text") for i in range(100, 400)] + [(5, "same  text"), (6, "same\u00a0text"), (7, None), (8, ""), (9, " \n"), (10, "é" * 40_000), (11, "é " * 40_000), (None, "unique")]
    for n in (1, 3, 16):
        got = exact_groups(make_docs(rows), partitions=n).collect()
        assert {r.id: (r.keep_id, r.group_size) for r in got} == brute(rows)
        assert len(got) == len(rows)
        assert all(r.kept == (r.id == r.keep_id) for r in got)


def test_repeated_rows_and_empty(make_docs):
    got = exact_groups(make_docs([(1, "a"), (1, "a"), (1, "b")])).collect()
    assert sorted((r.id, r.group_size) for r in got) == [(1, 1), (1, 2), (1, 2)]
    assert sum(r.kept for r in got) == 2
    assert exact_groups(make_docs([])).count() == 0


def test_rows_that_stay_keep_their_columns(make_docs):
    docs = make_docs([(1, "a b"), (2, "ab"), (3, "c"), (3, "c")]).withColumn("id", F.lit("x")).withColumn("kept", F.lit("y"))
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b"), (3, "c")]


def test_repeated_ids_in_any_order(make_docs):
    for rows in ([(1, "a   b"), (1, "ab")], [(1, "ab"), (1, "a   b")]):
        assert [r.text for r in drop_exact_copies(make_docs(rows)).collect()] == ["a   b"]
    ties = [(1, "a b c"), (1, "ab  c"), (1, " abc "), (None, "x y"), (None, "x y"), (None, " xy")]
    assert sorted(map(str, drop_exact_copies(make_docs(ties)).collect())) == sorted(map(str, drop_exact_copies(make_docs(ties[::-1])).collect()))
    assert drop_exact_copies(make_docs(ties)).count() == 2


def test_clashing_names(make_docs):
    docs = make_docs([(1, "a b"), (2, "ab"), (3, "c")])
    for c in ("_kept", "_KEPT1", "kept_tag", "_own_tag", "tag", "digest", "_chars", "norm"):
        docs = docs.withColumn(c, F.lit("x"))
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert {r.keep_id for r in exact_groups(docs).collect()} == {1, 3}
