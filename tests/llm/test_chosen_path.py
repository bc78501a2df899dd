import random

import pytest
from pyspark.sql import functions as F

from chromaframe.llm import chosen_path
from chromaframe.llm.chosen_path import drop_near_copies, near_duplicates
from chromaframe.llm.components import connected_components
from chromaframe.llm.queries import op9_chosen_path


def brute(rows, words=4, threshold=80):
    """doc_id to (shingles, component), with every pair compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query_against_all_pairs(spark, sf_dir, texts):
    assert got(op9_chosen_path(spark, sf_dir)) == brute(texts.items())


def vary(text, edits):
    words = text.split()
    for _ in range(edits):
        words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
    return " ".join(words)


def corpus():
    random.seed(5)
    text = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    base, other, common = text(120), text(150), text(8)
    rows = [(k, vary(base, random.randint(0, 4))) for k in range(80)]
    rows += [(100 + k, vary(other, random.randint(1, 9))) for k in range(40)]
    rows += [(200 + k, f"{common} {text(random.randint(3, 60))}") for k in range(60)]
    return rows + [(300, ""), (301, None), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "Ein Wort"), (307, base.upper()), (308, base), (309, text(20_000))]


@pytest.mark.parametrize("small", [2, 8])
def test_dense_groups_and_common_lines(make_docs, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "HUB_PAIRS", 16)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    monkeypatch.setattr(chosen_path, "MET_BLOCKS", small)
    monkeypatch.setattr(chosen_path, "BROADCAST_GROUPS", 0 if small == 2 else 100)
    rows = corpus()
    assert got(near_duplicates(make_docs(rows), words=4)) == brute(rows)


def test_nulls_repeats_and_clashing_names(make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    docs = make_docs(rows).withColumn("id", F.lit("z")).withColumn("set", F.lit("y")).withColumn("component_id", F.lit(3))
    out = near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in out) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, None, None)]
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert left.where("doc_id = 2").count() == 0
    assert near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (299, 300)]
    labels = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}


def test_an_id_with_several_texts_loses_no_link(make_docs):
    random.seed(8)
    a, b, c = (" ".join(f"w{random.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, near(c)), (5, near(a)), (0, "zero"), (6, b + " x")]
    for order in (rows, rows[::-1]):
        docs = make_docs(order)
        got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).collect())
        assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 1), (6, 1)]
        assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [0, 1, 1, 4, 4]


def test_names_of_the_pipeline_stage(make_docs):
    docs = make_docs([(1, "a b c d e f"), (2, "a b c d e F"), (None, "a b c d e F")])
    for c in ("_gone", "_gone_tag", "_OWN_TAG", "tag", "rep", "component"):
        docs = docs.withColumn(c, F.lit("x"))
    left = drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["1", "None"]
