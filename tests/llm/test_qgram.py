import random

from pyspark.sql import functions as F

from chromaframe.llm.qgram import Segments, benchmark_hits, decontaminate
from chromaframe.llm.queries import op6_decontamination

random.seed(11)


def prose(n):
    return " ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(n))


def semi_global(pattern, text):
    """Fewest edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, k):
    letters = list(text)
    for _ in range(k):
        p = random.randrange(len(letters))
        letters[p : p + random.randint(0, 1)] = random.choice(["", "x", "yz"[:1]])
    return "".join(letters)


def test_against_full_alignment():
    items = [(k, prose(18)[:140]) for k in range(12)]
    index = Segments(items, 0.1)
    texts = []
    for k in range(60):
        item = random.choice(items)[1]
        texts.append(prose(30) + " " + edited(item, random.randint(0, 22)) + " " + prose(random.randint(0, 20)))
    found = {(t, i) for t, i, *_ in index.search(texts)}
    want = {(t, i) for t, text in enumerate(texts) for i, item in items if semi_global(item, text) <= int(0.1 * len(item))}
    assert want and found == want


def test_borders_between_texts_and_cases():
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    index = Segments([(1, item), (2, ""), (3, "short"), (4, "e" * 60)], 0.1)
    half = len(item) // 2
    assert list(index.search([item[:half], item[half:]])) == []
    hits = list(index.search(["", item.upper().replace(" ", "\n"), "x", item + item]))
    assert {t for t, *_ in hits} == {1, 3}
    assert (1, 1, 0, 0, len(item), 0) in hits
    assert {i for _, i, *_ in index.search(["e" * 500])} == {4}


def test_query_finds_all_verbatim_items(spark, sf_dir, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op6_decontamination(spark, sf_dir).collect()}
    assert got >= {(i, j) for i, t in texts.items() for j, b in items.items() if b in t}
    assert all(any(w in texts[i].lower() for w in [items[j].lower()[k : k + 20] for k in range(len(items[j]) - 20)]) for i, j in got)


def test_blocks_nulls_and_columns(spark, make_docs):
    items = [(k, prose(15)) for k in range(9)]
    bench = spark.createDataFrame([*items, (None, "x" * 30), (50, None)], "item_id long, text string")
    docs = make_docs([(k, f"{prose(5)} {t} {prose(5)}") for k, t in items] + [(100, None), (101, ""), (102, prose(30_000)), (None, items[0][1])]).withColumn("item_id", F.lit(1)).withColumn("edits", F.lit(2))
    hits = benchmark_hits(docs, bench, block_chars=200)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == {(k, k) for k, _ in items} | {(None, 0)}
    left = decontaminate(docs, bench, block_chars=200)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [100, 101, 102]
    assert benchmark_hits(make_docs([]), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_passages_cut_at_a_text_border():
    item = "the quick brown fox jumps over the lazy dog and runs far away from here"
    index = Segments([(1, item)], 0.1)
    for cut in range(1, 4):
        for texts in (["clean words before it", item[cut:] + " and more", "clean"], [item[cut:], "clean"], ["clean", "so " + item[:-cut], "clean"]):
            hits = list(index.search(texts))
            assert {t for t, *_ in hits} == {next(k for k, t in enumerate(texts) if "brown" in t)}
            assert all(0 <= b < e <= len(texts[t]) and c == semi_global(item, texts[t]) == cut for t, _, _, b, e, c in hits)


def test_a_cut_passage_drops_its_own_document(spark, make_docs):
    item = prose(15)
    docs = make_docs([(1, "clean words before it"), (2, item[2:] + " " + prose(5)), (3, "clean")]).coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in benchmark_hits(docs, bench).collect()} == {2}
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [1, 3]


def test_slices_of_counted_pairs_change_nothing(monkeypatch):
    items = [(k, prose(40)) for k in range(6)] + [(6, "e" * 200), (7, "ab" * 90)]
    texts = [prose(20) + " " + edited(random.choice(items)[1], random.randint(0, 12)) + prose(20) for _ in range(30)] + ["e" * 700, "ab" * 400, "abe" * 200]
    whole = sorted(Segments(items, 0.1).search(texts))
    for entries in (1, 64, 5_000):
        monkeypatch.setattr("chromaframe.llm.qgram.ENTRIES", entries)
        assert sorted(Segments(items, 0.1).search(texts)) == whole
    assert {i for _, i, *_ in whole} >= {6, 7}


def test_short_items_match_as_they_are(spark, make_docs):
    bench = spark.createDataFrame([(1, "Ab c"), (2, "x"), (3, " 42 is it "), (4, ""), (5, "e" * 23)], "item_id long, text string")
    texts = ["say AB\tc now", "ab cd", "x", "axb x-y", "it: 42 is it", "142 is it", "e" * 23 + ".", "e" * 24, "", "ab  c"]
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in benchmark_hits(make_docs(list(enumerate(texts))), bench).collect()}
    assert got == {(0, 1, 4, 8, 0), (2, 2, 0, 1, 0), (3, 2, 4, 5, 0), (4, 3, 4, 12, 0), (6, 5, 0, 23, 0)}


def test_columns_named_like_results(spark, make_docs):
    item = prose(15)
    docs = make_docs([(1, item), (2, "clean"), (None, item), (None, "clean")]).withColumn("doc_id_", F.lit("x")).withColumn("item_start", F.lit("y")).withColumn("start", F.lit(1))
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    assert sorted(map(str, (r.doc_id for r in benchmark_hits(docs, bench).collect()))) == ["1", "None"]
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["clean", "clean"]
