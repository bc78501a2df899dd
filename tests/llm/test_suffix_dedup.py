import hashlib
import random
from collections import Counter

from chromaframe.llm import suffix_dedup
from chromaframe.llm.queries import op8_suffix_dedup


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept sha256) of each text of a list."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def values(df):
    return sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def expected(rows, length):
    return sorted((i is None, i, *v) for (i, _), v in zip(rows, brute([t for _, t in rows], length), strict=True))


def test_query_against_all_windows(spark, sf_dir, texts):
    rows = sorted(texts.items())
    assert values(op8_suffix_dedup(spark, sf_dir)) == expected(rows, 400)


def rows_with_repeats(seed):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12) for _ in range(5)]
    out = []
    for i in range(60):
        t = text(random.randint(0, 40))
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            at = random.randint(0, len(t))
            t = t[:at] + p[random.randint(0, 10) : len(p) - random.randint(0, 10)] + t[at:]
        out.append((i, t))
    near = text(60)
    out += [(100 + k, near[: 20 * k] + "#" + near[20 * k :]) for k in range(6)]
    out += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 100), (210, "abc " * 60 + near[:70] + "abc " * 60), (211, "x" + "abc " * 40), (204, near), (205, near), (205, near), (206, "z" * 40), (207, "z" * 39), (None, passages[0] * 2), (208, "short"), (209, "one id" * 20), (209, "one id, another text" * 20)]
    return out


def test_small_lengths(make_docs):
    for seed, (length, q) in enumerate([(40, 8), (40, 5), (64, 16)]):
        rows = rows_with_repeats(seed)
        assert values(suffix_dedup.remove_repeats(make_docs(rows), length=length, q=q)) == expected(rows, length)


def test_hot_buckets(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_BUCKET", 2)
    rows = rows_with_repeats(9)
    assert values(suffix_dedup.remove_repeats(make_docs(rows), length=40, q=8)) == expected(rows, 40)


def test_empty_table(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_bucket_counts_by_partial_sums(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COUNT_BUCKET", 1)
    rows = rows_with_repeats(9)
    assert values(suffix_dedup.remove_repeats(make_docs(rows), length=40, q=8)) == expected(rows, 40)


def shared_runs_of(rows, words):
    """Whether each row has so many words in a row that another row has, too."""
    runs = [{tuple(w[k : k + words]) for k in range(len(w) - words + 1)} for w in ((t or "").encode().split() for _, t in rows)]
    times = Counter(r for own in runs for r in own)
    return [any(times[r] > 1 for r in own) for own in runs]


def test_shared_passages_show_as_marks(make_docs):
    random.seed(3)
    text = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    rows = [(k, text(random.randint(0, 200))) for k in range(30)]
    for n in (29, 30, 45, 50, 51, 80):
        p = text(n)
        rows += [(100 * n + k, f"{text(random.randint(0, 30))} {p}\n{text(random.randint(0, 30))}") for k in range(3)]
    copy, short = text(70), text(45)
    rows += [(1, None), (2, ""), (3, copy), (4, copy), (4, copy), (None, copy + " end"), (5, short), (6, short), (7, text(60) + " " + rows[-1][1])]
    got = suffix_dedup.remove_repeats(make_docs(rows)).select("doc_id", "n_bytes", "shared_runs").collect()
    shared = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.shared_runs > 0) for r in got)
    sizes = [len((t or "").encode()) for _, t in rows]
    always, never = [{(i, n) for (i, _), n, f in zip(rows, sizes, shared_runs_of(rows, k), strict=True) if f} for k in (50, 30)]
    found = {(i, n) for _, i, n, f in shared if f}
    assert len(always) > 10 and always <= found <= never


def test_clashing_names(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "ab " * 40), (2, "ab " * 40), (3, "short")])
    for c in ("row", "tag", "kept", "spans", "bucket", "whole", "n_bytes"):
        docs = docs.withColumn(c, F.lit("x"))
    got = suffix_dedup.remove_repeats(docs, length=40, q=8)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_runs", "kept"]
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got.collect()} == {1: (120, b""), 2: (120, b""), 3: (0, b"short")}
