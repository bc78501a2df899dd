import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from chromaframe.llm import toxicity
from chromaframe.llm.queries import op10_toxicity


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def labelled():
    random.seed(4)
    word = lambda: "".join(random.choice(["re", "ta", "no", "li", "so", "en", "ur", "id", "st", "um"]) for _ in range(random.randint(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(random.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["stupid", "moron", "loser"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, make_docs, labelled):
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    return toxicity.fit(make_docs([(i, t) for i, t, _ in labelled]), labels)


def test_held_out_accuracy(make_docs, model, labelled):
    rows = toxicity.score(make_docs([(i, t) for i, t, _ in labelled]), model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    truth = {i: y for i, _, y in labelled}
    assert auc([r.score for r in rows], [truth[r.doc_id] for r in rows]) > 0.98
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in rows) > 0.95 * len(rows)


@pytest.mark.parametrize("shown", ["stupid", "5tup1d", "stuuuupid", "s.t.u.p.i.d", "STUPID!!", "$tup!d", "(stupid)"])
def test_disguises_are_restored(model, shown):
    assert toxicity.restore(shown, model.letters) == "stupid"


def test_plain_words_stay(model):
    assert [toxicity.restore(w, model.letters) for w in ("letter", "Été.", "2024", "")] == ["letter", "été", "2024", ""]


def test_spaced_letters_count(model):
    clean, bad = model.scores(pa.array(["you are rely no tali", "you are s t u p i d and a m o r o n"]))
    assert clean < 0.5 < bad


def brute(word, model):
    """The cheapest of all readings."""
    best = (float("inf"), "")
    stack = [("^^", 0.0, "", 0)]
    steps = toxicity.lattice(word)
    while stack:
        context, cost, said, k = stack.pop()
        if k == len(steps):
            best = min(best, (cost - model(context, "$"), said))
            continue
        for letter, own in steps[k]:
            stack.append((context[1] + letter if letter else context, cost + own - (model(context, letter) if letter else 0.0), said + letter, k + 1))
    return best[1]


def test_decoding_is_the_best_path(model):
    random.seed(6)
    words = ["5tup1d", "m0r0n", "l00oser", "st!umm", "1d10t", "(!il0000(8!6i.80"]
    words += ["".join(random.choice("aeilost01!6(.|8$-") for _ in range(random.randint(3, 9))) for _ in range(300)]
    for word in words:
        steps = toxicity.lattice(word)
        want = brute(word, model.letters)
        got = toxicity.decode(word, model.letters)
        assert got == want or (got == word and not any(c.isalpha() for c in word)), (word, len(steps))


def test_long_words_take_few_states(model):
    random.seed(2)
    word = "".join(random.choice("0123456789abcdef") for _ in range(100_000))
    assert 30_000 < len(toxicity.decode(word, model.letters)) <= len(word)
    spaced = " ".join(random.choice("stupid") for _ in range(3_000)) + " s t u p i d " + " ".join("xyz" * 1_000)
    assert "stupid" in {w[:6] for w in toxicity._spaced_words(spaced, model.letters)}
    assert len(toxicity.lattice("\u0301" * 50_000)) == 50_000


def test_scores_against_a_plain_version(model, labelled):
    """One text at a time, one feature at a time."""
    import math

    for _, text, _ in [*labelled[:60], (0, "you s t u p i d m0r0n moron", 1), (0, "", 0)]:
        found = Counter()
        for token in text.split():
            found.update(toxicity.token_features(token, model.letters))
        for word in toxicity._spaced_words(text, model.letters):
            found.update(toxicity.features(word))
        said, m, words = model.bias, len(model.number), len(text.split())
        for f, n in found.items():
            if f in model.number:
                k = model.number[f]
                said += model.weights[k] * math.log1p(n) + model.weights[m + k] * 5 * math.sqrt(n / max(words, 1))
        assert abs(model.scores(pa.array([text]))[0] - 1 / (1 + math.exp(-max(-30, min(30, said))))) < 1e-9


def test_held_out_labels_and_other_columns_teach_nothing(spark, make_docs, labelled):
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i, _, _ in labelled], "doc_id long").where(toxicity.held_out(F.col("doc_id"))).collect()}
    docs = make_docs([(i, t) for i, t, _ in labelled])
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if flip and i in held else y) for i, _, y in labelled], "doc_id long, toxic int")
        rows = docs.withColumn("source", F.lit("toxic" if flip else "clean")).withColumn("lang", F.lit(str(flip)))
        scores.append({r.doc_id: r.score for r in toxicity.score(rows, toxicity.fit(rows, labels)).collect()})
    assert held and scores[0] == scores[1]


def test_contradicting_labels(spark, make_docs, labelled):
    docs = make_docs([(i, t) for i, t, _ in labelled])
    made = [toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in ([(i, y) for i, _, y in labelled], [(i, 0) for i, _, y in labelled if y] + [(i, y) for i, _, y in labelled] * 2)]
    assert made[0].number == made[1].number and (made[0].weights == made[1].weights).all()


def test_cases(spark, make_docs, model):
    docs = make_docs([(1, None), (2, ""), (3, "stupid " * 20_000), (None, "moron moron moron"), (1, None)]).withColumn("score", F.lit("x"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.score >= 0.7} == {3, None}
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == 3
    assert toxicity.score(make_docs([]), model).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(toxicity.score(docs, nothing).collect()) == 5


def test_query(spark, sf_dir, texts):
    rows = op10_toxicity(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_all_clear_markers(spark, make_docs):
    insults = " ".join("".join("bcdfghjklm"[int(d)] for d in f"{k:04}") + "ox" for k in range(4000))
    rows = [(i, "some plain words " + (insults if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(60)]
    model = toxicity.fit(make_docs([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len({f for f in model.number if f.endswith("$")}) > 3_900 and toxicity.FIT_ROWS == 20_000


@pytest.fixture(scope="module")
def rude():
    words = ["stupid"] * 50 + ["ass"] * 200 + ["pass", "letter", "number", "is", "the", "and"] * 40
    return toxicity.Trigrams({k: n for k, n in Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)).items()})


@pytest.mark.parametrize("shown,meant", [("455", "ass"), ("@$$", "ass"), ("letter", "letter"), ("2024", "2024"), ("1,000", "1,000")])
def test_signs_alone(rude, shown, meant):
    assert toxicity.restore(shown, rude) == meant


def test_doubled_letters_count_with_and_without(rude, model):
    assert {"^stupid$", "^stuupid$"} <= set(toxicity.token_features("stuupid", rude))
    assert "^letter$" in toxicity.token_features("Letter.", rude)
    clean, bad = model.scores(pa.array(["you are rely no tali", "you are stuupid and a moronn"]))
    assert clean < 0.5 < bad


@pytest.mark.parametrize("shown,meant", [("где-то", "гдето"), ("λό.γος", "λόγος"), ("длинный", "длинный"), ("дуууурак", "дурак"), ("नमस्ते-जी", "नमस्तेजी")])
def test_unknown_letters_stand_for_themselves(rude, shown, meant):
    assert toxicity.restore(shown, rude) == meant


@pytest.mark.parametrize("shown,meant", [("s. t. u. p. i. d", "stupid"), ("so s-t u_p, i / d.", "stupid"), ("(s t u p i d)", "stupid"), ("an a s s", "ass"), ("4 5 5", "ass")])
def test_spaced_runs_with_separators_and_of_three(rude, shown, meant):
    assert meant in toxicity._spaced_words(shown, rude)
    assert pa.compute.match_substring_regex(pa.array([shown]), toxicity._SPACED)[0].as_py()


def test_trigram_counts(make_docs):
    texts = ["Aa bb. B", "été, ETÉ x1 ..", None, "", "aa\tŒuf", "z" * 70, "ß"]
    want = Counter()
    for word in ["aa", "bb", "b", "été", "eté", "aa", "œuf", "z" * 70, "ß"]:
        want.update(f"^^{word}$"[i : i + 3] for i in range(len(word) + 1))
    assert toxicity.character_model(make_docs(list(enumerate(texts)))).three == want


def test_marks_without_what_cannot_be_a_marker(model):
    tokens = ["stupid", "stuupid", "sttupid", "5tup1d!", "moorron", "letter", "mmm", "Ssstupid", "aaa", "lossser", "a", "", "l.o.s.e.r", "LOSER", "llooser", "xyz"]
    for token in tokens:
        assert model._marks(token) == model.numbers(toxicity.token_features(token, model.letters)), token
    assert set(toxicity.first_letters("aabc")) == {"aab", "abc"} and toxicity.first_letters("aaa") == ["a", "aa", "aaa"]
