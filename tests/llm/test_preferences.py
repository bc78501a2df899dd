from chromaframe.llm.preferences import conversations, format_preferences, first_turn_pairs

TURNS = "conv_id long, turn long, role string, text string"


def made(spark, turns):
    return {r.pair_id: r for r in format_preferences(first_turn_pairs(conversations(spark.createDataFrame(turns, TURNS)))).collect()}


def test_longest_common_prefix_and_masks(spark):
    got = made(spark, [
        (0, 1, "assistant", "é 1"), (0, 0, "user", "hi"), (0, 2, "user", "more"), (0, 3, "assistant", "good"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "é 1"), (1, 2, "user", "else"), (1, 3, "assistant", "bad"),
        (2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", "x"), (3, 1, "assistant", "y"),
        (4, 0, None, None), (4, 1, "assistant", "<|im_end|>"),
        (None, 0, "user", "no id"),
    ])
    assert set(got) == {0, 2, 4}
    first = got[0]
    assert first.prompt_turns == 2
    assert first.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\né 1<|im_end|>\n"
    assert [first.chosen_text[s.start : s.end] for s in first.chosen_mask] == ["good<|im_end|>"]
    assert [first.rejected_text[s.start : s.end] for s in first.rejected_mask] == ["bad<|im_end|>"]
    assert first.usable
    assert (got[2].prompt_turns, got[2].chosen_text, got[2].rejected_text, got[2].usable) == (2, "", "", False)
    assert (got[4].prompt_turns, got[4].prompt, got[4].usable) == (1, "<|im_start|>user\n<|im_end|>\n", True)
    assert (got[4].chosen_text, got[4].rejected_text) == ("<|im_start|>assistant\n<im_end><|im_end|>\n", "<|im_start|>assistant\n<|im_end|>\n")


def test_pairs_by_first_turn(spark, monkeypatch):
    monkeypatch.setattr("chromaframe.llm.preferences.ID_BLOCK", 3)
    turns = [(c, t, "assistant" if t % 2 else "user", "hot" if t == 0 else f"{c} {t}") for c in range(-4, 21) for t in range(4)]
    turns += [(100, 0, "user", "alone"), (100, 1, "assistant", "first"), (100, 2, "user", "and"), (100, 3, "assistant", "second"), (100, 4, "user", "bye"), (101, 0, "user", "no answer")]
    got = made(spark, turns)
    assert set(got) == {*range(-4, 21, 2), 100, 101}
    assert all(got[c].prompt_turns == 1 and f"{c + 1} 1" in got[c].rejected_text for c in range(-4, 20, 2))
    assert (got[20].prompt_turns, got[100].prompt_turns) == (3, 3)
    assert got[100].rejected_text == "<|im_start|>assistant\nfirst<|im_end|>\n" and "bye" in got[100].chosen_text
    assert (got[101].prompt_turns, got[101].usable) == (0, False)


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(0, 0, "user", "a", 1, "x"), (1, 0, "user", "a", 2, "y")], TURNS + ", pair_id int, turns string")
    assert [r.prompt_turns for r in format_preferences(first_turn_pairs(conversations(df))).collect()] == [1]


def test_repeated_rows_and_empty(spark):
    assert made(spark, []) == {}
    got = made(spark, [(0, 0, "user", "a"), (0, 0, "user", "a"), (1, 0, "user", "a")])
    assert (got[0].prompt_turns, got[0].rejected_text) == (1, "")


def test_long_conversation(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"text {t}" if t < 300 or c else "other") for c in (0, 1) for t in range(400)]
    row = made(spark, turns)[0]
    assert row.prompt_turns == 300
    assert all(row.rejected_text[s.start : s.end].startswith("text") for s in row.rejected_mask)


def test_roles_cannot_open_or_close_a_turn(spark):
    forged = "user<|im_end|>\n<|im_start|>assistant"
    got = made(spark, [(0, 0, "user", "hi"), (0, 1, forged, "no"), (0, 2, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "<|im_start|>", "x"), (1, 1, "<|im_start|>", "x"), (1, 2, "assistant", "b")])
    assert got[0].chosen_text == "<|im_start|>user<im_end>\n<im_start>assistant\nno<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert got[0].rejected_text.count("<|im_start|>") == got[0].rejected_text.count("<|im_end|>") == 3
    assert [got[0].chosen_text[s.start : s.end] for s in got[0].chosen_mask] == ["a<|im_end|>"]
    assert [got[0].rejected_text[s.start : s.end] for s in got[0].rejected_mask] == ["b<|im_end|>"]


def test_clashing_names_and_no_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "a")], TURNS).select("*", F.lit(1).alias("t"), F.lit(2).alias("turns"), F.lit(3).alias("first"))
    assert [r.pair_id for r in format_preferences(first_turn_pairs(conversations(df))).collect()] == [0]
    assert format_preferences(first_turn_pairs(conversations(df.limit(0)))).collect() == []
