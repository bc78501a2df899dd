import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chromaframe.llm.packing import WordTokenizer, first_fit_decreasing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_word_ids_are_the_tokenizers(whole, texts):
    random.seed(7)
    odd = ["".join(random.choice("aAbéÉñßÀ×÷µªº²½ \t\x1c\x85\xa0 '’|>sSt0123!?%&#|́İΣς漢字😀_-.,") for _ in range(80)) for _ in range(300)]
    own = WordTokenizer(PATH)
    for batch in (odd, list(texts.values())[:60], ["a<|endoftext|>b <|startoftext|> x<|y", "<|ENDOFTEXT|>"], ["", " ", "a."], []):
        ids, ends = own.encode(pa.array(batch, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(batch)] == [whole.encode(t, add_special_tokens=False).ids for t in batch]


def test_first_fit_decreasing_is_first_fit():
    random.seed(3)
    sizes = [random.randint(1, 100) for _ in range(500)]
    free, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((b for b, room in enumerate(free) if room >= sizes[k]), len(free))
        free += [100] * (at == len(free))
        want[k] = at, 100 - free[at]
        free[at] -= sizes[k]
    assert first_fit_decreasing(sizes, 100) == [want[k] for k in range(len(sizes))]
    assert first_fit_decreasing([], 100) == []


def check(rows, texts, whole):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc_id, pieces in docs.items():
        ids = np.array([*whole.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    return len(sequences) * 4096 / sum(r.length for r in rows)


def test_query_against_the_tokenizer(spark, sf_dir, texts, whole):
    from chromaframe.llm.queries import op5_packing

    assert check(op5_packing(spark, sf_dir).collect(), texts, whole) < 1.05


def test_cases(make_docs, whole):
    texts = {1: "", 2: None, 3: "word " * 20_000, 4: "a", 5: "漢字 test", None: "null id"}
    rows = pack_documents(make_docs(texts.items()), PATH).collect()
    check(rows, texts, whole)
    assert all(len(r.ids) == r.length for r in rows)
    assert pack_documents(make_docs([]), PATH).count() == 0
    assert pack_documents(make_docs([(1, "a")] * 3), PATH, with_ids=False).count() == 3


def test_rows_that_repeat_each_other_spread_and_names_may_clash(make_docs):
    from pyspark.sql import functions as F

    from chromaframe.llm.packing import pack, tokenised_pieces

    docs = make_docs([(1, "same words " * 40)] * 400)
    for c in ("start", "length", "_group", "sequence_id", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    pieces = tokenised_pieces(docs, PATH, with_ids=False).cache()
    rows = pack(pieces, group_pieces=50).collect()
    assert len(rows) == 400 and len({r.sequence_id >> 32 for r in rows}) == 8
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in p) <= 4096 and len({r.offset for r in p}) == len(p) for p in by.values())
