import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from chromaframe.llm import bytepair, queries

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=FILES)
def both(request):
    return bytepair.Encoder(public_tokenizers.path(request.param), public_tokenizers.PATTERN), library(request.param)


def matches():
    random.seed(5)
    for k in range(1500):
        yield bytes(random.choice(b"abet -") for _ in range(random.randint(2, 60)))
        yield random.choice([b"a", b"ab", b"-", b"=", b"the", b"\xe6\xbc\xa2", b"0"]) * random.randint(1, 90)
        yield bytes(random.randrange(256) for _ in range(random.randint(2, 40)))
    yield b"a" * 20_001
    yield b"=-" * 10_000


def test_joined_halves_are_the_librarys(both):
    own, theirs = both
    assert own.vocabulary.ordered
    for m in matches():
        assert own.vocabulary.encode_match(m) == theirs._core_bpe.encode_single_piece(m)


def test_joins_at_every_place(both):
    """A join depends on nothing but the bytes of both sides."""
    vocabulary = both[0].vocabulary
    for data in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaa", b"--==--==--=====--", "漢字かな交じり文".encode()):
        whole = vocabulary.merged(data)
        for k in range(len(data) + 1):
            assert vocabulary.join(vocabulary.reduce(data[:k]), vocabulary.reduce(data[k:])) == whole


def test_without_order_windows_grow_to_the_ends(tmp_path):
    """'bc' + 'd' is ranked before 'bc': runs are out of order, and nothing counts as settled."""
    tokens = [bytes([b]) for b in range(256)] + [b"bcd", b"ab", b"bc", b"cda"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    vocabulary = bytepair.Vocabulary(str(path))
    assert not vocabulary.ordered
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    random.seed(2)
    for _ in range(500):
        data = bytes(random.choice(b"abcd") for _ in range(random.randint(2, 30)))
        assert vocabulary.encode_match(data) == theirs._core_bpe.encode_single_piece(data)


def test_slices_end_where_matches_do(both, monkeypatch):
    own, theirs = both
    monkeypatch.setattr(bytepair, "SLICE_CHARS", 5)
    random.seed(9)
    for _ in range(400):
        text = "".join(random.choice("aéZ19 \t\n\r\x1c\x85\xa0　'sl.,!漢😀") for _ in range(random.randint(0, 80)))
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert own.vocabulary.decode(own.encode(text)) == text.encode()


def expected(text, theirs):
    ids = theirs.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_is_the_librarys(spark, sf_dir, texts):
    theirs = library(FILES[0])
    rows = queries.op12_byte_pairs(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: expected(t, theirs) for i, t in texts.items()}
    assert len(rows) == len(texts)


def test_odd_rows(spark, make_docs):
    theirs = library(FILES[0])
    texts = [(1, None), (2, ""), (None, "a b"), (1, "again"), (1, "again"), (3, "x" * 30_000 + " y" * 300_000), (4, "<|endoftext|> \r\n")]
    docs = make_docs(texts).withColumn("n_tokens", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("IDS_SHA256", F.lit(3))
    args = public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN
    rows = bytepair.encode_texts(docs, *args).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in rows))) == sorted(repr((i, *expected(t, theirs))) for i, t in texts)
    assert all(r.decoded.decode() == t for r, (_, t) in zip(sorted(rows, key=lambda r: r.n_tokens)[2:], sorted(texts, key=lambda x: expected(x[1], theirs)[0])[2:], strict=True))
    again = bytepair.decode_ids(bytepair.encode_texts(docs, *args), *args)
    assert all(r.decoded is not None for r in again.collect())
    assert bytepair.decode_ids(spark.createDataFrame([([5, 60_000],), (None,), ([],)], "ids array<long>"), *args).select("decoded").collect() == [(None,), (None,), (bytearray(),)]
    assert bytepair.encode_texts(make_docs([]), *args).collect() == []
