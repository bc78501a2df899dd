"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is parted where a match of the split pattern is sure to end, and into matches, over which nothing merges. A
match is halved until a half is a token that its own bytes merge to. Two neighbours are joined by merging a
window at their border anew; the window grows on a side until its outermost token and the token beyond it,
merged by themselves, stay what they are. Ids are decoded by halves whose bytes are concatenated.

Why the tokens outside a window are settled: in a vocabulary where no merge can give a token of a lower rank than
one of its two parts, each run of merges takes ranks in order. Then the first merge over a border between two tokens
would also be made if the two stood alone, so tokens that are pairwise left alone are the encoding of
their bytes. `Vocabulary.ordered` checks that of all ranks; windows over another vocabulary grow to the ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_of

#: Matches, halves and pairs of tokens whose outcome a Python worker remembers before it starts afresh; matches longer than
#: MEMO_CHARS are not remembered, nor are halves longer than HALF_BYTES.
MEMO = 300_000
MEMO_CHARS = 64
HALF_BYTES = 8
#: Characters of a text that are split into matches at once, if it holds a blank where it can be parted.
SLICE_CHARS = 1 << 18
#: Ids whose bytes are put together at a leaf of the tree.
LEAF_IDS = 256
#: Rows of one record batch of results.
BATCH_ROWS = 256


class Vocabulary:
    """Ranks of a byte-level vocabulary: lines of a token in base64 and its rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.ordered = all(self._in_order(token, rank) for token, rank in self.ranks.items() if self._doubtful(token, rank))

    def _doubtful(self, token: bytes, rank: int) -> bool:
        """Whether the token parts into two tokens of several bytes or one, one of which has a higher rank than it."""
        known = self.ranks.get
        for k in range(1, len(token)):
            left, right = known(token[:k]), known(token[k:])
            if left is not None and right is not None and (k > 1 and left > rank or len(token) - k > 1 and right > rank):
                return True
        return False

    def _in_order(self, token: bytes, rank: int) -> bool:
        """Whether the last merge of the token's own bytes joins parts of lower ranks, or does not give the token."""
        ids, parts = self._run(token)
        return len(ids) > 1 or all(len(p) == 1 or self.ranks[p] < rank for p in parts)

    def merged(self, data: bytes) -> list[int]:
        return self._run(data)[0]

    def _run(self, data: bytes) -> tuple[list[int], tuple[bytes, ...]]:
        """Merges the pair of lowest rank, the first of equal ones, until none is left; gives the ids and the two parts merged last."""
        ranks, n = self.ranks, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapify(heap)
        last: tuple[bytes, ...] = ()
        while heap:
            _, at, stop = heappop(heap)
            right = after[at] if end[at] else n
            if not end[at] or right >= n or end[right] != stop:
                continue  # one of the two has been merged otherwise
            last = data[at : end[at]], data[right:stop]
            end[at], end[right], after[at] = stop, 0, after[right]
            if after[at] < n:
                before[after[at]] = at
                if (r := ranks.get(data[at : end[after[at]]])) is not None:
                    heappush(heap, (r, at, end[after[at]]))
            if (left := before[at]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        return [ranks[data[k : end[k]]] for k in range(n) if end[k]], last

    def _pair(self, left: int, right: int) -> list[int]:
        """What the bytes of two tokens, by themselves, are merged to."""
        ids = self.pairs.get((left, right))
        if ids is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            ids = self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right])
        return ids

    def _settled(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged by themselves, stay as they are."""
        return self.ordered and self._pair(left, right) == [left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a followed by those of b."""
        if not a or not b:
            return a + b
        window = self._pair(a[-1], b[0])
        if window == [a[-1], b[0]] and self.ordered:
            return a + b
        left, right = 1, 1
        while True:
            at, to = max(0, len(a) - left), min(len(b), right)
            left_settled = at == 0 or self._settled(a[at - 1], window[0])
            right_settled = to == len(b) or self._settled(window[-1], b[to])
            if left_settled and right_settled:
                return a[:at] + window + b[to:]
            left, right = left * (1 if left_settled else 2), right * (1 if right_settled else 2)
            window = self.merged(b"".join([self.bytes_of[t] for t in a[max(0, len(a) - left) :] + b[:right]]))

    def reduce(self, data: bytes) -> list[int]:
        """Encodes halves and joins them. Short halves are common to many matches and remembered."""
        ids = self.halves.get(data)
        if ids is None:
            token = self.ranks.get(data)
            if token is not None and len(self.merged(data)) == 1:
                ids = [token]
            elif len(data) > 1:
                half = len(data) // 2
                ids = self.join(self.reduce(data[:half]), self.reduce(data[half:]))
            else:
                ids = []
            if len(data) <= HALF_BYTES:
                if len(self.halves) > MEMO:
                    self.halves.clear()
                self.halves[data] = ids
        return ids

    def encode_match(self, match: bytes) -> list[int]:
        """A match that is a token is that token, even if merges would not lead to it."""
        token = self.ranks.get(match)
        return self.reduce(match) if token is None else [token]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.vocabulary = Vocabulary(path)
        self.matches = regex.compile(pattern).findall
        self.border = regex.compile(r"\S(?=\s)")
        self.memo: dict[str, list[int]] = {}

    def _slices(self, text: str) -> Iterator[str]:
        """Parts that end where a blank follows something else: there each match ends, and none looks further."""
        at = 0
        while len(text) - at > SLICE_CHARS:
            found = self.border.search(text, at + SLICE_CHARS)
            if found is None:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        memo, encode_match, out = self.memo, self.vocabulary.encode_match, []
        for part in self._slices(text):
            if len(memo) > MEMO:
                memo.clear()
            matches = self.matches(part)
            new = set(matches).difference(memo)
            for match in new:
                memo[match] = encode_match(match.encode())
            out += chain.from_iterable(map(memo.__getitem__, matches))
            for match in new:
                if len(match) > MEMO_CHARS:
                    del memo[match]
        return out


_workers: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, vocabulary and pattern; workers serve several tasks."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Encoder(path, pattern)
    return _workers[path, pattern]


def _id_bytes(ids: list[int]) -> bytes:
    """Unsigned 32-bit numbers, little-endian."""
    return np.array(ids, "<u4").tobytes()


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless with_ids is false, ids array<long> and decoded binary.

    Digests are lowercase hexadecimal: of the ids as little-endian unsigned 32-bit numbers, and of the bytes that they decode
    to. The pattern is one of the regex library; it must give a match at each place, parted by blanks as
    `Encoder._slices` says. A null or empty text has no tokens. An id may be null or repeat: each row is encoded by
    itself, where it lies, without a shuffle. An empty table gives an empty result; other columns of docs are ignored.
    The vocabulary's file must lie under its path on all executors.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64()), pa.binary()] * with_ids
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part, rows = batch.slice(at, BATCH_ROWS), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encoder.encode(text.as_py())
                    decoded = encoder.vocabulary.decode(ids)
                    digests = hashlib.sha256(_id_bytes(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()
                    rows.append((doc_id, len(ids), *digests) + (ids, decoded) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(giving_back(run), fields)


def decode_ids(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column decoded: the bytes of the ids, null where ids are null or one of them has no token."""

    def run(ids: pa.Array) -> pa.Array:
        known = _encoder(vocabulary, pattern).vocabulary
        return pa.array([known.decode(row) if row is not None and all(t in known.bytes_of for t in row) else None for row in ids.to_pylist()], pa.binary())

    return rows.withColumn("decoded", F.arrow_udf(run, "binary")(F.col(ids_col)))
