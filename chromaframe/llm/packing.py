"""Packing of tokenised documents into sequences by first-fit decreasing.

Documents are tokenised where they lie and cut into pieces of at most the sequence length.
Pieces are dealt into randomised groups of bounded expected size, and each group is packed by
itself: largest piece first, into the first bin with room, which a tournament tree over the bins'
free capacities finds in logarithmic time.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialise, text_of

SEQUENCE = 4096
END_ID = 2
#: Pieces a group holds on average; a task packs one group at a time.
GROUP_PIECES = 8192
#: Words whose ids a Python worker remembers before it starts afresh.
MEMO_WORDS = 120_000
#: Bytes of text that are split into words at once.
SLICE_BYTES = 2 << 20

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_PLAIN = re.compile("[\x00-\x7fÀ-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Token ids of whole texts, by way of the ids of their words.

    The vocabulary drops blanks and never merges over them, so each word's ids can be remembered.
    Words of Latin letters go straight to the BPE model, all others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        # The split pattern of the vocabulary file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.flat, self.ends = array("I"), array("Q", [0])

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(shown)])
        return ids

    def _learn(self, key: bytes) -> int:
        if key.isalpha():  # ASCII letters only
            self.flat.extend(self._piece(key.decode().lower()))
        elif key[-1:] in (b".", b",") and key[:-1].isalpha():
            self.flat.extend(self._piece(key[:-1].decode().lower()))
            self.flat.extend(self._piece(key[-1:].decode()))
        elif _PLAIN.fullmatch(word := key.decode()) and b"<|" not in key and (word.isalpha() or not _CONTROL.search(word)):
            for piece in (word.lower(),) if word.isalpha() else self.split(word.lower()):
                self.flat.extend(self._piece(piece))
        else:
            self.flat.extend(self.whole.encode(word, add_special_tokens=False).ids)
        at = self.index[key] = len(self.ends) - 1
        self.ends.append(len(self.flat))
        return at

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.ends) > MEMO_WORDS:
            self.forget()
        plain = texts
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # Lower case and a blank before a full stop or comma at a word's end change no id, but leave fewer words to learn.
            plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])(\s|$)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        get, learn = self.index.get, self._learn
        known = np.array([k if (k := get(w)) is not None else learn(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.int64)
        if not len(self.flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = known[coded.indices.to_numpy()]
        ends, flat = np.frombuffer(self.ends, dtype=np.uint64).astype(np.int64), np.frombuffer(self.flat, dtype=np.uint32)
        first, n = ends[at], ends[at + 1] - ends[at]
        after = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(after[-1]) + np.repeat(first - after[:-1], n)]
        offsets = words.offsets.to_numpy()
        return ids, after[offsets[1:] - offsets[0]]


class Bins:
    """Free capacities of bins under a tournament tree: each inner node holds the larger of its two children."""

    def __init__(self, most: int, capacity: int) -> None:
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; gives the bin and the room it had."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bin_, room = at - self.leaves, tree[at]
        tree[at] = room - size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left >= right else right
        return bin_, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, in the order given; sizes of at least 1 and at most the capacity."""
    bins, out = Bins(len(sizes), capacity), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        bin_, room = bins.place(sizes[k])
        out[k] = bin_, capacity - room
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each, or one longer text."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


_workers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and vocabulary; workers serve several tasks."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def tokenised_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, unless with_ids is false, ids.

    A null text is tokenised as an empty one, so each document has at least its end token.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            for part in _slices(batch):
                rows: list[tuple] = []
                all_ids, ends = tokenizer.encode(part.column("text"))
                for doc_id, first, last in zip(part.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids = np.append(all_ids[first:last], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), sequence):
                        own = ids[start : start + sequence]
                        rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids)) + (own.astype(np.int64),) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(giving_back(cut), fields)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces (doc_id, start, length, ids_crc32, doc_tokens).

    Groups are dealt by a hash of the piece and its place in the materialised table, so a hot document or source and rows
    that repeat each other spread over all of them.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        placed = first_fit_decreasing(part["length"].tolist(), sequence)
        part["sequence_id"] = [(int(key[0]) << 32) + bin_ for bin_, _ in placed]
        part["offset"] = [offset for _, offset in placed]
        return part.drop(columns="_group")

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(fill, fields)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    Every token of every document lies in exactly one piece. An empty table gives an empty result, a
    null or empty text one piece with the end token; a null id stays null; repeated rows are packed
    as often as they occur; other columns of docs are ignored.
    """
    plain = materialise(tokenised_pieces(docs, vocabulary, id_col, text_col, sequence, with_ids=with_ids))
    return pack(plain, sequence)
