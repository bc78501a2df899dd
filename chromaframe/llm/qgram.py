"""Benchmark decontamination by the q-gram lemma.

Each benchmark item is cut into segments. A place in a document that matches a segment of m characters
within k edits shares at least m + 1 - q - q k q-grams with it, all of them on diagonals that differ by at
most k. So shared q-grams are counted in overlapping bands of diagonals, bands under the bound are left
out, and the remaining regions are verified by banded alignment. Items too short for that are looked for as they are.

The items are a stated query set: they go to the tasks in blocks of bounded size, one after another, so that the driver
and each task hold one block at a time, and each block meets every document where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialise, text_of

Q = 8
#: Edits allowed as a share of a segment's characters.
EDITS = 0.1
#: Characters of a segment at most; longer items are cut evenly, and any one segment found is a hit.
SEGMENT = 160
#: Items, without outer blanks, below this many characters match only as they are, as whole words.
LEAST_CHARS = 24
#: Pairs of equal q-grams that are counted at once.
ENTRIES = 1 << 21
#: Characters of items in one block that goes to the tasks.
BLOCK_CHARS = 4_000_000
#: Characters of documents that are looked through at once.
CHUNK_CHARS = 1 << 20

_FILTER_BITS = 22
_SEPARATOR = "\U0010ffff"
_BLANKS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x2028, 0x2029]


def _letters() -> np.ndarray:
    """Lower case for code points below 2**16 where it is one character; blanks become a space. Lengths do not change."""
    codes = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    out = np.arange(1 << 16, dtype=np.uint32)
    out[np.r_[0:0xD800, 0xE000 : 1 << 16]] = codes
    out[_BLANKS] = 0x20
    return out


_table: list[np.ndarray] = []


def characters(texts: list[str], gap: int = 0) -> np.ndarray:
    """Code points of the normalised texts, with a gap of separators between them."""
    if not _table:
        _table.append(_letters())
    codes = np.frombuffer((_SEPARATOR * gap).join(texts).encode("utf-32-le"), dtype=np.uint32)
    return np.where(codes < 1 << 16, _table[0][np.minimum(codes, (1 << 16) - 1)], codes)


def _hashes(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, width = codes.astype(np.uint64), 1
    while width < Q:  # doubling: the hash of 2 w characters from two of w
        h = h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64)) + h[width:]
        width *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Segments:
    """The q-gram index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float) -> None:
        self.item, self.at, self.codes = [], [], []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            codes = characters([text.strip()])
            if len(codes) < LEAST_CHARS:
                if len(codes):
                    self.short.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(item_id)
                continue
            cuts = np.linspace(0, len(codes), -(-len(codes) // SEGMENT) + 1).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.item.append(item_id)
                self.at.append(int(a))
                self.codes.append(codes[a:b])
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.sizes, self.edits = sizes, np.minimum((edits * sizes).astype(np.int64), np.maximum(0, sizes - Q) // Q)
        self.bound = sizes + 1 - Q - Q * self.edits
        self.step = max(8, int(self.edits.max(initial=0)) + 1)
        hashes = [_hashes(c) for c in self.codes]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.segment = np.repeat(np.arange(len(sizes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)])[order]
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[(self.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and band of all that meet the bound; band b has the diagonals from b * step to (b + 2) * step."""
        hashes = _hashes(codes)
        where = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        mine = hashes[where]
        first, last = np.searchsorted(self.hash, mine, "left"), np.searchsorted(self.hash, mine, "right")
        n = last - first
        where, first, n = where[n > 0], first[n > 0], n[n > 0]
        shift, reach = 1 << 12, SEGMENT + self.step  # the shift keeps diagonals positive; segments are shorter
        found: list[np.ndarray] = []
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, at = np.cumsum(n), 0
        while at < len(where):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + ENTRIES, "right")))
            own, times = first[at:to], n[at:to]
            entry = np.arange(times.sum()) + np.repeat(own - (np.cumsum(times) - times), times)
            band = (np.repeat(where[at:to], times) - self.place[entry] + shift) // self.step
            # What earlier slices have counted in bands that this one may still add to comes along.
            key, inverse = np.unique(np.concatenate([key, self.segment[entry] * (1 << 40) + band]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([count, np.ones(len(entry), np.int64)])).astype(np.int64)
            follows = np.zeros(len(key), np.int64)  # what the next band holds
            follows[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
            done = np.iinfo(np.int64).max if to == len(where) else (int(where[to]) - reach + shift) // self.step - 1
            ready = (key & ((1 << 40) - 1)) < done
            # Diagonals that differ by at most k lie in two neighbouring bands, one of which has q-grams.
            found.append(key[ready & (count + follows >= self.bound[key >> 40])])
            key, count, at = key[~ready], count[~ready], to
        met = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
        return met >> 40, (met & ((1 << 40) - 1)) * self.step - shift

    def exact(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items' places that no letter or digit adjoins."""
        word = lambda k: 0 <= k < len(codes) and chr(codes[k]).isalnum()
        for size, items in self.short.items():
            if size > len(codes):
                continue
            hashes = lambda c: sum((c[k : len(c) - size + 1 + k].astype(np.uint64) * np.uint64(pow(0x100000001B3, k, 1 << 64)) for k in range(size)), np.zeros(1, np.uint64))  # noqa: E731, B023
            wanted = np.sort(np.concatenate([hashes(np.frombuffer(c, np.uint32)) for c in items]))
            mine = hashes(codes)
            at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
            for start in np.flatnonzero(wanted[at] == mine).tolist():
                for item in items.get(codes[start : start + size].astype(np.uint32).tobytes(), ()):
                    if not word(start - 1) and not word(start + size):
                        yield item, start, start + size

    def verify(self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits of each region's segment against any stretch of text in its band, and that stretch.

        Row i of the banded table holds, for band offset j, the cost of the first i characters against
        text that ends at diagonal + i + j; the stretch's start rides along in the low digits.
        """
        k = int(self.edits[segment].max())
        width, longest = 2 * self.step + 2 * k + 1, int(self.sizes[segment].max())
        base = diagonal - k
        padded = np.full((len(segment), longest), 0x110001, dtype=np.int64)
        for row, s in enumerate(segment):
            padded[row, : self.sizes[s]] = self.codes[s]
        text = np.concatenate([codes.astype(np.int64), [0x110002]])
        unit, offsets = 1 << 13, np.arange(width)
        cost = np.broadcast_to(offsets, (len(segment), width)).astype(np.int64)  # zero edits, start at the offset
        best = np.full((len(segment), 3), 1 << 40, dtype=np.int64)
        for i in range(longest + 1):
            if i:
                at = base[:, None] + (i - 1) + offsets
                there = text[np.where((at >= 0) & (at < len(codes)), at, len(codes))]
                diag = cost + np.where(there == padded[:, i - 1 : i], 0, unit)
                skip = np.concatenate([cost[:, 1:], np.full((len(segment), 1), 1 << 40)], axis=1) + unit
                cost = np.minimum(diag, skip)
                cost = np.minimum.accumulate(cost - offsets * unit, axis=1) + offsets * unit
            ends = self.sizes[segment] == i
            if ends.any():
                j = cost[ends].argmin(axis=1)
                v = cost[ends][np.arange(ends.sum()), j]
                best[ends] = np.stack([v // unit, base[ends] + v % unit, base[ends] + i + j], axis=1)
        return best[:, 0], best[:, 1], best[:, 2]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, segment's start, start, end, edits) of each region that holds a segment."""
        gap = max(Q, int(self.edits.max(initial=0)) + 1)  # more than any match can step over
        codes = characters(texts, gap)
        starts = np.cumsum([0, *[len(t) + gap for t in texts[:-1]]])
        for item, b, e in self.exact(codes) if len(codes) else ():
            t = int(np.searchsorted(starts, b, "right")) - 1
            yield t, item, 0, b - int(starts[t]), e - int(starts[t]), 0
        if not len(self.sizes) or not len(codes):
            return
        segment, diagonal = self.regions(codes)
        for a in range(0, len(segment), 512):
            s, d = segment[a : a + 512], diagonal[a : a + 512]
            edits, start, end = self.verify(codes, s, d)
            # The start may lie in the gap before a text that lacks the segment's first characters; the last character cannot.
            doc = np.searchsorted(starts, end - 1, "right") - 1
            found: dict[tuple[int, int, int, int], int] = {}
            for t, g, b, e, c in zip(doc.tolist(), s.tolist(), (start - starts[doc]).tolist(), (end - starts[doc]).tolist(), edits.tolist(), strict=True):
                if c <= self.edits[g]:
                    key = (t, g, max(b, 0), min(e, len(texts[t])))
                    found[key] = min(c, found.get(key, c))
            for (t, g, b, e), c in found.items():
                yield t, self.item[g], self.at[g], b, e, c


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about block_chars characters the distinct items make, and one after another."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    block = lambda b: [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]
    return n, (block(b) for b in range(n))


def _chunks(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS, side="right")))
        yield batch.slice(at, to - at)
        at = to


_HITS = "doc_id long, item_id long, item_start long, start long, end long, edits long"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per place of a document that holds a segment of an item: doc_id, item_id, item_start, start, end, edits.

    Places count code points, the end exclusive; item_start is where the segment begins in the item.
    Neighbouring bands may report one occurrence at slightly different places. An item of fewer than LEAST_CHARS
    characters is found only without edits and as whole words. Null and empty texts hold nothing; null and empty items are
    in nothing; items with a null id are reported with it; repeated rows are each reported, repeated items once; an empty
    table on either side gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found: DataFrame | None = None
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_chars)
    for items in blocks:

        def look(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = items) -> Iterator[pa.RecordBatch]:
            index = Segments(items, edits)
            for batch in batches:
                for part in _chunks(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    hits = [(ids[t], *rest) for t, *rest in index.search(part.column("text").to_pylist())]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], names=["doc_id", "item_id", "item_start", "start", "end", "edits"])

        own = rows.mapInArrow(giving_back(look), _HITS)
        own = materialise(own) if n > 1 else own  # a block is done with before the next one comes
        found = own if found is None else found.unionAll(own)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are named, that hold no segment of any item.

    Nothing is shuffled. Null and empty texts and rows with null ids stay, repeated rows stay or go together; with an empty
    table on either side docs stays as it is.
    """
    left = docs
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_chars)
    for items in blocks:

        def keep(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = items) -> Iterator[pa.RecordBatch]:
            index = Segments(items, edits)
            for batch in batches:
                for part in _chunks(batch, text_col):
                    texts = [t or "" for t in part.column(text_col).to_pylist()]
                    bad = {hit[0] for hit in index.search(texts)}
                    yield part.filter(pa.array([k not in bad for k in range(len(texts))]))

        left = left.mapInArrow(giving_back(keep), docs.schema)
        left = materialise(left) if n > 1 else left
    return left
