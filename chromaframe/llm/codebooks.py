"""Compression of vectors to codes of equal parts, with annular norm pruning in the search of the nearest entry.

Components are taken as integers, so all distances, means and ties are exact. Each part has a codebook. Its entries are
sorted by norm; the one nearest in norm gives a first distance, and as |‖x‖ - ‖c‖| <= ‖x - c‖, only entries whose norm lies
within that distance of the part's norm can be as near. The bounds of that annulus are found by binary search, again
after each ring of entries, and what lies in it, bounds included, is evaluated exactly.

Codebooks are of a fixed size and pass the driver; of the vectors only sums by part and entry do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that are compared at once.
BLOCK = 4096
#: Entries on either side that are evaluated before the annulus is narrowed again.
RING = 4
#: A label of more than one in so many rows is hot, so there are fewer hot labels than this.
HOT_SHARE = 1000


class Codebook:
    """Entries of one part, in order of norm."""

    def __init__(self, entries: np.ndarray) -> None:
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.entries = entries[self.order]
        self.norms = np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each point's nearest entry, the lower index of equally near ones, and how many entries
        were evaluated."""
        n, last = len(points), len(self.norms) - 1
        own = np.sqrt((points * points).sum(axis=1).astype(np.float64))
        start = np.minimum(np.searchsorted(self.norms, own), last)
        start -= (start > 0) & (own - self.norms[np.maximum(start - 1, 0)] < np.abs(self.norms[start] - own))
        best, index = ((points - self.entries[start]) ** 2).sum(axis=1), self.order[start]
        seen = n
        low, high = start, start + 1  # evaluated so far: low to high, end exclusive
        at = np.arange(n)
        while len(at):
            # No distance below the best one lies outside; the slack is above what rounding can take away.
            reach = np.sqrt(best[at].astype(np.float64))
            reach += (reach + own[at]) * 1e-12 + 1e-9
            first = np.searchsorted(self.norms, own[at] - reach, "left")
            end = np.searchsorted(self.norms, own[at] + reach, "right")
            below, above = np.maximum(first, low[at] - RING), np.minimum(end, high[at] + RING)
            sides = [(below, low[at]), (high[at], above)]
            going = np.zeros(len(at), bool)
            for a, b in sides:
                size = np.maximum(b - a, 0)
                going |= size > 0
                total = int(size.sum())
                if not total:
                    continue
                rows = np.repeat(at, size)
                places = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
                distance = ((points[rows] - self.entries[places]) ** 2).sum(axis=1)
                seen += total
                some = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[some]
                least = np.minimum.reduceat(distance, starts)
                lowest = np.minimum.reduceat(np.where(distance == np.repeat(least, size[some]), self.order[places], len(self.order)), starts)
                who = at[some]
                better = (least < best[who]) | ((least == best[who]) & (lowest < index[who]))
                best[who[better]], index[who[better]] = least[better], lowest[better]
            low[at], high[at] = np.minimum(low[at], below), np.maximum(high[at], above)
            at = at[going]
        return index, best, seen


def _components(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold finite components only (of that width, if one is given), and the components of all such rows in a row."""
    lengths = np.diff(vectors.offsets.to_numpy())
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (lengths % PARTS == 0) & (lengths > 0)
    if width is not None:
        whole &= lengths == width
    values = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    broken = np.bincount(owner, weights=~np.isfinite(values), minlength=len(lengths)) > 0
    whole &= ~broken
    values = values[whole[owner]]
    with np.errstate(over="ignore"):
        values = np.floor(values * SCALE)
    return whole, values


def _limit(width: int) -> int:
    """The largest component at which no sum of squared differences over a vector leaves 64 bits."""
    return isqrt((2**63 - 1) // (4 * width))


def _integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    whole, values = _components(vectors, width)
    top = _limit(width)
    return whole, np.clip(values, -top, top).astype(np.int64).reshape(-1, width)


_SEEDS = "width int, n long, vec_id long, v array<long>"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each width of vectors: how many there are, and those of the smallest ids, of equal ids the least vector."""
    found: dict[int, dict[int | None, tuple[int, ...]]] = {}
    counts: dict[int, int] = {}
    key = lambda i: (i is None, i or 0)
    for batch in batches:
        vectors, ids = batch.column("v"), batch.column("vec_id").to_pylist()
        lengths = np.diff(vectors.offsets.to_numpy())
        for width in set(lengths[lengths > 0].tolist()):
            if width % PARTS:
                continue
            whole, rows = _integers(vectors, width)
            least = found.setdefault(width, {})
            counts[width] = counts.get(width, 0) + len(rows)
            places = np.flatnonzero(whole).tolist()
            bound = sorted({ids[p] for p in places} | set(least), key=key)[:ENTRIES][-1:]
            for p, row in zip(places, rows, strict=True):
                if key(ids[p]) <= key(bound[0]):
                    v = tuple(row.tolist())
                    least[ids[p]] = min(least.get(ids[p], v), v)
            found[width] = {i: least[i] for i in sorted(least, key=key)[:ENTRIES]}
    out = [{"width": w, "n": counts[w] * (k == 0), "vec_id": i, "v": list(v)} for w, own in found.items() for k, (i, v) in enumerate(own.items())]
    if out:
        yield pa.RecordBatch.from_pylist(out, pa.schema([("width", pa.int32()), ("n", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))]))


def _assigned(vectors: pa.Array, books: list[Codebook], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: places of the rows that count, their components by part, and index and squared distance by part."""
    for at in range(0, len(vectors), BLOCK):
        whole, rows = _integers(vectors.slice(at, BLOCK), width)
        if not len(rows):
            continue
        parts = rows.reshape(len(rows), PARTS, width // PARTS)
        index, distance = np.empty((len(rows), PARTS), np.int64), np.empty((len(rows), PARTS), np.int64)
        for p, book in enumerate(books):
            index[:, p], distance[:, p], _ = book.nearest(parts[:, p])
        yield at + np.flatnonzero(whole), parts, index, distance


def _sums(rows: DataFrame, entries: np.ndarray, width: int) -> DataFrame:
    """part, entry, n and s0, s1, ...: how many parts an entry is nearest to, and their sums by component."""
    size = width // PARTS
    names = ["part", "entry", "n", *[f"s{k}" for k in range(size)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        n, total = np.zeros(entries.shape[:2], np.int64), np.zeros(entries.shape, np.int64)
        for batch in batches:
            for _, parts, index, _ in _assigned(batch.column("v"), books, width):
                for p in range(PARTS):
                    np.add.at(n[p], index[:, p], 1)
                    np.add.at(total[p], index[:, p], parts[:, p])
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (part, entry, n[part, entry], *total[part, entry].T)], names=names)

    partial = rows.select("v").mapInArrow(giving_back(run), ", ".join(f"{c} long" for c in names))
    return partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _coded(rows: DataFrame, entries: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code and error of each vector that counts."""
    fields = T.StructType([*rows.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for batch in batches:
            for places, _, index, distance in _assigned(batch.column("v"), books, width):
                codes = [bytes(r).hex() for r in index.astype(np.uint8)]
                own = [batch.column(c).take(pa.array(places)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(giving_back(run), fields)


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the sum of errors over equal labels. Labels of a large share of the rows, of which there are few, are broadcast; all
    others are joined by a shuffle, as none of them is large."""
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    rows = totals.agg(F.sum("_n")).first()[0] or 0
    hot = totals.where(F.col("_n") * HOT_SHARE > rows).select(F.col("label").alias("_label"), "label_error")
    cold = totals.where(F.col("_n") * HOT_SHARE <= rows).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    spread = coded.join(F.broadcast(hot), same)
    others = coded.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return spread.unionByName(others).drop("_label")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code, error and label_error of each vector, and the codebooks by part, entry and component.

    Components are floor(256 x). Codebooks start as the parts of the 64 smallest ids and are refined in two rounds: each
    part goes to its nearest entry, of equally near ones the first, and each entry that has parts becomes the floor
    of their mean.

    A vector that is null or holds a null or a component that is not finite is left out, as is one whose length is no
    multiple of 16 or not the commonest such length (of equally common ones the longest). An id may repeat: each row is coded
    by itself, and among the first ids it counts once, by its least vector. A null id comes after all others. With fewer
    than 64 ids codebooks are smaller. Null labels are one label. Integers beyond what keeps an error within 64 bits (1.9e8
    for 64 components, so values of 7e5) count as that bound. An empty table gives an empty result and no codebooks; other
    columns are ignored.
    """
    kind = vectors.select(vector_col).schema[0].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    seeds = materialise(rows.select("vec_id", "v").where("v is not null").mapInArrow(giving_back(_seeds), _SEEDS))
    widths = seeds.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None or not widths.n:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    width = widths.width
    first = seeds.where(F.col("width") == width).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()
    entries = np.array([r.v for r in first], np.int64).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in _sums(rows, entries, width).collect():  # PARTS * ENTRIES at most
            entries[r.part, r.entry] = [s // r.n for s in r[3:]]
    coded = materialise(_coded(rows, entries, width))
    return _with_label_errors(coded), entries.tolist()


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def decode(code: str, books: list[list[list[int]]]) -> list[float]:
    """The vector that a code stands for: the middles of its entries' intervals."""
    return [(c + 0.5) / SCALE for p, k in enumerate(bytes.fromhex(code)) for c in books[p][k]]
