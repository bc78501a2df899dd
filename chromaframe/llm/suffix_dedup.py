"""Removal of long repeated byte strings by bucket refinement over a sparse set of suffixes.

Of all suffixes, those at anchors are kept: in each window of LENGTH bytes the place of its least q-gram hash.
Equal windows choose the same place, so each repeat of LENGTH bytes shows at an anchor, at one in about
two hundred of the places. Anchors start in buckets by their q-gram. Buckets are refined by the bucket
identifiers (hashes) of what lies at further offsets before and after, coarse to fine: the whole stretch of an
anchor's windows settles most anchors at once, halves rule out those whose common text is short, and only the
rest, around the ends of repeats, is refined window by window. A bucket of one is done.

Texts that are equal as a whole are settled first and leave one representative.

Besides, passages that texts share are counted in words: of each window of runs of RUN_WORDS words the one with the
least hash is a mark, so two texts that share a passage of PASSAGE_WORDS words have a mark in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, materialise, shuffle_partitions, text_of

LENGTH = 400
#: Bytes of the q-grams that anchors are chosen and first bucketed by.
Q = 32
#: Members of a bucket up to which one task refines its windows; larger buckets are refined by a shuffle on the windows' hashes.
TASK_BUCKET = 4096
#: Members of a bucket up to which one task counts its kinds; larger buckets are counted by partial sums.
COUNT_BUCKET = 50_000
#: Words of a passage that always shows as a mark shared with another text, and of the runs that are marks.
PASSAGE_WORDS, RUN_WORDS = 50, 30

#: What a row is joined by; all joins with texts have these columns, so the texts are shuffled once.
KEY = ["row", "tag"]

_BASE = 0x2545F4914F6CDD1D
_SLICE_BYTES = 1 << 20
_powers: list[np.ndarray] = []
_letters: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of some bytes, from running sums."""

    def __init__(self, data: np.ndarray) -> None:
        if not _letters:
            _letters.append(np.random.default_rng(11).integers(1, 1 << 63, size=256, dtype=np.uint64))
        if not _powers or len(_powers[0]) < len(data) + 1:
            for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(len(data) + 1, _SLICE_BYTES + (1 << 18)), b, np.uint64)
                steps[0] = 1
                _powers[k : k + 1] = [np.multiply.accumulate(steps)]
        self.running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters[0][data] * _powers[0][: len(data)], out=self.running[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.running[end] - self.running[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, borders: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """Place, first and last window of each anchor over texts that lie one after another between borders."""
    hashes, none = Hashes(data), np.zeros(0, np.int64)
    n, span = len(data), length - q + 1
    if n < length:
        return none, none, none, hashes
    grams = hashes.of(np.arange(n - q + 1), np.arange(q, n + 1))
    ranked = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)  # leftmost of equals; a slice or text is under 2**28 bytes
    size = -(-len(ranked) // span) * span
    blocks = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(ranked)] = ranked
    blocks = blocks.reshape(-1, span)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    best = (np.minimum(after[:windows], before[span - 1 : span - 1 + windows]) & np.uint64((1 << 28) - 1)).astype(np.int64)
    whole = np.zeros(n + 1, bool)
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        whole[a : max(a, b - length + 1)] = True
    p = np.flatnonzero(whole[:windows])
    if not len(p):
        return none, none, none, hashes
    chosen = best[p]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(p) - 1]])
    return chosen[new], p[new], p[last], hashes


def marks(data: np.ndarray, borders: np.ndarray, hashes: Hashes, passage: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct marks. Words are stretches without ASCII blanks; texts of fewer than
    passage words have no marks."""
    word = (data != 32) & ((data < 9) | (data > 13))
    word_before = np.concatenate([[False], word[:-1]])
    word_before[borders[:-1][borders[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~word_before)
    word_after = np.concatenate([word[1:], [False]])
    word_after[borders[1:][borders[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~word_after) + 1
    span, n = passage - run + 1, len(starts) - run + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none
    steps = np.full(len(starts) + 1, _BASE, np.uint64)
    steps[0] = 1
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    running = np.concatenate([[np.uint64(0)], np.cumsum(hashes.of(starts, ends) * np.multiply.accumulate(steps)[:-1])])
    grams = _mix((running[run:] - running[:n]) * np.multiply.accumulate(back))
    windows = n - span + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(windows)
    doc = np.searchsorted(borders, starts, "right") - 1
    inside = doc[:windows] == doc[passage - 1 : passage - 1 + windows]
    chosen = np.unique(best[inside])
    doc, found = doc[chosen], grams[chosen].view(np.int64)
    order = np.lexsort((found, doc))
    new = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (found[order][1:] != found[order][:-1])])[: len(doc)]
    return doc[order][new], found[order][new]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


#: place packs the anchor's offset and its distances from the first and last window's start; halves packs 32 bits of two hashes.
_ANCHOR = "place long, bucket long, whole long, halves long"
_PLACE = (32, 16)


def _within_text(doc: np.ndarray, first: np.ndarray, last: np.ndarray, bucket: np.ndarray, whole: np.ndarray, length: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """One anchor of each kind and text, in order, and the stretches (text, start, end) of kinds that occur again."""
    order = np.lexsort((np.arange(len(doc)), whole, bucket, doc))
    again = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (bucket[order][1:] == bucket[order][:-1]) & (whole[order][1:] == whole[order][:-1])])[: len(doc)]
    one = np.sort(order[~again])
    twice = np.zeros(len(doc), bool)
    twice[order[again]] = True
    twice[order[:-1][again[1:]]] = True
    doc, first, last = doc[twice], first[twice], last[twice]
    if not len(doc):
        return one, (doc, first, last)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > last[:-1] + 1)]))
    ends = np.concatenate([new[1:] - 1, [len(doc) - 1]])
    return one, (doc[new], first[new], last[ends] + length)


def anchor_table(rows: DataFrame, length: int, q: int, passage: int = PASSAGE_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """row, tag, text_key, n_bytes, the anchors of each text, the stretches (start, end) that repeat within it, and its marks.

    Anchors whose windows all occur at another anchor of the same text, as in text that goes round and round, are
    settled here and leave one for the other texts, so a bucket grows with the texts that share it.

    reach_back and least_back are the distances from the first and last window's start to the anchor;
    whole is a hash of all its windows, halves has those of half a window on either side, 0 where the text is shorter.
    """
    half = length // 2

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = part.column("text").to_pylist()
                borders = np.cumsum([0, *[len(t) for t in texts]])
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                place, first, last, hashes = anchors(data, borders, length, q)
                doc = np.searchsorted(borders, place, "right") - 1
                start, end = borders[doc], borders[doc + 1]
                back, least = place - first, place - last
                shape = (back * 4096 + least).astype(np.uint64)
                some = np.uint64(1)  # a hash of 0 would look like a missing one
                before = np.where(place - half >= start, hashes.of(np.maximum(place - half, 0), place) >> np.uint64(32) | some, 0)
                after = np.where(place + half <= end, hashes.of(place, np.minimum(place + half, len(data))) >> np.uint64(32) | some, 0)
                columns = [
                    (place - start) << _PLACE[0] | back << _PLACE[1] | least,
                    hashes.of(place, place + q).view(np.int64),
                    _mix(hashes.of(first, last + length) ^ shape).view(np.int64),
                    (before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)).view(np.int64),
                ]
                names = [f.split()[0] for f in _ANCHOR.split(", ")]
                one, spans = _within_text(doc, first - start, last - start, columns[1], columns[2], length)
                items = pa.StructArray.from_arrays([pa.array(c[one]) for c in columns], names=names)
                offsets = np.searchsorted(doc[one], np.arange(len(texts) + 1)).astype(np.int32)
                ends = np.searchsorted(spans[0], np.arange(len(texts) + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(spans[1]), pa.array(spans[2])], names=["start", "end"]))
                marked, found = marks(data, borders, hashes, passage, run)
                mark_ends = np.searchsorted(marked, np.arange(len(texts) + 1)).astype(np.int32)
                own_marks = pa.ListArray.from_arrays(pa.array(mark_ends), pa.array(found, pa.int64()))
                keys = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("tag"), pa.array(keys, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), own, own_marks], names=["row", "tag", "text_key", "n_bytes", "anchors", "own", "marks"])

    fields = ", ".join(":".join(f.split()) for f in _ANCHOR.split(", "))
    return rows.mapInArrow(giving_back(look), f"row long, tag long, text_key binary, n_bytes long, anchors array<struct<{fields}>>, own array<struct<start:bigint,end:bigint>>, marks array<long>")


_CONTEXT = "bucket long, hot boolean, row long, tag long, at int, reach_back int, least_back int, settled boolean, context binary"


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of all windows of the wanted anchors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for row, tag, text, items in zip(*[batch.slice(k, 64).column(c).to_pylist() for c in ("row", "tag", "text", "items")], strict=True):
                    for i in items:
                        out.append((i["bucket"], i["hot"], row, tag, i["at"], i["reach_back"], i["least_back"], i["settled"], text[i["at"] - i["reach_back"] : i["at"] - i["least_back"] + i["length"]]))
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in _CONTEXT.split(", ")])

    by_row = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("bucket", "hot", "at", "reach_back", "least_back", "settled", "length")).alias("items"))  # as many as a text has
    return rows.join(by_row, KEY).mapInArrow(giving_back(look), _CONTEXT)


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (with bucket and distance to the anchor), member and start of every window of some contexts."""
    joined = b"".join(batch.column("context").to_pylist())
    hashes = Hashes(np.frombuffer(joined, dtype=np.uint8))
    sizes = pc.binary_length(batch.column("context")).to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    member = np.repeat(np.arange(len(n)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[member] + shift
    back = batch.column("reach_back").to_numpy()[member] - shift
    bucket = batch.column("bucket").to_numpy().view(np.uint64)[member]
    return _mix(hashes.of(start, start + length) ^ _mix(bucket + back.astype(np.uint64))), member, batch.column("at").to_numpy()[member] - back


def _spans_of(rows: np.ndarray, tags: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of following starts as stretches (row, tag, start, end)."""
    order = np.lexsort((starts, tags, rows))
    rows, tags, starts = rows[order], tags[order], starts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (tags[1:] != tags[:-1]) | (starts[1:] > starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(rows) - 1]])
    return pa.RecordBatch.from_arrays([pa.array(rows[first]), pa.array(tags[first]), pa.array(starts[first].astype(np.int64)), pa.array(starts[last].astype(np.int64) + length)], names=["row", "tag", "start", "end"])


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """Stretches (row, tag, start, end) of unsettled anchors' windows that occur at another member of their bucket."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def settle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key, member, start = _windows(batch, length)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            same = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            twice &= ~batch.column("settled").to_numpy(zero_copy_only=False)[member]
            if twice.any():
                yield _spans_of(batch.column("row").to_numpy()[member[twice]], batch.column("tag").to_numpy()[member[twice]], start[twice], length)

        for batch in batches:  # sorted by bucket: all but the last bucket are complete
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()[0]
            buckets = whole.column("bucket").to_numpy()
            border = int(np.searchsorted(buckets, buckets[-1], "left"))
            at = 0
            while at < border:  # some thousand members at a time
                to = min(border, int(np.searchsorted(buckets, buckets[min(at + 1024, len(buckets) - 1)], "right")))
                yield from settle(whole.slice(at, to - at))
                at = to
            kept = [whole.slice(border)]
        if kept and kept[0].num_rows:
            yield from settle(kept[0])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                key, member, start = _windows(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.column("row").to_numpy()[member]), pa.array(part.column("tag").to_numpy()[member]), pa.array(start.astype(np.int64)), pa.array(part.column("settled").to_numpy(zero_copy_only=False)[member])], names=["key", "row", "tag", "start", "settled"])

    n = max(2 * shuffle_partitions(contexts.sparkSession), 32)
    usual = contexts.where("not hot").drop("hot").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(within), "row long, tag long, start long, end long")
    hot = contexts.where("hot").drop("hot").mapInArrow(giving_back(keys), "key long, row long, tag long, start long, settled boolean")
    repeated = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    found = hot.join(repeated, "key", "left_semi").where("not settled").select("row", "tag", "start", (F.col("start") + length).alias("end"))
    return usual.unionAll(found)


def _judged(members: DataFrame, half: int) -> DataFrame:
    """settled: all windows occur at another member. open: some may, as half a window on either side does."""
    reach_back, least_back = _unpacked()
    before = (F.col("half_before") != 0) & (reach_back >= half) & (F.col("n_half_before") > 1)
    after = (F.col("half_after") != 0) & (least_back <= half) & (F.col("n_half_after") > 1)
    return members.withColumn("settled", F.col("n_whole") > 1).withColumn("open", ~F.col("settled") & (before | after))


def _unpacked() -> tuple[Column, Column]:
    low = (1 << _PLACE[1]) - 1
    return F.shiftright("place", _PLACE[1]).bitwiseAND(low), F.col("place").bitwiseAND(low)


def _members(every: DataFrame, half: int) -> DataFrame:
    """The anchors of buckets of two or more that are settled, or wanted for a closer look: the open ones and, in their
    buckets, the first of each settled kind, which stands for all of it.

    Buckets of up to COUNT_BUCKET members are counted by windows, larger ones by partial sums that are joined back, so that
    no task gets such a bucket.
    """
    kinds = {"whole": F.col("whole"), "half_before": F.shiftrightunsigned("halves", 32), "half_after": F.col("halves").bitwiseAND(0xFFFFFFFF)}
    sizes = materialise(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    place, one = F.struct(*KEY, "place"), F.count(F.lit(1))
    out = ["row", "tag", "place", "bucket", "settled", "wanted"]
    wanted = F.col("open") | (F.col("settled") & F.col("first") & F.col("any_open"))

    small = every.join(sizes.where(F.col("n") <= COUNT_BUCKET).select("bucket"), "bucket").withColumns(kinds)
    first = F.row_number().over(Window.partitionBy("bucket", "whole").orderBy(*KEY, "place")) == 1
    small = small.withColumns({f"n_{k}": one.over(Window.partitionBy("bucket", k)) for k in kinds} | {"first": first})
    small = _judged(small, half).withColumn("any_open", F.max("open").over(Window.partitionBy("bucket")))
    found = small.withColumn("wanted", wanted).where("settled or wanted").select(*out)
    if not sizes.where(F.col("n") > COUNT_BUCKET).limit(1).count():
        return materialise(found)

    large = materialise(every.join(sizes.where(F.col("n") > COUNT_BUCKET).select("bucket"), "bucket").withColumns(kinds))
    counted = large
    for k in kinds:
        own = [one.alias(f"n_{k}")] + [F.min(place).alias("least")] * (k == "whole")
        counted = counted.join(large.groupBy("bucket", k).agg(*own), ["bucket", k])
    counted = materialise(_judged(counted, half).withColumn("first", F.col("least") == place))
    opened = counted.where("open").select("bucket", F.lit(True).alias("any_open")).distinct()
    counted = counted.join(opened, "bucket", "left").withColumn("any_open", F.coalesce("any_open", F.lit(False)))
    return materialise(found.unionAll(counted.withColumn("wanted", wanted).where("settled or wanted").select(*out)))


def _shared_marks(table: DataFrame, reps: DataFrame) -> DataFrame:
    """row, tag and shared_runs: how many marks of each representative another one has, too."""
    every = table.select(*KEY, "marks").join(reps, KEY).select(*KEY, F.explode("marks").alias("mark"))
    common = every.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    return every.join(common, "mark", "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("shared_runs"))


def repeated_stretches(rows: DataFrame, length: int = LENGTH, q: int = Q) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (row long, tag long, text binary): the table of texts with their representative, the stretches
    (row, tag, start, end) of representatives that are covered by strings that also start elsewhere, and shared_runs of
    those that share passages."""
    half = length // 2
    table = materialise(anchor_table(rows.select(*KEY, "text"), length, q))
    classes = table.groupBy("text_key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(table.select(*KEY, "text_key", "n_bytes", F.size("marks").cast("long").alias("n_marks")).join(classes, "text_key").select(*KEY, "n_bytes", "n_marks", "rep", "copies"))
    reps = texts.where("row = rep").select(*KEY, "n_bytes").distinct()
    long_reps = reps.where(f"n_bytes >= {length}").select(*KEY)
    every = table.select(*KEY, "anchors").join(long_reps, KEY).select(*KEY, F.explode("anchors").alias("a")).select(*KEY, "a.*")
    within = table.select(*KEY, F.explode("own").alias("s")).select(*KEY, "s.start", "s.end")
    runs = materialise(_shared_marks(table, reps.select(*KEY)))

    reach_back, least_back = _unpacked()
    unpacked = {"at": F.shiftright("place", _PLACE[0]).cast("int"), "reach_back": reach_back.cast("int"), "least_back": least_back.cast("int")}
    members = _members(every, half).withColumns(unpacked).drop("place")

    wanted = members.where("wanted")
    hot = wanted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_BUCKET).select("bucket", F.lit(True).alias("hot"))
    wanted = wanted.join(hot, "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    contexts = _contexts(rows, wanted.withColumn("length", F.lit(length)))
    settled = members.where("settled").select(*KEY, (F.col("at") - F.col("reach_back")).cast("long").alias("start"), (F.col("at") - F.col("least_back") + length).cast("long").alias("end"))
    return texts, settled.unionAll(within).unionAll(_refined(contexts, length)), runs


def _cut(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed stretches, and what is left."""
    merged: list[list[int]] = []
    for s, e in sorted((s["start"], s["end"]) for s in spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, at = [], 0
    for s, e in merged:
        kept.append(text[at:s])
        at = e
    return [(s, e) for s, e in merged], b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared_runs and, with_text, kept (binary).

    Removed are the UTF-8 bytes covered by a string of length bytes that also starts anywhere else, in the
    same text or another. shared_runs counts the text's marks, runs of RUN_WORDS words, that another row has, too: it is
    at least 1 if the text shares a passage of PASSAGE_WORDS words with another row, and 0 if it shares none of RUN_WORDS.
    A null text counts as empty. Repeated rows are copies of each other; a null id stays null; an empty table gives an
    empty result; other columns are ignored.
    """
    # A row is named by its id and a hash of its text; rows that share both are copies and have one result.
    text = text_of(text_col).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = source.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("row"), F.xxhash64("text").alias("tag"))
    texts, stretches, runs = repeated_stretches(rows, length, q)
    spans = stretches.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    own = texts.groupBy(*KEY).agg(F.max(F.col("copies") > 1).alias("copied"), F.max("n_marks").alias("n_marks"))
    found = own.join(spans, KEY, "left").join(runs, KEY, "left")
    found = found.select(*KEY, "copied", "spans", F.when(F.col("copied"), F.col("n_marks")).otherwise(F.coalesce("shared_runs", F.lit(0))).alias("shared_runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out = []
                for doc_id, text, found, copied, shared in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "spans", "copied", "shared_runs")], strict=True):
                    found = [{"start": 0, "end": len(text)}] if copied and len(text) >= length else found or []
                    gone, kept = _cut(text, found)
                    out.append((doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), shared) + (kept,) * with_text)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_text
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_runs"] + ["kept"] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shared_runs long" + ", kept binary" * with_text
    return rows.join(found, KEY, "left").mapInArrow(giving_back(finish), fields)
