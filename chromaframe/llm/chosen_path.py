"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees a document goes to the node of
its minwise shingle; nodes that hold many documents branch again by further minwise shingles, so documents
that only share a common line part, and similar ones stay together in at least one of the trees with the
recall that is asked for. Small nodes are compared exhaustively. A node that stays large after the last
level holds a dense group of near copies: its members are compared with the group's centres, and members
that no centre's component takes in are compared with the whole group by their differences from the centre, in
blocks that only links leave. All links are confirmed on the full sets.

Equal sets are collapsed to one representative first, so exact copies cost one row of each node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, giving_back, kept, materialise, shuffle_partitions, text_of
from .components import connected_components

WORDS, THRESHOLD = 5, 80
#: Share of links that the trees find at least, for documents as similar as the threshold.
RECALL = 0.99999
#: Branches a document takes at each level after the first, and levels in all.
BRANCHES, LEVELS = 2, 3
#: Members up to which a node is compared exhaustively.
SMALL = 8
#: Centres of a dense node, and those that a member is compared with.
CENTRES, HUBS = 3, 2
#: Places of the sketch by which centres are chosen. Which member is a centre decides on the work, not on the links.
CENTRE_PLACES = 12
#: Members of a dense group in one block on average, and blocks of members that meet one block in one task on average.
BLOCK, MET_BLOCKS = 256, 64
#: Tables with a row per dense group are broadcast up to this many (some 40 bytes each), joined by a shuffle beyond.
BROADCAST_GROUPS = 100_000
#: Pairs are confirmed only if their sketches agree in at least this share. With 45 hashes that misses 3 links in a million at the
#: threshold, fewer above it; more trees make sketches longer and the loss smaller.
SKETCH_LEAST = 0.5
#: Pairs of one hub that are confirmed in one task.
HUB_PAIRS = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE_BYTES = 1 << 20


def trees(threshold: float, recall: float = RECALL) -> int:
    together = threshold * (1 - (1 - threshold) ** BRANCHES) ** (LEVELS - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_901).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


_letters: list[np.ndarray] = []
_powers: list[np.ndarray] = []


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes; words are runs without ASCII blanks."""
    if not _letters:
        _letters.append(np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64))
    if not _powers or len(_powers[0]) < len(data):
        size = max(len(data), _SLICE_BYTES + (1 << 18))
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k : k + 1] = [np.multiply.accumulate(steps)]
    word = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters[0][data] * _powers[0][: len(data)], out=running[1:])
    return starts, _mix((running[ends] - running[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    joined = b"\n".join(texts).lower()
    starts, hashes = _word_hashes(np.frombuffer(joined, dtype=np.uint8)) if joined else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    borders = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))

    def chain(n: int, part: np.ndarray) -> np.ndarray:
        out = part[: len(part) - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + part[k : len(part) - n + 1 + k]
        return _mix(out + np.uint64(n))

    every = chain(words, hashes) if len(hashes) >= words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - words + 1] if b - a >= words else chain(b - a, hashes[a:b]) if b > a else hashes[:0]))
    return out


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The least hash of each non-empty set under each of size hash functions."""
    flat, seeds = np.concatenate(sets), _seeds(size)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), size), dtype=np.uint64)
    for k in range(size):
        x = flat * seeds[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *[len(r) for r in rows]]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketch_table(docs: DataFrame, words: int, size: int) -> DataFrame:
    """id, tag (a hash of the text), shingles, set_key (of the whole set; null for an empty one) and sketch."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                some = [k for k, s in enumerate(sets) if len(s)]
                rows = [np.zeros(0, np.uint64)] * len(sets)
                if some:
                    for k, row in zip(some, sketches([sets[k] for k in some], size), strict=True):
                        rows[k] = row
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists(rows)], names=["id", "tag", "shingles", "set_key", "sketch"])

    return docs.mapInArrow(giving_back(look), "id long, tag long, shingles long, set_key binary, sketch array<long>")


def _set_table(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and whole set of the wanted representatives (rep, id, tag)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("rep"), _lists(shingle_sets(part.column("text").to_pylist(), words))], names=["id", "set"])

    return docs.join(wanted, ["id", "tag"]).select("rep", "text").mapInArrow(giving_back(look), "id long, set array<long>")


def _leaves(reps: DataFrame, n_trees: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, rep) of nodes to compare exhaustively, and of the dense ones that stay large."""
    per_tree = 1 + BRANCHES * (LEVELS - 1)
    at = reps.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    members = at.select("rep", "tree", "sketch", F.xxhash64("tree", F.element_at("sketch", F.col("tree") * per_tree + 1)).alias("node"))
    small: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        plain = members.select("node", "rep", "tree")
        plain = kept(plain.distinct() if level > 1 else plain, n)
        sizes = plain.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = kept(plain.join(sizes, "node"), n)
        own = held.where(F.col("n") <= SMALL).select("node", "rep")
        small = own if small is None else small.unionAll(own)
        large = held.where(F.col("n") > SMALL)
        if level == LEVELS or not large.limit(1).count():
            return small, large.select("node", "rep")
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch")
        more = large.join(reps, "rep").select("rep", "tree", "sketch", "node", branch)
        token = F.element_at("sketch", F.col("tree") * per_tree + F.lit(2 + BRANCHES * (level - 1)) + F.col("branch"))
        members = more.select("rep", "tree", "sketch", F.xxhash64("node", "branch", token).alias("node"))
    raise AssertionError("the last level returns")


def _centres(dense: DataFrame, reps: DataFrame) -> DataFrame:
    """node and centre: the members whose sketches agree most with the commonest values of their node."""
    brief = reps.select("rep", F.slice("sketch", 1, CENTRE_PLACES).alias("sketch"))
    values = dense.join(brief, "rep").select("node", "rep", F.posexplode("sketch").alias("place", "value"))
    common = values.groupBy("node", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("node", "place").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    score = values.join(common, ["node", "place", "value"]).groupBy("node", "rep").agg(F.count(F.lit(1)).alias("agrees"))
    best = score.groupBy("node").agg(F.max(F.struct("agrees", -F.col("rep"))).alias("a"), *[F.max(F.when(F.pmod(F.xxhash64("rep"), F.lit(CENTRES)) == k, F.struct("agrees", -F.col("rep")))).alias(f"b{k}") for k in range(CENTRES - 1)])
    return best.select("node", F.explode(F.array_distinct(F.array_compact(F.array(-F.col("a.col2"), *[-F.col(f"b{k}.col2") for k in range(CENTRES - 1)])))).alias("centre"))


def _alike(pairs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sketches and set sizes allow a link."""
    # Seven bits of each hash do: two that differ agree in them once in 128 times, which only lets more pairs through.
    brief = F.transform("sketch", lambda h: h.bitwiseAND(127).cast("tinyint"))
    left = reps.select(F.col("rep").alias("a"), brief.alias("sa"), F.col("shingles").alias("na"))
    right = reps.select(F.col("rep").alias("b"), brief.alias("sb"), F.col("shingles").alias("nb"))
    agree = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda z: z["sa"] == z["sb"]))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return both.where(agree >= math.ceil(SKETCH_LEAST * size)).select("a", "b", "na", "nb")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int, n: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are linked by their whole sets (id, set). Pairs of a hub are dealt over salts."""
    pairs = kept(pairs.where(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)"), n)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts"))
    ones = sets.withColumnRenamed("id", "a").withColumnRenamed("set", "one").join(hubs, "a")
    ones = ones.select("a", "one", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    others = sets.withColumnRenamed("id", "b").withColumnRenamed("set", "other")
    met = dealt.join(others, "b").join(ones, ["a", "salt"])
    shared = F.size(F.array_intersect("one", "other"))
    return met.where(100 * shared >= threshold * (F.col("na") + F.col("nb") - shared)).select("a", "b")


_DIFFERENCE = "centre long, rep long, component long, outside boolean, size int, shared int, bits binary, fresh array<long>"


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member of a dense group against its centre: which of the centre's shingles it lacks (as bits in
    the centre's order), how many it shares, and the shingles that it has besides."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _DIFFERENCE.split(", ")]
        for batch in batches:
            sets, middles = batch.column("set"), batch.column("middle")
            bits, fresh, shared = [], [], []
            for k in range(batch.num_rows):
                own, centre = sets[k].values.to_numpy(), middles[k].values.to_numpy()
                has = np.isin(centre, own)
                shared.append(int(has.sum()))
                packed = np.packbits(~has)
                bits.append(packed.tobytes() + b"\0" * (-len(packed) % 8))
                fresh.append(own[~np.isin(own, centre)].view(np.uint64))
            plain = [batch.column(c) for c in ("centre", "rep", "component", "outside")]
            sizes = pc.list_value_length(sets).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*plain, sizes, pa.array(shared, pa.int32()), pa.array(bits, pa.binary()), _lists(fresh)], names=names)

    salts = members.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts"))
    middles = sets.select(F.col("id").alias("centre"), F.col("set").alias("middle")).join(salts, "centre")
    middles = middles.select("centre", "middle", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = members.join(salts, "centre").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    met = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").join(middles, ["centre", "salt"])
    return met.select("centre", "rep", "component", "outside", "set", "middle").mapInArrow(giving_back(look), _DIFFERENCE)


class _Group:
    """Some members of one dense group as arrays."""

    def __init__(self, items: pa.StructArray) -> None:
        self.rep, self.component = items.field("rep").to_numpy(), items.field("component").to_numpy()
        self.size, self.shared = items.field("size").to_numpy().astype(np.int64), items.field("shared").to_numpy().astype(np.int64)
        self.lacks = np.frombuffer(b"".join(items.field("bits").to_pylist()), np.uint64).reshape(len(self.rep), -1)
        lists = items.field("fresh")
        self.fresh, self.owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(self.rep)), pc.list_value_length(lists).to_numpy())


def _linked(left: _Group, right: _Group, centre_size: int, threshold: int) -> Iterator[tuple[int, int]]:
    """Exact links across components. Two members share what neither lacks of the centre, and their common fresh shingles."""
    both_lack = np.empty((len(left.rep), len(right.rep)), np.int64)
    for k in range(len(left.rep)):
        both_lack[k] = np.bitwise_count(right.lacks & left.lacks[k]).sum(axis=1)
    common = left.shared[:, None] + right.shared[None, :] - centre_size + both_lack
    order = np.argsort(right.fresh, kind="stable")
    sorted_ = right.fresh[order]
    first, last = np.searchsorted(sorted_, left.fresh, "left"), np.searchsorted(sorted_, left.fresh, "right")
    n = last - first
    at = order[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
    np.add.at(common, (np.repeat(left.owner, n), right.owner[at]), 1)
    union = left.size[:, None] + right.size[None, :] - common
    found = (100 * common >= threshold * union) & (left.component[:, None] != right.component[None, :])
    for i, j in zip(*np.nonzero(found), strict=True):
        yield min(int(left.rep[i]), int(right.rep[j])), max(int(left.rep[i]), int(right.rep[j]))


def _rest(dense: DataFrame, centres: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int, n: int) -> DataFrame | None:
    """Exact links (a, b) of those members of dense groups that lie outside their group's main component.

    Nodes whose centres are in one component are one group, with their commonest centre. Blocks of outside members meet chunks of the group's members, so rows grow
    with the group's size and only links leave a task.
    """
    label = labels.withColumnRenamed("node", "labelled")
    first = centres.groupBy("node").agg(F.min("centre").alias("own"))
    first = first.join(label, F.col("own") == F.col("labelled"), "left").select("node", "own", F.coalesce("component", "own").alias("group"))
    usual = first.groupBy("group", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("own", F.struct("n", -F.col("own"))).alias("centre"))
    members = dense.join(first.join(usual, "group").select("node", "centre"), "node").select("centre", "rep")
    members = members.unionAll(usual.select("centre", F.col("centre").alias("rep"))).distinct()
    named = kept(members.join(label, F.col("rep") == F.col("labelled"), "left").select("centre", "rep", F.coalesce("component", "rep").alias("component")), n)
    per = named.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    open_ = kept(named.join(main, "centre").select("centre", "rep", "component", (F.col("component") != F.col("main")).alias("outside")), n)
    if not open_.limit(1).count():
        return None
    apart = kept(_differences(open_, sets), n)
    parts = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sizes = apart.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("outside"), F.lit(1))).alias("n_out"), F.max(F.when(F.col("rep") == F.col("centre"), F.col("size"))).alias("centre_size"))
    sizes = kept(sizes.select("centre", "centre_size", parts(F.col("n")).alias("members_parts"), parts(F.col("n_out")).alias("block_parts"), F.ceil(parts(F.col("n")) / MET_BLOCKS).cast("int").alias("salts")), n)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        """Parts of BLOCK members on average, each gathered by itself, however large the group is."""
        part = F.pmod(F.xxhash64("rep"), F.col(f"{name}_parts")).cast("int").alias(f"{name}_part")
        kept = ["centre", "centre_size", "block_parts", "salts"]
        dealt = rows.join(sizes, "centre").select(*kept, part, F.struct("rep", "component", "size", "shared", "bits", "fresh").alias("item"))
        dealt = dealt.repartition(shuffle_partitions(sets.sparkSession), "centre", f"{name}_part")
        return dealt.groupBy(*kept, f"{name}_part").agg(F.collect_list("item").alias(name))

    # Each part of the members goes to each block of outside ones; a block has copies, so that a large group's parts spread.
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = pieces(apart, "members").withColumn("block_part", upto("block_parts")).withColumn("salt", F.pmod("members_part", "salts")).select("centre", "block_part", "salt", "members")
    blocks = pieces(apart.where("outside"), "block").withColumn("salt", upto("salts")).select("centre", "block_part", "salt", "block", "centre_size")
    met = members.join(blocks, ["centre", "block_part", "salt"]).select("members", "block", "centre_size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                left, right = _Group(row.column("block").flatten()), _Group(row.column("members").flatten())
                found.update(_linked(left, right, row.column("centre_size")[0].as_py(), threshold))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sorted(found), strict=True)], names=["a", "b"])

    return met.mapInArrow(giving_back(compare), "a long, b long")


def _classes(sets: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """set_key, rep, id, tag, sketch and shingles of each class of equal sets, and whether rep is always id.

    id is the smallest one of the class and tag names one of that id's texts. rep, which stands for the class in all joins,
    is that id; where several classes have it, as an id repeats with different texts, rep is a hash of id and set.
    """
    least = F.min(F.struct("id", "tag"))
    found = sets.groupBy("set_key").agg(least.alias("least"), F.min_by("sketch", "id").alias("sketch"), F.first("shingles").alias("shingles"))
    found = kept(found.select("set_key", "least.id", "least.tag", "sketch", "shingles"), n)
    several = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    if not several.limit(1).count():
        return found.withColumn("rep", F.col("id")), True
    return kept(found.join(several, "id", "left").withColumn("rep", F.when(F.col("several"), F.xxhash64("id", "set_key")).otherwise(F.col("id"))), n), False


def _by_smallest_id(labels: DataFrame, reps: DataFrame) -> DataFrame:
    """labels (node, component) with the smallest id of each component in place of its smallest rep."""
    named = labels.join(reps.select(F.col("rep").alias("node"), "id"), "node")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    return named.join(smallest, "component").select("node", F.col("smallest").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, recall: float = RECALL, with_tag: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept and, with_tag, tag (a hash of the text).

    Two documents are linked if 100 times the number of shingles they share is at least threshold times
    the number either has. Words are lower-cased (A-Z) runs without ASCII blanks. A text with fewer words
    than a shingle has one shingle, one without words has none and is linked with nothing, as is a row
    with a null id. component_id is the smallest id reachable over links; kept tells the rows that have it.
    Rows that repeat an id count as equal only through their texts; each of them has its own links. An empty table gives
    an empty result; other columns are ignored.
    """
    n_trees = trees(threshold / 100, recall)
    size = n_trees * (1 + BRANCHES * (LEVELS - 1))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).cast("binary").alias("text"))
    rows = materialise(sketch_table(texts, words, size))
    n = rows.count()
    sets = rows.where("set_key is not null and id is not null")
    reps, by_id = _classes(sets, n)
    known = reps.select("rep", "sketch", "shingles")

    small, dense = _leaves(known, n_trees, n)
    grouped = small.groupBy("node").agg(F.array_sort(F.collect_list("rep")).alias("m"))  # SMALL members at most
    pairs = grouped.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b")
    centres = kept(_centres(dense, known), n)
    # The centre of a dense group is the hub of its pairs. A member is in many nodes; the HUBS centres that it meets most often stand for them.
    met = dense.join(centres, "node").where("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("centre")).alias("c"))), asc=False), 1, HUBS).alias("hubs"))
    hub = best.select(F.explode("hubs").alias("h"), F.col("rep").alias("b")).select((-F.col("h.c")).alias("a"), "b")
    small_pairs, hub_pairs = kept(_alike(pairs, known, size), n), kept(_alike(hub, known, size), n)
    ends = [df.select(F.col(c).alias("id")) for df, c in ((small_pairs, "a"), (small_pairs, "b"), (dense, "rep"))]
    ends = ends[0].unionAll(ends[1]).unionAll(ends[2]).distinct().withColumnRenamed("id", "rep")
    sets = kept(_set_table(texts, reps.select("rep", "id", "tag").join(ends, "rep", "left_semi"), words).dropDuplicates(["id"]), n)

    to_hub = kept(_confirm(hub_pairs, sets, threshold, n), n)
    # Small nodes need no second look at two documents of one hub.
    star = to_hub.groupBy("b").agg(F.min("a").alias("hub"))
    with_hubs = small_pairs.join(star.select(F.col("b").alias("a"), F.col("hub").alias("ha")), "a", "left").join(star.select("b", F.col("hub").alias("hb")), "b", "left")
    apart = with_hubs.where(~F.coalesce("ha", "a").eqNullSafe(F.coalesce("hb", "b"))).select("a", "b", "na", "nb")
    links = kept(to_hub.unionAll(_confirm(apart, sets, threshold, n)), n)
    labels = connected_components(links, n)
    more = _rest(dense, centres, labels, sets, threshold, n) if dense.limit(1).count() else None
    if more is not None:
        more = kept(more.distinct(), n)
        if more.limit(1).count():
            labels = connected_components(links.unionAll(more), n)

    labels = labels if by_id else _by_smallest_id(labels, reps)
    classes = reps.select("set_key", "rep", F.col("id").alias("least")).join(labels, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "least").alias("component"))
    out = rows.select("id", "tag", "shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("shingles").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *["tag"] * with_tag)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are named, that stay: those of each component's smallest id.

    Rows with a null id stay. Of rows that repeat an id, each stays or goes by its own text.
    """
    gone_id, gone_tag, own_tag = fresh(docs, "gone", "gone_tag", "own_tag")
    found = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words, threshold=threshold, with_tag=True)
    gone = found.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("tag").alias(gone_tag))
    rows = docs.withColumn(own_tag, F.xxhash64(text_of(text_col)))
    return rows.join(gone, (rows[id_col] == gone[gone_id]) & (rows[own_tag] == gone[gone_tag]), "left_anti").select(*[f"`{c}`" for c in docs.columns])
