"""Sharding by k-d tree partitioning.

Metadata rows are split again and again at the weighted median along the widest dimension until each
leaf is one shard. All nodes of a level are split together: one aggregation gives the extents, a second
a byte histogram along each node's widest dimension, a third orders the ties inside the cut bin by a hash
of the text, then of the identifier. Each aggregation combines on the map side and gives tables with a row per
node or bin, which are joined back, so no node's rows meet in one task and nothing about nodes passes the driver.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Bins of the histogram along a node's widest dimension, and of the tie order inside one bin.
BINS = 1 << 14
#: Tie order: so many bins by the text's hash, each of so many by the identifier's.
TEXT_BINS, ID_BINS = 1 << 10, 1 << 8
#: A cut parts equal texts only if the nearest cut that does not would move it by more than this share of a shard.
TOGETHER = 0.03
#: Tables with a row per open node are broadcast up to this many (some 50 bytes each), joined by a shuffle beyond.
BROADCAST_NODES = 100_000
#: Rows that one task numbers in a row.
SLOT_ROWS = 50_000
#: Levels after which the lineage is cut.
CUT_LEVELS = 2


def default_dimensions(text: Column) -> dict[str, Column]:
    """Log of the size, share of multi-byte characters, and share of line breaks."""
    size = F.octet_length(text)
    return {
        "log_size": F.ln(1.0 + size),
        "wide": (size - F.char_length(text)) / F.greatest(size, F.lit(1)),
        "breaks": F.ln(1.0 + size - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))) / F.ln(2.0 + size),
    }


def _cumulated(rows: DataFrame, node: str, by: str) -> DataFrame:
    """Adds before and upto, running sums of w by node; a node has a bounded number of bins."""
    w = Window.partitionBy(node).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("w").over(w)).withColumn("before", F.col("upto") - F.col("w"))


def _split(rows: DataFrame, dims: list[str], shard_bytes: float, spans: dict[str, float], open_nodes: int) -> DataFrame:
    """Split each node that is to become k > 1 shards once, into one of half of them and one of the rest."""
    near = F.broadcast if open_nodes <= BROADCAST_NODES else lambda df: df
    extents = rows.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("w"), *[F.min(d).alias(f"min_{d}") for d in dims], *[F.max(d).alias(f"max_{d}") for d in dims])
    # The widest dimension, by its share of the whole table's extent; the first of equals.
    width = lambda d: F.col(f"max_{d}") - F.col(f"min_{d}")
    widest = F.array_max(F.array(*[F.struct((width(d) / (spans[d] or 1.0)).alias("share"), F.lit(-i).alias("dim"), F.col(f"min_{d}").alias("low"), width(d).alias("width")) for i, d in enumerate(dims)]))
    half = F.floor(F.col("k") / 2).cast("int")
    cuts = extents.withColumn("widest", widest).select("node", (-F.col("widest.dim")).alias("dim"), "widest.low", "widest.width", (F.col("w") * half / F.col("k")).alias("target"), half.alias("half"))
    cuts = materialise(cuts)
    value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
    at = F.when(F.col("width") > 0, F.least(F.floor((value - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(near(cuts), "node", "left").withColumn("bin", at)

    by_bin = _cumulated(dealt.where("dim is not null").groupBy("node", "bin", "target").agg(F.sum("size").alias("w")), "node", "bin")
    chosen = by_bin.where("upto >= target").groupBy("node").agg(F.min_by(F.struct("bin", "before"), "bin").alias("c"))
    chosen = materialise(chosen.select("node", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("left_of_bin")))
    inside = dealt.join(near(chosen), "node").where("bin = cut_bin")
    by_tie = _cumulated(inside.groupBy("node", "tie", "target", "left_of_bin").agg(F.sum("size").alias("w")), "node", "tie")
    miss = lambda border: F.abs(F.col("left_of_bin") + F.col(border) - F.col("target"))
    borders = by_tie.select("node", "tie", miss("before").alias("miss")).unionAll(by_tie.select("node", F.col("tie") + 1, miss("upto")))
    # A text's rows have ties between two multiples of ID_BINS. What ends inside such a stretch may part a text; its end does not.
    stretch_end = (F.floor(F.col("tie") / ID_BINS) + 1) * ID_BINS
    last = by_tie.groupBy("node", stretch_end.cast("int").alias("tie")).agg(F.max_by("upto", "tie").alias("upto"), F.first("left_of_bin").alias("left_of_bin"), F.first("target").alias("target"))
    first = by_tie.groupBy("node").agg(F.min_by(F.struct("tie", "before", "left_of_bin", "target"), "tie").alias("f")).select("node", (F.floor(F.col("f.tie") / ID_BINS) * ID_BINS).cast("int").alias("tie"), F.abs(F.col("f.left_of_bin") + F.col("f.before") - F.col("f.target")).alias("miss"))
    between = last.select("node", "tie", miss("upto").alias("miss")).unionAll(first).groupBy("node").agg(F.min(F.struct("miss", "tie")).alias("whole"))
    ties = borders.groupBy("node").agg(F.min(F.struct("miss", "tie")).alias("any")).join(between, "node")
    together = F.col("whole.miss") <= F.col("any.miss") + TOGETHER * shard_bytes
    cut = materialise(chosen.join(ties, "node").select("node", "cut_bin", F.when(together, F.col("whole.tie")).otherwise(F.col("any.tie")).alias("cut_tie")))
    right = (F.col("bin") > F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("tie") >= F.col("cut_tie")))
    after = dealt.join(near(cut), "node", "left").withColumn("right", F.when(F.col("cut_bin").isNotNull(), right))
    child = lambda left, right: F.when(F.col("right"), right).when(~F.col("right"), left)
    node, k = child(F.col("node"), F.col("node") + F.col("half")), child(F.col("half"), F.col("k") - F.col("half"))
    return after.withColumns({"node": F.coalesce(node, "node"), "k": F.coalesce(k, "k")}).select(*rows.columns)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dimensions: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes and 8), text_crc32, shard and slot.

    Either the number of shards or the bytes of a shard is given. Shards' bytes differ by about a document and TOGETHER of
    a shard; equal texts stay in one shard unless they are so many that this would move a cut by more than that. Slots
    number a shard's rows from 0. A null text has size 8. Repeated rows are dealt like others; an empty table gives an
    empty result; null dimensions count as 0; other columns are ignored.
    """
    text = text_of(text_col)
    dims = dimensions or default_dimensions(text)
    tie = F.pmod(F.xxhash64(text), F.lit(TEXT_BINS)) * ID_BINS + F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(ID_BINS))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        tie.cast("int").alias("tie"),
        F.lit(0).alias("node"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"d_{n}") for n, c in dims.items()],
    )
    rows, names = materialise(rows), [f"d_{n}" for n in dims]
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in names]).first()
    total = whole["bytes"] or 0
    shards = shards or max(1, round(total / target_bytes))
    rows = rows.withColumn("k", F.lit(shards))
    for level in range((shards - 1).bit_length()):
        rows = _split(rows, names, total / shards, {d: whole[d] or 0.0 for d in names}, 1 << level)
        rows = materialise(rows) if level % CUT_LEVELS == CUT_LEVELS - 1 else rows

    # Numbering in two steps, so that neither a shard's rows nor rows that repeat each other need to meet in one task.
    rows = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.spark_partition_id()), F.lit(max(1, -(-whole["rows"] // (shards * SLOT_ROWS)))))
    rows = materialise(rows.withColumn("_bucket", bucket))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("shard", "_bucket", (F.sum("n").over(first) - F.col("n")).alias("_offset"))
    order = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32")
    numbered = rows.withColumn("_k", F.row_number().over(order) - 1).join(offsets, ["shard", "_bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_k")).cast("long").alias("slot"))
