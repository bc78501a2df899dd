"""Exact deduplication by content sort.

Normalised texts are range-partitioned on sampled splitters, sorted externally inside each
partition so that equals lie next to each other, and compared in full with their neighbour.
The sort key ends with (longest original first, smallest identifier first), so the first row
of a run of equals is the row that stays, and a group of any size spreads over as many
partitions as its rows need. A run that continues over a partition border is joined up
through its digest; there are at most two such runs a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, giving_back, materialise, shuffle_partitions, text_of

#: Characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]"
#: Leading characters of the normalised text that serve as the splitters' key; a digest of the whole text breaks ties.
SPLITTER_CHARS = 24
#: Runs that touch a border are broadcast up to this many (some 150 bytes each), joined by a shuffle beyond.
BROADCAST_RUNS = 100_000

_RUNS = "id long, tag long, keep_id long, keep_tag long, keep_chars long, group_size long, first_of_run boolean, digest string, part int, edge boolean"


class _Run:
    """Rows of one partition that hold the same normalised text; the text itself is kept once."""

    def __init__(self, text: str, chars: int) -> None:
        self.text, self.chars, self.ids, self.tags = text, chars, [], []


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("keep_id", pa.int64()), ("keep_tag", pa.int64()), ("keep_chars", pa.int64()), ("group_size", pa.int64()), ("first_of_run", pa.bool_()), ("digest", pa.string()), ("part", pa.int32()), ("edge", pa.bool_())])
    run: _Run | None = None
    done: list[_Run] = []
    seen_first = False

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal done, seen_first
        columns: list[list] = [[] for _ in schema]
        for k, r in enumerate(done):
            n = len(r.ids)
            edge = not seen_first or (last and k == len(done) - 1)
            seen_first = True
            values = (r.ids, r.tags, [r.ids[0]] * n, [r.tags[0]] * n, [r.chars] * n, [n] * n, [True] + [False] * (n - 1), [hashlib.sha256(r.text.encode()).hexdigest()] * n, [part] * n, [edge] * n)
            for column, v in zip(columns, values, strict=True):
                column.extend(v)
        done = []
        if columns[0]:
            yield from pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches(max_chunksize=10_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids, tags, chars = batch.column("norm"), *[batch.column(c).to_pylist() for c in ("id", "tag", "chars")]
        same = [False, *pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_pylist()]
        start = 0
        if run is not None and norm[0].as_py() == run.text:
            same[0] = True
        for i in range(len(ids) + 1):
            if i == len(ids) or not same[i]:
                if i > start:
                    run.ids.extend(ids[start:i])
                    run.tags.extend(tags[start:i])
                if i < len(ids):
                    if run is not None:
                        done.append(run)
                    run, start = _Run(norm[i].as_py(), chars[i]), i
        yield from flush(False)
    if run is not None:
        done.append(run)
    yield from flush(True)


def _numbered(docs: DataFrame, id_col: str, text_col: str, partitions: int | None) -> DataFrame:
    """id, tag (a hash of the original text), keep_id, keep_tag, group_size, kept and text_sha256 of each row."""
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(text, BLANKS, "").alias("norm"), F.char_length(text).cast("long").alias("chars"), F.xxhash64(text).alias("tag"))
    rows = rows.withColumn("head", F.substring("norm", 1, SPLITTER_CHARS)).withColumn("tie", F.xxhash64("norm"))
    first = [F.col("chars").desc(), F.col("id").asc_nulls_last(), F.col("tag")]
    dealt = rows.repartitionByRange(n, F.col("head"), F.col("tie"), *first)
    runs = materialise(dealt.sortWithinPartitions("head", "tie", "norm", *first).select("id", "tag", "norm", "chars").mapInArrow(giving_back(_runs), _RUNS))

    # At most two runs a partition touch a border, so this table has at most 2 n rows.
    best = F.struct((-F.col("keep_chars")).alias("chars"), F.col("keep_id").isNull().alias("no_id"), F.col("keep_id"), F.col("keep_tag"), F.col("part"))
    borders = runs.where("edge and first_of_run").groupBy("digest").agg(F.count(F.lit(1)).alias("pieces"), F.sum("group_size").alias("total"), F.min(best).alias("best"))
    borders = borders.where("pieces > 1").select("digest", "total", F.col("best.keep_id").alias("best_id"), F.col("best.keep_tag").alias("best_tag"), F.col("best.part").alias("best_part"), F.lit(True).alias("joined"))
    either = lambda joined, own: F.when(F.col("joined"), F.col(joined)).otherwise(F.col(own))
    return runs.join(F.broadcast(borders) if 2 * n <= BROADCAST_RUNS else borders, "digest", "left").select(
        "id",
        "tag",
        either("best_id", "keep_id").alias("keep_id"),
        either("best_tag", "keep_tag").alias("keep_tag"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("first_of_run") & F.coalesce(F.col("best_part") == F.col("part"), F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks (BLANKS). The row with the most code
    points in the original text stays, then the smallest id, nulls last, then the smallest hash of the original
    text. A null text counts as empty. Of repeated rows with one id exactly one is kept. An empty table gives an
    empty result; other columns of the input are ignored.
    """
    return _numbered(docs, id_col, text_col, partitions).select("id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are named.

    One row of each group stays, chosen as in exact_groups whatever the order of the input; only among rows that
    repeat both id and original text is it any one. A null id is a value like others; an empty table stays empty.
    """
    kept_id, kept_tag, own_tag = fresh(docs, "kept", "kept_tag", "own_tag")
    kept = _numbered(docs, id_col, text_col, None).where("kept").select(F.col("id").alias(kept_id), F.col("tag").alias(kept_tag))
    rows = docs.withColumn(own_tag, F.xxhash64(text_of(text_col)))
    found = rows.join(kept, rows[id_col].eqNullSafe(F.col(kept_id)) & (rows[own_tag] == kept[kept_tag]), "left_semi")
    return found.dropDuplicates([id_col, own_tag]).select(*[f"`{c}`" for c in docs.columns])
