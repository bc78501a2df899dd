"""When statistics of updated images are computed again, in batch and as a stream.

An update makes its image's statistics stale. Those of an image that is not shown are renewed at once. A shown image waits, with
all updates that come meanwhile, until its statistics have stood for a while, so that a burst of updates costs one
computation in each such while, and the last update is never left out.

Of one image, an update at t that comes no later than the computation planned last is part of it; any other plans one
at t, or a while after the last one, whichever is later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise

#: How long statistics stand, in seconds. Fixed value.
WHILE = 0.2

_DONE, _UPDATE, _PLANNED = range(3)


class _Fold:
    """The computation planned last: when, how many updates it has, and the time of the last of them."""

    def __init__(self, least: int) -> None:
        self.least, self.planned = least, None

    def plan(self, at: int, updates: int, last: int) -> tuple | None:
        """A computation known from elsewhere; gives the one before it."""
        done, self.planned = self.planned, (at, updates, last)
        return done

    def update(self, t: int, shown: bool) -> tuple | None:
        """One update; gives the computation that it comes after, if that is complete now."""
        if self.planned is not None and t <= self.planned[0]:
            at, n, last = self.planned
            self.planned = at, n + 1, max(last, t)
            return None
        wait = t if self.planned is None or not shown else max(t, self.planned[0] + self.least)
        return self.plan(wait, 1, t)


def _local(least: int, keys: int):
    """Of sorted rows (key ..., shown, t): computations, and what depends on the partition before or after.

    An update two whiles after the one before it is computed at once whatever was planned, so only those of a partition's
    first key up to there are left as they are; the last computation of a partition may get more updates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, known, fold = None, None, False, _Fold(least)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for row in zip(*columns, strict=True):
                own, shown, t = row[:keys], row[keys], row[keys + 1]
                if key != (own,):
                    if fold.planned is not None:
                        out.append((*key[0], True, _DONE, *fold.planned))
                    known, key, fold = key is not None, (own,), _Fold(least)
                elif not known and (t - before >= 2 * least or not shown):
                    known = True
                before = t
                if not known:
                    out.append((*own, shown, _UPDATE, t, 1, t))
                    continue
                done = fold.update(t, shown)
                if done is not None:
                    out.append((*own, shown, _DONE, *done))
            yield _batch(out, batch.schema, keys)
        if key is not None and fold.planned is not None:
            yield _batch([(*key[0], True, _PLANNED, *fold.planned)], batch.schema, keys)

    return run


def _batch(rows: list[tuple], schema: pa.Schema, keys: int) -> pa.RecordBatch:
    fields = [*list(schema)[:keys], pa.field("_shown", pa.bool_()), *[pa.field(c, pa.int64()) for c in ("_kind", "_at", "updates", "_last")]]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], names=[f.name for f in fields])


def _joined(least: int, keys: int):
    """Of updates and planned computations of several partitions, sorted by key and time: computations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, _Fold(least)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, shown, kind, at, n, last = row[:keys], *row[keys:]
                if key != (own,):
                    if fold.planned is not None:
                        out.append((*key[0], True, _DONE, *fold.planned))
                    key, fold = (own,), _Fold(least)
                done = fold.plan(at, n, last) if kind == _PLANNED else fold.update(at, shown)
                if done is not None:
                    out.append((*own, shown, _DONE, *done))
            yield _batch(out, batch.schema, keys)
        if key is not None and fold.planned is not None:
            yield _batch([(*key[0], True, _DONE, *fold.planned)], batch.schema, keys)

    return run


def recomputed(updates: DataFrame, by: list[str], at: str, shown: str | None = None, least: float = WHILE) -> DataFrame:
    """by, recomputed_at, updates (how many) and last_update of each computation.

    shown names a boolean column that is one for all rows of an image; without it, or where it is null, images are shown. Rows
    without a time are no updates. Updates are dealt by image and time, so those of one image are worked through in many
    tasks, but for stretches without a pause of two whiles, which are a chain.
    """
    micros = round(least * 1e6)
    flag = F.coalesce(F.col(shown), F.lit(True)) if shown else F.lit(True)
    rows = updates.where(F.col(at).isNotNull()).select(*by, flag.alias("_shown"), F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    keys = len(by)
    fields = T.StructType([*rows.select(*by).schema.fields, T.StructField("_shown", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("_kind", "_at", "updates", "_last")]])
    local = materialise(rows.repartitionByRange(*by, "_t").sortWithinPartitions(*by, "_t").mapInArrow(_local(micros, keys), fields))
    open_ends = local.where(F.col("_kind") != _DONE).repartition(*by).sortWithinPartitions(*by, "_last")
    done = local.where(F.col("_kind") == _DONE).unionByName(open_ends.mapInArrow(_joined(micros, keys), fields))
    return done.select(*by, F.timestamp_micros("_at").alias("recomputed_at"), "updates", F.timestamp_micros("_last").alias("last_update"))


def recomputed_stream(updates: DataFrame, by: list[str], at: str, shown: str | None = None, least: float = WHILE, delay: str = "0 seconds") -> DataFrame:
    """The rows of recomputed() for a stream of updates, each once its image's computation is due.

    An image's state is the computation planned last, three numbers. A timer is set for it; it fires when the watermark, which follows the
    updates' times with the given delay, has passed, whether or not the image is updated again. Updates later than that are dropped. Needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    micros = round(least * 1e6)
    flag = F.coalesce(F.col(shown), F.lit(True)) if shown else F.lit(True)
    rows = updates.select(*by, flag.alias("shown__"), F.col(at).cast("timestamp").alias("time__")).withWatermark("time__", delay)
    fields = T.StructType([*rows.select(*by).schema.fields, T.StructField("recomputed_at", T.TimestampType()), T.StructField("updates", T.LongType()), T.StructField("last_update", T.TimestampType())])
    return rows.groupBy(*by).transformWithStateInPandas(_processor(by, micros), fields, "Append", "eventTime")


def _processor(by: list[str], least: int):
    from pyspark.sql.streaming import StatefulProcessor

    stamp = lambda micros: pd.Timestamp(micros, unit="us")

    class Recompute(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("planned", "at long, updates long, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            fold = _Fold(least)
            if self.state.exists():
                fold.planned = tuple(self.state.get())
                self.handle.deleteTimer(_due(fold.planned[0]))
            own = pd.concat(list(rows)).sort_values("time__", kind="stable")
            times = own["time__"].astype("datetime64[us]").astype("int64").tolist()
            done = [fold.update(t, s) for t, s in zip(times, own["shown__"].tolist(), strict=True)]
            self.state.update(fold.planned)
            self.handle.registerTimer(_due(fold.planned[0]))
            yield from self._rows(key, [d for d in done if d is not None and d[1]])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            planned = tuple(self.state.get())
            # What was computed still holds off the next computation, but is not told again.
            if planned[1]:
                self.state.update((planned[0], 0, planned[2]))
                yield from self._rows(key, [planned])

        def _rows(self, key, done: list[tuple]) -> Iterator[pd.DataFrame]:
            if done:
                columns = {c: [k] * len(done) for c, k in zip(by, key, strict=True)}
                yield pd.DataFrame(columns | {"recomputed_at": [stamp(d[0]) for d in done], "updates": [d[1] for d in done], "last_update": [stamp(d[2]) for d in done]})

        def close(self) -> None:
            pass

    return Recompute()


def _due(at: int) -> int:
    """Milliseconds of a timer that fires no sooner than the time in microseconds."""
    return -(-at // 1000)
