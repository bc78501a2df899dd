"""Publishing in order: rows that come in any order leave in the order of their identifiers, without a gap.

The state of a group is the identifier that is due and the rows that wait for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The state store that streams with several states for a group need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Identifiers whose waiting rows lie in one entry of the state, as each look at it is a call out of the worker.
BLOCK = 128


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def published(arrivals: DataFrame, by: list[str], ident: str, first: int = 0) -> DataFrame:
    """The rows of a stream, each as soon as all rows of its group with lower identifiers, from the first one on, have come.

    Of rows with one identifier the first that came counts; in one batch any of them. Rows with a lower identifier than the first or
    none never leave. What waits is kept in the state, so it takes as much as is out of order. The columns stay.
    """
    use_state_store(arrivals.sparkSession)
    schema = arrivals.schema
    return arrivals.where(f"`{ident}` >= {first}").groupBy(*by).transformWithStateInPandas(_processor(by, ident, first, schema), schema, "Append", "none")


def _processor(by: list[str], ident: str, first: int, schema: T.StructType):
    from pyspark.sql.streaming import StatefulProcessor

    others = [f for f in schema.fields if f.name not in (*by, ident)]
    names = [f.name for f in others]

    class Publish(StatefulProcessor):
        def init(self, handle) -> None:
            self.due = handle.getValueState("due", "id long")
            kept = T.StructType([T.StructField("_id", T.LongType()), *others])
            self.waiting = handle.getMapState("waiting", "block long", T.StructType([T.StructField("rows", T.ArrayType(kept))]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            due = self.due.get()[0] if self.due.exists() else first
            blocks: dict[int, dict[int, tuple]] = {}
            before: dict[int, int] = {}
            some = self.waiting.exists()

            def block(i: int) -> dict[int, tuple]:
                """Waiting rows by identifier."""
                b = i // BLOCK
                if b not in blocks:
                    there = some and self.waiting.containsKey((b,))
                    blocks[b] = {r[0]: tuple(r)[1:] for r in self.waiting.getValue((b,))[0]} if there else {}
                    before[b] = len(blocks[b])
                return blocks[b]

            changed = set()
            for frame in rows:
                cells = frame[names].astype(object).where(frame[names].notna(), None)
                own = zip(*[cells[c].tolist() for c in names], strict=True) if names else [()] * len(frame)
                for i, row in zip(frame[ident].tolist(), own, strict=True):
                    if i >= due and i not in block(i):
                        block(i)[i] = row
                        changed.add(i // BLOCK)
            out = []
            while due in block(due):
                out.append((due, block(due).pop(due)))
                changed.add(due // BLOCK)
                due += 1
            for b in changed:
                if blocks[b]:
                    self.waiting.updateValue((b,), ([(i, *row) for i, row in blocks[b].items()],))
                elif before[b]:
                    self.waiting.removeKey((b,))
            self.due.update((due,))
            if out:
                columns = {c: [k] * len(out) for c, k in zip(by, key, strict=True)} | {ident: [i for i, _ in out]}
                columns |= {c: [row[n] for _, row in out] for n, c in enumerate(names)}
                yield pd.DataFrame(columns)[schema.names]

        def close(self) -> None:
            pass

    return Publish()
