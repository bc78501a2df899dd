"""Repair of conversations: which turns to keep, to give another role, to delete, and where an empty turn is missing.

A conversation is right if the first letters of its roles read (s?(ua)+)?. The cheapest edits are found by a dynamic
programme over the retained turns: what lies between two of them is deleted, which prefix sums of deletions price; the
cheapest continuation is a running minimum for each role of the next retained turn; the pair of roles says how many
empty turns go in between. Of equally cheap repairs the one with the least audit (the letters D, I, K, R in order) is taken.

All turns are numbered in order over many tasks and cut into blocks, so that a long conversation is no one's whole work:
a block gives, for each role before it and after it, the cheapest edits inside, and a conversation that spans
blocks is put together from those few numbers. Texts are moved once, when edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import numbered
from .common import giving_back, materialise

BLANKS = " \t\n\x0b\x0c\r"
#: What an edit costs, and a truncated turn that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Turns of one block.
BLOCK = 2048
#: Characters of a text by which turns of one number are ordered, after their roles and before their digests.
HEAD = 32

#: Roles before or of a turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Empty turns between two roles, where one can follow the other at all; and after the last role.
_BETWEEN = {(NONE, SYSTEM): 0} | {(p, USER): int(p == USER) for p in range(4)} | {(p, ASSISTANT): int(p != USER) for p in range(4)}
_AFTER = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Turn = tuple[int, bool, bool]  # role or NONE for any other, whether it must go, whether it is truncated


def cheapest(turns: list[Turn], after: dict[int, int]) -> dict[int, tuple[int, str]]:
    """Cost and audit by the role before the turns; roles from which no repair leads to the end are missing.

    after: the last roles that may stand at the end, with the number of empty turns that then follow.
    """
    n = len(turns)
    nearest: dict[int, tuple[int, int]] = {}  # role: cost with all deletions before it, place
    follow: dict[tuple[int, int], tuple[int, int, str, int]] = {}  # place, role: next place, empty turns, edit, role
    rank: dict[tuple[int, int], int] = {}  # place, role: order among the audits of what follows there
    edits: list[dict[int, str]] = [{} for _ in turns]
    gone = lambda k: DELETE * k  # deletions of the first k turns

    def best(place: int, role: int) -> tuple[int, tuple[int, int, str, int], tuple] | None:
        """Cost of all that follows a turn, the next retained turn, and the audit as far as it takes to compare it."""
        found = []
        if role in after:
            found.append((gone(n) + INSERT * after[role], (-n, after[role], "", 0), (n, after[role], "", NONE)))
        for to, (cost, at) in nearest.items():
            empty = _BETWEEN.get((role, to))
            if empty is not None:
                edit = edits[at][to]
                # A later next turn means another D, and D < I < K < R.
                found.append((cost + INSERT * empty, (-at, -empty, edit, rank[at, to]), (at, empty, edit, to)))
        if not found:
            return None
        cost, order, step = min(found)
        return cost - gone(place + 1), step, order

    for k in range(n - 1, -1, -1):
        own, must_go, truncated = turns[k]
        if must_go:
            continue
        orders = {}
        for role in (SYSTEM, USER, ASSISTANT):
            if role == SYSTEM and own != SYSTEM:
                continue
            found = best(k, role)
            if found is None:
                continue
            cost, follow[k, role], orders[role] = found
            edits[k][role] = "K" if role == own else "R"
            orders[role] = orders[role], cost + (role != own) * REROLE + truncated * TRUNCATED
        ranks = sorted({order for order, _ in orders.values()})
        for role, (order, _) in orders.items():
            rank[k, role] = ranks.index(order)
        for role, (_, cost) in orders.items():
            if role not in nearest or gone(k) + cost < nearest[role][0]:
                nearest[role] = gone(k) + cost, k
    out = {}
    for role in range(4):
        found = best(-1, role)
        if found is None:
            continue
        audit, at, step = [], -1, found[1]
        while True:
            audit.append("D" * (step[0] - at - 1) + "I" * step[1] + step[2])
            if step[0] == n:
                break
            at = step[0]
            step = follow[at, step[3]]
        out[role] = found[0], "".join(audit)
    return out


def damage(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults, as the CRC of conv_id:turn says: of 20 rows one is dropped, one
    emptied, one without its full stops, exclamation and question marks, one repeated, one a user's. Nulls read as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("way")
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), way).where("way <> 0")
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_SEGMENT = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("seg", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns")],
        *[T.StructField(c, T.StringType()) for c in ("first_initial", "last_initial")],
        T.StructField("starts", T.IntegerType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("costs", T.ArrayType(T.LongType())),
        T.StructField("ranks", T.ArrayType(T.LongType())),
        T.StructField("audits", T.ArrayType(T.StringType())),
    ]
)


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _segment(rows: list[tuple], starts: int, closed: bool) -> dict:
    """One conversation's rows (n, turn, whether it has none, initial, fault) in a block, with the cheapest edits for each role
    before and after them; a role before is needed only at the block's start, a role after only at its end."""
    turns = [(_ROLES.get(initial, NONE), fault in (1, 2), fault == 3) for *_, initial, fault in rows]
    ends = [_AFTER] if closed else [{role: 0} for role in range(4)]
    found = [cheapest(turns, end) for end in ends]
    cells = [f.get(p, (-1, "")) for p in range(starts) for f in found]
    order = sorted({audit for cost, audit in cells if cost >= 0})
    numbers = [r[1] for r in rows if not r[2]] or [0]
    initials, faults = [r[3] for r in rows], [r[4] for r in rows]
    return {
        "seg": rows[0][0], "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
        "illegal": sum(map(_illegal, initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1],
        "first_turn": numbers[0], "last_turn": numbers[-1], "turns": len({r[1] for r in rows if not r[2]}), "starts": starts, "closed": closed,
        "costs": [c for c, _ in cells], "ranks": [order.index(audit) if c >= 0 else -1 for c, audit in cells], "audits": [audit for _, audit in cells],
    }


def _span(first: int, last: int, turns: int) -> int:
    return min(last - first + 1 - turns, 2**63 - 1) if turns else 0


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOLDED = "seg long, pick int, tail string, " + ", ".join(f"{c} long" for c in _NUMBERS)


def _fold(rows: list) -> list[dict]:
    """For each segment of one conversation, in order, which of its cells is taken; its first segment bears the conversation's
    numbers, its last one the empty turns at the end."""
    ahead = {role: (INSERT * k, k, -1) for role, k in _AFTER.items()}  # cost, order of the audit, cell taken
    taken: list[dict[int, tuple[int, int, int]]] = []
    for r in reversed(rows):
        ends = [NONE] if r.closed else range(4)
        best = {}
        for p in range(r.starts):
            cells = [(p * len(ends) + k, q) for k, q in enumerate(ends) if r.costs[p * len(ends) + k] >= 0 and (r.closed or q in ahead)]
            options = [(r.costs[c] + (0 if r.closed else ahead[q][0]), (r.ranks[c], 0 if r.closed else ahead[q][1]), c) for c, q in cells]
            if options:
                best[p] = min(options)
        orders = sorted({order for _, order, _ in best.values()})
        ahead = {p: (cost, orders.index(order), c) for p, (cost, order, c) in best.items()}
        taken.append(ahead)
    out, role = [], NONE
    for r, cells in zip(rows, reversed(taken), strict=True):
        cell = cells[role][2]
        role = NONE if r.closed else cell % 4
        out.append({"seg": r.seg, "pick": cell, "tail": ""} | dict.fromkeys(_NUMBERS, 0))
    if not rows[-1].closed:
        out[-1]["tail"] = "I" * _AFTER[role]
    spans = [r for r in rows if r.turns]
    distinct = sum(r.turns for r in spans) - sum(a.last_turn == b.first_turn for a, b in zip(spans, spans[1:]))
    total = {c: sum(getattr(r, c) for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(_illegal(a.last_initial, b.first_initial) for a, b in zip(rows, rows[1:]))
    out[0] |= total | {"gaps": _span(spans[0].first_turn, spans[-1].last_turn, distinct) if spans else 0, "cost": taken[-1][NONE][0]}
    return out


class Repair:
    """The repair of a table of turns: `report()` by conversation, `turns()` as they are afterwards.

    A null role or text reads as one space. Turns are taken by number, nulls first, those of one number by role, the first 32
    characters of their text and a digest. A row's fault is the first of: blank, duplicate (role and text seen earlier),
    truncated (its last character that is no blank is not one of . ! ?). Blank and duplicate turns are deleted. Keeping costs 0,
    another role 2, deletion 3, an empty turn 2, a truncated turn that stays 1. A role that begins with none of s, u, a, and
    an empty one, cannot be kept. A null conv_id is a conversation like others. A table without rows has no conversation.
    Other columns are ignored, whatever their names.
    """

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> None:
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        plain = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
        end = F.rtrim(F.col("text"), F.lit(BLANKS))
        fault = F.when(end == "", 1).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
        tag = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
        self._texts = plain.select("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), tag.alias("tag"), "text", fault.alias("fault"))
        # Rows that repeat each other may be many: their own numbers part them.
        narrow = self._texts.select("conv_id", "turn", "role", "head", "tag", "fault", F.monotonically_increasing_id().alias("copy"))
        order = ["conv_id", "turn", "role", "head", "tag"]
        self._rows = materialise(numbered(narrow, [*order, "copy"], "n").select(*order, F.substring("role", 1, 1).alias("initial"), "fault", "n", F.floor(F.col("n") / BLOCK).alias("block")))
        self._segments = materialise(self._cut())
        self._edits = materialise(self._chosen())

    def _cut(self) -> DataFrame:
        """The segments of all blocks."""
        firsts = self._rows.groupBy("conv_id", "tag").agg(F.min("n").alias("n")).select("n", F.floor(F.col("n") / BLOCK).alias("block"))

        def run(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("n")
            fault = np.where((rows["fault"] != 1) & ~rows["n"].isin(first["n"]), 2, rows["fault"])
            conv = rows["conv"].to_numpy()
            starts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist()]
            cells = list(zip(*[rows[c].tolist() for c in ("n", "turn", "no_turn", "initial")], fault.tolist(), strict=True))
            out = [_segment(cells[a:b], 4 if a == 0 else 1, b < len(cells)) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)]
            return pd.DataFrame(out, columns=_SEGMENT.names)

        # One conversation's rows lie together, so where this changes another one begins.
        conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
        narrow = self._rows.select("block", "n", F.coalesce("turn", F.lit(0)).alias("turn"), F.isnull("turn").alias("no_turn"), "initial", "fault", conv)
        return narrow.groupBy("block").cogroup(firsts.groupBy("block")).applyInPandas(run, _SEGMENT)

    def _chosen(self) -> DataFrame:
        """conv_id, the first row's place, audit of each segment; the conversation's numbers with its first segment."""
        begun = self._rows.select(F.col("n").alias("seg"), "conv_id", "turn", "role", "head", "tag").join(self._segments, "seg")
        inner = begun.where("closed and starts = 1")
        span = [F.col(c).cast("decimal(38)") for c in ("last_turn", "first_turn", "turns")]
        gaps = F.when(span[2] > 0, F.least(span[0] - span[1] + 1 - span[2], F.lit(2**63 - 1))).otherwise(0).cast("long")
        place = ["conv_id", "turn", "role", "head", "tag", "seg"]
        done = inner.select(*place, F.col("audits")[0].alias("audit"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_fold(list(rows.sort_values("seg").itertuples(index=False))), columns=[f.split()[0] for f in _FOLDED.split(", ")])

        # Only the first and the last conversation of a block, and those that span blocks: few numbers for each block.
        parted = begun.where("not (closed and starts = 1)")
        folded = parted.drop("turn", "role", "head", "tag", "audits").groupBy("conv_id").applyInPandas(run, _FOLDED)
        audit = F.concat(F.col("audits")[F.col("pick")], "tail").alias("audit")
        return done.unionByName(parted.drop(*_NUMBERS).join(folded, "seg").select(*place, audit, *_NUMBERS))

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation."""
        numbers = [F.sum(c).alias(c) for c in _NUMBERS]
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "")
        return self._edits.groupBy("conv_id").agg(*numbers, audit.alias("audit"))

    def turns(self) -> DataFrame:
        """conv_id, place (from 0), edit (K, R or I), role and text of each turn that there is afterwards.

        A conversation's rows come in order and in one partition, one after another: neither is all of it held at once.
        """
        key = ["conv_id", "turn", "role", "head", "tag"]
        none = F.lit(None).cast("string")
        edits = self._edits.select(*key, F.lit(0).alias("kind"), "seg", "audit", none.alias("text"))
        texts = self._texts.select(*key, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seg"), none.alias("audit"), "text")
        ordered = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*key, "kind", "seg").select("conv_id", "role", "audit", "text")
        fields = T.StructType([ordered.schema["conv_id"], *[T.StructField(c, t) for c, t in (("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()))]])
        return ordered.mapInArrow(giving_back(_repaired), fields)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with an audit comes before the first row that it is about; each other row takes the next edit of its conversation."""
    current, audits, audit, at, before, place = None, [], "", 0, NONE, 0
    for batch in batches:
        out: list[tuple] = []
        for conv, role, edits, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "audit", "text")], strict=True):
            if current != (conv,):
                current, audits, audit, at, before, place = (conv,), [], "", 0, NONE, 0
            if edits is not None:
                audits.append(edits)
                continue
            if at == len(audit):
                audit, at = audits.pop(0), 0
            own = at
            while audit[own] == "I":
                own += 1
            # Empty turns after this one are at the end of the conversation.
            end = len(audit) if audit[own + 1 :] in ("I", "II") else own + 1
            for edit in audit[at:end]:
                if edit == "D":
                    continue
                before = _ROLES[role[:1]] if edit == "K" else ASSISTANT if before == USER else USER
                out.append((conv, place, edit, role if edit == "K" else _NAMES[before], "" if edit == "I" else text))
                place += 1
            at = end
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["conv_id", "place", "edit", "role", "text"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of role:text of all turns, joined by line ends, of rows that come as Repair.turns() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if digest is None or current != conv:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            kind = batch.schema.field("conv_id").type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    fields = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return turns.select("conv_id", "role", "text").mapInArrow(giving_back(run), fields)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conv_id of the given table with report and digest of its repair after damage(); zeros, an empty audit and the digest of
    nothing where no row is left."""
    repair = Repair(damage(conversations))
    ids = conversations.select("conv_id").distinct()
    other = lambda df: df.withColumnRenamed("conv_id", "own_id")
    out = ids
    for df in (repair.report(), digests(repair.turns())):
        out = out.join(other(df), F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NUMBERS]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
