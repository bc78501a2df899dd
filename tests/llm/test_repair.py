import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chromaframe.llm import queries, repair

FIELDS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def every(turns, after=None):
    """The cheapest (cost, audit, roles) by trying all edits and up to two empty turns at every place."""
    found = []
    for edits in itertools.product("DKuaR", repeat=len(turns)):
        if "R" in edits:
            continue
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(turns) + 1):
            cost, audit, roles = 0, "", ""
            for k, (own, must_go, truncated) in enumerate(turns):
                roles += gaps[k]
                audit += "I" * len(gaps[k])
                cost += 2 * len(gaps[k])
                e = edits[k]
                if (must_go and e != "D") or (e == "K" and own not in "sua"):
                    break
                cost += {"D": 3, "K": truncated, "u": 2 + truncated, "a": 2 + truncated}[e]
                audit += e if e in "DK" else "R"
                roles += "" if e == "D" else own if e == "K" else e
            else:
                audit += "I" * len(gaps[-1])
                cost += 2 * len(gaps[-1])
                if re.fullmatch("(s?(ua)+)?", roles + gaps[-1]):
                    found.append((cost, audit, roles + gaps[-1]))
    return min(found)


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_is_the_least_of_all(seed):
    random.seed(seed)
    for n in (0, 1, 2, 2, 2, 3, 3):
        for _ in range(12 if n < 3 else 3):
            turns = [(random.choice("suat"), random.random() < 0.2, random.random() < 0.3) for _ in range(n)]
            own = [(repair._ROLES.get(r, repair.NONE), m, t) for r, m, t in turns]
            assert repair.cheapest(own, repair._AFTER)[repair.NONE] == every(turns)[:2], turns


def plain(turns):
    """(cost, audit, roles kept) by a table over turns and last roles, with whole audits."""
    best = {"": (0, "", ()), "s": (4, "II", ("u", "a")), "u": (2, "I", ("a",)), "a": (0, "", ())}
    for own, must_go, truncated in reversed(turns):
        new = {}
        for p in best:
            options = [(best[p][0] + 3, "D" + best[p][1], (None,) + best[p][2])]
            for edit, role in () if must_go else (("K", own), ("R", "u"), ("R", "a")):
                if role not in "sua" or not role or (role == "s" and p):
                    continue
                empty = {"s": "", "u": "a" if p == "u" else "", "a": "" if p == "u" else "u"}[role]
                cost, audit, kept = best[role]
                options.append((cost + 2 * len(empty) + 2 * (edit == "R") + truncated, "I" * len(empty) + edit + audit, tuple(empty) + ((edit, role),) + kept))
            new[p] = min(options, key=lambda o: o[:2])
        best = new
    return best[""]


def brute(rows):
    """What the query returns, by conversation, from (conv_id, turn, role, text) rows."""
    by_conv = {}
    for conv, turn, role, text in rows:
        own = by_conv.setdefault(conv, [])
        shown = lambda v: " " if v is None else str(v)
        way = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            own += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        tie = lambda r: (r[1], r[2][:32], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, *tie(r)))
        seen, counts, turns = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            end = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, kept = plain(turns)
        rows_left, lines = iter(own), []
        for k in kept:
            if isinstance(k, str):
                lines.append({"u": "user:", "a": "assistant:"}[k])
            else:
                _, role, text = next(rows_left)
                if k:
                    lines.append(f"{role if k[0] == 'K' else {'u': 'user', 'a': 'assistant'}[k[1]]}:{text}")
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_conversation_repair(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("block", [1, 3, 7, 2048])
def test_blocks_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    random.seed(block)
    words = ["Yes.", "No", "", " \t", "What?", "a b", None]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "ux"]
    rows = [(conv, random.choice([None, *range(12)]) if conv % 3 else k, random.choice(roles), random.choice(words) or random.choice([None, f"T{k}.", f"T{k}"])) for conv in range(12) for k in range(random.choice([1, 2, 9, 40]))]
    rows += [(None, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(9)]
    rows += [rows[3]] * 5 + [(99, k // 2, random.choice(roles[:5]), random.choice(["Hm.", f"{k}!", f"{k}", ""])) for k in range(300)]
    df = spark.createDataFrame(rows, FIELDS).repartition(5).select("*", F.lit("x").alias("tag"), F.lit(1).alias("AUDIT"), F.lit(2).alias("n"), F.lit(3).alias("place"))
    assert result(repair.repair_damaged(df)) == brute(rows)


def test_turns_and_report(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Still there?"), (1, 5, "assistant", "Yes"), (2, 0, "assistant", "Hello."), (3, None, "user", " ")]
    fixed = repair.Repair(spark.createDataFrame(rows, FIELDS))
    assert result(fixed.report()) == {1: (2, 0, 0, 1, 1, 3, "KKIKK"), 2: (0, 0, 0, 0, 0, 2, "IK"), 3: (0, 1, 0, 0, 0, 3, "D")}
    got = sorted(tuple(r) for r in fixed.turns().collect())
    by_conv = {c: [r[1:] for r in got if r[0] == c] for c in (1, 2, 3)}
    assert by_conv[1][2] == (2, "I", "assistant", "")
    assert by_conv[2] == [(0, "I", "user", ""), (1, "K", "assistant", "Hello.")] and by_conv[3] == []
    assert [r[0] for r in by_conv[1]] == list(range(len(by_conv[1])))
    for c in (1, 2, 3):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[2][0] for r in by_conv[c]))


def test_empty_and_wholly_dropped(spark):
    none = spark.createDataFrame([], FIELDS)
    assert repair.repair_damaged(none).collect() == [] and repair.Repair(none).turns().collect() == []
    turn = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    gone = repair.repair_damaged(spark.createDataFrame([(5, turn, "user", "Hi.")], FIELDS)).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_long_turns_and_far_numbers(spark):
    long = "word " * 200_000
    rows = [(1, -(2**63), "user", long), (1, 2**63 - 1, "assistant", long + "."), (2**62, 2**53 + 1, "user", "a."), (2**62, 2**53 + 3, "assistant", "b.")]
    got = {r.conv_id: (r.gaps, r.cost, r.audit) for r in repair.Repair(spark.createDataFrame(rows, FIELDS)).report().collect()}
    assert got == {1: (2**63 - 1, 1, "KK"), 2**62: (1, 0, "KK")}
