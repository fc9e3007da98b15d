"""Conversation repair against brute force over all edits, its SQL, and long conversations against short ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import check, duck
from proofline.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """Best (cost, audit) by trying every sequence of edits, with the rows it leaves."""
    found = faults(rows)
    best = None

    def go(i, roles, kept, cost, audit):
        nonlocal best
        if best is not None and cost > best[0] or len(roles) > 2 * len(rows) + 2:
            return
        if roles and not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
        else:
            _, role, text = rows[i]
            go(i + 1, roles, kept, cost + 4, audit + "D")
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                if role:
                    go(i + 1, roles + role[0], kept + [(role, text)], cost + more, audit + "K")
                for name in ("user", "assistant"):
                    go(i + 1, roles + name[0], kept + [(name, text)], cost + more + 3, audit + "R")
        for name in ("user", "assistant"):
            go(i, roles + name[0], kept + [(name, "")], cost + 3, audit + "I")

    go(0, "", [], 0, "")
    return best


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def wanted(table, copies=lambda r: 1):
    convs = {}
    for r in table:
        rows = convs.setdefault(r[0], [])
        rows += [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])] * copies(r)
    out = {}
    for conv, rows in convs.items():
        rows = order(rows)
        cost, audit, kept = plain(rows)
        kinds, initials = faults(rows), [r[1][:1] for r in rows]
        turns = {r[0] for r in rows if r[0] is not None}
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha)
    return out


def got(table, copies=None, **options):
    return {r[0]: tuple(r)[1:] for r in repair.digested(repair.repair(table, copies, **options)).collect()}


def sample(n, seed, longest=5):
    rng, table = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "", " \t\n", None, "Ende.  ", "A.\n"])
            table.append((conv if rng.random() > 0.02 else None, rng.choice([turn, turn, turn + 1, None]), role, text))
    return table


def test_matches_all_edit_sequences(spark):
    table = [r for r in sample(60, 1, 4) if r[0] is not None]
    assert got(spark.createDataFrame(table, SCHEMA)) == wanted(table)


@pytest.mark.parametrize("fan", [2, 64])
def test_long_conversations_give_the_same(spark, monkeypatch, fan):
    """The split path, with every conversation in it and pieces over several tasks."""
    table = sample(40, 2, 9) + [(99, t, r, f"{x}.") for t in range(40) for r, x in (("user", t % 11), ("assistant", t % 7))]
    monkeypatch.setattr(repair, "FAN", fan)
    frame = spark.createDataFrame(table, SCHEMA)
    rows, copies = repair.damaged(frame)
    assert got(rows, copies, large_rows=2) == got(rows, copies)
    assert got(frame, large_rows=0) == got(frame)
    assert got(frame.repartition(7), F.lit(3), large_rows=9) == got(frame, F.lit(3))


def test_pieces_of_pieces():
    rng = random.Random(3)
    rows = [repair.row_piece(rng.choice(["s", "u", "a", ""]), rng.randrange(4)) for _ in range(150)]
    want = repair.lightest(rows)
    fold = repair.Fold()
    for r in rows:
        fold.add(r)
    assert repair.lightest(fold.pieces()) == want
    assert repair.lightest([repair.times(rows[0], 37), rows[1]]) == repair.lightest([rows[0]] * 37 + [rows[1]])


def test_damage(spark):
    table = [(c, t, "assistant", "A. b! c?") for c in range(9) for t in range(9)] + [(None, None, None, None)]
    rows, copies = repair.damaged(spark.createDataFrame(table, SCHEMA))
    for r in rows.select("*", copies.alias("n")).collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fault = zlib.crc32(key.encode()) % 20
        old = ("assistant", "A. b! c?") if r.conv_id is not None else (" ", " ")
        text = "" if fault == 1 else re.sub("[.!?]", "", old[1]) if fault == 2 else old[1]
        assert (r.n, r.role, r.text) == ({0: 0, 3: 2}.get(fault, 1), "user" if fault == 4 else old[0], text)


def test_odd_rows(spark):
    one = spark.createDataFrame([(1, 0, "user", "x."), (2, None, None, None)], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(one, F.lit(0)) == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 0, 0, 0, 0, 0, "", empty)}
    assert got(one)[1][:7] == (0, 0, 0, 0, 0, 3, "KI") and got(one)[2][:7] == (0, 1, 0, 0, 0, 4, "D")
    assert got(one.filter("false")) == {}
    huge = spark.createDataFrame([(1, 0, "user", "w " * 3_000_000 + "?"), (1, 1, "assistant", "y."), (2, 0, "user", "a."), (2, 1, "assistant", "b.")], SCHEMA)
    assert got(huge, large_bytes=1 << 20)[1] == got(huge)[1] and got(huge)[2][5:7] == (0, "KK")
    clash = one.withColumns({c: F.lit("x") for c in ("copies", "report", "fault", "first", "c", "position")})
    assert got(clash, large_rows=0) == got(one)
    turns = repair.repair(one).filter("report IS NULL").orderBy("position").select("position", "edit", "role", "text").collect()
    assert [tuple(t) for t in turns] == [(1, "K", "user", "x."), (2, "I", "assistant", "")]


def test_query_and_its_sql(spark, sf):
    ok, note = check(spark, duck(sf), "op12_lightest_repair", sf)
    assert ok, note
