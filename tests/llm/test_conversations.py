"""Conversation repair against a brute-force search over edits, on short and on blocked conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kgframe.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def damaged(rows):
    """By conversation the rows after damage, in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired text) by plain recursion over positions and what has been written, the least of all."""
    kinds = faults(rows)
    best = {}

    def search(i, shape, inserts):
        """shape: the last two initials are enough to go on."""
        key = i, shape, inserts
        if key in best:
            return best[key]
        found = []
        if i == len(rows) and GOOD.fullmatch(shape):
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (new := grow(shape, role[0])) is not None and (rest := search(i, new, inserts + 1)):
                    found.append((3 + rest[0], "I" + rest[1], ((role, ""), *rest[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if rest := search(i + 1, shape, 0):
                found.append((4 + rest[0], "D" + rest[1], rest[2]))
            if kinds[i] not in (1, 2):
                extra = 3 * (kinds[i] == 3)
                for cost, letter, r in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if (new := grow(shape, r[:1])) is not None and (rest := search(i + 1, new, 0)):
                        found.append((cost + extra + rest[0], letter + rest[1], ((r, text), *rest[2])))
        best[key] = min(found) if found else None
        return best[key]

    shapes, new = set(), {""}
    while new:
        shapes |= new
        new = {g for x in new for c in ("s", "u", "a", "") if (g := grow(x, c)) is not None} - shapes
    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for shape in shapes:
            search(i, shape, 0)
    return search(0, "", 0)


def grow(shape, initial):
    new = shape + initial
    if not any(GOOD.fullmatch(new + end) for end in ("", "a", "ua")):
        return None
    return new if len(new) < 6 else new[:-2]


def expected(rows):
    kinds, initials = faults(rows), [r[1][:1] for r in rows]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, left = cheapest(rows)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)),
    )


def same(got, given):
    want = {c: expected(rows) for c, rows in damaged(given).items()}
    got = {r[0]: tuple(r[1:]) for r in got}
    assert got.keys() == want.keys()
    assert [c for c in want if got[c] != want[c]] == []


def test_walk_in_blocks():
    """Every path through blocks of any size gives what the plain recursion gives."""
    draw = random.Random(4)
    for _ in range(300):
        rows = [(k, draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["Yes.", "No", "", "Hm?", f"t{k}."])) for k in range(draw.randint(0, 9))]
        assert C.summary(rows)[0] == expected(rows)


@pytest.mark.parametrize("limits", [{}, {"long_rows": 2, "block_bits": 1}, {"long_bytes": 400, "block_bits": 3}])
def test_whole_table(spark, sf_dir, limits):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C.op12_conversations(spark, sf_dir) if not limits else C.repair(C.damage(spark.createDataFrame(given, SCHEMA)), **limits)
    same(got.collect(), given)


def test_one_conversation_of_most_rows(spark):
    """Long conversations, one of which repeats a single row, among short ones."""
    draw = random.Random(9)
    given = [(7, k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"{k}.", "so", "Well!", " "])) for k in range(700)]
    given += [(8, 3, "user", "Again.")] * 300 + [(c, k, draw.choice(["user", "assistant"]), f"{k}!") for c in range(20, 60) for k in range(4)]
    for limits in ({"block_bits": 4, "long_rows": 30}, {"block_bits": 2}):
        same(C.repair(C.damage(spark.createDataFrame(given, SCHEMA).repartition(6)), **limits).collect(), given)


def test_hard_rows(spark):
    """Nulls in every column, empty texts, equal rows, conversations that damage leaves empty, clashing names, no rows."""
    gone = next(c for c in itertools.count(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    given = [(None, None, None, None), (None, 1, "user", "A."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, None, "x."), (1, 2, "assistant", None), (gone, 1, "user", "A."), (2, 10**15, "", "Long " * 50_000), (2, -5, "system", "S.")]
    df = spark.createDataFrame(given, SCHEMA).withColumns({"pos": F.lit("x"), "edits": F.lit(1), "copy": F.lit(2)})
    for limits in ({}, {"long_rows": 1, "block_bits": 1}):
        got = C.repair(C.damage(df), **limits).collect()
        same(got, given)
        assert [tuple(r)[1:] for r in got if r.conv_id == gone] == [(0, 0, 0, 0, 0, 0, "", sha(""))]
        assert C.repair(C.damage(df.where(F.lit(False))), **limits).collect() == []


@pytest.mark.parametrize("limits", [{}, {"long_rows": 2, "block_bits": 1}])
def test_turns_that_are_left(spark, sf_dir, limits):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = {r.conv_id: r for r in C.repair(C.damage(df), **limits).collect()}
    turns = {}
    for r in sorted(C.repair(C.damage(df), as_turns=True, **limits).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for c, r in whole.items():
        left = turns.get(c, [])
        assert sha("\n".join(f"{t.new_role}:{t.new_text}" for t in left)) == r.repaired_sha256
        assert "".join(t.edit for t in left) == r.audit.replace("D", "")
