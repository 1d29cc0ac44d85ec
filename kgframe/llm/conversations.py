"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by checkpointed DP.

Edits are Delete, Insert, Keep and Rerole, and the roles that stay must read ``(s?(ua)+)?``. What is left to pay from a
position depends only on the state that is reached there (nothing yet, after system, user or assistant). Going
backward, the four costs are stored only at about every square root of n-th position; going forward, each stretch is
computed again from its checkpoint and the ASCII-least edits that keep to the least cost are written out.

Rows are range-partitioned by conversation and turn, so one that holds most of the table is spread over tasks. A task
finishes the conversations that lie wholly in its range and aren't long. The others are cut into blocks of positions:
a block is a min-plus matrix over the states, the products of these give the costs at the block's end (checkpoints
again), every block is walked from each of its four states, and one more pass over the blocks tells which of them is
entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgframe.llm.common import slices, table, written

#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits; an undeleted truncated turn costs CUT_OFF more.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Faults of a row; of the first two it must be deleted.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. NEXT: after a turn whose role the repair chooses.
NEXT, ENDS = (2, 2, 3, 2), (0, 3)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
NONE = 1 << 60
#: Edits as they are handed on: inserted user and assistant, Delete, Keep, rerole to user and assistant; and their audit.
AUDIT = str.maketrans({"u": "I", "a": "I", "U": "R", "A": "R"})
CHOSEN = {2: "user", 3: "assistant"}
#: A longer conversation, by rows or bytes, goes through blocks of 2 ** BLOCK positions.
LONG_ROWS, LONG_BYTES, BLOCK = 4096, 8 << 20, 12

Vector = list[int]
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, new_role string, new_text string"


# --- the DP on small lists ---
@lru_cache(maxsize=10_000)
def options(initial: str, fault: int) -> tuple[tuple[tuple[int, int | None, int | None, str], ...], int, int]:
    """What a row allows: by state (state after Keep), and the costs of Keep and Rerole; NONE if it must go."""
    extra = CUT_OFF if fault == TRUNCATED else 0
    gone = fault in (BLANK, DUPLICATE)
    return KEPT.get(initial, (None,) * 4), NONE if gone else extra, NONE if gone else REROLE + extra


def inserted(v: Vector) -> Vector:
    """Costs when turns may be inserted first: at most two are ever of use."""
    for _ in range(2):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def before(row: tuple, v: Vector) -> Vector:
    """The costs ahead of a row from those behind it."""
    kept, keep, rerole = row
    out = []
    for q in range(4):
        best = DELETE + v[q]
        if (to := kept[q]) is not None and keep + v[to] < best:
            best = keep + v[to]
        if rerole + v[NEXT[q]] < best:
            best = rerole + v[NEXT[q]]
        out.append(min(best, NONE))
    return inserted(out)


def last_costs() -> Vector:
    return inserted([0 if q in ENDS else NONE for q in range(4)])


def tail(state: int) -> str:
    """The turns inserted at the very end."""
    out = ""
    while state not in ENDS:
        state = NEXT[state]
        out += CHOSEN[state][0]
    return out


def walk(rows: list[tuple], end: Vector, starts: tuple[int, ...]) -> tuple[Vector, list[list[str]], list[int]]:
    """The costs ahead of the rows, and from each start the least tight edits at each row and the state at the end."""
    n = len(rows)
    step = isqrt(n) + 1
    marks: dict[int, Vector] = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = before(rows[i], v)
        if i % step == 0:
            marks[i] = v
    edits: list[list[str]] = [[] for _ in starts]
    states = list(starts)
    for begin in range(0, n, step):
        stop = min(begin + step, n)
        costs = [marks[stop]]
        for i in range(stop - 1, begin - 1, -1):
            costs.append(before(rows[i], costs[-1]))
        costs.reverse()
        for k, q in enumerate(states):
            for i in range(begin, stop):
                kept, keep, rerole = rows[i]
                here, there, out = costs[i - begin], costs[i - begin + 1], ""
                while True:
                    if here[q] == DELETE + there[q]:
                        out += "D"
                    elif here[q] == INSERT + here[NEXT[q]]:
                        q = NEXT[q]
                        out += CHOSEN[q][0]
                        continue
                    elif (to := kept[q]) is not None and here[q] == keep + there[to]:
                        q = to
                        out += "K"
                    else:
                        q = NEXT[q]
                        out += CHOSEN[q][0].upper()
                    break
                edits[k].append(out)
            states[k] = q
    return v, edits, states


def turns_of(edits: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """Audit letter, role and text of what the edits at one row leave; a deleted turn isn't among them."""
    for e in edits:
        if e in "ua":
            yield "I", "user" if e == "u" else "assistant", ""
        elif e != "D":
            yield e.translate(AUDIT), {"K": role, "U": "user", "A": "assistant"}[e], text


class Digest:
    """The SHA-256 of ``role:text`` lines, fed turn by turn."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, edits: str, role: str, text: str) -> None:
        for _, r, t in turns_of(edits, role, text):
            self.sha.update(f"{chr(10) * self.any}{r}:{t}".encode())
            self.any = True


def illegal(left: str | None, right: str) -> bool:
    return left is not None and left + right not in ("su", "ua", "au")


def summary(rows: list[tuple[int | None, str, str]]) -> tuple[tuple, list[str]]:
    """The result for one whole conversation, whose rows are given in order, and the edits at each row (the last with those behind it)."""
    counts, seen, faults = [0, 0, 0, 0], set(), []
    for _, role, text in rows:
        core = text.strip(BLANKS)
        fault = BLANK if not core else DUPLICATE if (role, text) in seen else TRUNCATED if core[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    initials = [role[:1] for _, role, _ in rows]
    costs, edits, states = walk([options(c, f) for c, f in zip(initials, faults)], last_costs(), (0,))
    edits = edits[0]
    if edits:
        edits[-1] += tail(states[0])
    digest = Digest()
    for (_, role, text), e in zip(rows, edits):
        digest.add(e, role, text)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    wrong = sum(illegal(a, b) for a, b in zip(initials, initials[1:]))
    return (gaps, *counts[1:], wrong, costs[0], "".join(edits).translate(AUDIT), digest.sha.hexdigest()), edits


# --- tables ---
def damage(conversations: DataFrame) -> DataFrame:
    """Planted faults by the checksum of ``conv_id:turn``: conv_id, turn, role, text, dropped.

    Nulls in the checksum's parts, role and text are one space. A dropped row stays as a mark that its conversation is
    there, without text.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def in_order(turns: DataFrame) -> DataFrame:
    """Range partitions by conversation and turn (nulls first; of one turn by role, then by a hash of the text), sorted. Equal rows are told apart by where they are read, so that they too can be spread."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("hash").asc(), F.col("at").asc()]
    return turns.select("conv_id", "turn", "role", "text", "dropped", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at")).repartitionByRange(*keys).sortWithinPartitions(*keys)


def first_pass(turns: DataFrame, long_rows: int, long_bytes: int, as_turns: bool) -> DataFrame:
    """Finish short conversations that lie within a task's range; rows of all others are handed on with their position."""
    kind = turns.schema["conv_id"].dataType
    fields = [T.StructField("conv_id", kind), T.StructField("done", T.BooleanType()), *T.StructType.fromDDL(TURNS if as_turns else SUMMARY).fields]
    out_schema = T.StructType([*fields, *T.StructType.fromDDL("pos long, turn long, role string, text string, dropped boolean").fields])
    blanks = [None] * (len(fields) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pos = to_arrow_schema(out_schema), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size, conv, first, edge = 0, None, True, True  # the first run of a range may have begun in another
        out: list[tuple] = []

        def hand_on() -> None:
            out.extend((conv, False, *blanks, *r) for r in held)
            held.clear()

        def finish() -> None:
            if not held:
                return
            rows = [(r[1], r[2], r[3]) for r in held if not r[4]]
            found, edits = summary(rows)
            if not as_turns:
                out.append((conv, True, *found, None, None, None, None, None))
            places = [r[0] for r in held if not r[4]]
            for place, (_, role, text), e in zip(places, rows, edits) if as_turns else ():
                out.extend((conv, True, place << 2 | k, *t, None, None, None, None, None) for k, t in enumerate(turns_of(e, role, text)))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for b in slices(batches, "text"):
            for c, turn, role, text, dropped in zip(*(col.to_pylist() for col in b.columns)):
                if first or c != conv:
                    (hand_on if edge else finish)()
                    conv, size, edge, first = c, 0, first, False
                held.append((pos, turn, role, text, dropped))
                pos += 1
                size += len(text)
                if len(held) > long_rows or size > long_bytes:
                    hand_on()
                    size, edge = 0, True  # the rest of this conversation is handed on too
            if out:
                yield flush()
        hand_on()  # the last run may go on in another range
        yield flush()

    return turns.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(run, out_schema)


def by_blocks(df: DataFrame, schema: str, begin: Callable, *order: Column, deal: str) -> DataFrame:
    """Stream rows that are dealt by ``deal`` and sorted by ``order``: ``begin()`` makes a function from one row (None at the end) to rows."""
    kind = df.schema["conv_id"].dataType
    full = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, f = to_arrow_schema(full), begin()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, arrow)], schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                out = []
                for r in b.slice(at, 4096).to_pylist():
                    out.extend(f(r))
                yield packed(out)
        yield packed(list(f(None)))

    return df.repartition(deal).sortWithinPartitions(*order).mapInArrow(run, full)


def gathered(finish: Callable[[list[dict]], list[tuple]]) -> Callable[[], Callable]:
    """Collect the rows of one conversation and block, which ``finish`` turns into result rows."""

    def begin() -> Callable:
        held: list[dict] = []

        def step(r: dict | None) -> list[tuple]:
            out = []
            if held and (r is None or (r["conv_id"], r["block"]) != (held[0]["conv_id"], held[0]["block"])):
                out = finish(held)
                held.clear()
            if r is not None:
                held.append(r)
            return out

        return step

    return begin


def matrix_of(rows: list[dict]) -> list[tuple]:
    """A block as its min-plus matrix (by rows), with its first and last initial and its illegal neighbours."""
    allowed = [options(r["initial"], r["fault"]) for r in rows]
    columns = []
    for q in range(4):
        v = [0 if p == q else NONE for p in range(4)]
        for row in reversed(allowed):
            v = before(row, v)
        columns.append(v)
    initials = [r["initial"] for r in rows]
    wrong = sum(illegal(a, b) for a, b in zip(initials, initials[1:]))
    return [(rows[0]["conv_id"], rows[0]["block"], [columns[c][r] for r in range(4) for c in range(4)], initials[0], initials[-1], wrong)]


def end_costs() -> Callable:
    """From the last block of a conversation to its first: the costs behind each block, and those ahead of it from nothing."""
    state: dict = {"conv": ()}

    def step(r: dict | None) -> list[tuple]:
        if r is None:
            return []
        if state["conv"] != (r["conv_id"],):
            state.update(conv=(r["conv_id"],), v=last_costs())
        end, m = state["v"], r["matrix"]
        state["v"] = [min(NONE, min(m[4 * q + p] + end[p] for p in range(4))) for q in range(4)]
        return [(r["conv_id"], r["block"], end, state["v"][0])]

    return step


def walked(rows: list[dict]) -> list[tuple]:
    """The edits at each row of a block from each state it can be entered in; the last row has the states behind them."""
    _, edits, states = walk([options(r["initial"], r["fault"]) for r in rows], rows[0]["end"], (0, 1, 2, 3))
    last = len(rows) - 1
    return [(r["conv_id"], r["block"], r["pos"], [e[i] for e in edits], states if i == last else None) for i, r in enumerate(rows)]


def entered() -> Callable:
    """From the first block of a conversation to its last: the state each is entered in, what is inserted behind the last, and whether neighbours across its beginning are illegal."""
    state: dict = {"row": None}

    def step(r: dict | None) -> list[tuple]:
        last = state["row"]
        new = r is None or last is None or last["conv_id"] != r["conv_id"]
        out = []
        if last is not None:
            out = [(last["conv_id"], last["block"], state["entry"], tail(last["states"][state["entry"]]) if new else "", state["wrong"])]
        if r is not None:
            state.update(row=r, entry=0 if new else last["states"][state["entry"]], wrong=int(not new and illegal(last["last"], r["first"])))
        return out

    return step


def digested() -> Callable:
    """The audit and digest of each conversation, row by row. One conversation's digest is sequential by its nature; only its state and the audit are held."""
    state: dict = {"conv": None}

    def done() -> list[tuple]:
        return [] if state["conv"] is None else [(state["conv"][0], "".join(state["audit"]).translate(AUDIT), state["digest"].sha.hexdigest())]

    def step(r: dict | None) -> list[tuple]:
        out = []
        if r is None or state["conv"] != (r["conv_id"],):
            out = done()
            if r is None:
                return out
            state.update(conv=(r["conv_id"],), audit=[], digest=Digest())
        state["audit"].append(r["edits"])
        state["digest"].add(r["edits"], r["role"], r["text"])
        return out

    return step


def edited(rest: DataFrame, block_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows that need blocks: those with faults, the edits at each, and the blocks with their costs."""
    core = F.rtrim("text", F.lit(BLANKS))
    skeleton = rest.select(
        "conv_id", "pos", "turn", "role", F.substring("role", 1, 1).alias("initial"), F.sha2("text", 256).alias("digest"), (F.length(core) == 0).alias("empty"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    firsts = skeleton.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("empty"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    rows = written(skeleton.join(firsts, "pos", "left").select("conv_id", "pos", "turn", "initial", fault.alias("fault"), F.shiftright("pos", block_bits).alias("block")), "turn-faults")
    blocks = written(by_blocks(rows.drop("turn"), "block long, matrix array<long>, first string, last string, wrong int", gathered(matrix_of), F.col("pos"), deal="block"), "turn-blocks")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    ends = written(by_blocks(blocks, "block long, end array<long>, ahead long", end_costs, F.col("conv_id"), F.desc("block"), deal="conv_id"), "turn-ends")
    with_ends = rows.drop("turn").join(ends, same(rows, ends)).select(rows["conv_id"], rows["block"], "pos", "initial", "fault", "end")
    walks = written(by_blocks(with_ends, "block long, pos long, edits array<string>, states array<int>", gathered(walked), F.col("pos"), deal="block"), "turn-walks")
    closing = walks.where(F.col("states").isNotNull())
    closing = closing.join(blocks, same(closing, blocks)).select(closing["conv_id"], closing["block"], "states", "first", "last")
    entries = written(by_blocks(closing, "block long, entry int, behind string, wrong int", entered, F.col("conv_id"), F.col("block"), deal="conv_id"), "turn-entries")
    edits = F.concat(F.col("edits")[F.col("entry")], F.when(F.col("states").isNotNull(), F.col("behind")).otherwise(""))
    chosen = walks.join(entries, same(walks, entries)).select("pos", edits.alias("edits"))
    costs = ends.groupBy("conv_id").agg(F.min_by("ahead", "block").alias("cost"))
    wrong = blocks.select("conv_id", "wrong").unionByName(entries.select("conv_id", "wrong")).groupBy("conv_id").agg(F.sum("wrong").alias("illegal"))
    return rows, chosen, costs.withColumnRenamed("conv_id", "c").join(wrong, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")


def repair(turns: DataFrame, as_turns: bool = False, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block_bits: int = BLOCK) -> DataFrame:
    """Repair conversations: one row for each with its faults, the least cost, the edits' initials and the digest of what is left; or if
    ``as_turns`` the turns that are left (place, which orders them, edit, new_role, new_text).

    ``turns`` has conv_id, turn, role, text and dropped (such rows only say that the conversation is there). Role and
    text must not be null; a null conv_id is a conversation, null turns come first and leave gaps as they are. Rows of one
    turn are taken by role, then by a hash of the text; equal rows are duplicates of the first. An empty role has no
    initial: keeping it leaves the state, and its neighbours count as illegal. Texts are never cut. No rows give no result.
    """
    passed = written(first_pass(in_order(turns), long_rows, long_bytes, as_turns), "turns")
    finished = passed.where("done").select("conv_id", *(c.split()[0] for c in (TURNS if as_turns else SUMMARY).split(", ")))
    handed = passed.where(~F.col("done"))
    rest = handed.where(~F.col("dropped")).select("conv_id", "pos", "turn", "role", "text")
    rows, chosen, costs = edited(rest, block_bits)
    left = rest.join(chosen, "pos")
    if as_turns:
        kind = turns.schema["conv_id"].dataType
        spread = by_blocks(left, TURNS, lambda: lambda r: [] if r is None else [(r["conv_id"], r["pos"] << 2 | k, *t) for k, t in enumerate(turns_of(r["edits"], r["role"], r["text"]))], F.col("pos"), deal="pos")
        return finished.unionByName(spread.withColumn("conv_id", F.col("conv_id").cast(kind)))
    audits = by_blocks(left.select("conv_id", "pos", "role", "text", "edits"), "audit string, repaired_sha256 string", digested, F.col("conv_id"), F.col("pos"), deal="conv_id")
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated")
    )
    found = handed.select("conv_id").distinct()
    for more in (counts, costs, audits):
        more = more.withColumnRenamed("conv_id", "c")
        found = found.join(more, found["conv_id"].eqNullSafe(more["c"]), "left").drop("c")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    found = found.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})
    return finished.unionByName(found)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    return repair(damage(table(spark, sf_dir, "conversations")))
