"""Repair of conversations by the cheapest edits: a dynamic program over turns whose layers keep ranks and parents, not strings.

An audit is a string of ``D`` (delete), ``I`` (insert), ``K`` (keep) and ``R`` (rerole). Cut after each turn it is a string of
macro edits, a run of inserts and what is done to the turn. No macro edit is the beginning of another one, so audits of the
same turns compare like the sequences of their macro edits: of two audits that have come to a turn, the order stays whatever
follows. A layer therefore keeps, for each state, the least cost, the rank of its audit among the states' and the parent state;
audits are read back from the parents at the end.

Ranks also make turns divisible. A block of turns gives, for each state it may start in, cost and rank of the best way to each
state it may end in; audits that enter a block in different states differ before it, so only ranks are needed to join blocks.
Blocks are solved where they lie after a range sort, joined by conversation (a row a block), and read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import written

#: Fixed values of the task: costs, white space, closing marks, the edits in the order of their letters.
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
SPACE, CLOSING = r"\x20\x09-\x0D", ".!?"
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. Nothing and the last may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Classes of a role by its initial; faults of a row.
CLASSES = {"s": 0, "u": 1, "a": 2}
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Turns of one block.
BLOCK = 1024
#: Turns solved at a time.
FLUSH = 1 << 16
FAR = 1 << 40
#: Macro edits in the order of their letters. Two inserts lead back to the same expectation, so longer runs are never cheaper.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")


def inserted(state: int) -> int:
    """The state after the turn that is expected in ``state``: it is the user's but after a user."""
    return ASSISTANT if state == USER else USER


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Least cost, and of its macro edits the first, for (fault, class, from, to)."""
    cost, code = np.full((4, 4, 4, 4), FAR, np.int64), np.zeros((4, 4, 4, 4), np.int64)
    for fault in range(4):
        for kind in range(4):
            for start in range(4):
                for k, letters in enumerate(CODES):
                    state = start
                    for _ in letters[:-1]:
                        state = inserted(state)
                    spent = INSERT * (len(letters) - 1)
                    fits = (kind == 0 and state == NOTHING) or (kind == 1 and state != USER) or (kind == 2 and state == USER)
                    if letters[-1] == "D":
                        spent += DELETE
                    elif fault in (BLANK, DUPLICATE) or letters[-1] == "K" and not fits:
                        continue
                    else:
                        spent += TRUNCATED * (fault == CUT) + REROLE * (letters[-1] == "R")
                        state = SYSTEM if letters[-1] == "K" and kind == 0 else inserted(state)
                    if spent < cost[fault, kind, start, state]:
                        cost[fault, kind, start, state], code[fault, kind, start, state] = spent, k
    return cost.reshape(16, 4, 4), code.reshape(16, 4, 4)


COST, CODE = _tables()


def solve(runs: list[np.ndarray], starts: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Least costs and ranks ``(runs, 4)`` by the state reached, and each run's macro edits ``(turns, 4)``; a turn is 4 x fault + class.

    All runs advance together, a layer at a time; the long ones go on alone.
    """
    order = sorted(range(len(runs)), key=lambda r: -len(runs[r]))
    lengths = np.array([len(runs[r]) for r in order])
    flat = np.concatenate([runs[r] for r in order])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    cost, rank = np.full((len(runs), 4), FAR, np.int64), np.full((len(runs), 4), 3, np.int64)
    first = np.array([starts[r] for r in order])
    cost[np.arange(len(runs)), first], rank[np.arange(len(runs)), first] = 0, 0
    parents = np.zeros((len(flat), 4), np.int64)
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]
    for t, n in enumerate(active):
        turn = flat[at[:n] + t]
        whole = np.minimum(cost[:n, :, None] + COST[turn], FAR)
        parent = (whole * 4 + rank[:n, :, None]).argmin(1)
        parents[at[:n] + t] = parent
        cost[:n] = np.take_along_axis(whole, parent[:, None], 1)[:, 0]
        sequence = np.take_along_axis(rank[:n], parent, 1) * len(CODES) + np.take_along_axis(CODE[turn], parent[:, None], 1)[:, 0]
        sequence[cost[:n] >= FAR] = 1 << 20
        rank[:n] = sequence.argsort(1, kind="stable").argsort(1, kind="stable")
    edits, state = np.zeros((len(flat), 4), np.int8), np.tile(np.arange(4), (len(runs), 1))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        parent = np.take_along_axis(parents[at[:n] + t], state[:n], 1)
        edits[at[:n] + t] = CODE[flat[at[:n] + t][:, None], parent, state[:n]]
        state[:n] = parent
    back = np.argsort(order)
    return cost[back], rank[back], [edits[at[k] : at[k] + lengths[k]] for k in back]


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)`` after the damage that a hash of conversation and turn deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), deal.alias("deal")).where("deal != 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("deal") == 3, 2).otherwise(1).cast("long").alias("copies"))


KEY = ["conv_id", "turn", "role", "h"]


def keyed(rows: DataFrame) -> DataFrame:
    """With ``h``, the SHA-256 that stands for the text."""
    return rows.withColumn("h", F.unhex(F.sha2("text", 256)))


def turns(rows: DataFrame) -> DataFrame:
    """One light row for equal rows: ``(conv_id, turn, role, h, copies, fault, first)``, ``first`` where role and text were not seen earlier."""
    blank = ~F.col("text").rlike(rf"[^{SPACE}]")
    closed = F.col("text").rlike(rf"[{CLOSING}][{SPACE}]*\z")
    fault: Column = F.when(blank, BLANK).when(~closed, CUT).otherwise(NONE)
    light = keyed(rows).select(*KEY, "copies", fault.alias("fault"))
    # Where role and text are first: the row whose turn is least (null before all), found by a minimum and met again as a further row of its key.
    first = light.groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    both = light.withColumn("first", F.lit(False)).unionByName(first.select("conv_id", F.col("least.turn").alias("turn"), "role", "h", F.lit(0).cast("long").alias("copies"), F.lit(0).alias("fault"), F.lit(True).alias("first")))
    return both.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.max("fault").alias("fault"), F.max("first").alias("first"))


_MOVE = "struct<i:int,o:int,cost:long,rank:int,audit:string>"
_BLOCKS = f"seq long, blank long, duplicate long, truncated long, illegal long, turns long, head int, tail int, low long, high long, moves array<{_MOVE}>"


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _blocks(schema: pa.Schema):
    """Range-sorted turns to one row for each block of a conversation: the key of its first turn, its sums and its moves."""

    def flush(held: list[dict]) -> pa.RecordBatch:
        runs, starts, whose = [], [], []
        for k, b in enumerate(held):
            turn = np.array(b.pop("run"), np.int64)
            for start in range(4) if b.pop("inner") else (NOTHING,):
                runs.append(turn), starts.append(start), whose.append(k)
        cost, rank, edits = solve(runs, starts)
        for b in held:
            b["moves"] = []
        for r, k in enumerate(whose):
            for o in range(4):
                if cost[r, o] < FAR:
                    held[k]["moves"].append({"i": starts[r], "o": o, "cost": int(cost[r, o]), "rank": int(rank[r, o]), "audit": "".join([CODES[c] for c in edits[r][:, o].tolist()])})
        return pa.RecordBatch.from_pylist(held, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        held: list[dict] = []
        block, conversation, total, last_turn = None, object(), 0, None
        for batch in batches:
            for row in batch.to_pylist():
                same = row["conv_id"] == conversation
                kind = CLASSES.get(row["role"][:1], 3)
                left, fresh = row["copies"], row["first"]
                while left:
                    if block is None or not same or len(block["run"]) == BLOCK:
                        if total >= FLUSH:
                            yield flush(held)
                            held, total = [], 0
                        # The first block of a task may go on with another task's conversation.
                        block = {k: row[k] for k in KEY} | {"seq": seq, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "head": kind, "tail": kind, "low": None, "high": None, "run": [], "inner": same or not held and seq & ((1 << 40) - 1) == 0}
                        held.append(block)
                        seq += 1
                        conversation, same, last_turn = row["conv_id"], True, None
                    fault = row["fault"] if fresh or row["fault"] == BLANK else DUPLICATE
                    many = 1 if fresh else min(left, BLOCK - len(block["run"]))
                    block["illegal"] += (not _legal(block["tail"], kind)) * bool(block["run"]) + (many - 1) * (not _legal(kind, kind))
                    if fault:
                        block[("blank", "duplicate", "truncated")[fault - 1]] += many
                    if row["turn"] is not None:
                        block["turns"] += row["turn"] != last_turn
                        block["low"] = row["turn"] if block["low"] is None else block["low"]
                        block["high"] = last_turn = row["turn"]
                    block["run"] += [4 * fault + kind] * many
                    block["tail"], fresh = kind, False
                    left, total = left - many, total + many
        if held:
            yield flush(held)

    return run


_FOLDED = "seq long, i int, o int, closing string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SUMS = ("blank", "duplicate", "truncated", "illegal")


def _fold(schema: pa.Schema):
    """Each conversation's blocks in order to the states it enters and leaves them in; the last one also has the conversation's sums."""

    def close(blocks: list[tuple[int, list[int]]], cost: list[int], rank: list[int], sums: dict) -> list[dict]:
        ends = [0, 2 * INSERT, INSERT, 0]
        o = min((s for s in range(4) if cost[s] < FAR), key=lambda s: (cost[s] + ends[s], rank[s]))
        low, high = sums.pop("low"), sums.pop("high")
        seen = sums.pop("turns")
        last = sums | {"closing": "I" * (ends[o] // INSERT), "cost": cost[o] + ends[o], "gaps": 0 if low is None else high - low + 1 - seen}
        out = []
        for seq, parents in reversed(blocks):
            out.append({"seq": seq, "i": parents[o], "o": o} | last)
            o, last = parents[o], {}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, blocks = object(), []
        cost, rank, sums, tail = [], [], {}, 3
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if row["conv_id"] != conversation:
                    if blocks:
                        out += close(blocks, cost, rank, sums)
                    conversation, blocks = row["conv_id"], []
                    cost, rank = [0, FAR, FAR, FAR], [0, 1, 2, 3]
                    sums = {k: 0 for k in _SUMS} | {"turns": 0, "low": None, "high": None}
                elif not _legal(tail, row["head"]):
                    sums["illegal"] += 1
                best: dict[int, tuple] = {}
                for m in row["moves"]:
                    if cost[m["i"]] < FAR:
                        best[m["o"]] = min(best.get(m["o"], (FAR,)), (cost[m["i"]] + m["cost"], rank[m["i"]], m["rank"], m["i"]))
                order = sorted(best, key=lambda o: best[o][1:3])
                blocks.append((row["seq"], [best[o][3] if o in best else 0 for o in range(4)]))
                cost, rank = [best[o][0] if o in best else FAR for o in range(4)], [order.index(o) if o in best else 3 for o in range(4)]
                tail = row["tail"]
                for k in _SUMS:
                    sums[k] += row[k]
                if row["low"] is not None:
                    sums["turns"] += row["turns"] - (sums["high"] == row["low"])
                    sums["low"] = row["low"] if sums["low"] is None else sums["low"]
                    sums["high"] = row["high"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if blocks:
            yield pa.RecordBatch.from_pylist(close(blocks, cost, rank, sums), schema=schema)

    return run


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repaired:
    """One conversation while its edits and texts stream by: nothing is held but the audit and the edits of the block at hand."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.audit, self.pending, self.place, self.state, self.sha, self.begun, self.closing = [], "", 0, NOTHING, hashlib.sha256(), False, ""

    def write(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.begun + role + ":").encode())
        self.sha.update(text.encode())
        self.begun = True

    def expected(self, text: str) -> None:
        self.state = inserted(self.state)
        self.write("assistant" if self.state == ASSISTANT else "user", text)

    def edits(self, row: dict) -> None:
        self.audit.append(row["audit"])
        self.pending, self.place = self.pending[self.place :] + row["audit"], 0
        if row["cost"] is not None:
            self.closing = row["closing"]
            self.row |= {k: row[k] for k in self.row if k != "conv_id"}

    def turn(self, row: dict) -> None:
        for _ in range(row["copies"]):
            while self.pending[self.place] == "I":
                self.expected("")
                self.place += 1
            edit = self.pending[self.place]
            self.place += 1
            if edit == "K":
                self.write(row["role"], row["text"])
                self.state = SYSTEM if row["role"][:1] == "s" else inserted(self.state)
            elif edit == "R":
                self.expected(row["text"])

    def result(self) -> dict:
        for _ in self.closing:
            self.expected("")
        return self.row | {"audit": "".join(self.audit) + self.closing, "repaired_sha256": self.sha.hexdigest()}


def _write(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.row["conv_id"]:
                    if now is not None:
                        out.append(now.result())
                    now = _Repaired(row["conv_id"])
                if row["kind"] == 0:
                    now.edits(row)
                elif row["kind"] == 1:
                    now.turn(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema=schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a frame with these columns."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``rows (conv_id, turn, role, text, copies)``: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    Every ``conv_id`` of ``conversations`` comes back; one without rows has zeros, an empty audit and the hash of nothing. Turns
    go by ``turn`` (nulls first), those of one turn by role and hash of the text; equal rows are copies next to each other. A
    null ``conv_id`` is a conversation of its own. Role and text are never null in ``rows`` (``damaged``). A role counts by its
    initial, so an empty one must be changed or deleted. Texts of any length are shuffled once and hashed as they stream by;
    equal texts are those of equal SHA-256. An empty table gives no rows; other columns are not read.

    A conversation of any length is solved in blocks of ``BLOCK`` turns by as many tasks as its turns were sorted into; one
    task joins its blocks (a row each), and one hashes its texts, which SHA-256 cannot share out, holding the audit only.
    """
    kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    head = f"conv_id {kind[0]}, turn {kind[1]}, role string, h binary"
    ordered = turns(rows).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    blocks = written(ordered.mapInArrow(_blocks(_arrow(f"{head}, {_BLOCKS}")), f"{head}, {_BLOCKS}"))
    light = blocks.select("conv_id", "seq", *_SUMS, "turns", "head", "tail", "low", "high", F.transform("moves", lambda m: F.struct(m["i"].alias("i"), m["o"].alias("o"), m["cost"].alias("cost"), m["rank"].alias("rank"))).alias("moves"))
    folded = light.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_fold(_arrow(_FOLDED)), _FOLDED)
    audit = F.element_at(F.filter("moves", lambda m: (m["i"] == F.col("i")) & (m["o"] == F.col("o"))), 1)["audit"]
    edits = blocks.select(*KEY, "seq", "moves").join(folded, "seq").select(*KEY, F.lit(0).alias("kind"), "seq", audit.alias("audit"), "closing", "gaps", *_SUMS, "cost")
    texts = keyed(rows).select(*KEY, F.lit(1).alias("kind"), "text", "copies")
    every = conversations.select("conv_id").distinct().withColumn("kind", F.lit(2))
    stream = edits.unionByName(texts, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    result = f"conv_id {kind[0]}, {_RESULT}"
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "kind", "seq").mapInArrow(_write(_arrow(result)), result)


def repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``conversations`` after ``damaged``."""
    return repair(damaged(conversations), conversations)
