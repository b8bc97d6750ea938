r"""Conversation structure repair: the cheapest edits that make turns alternate, by divide and conquer in linear space.

Role initials of a repaired conversation are ``(s?(ua)+)?``: a machine of four states, what the last turn was (none,
system, user, assistant). Each row is kept, given another role or deleted, and turns may be put in; faulty rows must go
or cost more. A row is a 4 x 4 matrix of costs from state to state, and so is any run of rows. To find the edits of a run
costs go forward from its first state and backward from its last, meet in the middle, and of the cheapest crossings
that is taken to which the least audit leads; then both halves are done alike. Audits of as many rows are never one
the beginning of another, so the order of the four audits that lead to the four states is all that has to be kept.

The rows of a conversation are cut into segments of bounded size, whose matrices meet in a tree of bounded fan-in. So a
conversation of any size is shared by many tasks, and the recursion goes from its whole down to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, attach

#: Costs of the edits, and the characters that spaces are and that a whole text ends with: fixed values of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: States: nothing yet, after a system, a user, an assistant turn. What may follow each state, by initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60

#: A row's code: its initial (o: any other), small if it has no fault, large if it is truncated, a digit if it must go.
INITIALS = "suao"
FINE, CUT, GONE = "suao", "SUAO", "1234"

#: A segment has at most 2 ** SEGMENT rows, a node of the tree at most 2 ** FAN children.
SEGMENT, FAN = 12, 8

#: Costs of 16 pairs of states, and for each first state the places of the four audits in their order.
Run = tuple[tuple[int, ...], tuple[int, ...]]


def _given(state: int) -> int:
    """The state after a turn that is put in or given the role that fits: a user's, or an assistant's after a user's."""
    return ASSISTANT if state == USER else USER


def _ranked(found: dict[tuple[int, int], tuple[int, tuple]]) -> Run:
    """Costs and ranks from (cost, what the audits are ordered by) for each pair of states."""
    costs = [found[p, q][0] if (p, q) in found else NEVER for p in range(4) for q in range(4)]
    ranks = [4] * 16
    for p in range(4):
        for k, q in enumerate(sorted((q for q in range(4) if (p, q) in found), key=lambda q: found[p, q][1])):
            ranks[4 * p + q] = k
    return tuple(costs), tuple(ranks)


@lru_cache
def edits(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each pair of states the least (cost, audit) of one row, with turns put in before it."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for first in range(4):
        state = first
        for put in range(4):
            options = [(DELETE, "D", state)]
            if code not in GONE:
                more = TRUNCATED if code in CUT else 0
                if (kept := NEXT[state].get(code.lower())) is not None:
                    options.append((more, "K", kept))
                options.append((REROLE + more, "R", _given(state)))
            for cost, name, last in options:
                out[first, last] = min(out.get((first, last), (NEVER, "")), (cost + put * INSERT, "I" * put + name))
            state = _given(state)
    return out


@lru_cache
def row_run(code: str) -> Run:
    return _ranked({k: (cost, (audit,)) for k, (cost, audit) in edits(code).items()})


def _forward(runs: Sequence[Run], begin: int, end: int, state: int) -> tuple[list[int], list[int]]:
    """Costs of the four states after runs[begin:end], and the order of the audits that lead to them."""
    costs, ranks = [NEVER] * 4, [4] * 4
    costs[state], ranks[state] = 0, 0
    for step, order in runs[begin:end]:
        now = []
        for q in range(4):
            now.append(min((costs[p] + step[4 * p + q], ranks[p], order[4 * p + q]) for p in range(4)))
        places = {x[1:]: k for k, x in enumerate(sorted((x for x in now if x[0] < NEVER), key=lambda x: x[1:]))}
        costs, ranks = [x[0] if x[0] < NEVER else NEVER for x in now], [places[x[1:]] if x[0] < NEVER else 4 for x in now]
    return costs, ranks


def _backward(runs: Sequence[Run], begin: int, end: int, state: int) -> list[int]:
    """Costs from each of the four states over runs[begin:end] to state."""
    costs = [NEVER] * 4
    costs[state] = 0
    for step, _ in reversed(runs[begin:end]):
        costs = [min(min(step[4 * p + q] + costs[q] for q in range(4)), NEVER) for p in range(4)]
    return costs


def crossings(runs: Sequence[Run], first: int, last: int) -> list[tuple[int, int]]:
    """The states before and after each run on the cheapest way from first to last whose audit is the least."""
    out = [(first, last)] * len(runs)
    open_ = [(0, len(runs), first, last)]
    while open_:
        begin, end, p, q = open_.pop()
        if end - begin == 1:
            out[begin] = (p, q)
        if end - begin < 2:
            continue
        middle = (begin + end) // 2
        costs, ranks = _forward(runs, begin, middle, p)
        rest = _backward(runs, middle, end, q)
        r = min(range(4), key=lambda r: (costs[r] + rest[r], ranks[r]))
        open_ += [(begin, middle, p, r), (middle, end, r, q)]
    return out


def joined(runs: Sequence[Run]) -> Run:
    """One run for several, one after the other."""
    ways = [_forward(runs, 0, len(runs), p) for p in range(4)]
    return tuple(c for costs, _ in ways for c in costs), tuple(r for _, ranks in ways for r in ranks)


def closing(run: Run) -> tuple[int, int, str]:
    """Of a whole conversation: the state after its last row, what the edits cost, and the audit of turns put in at its end."""
    tails = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    last = min(range(4), key=lambda q: (run[0][q] + INSERT * len(tails[q]), run[1][q]))
    return last, run[0][last] + INSERT * len(tails[last]), tails[last]


@lru_cache(1 << 14)
def summary(codes: str) -> tuple[Run, int]:
    """The run of a segment, and its pairs of neighbours that may not follow each other."""
    initials = [INITIALS[(FINE.find(c) if c in FINE else CUT.find(c) if c in CUT else GONE.find(c))] for c in codes]
    return joined([row_run(c) for c in codes]), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


@lru_cache(1 << 14)
def segment_edits(codes: str, first: int, last: int) -> tuple[tuple[str, str], ...]:
    """For each row of a segment its part of the audit, and the initials of the turns that come out (small: put in)."""
    out = []
    for code, (p, q) in zip(codes, crossings([row_run(c) for c in codes], first, last), strict=True):
        audit, state, roles = edits(code)[p, q][1], p, ""
        for edit in audit:
            if edit == "I":
                state = _given(state)
                roles += NAMES[state][0]
            elif edit == "R":
                roles += NAMES[_given(state)][0].upper()
            elif edit == "K":
                roles += "K"
        out.append((audit, roles))
    return tuple(out)


NODE = "key string, node long, costs array<long>, ranks array<int>, head string, tail string, illegal long"


def _nodes(segments: DataFrame) -> DataFrame:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(c) for c in batch["codes"].to_pylist()]
            columns = [pa.array([list(run[k]) for run, _ in found], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["node"], *columns, batch["head"], batch["tail"], pa.array([n for _, n in found], pa.int64())], [c.split()[0] for c in NODE.split(", ")])

    return segments.select("key", "node", "codes", "head", "tail").mapInArrow(summed, NODE)


def _runs(table: pa.Table) -> list[Run]:
    return [(tuple(c), tuple(r)) for c, r in zip(table["costs"].to_pylist(), table["ranks"].to_pylist(), strict=True)]


def _parents(children: DataFrame, fan: int) -> DataFrame:
    def one(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        costs, ranks = joined(_runs(table))
        heads, tails = table["head"].to_pylist(), table["tail"].to_pylist()
        illegal = sum(table["illegal"].to_pylist()) + sum(a + b not in LEGAL for a, b in zip(tails, heads[1:], strict=False))
        values = [keys[0].as_py(), keys[1].as_py(), list(costs), list(ranks), heads[0], tails[-1], illegal]
        return pa.table({c.split()[0]: [v] for c, v in zip(NODE.split(", "), values, strict=True)}).cast(kinds)

    kinds = pa.schema([("key", pa.string()), ("node", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])
    return children.withColumn("parent", F.shiftright("node", fan)).groupBy("key", "parent").applyInArrow(one, NODE)


def _children(parents: DataFrame, children: DataFrame, fan: int) -> DataFrame:
    """(key, node, first, last) of children, from those of their parents."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        states = crossings(_runs(table), table["first"][0].as_py(), table["last"][0].as_py())
        return pa.table({"key": table["key"], "node": table["node"], "first": pa.array([p for p, _ in states], pa.int32()), "last": pa.array([q for _, q in states], pa.int32())})

    both = children.withColumn("parent", F.shiftright("node", fan)).join(parents.select("key", F.col("node").alias("parent"), "first", "last"), ["key", "parent"])
    return both.groupBy("key", "parent").applyInArrow(one, "key string, node long, first int, last int")


def _whole(nodes: DataFrame) -> DataFrame:
    """Nodes that are all of their conversation, with first, last, cost and the audit of their end (ending)."""

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [closing(run) for run in _runs(batch)]
            columns = [pa.array([START] * len(ends), pa.int32()), *(pa.array([e[k] for e in ends], kind) for k, kind in ((0, pa.int32()), (1, pa.int64()), (2, pa.string())))]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["node"], batch["illegal"], *columns], ["key", "node", "illegal", "first", "last", "cost", "ending"])

    return nodes.mapInArrow(closed, "key string, node long, illegal long, first int, last int, cost long, ending string")


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's key: no conv_id is a conversation of its own."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def _ordered(scratch: Scratch, rows: DataFrame, segment: int) -> DataFrame:
    """Rows with their place (gid) in the order of conversations and turns, their fault and code."""
    text = F.coalesce("text", F.lit(" "))
    named = rows.select("conv_id", _key().alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    # rid only parts rows that are alike, so that very many of them don't meet in one range.
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "rid"]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id()).drop("rid")
    placed = scratch.table(placed, "placed")
    again = ["key", "role", "digest"]
    groups = placed.groupBy(*again).agg(F.min("gid").alias("first_gid"), F.count("*").alias("times")).filter("times > 1")
    seen = attach(placed, scratch.table(groups, "again"), again, "times", placed.count(), "left")
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("gid") > F.col("first_gid"), "duplicate").when(~end.isin(*ENDS), "truncated")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.translate(initial, INITIALS, GONE)).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    full = seen.withColumn("fault", fault).withColumns({"code": code, "initial": initial, "node": F.shiftright("gid", segment)})
    return scratch.table(full.select("conv_id", "key", "turn", "role", "text", "gid", "fault", "code", "initial", "node"), "rows")


def _solved(scratch: Scratch, rows: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Segments (key, node, least, codes, first, last), and conversations (key, illegal, cost, ending)."""
    ordered = F.array_sort(F.collect_list(F.struct("gid", "code", "initial")))
    found = rows.groupBy("key", "node").agg(F.min("gid").alias("least"), ordered.alias("r"))
    found = found.select("key", "node", "least", F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes"), F.col("r")[0]["initial"].alias("head"), F.element_at("r", -1)["initial"].alias("tail"))
    segments = scratch.table(found, "segments")
    level = scratch.table(_nodes(segments), "nodes0")
    wholes, levels, k = [], [], 0
    # A conversation leaves the tree once it is one node; the others go on until none is left.
    while True:
        counts = level.groupBy("key").agg(F.count("*").alias("n"))
        one, more = counts.filter("n = 1").select("key"), counts.filter("n > 1").select("key")
        wholes.append(scratch.table(_whole(level.join(one, "key")), f"wholes{k}"))
        level = scratch.table(level.join(more.hint("merge"), "key", "left_semi"), f"open{k}")
        if level.isEmpty():
            break
        levels.append(level)
        level = scratch.table(_parents(level, fan), f"nodes{k + 1}")
        k += 1
    states = wholes[-1].select("key", "node", "first", "last")
    for k in reversed(range(len(levels))):
        below = _children(states, levels[k], fan)
        states = scratch.table(below.unionByName(wholes[k].select("key", "node", "first", "last")), f"states{k}")
    conversations = wholes[0]
    for whole in wholes[1:]:
        conversations = conversations.unionByName(whole)
    return segments.join(states.hint("merge"), ["key", "node"]), conversations


def _edited(segments: DataFrame) -> DataFrame:
    """(gid, audit, roles) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids, audits, roles = [], [], []
            for least, codes, first, last in zip(*(batch[c].to_pylist() for c in ("least", "codes", "first", "last")), strict=True):
                done = segment_edits(codes, first, last)
                gids += range(least, least + len(done))
                audits += [a for a, _ in done]
                roles += [r for _, r in done]
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(audits, pa.string()), pa.array(roles, pa.string())], ["gid", "audit", "roles"])

    return segments.select("least", "codes", "first", "last").mapInArrow(each, "gid long, audit string, roles string")


class Repair:
    """What is wrong in conversations, and the cheapest repair.

    Rows are taken by turn, nulls first, then role and the digest of the text. Null roles and texts are one space.
    Rows without conv_id are one conversation. A row is blank if its text has nothing but spaces, a duplicate if
    role and text are those of an earlier row of the conversation, truncated if its text ends with none of ``.!?``; the
    first of these counts. Blank rows and duplicates are deleted. Repeated rows are duplicates; texts of any length are
    read whole; other columns, whatever their names, are not used. An empty table has no conversations.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT, fan: int = FAN):
        self.scratch = Scratch(rows.sparkSession, "repair")
        self.rows = _ordered(self.scratch, rows, segment)
        segments, self.conversations = _solved(self.scratch, self.rows, fan)
        self.edits = self.scratch.table(_edited(segments), "edits")

    def audits(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation with a row.

        The audit is a row's column, so it is in memory at once: a character a row or turn put in.
        """
        rows = self.rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
        turns = self.rows.filter("turn is not null").groupBy("key", "turn").count().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
        marks = self.rows.select("key", "node", "gid").join(self.edits.hint("merge"), "gid")
        # First what a segment has, then what a conversation has: no list is sorted that is longer than a segment or its segments.
        text = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "audit"))), lambda x: x["audit"]), "").alias("audit")
        marks = marks.groupBy("key", "node").agg(text("gid")).groupBy("key").agg(text("node"))
        out = rows.join(turns, "key", "left").join(self.conversations, "key").join(marks, "key")
        return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", "ending").alias("audit"))

    def repaired(self) -> DataFrame:
        """conv_id, key, place, role, text, inserted: the repaired rows; place orders them in a conversation.

        An inserted turn has an empty text and the turn number of none.
        """
        name = lambda r: F.when(F.lower(r) == "u", "user").otherwise("assistant")
        chars = F.filter(F.split("roles", ""), lambda r: r != "")
        turn = lambda r: F.struct(F.when(r == "K", F.col("role")).otherwise(name(r)).alias("role"), F.when(r.isin("u", "a"), "").otherwise(F.col("text")).alias("text"), r.isin("u", "a").alias("inserted"))
        rows = self.rows.join(self.edits.hint("merge"), "gid").select("conv_id", "key", "gid", F.posexplode(F.transform(chars, turn)).alias("k", "t"))
        rows = rows.select("conv_id", "key", (F.col("gid") * 8 + F.col("k")).alias("place"), "t.*")
        last = self.rows.groupBy("key").agg(F.max_by(F.struct("conv_id", "gid"), "gid").alias("last")).join(self.conversations.filter("ending <> ''").select("key", "ending"), "key")
        names = F.when(F.col("ending") == "I", F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
        ends = last.select("last.conv_id", "key", "last.gid", F.posexplode(names).alias("k", "role"))
        ends = ends.select("conv_id", "key", (F.col("gid") * 8 + 6 + F.col("k")).alias("place"), "role", F.lit("").alias("text"), F.lit(True).alias("inserted"))
        return rows.unionByName(ends)


def digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the digest of a conversation's ``role:text``, joined by new lines; rows stream by, however many."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for now, role, text in zip(*(batch[c].to_pylist() for c in ("key", "role", "text")), strict=True):
                if now != key:
                    if state is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "repaired_sha256"])

    rows = repaired.select("key", "place", "role", "text").repartition("key").sortWithinPartitions("key", "place")
    return rows.mapInArrow(each, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that the row's number in twenty says; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    df = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), number.alias("n")).filter("n <> 0")
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return df.drop("copy")


def damage_and_repair(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of rows: what damaged() has done to it and what repairs it, with a digest of the repaired text."""
    repair = Repair(damaged(rows), segment, fan)
    found = repair.audits().withColumn("key", _key()).drop("conv_id").join(digests(repair.repaired()), "key", "left")
    every = rows.select("conv_id", _key().alias("key")).distinct().join(found, "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
