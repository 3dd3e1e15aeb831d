"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A repaired conversation has the roles ``(system)? (user assistant)+`` or is empty. A lattice node is a place between rows
together with what the grammar has read: nothing, a system row, a user row, an assistant row. Edges keep, rerole or delete
the next row, or insert an empty row before it. One heap works forward from the start, one backward from the end; labels are
a cost and the least audit (the initials of the edits) of that cost. When the two smallest costs together exceed the best
crossing, every crossing of that cost has been seen, and the least concatenated audit wins. Zero-cost steps only lead to the
next row, so heaps ordered by cost and place settle each node once.

No task holds a whole conversation. Rows are dealt out by ranges of (conversation, turn), numbered, and cut into blocks of
``BLOCK`` rows, of which a block keeps one letter each. A conversation of one block is one search. Of a longer one each block
is searched from each state to each state, with insertions only before its rows: then the audits of a block from one state
are no prefixes of each other, so costs and ranks of audits suffice to compose blocks, tree-wise, ``FAN`` at a time, and to go
back down to the states at which the cheapest path enters and leaves each block. Texts move only to be hashed; the
hash of a conversation reads its rows one after another, in constant memory.

Defined cases: null role and text are one space; a null conversation is one of its own; null turns come first; rows of
one turn are ordered by a hash of role and text, then by their place in the file, a repeat beside its original; empty texts
are blank; a conversation without rows costs nothing and has an empty audit; texts and conversations may be of any length;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sleuthframe.llm.tables import keyed, numbered, settle

BLOCK = 256
FAN = 64
BLANK_CHARS = " \t\n\x0b\x0c\r"

RETAIN, REROLE, REMOVE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
NEVER = 1 << 40

# What the grammar has read: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# What is missing at the end of a conversation.
MISSING = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
NAMES = {"u": "user", "a": "assistant"}


@lru_cache(None)
def moves(code: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, initial) of the edits of a row; see ``row_code``."""
    out = [(q, q, REMOVE, "D") for q in STATES]
    if code != "x":
        more = UNFINISHED if code.isupper() else 0
        for q in STATES:
            if (q, code.lower()) in AFTER:
                out.append((q, AFTER[q, code.lower()], RETAIN + more, "K"))
            out += [(q, AFTER[q, r], REROLE + more, "R") for r in NAMES if (q, r) in AFTER]
    return out


INSERTS = [(q, AFTER[q, r], INSERT, "I") for q in STATES for r in NAMES if (q, r) in AFTER]


class _Lattice:
    """Edges between nodes (place, state); the end is a node of its own, one place behind the last row."""

    def __init__(self, codes: str, leave: int | None):
        self.codes, self.n = codes, len(codes)
        if leave is None:
            self.ends = [(q, len(MISSING[q]) * INSERT, "I" * len(MISSING[q])) for q in STATES]
        else:
            self.ends = [(leave, 0, "")]
        self.end = (self.n + 1, 0)

    def onward(self, place: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        if place == self.n:
            yield from ((self.end, c, e) for q, c, e in self.ends if q == state)
        elif place < self.n:
            yield from (((place + 1, b), c, e) for a, b, c, e in moves(self.codes[place]) if a == state)
            yield from (((place, b), c, e) for a, b, c, e in INSERTS if a == state)

    def back(self, place: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        if place == self.n + 1:
            yield from (((self.n, q), c, e) for q, c, e in self.ends)
            return
        if place < self.n:
            yield from (((place, a), c, e) for a, b, c, e in INSERTS if b == state)
        if place > 0:
            yield from (((place - 1, a), c, e) for a, b, c, e in moves(self.codes[place - 1]) if b == state)


@lru_cache(65536)
def search(codes: str, enter: int = NOTHING, leave: int | None = None) -> tuple[int, str] | None:
    """(cost, least audit) from a state before the first row to one behind the last, or with ``leave`` None to the end."""
    lattice = _Lattice(codes, leave)
    start = (0, enter)
    ahead, behind = {start: (0, "")}, {lattice.end: (0, "")}
    settled_ahead: dict = {}
    settled_behind: dict = {}
    heap_ahead, heap_behind = [(0, 0, start)], [(0, -lattice.end[0], lattice.end)]
    best: tuple[int, str] | None = None
    while heap_ahead and heap_behind:
        if best is not None and heap_ahead[0][0] + heap_behind[0][0] > best[0]:
            break
        forward = heap_ahead[0][0] <= heap_behind[0][0]
        heap, labels, settled, other = (
            (heap_ahead, ahead, settled_ahead, settled_behind)
            if forward
            else (heap_behind, behind, settled_behind, settled_ahead)
        )
        node = heapq.heappop(heap)[2]
        if node in settled:
            continue
        cost, audit = settled[node] = labels[node]
        for near, step, edit in lattice.onward(*node) if forward else lattice.back(*node):
            label = (cost + step, audit + edit if forward else edit + audit)
            if near in other:
                rest, tail = other[near]
                crossing = (label[0] + rest, label[1] + tail if forward else tail + label[1])
                best = crossing if best is None else min(best, crossing)
            if near not in settled and (near not in labels or label < labels[near]):
                labels[near] = label
                heapq.heappush(heap, (label[0], near[0] if forward else -near[0], near))
    return best


def block_table(codes: str) -> tuple[list[int], list[int]]:
    """Costs from each state to each state, and ranks of the audits among those from the same state."""
    costs, ranks = [], []
    for enter in STATES:
        found = [search(codes, enter, leave) for leave in STATES]
        order = sorted(f[1] for f in found if f)
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(f[1]) if f else 0 for f in found]
    return costs, ranks


def _walk(tables: list[tuple[list[int], list[int]]], enter: int) -> tuple[dict[int, tuple[int, int]], list[dict[int, int]]]:
    """Cheapest costs to each state after all blocks, with the rank of the audit, and the state before each block.

    Audits that lead to different states differ, so the rank of the audits so far decides between equal costs.
    """
    now, back = {enter: (0, 0)}, []
    for costs, ranks in tables:
        found = {}
        for leave in STATES:
            ways = [(c + costs[4 * q + leave], rank, q) for q, (c, rank) in now.items() if costs[4 * q + leave] < NEVER]
            if ways:
                found[leave] = min(ways)
        order = sorted(found, key=lambda e: (found[e][1], ranks[4 * found[e][2] + e]))
        back.append({e: found[e][2] for e in found})
        now = {e: (found[e][0], order.index(e)) for e in found}
    return now, back


def compose(tables: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """The table of neighbouring blocks taken as one."""
    costs, ranks = [], []
    for enter in STATES:
        now, _ = _walk(tables, enter)
        costs += [now[e][0] if e in now else NEVER for e in STATES]
        ranks += [now[e][1] if e in now else 0 for e in STATES]
    return costs, ranks


def last_state(table: tuple[list[int], list[int]]) -> int:
    """The state in which the cheapest path of a whole conversation has read its rows."""
    costs, ranks = table
    return min(STATES, key=lambda e: (costs[e] + INSERT * len(MISSING[e]), ranks[e]))


def way_through(tables: list[tuple[list[int], list[int]]], enter: int, leave: int) -> list[tuple[int, int]]:
    """States before and after each block on the cheapest path."""
    _, back = _walk(tables, enter)
    out = []
    for before in reversed(back):
        out.append((before[leave], leave))
        leave = before[leave]
    return out[::-1]


def edits(codes: str, audit: str, enter: int) -> list[tuple[str, str, str | None]]:
    """(initial, inserted roles before the row, new role) of each row; what comes last is behind the rows."""
    out, state, inserted, at = [], enter, "", 0
    for edit in audit:
        if edit == "I":
            role = "a" if state == USER else "u"
            inserted += role
            state = AFTER[state, role]
            continue
        role = None
        if edit == "K":
            state = AFTER[state, codes[at].lower()]
        elif edit == "R":
            role = "a" if state == USER else "u"
            state = AFTER[state, role]
        out.append((edit, inserted, NAMES.get(role)))
        inserted, at = "", at + 1
    return [*out, ("", inserted, None)]


class Repairs(NamedTuple):
    """``summary``: one row per conversation; ``lines``: the repaired rows, each with its place."""

    summary: DataFrame
    lines: DataFrame


def conversation_key(conv: Column) -> Column:
    return F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("+"), conv.cast("string")))


def turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_file, _row, conv, turn, role, text, copy) of a table, null role and text being one space."""
    space = lambda c: F.coalesce(F.col(f"_doc.`{c}`").cast("string"), F.lit(" "))
    return keyed(table).select(
        "_file", "_row", F.col(f"_doc.`{conv_col}`").alias("conv"), F.col(f"_doc.`{turn_col}`").cast("long").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), F.lit(0).alias("copy"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user by the checksum of conversation and turn."""
    named = F.concat(
        F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    kind = F.crc32(named.cast("binary")) % 20
    marked = rows.withColumn("_kind", kind).where("_kind <> 0")
    changed = (
        F.when(F.col("_kind") == 1, F.lit(""))
        .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "_file", "_row", "conv", "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"), F.explode(copies).alias("copy"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """(key, at, fault, code, initial, _file, _row, copy, turn): narrow rows, numbered within their conversation.

    ``code`` is what the lattice needs of a row: x where it must go, else s, u, a or o (any other role), large where the
    text is unfinished.
    """
    shown = F.rtrim("text", F.lit(BLANK_CHARS))
    first = F.substring("role", 1, 1)
    narrow = rows.select(
        conversation_key(F.col("conv")).alias("key"), "turn", "_file", "_row", "copy",
        F.xxhash64("role", "text").alias("tie"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("same"),
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("tie"), F.col("_file"), F.col("_row"), F.col("copy")]
    placed = settle(numbered(narrow, order).drop("tie"))
    often = placed.groupBy("key", "same").agg(F.min("_pos").alias("_first"), F.count("*").alias("_k")).where("_k > 1")
    base = placed.groupBy("key").agg(F.min("_pos").alias("_base"))
    both = placed.join(often.select("key", "same", "_first"), ["key", "same"], "left").join(base, "key")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("_first") < F.col("_pos"), "duplicate").when(F.col("open"), "truncated")
    )
    marked = both.withColumn("fault", fault)
    code = (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )
    return settle(
        marked.select(
            "key", (F.col("_pos") - F.col("_base")).alias("at"), "fault", code.alias("code"), "initial", "_file", "_row",
            "copy", "turn",
        )
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, block, codes, initials, places): at most BLOCK rows each, in order."""
    one = F.struct("at", "code", "initial", "_file", "_row", "copy")
    grouped = rows.groupBy("key", F.expr(f"at div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    text = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "")
    places = F.transform("r", lambda x: F.struct(x["_file"].alias("_file"), x["_row"].alias("_row"), x["copy"].alias("copy")))
    return grouped.select("key", "block", text("code").alias("codes"), text("initial").alias("initials"), places.alias("places"))


TABLE = "costs array<long>, ranks array<long>"


def _tables(frame: pd.DataFrame) -> list[tuple[list[int], list[int]]]:
    return [(list(map(int, c)), list(map(int, r))) for c, r in zip(frame["costs"], frame["ranks"], strict=True)]


def _states(blocks: DataFrame) -> DataFrame:
    """(key, block, enter, leave) for the blocks of conversations of several blocks; ``leave`` is null at the end."""

    @F.pandas_udf(f"struct<{TABLE.replace(' ', ':', 1).replace('ranks ', 'ranks:')}>")
    def tabled(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([block_table(c) for c in codes], columns=["costs", "ranks"])

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [compose([(list(c), list(r)) for _, c, r in parts]) for parts in _parts(frame)]
            yield pd.DataFrame(
                {"key": frame["key"], "block": frame["block"], "costs": [o[0] for o in out], "ranks": [o[1] for o in out]}
            )

    def _parts(frame: pd.DataFrame) -> list:
        return [
            [(p["block"], [int(x) for x in p["costs"]], [int(x) for x in p["ranks"]]) for p in parts] for parts in frame["parts"]
        ]

    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, parts, enter, leave in zip(frame["key"], _parts(frame), frame["enter"], frame["leave"], strict=True):
                ways = way_through([(c, r) for _, c, r in parts], int(enter), int(leave))
                out += [(key, int(part[0]), a, b) for part, (a, b) in zip(parts, ways, strict=True)]
            yield pd.DataFrame(out, columns=["key", "block", "enter", "leave"])

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leave = [last_state(t) for t in _tables(frame)]
            yield pd.DataFrame({"key": frame["key"], "block": frame["block"], "enter": NOTHING, "leave": leave})

    level = settle(blocks.withColumn("t", tabled("codes")).select("key", "block", "t.costs", "t.ranks"))
    groups = []
    while (level.agg(F.max("block")).first()[0] or 0) > 0:
        part = F.struct("block", "costs", "ranks")
        grouped = settle(
            level.groupBy("key", F.expr(f"block div {FAN}").alias("block")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        )
        groups.append(grouped)
        level = settle(grouped.mapInPandas(joined, f"key string, block long, {TABLE}"))
    found = level.mapInPandas(top, "key string, block long, enter int, leave int")
    for grouped in reversed(groups):
        found = grouped.join(found, ["key", "block"]).mapInPandas(down, "key string, block long, enter int, leave int")
    return settle(found)


def _solved(blocks: DataFrame) -> DataFrame:
    """(key, block, cost, audit, plan): the edits of every block, ``plan`` one entry per row and one behind the last."""
    last = settle(blocks.groupBy("key").agg(F.max("block").alias("last")))
    several = last.where("last > 0")
    states = _states(blocks.join(several.select("key"), "key", "left_semi"))
    known = blocks.join(last, "key").join(states, ["key", "block"], "left").select(
        "key", "block", "codes", "places", F.coalesce("enter", F.lit(NOTHING)).alias("enter"),
        # The last block is searched up to the end of the conversation, all others up to a state.
        F.when(F.col("block") == F.col("last"), F.lit(-1)).otherwise(F.col("leave")).alias("leave"),
    )

    @F.pandas_udf("struct<cost:long,audit:string,plan:array<struct<edit:string,before:string,role:string>>>")
    def solve(codes: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.DataFrame:
        out = []
        for c, a, b in zip(codes, enter, leave, strict=True):
            cost, audit = search(c, int(a), None if b < 0 else int(b))
            plan = [{"edit": e, "before": i, "role": r} for e, i, r in edits(c, audit, int(a))]
            out.append((cost, audit, plan))
        return pd.DataFrame(out, columns=["cost", "audit", "plan"])

    done = known.withColumn("s", solve("codes", "enter", "leave"))
    return settle(done.select("key", "block", "places", "s.cost", "s.audit", "s.plan"))


def repaired_lines(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(key, at, line): kept and reroled rows with their text, and inserted rows, by place.

    ``line`` has the inserted rows before the row, too, one per line.
    """
    nowhere = F.struct(F.lit(None).cast("long").alias("_file"), F.lit(None).cast("long").alias("_row"), F.lit(None).cast("int").alias("copy"))
    steps = solved.select(
        "key", "block", F.posexplode(F.arrays_zip("plan", F.concat("places", F.array(nowhere)).alias("place"))).alias("i", "z")
    ).select(
        "key", (F.col("block") * (BLOCK + 1) + F.col("i")).alias("at"), "z.plan.edit", "z.plan.before", "z.plan.role",
        "z.place._file", "z.place._row", "z.place.copy",
    )
    names = F.array_join(
        F.transform(F.filter(F.split("before", ""), lambda x: x != ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:")), "\n"
    )
    steps = settle(steps.where("edit in ('K', 'R') or before <> ''").withColumn("names", names).drop("before"))
    texts = rows.select("_file", "_row", "copy", F.col("role").alias("own"), "text")
    kept = steps.where("edit in ('K', 'R')").join(texts, ["_file", "_row", "copy"])
    own = F.concat(F.coalesce("role", "own"), F.lit(":"), F.col("text"))
    full = F.when(F.col("names") == "", own).otherwise(F.concat(F.col("names"), F.lit("\n"), own))
    alone = steps.where("edit not in ('K', 'R')")
    return kept.select("key", "at", full.alias("line")).unionByName(alone.select("key", "at", F.col("names").alias("line")))


def line_hashes(lines: DataFrame) -> DataFrame:
    """(key, sha256) of the lines of each conversation, read in order, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            keys, found = [], []
            for k, line in zip(frame["key"], frame["line"], strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pd.DataFrame({"key": pd.Series(keys, dtype="object"), "sha256": pd.Series(found, dtype="object")})
        if key is not None:
            yield pd.DataFrame({"key": [key], "sha256": [state.hexdigest()]})

    return lines.repartition("key").sortWithinPartitions("key", "at").select("key", "line").mapInPandas(run, "key string, sha256 string")


def repair(rows: DataFrame) -> Repairs:
    """Repair ``rows(_file, _row, copy, conv, turn, role, text)``."""
    marked = judged(rows)
    blocks = settle(_blocks(marked))
    counts = marked.groupBy("key").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    # Turns are counted apart: distinct ones are combined before the shuffle.
    distinct = marked.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("turns"))
    legal = r"(?=su|ua|au)"
    before = F.lag(F.right("initials", F.lit(1))).over(Window.partitionBy("key").orderBy("block"))
    chained = blocks.select("key", F.concat(F.coalesce(before, F.lit("")), "initials").alias("i"))
    illegal = chained.groupBy("key").agg(F.sum(F.length("i") - 1 - F.regexp_count("i", F.lit(legal))).alias("illegal"))
    solved = _solved(blocks)
    audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    found = solved.groupBy("key").agg(F.sum("cost").alias("cost"), audits.alias("audit"))
    lines = repaired_lines(rows, solved)
    both = (
        counts.join(distinct, "key", "left").join(illegal, "key").join(found, "key").join(line_hashes(lines), "key", "left")
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    empty = F.lit(hashlib.sha256().hexdigest())
    summary = both.select(
        "key", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", F.col("illegal").cast("long").alias("illegal"),
        "cost", "audit", F.coalesce("sha256", empty).alias("repaired_sha256"),
    )
    return Repairs(summary, lines)


def repair_damaged(table: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """One row per conversation of a table, repaired after ``damage``."""
    rows = turns(table, conv_col, **columns)
    summary = repair(damage(rows)).summary
    every = table.select(F.col(f"`{conv_col}`").alias(conv_col)).distinct().withColumn("key", conversation_key(F.col(conv_col)))
    both = every.join(summary, "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        conv_col,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
