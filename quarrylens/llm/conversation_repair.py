"""Conversation structure repair: a bidirectional tight-arc DAG.

The turns of a conversation, in order, are edited until the initials of their roles read
``(s?(ua)+)?``.  Keep costs 0; rerole to user or assistant 2; delete 3, and blank and repeated
turns must go; insert an empty turn of user or assistant, anywhere, 2; a truncated turn that is
not deleted adds 1.  Nodes are (turns read, state), the states being nothing yet, after system,
after user, after assistant; arcs are edits.  Minimum costs from the start and to the end make an
arc tight where their sum with its own cost is the total, and the tight arcs are all optimal
edits.  The audit is the least string of edit letters D, I, K, R along them: from a frontier of
nodes the least letter that any tight arc carries leads to the next frontier.

How it runs.  Rows are sorted by range of (conversation, turn, role, hash of role and text) and
read in order.  A conversation that lies within one partition is repaired there, in one pass; at
most two of a partition reach beyond it, and one of over ``SMALL_ROWS`` turns or ``SMALL_CHARS``
characters is not held either.  These are written out in slices, one for each partition:
repeats are found by joining digests with their least place; each slice becomes a 4 by 4 matrix
of costs between states; products of matrices from both ends give every slice its costs from the
start and to the end, so slices find their letters apart, for each state they may begin in; the
chain of states picks one of these.  Thus a conversation that holds a third of all rows is
repaired by many tasks.  Only the SHA-256 of its repaired text is one sequence by definition: a
task streams that text in order, a batch of rows at a time.

Defined cases: null role or text is one space; a null conversation is a conversation; null turns
come first; turns that tie go by role, then by a hash; repeated rows are repeated turns; the
initial of an empty role is none, so it cannot be kept; a conversation whose rows are all absent
gives zeros, an empty audit and the hash of nothing; long texts are hashed whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import settle

SMALL_ROWS = 4096
SMALL_CHARS = 4_000_000
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
#: States: nothing yet, after system, after user, after assistant.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn of user or assistant leads to, by state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\v\f\r"
_LEGAL = frozenset(("su", "ua", "au"))

#: A turn as the search sees it: initial, must it go, what it adds if it stays.
Turn = tuple[str, bool, int]


def after_inserts(f: list[int]) -> list[int]:
    """Costs from the start once inserts are open."""
    user = min(f[USER], min(f[BEGIN], f[SYSTEM], f[ASSISTANT]) + INSERT)
    return [f[BEGIN], f[SYSTEM], user, min(f[ASSISTANT], user + INSERT)]


def before_inserts(b: list[int]) -> list[int]:
    """Costs to the end once inserts are open."""
    user, assistant = min(b[USER], b[ASSISTANT] + INSERT), min(b[ASSISTANT], b[USER] + INSERT)
    return [min(b[BEGIN], user + INSERT), min(b[SYSTEM], user + INSERT), user, assistant]


#: Costs to the end after the last turn: nothing and a closed pair are whole.
END = before_inserts([0, NEVER, NEVER, 0])


def turn_arcs(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of the edits of a turn in a state."""
    initial, must_go, adds = turn
    out = [("D", DELETE, state)]
    if not must_go:
        if initial == "s" and state == BEGIN:
            out.append(("K", adds, SYSTEM))
        elif initial == ("a" if state == USER else "u"):
            out.append(("K", adds, NEXT[state]))
        out.append(("R", REROLE + adds, NEXT[state]))
    return out


def forward(turns: list[Turn], f: list[int]) -> list[list[int]]:
    """Costs from the start before each turn and after the last; inserts are open in all but the last."""
    out = []
    for turn in turns:
        f = after_inserts(f)
        out.append(f)
        to = [NEVER] * 4
        for state in range(4):
            for _, cost, end in turn_arcs(turn, state):
                to[end] = min(to[end], f[state] + cost)
        f = to
    return [*out, f]


def backward(turns: list[Turn], b: list[int]) -> list[list[int]]:
    """Costs to the end before each turn and after the last, inserts open."""
    out = [b]
    for turn in reversed(turns):
        out.append(before_inserts([min(cost + out[-1][end] for _, cost, end in turn_arcs(turn, state)) for state in range(4)]))
    return out[::-1]


def least_letters(turns: list[Turn], ahead: list[list[int]], behind: list[list[int]], total: int, state: int) -> tuple[str, int]:
    """The least letters along tight arcs from a state to behind the last turn, and the state there."""
    letters, frontier, i = [], {state}, 0
    while i < len(turns):
        found: dict[str, set[int]] = {}
        for at in frontier:
            if ahead[i][at] + INSERT + behind[i][NEXT[at]] == total:
                found.setdefault("I", set()).add(NEXT[at])
            for letter, cost, end in turn_arcs(turns[i], at):
                if ahead[i][at] + cost + behind[i + 1][end] == total:
                    found.setdefault(letter, set()).add(end)
        letter = min(found)
        letters.append(letter)
        frontier = found[letter]
        i += letter != "I"
    return "".join(letters), min(frontier)


def closing(state: int) -> str:
    """The inserts that end a conversation in a state."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated or none."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        out.append("blank" if is_blank(row[1]) else "duplicate" if row in seen else "truncated" if is_truncated(row[1]) else "")
        seen.add(row)
    return out


def is_blank(text: str) -> bool:
    return not text.strip(_SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


def as_turn(role: str, fault: str) -> Turn:
    return role[:1], fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


class Repaired:
    """The repaired text, hashed as it grows."""

    def __init__(self) -> None:
        self.sha, self.state, self.empty = hashlib.sha256(), BEGIN, True

    def turn(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def edit(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "D":
            return
        self.state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[self.state]
        self.turn(role if letter == "K" else ROLE[self.state], text)


def repair(rows: list[tuple[str, str]], turns: list[int | None]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of (role, text) rows in order."""
    found = faults(rows)
    search = [as_turn(role, fault) for (role, _), fault in zip(rows, found)]
    ahead, behind = forward(search, [0, NEVER, NEVER, NEVER]), backward(search, END)
    total = behind[0][BEGIN]
    audit, state = least_letters(search, ahead, behind, total, BEGIN)
    audit += closing(state)
    text, reading = Repaired(), iter(rows)
    for letter in audit:
        text.edit(letter, *(("", "") if letter == "I" else next(reading)))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    counts = (found.count(x) for x in ("blank", "duplicate", "truncated"))
    return gaps, *counts, illegal_pairs([t[0] for t in search]), total, audit, text.sha.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RAW = "part int, row int, turn long, role string, text string, present boolean, digest binary, blank_row boolean, truncated_row boolean"


def _first_pass(rows: DataFrame, small_rows: int, small_chars: int) -> DataFrame:
    """Of rows (key, conv, turn, role, text, present) in order: results where done, else the rows of a slice."""
    id_type = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("conv", id_type), T.StructField("done", T.BooleanType()), *T.StructType.fromDDL(_DONE), *T.StructType.fromDDL(_RAW)])
    n_done, n_raw = _DONE.count(",") + 1, _RAW.count(",") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kinds, out = TaskContext.get().partitionId(), None, []
        held: list[tuple] = []
        current, first, whole, chars, number = None, True, True, 0, 0

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)
            out.clear()
            return made

        def write_raw() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for key, conv, turn, role, text, present in held:
                digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()[:16]
                out.append((key, conv, False, *[None] * n_done, part, number, turn, role, text, present, digest, is_blank(text), is_truncated(text)))
                number += 1
                if len(out) >= 2000:
                    yield table()
            held.clear()
            if out:
                yield table()

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            if whole and not first and not last:
                rows = [(role, text) for _, _, _, role, text, present in held if present]
                out.append((*held[0][:2], True, *repair(rows, [x[2] for x in held if x[5]]), *[None] * n_raw))
                held.clear()
                if len(out) >= 2000:
                    yield table()
            else:
                yield from write_raw()

        for batch in batches:
            kinds = kinds or [pa.string(), batch.schema.field("conv").type, pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.bool_(), pa.bool_()]
            for at in range(0, batch.num_rows, 512):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if row[0] != current:
                        if current is not None:
                            yield from close(False)
                            first = False
                        current, whole, chars, number = row[0], True, 0, 0
                    held.append(row)
                    chars += len(row[4])
                    if len(held) >= small_rows or chars >= small_chars:
                        whole, chars = False, 0
                        yield from write_raw()
        if current is not None:
            yield from close(True)
        if out:
            yield table()

    return rows.mapInArrow(run, schema)


def _search_rows(slim: pd.DataFrame) -> list[Turn]:
    return list(zip(slim["initial"], slim["must_go"], slim["adds"]))


def _slices(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of slices: turns as the search sees them, and their counts by conversation (gaps, blank, duplicate, truncated)."""
    place = F.struct("part", "row")
    slim = raw.where("present").select("key", "part", "row", "turn", F.substring("role", 1, 1).alias("initial"), "digest", F.col("blank_row").alias("blank"), F.col("truncated_row").alias("open"))
    least = slim.groupBy("key", "digest").agg(F.min(place).alias("least"))
    told = slim.join(least.hint("merge"), ["key", "digest"])
    again = ~F.col("blank") & (place > F.col("least"))
    told = told.select("key", "part", "row", "turn", "initial", "blank", again.alias("again"), (F.col("open") & ~F.col("blank") & ~again).alias("cut"))
    told = settle(told.withColumn("must_go", F.col("blank") | F.col("again")).withColumn("adds", F.when(F.col("cut"), TRUNCATED).otherwise(0)), "slice-turns")
    distinct = told.where("turn is not null").select("key", "turn").distinct()  # before it is counted: no task gathers a conversation's turns
    gaps = distinct.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    count = {name: F.count_if(F.col(c)).alias(name) for name, c in (("blank", "blank"), ("duplicate", "again"), ("truncated", "cut"))}
    return told, told.groupBy("key").agg(*count.values()).join(gaps, "key", "left")


def _matrix(slim: pd.DataFrame) -> pd.DataFrame:
    slim = slim.sort_values("row")
    turns = _search_rows(slim)
    costs = [c for state in range(4) for c in forward(turns, [0 if s == state else NEVER for s in range(4)])[-1]]
    initials = [t[0] for t in turns]
    return pd.DataFrame([(slim["key"].iloc[0], int(slim["part"].iloc[0]), costs, initials[0], initials[-1], illegal_pairs(initials))], columns=["key", "part", "costs", "begin", "end", "illegal"])


def _both_ways(slices: pd.DataFrame) -> pd.DataFrame:
    """Costs from the start and to the end of each slice of a conversation: one row for each partition at most."""
    slices = slices.sort_values("part")
    matrices = [[list(map(int, m[4 * s : 4 * s + 4])) for s in range(4)] for m in slices["costs"]]
    ahead, f = [], [0, NEVER, NEVER, NEVER]
    for m in matrices:
        ahead.append(f)
        f = [min(min(f[s] + m[s][t] for s in range(4)), NEVER) for t in range(4)]
    behind, b = [], END
    for m in reversed(matrices):
        behind.append(b)
        b = [min(min(m[s][t] + b[t] for t in range(4)), NEVER) for s in range(4)]
    edges = illegal_pairs([x for pair in zip(slices["begin"], slices["end"]) for x in pair]) - sum(a + z not in _LEGAL for a, z in zip(slices["begin"], slices["end"]))
    return pd.DataFrame({"key": slices["key"], "part": slices["part"], "ahead": ahead, "behind": behind[::-1], "cost": b[BEGIN], "illegal": int(slices["illegal"].sum()) + edges})


def _letters(slim: pd.DataFrame) -> pd.DataFrame:
    """A slice's letters and last state for every state that an optimal path may enter it in."""
    slim = slim.sort_values("row")
    turns = _search_rows(slim)
    key, part, total = slim["key"].iloc[0], int(slim["part"].iloc[0]), int(slim["cost"].iloc[0])
    start = list(map(int, slim["ahead"].iloc[0]))
    ahead, behind = forward(turns, start), backward(turns, list(map(int, slim["behind"].iloc[0])))
    out = [(key, part, state, *least_letters(turns, ahead, behind, total, state)) for state in range(4) if start[state] + behind[0][state] == total]
    return pd.DataFrame(out, columns=["key", "part", "state", "letters", "to"])


def _chain(moves: pd.DataFrame) -> pd.DataFrame:
    """The state in which each slice of a conversation is entered, and the inserts after the last."""
    to = {(part, state): end for part, state, end in zip(moves["part"], moves["state"], moves["to"])}
    out, state = [], BEGIN
    for part in sorted(set(moves["part"])):
        out.append((moves["key"].iloc[0], part, state, ""))
        state = to[part, state]
    return pd.DataFrame([*out[:-1], (*out[-1][:3], closing(state))], columns=["key", "part", "state", "closing"])


def _read_through(raw: DataFrame, letters: DataFrame, id_type: T.DataType) -> DataFrame:
    """key, conv, audit, repaired_sha256 of conversations in slices: rows stream by in order, each slice led by its letters."""
    told = letters.select("key", "part", F.lit(-1).alias("row"), "letters", "closing")
    rows = raw.select("key", "part", "row", "conv", "role", "text", "present").unionByName(told, allowMissingColumns=True)
    rows = rows.repartition("key").sortWithinPartitions("key", "part", "row")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("conv", id_type), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv, audit, text, pending, after = None, None, [], Repaired(), iter(""), ""
        kind = None

        def result() -> pa.RecordBatch:
            for letter in after:
                text.edit(letter)
            row = (current, conv, "".join(audit) + after, text.sha.hexdigest())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.string(), kind, pa.string(), pa.string()))], schema.names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            for at in range(0, batch.num_rows, 512):
                for key, _, row, conv_id, role, said, present, letters, closing_letters in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if key != current:
                        if current is not None:
                            yield result()
                        current, audit, text, pending, after = key, [], Repaired(), iter(""), ""
                    if row < 0:
                        audit.append(letters)
                        pending, after = iter(letters), closing_letters
                        continue
                    conv = conv_id
                    if present:
                        letter = next(pending)
                        while letter == "I":
                            text.edit(letter)
                            letter = next(pending)
                        text.edit(letter, role, said)
        if current is not None:
            yield result()

    return rows.select("key", "part", "row", "conv", "role", "text", "present", "letters", "closing").mapInArrow(run, schema)


def _in_slices(raw: DataFrame, id_type: T.DataType) -> DataFrame:
    """conv and its results, of conversations that are written in slices."""
    turns, counts = _slices(raw)
    vectors = "array<long>"
    costs = settle(turns.select("key", "part", "row", "initial", "must_go", "adds").groupBy("key", "part").applyInPandas(_matrix, f"key string, part int, costs {vectors}, begin string, end string, illegal long"), "slice-costs")
    ways = settle(costs.groupBy("key").applyInPandas(_both_ways, f"key string, part int, ahead {vectors}, behind {vectors}, cost long, illegal long"), "slice-ways")
    with_ways = turns.select("key", "part", "row", "initial", "must_go", "adds").join(ways.drop("illegal").hint("merge"), ["key", "part"])
    moves = settle(with_ways.groupBy("key", "part").applyInPandas(_letters, "key string, part int, state int, letters string, to int"), "slice-letters")
    chain = moves.select("key", "part", "state", "to").groupBy("key").applyInPandas(_chain, "key string, part int, state int, closing string")
    letters = moves.join(chain, ["key", "part", "state"]).select("key", "part", "letters", "closing")
    totals = counts.join(ways.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal")), "key")
    done = _read_through(raw, letters, id_type).join(totals, "key", "left")
    return done.select("conv", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), "audit", "repaired_sha256")


def repair_conversations(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, small_rows: int = SMALL_ROWS, small_chars: int = SMALL_CHARS
) -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows.

    present: rows for which it is false are none of a conversation's turns, but name it.  small_rows,
    small_chars: what of a conversation a task may hold; they change no result.
    """
    key = F.concat(F.when(F.col(id_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    taken = rows.select(
        key.alias("key"), F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), there.alias("present")
    ).withColumn("tie", F.xxhash64("role", "text")).withColumn("equal", F.rand(5))  # equal rows may part
    order = ["key", "turn", "role", "tie", "equal"]
    read = taken.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "equal")
    passed = settle(_first_pass(read, small_rows, small_chars), "conversations")
    names = [*_COUNTS, "audit", "repaired_sha256"]
    whole = passed.where("done").select("conv", *names)
    raw = passed.where("not done").select("key", "conv", *(x.split()[0] for x in _RAW.split(", ")))
    return whole.unionByName(_in_slices(raw, rows.schema[id_col].dataType)).withColumnRenamed("conv", id_col)
