import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import conversation_repair as X
from quarrylens.llm import queries

ROWS = "conv_id long, turn long, role string, text string, gaps int, key string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def least_by_states(turns):
    """Least (cost, audit) by one pass from the start that keeps whole strings."""
    best = {0: (0, "")}
    for initial, must_go, adds in turns:
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):  # inserts, of which two may follow each other
            if s in best:
                best[t] = min(best.get(t, (X.NEVER, "")), (best[s][0] + 2, best[s][1] + "I"))
        new = {}
        for s, (cost, audit) in best.items():
            for letter, more, t in X.turn_arcs((initial, must_go, adds), s):
                new[t] = min(new.get(t, (X.NEVER, "")), (cost + more, audit + letter))
        best = new
    ends = [(c + 2 * n, a + "I" * n) for s, n in ((0, 0), (3, 0), (2, 1), (1, 2)) if s in best for c, a in [best[s]]]
    return min(ends)


def least_of_all(turns, most):
    """Least (cost, audit) of every sequence of edits under a bound, by trying them."""
    found = []

    def go(i, roles, cost, audit):
        if cost > most:
            return
        if i == len(turns) and GRAMMAR.fullmatch(roles):
            found.append((cost, audit))
        for role in "ua":
            go(i, roles + role, cost + 2, audit + "I")
        if i < len(turns):
            initial, must_go, adds = turns[i]
            go(i + 1, roles, cost + 3, audit + "D")
            if not must_go:
                go(i + 1, roles + initial, cost + adds, audit + "K")
                for role in "ua":
                    go(i + 1, roles + role, cost + adds + 2, audit + "R")

    go(0, "", 0, "")
    return min(found)


def by_arcs(turns):
    ahead, behind = X.forward(turns, [0, X.NEVER, X.NEVER, X.NEVER]), X.backward(turns, X.END)
    total = behind[0][0]
    letters, state = X.least_letters(turns, ahead, behind, total, 0)
    return total, letters + X.closing(state)


def test_tight_arcs_against_all_edits():
    kinds = [(r, m, 0 if m else a) for r in "suax" for m, a in ((False, 0), (False, 1), (True, 0))]
    for n in range(3):
        for turns in itertools.product(kinds, repeat=n):
            got = by_arcs(list(turns))
            assert got == least_by_states(turns) == least_of_all(turns, got[0])
    r = random.Random(1)
    for _ in range(3000):
        turns = [r.choice(kinds) for _ in range(r.randrange(3, 30))]
        assert by_arcs(turns) == least_by_states(turns)


def brute(rows):
    """The results of (turn, role, text) rows, whose order settles all but equal rows."""
    rows = [(t, " " if role is None else role, " " if text is None else text) for t, role, text in rows]
    found, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    turns = [(role[:1], f in ("blank", "duplicate"), int(f == "truncated")) for (_, role, _), f in zip(rows, found)]
    cost, audit = least_by_states(turns)
    out, at = [], 0
    for letter in audit:
        roles = "".join(x[0][:1] for x in out)
        wanted = "assistant" if roles.endswith("u") else "user"
        if letter == "I":
            out.append((wanted, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            out.append((role if letter == "K" else wanted, text))
    assert GRAMMAR.fullmatch("".join(x[0][:1] for x in out)) and at == len(rows)
    known = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha


@pytest.mark.parametrize("small_rows,parts", [(4096, 4), (1, 1), (7, 6)])
def test_against_brute_force(spark, small_rows, parts):
    r = random.Random(small_rows)
    by = {}
    for conv in [*range(40), None]:
        turns = sorted(r.sample(range(2000), r.choice([1, 2, 3, 8, 20]) if conv != 7 else 900))
        # one row to a turn, so that the order is settled; a repeat follows at once
        rows = [(t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "No", "", " \n", "Why?", "é…", None, f"word {t}!", f"cut {t}"])) for t in turns]
        by[conv] = [x for row in rows for x in [row] * r.choice([1, 1, 1, 2])]
    by[3] = [(None, "user", "Hm."), *by[3]]
    by[4] = [(None, "user", "Hm.")]
    flat = [(c, *x, 1, "clash") for c, rows in by.items() for x in rows] + [(99, 1, "user", "x", 1, "gone")]
    df = spark.createDataFrame(flat, ROWS).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = X.repair_conversations(df, present=F.col("key") == "clash", small_rows=small_rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(by) + 1
    for row in got:
        want = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) if row.conv_id == 99 else brute(by[row.conv_id])
        assert tuple(row)[1:] == want, row.conv_id


def test_damage_and_odd_rows_agree_with_sql(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.choice([None, *range(6)]), r.choice([None, *range(40)]), r.choice(["user", "assistant", "system", None]), r.choice([None, "", f"A{i}. B!", f"cut{i}", "same."])) for i in range(300)]
    rows = list({(c, t): (c, t, a, b) for c, t, a, b in rows}.values())  # a turn is there once: its order is settled
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op12_conversation_repair"])
    got = queries.QUERIES["op12_conversation_repair"](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_defined_cases(spark):
    assert X.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0
    long = "x" * 5_000_000
    row = X.repair_conversations(spark.createDataFrame([(1, 0, "user", long, 0, ""), (1, 1, "assistant", "Yes.", 0, "")], ROWS)).first()
    assert row.audit == "KK" and row.cost == 1 and row.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest()
