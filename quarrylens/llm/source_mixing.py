"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a share of a total budget, by weight, and at most ``most_times`` its
size; what a cap cuts off goes to the others by weight until none is above.  A source gives
all its documents as many whole times as fit.  The rest of its budget is fitted over the
counts of documents by exact length:

1. each length gives the same fraction of its documents, rounded down;
2. lengths with the largest rounded-off parts give one more document each while ``dp_words``
   stay open;
3. bounded-knapsack dynamic programming over the documents not yet given fills what is open.

Where that does not reach the lengths' common divisor, beyond which no choice can go, steps 1 to
3 run once more with ``longest_times`` the longest text left open from the start, so that
documents are given back and several of each length are free; the nearer of the two stands.  A
budget within that span is open whole, and its remainder then is the smallest of all choices.
The programme counts in units of the lengths' common divisor.  Beyond ``MOST_SUMS`` sums it
counts in larger units, lengths rounded up, and once more over what that left.

Then each length gives its number of documents in order of a seeded hash.  A length's
documents are counted by slices of the hash, as many as the table's rows ask for; slices before
the last one needed are taken whole, and only documents of that slice are ranked, so no group is
gathered in one task.

Defined cases: null text has size 0 and gives nothing; null is a source like any other and
comes last; a null or repeated doc_id is a row of its own; rows that tie in id, text hash and
so in the order are told apart by nothing, and any of them may be taken; a very long text is one
document of its length; an empty table gives no rows; a source without words has target 0; other
columns travel along in ``mix_sources`` and are not read in the query.  A row for each source
goes to the driver, where the targets are shared out.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import fresh_name, settle, word_count

WEIGHTS = (5, 2, 1)
BUDGET_PCT = 150
MOST_TIMES = 2
SEED = 7
SLICES = 64
#: A slice of the hash holds about this many rows of the whole table.
SLICE_ROWS = 1 << 16
#: What stays open for the dynamic programme: this many words, and this many times the longest text.
DP_WORDS = 1 << 16
LONGEST_TIMES = 8
#: Sums the programme may hold, at five bytes each.
MOST_SUMS = 1 << 24
#: Plans of up to this many sources are broadcast, of more joined by merge.
MOST_SENT = 10_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, budget_pct: int = BUDGET_PCT, most_times: int = MOST_TIMES) -> dict[str | None, Fraction]:
    """The target of each source: weights repeat over the sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = Fraction(sum(sizes.values()) * budget_pct, 100)
    out: dict[str | None, Fraction] = {}
    free = list(order)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most_times * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = Fraction(most_times * sizes[s])
            left -= out[s]
        left = max(left, Fraction(0))
        free = [s for s in free if s not in out]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS, longest_times: int = LONGEST_TIMES, most_sums: int = MOST_SUMS) -> np.ndarray:
    """How many documents of each length to take so that their words come near to the budget from below."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts
    least = budget % int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))  # no choice leaves less
    best = None
    for held, open_ in ((0, dp_words), (max(dp_words, longest_times * int(lengths.max())),) * 2):
        given = max(0, budget - held)
        take = np.array([int(c) * given // total for c in counts], np.int64)
        part = [int(c) * given % total for c in counts]  # what rounding down took off, in 1 / total
        left = budget - int((lengths * take).sum())
        for i in sorted(range(len(lengths)), key=lambda i: (-part[i], -int(lengths[i]))):
            if part[i] and left - int(lengths[i]) >= open_:
                take[i] += 1
                left -= int(lengths[i])
        for _ in range(2):
            take = take + fill_up(lengths, counts - take, left, most_sums)
            left = budget - int((lengths * take).sum())
        if best is None or left < best[0]:
            best = left, take
        if left == least:
            break
    return best[1]


def fill_up(lengths: np.ndarray, counts: np.ndarray, left: int, most_sums: int = MOST_SUMS) -> np.ndarray:
    """How many of each length to take so that the sum comes nearest to left from below.

    Five bytes for each unit of left.  With more than most_sums units the unit grows and lengths
    are rounded up to it, which may leave as many units open as documents are taken.
    """
    take = np.zeros(len(lengths), np.int64)
    useful = (counts > 0) & (lengths > 0) & (lengths <= left)
    if not useful.any():
        return take
    unit = int(np.gcd.reduce(lengths[useful]))
    whole = min(left, int((lengths * counts)[useful].sum()))
    unit *= max(1, -(-(whole // unit) // most_sums))
    lengths = -(-lengths // unit)
    left //= unit
    left = min(left, int((lengths * counts)[useful].sum()))
    # binary multiples of each length, as items of the programme
    items: list[tuple[int, int]] = []
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    by = np.full(left + 1, -1, np.int32)  # the item by which a sum was first reached
    top = 0  # the largest sum so far
    for i in np.argsort(-lengths, kind="stable"):
        if not useful[i]:
            continue
        size = int(lengths[i])
        if size > left:
            continue
        spare = min(int(counts[i]), left // size)
        part = 1
        while spare > 0:
            n = min(part, spare)
            weight = n * size
            end = min(left, top + weight)
            new = np.flatnonzero(reach[: end + 1 - weight] & ~reach[weight : end + 1]) + weight
            reach[new] = True
            by[new] = len(items)
            top = max(top, int(new[-1])) if len(new) else top
            items.append((int(i), n))
            spare -= n
            part *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def result_names(carried: list[str]) -> list[str]:
    """What size, source_size, target and taken are called beside these columns."""
    names: list[str] = []
    for name in ("size", "source_size", "target", "taken"):
        names.append(fresh_name([*carried, *names], name))
    return names


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_columns: list[str] | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    budget_pct: int = BUDGET_PCT,
    most_times: int = MOST_TIMES,
    seed: int = SEED,
    slices: int = SLICES,
) -> DataFrame:
    """The kept columns of every row of docs (all unless named) with size, source_size, target and taken (words, repeats counted)."""
    spark = docs.sparkSession
    carried = docs.columns if keep_columns is None else keep_columns
    names = result_names(carried)
    size, source_size, target, taken = names
    source, order, slice_, rank = (fresh_name([*carried, *names], name) for name in ("mix_source", "mix_order", "mix_slice", "mix_rank"))
    mark = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    rows = settle(
        docs.select(*(docs[c] for c in carried), docs[source_col].alias(source), word_count(docs[text_col]).alias(size), mark.alias(order), F.shiftrightunsigned(mark, 33).cast("int").alias(slice_)),
        "mix-sizes",
    )
    slices = max(slices, -(-rows.count() // SLICE_ROWS))
    rows = rows.withColumn(slice_, F.pmod(F.col(slice_), F.lit(slices)))

    cells = settle(rows.groupBy(source, size, slice_).agg(F.count("*").alias("n")), "mix-cells")
    totals = {r[0]: int(r[1]) for r in cells.groupBy(source).agg(F.sum(F.col(size) * F.col("n"))).collect()}  # a row for each source
    goals = targets(totals, weights, budget_pct, most_times)
    plan = []
    for s, words in totals.items():
        times = int(goals[s] // words) if words else 0
        plan.append((s, words, float(goals[s]), times, round(goals[s] - times * words)))
    how = "broadcast" if len(plan) <= MOST_SENT else "merge"
    plans = spark.createDataFrame(plan, f"`{source}` string, `{source_size}` long, `{target}` double, times long, rest long")

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        got = fit_budget(frame["len"].to_numpy(), frame["n"].to_numpy(), int(frame["rest"].iloc[0]))
        return pd.DataFrame({"src": frame["src"], "len": frame["len"], "need": got})

    lengths = cells.join(plans.hint(how), cells[source].eqNullSafe(plans[source])).where(F.col(size) > 0).groupBy(cells[source].alias("src"), F.col(size).alias("len")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    needs = lengths.groupBy("src").applyInPandas(fit, "src string, len long, need long")  # a row for each length of a source

    so_far = Window.partitionBy(source, size).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))  # at most `slices` rows for each length
    decided = counted.join(needs, counted[source].eqNullSafe(needs["src"]) & (counted[size] == needs["len"])).select(
        counted[source].alias("d_source"), counted[size].alias("d_size"), counted[slice_].alias("d_slice"), F.greatest(F.lit(0), F.col("need") - F.col("before")).alias("room"), "n"
    ).where("room > 0")
    joined = rows.join(decided, rows[source].eqNullSafe(F.col("d_source")) & (rows[size] == F.col("d_size")) & (rows[slice_] == F.col("d_slice")), "left")
    joined = joined.drop("d_source", "d_size", "d_slice")
    whole = joined.where("room is null or room >= n").withColumn("once", F.col("room").isNotNull())
    cut = joined.where("room < n").withColumn(rank, F.row_number().over(Window.partitionBy(source, size, slice_).orderBy(order, *[c for c in [id_col] if c in carried])))
    cut = cut.withColumn("once", F.col(rank) <= F.col("room")).drop(rank)
    out = whole.unionByName(cut).join(plans.withColumnRenamed(source, "p_source").hint(how), F.col(source).eqNullSafe(F.col("p_source")))
    return out.select(*carried, size, source_size, target, (F.col(size) * (F.col("times") + F.col("once").cast("long"))).alias(taken))
