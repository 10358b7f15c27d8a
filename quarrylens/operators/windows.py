"""Running budgets, rates and streaks; as-of joins.

A key may hold most rows, and a window over it would be one task's work.  So the order column
is cut into slices of a fixed width, and windows run over (key, slice).  What a slice needs of
the slices before it is a carry (a sum, a streak, the version in force), which comes from one
row for each key and slice; a window that looks back a fixed way needs a halo of rows instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of ids and of seconds that are taken where none are named.
ID_SLICE, SECONDS_SLICE = 1024, 86_400


def _sliced(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("slice_", F.floor(F.col(order) / width))


def _carried(df: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """df with what carry (keys, slice_, and one column more) says of each slice; null keys are keys."""
    right = carry.select(*(F.col(k).alias(f"{k}_of") for k in keys), F.col("slice_").alias("slice_of"), carry.columns[-1])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys), F.col("slice_") == F.col("slice_of"))
    return df.join(right.hint("merge"), same, "left").drop(*(f"{k}_of" for k in keys), "slice_of")


def _before(keys: Sequence[str]) -> Window:
    """The slices of a key before one: a row for each."""
    return Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, name: str) -> DataFrame:
    """df with the sum of value over the key's rows up to and with each; the first of order is a number, cut into slices of a width."""
    cut = _sliced(df, order[0], width)
    totals = cut.groupBy(*keys, "slice_").agg(F.sum(value).alias("total_"))
    carry = totals.select(*keys, "slice_", F.sum("total_").over(_before(keys)).alias("carry_"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = _carried(cut.withColumn("inside_", inside), keys, carry)
    return both.withColumn(name, F.col("inside_") + F.coalesce("carry_", F.lit(0))).drop("slice_", "inside_", "carry_")


def prefix_budget(df: DataFrame, keys: Sequence[str], order: str, cost: str, most: int, width: int = ID_SLICE) -> DataFrame:
    """Rows of each key up to the first that would exceed the budget, with used; costs are not negative, so nothing re-enters."""
    return running_sum(df, keys, [order], cost, width, "used").where(F.col("used") <= most)


def call_budget(df: DataFrame, keys: Sequence[str], order: str, wants: str, most: int, width: int = ID_SLICE) -> DataFrame:
    """action of each row: skipped once the calls before it have spent the budget (hits too), else call or hit."""
    summed = running_sum(df.withColumn("one_", F.col(wants).cast("int")), keys, [order], "one_", width, "spent")
    spent = summed.withColumn("spent", F.col("spent") - F.col("one_")).drop("one_")
    return spent.withColumn("action", F.when(F.col("spent") >= most, "skipped").when(F.col(wants), "call").otherwise("hit"))


def range_rate(df: DataFrame, key: str, at: str, tokens: str, seconds: int, width: int | None = None) -> DataFrame:
    """requests and tokens_in_window of the last seconds, the row's own second included.

    A slice is ``width`` seconds, 24 windows unless named; rows of the last window of a slice
    also stand, as a halo, at the head of the next.  Spark sums a sliding window anew for each
    row, so its work would grow with the square of a window's rows.  Here a slice is cut into
    blocks as long as a window, which is then the end of one block and the head of the next:
    two running sums.
    """
    width = width or 24 * max(seconds, 1)
    if width < seconds:
        raise ValueError("a slice must hold a window")
    kind = df.select(F.sum(tokens)).schema[0].dataType
    cut = _sliced(df, at, width)
    halo = cut.where(F.col(at) >= (F.col("slice_") + 1) * width - seconds).withColumn("slice_", F.col("slice_") + 1)
    rows = cut.withColumn("own_", F.lit(True)).union(halo.withColumn("own_", F.lit(False))).repartition(key, "slice_")
    # each row stands in its block, and once more, late, in the next; rows without a time are one block
    twice = rows.withColumn("late_", F.explode(F.when(F.col(at).isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    block = F.floor(F.col(at) / seconds) if seconds else F.col(at)
    placed = twice.withColumn("block_", block + F.col("late_").cast("int")).withColumn("from_", F.when(F.col("late_"), F.col(at)).otherwise(F.col(at) - seconds))
    by = Window.partitionBy("block_", key, "slice_")
    head, end = (by.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("from_").asc(), F.col("from_").desc()))
    here, late = F.when(~F.col("late_"), F.col(tokens)), F.when(F.col("late_"), F.col(tokens))
    summed = placed.withColumn("n_head_", F.count_if(~F.col("late_")).over(head)).withColumn("head_", F.sum(here).over(head))
    summed = summed.withColumn("n_end_", F.count_if("late_").over(end)).withColumn("end_", F.sum(late).over(end)).where("own_ and not late_")
    both = F.coalesce(F.col("head_") + F.col("end_"), "head_", "end_").cast(kind)
    return summed.withColumn("requests", F.col("n_head_") + F.col("n_end_")).withColumn("tokens_in_window", both).select(*df.columns, "requests", "tokens_in_window")


def failure_streak(df: DataFrame, key: str, order: Sequence[str], failed: str, width: int = SECONDS_SLICE) -> DataFrame:
    """streak: failures since the key's last success.  The first of order is a number, cut into slices of a width."""
    cut = _sliced(df, order[0], width)
    good, place = ~F.col(failed), F.struct(*order)
    inside = Window.partitionBy(key, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("wins_", F.sum(good.cast("int")).over(inside))
    within = Window.partitionBy(key, "slice_", "wins_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("inside_", F.sum(F.col(failed).cast("long")).over(within))
    # of a slice: has it a success, and how many failures follow the last one
    facts = marked.groupBy(key, "slice_").agg((F.max("wins_") > 0).alias("any_"), F.max_by("inside_", place).alias("tail_"))
    era = F.sum(F.col("any_").cast("int")).over(Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, 0))
    so_far = F.sum("tail_").over(Window.partitionBy(key, "era_").orderBy("slice_").rowsBetween(Window.unboundedPreceding, 0))
    ends = facts.withColumn("era_", era).withColumn("ends_", so_far)
    carry = ends.select(key, "slice_", F.lag("ends_").over(Window.partitionBy(key).orderBy("slice_")).alias("carry_"))
    both = _carried(marked, [key], carry)
    return both.withColumn("streak", F.col("inside_") + F.when(F.col("wins_") == 0, F.coalesce("carry_", F.lit(0))).otherwise(0)).drop("slice_", "wins_", "inside_", "carry_")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, take: Sequence[str], width: int = SECONDS_SLICE) -> DataFrame:
    """left with the columns to take of the last row of right, by its since, at or before each row's own time; null where there is none.

    Rows of right that tie in keys and since are told apart by what is taken, the greatest wins.
    """
    found = F.struct(*take)
    versions = _sliced(right.select(*keys, F.col(since).alias("at_"), found.alias("found_")), "at_", width)
    rows = _sliced(left.withColumn("at_", F.col(at)), "at_", width)
    last = versions.groupBy(*keys, "slice_").agg(F.max(F.struct("at_", "found_")).alias("last_"))
    places = last.unionByName(rows.select(*keys, "slice_").distinct(), allowMissingColumns=True).groupBy(*keys, "slice_").agg(F.max("last_").alias("last_"))
    carry = places.select(*keys, "slice_", F.last("last_.found_", ignorenulls=True).over(_before(keys)).alias("carry_"))
    both = rows.withColumn("own_", F.lit(True)).unionByName(versions.withColumn("own_", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "slice_").orderBy("at_", "own_", "found_").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen_", F.last("found_", ignorenulls=True).over(inside)).where("own_")
    out = _carried(seen, keys, carry).withColumn("seen_", F.coalesce("seen_", "carry_"))
    return out.select(*left.columns, *(F.col(f"seen_.{c}").alias(c) for c in take))
