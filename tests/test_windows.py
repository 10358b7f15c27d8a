import json
import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.operators import pool as P
from quarrylens.operators import windows as W

ROWS = "key string, id long, at long, n long, bad boolean"


def rows_of(r, n, keys):
    return [(r.choice(keys), i, r.randrange(300), r.randrange(9), r.random() < 0.6) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_two_levels_agree_with_one_history(spark, width):
    r = random.Random(width)
    rows = rows_of(r, 400, ["a", "b", None])
    df = spark.createDataFrame(rows, ROWS)
    by = {k: sorted((x for x in rows if x[0] == k), key=lambda x: x[1]) for k in ("a", "b", None)}
    used, actions = {}, {}
    for k, mine in by.items():
        total = spent = 0
        for x in mine:
            total += x[3]
            used[x[1]] = total
            actions[x[1]] = "skipped" if spent >= 30 else "call" if x[4] else "hit"
            spent += x[4]
    assert {x.id: x.used for x in W.prefix_budget(df, ["key"], "id", "n", 150, width).collect()} == {i: n for i, n in used.items() if n <= 150}
    assert {x.id: x.action for x in W.call_budget(df, ["key"], "id", "bad", 30, width).collect()} == actions
    streak, rate = {}, {}
    for k, mine in by.items():
        now = 0
        for x in sorted(mine, key=lambda x: (x[2], x[1])):
            now = now + 1 if x[4] else 0
            streak[x[1]] = now
            seen = [y for y in mine if x[2] - 6 <= y[2] <= x[2]]
            rate[x[1]] = (len(seen), sum(y[3] for y in seen))
    assert {x.id: x.streak for x in W.failure_streak(df, "key", ["at", "id"], "bad", width).collect()} == streak
    if width >= 6:
        assert {x.id: (x.requests, x.tokens_in_window) for x in W.range_rate(df, "key", "at", "n", 6, width).collect()} == rate
    else:
        with pytest.raises(ValueError):
            W.range_rate(df, "key", "at", "n", 6, width)


def test_a_window_is_not_summed_anew_for_each_row(spark, capsys):
    """A frame that slides costs the square of a window's rows; running sums do not."""
    rows = spark.range(40_000).select(F.lit("k").alias("key"), "id", F.floor(F.col("id") / 2).alias("at"), (F.col("id") % 9).alias("n"))
    out = W.range_rate(rows, "key", "at", "n", 1_000)
    out.explain("extended")
    plan = capsys.readouterr().out
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
    got = {x.id: (x.requests, x.tokens_in_window) for x in out.collect()}
    sums = [0]
    for i in range(40_000):
        sums.append(sums[-1] + i % 9)
    first, last = (lambda i: 2 * max(i // 2 - 1_000, 0)), (lambda i: i | 1)
    assert got == {i: (last(i) - first(i) + 1, sums[last(i) + 1] - sums[first(i)]) for i in range(40_000)}


@pytest.mark.parametrize("kind, seconds, width", [("long", 0, None), ("double", 6, 7), ("decimal(9,2)", 6, None)])
def test_range_rate_takes_what_a_range_frame_takes(spark, kind, seconds, width):
    """Null times and tokens, times before zero, huge tokens beside small ones, ties: as Spark's own frame, types too."""
    r = random.Random(seconds)
    n = lambda: r.choice([None, None, 1.0, 2.5, 1e17 if kind == "double" else 7.0])
    rows = [(r.choice(["a", None]), i, r.choice([None, *range(-20, 40)]), n()) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, id long, at long, n double").withColumn("n", F.col("n").cast(kind))
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0)
    want = df.withColumn("requests", F.count("*").over(w)).withColumn("tokens_in_window", F.sum("n").over(w))
    got = W.range_rate(df, "key", "at", "n", seconds, width)
    assert got.dtypes == want.dtypes
    found, meant = ({x.id: (x.requests, x.tokens_in_window) for x in d.collect()} for d in (got, want))
    if kind == "double":
        meant = {i: (c, None if v is None else pytest.approx(v, rel=1e-12)) for i, (c, v) in meant.items()}
    assert found == meant and len(found) == 300


@pytest.mark.parametrize("width", [1, 40, 10_000])
def test_as_of(spark, width):
    r = random.Random(width)
    left = [(r.choice(["a", "b", None, "z"]), i, r.randrange(200)) for i in range(300)]
    right = [(r.choice(["a", "b", None]), r.randrange(200), f"v{i}") for i in range(40)]
    got = W.as_of(spark.createDataFrame(left, "key string, id long, at long"), spark.createDataFrame(right, "key string, since long, label string"), ["key"], "at", "since", ["label"], width).collect()
    want = {i: max(((s, v) for k, s, v in right if k == key and s <= at), default=(0, None))[1] for key, i, at in left}
    assert {x.id: x.label for x in got} == want and len(got) == 300


def test_one_hot_key_is_spread(spark):
    """With a single key no task has twice as many rows as the median one."""
    df = spark.range(60_000).select(F.lit("k").alias("key"), "id", F.col("id").alias("at"), (F.col("id") % 7).alias("n"), (F.col("id") % 3 == 0).alias("bad"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        for out in (
            W.running_sum(df, ["key"], ["id"], "n", 256, "used"),
            W.range_rate(df, "key", "at", "n", 10, 240),
            W.failure_streak(df, "key", ["at", "id"], "bad", 256),
            W.as_of(df.select("key", "id", "at"), df.where("id % 10 = 0").select("key", F.col("id").alias("since"), "n"), ["key"], "at", "since", ["n"], 256),
        ):
            sizes = [x.n for x in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(out.columns[-1])).collect()]
            assert len(sizes) == 8 and max(sizes) < 2 * median(sizes), sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def version(at, price, enabled="true", name="m"):
    return '{"valid_from": %d, "models": [{"name": "%s", "price_in": %s, "price_out": ${OUT}, "enabled": %s}]}' % (at, name, price, enabled)


def test_pool_versions_are_read_anew(spark, tmp_path):
    pool, source = tmp_path / "pool", tmp_path / "in"
    pool.mkdir(), source.mkdir()
    (pool / "1.json").write_text(version(10, 1.0))
    (pool / "odd.json").write_text("{not a pool")
    calls = "name string, event_id long, at long, tokens_in long, tokens_out long"

    def run():
        P.stream_priced(spark.readStream.schema(calls).json(str(source)), str(pool), str(tmp_path / "sink"), str(tmp_path / "c"), {"OUT": "2.0"}).awaitTermination(120)
        return {x.event_id: (x.version, x.cost) for x in spark.read.parquet(str(tmp_path / "sink")).collect()}

    call = lambda i, at, name="m": json.dumps({"name": name, "event_id": i, "at": at, "tokens_in": 1000, "tokens_out": 500})
    (source / "a.json").write_text("\n".join([call(1, 5), call(2, 10), call(3, 25), call(4, 25, "other")]))
    assert run() == {1: (None, None), 2: (10, 2.0), 3: (10, 2.0), 4: (None, None)}
    (pool / "2.json").write_text(version(20, 3.0))
    (pool / "3.json").write_text(version(40, 3.0, "false"))
    (source / "b.json").write_text("\n".join([call(5, 25), call(6, 19), call(7, 41)]))
    got = run()
    assert got[3] == (10, 2.0) and {i: got[i] for i in (5, 6, 7)} == {5: (20, 4.0), 6: (10, 2.0), 7: (40, None)}
