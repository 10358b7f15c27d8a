import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylens.llm import sharding as H

DOCS = "doc_id long, text string, shard string, slot int, bucket int"


def table(spark):
    rows = [(i, f"text {i} é" * (i % 5), "s", 0, 0) for i in range(500)] + [(3, "again", None, 1, 1)] * 3 + [(None, None, None, None, None), (900, "x" * 300_000, "", 0, 0), (901, "", "", 0, 0)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_law_slots_and_columns(spark):
    rows, docs = table(spark)
    got = H.shuffle_into_shards(docs, bucket_bytes=20_000).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard, r.slot, r.bucket) for r in got))) == sorted(map(str, rows))
    for r in got:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    for s in range(8):
        assert sorted(r._slot for r in got if r._shard == s) == list(range(sum(r._shard == s for r in got)))
    assert max(Counter(r._shard for r in got).values()) < 2 * len(rows) / 8
    assert len({r._shard for r in got if r.doc_id == 3}) == 1


def test_order_is_shuffled_and_repeats(spark):
    _, docs = table(spark)
    order = lambda d: [r.doc_id for r in H.shuffle_into_shards(d, bucket_bytes=20_000).where("_shard = 2").orderBy("_slot").collect()]
    first = order(docs)
    assert first == order(docs.repartition(5)) and first != sorted(first)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(5000)
    moved = ids.select(H.rendezvous(F.col("id"), 8, 1).alias("a"), H.rendezvous(F.col("id"), 9, 1).alias("b")).where("a <> b").groupBy("b").count().collect()
    assert [r.b for r in moved] == [8] and 400 < moved[0]["count"] < 700


def test_no_python_in_the_plan(spark):
    _, docs = table(spark)
    plan = H.shuffle_into_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert H.shuffle_into_shards(spark.createDataFrame([], DOCS)).count() == 0


def draw(seed, *values):
    """Spark's 64-bit hash of ints and longs, one after another from 42."""
    h = 42
    for v, code in ((seed, "<i"), *values):
        h = xxhash.xxh64_intdigest(struct.pack(code, v), h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("shards", [1, 8, 9])
def test_shards_by_brute_force(spark, shards):
    ids = [0, 1, -7, 5_000_000_000, *range(100, 300)]
    docs = spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string")
    want = {i: max((draw(H.SEED, (k, "<i"), (i, "<q")), k) for k in range(shards))[1] for i in ids}
    assert {r.doc_id: r.shard for r in H.shuffle_into_shards(docs, shards=shards).collect()} == want


def test_rows_that_tie_keep_their_slots(spark):
    docs = spark.createDataFrame([(5, "same", f"other {i}", {"k": i}) for i in range(40)], "doc_id long, text string, other string, more map<string,int>")
    seen = {tuple(sorted((r.slot, r.other, r.more["k"]) for r in H.shuffle_into_shards(docs.repartition(n), bucket_bytes=1 << 20).collect())) for n in (1, 7)}
    assert len(seen) == 1
    plain = docs.drop("more")
    seen = {tuple(sorted((r.slot, r.other) for r in H.shuffle_into_shards(plain.repartition(n), bucket_bytes=1000).collect())) for n in (1, 2, 3, 7)}
    assert len(seen) == 1


def test_equal_rows_are_dealt_over_the_buckets_of_their_shard(spark):
    rows = [(1, "hot", "s", 0, None)] * 2000 + [(i, f"t{i}", None, 1, 1) for i in range(2, 200)]
    seen = []
    for n in (1, 5):
        got = H.shuffle_into_shards(spark.createDataFrame(rows, DOCS).repartition(n), bucket_bytes=10_000).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
        for s in range(8):
            assert sorted(r._slot for r in got if r._shard == s) == list(range(sum(r._shard == s for r in got)))
        seen.append(sorted((r._shard, r._slot, r.doc_id) for r in got))
    assert seen[0] == seen[1]
    hot = {r[0] for r in seen[0] if r[2] == 1}
    inside = [r[2] == 1 for r in seen[0] if r[0] in hot]
    assert not all(inside[:900]) or not all(inside[-900:])  # other rows of the shard stand among them


def test_a_wide_column_makes_more_buckets(spark, monkeypatch):
    tasks = []
    kind = type(spark.range(1))
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, c: tasks.append(n) or real(self, n, c))
    thin = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    H.shuffle_into_shards(thin, bucket_bytes=20_000)
    H.shuffle_into_shards(thin.withColumn("wide", F.repeat(F.lit("w"), 3000)), bucket_bytes=20_000)
    assert tasks[0] == 8 and tasks[1] > 25


def test_buckets_may_share_tasks(spark, monkeypatch):
    _, docs = table(spark)
    order = lambda: sorted((r._shard, r._slot, str(r.doc_id), r.text) for r in H.shuffle_into_shards(docs, bucket_bytes=20_000).collect())
    one = order()
    monkeypatch.setattr(H, "MOST_TASKS", 5)
    two = order()
    assert [r[:2] for r in one] == [r[:2] for r in two] and order() == two
