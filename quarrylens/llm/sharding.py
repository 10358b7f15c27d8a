"""Sharding: a two-pass external shuffle, by DataFrame functions alone.

Pass one scatters the rows uniformly over buckets that fit in memory: seeded hashes of the id
choose the shard, and a hash of the whole row a bucket inside the shard.  Pass two takes each
bucket whole, brings it into a fixed order, applies Spark's Fisher-Yates ``shuffle`` with the
seed, and writes it.  A shard is its buckets one after another, so slots run from 0 without
gaps.  Where a bucket begins in its shard travels as a row of its own with the scattered rows,
so all rows cross the network once and nothing is joined to them.

The law is ``key``: doc_id and the number of shards alone decide.  Each shard draws a hash with
the id and the greatest wins (rendezvous hashing), so one more shard takes rows only into
itself, and shards get near equal shares.

A shard has as many buckets as its own bytes need, all columns counted, so a bucket stays near
``bucket_bytes`` at any size and under a hot id.  Rows equal in every column would share one
bucket: those that together exceed half a bucket are counted first, travel once with their
number, and are dealt evenly over all buckets of their shard.

Defined cases: null text has no bytes and the checksum of the empty text; a null id is a key
like any other; the order inside a bucket is that of two hashes of the whole row and then of
its columns, so rows that tie in all of them are equal and may trade places; repeated rows are
all placed, in slots of their own; a very long text is a row like any other and makes its bucket
longer by its own size; an empty table gives empty shards; other columns travel along, and
result columns whose names are taken get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import fresh_name, scratch_path, settle

SHARDS = 8
SEED = 20240607
BUCKET_BYTES = 16 << 20
#: A row in memory beside its columns.
ROW_BYTES = 64
#: Buckets share tasks beyond this number.
MOST_TASKS = 20_000
#: Hot rows are told apart by a broadcast up to this number of hashes, by a merge join beyond.
MOST_SENT = 100_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is greatest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["i"]


def _ordered(kind: T.DataType) -> bool:
    """Can values of this type be ordered and hashed?"""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def _hashable(docs: DataFrame) -> list[Column]:
    """Columns to hash for all of docs' columns; whether each is null counts too."""
    out = []
    for f in docs.schema:
        out += [docs[f.name] if _ordered(f.dataType) else F.to_json(F.struct(docs[f.name])), docs[f.name].isNull()]
    return out


def _row_bytes(docs: DataFrame) -> Column:
    """About what a row takes in memory."""
    total = F.lit(ROW_BYTES).cast("long")
    for f in docs.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(docs[f.name]), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(docs[f.name]))), F.lit(0))
        else:
            total = total + 8
    return total


def shuffle_into_shards(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write docs in shards under folder (of the shared folder unless named) and read them back.

    The files are Parquet, partitioned by shard; rows carry the input's columns with size,
    text_crc32, slot and shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    names: list[str] = []
    for name in ("size", "text_crc32", "slot", "shard"):
        names.append(fresh_name([*docs.columns, *names], name))
    size, crc, slot, shard = names
    home = rendezvous(docs[id_col], shards, seed)
    parts = _hashable(docs)
    mark = F.xxhash64(F.lit(seed + 1), *parts)

    # what each row holds, by its hash: some thirty bytes a row
    marks = settle(docs.select(home.alias("home"), mark.alias("h"), _row_bytes(docs).alias("b")).groupBy("home", "h").agg(F.count("*").alias("n"), F.sum("b").alias("b")), "shard-marks")
    held = {r[0]: int(r[1]) for r in marks.groupBy("home").agg(F.sum("b")).collect()}  # a row a shard
    many = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(many[:s]) for s in range(shards)]
    buckets = sum(many)

    def of_shard(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)

    def bucket_of(at: Column, code: Column, copy: Column | None = None) -> Column:
        spot = F.pmod(F.xxhash64(F.lit(seed + 2), code), of_shard(many, at).cast("long"))
        return (of_shard(first, at) + (spot if copy is None else F.pmod(spot + copy, of_shard(many, at).cast("long")))).cast("int")

    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    row = F.struct(mark.alias("h"), F.xxhash64(F.lit(seed + 3), *parts).alias("h2"), (F.octet_length(raw).cast("long") + 1).alias("s"), F.crc32(raw).alias("c"), *own)
    rows = docs.select(home.alias("home"), mark.alias("h"), row.alias("row"), F.lit(1).cast("long").alias("copies"))
    hot = marks.where(f"n > 1 and 2 * b > {int(bucket_bytes)}").select("h").distinct()
    n_hot = hot.count()
    if n_hot:
        hot = hot.hint("broadcast" if n_hot <= MOST_SENT else "merge")
        alike = rows.join(hot, "h", "left_semi").groupBy("home", "h", "row").agg(F.count("*").alias("n"))
        spread = alike.withColumn("copy", F.explode(F.sequence(F.lit(0), of_shard(many, F.col("home")) - 1)))
        share = (F.col("n") / of_shard(many, F.col("home"))).cast("long") + (F.col("copy") < F.pmod(F.col("n"), of_shard(many, F.col("home")).cast("long"))).cast("long")
        dealt = settle(spread.select(bucket_of(F.col("home"), F.col("h"), F.col("copy")).alias("bucket"), "row", share.alias("copies")).where("copies > 0"), "hot-rows")
        rows = rows.join(hot, "h", "left_anti")
        marks = marks.join(hot, "h", "left_anti")
    rows = rows.select(bucket_of(F.col("home"), F.col("h")).alias("bucket"), "row", "copies")
    filled = marks.select(bucket_of(F.col("home"), F.col("h")).alias("bucket"), "n")
    if n_hot:
        rows = rows.union(dealt)
        filled = filled.union(dealt.select("bucket", F.col("copies").alias("n")))

    shard_of = F.lit(0)
    for s in range(1, shards):
        shard_of = shard_of + (F.col("bucket") >= first[s]).cast("int")
    before = Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before.partitionBy(shard_of)), F.lit(0)).alias("offset"))  # one row per bucket

    tasks = min(buckets, MOST_TASKS)
    task = (F.col("bucket").cast("long") * tasks / buckets).cast("int") if tasks < buckets else F.col("bucket")
    nothing = F.lit(None)
    scattered = rows.select("bucket", "row", "copies", nothing.cast("long").alias("offset")).union(
        offsets.select("bucket", nothing.cast(rows.schema["row"].dataType), nothing.cast("long"), F.col("offset").cast("long"))
    )
    scattered = scattered.select(task.alias("task"), "*").repartitionById(tasks, F.col("task"))
    if n_hot:
        gathered = F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "copies")))
        gathered = F.flatten(F.transform(gathered, lambda x: F.array_repeat(x["row"], x["copies"].cast("int"))))
    else:
        gathered = F.collect_list("row")
    in_order = F.array_sort("rows") if all(_ordered(f.dataType) for f in docs.schema) else F.array_sort("rows", _by_hashes)
    grouped = scattered.groupBy("task", "bucket").agg(gathered.alias("rows"), F.max("offset").alias("offset"))
    placed = grouped.select(shard_of.alias(shard), "offset", F.shuffle(in_order, seed).alias("rows")).select(shard, "offset", F.posexplode("rows").alias("at", "row"))
    out = placed.select(
        *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)),
        F.col("row.s").alias(size), F.col("row.c").alias(crc), (F.col("offset") + F.col("at")).alias(slot), shard,
    )
    # buckets of a task come one after another, sorted, rather than all at once in a hash table
    setting = "spark.sql.execution.useObjectHashAggregateExec"
    was = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        out.write.partitionBy(shard).parquet(folder)
    finally:
        spark.conf.set(setting, was)
    schema = spark.createDataFrame([], docs.schema).select("*", F.lit(0).cast("long").alias(size), F.lit(0).cast("long").alias(crc), F.lit(0).cast("long").alias(slot), F.lit(0).alias(shard)).schema
    return spark.read.schema(schema).parquet(folder)


def _by_hashes(a: Column, b: Column) -> Column:
    """Order by both hashes of the row, where some column has no order of its own."""
    out = F.lit(0)
    for f in ("h2", "h"):
        out = F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(out)
    return out
