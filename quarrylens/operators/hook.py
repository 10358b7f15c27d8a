"""A hook for a model: each distinct text is given to it once, ever, in batches, and its answer is kept by hash.

Texts are reduced to their hashes inside each task before a shuffle, so a text on a third of all
rows is one row of it.  What the store already answers, under the model's version, is left out;
the rest is called in ``rounds`` by hash, each round a job whose answers are appended as a whole.
A run that dies keeps the rounds that were over; a task that is run again repeats no other
round's calls.  A call that may be repeated is, after waits that double up to ``MOST_WAIT``
seconds; a text that still has no answer stays without one, and is asked for again next time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.scratch import settle

MOST_WAIT = 10.0
_STORE = "key string, answer string"


class Retriable(Exception):
    """A failure of the model that may pass: a limit, a time-out, a network fault."""


def waits(attempts: int, first: float = 1.0) -> list[float]:
    """Seconds between attempts: doubled each time, MOST_WAIT at most."""
    return [min(first * 2**n, MOST_WAIT) for n in range(attempts - 1)]


def answered(call: Callable[[list[str]], list[str]], texts: list[str], attempts: int, sleep: Callable[[float], None]) -> list[str | None]:
    """What the model says of some texts; of none of them, once all attempts have failed."""
    for wait in [*waits(attempts), None]:
        try:
            said = call(texts)
            if len(said) != len(texts):
                raise ValueError("a model must answer each text")
            return said
        except Retriable:
            if wait is not None:
                sleep(wait)
    return [None] * len(texts)


def read_store(spark: SparkSession, store: str, version: str) -> DataFrame:
    """key and answer under a version, once for each key."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _STORE)
    return spark.read.schema(f"{_STORE}, version string").parquet(store).where(F.col("version") == version).drop("version").dropDuplicates(["key"])


def call_once(
    rows: DataFrame, text_col: str, call: Callable[[list[str]], list[str]], store: str, version: str, *, batch: int = 64, attempts: int = 4, rounds: int = 4, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """rows with answer, the model's for each text; null for null texts and where it gave none."""
    spark = rows.sparkSession
    key = F.sha2(F.col(text_col).cast("binary"), 256)
    texts = rows.where(F.col(text_col).isNotNull()).groupBy(key.alias("key")).agg(F.first(text_col).alias("text"))
    todo = settle(texts.join(read_store(spark, store, version).hint("merge"), "key", "left_anti"), "texts-to-ask")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                said = pa.array(answered(call, some.column(1).to_pylist(), attempts, sleep), pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), said], ["key", "answer"]).filter(said.is_valid())

    for number in range(rounds):
        mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == number)
        mine.mapInArrow(ask, _STORE).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(store)
    answers = settle(read_store(spark, store, version), "answers")  # apart from the join, which can then split a hot text
    return rows.withColumn("key", key).join(answers, "key", "left").drop("key")
