"""Changes of stored tables: partitions replaced one by one, the log written first.

A table is a Parquet folder whose rows lie in slots by a hash of their key, so a change of one
key rewrites its slot alone and leaves the files of all others as they are.  Parquet has no
transactions: the log of a change is written before the table, so what the table shows is
always in the log, and the same change can be applied again after a failure in between; it then
leaves the same rows, under the same number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.scratch import settle

SLOTS = 256


def slot_of(keys: Sequence[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def create(rows: DataFrame, path: str, keys: Sequence[str], slots: int = SLOTS) -> None:
    """Write rows as a table of slots: one shuffle, one file to a slot unless it is large."""
    placed = rows.withColumn("slot", slot_of(keys, slots))
    placed.repartition("slot").sortWithinPartitions("slot", *keys).write.partitionBy("slot").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, slot int").parquet(path)


def replace(spark: SparkSession, path: str, schema: str, keys: Sequence[str], gone: DataFrame, new: DataFrame, log: DataFrame, log_path: str, number: int, slots: int = SLOTS) -> list[int]:
    """Rows whose keys are in gone leave the table, new ones come in; the slots that were written.

    log is written first, as the partition change=number of log_path.  Only the slots of gone and
    new are read and written; their numbers come to the driver, ``slots`` at most.  A slot that
    is left without rows keeps an empty file.
    """
    log.write.mode("overwrite").parquet(f"{log_path}/change={number}")
    touched = gone.select(slot_of(keys, slots).alias("slot")).union(new.select(slot_of(keys, slots))).distinct()
    wanted = sorted(r.slot for r in touched.collect())
    if not wanted:
        return wanted
    old = read(spark, path, schema).where(F.col("slot").isin(wanted))
    kept = old.join(gone.select(*keys).distinct().hint("merge"), list(keys), "left_anti").select(*old.columns)
    after = settle(kept.unionByName(new.withColumn("slot", slot_of(keys, slots)).select(*old.columns)), "slots")
    filled = {r.slot for r in after.select("slot").distinct().collect()}
    after.repartition("slot").sortWithinPartitions("slot", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)
    for slot in set(wanted) - filled:  # nothing overwrites a partition without rows
        after.where("false").drop("slot").coalesce(1).write.mode("overwrite").parquet(f"{path}/slot={slot}")
    return wanted
