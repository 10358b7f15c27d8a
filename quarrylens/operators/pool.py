"""A pool of models that changes: versions in files, re-read, each call priced by the version in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators.windows import as_of

_MODEL = "struct<name: string, price_in: double, price_out: double, max_context: long, rpm: long, tpm: long, enabled: boolean>"
_POOL = f"valid_from long, models array<{_MODEL}>"


def read_pool(spark: SparkSession, folder: str, values: dict[str, str] | None = None) -> DataFrame:
    """name, valid_from and the settings of every model of every version in a folder: a JSON file each, whose placeholders take their values.

    It is read anew at each call, so a version that has been added counts from the next call on.
    A file that cannot be read as a version is left out.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    told = files.select(F.from_json(S.expand_placeholders(F.col("value"), values or {}), _POOL).alias("pool")).where("pool.valid_from is not null")
    return told.select("pool.valid_from", F.explode("pool.models").alias("model")).select("valid_from", "model.*").where("name is not null")


def priced(calls: DataFrame, versions: DataFrame, width: int = 86_400) -> DataFrame:
    """calls (name, at, tokens_in, tokens_out) with version (its valid_from) and cost, by the version in force at their time; null before the first, or where it was not enabled."""
    told = versions.withColumn("version", F.col("valid_from"))
    found = as_of(calls, told, ["name"], "at", "valid_from", ["version", "price_in", "price_out", "enabled"], width)
    cost = F.when(F.coalesce("enabled", F.lit(True)), S.call_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return found.withColumn("cost", cost).drop("price_in", "price_out", "enabled")


def stream_priced(calls: DataFrame, folder: str, sink: str, checkpoint: str, values: dict[str, str] | None = None):
    """Start a stream that prices each micro-batch of calls by the pool as its files are then; a batch writes its own partition whole."""

    def write(batch: DataFrame, number: int) -> None:
        priced(batch, read_pool(batch.sparkSession, folder, values)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
