"""What the operators of this subpackage share: scratch tables and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and all runs on one machine, as in tests, a temporary
    folder is made; a cluster without the setting is refused, as its executors share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarrylens-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables and files that this process wrote to the shared folder; results not yet written elsewhere go with them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and return the table: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, few of them in Python at a time: a whole batch of texts takes as much again."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def fresh_name(taken: list[str], wanted: str) -> str:
    """wanted, with underscores in front until no input column has that name (names compare without case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


#: Bits of a key filter: 2 MB wherever it goes.
FILTER_BITS = 1 << 24
_SPREAD = 2654435761


def filter_spot(code: Column, number: Column) -> Column:
    """The bit of a key of a 64-bit hash and an int."""
    return F.shiftrightunsigned(code.bitwiseXOR(number.cast("long") * F.lit(_SPREAD)), 13).bitwiseAND(F.lit(FILTER_BITS - 1))


def filter_spots(codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """filter_spot of int64 arrays."""
    mixed = codes.view(np.uint64) ^ (numbers.astype(np.uint64) * np.uint64(_SPREAD))
    return (mixed >> np.uint64(13)) & np.uint64(FILTER_BITS - 1)


def key_filter(spots: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the bits in the one column of spots: keys that are in it may be wanted, others are not.

    At most FILTER_BITS / 64 rows come to the driver.  Where it fills up it rules out less, and
    the join that follows does the work; it never loses a key.
    """
    bit = F.col(spots.columns[0])
    words = spots.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in words:
        out[at] = bits
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bitmap[(spots >> np.uint64(6)).astype(np.int64)] >> (spots & np.uint64(63)) & np.uint64(1)).astype(bool)
