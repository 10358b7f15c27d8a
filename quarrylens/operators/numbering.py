"""Numbers for rows in a global order, without one task for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.sources.scratch import settle

_PLACE_BITS = 33  # of monotonically_increasing_id: below them the place in a partition, above them the partition


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """rows with their number in the order of some columns, from 0; where these tell rows apart, it depends on nothing else.

    Rows are sorted by range, so each partition needs only the count of those before it: one
    row for each partition comes to the driver.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    table = settle(placed, "numbered")
    part, within = F.shiftright("place_", _PLACE_BITS), F.col("place_").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    offsets, total = [], 0
    for number, count in table.groupBy(part.alias("part_")).count().orderBy("part_").collect():
        offsets.append((number, total))
        total += count
    known = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "part_ long, before_ long")
    return table.withColumn("part_", part).join(F.broadcast(known), "part_").withColumn(name, F.col("before_") + within).drop("part_", "before_", "place_")
