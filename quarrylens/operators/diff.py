"""Differences between code snapshots, and who is concerned."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, modified and removed functions of files that both snapshots have (file, func, pos, signature).

    Of several old functions with one name the last counts.
    """
    last = F.row_number().over(Window.partitionBy("file", "func").orderBy(F.desc("pos")))
    before = old.withColumn("r", last).where("r = 1").select("file", "func", F.col("signature").alias("old_signature"), F.lit(True).alias("was"))
    after = new.select("file", "func", F.col("signature").alias("new_signature"), F.lit(True).alias("now"))
    shared = old.select("file").distinct().join(new.select("file").distinct(), "file")
    both = before.join(shared, "file", "left_semi").join(after.join(shared, "file", "left_semi"), ["file", "func"], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified")
    differs = F.col("was").isNull() | F.col("now").isNull() | (F.trim("old_signature") != F.trim("new_signature"))
    return both.where(differs).select("file", "func", "old_signature", "new_signature", change.alias("change"))


# Statements that change a schema, in order of precedence.
_NAME = r'[`"]?([a-zA-Z0-9_.]+)[`"]?'
RENAME = rf"(?i)rename\s+table\s+{_NAME}\s+to\s+{_NAME}"
STATEMENTS = {
    "create": rf"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}",
    "alter": rf"(?i)alter\s+table\s+{_NAME}",
    "drop": rf"(?i)drop\s+table\s+(?:if\s+exists\s+)?{_NAME}",
}


def schema_change(content: Column) -> Column:
    """struct(change, tables) of an SQL file: one kind for each file, rename before create before alter before drop; null if none."""
    out = F.lit(None).cast("struct<change:string,tables:array<string>>")
    for kind in reversed(STATEMENTS):
        tables = F.array_distinct(F.regexp_extract_all(content, F.lit(STATEMENTS[kind]), 1))
        out = F.when(content.rlike(STATEMENTS[kind]), F.struct(F.lit(kind).alias("change"), tables.alias("tables"))).otherwise(out)
    pair = F.array(F.regexp_extract(content, RENAME, 1), F.regexp_extract(content, RENAME, 2))
    return F.when(content.rlike(RENAME), F.struct(F.lit("rename").alias("change"), pair.alias("tables"))).otherwise(out)


def mentions(docs: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """docs once for each name that any of the columns mentions, with the name.  One pass, without a join."""
    hit = lambda n: reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{n}%") for c in columns))
    found = F.filter(F.array(*(F.when(hit(n), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return docs.withColumn("name", F.explode(found))


def test_selection(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Files whose content names any of the functions as a whole word, with those names."""
    if not names:
        return files.where(F.lit(False)).withColumn("funcs", F.array().cast("array<string>"))
    # ASCII word borders, which Java's own do not keep to
    pattern = r"(?<![A-Za-z0-9_])(" + "|".join(re.escape(n) for n in sorted(names)) + r")(?![A-Za-z0-9_])"
    return files.withColumn("funcs", F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).where(F.size("funcs") > 0)
