"""Inserts, updates, deletes and audits as joins over whole tables.

Parquet has no transactions: write a result to a new path, its log first, then swap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDIT, RESET, RETIRE = 1, 2, 3
FINDING_STATUSES = ["open", "fixed", "false_positive"]


def update_non_empty(df: DataFrame, edits: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of df replaced by those of edits that are not empty."""
    new = edits.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    out = df.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), F.col(c)) for c in columns}).select(*df.columns)


def update_fields(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_by_id(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("id"), "id", "left_anti")


def replace_partition(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the partitions that new has are replaced by new's."""
    return df.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def get_or_create(have: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """have, and what of wanted it lacks, once each, with created."""
    new = wanted.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti")
    return have.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))


def edit_docs(docs: DataFrame, edits: DataFrame, columns: Sequence[str], operator: str) -> tuple[DataFrame, DataFrame]:
    """(documents after the edit, log rows with snapshots).  Unknown ids are left out; an empty operator is 'system'."""
    after = update_non_empty(docs, edits, "id", columns)
    hit = edits.select("id")
    snapshot = lambda df, name: df.join(hit, "id", "left_semi").select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))
    log = snapshot(docs, "before_content").join(snapshot(after, "after_content"), "id")
    return after, log.select(F.col("id").alias("doc_id"), F.lit(EDIT).alias("operate_type"), "before_content", "after_content", F.lit(operator or "system").alias("operator"))


def restore_origin(rows: DataFrame) -> DataFrame:
    """summary and risk_point from the original JSON, and whether it could be read."""
    parsed = F.from_json("origin", "summary string, risk_point string")
    good = F.try_parse_json("origin").isNotNull() & (F.trim("origin") != "")
    return rows.select("id", F.when(good, parsed["summary"]).alias("summary"), F.when(good, parsed["risk_point"]).alias("risk_point"), good.alias("restored"))


def add_relations(relations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, log rows): no self relation, none that exists."""
    good = new.where("from_module <> to_module").dropDuplicates(["from_module", "to_module"]).join(relations.select("from_module", "to_module"), ["from_module", "to_module"], "left_anti")
    rows = good.select("from_module", "to_module", "relation_type", F.lit(2).alias("source"))
    return rows, rows.select("from_module", "to_module", F.lit("add").alias("operation"))


def upsert(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return versions.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def edit_unique(rows: DataFrame, edits: DataFrame, unique: str) -> DataFrame:
    """rows that edits name, edited unless another row holds the new unique value."""
    names = [c for c in rows.columns if c != "id"]
    taken = rows.select(F.col(unique).alias(f"new_{unique}"), F.col("id").alias("holder"))
    new = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in names)).join(taken, f"new_{unique}", "left")
    clash = F.col("holder").isNotNull() & (F.col("holder") != F.col("id"))
    return rows.join(new, "id").select("id", *(F.when(clash, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in names))


def set_finding_status(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """New statuses, where they are allowed ones."""
    good = updates.where(F.col("status").isin(FINDING_STATUSES)).select("id", F.col("status").alias("new_status"))
    return findings.join(good, "id", "left").select("id", F.coalesce("new_status", "status").alias("status"))
