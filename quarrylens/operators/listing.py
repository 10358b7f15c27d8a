"""Lists, lookups, pages and filters over any table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators.numbering import numbered

PAGE, PAGE_MOST = 20, 100


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every named column; those given None do not restrict."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)


def by_key(df: DataFrame, **equal) -> DataFrame:
    return matching(df, **equal).orderBy("id").limit(1)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page in a total order, with the count of all rows; size is at most PAGE_MOST."""
    number, size = max(1, number), PAGE if size <= 0 else min(size, PAGE_MOST)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def in_modules(df: DataFrame, modules: Sequence[str], limit: int | None = None) -> DataFrame:
    out = df.where(F.col("module_name").isin(*modules)).orderBy(F.desc("id"))
    return out.limit(limit) if limit else out


def keyword(df: DataFrame, word: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any column is like %word%, without regard to case; a blank word matches nothing."""
    if not word.strip():
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{word.strip()}%") for c in columns)))


def group_digest(*columns: str) -> Column:
    """An aggregate that tells groups of rows apart by 128 bits and their count: sums of hashes, so it is merged task by task and holds no list.

    Where the order of rows matters their position is one of the columns.
    """
    first, second = (F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(20,0)")) for salt in (1, 2))
    return F.concat_ws(":", F.count("*").cast("string"), first.cast("string"), second.cast("string"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that one of two snapshots lacks or that differ, with the kind of change."""
    def body(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("file").agg(group_digest("pos", "func", "signature").alias(name))

    both = body(old, "a").join(body(new, "b"), "file", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("file", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= n).drop("rank_")


def skip_reason(path: Column) -> Column:
    """Why a file is not parsed: blank path, extension, directory, pattern, in this order; empty if it is."""
    return (
        F.when(F.trim(path) == "", "blank")
        .when(~S.extension(path).isin(S.ALLOWED_EXTENSIONS), "extension")
        .when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, S.IGNORED_DIRS))), "directory")
        .when(reduce(lambda a, b: a | b, (path.rlike(p) for p in S.IGNORED_FILES)), "pattern")
        .otherwise("")
    )


def hits_of(body: Column, terms: Sequence[str]) -> Column:
    """How many terms a body holds, without regard to case.  The body is put in lower case once: the fold over the terms carries it."""
    begin = F.struct(F.lower(body).alias("body"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array(*map(F.lit, terms)).cast("array<string>"), begin, lambda a, w: F.struct(a["body"].alias("body"), (a["n"] + F.contains(a["body"], w).cast("long")).alias("n")), lambda a: a["n"]
    )


def term_hits(docs: DataFrame, query: str, terms: Sequence[str] | None = None) -> DataFrame:
    """docs with hits, how many of the query's terms each holds."""
    body = F.concat_ws(" ", "module_name", "func_name", "file_path", "summary", "process_flow", "risk_point")
    return docs.withColumn("hits", hits_of(body, terms_of(docs, query) if terms is None else terms))


def terms_of(docs: DataFrame, query: str) -> list[str]:
    """The terms of one query, taken out once."""
    return docs.sparkSession.range(1).select(S.query_terms(F.lit(query))).first()[0]


def relevant(docs: DataFrame, query: str, least: int = 2) -> DataFrame:
    """Documents with two terms or more of the query; all of them if the query has no terms."""
    terms = terms_of(docs, query)
    return term_hits(docs, query, terms).where((F.col("hits") >= least) if terms else F.lit(True))


def candidate_models(models: DataFrame, estimated_tokens: int = 0, least_price: float | None = None) -> DataFrame:
    out = models.where("enabled")
    if estimated_tokens > 0:
        out = out.where((F.col("max_context") <= 0) | (F.col("max_context") >= estimated_tokens))
    return out if least_price is None else out.where(S.average_price(F.col("price_in"), F.col("price_out")) >= least_price)


def by_price(models: DataFrame) -> DataFrame:
    """models with pos, from 1: the cheapest on average first, equal prices by name."""
    priced = models.withColumn("average_", S.average_price(F.col("price_in"), F.col("price_out")))
    return numbered(priced, ["average_", "name"], "pos").withColumn("pos", F.col("pos") + 1).drop("average_")


def status_label(status: Column) -> Column:
    return F.when(status == 0, "pending").when(status == 1, "running").when(status == 2, "success").when(status == 3, "failed").otherwise("unknown")
