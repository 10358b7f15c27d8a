"""Secret findings by line: rules, masks, summaries, and the merge with earlier findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of our own making: name, risk, pattern (in the syntax that Java and RE2 share).  GATES has what any hit of a rule holds.
RULES = [
    ("private_key", "high", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key", "high", "AKIA[0-9A-Z]{16}"),
    ("github_token", "high", "gh[pousr]_[A-Za-z0-9]{36}"),
    ("gitlab_token", "high", "glpat-[A-Za-z0-9_-]{20}"),
    ("openai_key", "high", "sk-[A-Za-z0-9]{32}"),
    ("conn_string", "high", "[a-z]+://[A-Za-z0-9_]+:[A-Za-z0-9_]+@[A-Za-z0-9.]+"),
    ("password", "medium", "(?i)passw(or)?d *[:=] *[A-Za-z0-9_+/.-]{6,}"),
    ("token", "medium", '(?i)(token|secret) *[:=] *"?[A-Za-z0-9+/_.-]{16,}'),
    ("api_key", "medium", '(?i)api_?key *[:=] *"?[A-Za-z0-9]{16,}'),
    ("jwt_token", "medium", "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    ("email", "low", "[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]{2,}"),
]


GATES = {"private_key": "PRIVATE KEY", "aws_access_key": "AKIA", "github_token": "gh", "gitlab_token": "glpat-", "openai_key": "sk-", "conn_string": "://", "jwt_token": "eyJ", "email": "@"}


def mask(hit: Column) -> Column:
    """The first and last four characters of a long value, nothing of a short one."""
    return F.when(F.length(hit) <= 8, F.repeat(F.lit("*"), F.length(hit))).otherwise(F.concat(F.left(hit, F.lit(4)), F.lit("****"), F.right(hit, F.lit(4))))


def scan(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line and rule that it breaks: id, line_no from 1, rule, risk, masked.

    All rules are tested on a line at once, so a line is read once and no join is needed; a
    pattern runs once, and only on lines that hold its gate.
    """

    def hit(name: str, pattern: str) -> Column:
        found = F.regexp_extract("line", pattern, 0)
        return F.when(F.contains(F.col("line"), F.lit(GATES[name])), found).otherwise("") if name in GATES else found

    lines = files.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("at", "line"))
    hits = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(r).alias("risk"), hit(n, p).alias("hit")) for n, r, p in RULES))
    found = lines.select(id_col, (F.col("at") + 1).cast("long").alias("line_no"), F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h"))
    return found.select(id_col, "line_no", "h.rule", "h.risk", mask(F.col("h.hit")).alias("masked"))


def summary(findings: DataFrame) -> DataFrame:
    risk = lambda r: F.count_if(F.col("risk") == r).alias(r)
    return findings.agg(F.countDistinct("doc_id").alias("files"), risk("high"), risk("medium"), risk("low"), F.count("*").alias("total"))


def merge_findings(old: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings met again keep their status, open ones not met are fixed, new ones are open."""
    both = old.withColumn("was", F.lit(True)).join(current.withColumn("now", F.lit(True)), list(keys), "full_outer")
    status = F.when(F.col("was").isNull(), "open").when(F.col("now").isNull() & (F.col("status") == "open"), "fixed").otherwise(F.col("status"))
    return both.select(*keys, status.alias("status"))
