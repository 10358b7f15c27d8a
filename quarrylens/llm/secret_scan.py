"""Secret scans: an incremental blob ledger.

A text is a blob, addressed by its SHA-256.  The ledger is a Parquet folder with one row for
each blob and rule version that has been scanned, partitioned by rule version.  A scan reduces the input to distinct blobs
(inside each task first, so a hot blob never gathers), leaves out those whose pair with the
rule version is in the ledger, scans the rest, appends them, and joins the findings back to
every path that carries the blob.  A second version of a file, or a copy of it, costs nothing;
a change of the rules scans every blob once more under the new version.

A finding is kind:start:end in code points, end exclusive.  Three kinds are the base; the
others add findings and change no base finding.

Defined cases: null text is the empty text; repeated rows are all reported; a null path is
reported as null; an empty table gives no rows and appends nothing; a text of any length is
scanned whole; columns beside path and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import scratch_path

RULE_VERSION = "base-1+extra-1"

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones are simply not met

# Rules of our own, beside the base.  Each has a plain string that must be in the text.
EXTRA_RULES = {
    "pem": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "google": ("AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}

LEDGER = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and further spans of a text, as (start, end, kind) in order of start, then kind as listed."""
    base = []
    if ":" in text or "=" in text:
        low = text.lower()
        if _ASSIGN_HINT.search(low):
            base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    more = [(m.start(), m.end(), kind) for kind, (hint, rule) in EXTRA_RULES.items() if hint in text for m in rule.finditer(text)]
    rank = {kind: i for i, kind in enumerate([*BASE_KINDS, *EXTRA_RULES])}

    def order(span: tuple[int, int, str]) -> tuple[int, int]:
        return span[0], rank[span[2]]

    return sorted(base, key=order), sorted([*base, *more], key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = scan_text(text)
                row = [blob, *(sum(s[2] == kind for s in base) for kind in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in LEDGER.split(", ")])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger's rows of one rule version; other versions are not read.  What two scans appended at once stands twice."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{LEDGER}, rule_version string")
    return spark.read.schema(f"{LEDGER}, rule_version string").parquet(ledger).where(F.col("rule_version") == rule_version)


def scan_secrets(
    docs: DataFrame,
    *,
    path_col: str = "doc_id",
    text_col: str = "text",
    ledger: str | None = None,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """path, blob, n_assign, n_access, n_hex, base_sha256, spans of every row of docs.

    ledger: the folder of earlier scans, which this one extends; a new one in the shared folder
    unless named.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "blob-ledger")
    addressed = docs.select(F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    unseen = addressed.groupBy("blob").agg(F.first("text").alias("text")).join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti")
    scan_blobs(unseen).withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    findings = read_ledger(spark, ledger, rule_version).dropDuplicates(["blob", "rule_version"]).drop("rule_version")  # not by the join's key alone, which would bind a hot blob to one task
    return addressed.select("path", "blob").join(findings, "blob").select("path", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
