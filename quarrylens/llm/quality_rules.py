"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed byte n-grams are counted, one over all documents (raw) and one
over the trusted ones (labelled quality 1 and not toxic), both over all rows.  A document's
score is the mean over its n-grams of log p_trusted - log p_raw, so length does not move it;
it is kept if the score reaches a fixed threshold and no base rule fails.  Nothing is drawn
at random: the same table gives the same verdicts.

Base rules, on words ``[^\\x20\\x09-\\x0D]+``: fewer than ``min_words`` words, or over
``max_repeat_pct`` per cent of the words in five-word windows that occur twice or more.

Defined cases: null text has no words and fails the base; a text with fewer bytes than an
n-gram scores 0; a null or unlabelled doc_id is untrusted; where a doc_id has several labels,
all must trust it; with no trusted text, the ratio of two equal multinomials applies (every
score 0); very long texts are read whole, some at a time; a score equal to the threshold is kept;
repeated rows are counted and judged each; columns of the input pass through, and
result columns whose names are taken get underscores in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import WORD, fresh_name, values

N = 4
BUCKETS = 1 << 16
THRESHOLD = -0.75
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5

RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_WORDS = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SLICE = 1 << 20


def grams(text: str, n: int, buckets: int) -> Iterator[np.ndarray]:
    """The bucket of every byte n-gram of a text, some at a time."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for at in range(0, len(data) - n + 1, _SLICE):
        part = data[at : at + _SLICE + n - 1].astype(np.uint64)
        code = np.zeros(len(part) - n + 1, np.uint64)
        for i in range(n):
            code = code * _STEP + part[i : len(part) - n + 1 + i] + np.uint64(1)
        yield (((code ^ (code >> np.uint64(29))) * _MIX) >> shift).astype(np.int64)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of that many words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for i in range(window):
        code = (code ^ (code >> np.uint64(31))) * _ODD[i % 5] + (ids[i : n + i] + np.uint64(1)) * _MIX
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    spots = np.flatnonzero(maybe).tolist()
    for at in spots:  # equal codes are confirmed on the words
        key = tuple(words[at : at + window])
        seen[key] = seen.get(key, 0) + 1
    for at in spots:
        if seen[tuple(words[at : at + window])] > 1:
            covered[at] += 1
            covered[at + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_facts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = _WORDS.findall(text)
    lines: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line in lines:
            repeated += 1
        elif _WORDS.search(line):
            lines.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), repeated, repeated_words(words)


def count_grams(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over trusted and over all documents; both arrays have the fixed length ``buckets``."""
    trusted = (
        labels.select(F.col(id_col).alias("id"), "quality", "toxic").groupBy("id")
        .agg(F.min(F.col("quality").eqNullSafe(1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("trusted"))
        .where("trusted and id is not null").hint("merge")  # grows with the labels: never broadcast
    )
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(trusted, "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)  # trusted, other
        waiting: tuple[list, list] = ([], [])
        held = [0, 0]  # n-grams that wait: never more than two slices
        for batch in batches:
            for text, good in zip(values(batch.column(0)), values(batch.column(1))):
                k = int(not good)
                for part in grams(text or "", n, buckets):
                    waiting[k].append(part)
                    held[k] += len(part)
                    if held[k] >= _SLICE:
                        total[k] += np.bincount(np.concatenate(waiting[k]), minlength=buckets)
                        waiting[k].clear()
                        held[k] = 0
        for k, mine in enumerate(waiting):
            if mine:
                total[k] += np.bincount(np.concatenate(mine), minlength=buckets)
        total[0], total[1] = total[0] + total[1], total[0].copy()
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "raw", "trusted"])

    rows = marked.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).collect()  # at most ``buckets`` rows
    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for bucket, r, t in rows:
        raw[bucket], good[bucket] = r, t
    return good, raw


def ratio_table(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw for each bucket, add-one smoothed; zero everywhere without trusted text."""
    if not good.sum():
        return np.zeros(len(raw), np.float64)
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def result_names(carried: list[str]) -> list[str]:
    """What the columns of RESULT are called beside these."""
    names: list[str] = []
    for name in RESULT:
        names.append(fresh_name([*carried, *names], name))
    return names


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_columns: list[str] | None = None,
    n: int = N,
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeat_pct: int = MAX_REPEAT_PCT,
) -> DataFrame:
    """The kept columns of every row of docs (all unless named) with RESULT.

    Two passes over the documents.  The first joins the labels by id and sums n-gram counts in
    each task before the shuffle; the second needs no shuffle.  What goes to the driver and
    back is the table of ``buckets`` numbers.
    """
    good, raw = count_grams(docs, labels, id_col=id_col, text_col=text_col, n=n, buckets=buckets)
    sent = docs.sparkSession.sparkContext.broadcast(ratio_table(good, raw))
    carried = docs.columns if keep_columns is None else keep_columns
    names = result_names(carried)
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(a, k) for a, k in zip(names, kinds))])
    text = fresh_name(carried, "text_to_judge")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            facts, scores, kept, failed = [], [], [], []
            for value in values(batch.column(batch.num_columns - 1)):
                row = base_facts(value)
                total = size = 0
                for part in grams(value or "", n, buckets):
                    total += float(table[part].sum())
                    size += len(part)
                facts.append(row)
                scores.append(total / size if size else 0.0)
                failed.append(row[0] < min_words or 100 * row[4] > max_repeat_pct * row[0])
                kept.append(not failed[-1] and scores[-1] >= threshold)
            longs = [pa.array(c, pa.int64()) for c in (zip(*facts) if facts else [()] * 5)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *longs, pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                [*carried, *names],
            )

    return docs.select(*(docs[c] for c in carried), docs[text_col].alias(text)).mapInArrow(judge, schema)
