"""Line dedup: a deletion-neighbourhood join over words.

A line is its words (A-Z in lower case).  It is dropped if an earlier line, by document id and
place, has the same words or, where both have ``near_words`` words or more, words at edit
distance 1; so the earliest of any two stays.  Lines under ``min_words`` words stay.

Lines at distance 1 share a variant: the line itself or the line less one word.  Substitutions
share the variant and the place of the deletion, and any two that share both are at distance
1, so the least position of a key answers for all its members.  Insertions pair a whole line
with another's deletion; distinct lines have one whole line to a key.  No bucket is therefore
paired with itself.

Before any variant is made, distinct lines are screened: two lines at distance 1 agree in
their first or their last q words, q the power of two below half the length.  A line that
shares neither end with another line has no partner, so the screen loses nothing.

Texts are not shuffled to fetch the lines that pass, nor to cut documents that lose no line:
a bitmap of fixed size says which may be concerned, and exact joins follow on those alone.
Candidates are verified on their words.  Positions are (document id, hash of the text, line
number).

Defined cases: null texts have no lines and stay null; empty lines stay; a null id sorts
first; rows equal in id and text are one document and are both cut alike; rows that repeat an
id under other texts are ordered by the text's hash; very long lines and texts are read whole;
of lines that tie in everything but their place the earliest stays; an empty table gives no rows; columns
beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import filter_spot, filter_spots, in_filter, key_filter, settle

MIN_WORDS = 3
NEAR_WORDS = 8

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POSITION = ["doc_id", "tag", "line_no"]


def line_words(line: bytes) -> list[bytes]:
    """Words of a UTF-8 line; splits where [\\x20\\x09-\\x0D] stands."""
    return line.lower().split()


def screen_keys(words: list[bytes]) -> list[int]:
    """Keys of both ends for the length's class, and for the one below at its lower border."""
    n = len(words)
    top = n.bit_length() - 1
    out = []
    for c in {top, max(1, (n - 1).bit_length() - 1)}:
        q = 1 << (c - 1)
        out += [xxhash.xxh3_64_intdigest(b" ".join(words[:q]), 2 * c), xxhash.xxh3_64_intdigest(b" ".join(words[-q:]), 2 * c + 1)]
    return [k - (1 << 64) if k >> 63 else k for k in out]


def variant_keys(words: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Hashes of the line, of each deletion, and of each deletion with its place."""
    n = len(words)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    codes = (codes ^ (codes >> np.uint64(32))) * _B
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = _A
    powers = np.cumprod(powers, dtype=np.uint64)
    ahead = np.zeros(n + 1, np.uint64)  # sum of codes[j] * A^j over j < i
    ahead[1:] = np.cumsum(codes * powers[:n], dtype=np.uint64)
    moved = np.zeros(n + 2, np.uint64)  # words one place forward
    moved[1:n] = codes[1:] * powers[: n - 1]
    behind = np.cumsum(moved[::-1], dtype=np.uint64)[::-1]  # sum over j >= i
    less_one = ahead[:n] + behind[1 : n + 1]
    whole = int(_final(ahead[n:], n)[0])
    deleted = _final(less_one, n - 1)
    placed = (deleted ^ (np.arange(1, n + 1, dtype=np.uint64) * _C)) * _A
    return whole - (1 << 64) if whole >> 63 else whole, deleted.view(np.int64), (placed ^ (placed >> np.uint64(29))).view(np.int64)


def _final(x: np.ndarray, length: int) -> np.ndarray:
    x = (x + np.uint64(length)) * _B
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Is the edit distance of two word lists 1 or less?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _each_line(texts: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """Every line of min_words words or more: position, n_words, h1, h2 (128-bit hash), keys (of the screen, null if none)."""
    kinds = {"doc_id": pa.int64(), "tag": pa.int64(), "line_no": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "keys": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, tag, text in zip(*(c.to_pylist() for c in batch.columns)):
                for number, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                    words = line_words(line)
                    if len(words) >= min_words:
                        h = xxhash.xxh3_128_digest(b" ".join(words))
                        keys = screen_keys(words) if len(words) >= near_words else None
                        out.append((doc_id, tag, number, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), keys))
                if len(out) >= 20_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], list(kinds))

    return texts.mapInArrow(run, "doc_id long, tag long, line_no int, h1 long, h2 long, keys array<long>")


def _variants(lines: DataFrame) -> DataFrame:
    """key, kind (0 whole, 1 deletion, 2 deletion with its place), at (position) of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                keys, kinds, rows = [], [], []
                for i, line in enumerate(part.column(3).to_pylist()):
                    words = line.encode("utf-8", "surrogatepass").split()
                    whole, deleted, placed = variant_keys(words)
                    n = len(words)
                    keys += [np.array([whole]), deleted, placed]
                    kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [1, n, n]))
                    rows.append(np.full(2 * n + 1, i))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds)), *(part.column(i).take(take) for i in range(3))], ["key", "kind", *_POSITION]
                )

    rows = lines.select(*_POSITION, "line").mapInArrow(run, "key long, kind byte, doc_id long, tag long, line_no int")
    return rows.select("key", "kind", F.struct(*_POSITION).alias("at"))


def _near(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Positions of distinct lines that are at distance 1 from an earlier one."""
    ends = firsts.where("keys is not null").select("at", F.explode("keys").alias("key"))
    shared = ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    passed = settle(ends.join(shared, "key", "left_semi").select("at.*").distinct(), "screened")
    sent = texts.sparkSession.sparkContext.broadcast(key_filter(passed.select(filter_spot(F.col("tag"), F.col("line_no")))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                out = []
                for doc_id, tag, text in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns)):
                    parts = text.encode("utf-8", "surrogatepass").split(b"\n")
                    may = in_filter(sent.value, filter_spots(np.full(len(parts), tag, np.int64), np.arange(len(parts))))
                    out += [(doc_id, tag, n, b" ".join(line_words(parts[n])).decode("utf-8", "surrogatepass")) for n in np.flatnonzero(may).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], [*_POSITION, "line"])

    found = texts.where("text is not null").select("doc_id", "tag", "text").mapInArrow(pick, "doc_id long, tag long, line_no int, line string")
    same = [found[c].eqNullSafe(passed[c]) for c in _POSITION]
    lines = settle(found.join(passed, same, "left_semi").distinct(), "screened-lines")
    rows = _variants(lines)
    best = rows.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"k{k}") for k in (0, 1, 2)), F.count("*").alias("n"))
    best = best.where("n > 1 and (k2 is not null or (k0 is not null and k1 is not null))").drop("n")
    partner = F.when(F.col("kind") == 0, F.col("k1")).when(F.col("kind") == 1, F.col("k0")).otherwise(F.col("k2"))
    pairs = settle(rows.join(best, "key").select("at", partner.alias("earlier")).where("earlier < at").distinct(), "line-pairs")
    text = lines.select(F.struct(*_POSITION).alias("p"), "line")
    both = pairs.join(text.select(F.col("p").alias("at"), F.col("line").alias("a")), "at").join(text.select(F.col("p").alias("earlier"), F.col("line").alias("b")), "earlier")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.encode("utf-8", "surrogatepass").split(), b.encode("utf-8", "surrogatepass").split()) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    return both.select("at.doc_id", "at.tag", "at.line_no", "a", "b").mapInArrow(check, "doc_id long, tag long, line_no int").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines, dropped (line numbers from 0, ascending) of every row of docs."""
    if near_words < 2:
        raise ValueError("near_words must be 2 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    lines = settle(_each_line(texts.where("text is not null"), min_words, near_words), "lines")
    firsts = settle(lines.groupBy("h1", "h2").agg(F.min(F.struct(*_POSITION)).alias("at"), F.first("keys").alias("keys")), "first-lines")
    again = lines.join(firsts.select("h1", "h2", "at"), ["h1", "h2"]).where(F.struct(*_POSITION) > F.col("at")).select(*_POSITION)
    gone = again.union(_near(texts, firsts)).groupBy(F.col("doc_id").alias("d"), F.col("tag").alias("t")).agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))  # lines of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], []
            for text, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = [] if text is None else text.split("\n")
                out = set(dropped or ())
                counts.append(len(parts))
                kept.append(None if text is None else "\n".join(p for i, p in enumerate(parts) if i not in out))
            dropped = pa.array([x or [] for x in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), dropped], ["doc_id", "text", "n_lines", "dropped"])

    gone = settle(gone, "dropped-lines")
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(gone.select(filter_spot(F.col("t"), F.lit(0)))))

    @F.pandas_udf("boolean")
    def may_lose(tag: pd.Series) -> pd.Series:
        return pd.Series(in_filter(sent.value, filter_spots(tag.to_numpy(np.int64), np.zeros(len(tag), np.int64))))

    told = texts.withColumn("may", may_lose("tag"))
    losing = told.where("may").join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "dropped")
    # what loses no line stays in the JVM
    lines_of = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    whole = told.where("not may").select("doc_id", "text", lines_of.alias("n_lines"), F.array().cast("array<int>").alias("dropped"))
    return losing.mapInArrow(cut, "doc_id long, text string, n_lines long, dropped array<int>").union(whole)
