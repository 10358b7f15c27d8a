"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text's features are the character n-grams of its words, with a mark at each word's ends,
hashed into buckets.  Its vector is the mean of their embeddings; a linear softmax over it
gives the languages.  Embeddings and softmax are trained together by stochastic gradient
descent in numpy.  After training, a bucket's embedding times the softmax is one row of a
table of buckets x languages, so a prediction is a mean of table rows over the whole text.

Training takes a bounded sample of labelled rows: at most ``per_language`` texts of a language
(least seeded hash of the id first), cut to ``longest`` characters, ``most_rows`` in all, from the ``MOST_LANGUAGES`` commonest languages.
A fifth of the sample is held back to calibrate: a temperature makes scores probabilities,
and the least score at which accepted texts reach ``target_accuracy`` becomes the limit under
which a prediction is rejected (``accepted`` false; the prediction itself stays).

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; so
is every text if there was nothing to learn from; null ids are never learnt from and not held
out; repeated rows are predicted each; of languages with equal probability the first by code
point is predicted; texts of any length are read whole for a prediction, some at a time; columns
beside id, text and language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 15
DIM = 16
GRAMS = (2, 3, 4)
PER_LANGUAGE = 600
MOST_ROWS = 4000
LONGEST = 20_000
MOST_LANGUAGES = 1000
EPOCHS = 8
RATE = 0.5
SEED = 11
TARGET_ACCURACY = 0.99

UNKNOWN = "und"
_WORD_MARK = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 19


def features(text: str, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text's words, some at a time.  A gram lies in one word and its end marks."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    most = max(grams)
    clean = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), _SLICE):
        part = codes[at : at + _SLICE + most - 1].astype(np.uint64)
        here = min(_SLICE, len(codes) - at)
        gap = part == np.uint64(32)
        code = np.zeros(len(part), np.uint64)
        inside = np.zeros(len(part), np.int64)  # gaps strictly inside the gram
        for n in range(1, most + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            code = code[:size] * _STEP + part[n - 1 :] + np.uint64(1)
            if n > 2:
                inside = inside[:size] + gap[n - 2 : n - 2 + size]
            if n in grams:
                good = inside[:size] == 0
                good &= ~(gap[:size] & gap[n - 1 :]) if n == 2 else True
                good[here:] = False
                yield (((code[good] ^ (code[good] >> np.uint64(30))) * _MIX) >> shift).astype(np.int64)


def has_letter(text: str) -> bool:
    """Is there a character of Unicode's category L?  Numerals such as one half are word characters, but no letters."""
    return any(m[0].isalpha() for m in _WORD_MARK.finditer(text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    limit: float
    buckets: int
    grams: tuple[int, ...]

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for part in features(text, self.buckets, self.grams):
            if len(part) > 4 * self.buckets:
                total += np.bincount(part, minlength=self.buckets) @ self.table
            else:
                total += self.table[part].sum(axis=0, dtype=np.float64)
            count += len(part)
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is accepted."""
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.limit)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(
    rows: list[tuple[str, str]],
    *,
    buckets: int = BUCKETS,
    dim: int = DIM,
    grams: tuple[int, ...] = GRAMS,
    epochs: int = EPOCHS,
    rate: float = RATE,
    seed: int = SEED,
    target_accuracy: float = TARGET_ACCURACY,
) -> Model:
    """Train on (text, language) rows; every fifth calibrates.  Without rows there are no languages."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, buckets, grams)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    weight, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    data = []
    for text, lang in rows:
        parts = [p for p in features(text, buckets, grams) if len(p)]
        if parts:
            at, n = np.unique(np.concatenate(parts), return_counts=True)
            data.append((at, n / n.sum(), languages.index(lang)))
    rng.shuffle(data)
    held, learnt = data[::5], [x for i, x in enumerate(data) if i % 5]
    share = np.bincount([y for *_, y in learnt], minlength=len(languages)) + 1.0
    cost = share.mean() / share  # each language weighs the same
    steps, step = max(1, epochs * len(learnt)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(learnt)):
            at, f, y = learnt[k]
            own = embed[at]
            hidden = f @ own
            error = _softmax((hidden @ weight + bias)[None])[0]
            error[y] -= 1
            now = rate * cost[y] * (1 - step / steps)
            back = weight @ error
            weight -= now * np.outer(hidden, error)
            bias -= now * 0.1 * error
            embed[at] = own - now * np.sqrt(len(at)) * np.outer(f, back)
            step += 1
    model = Model(languages, (embed @ weight).astype(np.float32), bias, 1.0, 0.0, buckets, grams)
    if held:
        logits = np.array([f @ model.table[at] + bias for at, f, _ in held])
        truth = np.array([y for *_, y in held])
        heat = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heat]
        model.temperature = float(heat[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-score, kind="stable")
        accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(accuracy >= target_accuracy)
        model.limit = float(score[order[good[-1]]]) if len(good) else 1.0
    return model


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, longest: int = LONGEST, seed: int = SEED) -> list[tuple[str, str]]:
    """The bounded sample: at most most_rows texts of at most longest characters come to the driver.

    A language's share of the hash is set from its count, a few times what is wanted, so only
    about that many rows leave the scan; among them the least hashes are taken.
    """
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.substring(text_col, 1, longest).alias("text"), F.col(lang_col).alias("lang"), hashed.alias("h")).where(
        (remainder(F.col("id")) != 0) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    share = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    few = rows.join(F.broadcast(counts), "lang").where((share * F.col("n") < 3 * per_language) & F.col("text").isNotNull())
    best = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("r") <= per_language)
    return [(r["text"], r["lang"]) for r in best.orderBy("r", "lang").limit(most_rows).select("text", "lang").collect()]


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row of docs; learns from the rows that are not held out."""
    model = fit(training_rows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **sample))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = [known.predict(t) for t in batch.column(2).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in found], k) for i, k in enumerate(kinds))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
