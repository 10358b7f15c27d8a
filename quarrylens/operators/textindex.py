"""Substring joins by trigrams: which of many names stand in which of many texts.

A name of three characters or more stands in a text only where all its trigrams do.  Each name
is keyed by its rarest trigram among the texts, so a pair is a candidate only where that one
occurs; candidates are then tested exactly.  Trigrams of texts that no name needs are ruled out
inside the tasks by a bitmap of fixed size, which may let some pass but loses none, so what is
shuffled are the postings that names ask for, not texts times names.  Shorter names match by
their own characters, which are keys of one or two.

Names of ``SMALL_CHARS`` characters at most in all, which is measured, go to the tasks as one
automaton instead: a text is then read once, and nothing of it is shuffled.

Texts and names are compared in lower case; null and empty names stand nowhere, null texts hold
nothing; rows that repeat an id are texts each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.sources.scratch import settle

#: Bits of the bitmap of wanted trigrams: 2 MB wherever it goes.
BITS = 1 << 24
GRAM = 3
#: Names that may travel whole; their automaton takes about 100 bytes for each character.
SMALL_CHARS = 1_000_000

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def grams_of(text: str) -> list[int]:
    """Hashes of the distinct keys of a text: of all its runs of one to three characters."""
    return _hashed({text[i : i + n] for n in range(1, GRAM + 1) for i in range(len(text) - n + 1)})


def own_grams(name: str) -> list[int]:
    """Hashes of the keys a name may be found by: its trigrams, or all of a shorter one."""
    return _hashed({name[i : i + GRAM] for i in range(max(1, len(name) - GRAM + 1))})


def _hashed(grams: set[str]) -> list[int]:
    return [h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass"))) >> 63 else h for g in grams]


def _keyed(rows: DataFrame, grams, wanted: np.ndarray | None = None) -> DataFrame:
    """row and gram of rows (row, text): of all the keys that grams gives a text, those in the bitmap."""
    sent = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, counts = [], []
                for text in part.column(1).to_pylist():
                    codes = np.array(grams(text), np.int64)
                    if sent is not None:
                        spots = codes.view(np.uint64) & np.uint64(BITS - 1)
                        codes = codes[(sent.value[(spots >> np.uint64(3)).astype(np.int64)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    found.append(codes)
                    counts.append(len(codes))
                rows_again = part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([rows_again, pa.array(np.concatenate(found))], ["row", "gram"])

    return rows.mapInArrow(run, "row long, gram long")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the grams, as bytes: at most BITS / 64 numbers come to the driver."""
    spot = F.col("gram").bitwiseAND(F.lit(BITS - 1))
    words = grams.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for at, bits in words:
        out[at] = bits
    return out.view(np.uint8)


def _automaton(key: str, names: list[str]) -> ahocorasick.Automaton:
    """The automaton of some names, built once in each worker and kept until others are asked for."""
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _found_by_automaton(texts: DataFrame, names: list[str]) -> DataFrame:
    """id and name, from texts (id, text)."""
    sent, key = texts.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex
    schema = T.StructType([texts.schema["id"], T.StructField("name", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [{name for _, name in automaton.iter(text)} for text in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), list(map(len, found)))))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n for some in found for n in some], pa.string())], ["id", "name"])

    return texts.mapInArrow(run, schema)


def contained(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, small_chars: int = SMALL_CHARS) -> DataFrame:
    """id and name of each text that holds a name, without regard to case; each name once, in lower case.  small_chars changes no result."""
    known = names.select(F.lower(name_col).alias("text")).where("text <> ''").distinct().withColumn("row", F.monotonically_increasing_id()).select("row", "text")
    known = settle(known, "names")
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if 0 < size <= small_chars:
        return _found_by_automaton(texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")), [r.text for r in known.select("text").collect()])
    bodies = settle(texts.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(text_col).alias("text")), "texts")
    keys = settle(_keyed(known, own_grams), "name-grams")
    slim = bodies.select("row", "text")
    often = _keyed(slim, grams_of, _bitmap(keys)).groupBy("gram").count()
    # of a name's grams the rarest: none that is in no text, for then the name is in none
    rarest = keys.join(often.hint("merge"), "gram", "left").groupBy("row").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    chosen = settle(rarest.select(F.col("row").alias("name_row"), F.col("least.gram").alias("gram")), "rarest-grams")
    postings = _keyed(slim, grams_of, _bitmap(chosen))
    pairs = postings.join(chosen.hint("merge"), "gram").select("row", "name_row").join(known.select(F.col("row").alias("name_row"), F.col("text").alias("name")).hint("merge"), "name_row")
    tested = bodies.join(pairs.hint("merge"), "row").where(F.contains("text", F.col("name")))
    return tested.select("id", "name")
