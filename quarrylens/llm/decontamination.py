"""Benchmark decontamination: pigeonhole edit matching.

An item of m characters may differ by k = m * error_pct / 100 edits.  Cut into k + 1 pieces,
one piece at least is untouched in any match, so an Aho-Corasick automaton over all pieces
finds every candidate place, and Myers' bit-parallel distance confirms it in the window around
the piece.  Items and texts are compared in lower case with each run of white space as one
space; the whole text is searched.

The items travel to the executors, in blocks of about ``block_chars`` characters, dealt by hash
once their size has been measured.  One block is kept as one automaton.  Of several, a worker
holds one at a time: it gathers about ``span_chars`` characters of texts, runs them through
block after block, and goes on to the next texts.  Beyond ``blocks_a_pass`` blocks the result is
written and read again, so what travels at once is bounded.  No pass shuffles anything, and a
stage has one Python step.

Defined cases: null texts hold no item; a very long text is searched whole, in a span of its own; null and empty items are found nowhere; repeated items
count once for each item_id, and a null item_id is dropped; repeated documents are judged each;
an empty benchmark finds nothing; columns of the input pass through, and result columns whose
names are taken get underscores in front.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import fresh_name, settle

ERROR_PCT = 5
#: Characters of items in one automaton, about 100 bytes of memory each.
BLOCK_CHARS = 2_000_000
BLOCKS_A_PASS = 16
SPAN_CHARS = 32_000_000

_AUTOMATA: dict[str, tuple] = {}


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 consecutive spans, of equal length to within one, that cover the item."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def errors_allowed(length: int, error_pct: int) -> int:
    return length * error_pct // 100


class Pattern:
    """An item, with the masks of Myers' algorithm on integers of any length."""

    def __init__(self, text: str, errors: int):
        self.text, self.errors, self.length = text, errors, len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.all, self.top = (1 << self.length) - 1, 1 << self.length - 1

    def within(self, window: str) -> bool:
        """Is there a part of the window at edit distance ``errors`` or less?"""
        if self.text in window:
            return True
        if not self.errors:
            return False
        up, down, score = self.all, 0, self.length
        for c in window:
            eq = self.masks.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right = down | ~(diagonal | up) & self.all
            left = up & diagonal
            if right & self.top:
                score += 1
            elif left & self.top:
                score -= 1
            if score <= self.errors:
                return True
            right = right << 1 & self.all  # a match may begin anywhere: no carry in
            left = left << 1 & self.all
            up = left | ~(diagonal | right) & self.all
            down = right & diagonal
        return False


def _automaton(items: list[tuple[int, str]], error_pct: int) -> tuple:
    import ahocorasick

    patterns: dict[str, tuple[Pattern, set[int]]] = {}
    for item_id, text in items:
        text = plain(text)
        if text and text not in patterns:
            patterns[text] = Pattern(text, errors_allowed(len(text), error_pct)), set()
        if text:
            patterns[text][1].add(item_id)
    all_patterns = list(patterns.values())
    places: dict[str, list[tuple[int, int]]] = {}
    for number, (pattern, _) in enumerate(all_patterns):
        for a, b in pieces(pattern.length, pattern.errors):
            places.setdefault(pattern.text[a:b], []).append((number, b))
    machine = ahocorasick.Automaton()
    for piece, where in places.items():
        machine.add_word(piece, where)
    if places:
        machine.make_automaton()
    return machine if places else None, all_patterns


def items_in(text: str | None, machine, patterns: list[tuple[Pattern, set[int]]]) -> list[int]:
    """Ids of the items that the text holds."""
    if machine is None or not text:
        return []
    text = plain(text)
    found: set[int] = set()
    tried: set[tuple[int, int]] = set()
    for end, where in machine.iter(text):
        for number, piece_end in where:
            begin = end + 1 - piece_end  # where the item would begin without edits before the piece
            if number in found or (number, begin) in tried:
                continue
            tried.add((number, begin))
            pattern = patterns[number][0]
            if pattern.within(text[max(0, begin - pattern.errors) : begin + pattern.length + pattern.errors]):
                found.add(number)
    return sorted({i for number in found for i in patterns[number][1]})


def _packed(rows: list[tuple[int, str]]) -> tuple[str, bytes]:
    """Items as a name, by what they hold, and bytes."""
    raw = json.dumps(rows).encode()
    return hashlib.sha256(raw).hexdigest(), zlib.compress(raw, 1)


def _machine(name: str, packed: bytes, error_pct: int) -> tuple:
    """The automaton of a block; the worker keeps the last one."""
    key = f"{name}-{error_pct}"
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = _automaton([tuple(x) for x in json.loads(zlib.decompress(packed))], error_pct)
    return _AUTOMATA[key]


def find_benchmark_items(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep_columns: list[str] | None = None,
    error_pct: int = ERROR_PCT,
    block_chars: int = BLOCK_CHARS,
    blocks_a_pass: int = BLOCKS_A_PASS,
    span_chars: int = SPAN_CHARS,
) -> DataFrame:
    """The kept columns of every row of docs (all unless named), with items (sorted ids of the items it holds) and contaminated."""
    carried = docs.columns if keep_columns is None else keep_columns
    items_name, flag_name = result_names(carried)
    text_name = fresh_name([*carried, items_name, flag_name], "text_to_search")
    wanted = benchmark.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null")
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField(text_name, T.StringType()), T.StructField(items_name, T.ArrayType(T.LongType()))])
    out = docs.select(*(docs[c] for c in carried), docs[text_col].alias(text_name), F.array().cast("array<long>").alias(items_name))
    for first in range(0, blocks, blocks_a_pass):
        sent = []
        for block in range(first, min(blocks, first + blocks_a_pass)):
            rows = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()  # about block_chars characters
            sent.append(docs.sparkSession.sparkContext.broadcast(_packed([(r[0], r[1]) for r in rows])))
        if first:
            out = settle(out, "decontaminated")
        out = out.mapInArrow(_search(sent, error_pct, span_chars if len(sent) > 1 else 0), schema)
    return out.drop(text_name).withColumn(flag_name, F.size(items_name) > 0)


def result_names(carried: list[str]) -> tuple[str, str]:
    """What the columns items and contaminated are called beside these."""
    items = fresh_name(carried, "items")
    return items, fresh_name([*carried, items], "contaminated")


def _search(sent: list, error_pct: int, span_chars: int):
    """The step that adds the blocks' items to rows that end in a text and the items found so far."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.num_columns - 2
        texts, now = batch.column(at).to_pylist(), [set(x) for x in batch.column(at + 1).to_pylist()]
        for block in sent:
            machine, patterns = _machine(*block.value, error_pct)
            for text, mine in zip(texts, now):
                mine.update(items_in(text, machine, patterns))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sorted(x) for x in now], pa.list_(pa.int64()))], batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.num_columns - 2).nbytes
            if size > span_chars:
                yield from map(found, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0
        if held:
            yield from map(found, pa.Table.from_batches(held).combine_chunks().to_batches())

    return run
