"""License scans by ordered signature rules.

A text is read as words: A-Z in lower case; letters, digits and characters beyond ASCII are word
characters.  The rules of license_rules are expressions over the words, joined by one space, and
each names a keyword.  A text's words are met once with the set of all keywords, and only rules
whose keyword is among them are tried, so a text without a keyword costs one pass.

Matches are detections: first word, number of words, label, priority.  They are taken by
priority, then length, then place, then the order of the rules; a detection whose interval lies
within that of one taken before is suppressed.  So a version beats the bare name it begins with,
and the sentence of a license beats what it quotes.  Detections that merely overlap both stay.

The base is the places of four phrases.  Its labels stay whatever the rules find; the labels of
detections that are not suppressed are added.  The score is a hundredth of the highest priority
among both, a base place counting ``BASE_PRIORITY``; 0 where there is nothing.

One task reads its rows and needs no others: there is no shuffle.  Defined cases: null is the
empty text, which has no words and no labels; texts of any length are read whole; repeated rows
are scanned each; ties of priority, length and place go to the earlier rule; an empty table
gives no rows; of columns beside the text only those to keep are read, and result columns whose
names are taken get underscores in front.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm import license_rules
from quarrylens.llm.common import fresh_name, values

BASE_PRIORITY = 60

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class Detection(NamedTuple):
    first_word: int
    n_words: int
    label: str
    priority: int


class Rules:
    """Rules that are ready to run: an expression is compiled when its keyword is first met."""

    def __init__(self, rules: list[tuple[str, int, str, str]]):
        self.rules = rules
        self.by_keyword: dict[bytes, list[int]] = defaultdict(list)
        for i, (_, _, keyword, _) in enumerate(rules):
            self.by_keyword[keyword.encode()].append(i)
        self.keywords = frozenset(self.by_keyword)
        self._compiled: dict[int, re.Pattern] = {}

    def expression(self, i: int) -> re.Pattern:
        if i not in self._compiled:
            self._compiled[i] = re.compile(rb"(?<!\S)(?:" + self.rules[i][3].encode() + rb")(?!\S)")
        return self._compiled[i]

    def matches(self, words: list[bytes], joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all matches in the joined words, of rules whose keyword is there."""
        tried = sorted(i for keyword in self.keywords.intersection(words) for i in self.by_keyword[keyword])
        return [(m.start(), m.end(), i) for i in tried for m in self.expression(i).finditer(joined)]


_BASE = [(phrase.encode(), label, re.compile(rb"(?<!\S)" + phrase.encode() + rb"(?!\S)")) for phrase, label in license_rules.BASE]


def text_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def unsuppressed(found: list[tuple[int, int, int]], rules: list[tuple[str, int, str, str]]) -> list[tuple[int, int, int]]:
    """Those of (start, end, rule) that no detection taken before contains."""
    kept = []
    starts: list[int] = []  # of intervals taken that are in no other: their ends ascend too
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda x: (-rules[x[2]][1], x[0] - x[1], x[0], x[2])):
        i = bisect_right(starts, start)
        if i and ends[i - 1] >= end:
            continue
        kept.append((start, end, rule))
        first = i - 1 if i and starts[i - 1] == start else i
        last = i
        while last < len(ends) and ends[last] <= end:
            last += 1
        starts[first:last], ends[first:last] = [start], [end]
    return kept


def _numbered(joined: bytes, starts: list[int]) -> dict[int, int]:
    """The number of the word at each of some starts, by one pass."""
    out, at, number = {}, 0, 0
    for start in sorted(set(starts)):
        number += joined.count(b" ", at, start)
        out[start], at = number, start
    return out


def scan_text(text: str, rules: Rules) -> tuple[int, list[tuple[int, str]], list[Detection]]:
    """Number of words, base places (first word, label) in order, detections in order of place."""
    words = text_words(text)
    joined = b" ".join(words)
    places = [(m.start(), label) for phrase, label, rule in _BASE if phrase in joined for m in rule.finditer(joined)]
    kept = unsuppressed(rules.matches(words, joined), rules.rules)
    number = _numbered(joined, [start for start, *_ in [*places, *kept]])
    detections = [Detection(number[start], joined.count(b" ", start, end) + 1, *rules.rules[i][:2]) for start, end, i in kept]
    return len(words), sorted((number[start], label) for start, label in places), sorted(detections)


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep_columns: list[str] | None = None, rules: list[tuple[str, int, str, str]] | None = None) -> DataFrame:
    """The kept columns of every row of docs (all unless named) and n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    rules: label, priority (to 100), keyword and expression of each; those of license_rules unless given.
    """
    carried = docs.columns if keep_columns is None else keep_columns
    found = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType())])
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "detections": T.ArrayType(found)}
    arrow = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))]
    names: list[str] = []
    for c in kinds:
        names.append(fresh_name([*carried, *names], c))
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, k) for n, k in zip(names, kinds.values()))])
    given = license_rules.parsed() if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Rules(given)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for text in values(batch.column(batch.num_columns - 1)):
                n_words, places, detections = scan_text(text or "", ready)
                base = {label for _, label in places}
                strongest = max([d.priority for d in detections] + [BASE_PRIORITY] * bool(places), default=0)
                row = (
                    n_words, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
                    ",".join(sorted(base | {d.label for d in detections})), strongest / 100, [d._asdict() for d in detections],
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(out, arrow))], schema.names)

    return docs.select(*(docs[c] for c in carried), docs[text_col].alias(fresh_name([*carried, *names], "text_to_scan"))).mapInArrow(run, schema)
