"""Parsers of source text: Go and PHP functions, JSON candidates in prose.

One lexer marks strings and comments; everything else works on the source with those blanked
out, where places are the same as in the source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.merge import BUILTINS

GO_FUNCTION = T.StructType([
    T.StructField("func_name", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("callee_simple", T.ArrayType(T.StringType())),
    T.StructField("callee", T.ArrayType(T.StringType())),
    T.StructField("imports", T.MapType(T.StringType(), T.StringType())),
])
PHP_FUNCTION = T.StructType([T.StructField("func_name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("code", T.StringType())])

_GO_QUIET = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)", re.S | re.M)
_PHP_QUIET = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", re.S)
_GO_FUNC = re.compile(r"^func\s*(\([^)]*\)\s*)?([A-Za-z_]\w*)", re.M)
_GO_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\s*\.\s*)*[A-Za-z_]\w*)\s*\(")
_GO_WORDS = frozenset("if for switch select func return go defer range case else var const type struct interface map chan package import".split())
_GO_IMPORT = re.compile(r"^\s*(?:([A-Za-z_]\w*|\.|_)\s+)?\"([^\"]+)\"", re.M)
_PHP_FUNC = re.compile(r"\bfunction\s+&?\s*([A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)\s*\(")


def blank(source: str, quiet: re.Pattern) -> str:
    """The source with strings and comments replaced by spaces; line ends stay."""
    return quiet.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def closing(source: str, at: int, pair: str) -> int:
    """The place of the bracket that closes the one at `at`, or -1."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(source, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return -1


def _go_body(clean: str, at: int) -> int:
    """Where a function's body opens after its name, parameters and results; -1 if it has none."""
    i = at
    while i < len(clean):
        c = clean[i]
        if c == "(" or c == "[":
            i = closing(clean, i, "()" if c == "(" else "[]")
            if i < 0:
                return -1
        elif c == "{":
            before = re.search(r"(interface|struct)\s*$", clean[at:i])
            if not before:
                return i
            i = closing(clean, i, "{}")
            if i < 0:
                return -1
        elif c == "\n":
            return -1
        i += 1
    return -1


def go_imports(source: str) -> dict[str, str]:
    """Alias (or last path segment) to import path; blank and dot imports aside."""
    out: dict[str, str] = {}
    for m in re.finditer(r"^import\s*(?:\((.*?)\)|([^\n]*))", source, re.M | re.S):
        for alias, path in _GO_IMPORT.findall(m[1] if m[1] is not None else m[2]):
            if alias not in ("_", "."):
                out[alias or path.rsplit("/", 1)[-1]] = path
    return out


def _go(source: str | None) -> Iterator[tuple]:
    source = source or ""
    clean = blank(source, _GO_QUIET)
    if not re.search(r"^package\s+\w+", clean, re.M) or any(clean.count(a) != clean.count(b) for a, b in ("()", "{}", "[]")):
        return  # not a Go file, or one that does not parse
    imports = go_imports(re.sub(r"//[^\n]*", lambda m: " " * len(m[0]), source))
    for m in _GO_FUNC.finditer(clean):
        opening = _go_body(clean, m.end())
        end = closing(clean, opening, "{}") if opening >= 0 else -1
        line = 1 + source.count("\n", 0, m.start())
        if opening < 0 or end < 0:
            stop = clean.find("\n", m.start())
            yield m[2], line, source[m.start() : stop if stop >= 0 else len(source)].rstrip(), None, [], [], imports
            continue
        plain, qualified = [], []
        for call in _GO_CALL.finditer(clean, opening, end):
            name = re.sub(r"\s", "", call[1])
            if "." in name:
                qualified.append(name)
            elif name not in _GO_WORDS and name not in BUILTINS and not re.search(r"\bfunc\s+$", clean[opening : call.start()]):
                plain.append(name)
        yield m[2], line, source[m.start() : end + 1], source[m.start() : opening].strip(), plain, qualified, imports


def go_functions(source: str | None) -> list[tuple]:
    """Top-level functions and methods: name, line, code, signature (null without body), plain calls, qualified calls, imports."""
    return list(_go(source))


def _php(source: str | None) -> Iterator[tuple]:
    source = source or ""
    clean = blank(source, _PHP_QUIET)
    for m in _PHP_FUNC.finditer(clean):
        opening = clean.find("{", m.end())
        end = closing(clean, opening, "{}") if opening >= 0 else -1
        if end >= 0:
            yield m[1], 1 + source.count("\n", 0, m.start()), source[m.start() : end + 1]


def php_functions(source: str | None) -> list[tuple]:
    """Named functions with a body: name, line, code from the keyword to the closing brace."""
    return list(_php(source))


_BRACE = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.S)


def json_candidates(text: str | None) -> list[str]:
    """Balanced objects in a text, braces in strings aside, that parse as JSON; outermost, in order.

    An object that does not parse takes what is inside it along, and so does one nested too deeply
    to be read.
    """
    text = text or ""
    out: list[str] = []
    depth = start = 0
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            start = m.start() if not depth else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    json.loads(text[start : m.end()])
                except (ValueError, RecursionError):
                    continue
                out.append(text[start : m.end()])
    return out


def balanced_json(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(json_candidates)

    return run(text)


#: Functions, and characters of them, that go back to Spark in one batch.
BATCH_ROWS, BATCH_CHARS = 2048, 1 << 20
_CALLS, _IMPORTS = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
_ARROW = {
    "go": pa.schema([("path", pa.string()), ("func_name", pa.string()), ("start_line", pa.int32()), ("code", pa.string()), ("signature", pa.string()), ("callee_simple", _CALLS), ("callee", _CALLS), ("imports", _IMPORTS)]),
    "php": pa.schema([("path", pa.string()), ("func_name", pa.string()), ("start_line", pa.int32()), ("code", pa.string())]),
}


def parsed_batches(batches: Iterable[pa.RecordBatch], language: str) -> Iterator[pa.RecordBatch]:
    """Functions of batches of files (path, content), in batches of a bounded size.

    A batch of files comes with up to 10,000 of them, and its functions in Python take many times
    its bytes; so one file is in Python at a time, with the functions of one batch to go back.
    """
    each, schema = {"go": _go, "php": _php}[language], _ARROW[language]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if f.type == _IMPORTS else c, f.type) for f, c in zip(schema, columns)], schema=schema)

    rows, size = [], 0
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            path = path.as_py()
            for f in each(content.as_py()):
                rows.append((path, *f))
                size += len(f[2]) + sum(len(alias) + len(of) for imports in f[6:] for alias, of in imports.items())
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield sent(rows)
                    rows, size = [], 0
    if rows:
        yield sent(rows)


def parse_files(files: DataFrame, language: str) -> DataFrame:
    """Functions of source files (path, content), one row each, with the path; a file that does not parse has none."""
    kind = {"go": GO_FUNCTION, "php": PHP_FUNCTION}[language]

    def run(batches):
        return parsed_batches(batches, language)

    return files.select("path", "content").mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), *kind.fields]))
