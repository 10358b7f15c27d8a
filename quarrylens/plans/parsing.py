"""Parsers over source files that are written from documents, and a model that is asked about them."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quarrylens.operators import parsers as P
from quarrylens.operators.hook import call_once
from quarrylens.plans.registry import query
from quarrylens.sources.scratch import scratch_path

_LINES = "l AS (SELECT file_path, unnest(string_split(source_code, chr(10))) AS line, generate_subscripts(string_split(source_code, chr(10)), 1) - 1 AS i FROM docs)"


def _written(lines, head, function):
    """A file of a head and a function for each line of a document."""
    return F.concat(F.lit(head), F.array_join(F.transform(lines, function), ""))


@query("ud01_go_functions", f"""WITH $docs, {_LINES}
SELECT file_path AS path, 'L' || i AS func_name, CAST(8 + 4 * i AS INTEGER) AS start_line, CASE WHEN i % 2 = 0 THEN 'func L' || i || '(a int) error' ELSE 'func (s *S) L' || i || '()' END AS signature,
CASE WHEN i % 2 = 0 THEN 'g' ELSE 'h' END || i % 5 AS plain, CASE WHEN i % 2 = 0 THEN 'fmt.Println' ELSE 'u.Get' END AS qualified FROM l WHERE file_path IS NOT NULL""")
def _(t):
    """Go files with a function for each line of a document: functions and methods by turns, the line in a string or in a comment."""
    def function(line, i):
        n, fifth = i.cast("string"), (i % 5).cast("string")
        said = F.regexp_replace(line, r'["\\\\\r]', " ")
        plain = F.concat(F.lit("func L"), n, F.lit('(a int) error {\n\tfmt.Println("'), said, F.lit('")\n\treturn g'), fifth, F.lit("(a)\n}\n"))
        method = F.concat(F.lit("func (s *S) L"), n, F.lit("() {\n\t// "), said, F.lit("\n\tu.Get(h"), fifth, F.lit("())\n}\n"))
        return F.when(i % 2 == 0, plain).otherwise(method)

    body = _written(F.split("source_code", "\n"), 'package main\n\nimport (\n\t"fmt"\n\tu "shop/user"\n)\n\n', function)
    out = P.parse_files(t.sources.select(F.col("file_path").alias("path"), body.alias("content")), "go")
    return out.select("path", "func_name", "start_line", "signature", F.array_join("callee_simple", ",").alias("plain"), F.array_join("callee", ",").alias("qualified"))


@query("ud02_php_functions", f"""WITH $docs, {_LINES} SELECT replace(file_path, '.go', '.php') AS path, 'f' || i AS func_name, CAST(3 + 4 * i AS INTEGER) AS start_line, length(line) + length(CAST(i AS VARCHAR)) + CASE WHEN i % 3 = 0 THEN 31 ELSE 42 END AS code_chars FROM l WHERE file_path IS NOT NULL AND i % 3 < 2""")
def _(t):
    """PHP files with a function for each line of a document, the line in a string or in a comment; every third line names a function that is only spoken of."""
    def function(line, i):
        n = i.cast("string")
        said = F.regexp_replace(F.regexp_replace(line, r"['\\\r]", " "), r"\*/", "* ")
        plain = F.concat(F.lit("function f"), n, F.lit("($a) {\n  return '"), said, F.lit("';\n}\n\n"))
        by_reference = F.concat(F.lit("function &f"), n, F.lit("() {\n  /* function no() { "), said, F.lit(" */\n}\n\n"))
        spoken = F.concat(F.lit("// function g"), n, F.lit("() {\n$b = 'function h() {';\n# "), said, F.lit("\n\n"))
        return F.when(i % 3 == 0, plain).when(i % 3 == 1, by_reference).otherwise(spoken)

    body = _written(F.split("source_code", "\n"), "<?php\n\n", function)
    out = P.parse_files(t.sources.select(F.regexp_replace("file_path", "go$", "php").alias("path"), body.alias("content")), "php")
    return out.select("path", "func_name", "start_line", F.length("code").alias("code_chars"))


def _stub_model(texts: list[str]) -> list[str]:
    """Stands in for an embedding service: what it says depends on the text alone."""
    return [hashlib.md5(x.encode()).hexdigest() for x in texts]


@query("ud07_model_once", "WITH $docs SELECT id, md5(summary) AS answer FROM docs")
def _(t):
    """The model's answer about each document's summary; equal summaries are given to it once."""
    return call_once(t.sources.select("id", "summary"), "summary", _stub_model, scratch_path(t.spark, "model-answers"), "stub-1").select("id", "answer")
