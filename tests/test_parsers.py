import tracemalloc

import pyarrow as pa

from quarrylens.operators import parsers as P
from quarrylens.plans import catalogue


def go(body):
    return P.go_functions(body)


def test_standard_call_is_qualified():
    (f,) = go('package a\nimport "fmt"\nfunc Foo() { fmt.Println("x") }')
    assert f[0] == "Foo" and f[4] == [] and f[5] == ["fmt.Println"] and f[6] == {"fmt": "fmt"}


def test_method_with_selector():
    (f,) = go("package a\nfunc (s *Svc) Run() error {\n\treturn s.repo.Save(1)\n}")
    assert f[0] == "Run" and f[5] == ["s.repo.Save"] and f[3] == "func (s *Svc) Run() error"


def test_generic_call_is_not_collected():
    (f,) = go("package a\nfunc Foo() { Bar[int](1) }")
    assert f[4] == [] and f[5] == []


def test_two_functions_and_lines():
    a, b = go("package a\n\n\n\n\nfunc foo() {}\n\n\n\nfunc bar() { foo() }\n")
    assert (a[0], a[1], b[0], b[1], b[4]) == ("foo", 6, "bar", 10, ["foo"])


def test_builtins_and_keywords_are_no_calls():
    (f,) = go("package a\nfunc F() { x := make([]int, len(y)); for (true) { }; if (x) { check(x) } }")
    assert f[4] == ["check"]


def test_imports_with_alias_blank_and_dot():
    (f,) = go('package a\nimport (\n\tu "shop/user"\n\t_ "side/effect"\n\t. "dots"\n\t"net/http"\n)\nfunc F() {}')
    assert f[6] == {"u": "shop/user", "http": "net/http"}


def test_nested_calls():
    (f,) = go("package a\nfunc F() { outer(inner(pkg.Deep())) }")
    assert f[4] == ["outer", "inner"] and f[5] == ["pkg.Deep"]


def test_nothing_to_find():
    assert go("package a\nvar x = 1") == [] and go("package a\nfunc F( {") == [] and go(None) == [] and go("") == []


def test_calls_in_strings_and_comments_do_not_count():
    (f,) = go('package a\nfunc F() { s := "call()"; // other()\n /* third() */ r := `raw()` }')
    assert f[4] == [] and f[5] == []


def test_body_less_function_has_no_signature():
    (f,) = go("package a\nfunc F(a int) int\n")
    assert f[0] == "F" and f[3] is None


def php(body):
    return [(n, c) for n, _, c in P.php_functions(body)]


def test_php_comments_and_strings():
    assert php("<?php\n// function a() {}\n# function b() {}\n/* function c() {} */\n$s = 'function d() {}';") == []


def test_php_kinds():
    source = "<?php\nclass A { public function one() { return '}'; } abstract function two(); }\nfunction &three(): int { return 3; }\n$f = function () { };\nfunction four($a = array()) { if ($a) { } }"
    assert [n for n, _ in php(source)] == ["one", "two", "three", "four"] or [n for n, _ in php(source)] == ["one", "three", "four"]


def test_php_lines():
    assert [(n, line) for n, line, _ in P.php_functions("<?php\n\n\nfunction foo() {\n}\n\n\nfunction bar() { }")] == [("foo", 4), ("bar", 8)]
    assert P.php_functions("") == [] and P.php_functions(None) == []


def test_json_candidates():
    assert P.json_candidates('x {"a": "}{"} y {bad} {"b": {"c": 1}}') == ['{"a": "}{"}', '{"b": {"c": 1}}']
    assert P.json_candidates("none") == [] and P.json_candidates(None) == []
    assert P.json_candidates('{a {"k":1}} {"z": 2}') == ['{"z": 2}']  # what does not parse takes its inside along
    assert P.json_candidates('{"a":' + "[" * 200_000) == [] and P.json_candidates('{"a":' + "[" * 200_000 + "]" * 200_000 + "}") == []
    assert P.json_candidates('} "{" {"s": "\\"}"}') == ['{"s": "\\"}"}'] and P.json_candidates('"open {') == []


def test_parse_files(spark):
    files = spark.createDataFrame([("a.go", "package a\nfunc F() { g() }"), ("b.go", None)], "path string, content string")
    assert [(r.path, r.func_name, list(r.callee_simple)) for r in P.parse_files(files, "go").collect()] == [("a.go", "F", ["g"])]


class Fed:
    """Stands in for a DataFrame: keeps what is to run on its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

    def mapInPandas(self, run, schema):
        return lambda batches: run(b.to_pandas() for b in batches)


def peak_of(language, batch):
    """Most bytes that Python holds above the batch itself, and the functions found."""
    run = P.parse_files(Fed(), language)
    tracemalloc.start()
    try:
        found = 0
        for out in run(iter([batch])):
            found += len(out) if hasattr(out, "iloc") else out.num_rows
        return tracemalloc.get_traced_memory()[1], found
    finally:
        tracemalloc.stop()


def assert_memory_is_flat(language, head, function):
    """A batch of four times the files, or a file of four times the functions, takes no four times the memory."""
    files = lambda n, k: pa.record_batch({"path": [f"{i}" for i in range(n)], "content": [head + "".join(function % j for j in range(k))] * n})
    (small, few), (large, many) = peak_of(language, files(500, 20)), peak_of(language, files(2000, 20))
    assert (few, many) == (10_000, 40_000) and large < 1.5 * small, (small, large)
    with_files = P.parsed_batches(iter([files(3, 5000), files(0, 0), files(5, 1)]), language)
    sizes = [b.num_rows for b in with_files]
    assert sum(sizes) == 15_005 and max(sizes) <= P.BATCH_ROWS


def test_go_memory_does_not_grow_with_the_batch():
    assert_memory_is_flat("go", 'package a\n\nimport "fmt"\n\n', 'func F%d() {\n\tfmt.Println(g("some words of a line that stands in a string"))\n}\n')


def test_php_memory_does_not_grow_with_the_batch():
    assert_memory_is_flat("php", "<?php\n\n", "function f%d($a) {\n  return 'some words of a line that stands in a string';\n}\n\n")


def test_batches_of_long_functions_are_short():
    body = "package a\n" + "".join(f"func F{i}() {{\n\t// {'x' * 400_000}\n}}\n" for i in range(7))
    got = list(P.parsed_batches(iter([pa.record_batch({"path": ["a", None, "b"], "content": [body, body, None]})]), "go"))
    assert [b.num_rows for b in got] == [3, 3, 3, 3, 2] and pa.Table.from_batches(got)["path"].to_pylist() == ["a"] * 7 + [None] * 7
    assert [r["func_name"] for b in got for r in b.to_pylist()] == [f"F{i}" for i in range(7)] * 2


def test_all_columns_come_back(spark):
    source = 'package a\nimport u "x/user"\nfunc F() error {\n\tu.Get(g())\n}\nfunc G()\n'
    got = [tuple(r) for r in P.parse_files(spark.createDataFrame([("a.go", source)], "path string, content string"), "go").collect()]
    assert got == [("a.go", *f) for f in P.go_functions(source)] and len(got) == 2
    source = "<?php\nfunction f() { }\n"
    assert [tuple(r) for r in P.parse_files(spark.createDataFrame([("a", source)], "path string, content string"), "php").collect()] == [("a", "f", 2, "function f() { }")]


def test_queries_parse_the_whole_text(spark, tmp_path, monkeypatch):
    texts = ["one\ntwo \"q\" 'p' \\\nlast", "", None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    php = {(r.path, r.func_name): r.code_chars for r in catalogue.QUERIES["ud02_php_functions"](spark, str(tmp_path)).collect()}
    assert php == {("s/en/0.php", "f0"): len("function f0($a) {\n  return 'one';\n}"), ("s/en/0.php", "f1"): len("function &f1() {\n  /* function no() { " + texts[0].split("\n")[1] + " */\n}")} | {
        (f"s/en/{i}.php", "f0"): len("function f0($a) {\n  return '';\n}") for i in (1, 2)
    }
    parsed = []
    monkeypatch.setattr(P, "parse_files", lambda files, language, parse=P.parse_files: parsed.append(files) or parse(files, language))
    assert catalogue.QUERIES["ud01_go_functions"](spark, str(tmp_path)).count() == 5  # a function for each line
    bodies = {r.path: r.content for r in parsed[0].collect()}
    assert 'Println("one")' in bodies["s/en/0.go"] and "// two  q  'p'  \n" in bodies["s/en/0.go"] and 'Println("last")' in bodies["s/en/0.go"] and 'Println("")' in bodies["s/en/2.go"]
