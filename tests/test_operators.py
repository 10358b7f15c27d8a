import hmac
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import graph as G
from quarrylens.operators import listing as L
from quarrylens.operators import merge as M
from quarrylens.operators import retrieval as R
from quarrylens.operators import sessions as C
from quarrylens.sources.files import list_files, read_files

EDGE = "caller_module string, caller_func string, callee_module string, callee_func string, call_kind int"


def edges(spark, *pairs):
    return spark.createDataFrame([(a[0], a[1:], b[0], b[1:], 2) for a, b in pairs], EDGE)


def reached(df):
    return {(r.module + r.func, r.depth) for r in df.collect()}


def seeds(spark, *names):
    return spark.createDataFrame([(n[0], n[1:]) for n in names], "module string, func string")


def test_bfs_diamond_and_cycle(spark):
    e = edges(spark, ("aA", "tT"), ("bB", "tT"), ("cC", "aA"), ("cC", "bB"), ("tT", "cC"))
    assert reached(G.bfs(e, seeds(spark, "tT"), 2, reverse=True)) == {("aA", 1), ("bB", 1), ("cC", 2)}
    assert reached(G.bfs(e, seeds(spark, "tT"), 9)) == {("cC", 1), ("aA", 2), ("bB", 2)}
    (c,) = [r for r in G.bfs(e, seeds(spark, "tT"), 2, reverse=True).collect() if r.func == "C"]
    assert (c.caller, c.callee) == ("c.C", "a.A")  # the least edge of those that reach it


def test_impact_directions(spark):
    e = edges(spark, ("oCreate", "uGet"), ("uGet", "uUpdate"))
    both = {(r.func, r.kind) for r in G.impact(e, seeds(spark, "uGet")).collect()}
    assert both == {("Create", "reverse"), ("Update", "forward")}
    with pytest.raises(ValueError):
        G.impact(e, seeds(spark, "uGet"), "sideways")


def test_merge_is_idempotent(spark):
    schema = "id long, repo_id long, file_path string, func_name string, source_code string, content_source long, source_code_changed long"
    have = spark.createDataFrame([(1, 1, "a", "f", "x", 1, 0), (2, 1, "a", "g", "y", 2, 0), (3, 1, "a", "h", "z", 1, 0)], schema)
    new = spark.createDataFrame([(1, "a", "f", " x "), (1, "a", "g", "y2"), (1, "a", "h", "z2"), (1, "a", "i", "new")], "repo_id long, file_path string, func_name string, code string")
    actions = lambda d: {r.func_name: r.action for r in M.merge_actions(d, new).collect()}
    assert actions(have) == {"f": "hit", "g": "flag", "h": "overwrite", "i": "insert"}
    after = M.apply_merge(have, new)
    assert actions(after) == {"f": "hit", "g": "flag", "h": "hit", "i": "hit"}
    assert {r.func_name: r.source_code_changed for r in after.collect()} == {"f": 0, "g": 1, "h": 0, "i": 0}
    assert sorted(map(tuple, M.apply_merge(after, new).collect())) == sorted(map(tuple, after.collect()))


def test_merge_keeps_origins_and_manual_texts(spark):
    schema = "id long, repo_id long, module_name string, file_path string, func_name string, func_line long, source_code string, summary string, origin_auto_doc string, content_source long, source_code_changed long"
    have = spark.createDataFrame([(1, 1, "m", "a", "f", 3, "x", "old", '{"summary":"first"}', 1, 0), (2, 1, "m", "a", "g", 4, "y", "by hand", "{}", 2, 0)], schema)
    new = spark.createDataFrame([(1, "n", "a", "f", 5, "x2", "new f"), (1, "n", "a", "g", 6, "y2", "new g"), (1, "n", "b", "h", 7, "z", "new h")], "repo_id long, module_name string, file_path string, func_name string, func_line long, code string, summary string")
    got = {r.func_name: r for r in M.apply_merge(have, new).collect()}
    assert (got["f"].module_name, got["f"].func_line, got["f"].summary, got["f"].origin_auto_doc) == ("n", 5, "new f", '{"summary":"first"}')
    assert (got["g"].module_name, got["g"].func_line, got["g"].summary, got["g"].source_code_changed) == ("m", 6, "by hand", 1)
    assert (got["h"].origin_auto_doc, got["h"].content_source) == ('{"summary":"new h"}', 1) and got["h"].id > 2


def merged_in_turn(have, new):
    """Documents by key, functions merged one after another, and the action of each."""
    docs, actions = {d[0]: dict(zip(("id", "code", "line", "by", "mark", "origin"), d[1:])) for d in have}, []
    fresh = {}
    for key, line, code, summary in sorted(new, key=lambda f: (f[1], f[2])):
        d = docs.get(key)
        if d is None:
            docs[key] = fresh[key] = {"id": None, "code": code, "line": line, "by": 1, "mark": 0, "origin": summary}
            actions.append((key, line, "insert"))
        elif d["by"] == 2:
            d.update(code=code, line=line, mark=1)
            actions.append((key, line, "flag"))
        elif d["mark"] == 0 and d["code"].strip(" ") == code.strip(" "):
            actions.append((key, line, "hit"))
        else:
            d.update(code=code, line=line, mark=0)
            actions.append((key, line, "overwrite"))
    most = max((d[1] for d in have), default=0)
    for n, key in enumerate(sorted(fresh)):
        fresh[key]["id"] = most + 1 + n
    return docs, actions


def test_repeated_names_are_merged_one_after_another(spark):
    r = random.Random(3)
    names = [f"f{i}" for i in range(30)]
    have = [(n, 10 + i, r.choice("xyz"), 0, r.choice([1, 1, 2]), r.choice([0, 0, 1]), None) for i, n in enumerate(names[:20])]
    new = [(n, line, r.choice(["x", " x", "y", "z "]), f"about {line}") for n in names[5:] for line in r.sample(range(1, 99), r.choice([0, 1, 1, 2, 4]))]
    docs, actions = merged_in_turn(have, new)
    existing = spark.createDataFrame([(d[1], 1, "a", d[0], d[3], d[2], "s", d[6], d[4], d[5]) for d in have], "id long, repo_id long, file_path string, func_name string, func_line long, source_code string, summary string, origin_auto_doc string, content_source long, source_code_changed long")
    parsed = spark.createDataFrame([(1, "a", *f) for f in new], "repo_id long, file_path string, func_name string, func_line long, code string, summary string")
    assert sorted((x.func_name, x.func_line, x.action) for x in M.merge_actions(existing, parsed).collect()) == sorted(actions)
    for parts in (1, 7):  # ids too are the same however the rows lie
        after = M.apply_merge(existing.repartition(parts), parsed.repartition(parts)).collect()
        got = {x.func_name: {"id": x.id, "code": x.source_code, "line": x.func_line, "by": x.content_source, "mark": x.source_code_changed, "origin": json.loads(x.origin_auto_doc)["summary"] if x.origin_auto_doc else None} for x in after}
        assert len(after) == len(docs) and got == docs


def test_ordered_union_has_no_repeats(spark):
    a = spark.createDataFrame([(0, 4), (1, 2), (2, 0)], "pos int, id int")
    b = spark.createDataFrame([(0, 2), (1, 9)], "pos int, id int")
    assert [r.id for r in R.ordered_union(a, b).orderBy("pos").collect()] == [4, 2, 9]


def test_context_stops_at_the_first_overflow(spark):
    doc = lambda i, n: (i, "m", "f", "p", 1, "s" * n, "", "")
    docs = spark.createDataFrame([doc(0, 10), doc(1, 300), doc(2, 10)], "pos int, module_name string, func_name string, file_path string, func_line int, summary string, process_flow string, risk_point string")
    assert [r.pos for r in R.context_entries(docs, 200).collect()] == [0]


@pytest.mark.parametrize(
    ("path", "reason"),
    [("", "blank"), ("a.py", "extension"), ("noext", "extension"), ("vendor/a.go", "directory"), ("x/mock/a.go", "directory"), ("a_test.go", "pattern"), ("vendors/a.go", ""), ("a/b.PHP", "")],
)
def test_file_rules(spark, path, reason):
    assert spark.createDataFrame([(path,)], "p string").select(L.skip_reason(F.col("p"))).first()[0] == reason


def test_query_terms(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string").select(S.query_terms(F.col("s"))).first()[0]
    assert one("The Order order of get_user 编辑管理 单 x1") == ["order", "get_user", "编辑", "辑管", "管理", "单"]
    assert one("a of !!") == []


def test_keyword_blank(spark):
    assert L.keyword(spark.createDataFrame([("x",)], "c string"), "  ", ["c"]).count() == 0


def test_scalars_handle_null_and_empty(spark):
    row = spark.createDataFrame([(None, "")], "n string, e string")
    got = row.select(S.truncate(F.col("n"), 3), S.truncate(F.col("e"), 3), S.module_of_path(F.col("e")), S.safe_int(F.col("n")), S.leading_int(F.col("e")), S.extension(F.col("e"))).first()
    assert tuple(got) == (None, "", "default", 0, 0, "")


def test_stable_plan_has_no_python(spark):
    from quarrylens.plans import catalogue

    from .conftest import SF

    plan = catalogue.QUERIES["rt01_hybrid_retrieval"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    assert isinstance(pd.__version__, str)


def test_push_payloads(spark):
    gitlab = '{"object_kind":"push","ref":"refs/heads/main","before":"a","after":"b","project":{"git_http_url":"https://h/r.git"}}'
    cases = {
        gitlab: ("gitlab", "https://h/r.git", "main", False, False, ""),
        gitlab.replace('"object_kind":"push"', '"hook_name":"push_hooks"'): ("gitee", "https://h/r.git", "main", False, False, ""),
        gitlab.replace("push", "tag_push"): ("gitlab", "https://h/r.git", None, True, False, ""),
        gitlab.replace("refs/heads/main", "refs/tags/v1"): ("gitlab", "https://h/r.git", None, True, False, ""),
        gitlab.replace('"after":"b"', f'"after":"{"0" * 40}"'): ("gitlab", "https://h/r.git", "main", False, True, ""),
        gitlab.replace("git_http_url", "html_url"): ("gitlab", "https://h/r.git", "main", False, False, ""),
        gitlab.replace("git_http_url", "other"): ("gitlab", None, "main", False, False, "url"),
        gitlab.replace("refs/heads/main", ""): ("gitlab", "https://h/r.git", None, False, False, "branch"),
        '{"object_kind":"merge"}': ("", None, None, False, False, "event"),
        "{broken": ("", None, None, False, False, "json"),
        "": ("", None, None, False, False, "body"),
    }
    got = spark.createDataFrame([(c,) for c in cases], "body string").select("body", S.push_event(F.col("body")).alias("e")).collect()
    assert {r.body: (r.e.provider, r.e.repo_url, r.e.branch, r.e.tag, r.e.deleted, r.e.error) for r in got} == cases


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_parse_and_one_lower_a_row(spark):
    """Whatever reads the fields of a payload, or the hits of a query, does the costly step once for each place that uses it."""
    got = spark.range(3).select(F.concat(F.lit("{"), F.col("id").cast("string")).alias("body"))
    plan = plan_of(got.select(S.push_event(F.col("body")).alias("e")).select("e.*"))
    assert plan.count("from_json") == 1 and "get_json_object" not in plan and "parse_json" not in plan
    docs = spark.range(3).select(*(F.col("id").cast("string").alias(c) for c in ("module_name", "func_name", "file_path", "summary", "process_flow", "risk_point")))
    plan = plan_of(L.relevant(docs, "token password reader stupid").select("hits"))
    assert plan.count("lower(") == 2  # the filter and the column that passes on


def test_change_text(spark):
    e = edges(spark, ("oCreate", "uGet"), ("uGet", "uUpdate"))
    changed = spark.createDataFrame([("u", "Get", "reads a user"), ("x", "Lone", " ")], "module string, func string, summary string")
    got = {r.func: r for r in M.change_text(changed, e).collect()}
    assert got["Get"].change_summary == "本轮迭代修改 u.Get：reads a user" and got["Get"].impact == "修改 u.Get。 上游调用方：o.Create。 下游依赖：u.Update。"
    assert got["Lone"].change_summary == "本轮迭代修改 x.Lone" and got["Lone"].attention == "建议回归 x.Lone 及其调用链。"


def test_degraded_results(spark):
    rows = [("", 0), ("some words", 0), ("知识库 says", 0), ("fine", 3), (None, 0)]
    got = [(r.knowledge_missing, r.analysis) for r in R.degraded(spark.createDataFrame(rows, "analysis string, n long")).collect()]
    assert got[0] == got[4] == (True, "知识库中暂未检索到与当前需求相关的业务文档，缺少对应资料。")
    assert got[1][1].startswith("some words\n说明：") and got[2][1] == "知识库 says" and got[3] == (False, "fine")


def test_chat_store(spark):
    has = spark.createDataFrame([("a", i, "user", f"m{i}") for i in range(25)] + [("b", 0, "user", "hi")], "session string, pos long, role string, text string")
    more = C.append(has, spark.createDataFrame([("a", 5, "assistant", "x"), ("a", 6, "user", "y"), ("c", 1, "user", "z")], "session string, at long, role string, text string"))
    assert {(r.session, r.pos, r.text) for r in more.where("text in ('x', 'y', 'z')").collect()} == {("a", 25, "x"), ("a", 26, "y"), ("c", 0, "z")}
    assert C.delete(has, spark.createDataFrame([("a",)], "session string")).count() == 1
    meta = spark.createDataFrame([("a", "title", "old"), ("b", "t", "")], "session string, title string, summary string")
    kept, after = C.roll_up(has, meta, lambda was, said: F.concat(was, F.lit("|"), F.left(said, F.lit(9))))
    assert kept.where("session = 'a'").count() == C.KEEP and kept.where("session = 'b'").count() == 1
    assert {r.session: (r.title, r.summary) for r in after.collect()} == {"a": ("title", "old|user: m0\n"), "b": ("t", "")}
    told = C.prompts(has.where("session = 'b'"), meta=spark.createDataFrame([("b", "sum", "ctx")], "session string, summary string, context string")).first().prompt
    assert told == "[历史对话摘要]\nsum\n\nctx\n\n[当前问题]\nhi\n"


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    (tmp_path / "a.go").write_text("package a\n")
    (tmp_path / "x y" / "b.go").write_text("package b\nfunc F() {}\n")
    (tmp_path / "c.txt").write_text("no")
    assert {(r.path, r.bytes) for r in list_files(spark, str(tmp_path), "*.go").collect()} == {("a.go", 10), ("x y/b.go", 22)}
    assert {(r.path, r.content) for r in read_files(spark, str(tmp_path), "*.go").collect()} == {("a.go", "package a\n"), ("x y/b.go", "package b\nfunc F() {}\n")}


def test_signature_of_the_standard_library(spark):
    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("some text é",)], "s string").select(S.hmac_sha256(key, F.col("s"))).first()[0]
        assert got == hmac.new(key, "some text é".encode(), "sha256").hexdigest()


def test_top_k_is_by_the_raw_distance(spark):
    vectors = spark.createDataFrame([(1, [1.0 + 2e-8]), (2, [1.0 + 1e-8])], "id long, embedding array<double>")
    assert [r.id for r in R.vector_top_k(vectors, spark.createDataFrame([([1.0],)], "embedding array<double>"), 2).collect()] == [2, 1]
