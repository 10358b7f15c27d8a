import random

from quarrylens.operators import stored as T

EDGES = "file string, caller string, callee string"


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def rows_of(spark, path):
    return sorted((r.file, r.caller, r.callee) for r in T.read(spark, path, EDGES).collect())


def test_other_slots_are_left_untouched(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"f{r.randrange(40)}.go", f"a{i}", f"b{i % 7}") for i in range(400)]
    table, log = tmp_path / "edges", tmp_path / "log"
    T.create(spark.createDataFrame(rows, EDGES), str(table), ["file"], 16)
    assert rows_of(spark, str(table)) == sorted(rows)
    before = files_of(table)
    gone, new = spark.createDataFrame([("f3.go",)], "file string"), spark.createDataFrame([("f3.go", "x", "y"), ("f3.go", "x", "z")], EDGES)
    change = lambda: T.replace(spark, str(table), EDGES, ["file"], gone, new, spark.createDataFrame([("f3.go", "replaced")], "file string, what string"), str(log), 1, 16)
    slots = change()
    assert len(slots) == 1
    want = sorted([x for x in rows if x[0] != "f3.go"] + [("f3.go", "x", "y"), ("f3.go", "x", "z")])
    assert rows_of(spark, str(table)) == want
    after = files_of(table)
    same = {p for p, at in before.items() if after.get(p) == at}
    assert {p.parent.name for p in before.keys() - same} == {f"slot={slots[0]}"} and same == {p for p in before if p.parent.name != f"slot={slots[0]}"}
    change()  # again, as after a failure: the same rows, the log once
    assert rows_of(spark, str(table)) == want and spark.read.parquet(str(log)).count() == 1


def test_the_log_is_there_before_the_table_changes(spark, tmp_path, monkeypatch):
    table, log = tmp_path / "edges", tmp_path / "log"
    T.create(spark.createDataFrame([("a", "x", "y")], EDGES), str(table), ["file"], 4)
    gone, none = spark.createDataFrame([("a",)], "file string"), spark.createDataFrame([], EDGES)
    said = spark.createDataFrame([("a", "gone")], "file string, what string")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(T, "settle", fails)
    try:
        T.replace(spark, str(table), EDGES, ["file"], gone, none, said, str(log), 7, 4)
    except RuntimeError:
        pass
    assert spark.read.parquet(str(log)).count() == 1 and rows_of(spark, str(table)) == [("a", "x", "y")]
    monkeypatch.undo()
    T.replace(spark, str(table), EDGES, ["file"], gone, none, said, str(log), 7, 4)
    assert rows_of(spark, str(table)) == [] and spark.read.parquet(str(log)).count() == 1  # a slot without rows
    assert T.replace(spark, str(table), EDGES, ["file"], none.select("file"), none, said, str(log), 8, 4) == []
