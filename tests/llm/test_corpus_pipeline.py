import pytest

SCHEMA = "doc_id long, text string, row_no string"


def test_one_row_of_each_group_stays(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(7, one, "x"), (7, one, "x"), (None, one + " more", "x"), (None, two, "x"), (None, two, "y"), (None, two + " end", "z"), (3, three, "x"), (3, one, "x"), (9, None, "x"), (9, None, "x"), (None, "", "x")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert got.columns == ["doc_id", "text", "row_no"]
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(k for k in kept if k[0] is not None and k[1]) == [(3, one), (3, three)]
    assert [k[1] in (two, two + " end") for k in kept if k[0] is None and k[1]] == [True]
    assert sum(not k[1] for k in kept) == 3  # texts without words link with nothing


def test_numbered_rows_keep_the_same_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(60))
    plain = [(9, text, ""), (4, text + " more", ""), (12, "other words", "")]
    kept = [{r.doc_id for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} for rows in (plain, [*plain, (None, "alone here", "")])]
    assert kept == [{4, 12}, {4, 12, None}]


def test_every_stage_takes_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one benchmark item that is asked of models"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "s", 1, "k"), (1, text, "s", 1, "k"), (None, None, None, None, None), (2, "", "s", 2, ""), (3, "z " * 60_000, None, 3, "u"), (None, text + " end", "t", 4, "")]
    schema = "doc_id long, text string, source string, taken int, kept string"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            n = got.count()
            assert n <= 2 * len(some)
            if name == "token output":
                assert n == len(some)
            else:
                assert got.columns == docs.columns
                assert got.exceptAll(docs.union(docs)).count() == 0
