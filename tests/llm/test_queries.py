import duckdb
import pytest

import __spark_entry__ as entry
from quarrylens.llm import queries

from ..conftest import SF

COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32",
    "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3": "doc_id n_shingles component_id kept",
    "op4": "doc_id size source_size target taken",
    "op5": "doc_id size text_crc32 law shard slot grown_shard",
    "op6": "page_id url text n_chars",
    "op7": "doc_id held_out lang_pred score",
    "op11": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op9": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_and_rows(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(got.columns)
    if name.startswith("op12"):
        assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        return
    table = "pages" if name.startswith("op6") else "documents"
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, stage in pipeline.STAGES:
        at = pipeline.settle(stage(spark, at, SF), "pipeline-test")
        seen[name] = at
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "source mixing", "token output"]
    for name, df in list(seen.items())[:-1]:
        assert df.columns == docs.columns and df.exceptAll(docs).count() == (0 if name != "source mixing" else df.count() - df.select("doc_id").distinct().count())
    ids = {n: {r.doc_id for r in df.collect()} for n, df in seen.items()}
    assert ids["quality rules"] == {r.doc_id for r in queries.QUERIES["op2_quality_rules"](spark, SF).where("kept").collect()}
    assert ids["near duplicates"] < ids["quality rules"] and ids["decontamination"] < ids["near duplicates"]
    assert ids["source mixing"] <= ids["decontamination"] and ids["token output"] == ids["source mixing"]
    assert seen["token output"].count() == seen["source mixing"].count()
    assert "pipeline" in entry.queries()
