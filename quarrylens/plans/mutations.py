"""State changes as joins: each query gives the state or the log after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import mutation as U
from quarrylens.operators import sessions as C
from quarrylens.operators import stored as T
from quarrylens.plans.registry import query
from quarrylens.sources.scratch import scratch_path
from quarrylens.plans.windows import _TEN, _sessions

_EDITS = "edits(id, summary, risk_point) AS (VALUES (1, 'new summary', ''), (2, '', 'new risk'), (99999999, 'lost', 'lost'))"


def _edits(t):
    return t.rows("id long, summary string, risk_point string", (1, "new summary", ""), (2, "", "new risk"), (99999999, "lost", "lost"))


@query("sk02_nonzero_update", f"WITH $docs, {_EDITS} SELECT d.id, coalesce(nullif(e.summary, ''), d.summary) AS summary FROM active d LEFT JOIN edits e ON e.id = d.id")
def _(t):
    return U.update_non_empty(t.active, _edits(t), "id", ["summary"]).select("id", "summary")


@query("sk03_update_fields", "WITH $docs SELECT id, CASE WHEN func_name = 'F5' THEN 2 ELSE content_source END AS content_source FROM active")
def _(t):
    return U.update_fields(t.slim, F.col("func_name") == "F5", content_source=F.lit(2).cast("long")).select("id", "content_source")


@query("sk04_logical_delete", "WITH $docs SELECT id, CAST(CASE WHEN source_code_changed = 1 THEN 1 ELSE is_deleted END AS BIGINT) AS is_deleted FROM docs")
def _(t):
    return U.update_fields(t.docs, F.col("source_code_changed") == 1, is_deleted=F.lit(1).cast("long")).select("id", "is_deleted")


@query("sk05_hard_delete", "WITH $docs SELECT id FROM active WHERE id NOT IN (SELECT item_id FROM benchmark)")
def _(t):
    return U.delete_by_id(t.slim, t.raw("benchmark").select(F.col("item_id").alias("id"))).select("id")


@query("sk06_replace_partition", "WITH $code SELECT file, func, signature FROM old_code WHERE file NOT IN (SELECT file FROM new_code WHERE file LIKE 'Brand#1%') UNION ALL SELECT file, func, signature FROM new_code WHERE file LIKE 'Brand#1%'")
def _(t):
    cols = ["file", "func", "signature"]
    return U.replace_partition(t.old_code.select(*cols), t.new_code.where("file like 'Brand#1%'").select(*cols), ["file"])


@query("sk06_stored_partition", "WITH $code SELECT file, func, signature FROM old_code WHERE file NOT IN (SELECT file FROM new_code WHERE file LIKE 'Brand#1%') UNION ALL SELECT file, func, signature FROM new_code WHERE file LIKE 'Brand#1%'")
def _(t):
    """The same on a stored table: only the slots of the files that changed are written."""
    cols, schema, table = ["file", "func", "signature"], "file string, func string, signature string", scratch_path(t.spark, "stored-code")
    new = t.new_code.where("file like 'Brand#1%'").select(*cols)
    T.create(t.old_code.select(*cols), table, ["file"], 16)
    log = new.groupBy("file").agg(F.count("*").alias("functions"))
    T.replace(t.spark, table, schema, ["file"], new.select("file"), new, log, scratch_path(t.spark, "stored-log"), 1, 16)
    return T.read(t.spark, table, schema).select(*cols)


@query("sk07_get_or_create", "WITH have(name) AS (VALUES ('src1'), ('src2'), ('other')) SELECT name, false AS created FROM have UNION ALL SELECT DISTINCT source, true FROM documents WHERE source NOT IN (SELECT name FROM have)")
def _(t):
    have = t.rows("name string", ("src1",), ("src2",), ("other",))
    return U.get_or_create(have, t.raw("documents").select(F.col("source").alias("name")), ["name"])


@query("sk11_edit_partial", f"WITH $docs, {_EDITS} SELECT d.id, 1 AS operate_type, coalesce(nullif(e.summary, ''), d.summary) AS after_summary, coalesce(nullif(e.risk_point, ''), d.risk_point) AS after_risk, d.summary AS before_summary, 'system' AS operator FROM active d JOIN edits e ON e.id = d.id")
def _(t):
    state, log = U.edit_docs(t.active, _edits(t), ["summary", "risk_point"], operator="")
    after, before = F.from_json("after_content", "summary string, risk_point string"), F.from_json("before_content", "summary string")
    return log.select(F.col("doc_id").alias("id"), "operate_type", after["summary"].alias("after_summary"), after["risk_point"].alias("after_risk"), before["summary"].alias("before_summary"), "operator")


@query("sk12_reset_from_origin", "WITH $docs SELECT id, CASE WHEN id % 3 = 0 THEN summary END AS summary, id % 3 = 0 AS restored FROM docs")
def _(t):
    origin = F.when(F.col("id") % 3 == 0, F.to_json(F.struct("summary", "risk_point"))).when(F.col("id") % 3 == 1, "").otherwise("not json")
    return U.restore_origin(t.sources.select("id", origin.alias("origin"))).select("id", "summary", "restored")


@query("sk13_add_relation", """WITH $relations, n AS (SELECT from_module, CASE id % 3 WHEN 0 THEN to_module WHEN 1 THEN from_module ELSE 'src' || ((id + 1) % 20) END AS to_module, relation_type FROM relations)
SELECT from_module, to_module, relation_type, 2 AS source FROM n WHERE from_module <> to_module AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.from_module = n.from_module AND r.to_module = n.to_module)""")
def _(t):
    """Of relations drawn by hand a third exist already and a third are of a module to itself."""
    two_on = F.concat(F.lit("src"), ((F.col("id") + 1) % 20).cast("string"))
    to = F.when(F.col("id") % 3 == 0, F.col("to_module")).when(F.col("id") % 3 == 1, F.col("from_module")).otherwise(two_on)
    return U.add_relations(t.relations, t.relations.select("from_module", to.alias("to_module"), "relation_type"))[0]


@query("sk14_delete_relation", "WITH $relations SELECT id, CASE WHEN id IN (3, 4) THEN 1 ELSE 0 END AS is_deleted FROM relations")
def _(t):
    live = t.relations.withColumn("is_deleted", F.lit(0))
    return U.update_fields(live, F.col("id").isin(3, 4), is_deleted=F.lit(1)).select("id", "is_deleted")


@query("sk15_change_log", "WITH $docs, $code SELECT d.id AS doc_id, 'func ' || n.func AS change FROM new_code n JOIN active d ON d.id = n.pos JOIN old_code o ON o.pos = n.pos WHERE o.signature <> n.signature")
def _(t):
    changed = t.new_code.join(t.old_code.select("pos", F.col("signature").alias("was")), "pos").where("signature <> was")
    return changed.join(t.slim.select(F.col("id").alias("pos")), "pos").dropDuplicates(["pos"]).select(F.col("pos").alias("doc_id"), F.concat(F.lit("func "), "func").alias("change"))


_UPSERT = "u AS (SELECT vec_id AS id, label, 0 AS version FROM embeddings UNION ALL SELECT item_id, -1, 1 FROM benchmark)"


@query("sk16_vector_upsert", f"WITH {_UPSERT} SELECT id, CAST(label AS BIGINT) AS label FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def _(t):
    new = t.raw("benchmark").select(F.col("item_id").alias("id"), F.lit(-1).cast("long").alias("label"), F.lit(1).alias("version"))
    return U.upsert(t.vectors.select("id", "label", F.lit(0).alias("version")).unionByName(new), "id", "version").select("id", "label")


@query("sk17_vector_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def _(t):
    return U.delete_by_id(t.vectors.select("id"), t.raw("benchmark").select(F.col("item_id").alias("id")))


@query("sk19_chat_trim", f"WITH $chat, {_TEN} SELECT session, pos FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 12")
def _(t):
    return C.trim(_sessions(t), 12).select("session", "pos")


@query("sk20_task_status", "WITH $tasks SELECT task_id, status, us AS updated FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY us DESC, event_id DESC) = 1")
def _(t):
    last = t.tasks.groupBy("task_id").agg(F.max(F.struct("us", "event_id", "status")).alias("m"))
    return last.select("task_id", "m.status", F.col("m.us").alias("updated"))


@query("sk21_retry_increment", "WITH $tasks SELECT task_id, CAST(least(3, count(*) FILTER (status = 3)) AS BIGINT) AS retry_count, CASE WHEN count(*) FILTER (status = 3) > 3 THEN 3 ELSE 0 END AS status FROM tasks GROUP BY task_id")
def _(t):
    failed = F.count_if(F.col("status") == 3)
    return t.tasks.groupBy("task_id").agg(failed.alias("f")).select("task_id", F.least(F.lit(3).cast("long"), "f").alias("retry_count"), F.when(F.col("f") > 3, 3).otherwise(0).alias("status"))


@query("sk22_token_expiry", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 1000)")
def _(t):
    orders = t.raw("orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    expired = orders.where("o_orderdate <= timestamp_ntz'1996-01-01'").orderBy("o_orderdate", "id").limit(1000)
    return U.delete_by_id(orders, expired).select(F.col("id").alias("o_orderkey"))


@query("sk23_repo_status", """WITH r AS (SELECT c_custkey AS id, c_name AS name, 1 AS status FROM customer), e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 20 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') ELSE c_name || '!' END AS name, 2 AS status FROM customer WHERE c_custkey % 10 = 0)
SELECT r.id, CASE WHEN x.id <> e.id THEN r.name ELSE e.name END AS name, CASE WHEN x.id <> e.id THEN r.status ELSE e.status END AS status FROM r JOIN e USING (id) LEFT JOIN r x ON x.name = e.name""")
def _(t):
    """Every tenth repository is renamed, half of them to a name that another one has."""
    c = t.raw("customer")
    repos = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("status"))
    next_name = F.concat(F.lit("Customer#"), F.lpad((F.col("id") + 1).cast("string"), 9, "0"))
    edits = repos.where("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, next_name).otherwise(F.concat("name", F.lit("!"))).alias("name"), F.lit(2).alias("status"))
    return U.edit_unique(repos, edits, "name")


@query("sk25_finding_status", """WITH f AS (SELECT doc_id AS id, CASE WHEN n_chars % 3 = 0 THEN 'fixed' ELSE 'open' END AS status FROM documents), u AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 0 THEN 'bogus' ELSE 'fixed' END AS status FROM labels)
SELECT f.id, CASE WHEN u.status IN ('open', 'fixed', 'false_positive') THEN u.status ELSE f.status END AS status FROM f LEFT JOIN u USING (id)""")
def _(t):
    """Findings of documents, whose status the labels change; a status that is none changes nothing."""
    found = t.raw("documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 == 0, "fixed").otherwise("open").alias("status"))
    wanted = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 0, "bogus").otherwise("fixed")
    return U.set_finding_status(found, t.raw("labels").select(F.col("doc_id").alias("id"), wanted.alias("status")))
