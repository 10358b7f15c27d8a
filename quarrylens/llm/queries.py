"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import (
    conversation_repair,
    decontamination,
    html_extraction,
    language_id,
    license_scan,
    line_dedup,
    merkle_manifest,
    minhash_dedup,
    quality_rules,
    secret_scan,
    sharding,
    source_mixing,
    token_output,
)
from quarrylens.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    shards = token_output.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_output.read_token_docs(spark, shards, folder)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep_columns=["doc_id"])


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"), keep_columns=["doc_id"])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    grown = sharding.rendezvous(F.col("doc_id"), sharding.SHARDS + 1, sharding.SEED)
    return sharding.shuffle_into_shards(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", grown.cast("int").alias("grown_shard"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(_table(spark, sf_dir, "pages"), keep_columns=["page_id", "url"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_benchmark_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep_columns=["doc_id"])


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"), keep_columns=["doc_id"]).drop("detections")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(damaged(_table(spark, sf_dir, "conversations")), present=F.col("fate") != 0)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with faults by crc32(conv_id:turn) % 20, the fate of a row: 0 is to be dropped."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text, fate = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" ")), F.col("fate")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("fate"))
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("copy", F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    torn = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    received = [torn if c == "text" else F.col(c) for c in merkle_manifest.FIELDS]
    return merkle_manifest.merkle_manifest(_table(spark, sf_dir, "documents"), received=received)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_quality_rules,
        op3_minhash_dedup,
        op4_source_mixing,
        op5_sharding,
        op6_html_extraction,
        op7_language_id,
        op8_line_dedup,
        op9_secret_scan,
        op10_decontamination,
        op11_license_scan,
        op12_conversation_repair,
        op13_merkle_manifest,
    )
}

#: crc32 of a DuckDB string of characters below 128, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
  list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))"""

ORACLES: dict[str, str] = {
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.b, r.root FROM r JOIN both_ways ON r.doc_id = both_ways.a),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.root AS component_id, sh.doc_id = m.root AS kept
FROM sh JOIN m USING (doc_id)""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l),
k AS (SELECT doc_id, n, ws, len(ws) AS c, array_to_string(ws, ' ') AS s FROM w WHERE len(ws) >= 3),
f AS (SELECT s, any_value(ws) AS ws, any_value(c) AS c, min((doc_id, n)) AS pos FROM k GROUP BY s),
v AS (SELECT s, pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS d FROM (SELECT s, ws, pos, unnest(range(1, c + 1)) AS i FROM f WHERE c >= 8)),
near AS (SELECT a.s FROM v a JOIN v b ON a.d = b.d AND a.i = b.i WHERE b.pos < a.pos
  UNION SELECT a.s FROM v a JOIN f ON a.d = f.s AND f.c >= 8 WHERE f.pos < a.pos
  UNION SELECT f.s FROM v a JOIN f ON a.d = f.s AND f.c >= 8 WHERE a.pos < f.pos),
gone AS (SELECT k.doc_id, k.n FROM k JOIN f USING (s) WHERE (k.doc_id, k.n) > f.pos OR k.s IN (SELECT s FROM near)),
m AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS out FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_dropped, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (out), '') AS dropped,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT out), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, length(coalesce(kept, '')) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN r USING (doc_id)""",
    "op12_conversation_repair": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT conv_id, turn, role, text, """
    + _CRC32.format("k")
    + r""" % 20 AS fate FROM c),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM d),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM o),
x AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM again),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM x GROUP BY conv_id),
ins(s, t, ins, insc, said) AS (VALUES ('', '', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''), ('', 'u', 'I', 2, chr(10) || 'user:'), ('s', 'u', 'I', 2, chr(10) || 'user:'), ('a', 'u', 'I', 2, chr(10) || 'user:'),
  ('u', 'a', 'I', 2, chr(10) || 'assistant:'), ('', 'a', 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
nxt(t, role, e) AS (VALUES ('', 'user', 'u'), ('s', 'user', 'u'), ('a', 'user', 'u'), ('u', 'assistant', 'a')),
w(conv_id, i, s, cost, audit, said) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', 0, '', '' FROM d
  UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit, best.said FROM (
    SELECT conv_id, i, s, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
      SELECT w.conv_id, x.i, m.s, w.cost + ins.insc + m.c AS cost, w.audit || ins.ins || m.l AS audit, w.said || ins.said || m.said AS said
      FROM w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 JOIN ins ON ins.s = w.s JOIN nxt ON nxt.t = ins.t,
      LATERAL (SELECT 'D' AS l, 3 AS c, ins.t AS s, '' AS said
        UNION ALL SELECT 'R', 2 + CAST(x.fault = 'truncated' AS INT), nxt.e, chr(10) || nxt.role || ':' || x.text WHERE x.fault NOT IN ('blank', 'duplicate')
        UNION ALL SELECT 'K', CAST(x.fault = 'truncated' AS INT), x.r, chr(10) || x.role || ':' || x.text WHERE x.fault NOT IN ('blank', 'duplicate') AND (x.r = nxt.e OR x.r = 's' AND ins.t = '')) AS m)
    GROUP BY conv_id, i, s)),
fin AS (SELECT w.conv_id, min({'cost': w.cost + ins.insc, 'audit': w.audit || ins.ins, 'said': w.said || ins.said}) AS best FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.rows JOIN ins ON ins.s = w.s WHERE ins.t IN ('', 'a') GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text, """
    + "".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END AS f_{c}, " for c in merkle_manifest.FIELDS)
    + rf"""CASE WHEN doc_id IS NOT NULL AND {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS torn
  FROM documents),
h AS (SELECT doc_id, source, sha256(f_doc_id || f_source || f_lang || f_n_chars || f_text) AS leaf,
  sha256(f_doc_id || f_source || f_lang || f_n_chars || CASE WHEN torn IS NULL THEN '-' ELSE strlen(torn) || ':' || torn END) AS got FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, count(*) OVER (PARTITION BY source) AS n FROM h),
t(s, lvl, i, h, n) AS (SELECT s, 0, i, leaf, n FROM d
  UNION ALL SELECT s, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY s, lvl, i // 3, n),
top AS (SELECT s, h, lvl FROM t WHERE n = 1),
u(lvl, i, h, n) AS (SELECT 0, s - 1, h, (SELECT count(*) FROM top) FROM top
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (SELECT s, lvl, i, h FROM t WHERE n > 1 UNION ALL SELECT top.s, top.lvl + u.lvl, u.i, u.h FROM u, top WHERE u.n > 1),
steps AS (SELECT d.s, d.i, nodes.lvl, nodes.i AS pos, nodes.h, nodes.i = p AS own FROM
  (SELECT d.s, d.i, l.lvl, CASE WHEN l.lvl < top.lvl THEN d.i // CAST(3 ** l.lvl AS BIGINT) ELSE (d.s - 1) // CAST(3 ** (l.lvl - top.lvl) AS BIGINT) END AS p
   FROM d JOIN top USING (s) JOIN (SELECT DISTINCT s, lvl FROM nodes) l USING (s)) d JOIN nodes ON nodes.s = d.s AND nodes.lvl = d.lvl AND nodes.i // 3 = p // 3),
proof AS (SELECT s, i, sha256(coalesce(string_agg(h, '' ORDER BY lvl, pos) FILTER (NOT own), '')) AS proof FROM steps GROUP BY s, i),
fold(s, i, lvl, h) AS (SELECT s, i, 0, got FROM d
  UNION ALL SELECT fold.s, fold.i, fold.lvl + 1, sha256(string_agg(CASE WHEN own THEN fold.h ELSE steps.h END, '' ORDER BY pos)) FROM fold JOIN steps ON steps.s = fold.s AND steps.i = fold.i AND steps.lvl = fold.lvl GROUP BY fold.s, fold.i, fold.lvl),
ends AS (SELECT s, i, arg_max(h, lvl) AS h FROM fold GROUP BY s, i),
root AS (SELECT h FROM u WHERE n = 1)
SELECT d.doc_id, d.leaf, top.h AS subroot, root.h AS root, coalesce(proof.proof, sha256('')) AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM d JOIN top USING (s) JOIN ends ON ends.s = d.s AND ends.i = d.i LEFT JOIN proof ON proof.s = d.s AND proof.i = d.i CROSS JOIN root""",
}
