"""The tables of a code-knowledge base, drawn from the tables at hand.

Each adapter is a select, and ``CTES`` has the same select in SQL, so that a query and its SQL
start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.sources.scratch import settle

MODULES = 20  # after the last of so many modules comes the first

MODELS = [  # name, price in, price out, context, requests and tokens a minute, enabled
    ("alpha", 0.001, 0.002, 64000, 60, 100000, True),
    ("beta", 0.0003, 0.0006, 100000, 60, 100000, True),
    ("gamma", 0.0008, 0.002, 32000, 30, 50000, True),
    ("delta", 0.01, 0.03, 128000, 10, 40000, False),
    ("omega", 0.3, 0.5, 200000, 5, 20000, True),
]


class Tables:
    """The adapters over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    @cached_property
    def _source_columns(self) -> list[Column]:
        text, flow = F.coalesce("text", F.lit("")), F.instr(F.coalesce("text", F.lit("")), "\n")
        return [
            F.col("doc_id").alias("id"),
            F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 ELSE 0 END").cast("long").alias("repo_id"),
            F.col("source").alias("module_name"),
            F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("file_path"),
            F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("func_name"),
            (F.col("n_chars") % 500).alias("func_line"),
            text.alias("source_code"),
            F.split_part(text, F.lit("\n"), F.lit(1)).alias("summary"),
            F.when(flow > 0, F.substring(text, flow + 1, F.length(text))).otherwise("").alias("process_flow"),
            F.split_part(text, F.lit("\n"), F.lit(-1)).alias("risk_point"),
        ]

    @cached_property
    def sources(self) -> DataFrame:
        """One function of a repository, without what the labels say: no join, so no text is shuffled."""
        return self.raw("documents").select(*self._source_columns, "n_chars")

    @cached_property
    def docs(self) -> DataFrame:
        """One function of a repository with its document; labels hold at most one row for each."""
        joined = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        return joined.select(*self._source_columns, *self._label_columns)

    @cached_property
    def _label_columns(self) -> list[Column]:
        return [
            F.when(F.col("quality") == 0, 2).otherwise(1).cast("long").alias("content_source"),
            F.coalesce("toxic", F.lit(0)).cast("long").alias("source_code_changed"),
            F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1).otherwise(0).cast("long").alias("is_deleted"),
        ]

    @cached_property
    def active(self) -> DataFrame:
        return self.docs.where("is_deleted = 0")

    @cached_property
    def slim(self) -> DataFrame:
        """Active documents without their text."""
        return self.active.drop("source_code", "summary", "process_flow", "risk_point")

    @cached_property
    def coded(self) -> DataFrame:
        """Active documents without their text, code as a digest: taken before labels are joined, so no text is shuffled."""
        return self.marked(self.sources.select("id", "repo_id", "module_name", "file_path", "func_name", "func_line", F.md5(F.trim("source_code").cast("binary")).alias("code_digest")))

    def marked(self, own: DataFrame) -> DataFrame:
        """Rows of sources, cut down to what is wanted of them, with what the labels say; those of deleted documents are left out."""
        return own.join(self.raw("labels").withColumnRenamed("doc_id", "id"), "id", "left").select(*own.columns, *self._label_columns).where("is_deleted = 0")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))

    @cached_property
    def edges(self) -> DataFrame:
        """Call edges: tables are modules, keys are functions."""
        def typed(df: DataFrame, a: str, x: str, b: str, y: str, kind: int) -> DataFrame:
            return df.select(F.lit(a).alias("caller_module"), F.col(x).cast("string").alias("caller_func"), F.lit(b).alias("callee_module"), F.col(y).cast("string").alias("callee_func"), F.lit(kind).cast("long").alias("call_kind"))

        s, n, c, o, li, p = (self.raw(t) for t in ("supplier", "nation", "customer", "orders", "lineitem", "part"))
        following = p.select("p_partkey", F.expr("lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey)").alias("q")).where("q is not null")
        parts = [
            typed(s, "supplier", "s_suppkey", "nation", "s_nationkey", 2),
            typed(n, "nation", "n_nationkey", "region", "n_regionkey", 2),
            typed(c, "nation", "c_nationkey", "customer", "c_custkey", 2),
            typed(o, "customer", "o_custkey", "orders", "o_orderkey", 2),
            typed(li.select("l_orderkey", "l_partkey").distinct(), "orders", "l_orderkey", "part", "l_partkey", 2),
            typed(li.select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "supplier", "l_suppkey", 2),
            typed(following, "part", "p_partkey", "part", "q", 1),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out

    @cached_property
    def edge_table(self) -> DataFrame:
        """The edges as a stored table, for searches that read them level by level."""
        return settle(self.edges, "call-edges")

    @cached_property
    def relations(self) -> DataFrame:
        """Relations of the documents' modules: each to the next by number, sync and async by turns, every fifth drawn by hand."""
        i = F.col("i")
        return self.raw("documents").where(r"source rlike '^src[0-9]+$'").select(F.substring("source", 4, 18).cast("long").alias("i")).distinct().select(
            (i + 1).alias("id"), F.concat(F.lit("src"), i.cast("string")).alias("from_module"), F.concat(F.lit("src"), ((i + 1) % MODULES).cast("string")).alias("to_module"),
            (1 + i % 2).alias("relation_type"), F.when(i % 5 == 0, 2).otherwise(1).cast("long").alias("source"),
        )

    @cached_property
    def old_code(self) -> DataFrame:
        return self._code("p_size <= 40", F.lit(False))

    @cached_property
    def new_code(self) -> DataFrame:
        return self._code("p_size >= 11", F.col("p_size").between(20, 25))

    def _code(self, where: str, changed: Column) -> DataFrame:
        p = self.raw("part").where(where)
        signature = F.concat(F.lit("func "), F.col("p_name"), F.lit("("), F.col("p_type"), F.when(changed, F.lit(", ctx")).otherwise(""), F.lit(")"))
        return p.select(F.concat("p_brand", F.lit(".go")).alias("file"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("func"), F.col("p_partkey").alias("pos"), signature.alias("signature"))

    @cached_property
    def tasks(self) -> DataFrame:
        """Task events: status follows the kind of event."""
        return self.raw("events").select(
            "event_id", F.col("user_id").alias("task_id"), "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            F.expr("CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END").cast("long").alias("status"),
        )

    @cached_property
    def chat(self) -> DataFrame:
        return self.raw("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def files(self) -> DataFrame:
        """Source files: the path of a page's URL, with a suffix by its host's ending."""
        path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
        suffix = F.when(F.col("url").contains("example.com"), ".go").when(F.col("url").contains("example.net"), ".php").otherwise(".html")
        return self.raw("pages").select(F.col("page_id").alias("id"), F.concat(path, suffix).alias("path"), F.coalesce("html", F.lit("")).alias("content"))

    @cached_property
    def models(self) -> DataFrame:
        return self.rows("name string, price_in double, price_out double, max_context long, rpm long, tpm long, enabled boolean", *MODELS)

    @cached_property
    def offers(self) -> DataFrame:
        """Models on offer: one of each supplier."""
        price = F.abs("s_acctbal") / 1_000_000
        return self.raw("supplier").select(
            F.col("s_name").alias("name"), price.alias("price_in"), (2 * price).alias("price_out"), ((F.col("s_suppkey") % 8) * 16000).alias("max_context"), (F.col("s_suppkey") % 5 != 0).alias("enabled")
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Model calls: one model for each kind of event, ten tokens for each unit of value."""
        return self.tasks.select("event_id", F.col("event_type").alias("model"), F.floor(F.col("us") / 1_000_000).alias("at"), F.floor(F.col("value") * 10).alias("tokens"), (F.col("value") > 50).alias("failed"))


_MODEL_ROWS = ", ".join(f"('{n}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE), CAST({c} AS BIGINT), CAST({r} AS BIGINT), CAST({t} AS BIGINT), {str(e).lower()})" for n, i, o, c, r, t, e in MODELS)

CTES = {
    "docs": r"""docs AS (SELECT d.doc_id AS id,
  CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 ELSE 0 END AS BIGINT) AS repo_id,
  source AS module_name, source || '/' || lang || '/' || d.doc_id || '.go' AS file_path, 'F' || d.doc_id AS func_name,
  n_chars % 500 AS func_line, coalesce(text, '') AS source_code,
  split_part(coalesce(text, ''), chr(10), 1) AS summary,
  CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS process_flow,
  split_part(coalesce(text, ''), chr(10), -1) AS risk_point,
  CAST(CASE WHEN quality = 0 THEN 2 ELSE 1 END AS BIGINT) AS content_source,
  CAST(coalesce(toxic, 0) AS BIGINT) AS source_code_changed,
  CAST(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_deleted
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
active AS (SELECT * FROM docs WHERE is_deleted = 0)""",
    "edges": r"""edges AS (
  SELECT 'supplier' AS caller_module, CAST(s_suppkey AS VARCHAR) AS caller_func, 'nation' AS callee_module, CAST(s_nationkey AS VARCHAR) AS callee_func, CAST(2 AS BIGINT) AS call_kind FROM supplier
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'region', CAST(n_regionkey AS VARCHAR), 2 FROM nation
  UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR), 2 FROM customer
  UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR), 2 FROM orders
  UNION ALL SELECT 'orders', CAST(l_orderkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR), 2 FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), 'supplier', CAST(l_suppkey AS VARCHAR), 2 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), 'part', CAST(q AS VARCHAR), 1 FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q FROM part) WHERE q IS NOT NULL)""",
    "relations": f"""relations AS (SELECT i + 1 AS id, 'src' || i AS from_module, 'src' || ((i + 1) % {MODULES}) AS to_module, 1 + i % 2 AS relation_type,
  CAST(CASE WHEN i % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS source FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS i FROM documents WHERE regexp_matches(source, '^src[0-9]+$')))""",
    "code": r"""old_code AS (SELECT p_brand || '.go' AS file, p_name || '_' || p_partkey AS func, p_partkey AS pos, 'func ' || p_name || '(' || p_type || ')' AS signature FROM part WHERE p_size <= 40),
new_code AS (SELECT p_brand || '.go' AS file, p_name || '_' || p_partkey AS func, p_partkey AS pos,
  'func ' || p_name || '(' || p_type || CASE WHEN p_size BETWEEN 20 AND 25 THEN ', ctx' ELSE '' END || ')' AS signature FROM part WHERE p_size >= 11)""",
    "tasks": r"""tasks AS (SELECT event_id, user_id AS task_id, event_type, value, props, epoch_us(ts) AS us,
  CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 1 END AS BIGINT) AS status FROM events)""",
    "chat": "chat AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)",
    "files": r"""files AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') ||
  CASE WHEN contains(url, 'example.com') THEN '.go' WHEN contains(url, 'example.net') THEN '.php' ELSE '.html' END AS path, coalesce(html, '') AS content FROM pages)""",
    "models": f"models(name, price_in, price_out, max_context, rpm, tpm, enabled) AS (VALUES {_MODEL_ROWS})",
    "offers": "offers AS (SELECT s_name AS name, abs(s_acctbal) / 1000000 AS price_in, 2 * (abs(s_acctbal) / 1000000) AS price_out, s_suppkey % 8 * 16000 AS max_context, s_suppkey % 5 <> 0 AS enabled FROM supplier)",
    "calls": r"""calls AS (SELECT event_id, event_type AS model, epoch_us(ts) // 1000000 AS "at", CAST(floor(value * 10) AS BIGINT) AS tokens, value > 50 AS failed FROM events)""",
}
