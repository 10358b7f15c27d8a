"""Scalar functions over rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.functions import validation as V
from quarrylens.operators.parsers import balanced_json
from quarrylens.plans.registry import query


@query("fn01_truncate", "WITH $docs SELECT id, CASE WHEN length(source_code) > 300 THEN left(source_code, 300) || '...' ELSE source_code END AS short FROM docs")
def _(t):
    return t.sources.select("id", S.truncate(F.col("source_code"), 300).alias("short"))


@query("fn02_token_estimate", r"WITH $docs, a AS (SELECT id, length(source_code) AS n, length(regexp_replace(source_code, '[^\x00-\x7F]', '', 'g')) AS a FROM docs) SELECT id, CAST(n - a + (a + 3) // 4 AS BIGINT) AS tokens FROM a")
def _(t):
    return t.sources.select("id", S.token_estimate(F.col("source_code")).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query("fn03_query_terms", f"WITH $docs, w AS (SELECT id, list_filter(list_transform(regexp_extract_all(source_code, '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS xs FROM docs), u AS (SELECT DISTINCT id, unnest(xs) AS x FROM w) SELECT id, count(*) AS terms, min(x) AS least FROM u GROUP BY id")
def _(t):
    terms = t.sources.select("id", F.explode(S.query_terms(F.col("source_code"))).alias("x"))
    return terms.groupBy("id").agg(F.count("*").alias("terms"), F.min("x").alias("least"))


@query("fn04_module_of_path", "WITH $files SELECT id, coalesce(list_filter(string_split(path, '/'), lambda x: trim(x) <> '')[1], 'default') AS module FROM files")
def _(t):
    return t.files.select("id", S.module_of_path(F.col("path")).alias("module"))


@query("fn05_import_module", "WITH $files SELECT id, string_split(regexp_replace(path, '/$', ''), '/')[-1] AS module FROM files")
def _(t):
    return t.files.select("id", S.import_module(F.col("path")).alias("module"))


@query("fn06_selector", "WITH $files SELECT id, split_part(path, '.', 1) AS alias, CASE WHEN contains(path, '.') THEN substr(path, instr(path, '.') + 1) ELSE '' END AS rest FROM files")
def _(t):
    return t.files.select("id", S.selector_alias(F.col("path")).alias("alias"), S.selector_rest(F.col("path")).alias("rest"))


@query("fn07_func_key", "WITH $docs SELECT id, module_name || '.' || func_name AS key FROM docs")
def _(t):
    return t.sources.select("id", S.function_key(F.col("module_name"), F.col("func_name")).alias("key"))


@query("fn08_normalize_url", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '/$', ''), '\.git$', ''), '^(https|http|ssh)://', ''), '^git@', ''), '^([^:]*):', '\1/') AS key FROM pages")
def _(t):
    return t.raw("pages").select("page_id", S.normalize_url(F.col("url")).alias("key"))


@query("fn09_task_id", "SELECT page_id, 'webhook-' || left(sha1(url || '|main|' || page_id), 16) AS task_id FROM pages")
def _(t):
    return t.raw("pages").select("page_id", S.webhook_task_id(F.col("url"), F.lit("main"), F.col("page_id").cast("string")).alias("task_id"))


@query("fn10_extension", r"WITH $files SELECT id, lower(regexp_extract(path, '\.([^.]+)$', 1)) AS ext FROM files")
def _(t):
    return t.files.select("id", S.extension(F.col("path")).alias("ext"))


@query("fn11_csv_list", "SELECT item_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM benchmark")
def _(t):
    return t.raw("benchmark").select("item_id", F.array_join(S.csv_list(F.col("text")), "|").alias("parts"))


@query("fn12_first_non_empty", "SELECT doc_id, coalesce(CASE WHEN trim(split_part(text, chr(10), 2)) <> '' THEN split_part(text, chr(10), 2) END, CASE WHEN trim(text) <> '' THEN text END, '') AS first FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", S.first_non_empty(F.split_part("text", F.lit("\n"), F.lit(2)), F.col("text")).alias("first"))


_REFS = [("refs/heads/main", "a1"), ("refs/tags/v1", "b2"), ("refs/heads/x/y", "0000000000000000000000000000000000000000"), ("", "")]


@query("fn13_push_event", r"""WITH r(ref, after) AS (VALUES ('refs/heads/main', 'a1'), ('refs/tags/v1', 'b2'), ('refs/heads/x/y', '0000000000000000000000000000000000000000'), ('', ''))
SELECT ref, regexp_replace(ref, '^refs/(heads|tags)/', '') AS branch, starts_with(ref, 'refs/tags/') AS tag, regexp_matches(after, '^0+$') AS deleted FROM r""")
def _(t):
    return t.rows("ref string, after string", *_REFS).select("ref", S.branch_of(F.col("ref")).alias("branch"), S.is_tag(F.col("ref")).alias("tag"), S.is_deletion(F.col("after")).alias("deleted"))


@query("fn14_line_of", "WITH $docs SELECT id, CAST(1 + length(left(source_code, func_line)) - length(replace(left(source_code, func_line), chr(10), '')) AS BIGINT) AS line FROM docs WHERE func_line <= length(source_code)")
def _(t):
    return t.sources.where("func_line <= length(source_code)").select("id", S.line_of(F.col("source_code"), F.col("func_line").cast("int")).alias("line"))


@query("fn15_embed_text", "WITH $docs SELECT id, concat_ws(chr(10), module_name, func_name, summary, process_flow, risk_point) AS body FROM docs")
def _(t):
    return t.sources.select("id", S.embedding_text(*(F.col(c) for c in ("module_name", "func_name", "summary", "process_flow", "risk_point"))).alias("body"))


@query("fn16_safe_int", r"SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '/([^/?#.]+)[^/]*$', 1) AS BIGINT), 0) AS n FROM pages")
def _(t):
    return t.raw("pages").select("page_id", S.safe_int(F.regexp_extract("url", r"/([^/?#.]+)[^/]*$", 1)).alias("n"))


@query("fn17_json_fence", r"""WITH m AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Here: ```json' || chr(10) || props || chr(10) || '```' WHEN 'click' THEN 'so ' || props || ' it is' WHEN 'error' THEN 'nothing' ELSE props END AS msg, props, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE props END AS obj FROM m""")
def _(t):
    e = t.raw("events")
    msg = F.when(F.col("event_type") == "view", F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```"))).when(F.col("event_type") == "click", F.concat(F.lit("so "), "props", F.lit(" it is"))).when(F.col("event_type") == "error", "nothing").otherwise(F.col("props"))
    return e.select("event_id", S.json_object(msg).alias("obj"))


@query("fn18_balanced_json", """SELECT event_id, props AS candidate FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, '{"s": "}{"}' FROM events WHERE props IS NOT NULL""")
def _(t):
    e = t.raw("events")
    said = F.concat(F.lit("first {broken} then "), "props", F.lit(' and {"s": "}{"} end'))
    return e.select("event_id", F.explode(balanced_json(said)).alias("candidate"))


@query("fn19_dependency_json", '''SELECT event_id, CASE event_type WHEN 'view' THEN '["a","' || event_id || '"]' WHEN 'click' THEN '["billing' || event_id || '"]' ELSE '[]' END AS deps FROM events''')
def _(t):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    said = F.when(kind == "view", F.concat(F.lit('["a","'), number, F.lit('"]'))).when(kind == "click", F.concat(F.lit("billing"), number)).when(kind == "error", F.lit(None)).otherwise("")
    return t.raw("events").select("event_id", S.dependency_json(said).alias("deps"))


@query("fn20_snapshot_map", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).cast("long").alias("k"))


@query("fn22_avg_price", "WITH $offers SELECT name, (price_in + price_out) / 2 AS price FROM offers")
def _(t):
    return t.offers.select("name", S.average_price(F.col("price_in"), F.col("price_out")).alias("price"))


@query("fn23_error_class", """WITH e AS (SELECT event_id, [429, 401, 403, 500, 404, 400, 0][event_id % 7 + 1] AS status, CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS kind FROM events)
SELECT event_id, CASE WHEN kind = 'timeout' THEN 'retriable' WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 OR status >= 500 THEN 'retriable' WHEN status >= 400 THEN 'business' ELSE 'retriable' END AS class FROM e""")
def _(t):
    status = F.element_at(F.array(*map(F.lit, (429, 401, 403, 500, 404, 400, 0))), (F.col("event_id") % 7 + 1).cast("int"))
    return t.raw("events").select("event_id", S.error_class(status, F.when(F.col("event_type") == "error", "timeout").otherwise("")).alias("class"))


@query("fn25_l2", "SELECT vec_id AS id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 6) AS distance FROM embeddings")
def _(t):
    one = t.vectors.where("id = 1").select(F.col("embedding").alias("wanted"))
    return t.vectors.crossJoin(F.broadcast(one)).select("id", F.round(S.l2_distance(F.col("embedding"), F.col("wanted")), 6).alias("distance"))


@query("fn27_version_default", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'view' THEN 'v1' ELSE ' ' END), ''), nullif(CASE WHEN event_type = 'click' THEN 'main' ELSE '' END, ''), '迭代-' || strftime(ts, '%Y%m%d')) AS version FROM events")
def _(t):
    kind = F.col("event_type")
    return t.raw("events").select("event_id", S.version_default(F.when(kind == "view", "v1").otherwise(" "), F.when(kind == "click", "main").otherwise(""), F.col("ts")).alias("version"))


@query("fn31_impact_tokens", "WITH $chat SELECT conv_id, CAST(600 + 300 * greatest(count(*) - 1, 1) AS BIGINT) AS tokens FROM chat GROUP BY conv_id")
def _(t):
    return t.chat.groupBy("conv_id").agg((F.count("*") - 1).alias("n")).select("conv_id", S.impact_tokens(F.col("n")).cast("long").alias("tokens"))


@query("fn32_safe_path", "WITH $files, p AS (SELECT id, ['', '../', '/', 'a/../', 'a/../../', './'][id % 6 + 1] || path AS path FROM files) SELECT id, path, id % 6 IN (0, 3, 5) AS safe FROM p")
def _(t):
    before = F.element_at(F.array(*map(F.lit, ("", "../", "/", "a/../", "a/../../", "./"))), (F.col("id") % 6 + 1).cast("int"))
    return t.files.select("id", F.concat(before, "path").alias("path")).withColumn("safe", S.safe_path(F.col("path")))


@query("pf22_impact_requests", f"""WITH e AS (SELECT event_id, ['both', ' ', 'sideways', 'upstream', ''][event_id % 5 + 1] AS direction, CASE WHEN event_type IN ('view', 'error') THEN 'main' ELSE ' ' END AS branch, event_id % 3 = 0 AS f, CASE WHEN event_type = 'click' THEN 'how' END AS query FROM events)
SELECT event_id, CASE WHEN direction = 'sideways' THEN '{V.BAD_DIRECTION}' WHEN CAST(branch = 'main' AS INT) + CAST(f AS INT) + CAST(query IS NOT NULL AS INT) > 1 THEN '{V.MANY_SEEDS}' ELSE '' END AS error FROM e""")
def _(t):
    """What is wrong with requests for an impact."""
    kind, n = F.col("event_type"), F.col("event_id")
    direction = F.element_at(F.array(*map(F.lit, ("both", " ", "sideways", "upstream", ""))), (n % 5 + 1).cast("int"))
    functions = F.when(n % 3 == 0, F.array(F.lit("order.Create"))).when(n % 3 == 1, F.array().cast("array<string>"))
    error = V.impact_error(direction, F.when(kind.isin("view", "error"), "main").otherwise(" "), functions, F.when(kind == "click", "how"))
    return t.raw("events").select("event_id", error.alias("error"))


@query("pf22_relation_requests", f"""WITH r AS (SELECT doc_id, source AS a, CASE doc_id % 5 WHEN 0 THEN ' ' || source || ' ' WHEN 1 THEN ' ' ELSE source || 'x' END AS b, doc_id % 4 AS kind, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'me' END AS creator FROM documents)
SELECT doc_id AS id, CASE WHEN trim(coalesce(a, '')) = '' OR trim(coalesce(b, '')) = '' THEN '{V.NO_MODULE}' WHEN trim(a) = trim(b) THEN '{V.SAME_MODULE}' WHEN kind NOT IN (1, 2) THEN '{V.BAD_TYPE}' WHEN creator = '' THEN '{V.NO_CREATOR}' ELSE '' END AS error FROM r""")
def _(t):
    """What is wrong with relations that are drawn by hand."""
    n, source = F.col("doc_id"), F.col("source")
    target = F.when(n % 5 == 0, F.concat(F.lit(" "), source, F.lit(" "))).when(n % 5 == 1, " ").otherwise(F.concat(source, F.lit("x")))
    return t.raw("documents").select(n.alias("id"), V.relation_error(source, target, n % 4, F.when(n % 7 == 0, "").otherwise("me")).alias("error"))


@query("fn33_dates", "SELECT event_id, epoch_us(ts) // 1000000 AS unix, strftime(ts + INTERVAL 7 DAY, '%Y%m%d') AS expires FROM events")
def _(t):
    at = F.col("ts").cast("timestamp")
    return t.raw("events").select("event_id", F.unix_timestamp(at).alias("unix"), F.date_format(F.col("ts") + F.expr("interval 7 days"), "yyyyMMdd").alias("expires"))


@query("fn34_page_count", "WITH $docs SELECT module_name, CAST(greatest(1, ceil(count(*) / 7.0)) AS BIGINT) AS pages FROM docs GROUP BY 1")
def _(t):
    return t.sources.groupBy("module_name").agg(F.count("*").alias("n")).select("module_name", S.page_count(F.col("n"), F.lit(7)).cast("long").alias("pages"))


@query("fn36_snapshot_json", """SELECT c_custkey, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' AS snapshot FROM customer""")
def _(t):
    row = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return t.raw("customer").select("c_custkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("snapshot"))


_KEY = b"shared secret"


def _blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


@query("fn24_signature", f"""WITH m AS (SELECT event_id, event_type || ':' || props AS msg FROM events WHERE props IS NOT NULL), s AS (SELECT event_id, msg, sha256({_blob(S.hmac_pads(_KEY)[1])} || from_hex(sha256({_blob(S.hmac_pads(_KEY)[0])} || encode(msg)))) AS signature FROM m)
SELECT event_id, signature, event_id % 3 = 0 AS accepted FROM s""")
def _(t):
    said = t.raw("events").where("props is not null").select("event_id", S.hmac_sha256(_KEY, F.concat_ws(":", "event_type", "props")).alias("signature"))
    sent = F.when(F.col("event_id") % 3 == 0, F.col("signature")).otherwise(F.reverse("signature"))
    return said.select("event_id", "signature", (sent == F.col("signature")).alias("accepted"))


@query("fn29_placeholders", "SELECT event_id, CASE event_type WHEN 'view' THEN 'a=1/seen/' WHEN 'click' THEN 'a=1/hit/' ELSE 'a=1//' END || '${' AS filled FROM events")
def _(t):
    text = F.concat(F.lit("a=${A}/${"), "event_type", F.lit("}/${NONE}${"))
    return t.raw("events").select("event_id", S.expand_placeholders(text, {"A": "1", "view": "seen", "click": "hit"}).alias("filled"))


@query("fn30_random_ids", "SELECT count(*) AS n, count(*) AS different, 32 AS length FROM events")
def _(t):
    ids = t.raw("events").select(S.random_id().alias("id"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("different"), F.max(F.length("id")).alias("length"))


@query("sc20_push_payloads", """WITH p AS (SELECT event_id, event_type AS k, 'https://git.example.com/r' || user_id || '.git' AS url FROM events)
SELECT event_id, CASE k WHEN 'view' THEN 'gitlab' WHEN 'click' THEN 'gitlab' WHEN 'purchase' THEN 'gitee' WHEN 'signup' THEN 'gitee' ELSE '' END AS provider, CASE WHEN k IN ('view', 'click', 'purchase', 'signup') THEN url END AS repo_url,
CASE WHEN k IN ('view', 'signup') THEN 'b/' || event_id END AS branch, k IN ('click', 'purchase') AS tag, k = 'signup' AS deleted, CASE WHEN k IN ('view', 'click', 'purchase', 'signup') THEN '' ELSE 'event' END AS error FROM p""")
def _(t):
    url = F.concat(F.lit("https://git.example.com/r"), F.col("user_id").cast("string"), F.lit(".git"))
    kind = F.col("event_type")
    branch = F.concat(F.lit("refs/heads/b/"), F.col("event_id").cast("string"))
    body = F.to_json(F.struct(
        F.when(kind == "view", "push").when(kind == "click", "tag_push").alias("object_kind"), F.when(kind == "purchase", "push_hooks").when(kind == "signup", "push_hooks").alias("hook_name"),
        F.when(kind == "purchase", "refs/tags/v1").otherwise(branch).alias("ref"), F.when(kind == "signup", "0" * 40).otherwise("abc").alias("after"),
        F.struct(F.when(kind != "click", url).alias("git_http_url")).alias("repository"), F.struct(F.when(kind == "click", url).alias("git_http_url")).alias("project"),
    ))
    return t.raw("events").select("event_id", S.push_event(body).alias("e")).select("event_id", "e.provider", "e.repo_url", "e.branch", "e.tag", "e.deleted", "e.error")
