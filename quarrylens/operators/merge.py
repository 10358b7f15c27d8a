"""Merging parsed functions into documents, retiring ghosts, call-edge extraction, change texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators.numbering import numbered

KEYS = ["repo_id", "file_path", "func_name"]
AUTO, MANUAL = 1, 2
RETIRED = 3

# Names that are no business calls.
BUILTINS = ["make", "len", "cap", "append", "copy", "delete", "new", "panic", "recover", "close", "complex", "real", "imag", "min", "max", "clear", "print", "println"]
STANDARD_IMPORTS = [
    "fmt", "strings", "errors", "strconv", "os", "io", "bytes", "bufio", "time", "context", "sync", "sort", "math", "rand", "regexp", "log", "path", "path/filepath", "runtime",
    "reflect", "unicode", "flag", "hash", "encoding/json", "encoding/xml", "encoding/base64", "encoding/hex", "encoding/binary", "crypto", "crypto/sha1", "crypto/sha256",
    "crypto/md5", "crypto/rsa", "crypto/aes", "crypto/tls", "net", "net/http", "net/url", "database/sql", "mime", "html", "container/list", "io/ioutil",
]


def code_digest(code: Column) -> Column:
    """What tells code apart but for spaces around it."""
    return F.md5(F.trim(code).cast("binary"))


def _in_order(parsed: DataFrame) -> tuple[Window, list[str]]:
    """The functions of one key in the order of their lines; of functions on one line or without one, in the order of their digests."""
    order = [*(["func_line"] if "func_line" in parsed.columns else []), "digest_"]
    return Window.partitionBy(*KEYS).orderBy(*order), order


def merge_actions(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """parsed (KEYS, code, maybe func_line) with what happens to each: insert, hit, flag (manual: review mark only) or overwrite; id of the document, if any.

    A file may hold a name more than once (methods of two types): such functions are merged one
    so each is compared with what the one before it left, and the last wins.  Code is
    compared by digest; existing may bring that as code_digest in place of source_code.
    """
    was = F.col("code_digest") if "code_digest" in existing.columns else code_digest(F.col("source_code"))
    own = existing.select(*KEYS, "id", was.alias("was"), "content_source", "source_code_changed")
    w, _ = _in_order(parsed)
    before = parsed.withColumn("digest_", code_digest(F.col("code"))).withColumn("before_", F.lag("digest_").over(w)).withColumn("again", F.row_number().over(w) > 1)
    same = F.when(F.col("again"), F.col("before_") == F.col("digest_")).otherwise((F.col("source_code_changed") == 0) & (F.col("was") == F.col("digest_")))
    action = (
        F.when(F.col("content_source") == MANUAL, "flag")
        .when(F.col("id").isNull() & ~F.col("again"), "insert")
        .when(same, "hit")
        .otherwise("overwrite")
    )
    return before.join(own, KEYS, "left").withColumn("action", action).drop("digest_", "before_", "again", "was")


#: What a generator writes about a function.
GENERATED = ["summary", "process_flow", "risk_point"]


def _one_for_each_key(parsed: DataFrame) -> DataFrame:
    """KEYS, runs (of equal code, one after another), auto (what an automatic document ends with), manual (what a manual one takes), first.

    Each of equal code after another is a hit and leaves the line of the first, so an automatic
    document ends with the first function of the last run, a manual one with the last function.
    """
    w, order = _in_order(parsed)
    starts = parsed.withColumn("digest_", code_digest(F.col("code"))).withColumn("starts", ~F.col("digest_").eqNullSafe(F.lag("digest_").over(w)) | (F.row_number().over(w) == 1))
    row, place = F.struct(*(c for c in parsed.columns if c not in KEYS)), F.struct(*order)
    return starts.groupBy(*KEYS).agg(
        F.count_if("starts").alias("runs"), F.max_by(row, F.when(F.col("starts"), place)).alias("auto"), F.max_by(row, place).alias("manual"), F.min_by(row, place).alias("first")
    )


def apply_merge(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Documents after the merge, those of new functions included, one for each key.  A second merge of the same code hits every automatic document.

    parsed: KEYS, code, and what it brings of module_name, func_line and GENERATED; functions that
    repeat a key are merged one after another.  A manual document takes code and line alone and
    is marked for review; an automatic one takes all; a new one also keeps what was first
    generated, as origin_auto_doc, which no later merge touches.  New ids follow the greatest
    one in the order of KEYS, however the rows are partitioned.
    """
    brought = _one_for_each_key(parsed)
    fresh = parsed.select(*KEYS).distinct().join(existing.select(*KEYS).hint("merge"), KEYS, "left_anti")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))  # one row
    ids = numbered(fresh, KEYS, "new_id").crossJoin(F.broadcast(last)).select(*KEYS, (F.col("last") + 1 + F.col("new_id")).alias("new_id"))
    both = existing.hint("merge").join(brought, KEYS, "full_outer").join(ids.hint("merge"), KEYS, "left")
    parsed_too, new, manual = F.col("runs").isNotNull(), F.col("id").isNull(), F.col("content_source") == MANUAL
    hit = (F.col("content_source") == AUTO) & (F.col("source_code_changed") == 0) & (F.col("runs") == 1) & (F.trim("source_code") == F.trim("auto.code"))
    flag = parsed_too & ~new & manual
    takes = parsed_too & (new | ~manual & ~F.coalesce(hit, F.lit(False)))
    own = lambda c: F.when(takes, F.col(f"auto.{c}")).otherwise(F.col(c))
    out = {
        "id": F.coalesce("id", "new_id"),
        "source_code": F.when(takes, F.col("auto.code")).when(flag, F.col("manual.code")).otherwise(F.col("source_code")),
        "source_code_changed": F.when(flag, 1).when(takes, 0).otherwise(F.col("source_code_changed")),
        "content_source": F.when(takes, AUTO).otherwise(F.col("content_source")),
    }
    out |= {c: own(c) for c in ["module_name", *GENERATED] if c in parsed.columns}
    if "func_line" in parsed.columns:
        out["func_line"] = F.when(flag, F.col("manual.func_line")).otherwise(own("func_line"))
    if "is_deleted" in existing.columns:
        out["is_deleted"] = F.when(new, 0).otherwise(F.col("is_deleted"))
    if "origin_auto_doc" in existing.columns and set(GENERATED) & set(parsed.columns):
        origin = F.to_json(F.struct(*(F.col(f"first.{c}").alias(c) for c in GENERATED if c in parsed.columns)))
        out["origin_auto_doc"] = F.when(new, origin).otherwise(F.col("origin_auto_doc"))
    return both.select(*(out.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in existing.schema))


def retire_ghosts(existing: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("file", "func")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions that the code no longer has: (retired rows, log rows, vector deletions)."""
    gone = existing.join(current, list(keys), "left_anti")
    return gone, gone.select(*keys, F.lit(RETIRED).alias("operate_type")), gone.select(*keys)


def call_edges(parsed: DataFrame) -> DataFrame:
    """Edges of parsed functions (path, func_name, callee_simple, callee, imports), each pair once.

    Plain calls stay in the module, builtins aside; qualified calls go where the file's imports
    say, standard imports and unresolved names aside.
    """
    module = S.module_of_path(F.col("path"))
    own = parsed.select(module.alias("caller_module"), F.col("func_name").alias("caller_func"), F.explode("callee_simple").alias("f")).where(~F.col("f").isin(BUILTINS))
    intra = own.select("caller_module", "caller_func", F.col("caller_module").alias("callee_module"), F.col("f").alias("callee_func"), F.lit(1).alias("call_kind"))
    calls = parsed.select(module.alias("caller_module"), F.col("func_name").alias("caller_func"), "imports", F.explode("callee").alias("call"))
    found = calls.withColumn("target", F.try_element_at("imports", S.selector_alias(F.col("call")))).withColumn("rest", S.selector_rest(F.col("call")))
    found = found.where(F.col("target").isNotNull() & ~F.col("target").isin(STANDARD_IMPORTS) & (F.col("rest") != ""))
    cross = found.select("caller_module", "caller_func", S.import_module(F.col("target")).alias("callee_module"), F.col("rest").alias("callee_func"), F.lit(2).alias("call_kind"))
    return intra.union(cross).distinct()


def change_text(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """change_summary, impact and attention of each changed function (module, func, and summary if there is one).

    impact names its direct callers and callees.  The wording is a fixed value.
    """
    name = S.function_key(F.col("module"), F.col("func"))
    links = edges.select(S.function_key(F.col("caller_module"), F.col("caller_func")).alias("caller"), S.function_key(F.col("callee_module"), F.col("callee_func")).alias("callee"))
    own = changed.withColumn("name", name)
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "、")  # noqa: E731  neighbours of one function
    ups = links.join(own.select(F.col("name").alias("callee")), "callee", "left_semi").groupBy(F.col("callee").alias("name")).agg(joined("caller").alias("ups"))
    downs = links.join(own.select(F.col("name").alias("caller")), "caller", "left_semi").groupBy(F.col("caller").alias("name")).agg(joined("callee").alias("downs"))
    all_ = own.join(ups, "name", "left").join(downs, "name", "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit("。"))).otherwise("")
    about = F.when(F.trim("summary") != "", F.concat(F.lit("："), "summary")).otherwise("") if "summary" in changed.columns else F.lit("")
    return all_.withColumns({
        "change_summary": F.concat(F.lit("本轮迭代修改 "), "name", about),
        "impact": F.concat(F.lit("修改 "), "name", F.lit("。"), part(" 上游调用方：", "ups"), part(" 下游依赖：", "downs")),
        "attention": F.concat(F.lit("建议回归 "), "name", F.lit(" 及其调用链。")),
    })
