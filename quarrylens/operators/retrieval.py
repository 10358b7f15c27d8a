"""Hybrid retrieval: vector and keyword recall, ordered union, module expansion, bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S
from quarrylens.operators import listing
from quarrylens.sources.scratch import settle

VECTOR_K, KEYWORD_K, EXPAND_EACH = 10, 5, 5
FIELD_MOST, CONTEXT_BYTES = 300, 6000
KEYWORD_COLUMNS = ("module_name", "func_name", "file_path", "summary", "process_flow", "risk_point")


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors by L2 distance: id, distance.  Filters belong on `vectors`, before the limit; query is one row."""
    one = F.broadcast(query.limit(1).select(F.col("embedding").alias("wanted")))
    return vectors.crossJoin(one).select("id", S.l2_distance(F.col("embedding"), F.col("wanted")).alias("distance")).orderBy("distance", "id").limit(k)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """pos from 0 in a total order; for results of a top-k, which are few."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)


def ordered_union(*channels: DataFrame) -> DataFrame:
    """Distinct ids of several ranked channels (pos, id), earlier channels first; ids must be positive."""
    both = None
    for i, c in enumerate(channels):
        part = c.select(F.lit(i).alias("channel"), "pos", "id").where("id > 0")
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("id").agg(F.min(F.struct("channel", "pos")).alias("at"))
    return ranked(first, F.col("at.channel"), F.col("at.pos")).select("id", "pos", F.col("at.channel").alias("channel"))


def load_in_order(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of ranked ids; missing ones are skipped, the order stays in pos."""
    return docs.join(F.broadcast(ids), "id")  # a top-k


def related_modules(modules: DataFrame, relations: DataFrame) -> DataFrame:
    """Modules one relation away from any of `modules` (module), either way."""
    out = relations.join(modules, F.col("from_module") == F.col("module")).select(F.col("to_module").alias("module"))
    back = relations.join(modules, F.col("to_module") == F.col("module")).select(F.col("from_module").alias("module"))
    return out.union(back).distinct()


def expand(recalled: DataFrame, docs: DataFrame, relations: DataFrame, each: int = EXPAND_EACH) -> DataFrame:
    """Newest documents of modules related to those recalled, at most `each` times their number in all."""
    have = recalled.select(F.col("module_name").alias("module")).distinct()
    wanted = related_modules(have, relations).join(have, "module", "left_anti")
    most = each * wanted.count()  # the cap needs the number of modules before the top-k is planned
    found = docs.join(F.broadcast(wanted.withColumnRenamed("module", "module_name")), "module_name", "left_semi")
    return ranked(found.orderBy(F.desc("id")).limit(most), F.desc("id"))


def newest_by(docs: DataFrame, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))
    return docs.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def recall(docs: DataFrame, vectors: DataFrame, query: DataFrame, word: str) -> DataFrame:
    """Vector and keyword recall of active documents of one repository: ranked ids."""
    near = ranked(vector_top_k(vectors.join(docs.select("id"), "id", "left_semi"), query, VECTOR_K), F.col("distance"), F.col("id"))
    said = ranked(listing.keyword(docs, word, KEYWORD_COLUMNS).select("id").orderBy("id").limit(KEYWORD_K), F.col("id"))
    return ordered_union(near, said)


def hybrid(docs: DataFrame, vectors: DataFrame, query: DataFrame, word: str, relations: DataFrame) -> DataFrame:
    """Recalled documents in order, then those of related modules: pos runs through."""
    ids = recall(docs, vectors, query, word)
    got = settle(load_in_order(ids.select("id", "pos"), docs).withColumn("grp", F.lit(0)), "recalled")  # a dozen rows, read three times
    more = expand(got, docs, relations).withColumn("grp", F.lit(1))
    both = got.unionByName(more)
    return both.withColumn("pos", F.row_number().over(Window.orderBy("grp", "pos")) - 1)  # a few dozen rows


# fixed value: the form of a context entry
_ENTRY = "[%d] 模块:%s 函数:%s 文件:%s:%d\n摘要:%s\n流程:%s\n风险:%s\n"


def context_entries(docs: DataFrame, most_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """Numbered entries of ranked documents up to the first that would overflow the budget; nothing after it is taken."""
    field = lambda c: S.truncate(F.col(c), FIELD_MOST)
    entry = F.format_string(_ENTRY, F.col("pos") + 1, "module_name", "func_name", "file_path", "func_line", field("summary"), field("process_flow"), field("risk_point"))
    sized = docs.withColumn("entry", entry).withColumn("bytes", F.octet_length("entry").cast("long"))
    return sized.withColumn("used", F.sum("bytes").over(Window.orderBy("pos"))).where(F.col("used") <= most_bytes)


# fixed values: what a result says without documents
_NO_DOCUMENTS = "知识库中暂未检索到与当前需求相关的业务文档，缺少对应资料。"
_NOTE = "\n说明：知识库暂未检索到与当前需求匹配的业务文档，建议补充相关代码后重新分析。"


# fixed values: what a result says whose answer could not be read
_UNREAD = "知识库检索完成，但 AI 结构化分析输出解析失败，已基于召回文档返回基础信息，请稍后重试。"
_SUGGESTION = "建议补充/更新知识库文档后重新分析。"


def fallback(requests: DataFrame, recalled: DataFrame) -> DataFrame:
    """What is answered to requests (request) whose answers cannot be read: request, related_modules, related_functions, analysis, risk_points, suggestion, knowledge_missing.

    recalled: request, pos, module_name, id, file_path, func_name, summary of the documents that
    were recalled for each, a top-k.  Modules come in order of their names.
    """
    function = F.struct("id", "file_path", "func_name", S.truncate(F.col("summary"), 100).alias("summary"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", function.alias("f")))), lambda x: x["f"])  # of a top-k
    modules = F.array_sort(F.collect_set(F.when(F.trim("module_name") != "", F.col("module_name"))))
    found = recalled.groupBy("request").agg(listed.alias("related_functions"), modules.alias("related_modules"))
    out = requests.select("request").join(found, "request", "left").withColumn("knowledge_missing", F.col("related_functions").isNull())
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(
        "request", empty("related_modules"), empty("related_functions"), F.when(F.col("knowledge_missing"), _NO_DOCUMENTS).otherwise(_UNREAD).alias("analysis"),
        F.array().cast("array<string>").alias("risk_points"), F.lit(_SUGGESTION).alias("suggestion"), "knowledge_missing",
    )


def degraded(results: DataFrame) -> DataFrame:
    """results (analysis, n: documents recalled) with knowledge_missing, and an analysis that says so."""
    said = F.coalesce("analysis", F.lit(""))
    told = F.when(F.trim(said) == "", F.lit(_NO_DOCUMENTS)).when(~F.contains(said, F.lit("知识库")), F.concat(said, F.lit(_NOTE))).otherwise(said)
    return results.withColumn("knowledge_missing", F.col("n") == 0).withColumn("analysis", F.when(F.col("n") == 0, told).otherwise(F.col("analysis")))
