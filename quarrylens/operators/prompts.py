"""Prompts about an impact: what was changed, who calls it, what it calls.

The wording is a fixed value.  A prompt names at most ``most`` functions of each kind, those of
least depth first, so no group of a request's functions is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S

MOST = 200
CHANGED, UPSTREAM, DOWNSTREAM = "changed", "upstream", "downstream"

# fixed values: the prompts' headings and forms
_IMPACT_HEAD = "本次迭代影响分析结果如下（来自代码知识库 Wiki 函数级调用图与业务文档）：\n\n"
_SECTIONS = {CHANGED: "【直接修改的函数】\n", UPSTREAM: "\n【上游调用方（受改动波及的调用链）】\n", DOWNSTREAM: "\n【下游被调用函数（改动牵连的依赖）】\n"}
_IMPACT_END = "\n请基于以上信息输出 JSON 格式的变更说明与影响分析。"
_CHANGE_HEAD = "请为下列被修改函数逐一生成个性化变更记录：\n"
_CHANGE_END = "\n输出 entries 数组，每条针对对应函数（change_summary 必须针对该函数，不得与其他函数雷同）。"
_CALLS = " 调用了 "


def edge_text(caller: Column, callee: Column) -> Column:
    """How a prompt tells one call."""
    return F.concat(caller, F.lit(_CALLS), callee)


def _least(functions: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each group, with their place, by depth, module and function."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("depth", F.lit(0)), "module", "func", F.coalesce("edge", F.lit(""))))
    return functions.withColumn("place", place).where(F.col("place") <= most)


def _listed(line: Column, only: Column) -> Column:
    """An aggregate: the lines of some rows in order of their place, none if there are none."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("place", line.alias("line"))))), lambda x: x["line"]), "")


def impact_prompts(functions: DataFrame, most: int = MOST) -> DataFrame:
    """request and prompt, from functions: request, kind (changed, upstream or downstream), module, func, file, summary, and of those that are not changed depth and edge (edge_text)."""
    name, said = S.function_key(F.col("module"), F.col("func")), F.coalesce("summary", F.lit(""))
    changed = F.format_string("- %s (文件 %s)\n  摘要: %s\n", name, F.coalesce("file", F.lit("")), said)
    called = F.format_string("- [深度%d] %s %s\n  摘要: %s\n", F.coalesce("depth", F.lit(0)), name, F.coalesce("edge", F.lit("")), said)
    parts = {k: _listed(changed if k == CHANGED else called, F.col("kind") == k).alias(k) for k in _SECTIONS}
    told = _least(functions, ["request", "kind"], most).groupBy("request").agg(*parts.values())
    section = lambda k: F.when((F.col(k) != "") | F.lit(k == CHANGED), F.concat(F.lit(_SECTIONS[k]), k)).otherwise("")
    return told.select("request", F.concat(F.lit(_IMPACT_HEAD), *map(section, _SECTIONS), F.lit(_IMPACT_END)).alias("prompt"))


def change_prompts(functions: DataFrame, most: int = MOST) -> DataFrame:
    """request and prompt that asks for a note on each changed function, with its own callers and callees; functions as for impact_prompts."""
    few = _least(functions, ["request", "kind"], most)
    name = S.function_key(F.col("module"), F.col("func"))
    around = few.where(F.col("kind") != CHANGED).select("request", "kind", "depth", "place", F.split("edge", _CALLS, 2).alias("ends")).where(F.size("ends") == 2)
    own = F.when(F.col("kind") == UPSTREAM, F.col("ends")[1]).otherwise(F.col("ends")[0])
    other = F.when(F.col("kind") == UPSTREAM, F.col("ends")[0]).otherwise(F.col("ends")[1])
    told = F.concat(other, F.lit("(深度"), F.col("depth").cast("string"), F.lit(")"))
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", told.alias("told"))))), lambda x: x["told"]), "、").alias(k)
    calls = around.groupBy("request", own.alias("name")).agg(joined(UPSTREAM), joined(DOWNSTREAM))
    entries = few.where(F.col("kind") == CHANGED).withColumn("name", name).join(calls.hint("merge"), ["request", "name"], "left")
    line = lambda head, k: F.when(F.coalesce(k, F.lit("")) != "", F.concat(F.lit(head), k, F.lit("\n"))).otherwise("")
    entry = F.concat(
        F.format_string("\n【%s】文件 %s\n  摘要: %s\n", "name", F.coalesce("file", F.lit("")), F.coalesce("summary", F.lit(""))), line("  上游调用方: ", UPSTREAM), line("  下游依赖: ", DOWNSTREAM)
    )
    return entries.groupBy("request").agg(_listed(entry, F.lit(True)).alias("entries")).select("request", F.concat(F.lit(_CHANGE_HEAD), "entries", F.lit(_CHANGE_END)).alias("prompt"))
