"""Chat sessions: windows, roll-up, trimming, titles, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scalars as S

WINDOW, TRIGGER, KEEP, TITLE = 12, 20, 12, 20


def rollup_split(messages: DataFrame, trigger: int = TRIGGER, keep: int = KEEP) -> DataFrame:
    """overflow: messages to be rolled up, all but the last keep once a session has more than trigger."""
    n = F.count("*").over(Window.partitionBy("session"))
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))
    return messages.withColumn("overflow", (n > trigger) & (back > keep))


def trim(messages: DataFrame, keep: int = KEEP) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))
    return messages.withColumn("back", back).where(F.col("back") <= keep).drop("back")


def titles(messages: DataFrame, most: int = TITLE) -> DataFrame:
    """A session's title: its first user message, cut."""
    first = messages.where("role = 'user'").groupBy("session").agg(F.min_by("text", "pos").alias("text"))
    return first.select("session", S.truncate(F.col("text"), most).alias("title"))


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages with new ones (session, role, text, in the order of at) after the last of their session."""
    last = messages.groupBy("session").agg(F.max("pos").alias("last"))
    at = F.row_number().over(Window.partitionBy("session").orderBy("at"))
    placed = new.withColumn("nth", at).join(last, "session", "left").withColumn("pos", F.coalesce("last", F.lit(-1)) + F.col("nth"))
    return messages.unionByName(placed.select(*messages.columns))


def delete(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("session"), "session", "left_anti")


def save_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Meta records by session: fields of new that are not empty replace the old ones, unknown sessions are added."""
    names = [c for c in meta.columns if c != "session"]
    both = meta.join(new.select("session", *(F.col(c).alias(f"new_{c}") for c in names)), "session", "full_outer")
    filled = lambda c: F.when(F.col(f"new_{c}").cast("string") == "", None).otherwise(F.col(f"new_{c}"))
    return both.select("session", *(F.coalesce(filled(c), F.col(c)).alias(c) for c in names))


def roll_up(messages: DataFrame, meta: DataFrame, summarize, trigger: int = TRIGGER, keep: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """(messages kept, meta with new summaries): sessions beyond trigger fold all but the last keep into their summary.

    summarize makes a Column of (old summary, text of the messages folded); an empty result
    leaves the summary as it was.
    """
    split = rollup_split(messages, trigger, keep)
    folded = split.where("overflow").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("all"))
    said = F.array_join(F.transform("all", lambda m: F.concat(m["role"], F.lit(": "), m["text"], F.lit("\n"))), "")
    fresh = folded.join(meta.select("session", F.col("summary").alias("was")), "session", "left").select("session", summarize(F.coalesce("was", F.lit("")), said).alias("summary"))
    others = [c for c in meta.columns if c not in ("session", "summary")]
    return split.where("not overflow").drop("overflow"), save_meta(meta, fresh.select("session", "summary", *(F.lit(None).alias(c) for c in others)))


def prompts(messages: DataFrame, window: int = WINDOW, field_most: int = 300, meta: DataFrame | None = None) -> DataFrame:
    """The prompt of each session's last message: the summary, the messages before it in order and cut, what was recalled, the question.

    meta: session, summary and context, where there are any.
    """
    recent = trim(messages, window)
    last = recent.groupBy("session").agg(F.max_by("text", "pos").alias("question"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("all"))  # at most window messages
    said = F.transform(F.slice("all", F.lit(1), F.size("all") - 1), lambda m: F.concat(m["role"], F.lit(": "), S.truncate(m["text"], field_most), F.lit("\n")))
    # fixed values: the prompt's headings
    history = F.when(F.size(said) > 0, F.concat(F.lit("\n[最近对话]\n"), F.array_join(said, ""))).otherwise("")
    if meta is not None:
        last = last.join(meta.select("session", "summary", "context"), "session", "left")
    else:
        last = last.withColumns({"summary": F.lit(""), "context": F.lit("")})
    summary = F.when(F.trim("summary") != "", F.col("summary")).otherwise("（无）")
    context = F.when(F.trim("context") != "", F.concat(F.lit("\n"), "context", F.lit("\n"))).otherwise("")
    return last.select("session", F.concat(F.lit("[历史对话摘要]\n"), summary, F.lit("\n"), history, context, F.lit("\n[当前问题]\n"), "question", F.lit("\n")).alias("prompt"))


def merge_sessions(events: DataFrame, key: str, at_us: str, gap_seconds: int) -> DataFrame:
    """Sessions that end after a gap: key, start, end, n."""
    w = Window.partitionBy(key).orderBy(at_us, "event_id")
    new = (F.col(at_us) - F.lag(at_us).over(w) >= gap_seconds * 1_000_000) | F.lag(at_us).over(w).isNull()
    numbered = events.withColumn("session_no", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(at_us).alias("start"), F.max(at_us).alias("end"), F.count("*").alias("n"))
