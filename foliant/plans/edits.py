"""Edits of a document by workers: route by size, scatter chunks, gather replies, merge.

Replies are rows; who makes them is outside. A chunk without a reply, as after a failure, keeps its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators.collections import in_turn, last_n

# The models that workers take in turn.
WORKER_MODELS = ["llama-3.1-8b-instant", "moonshotai/kimi-k2-instruct-0905", "openai/gpt-oss-20b", "llama-3.3-70b-versatile", "gemma2-9b-it", "mixtral-8x7b-32768"]
TARGET_CHUNKS, HISTORY = 6, 10


def route(tokens: Column) -> Column:
    return F.when(tokens <= t.SINGLE_CALL_TOKENS, "single").otherwise("parallel")


def scatter(split: DataFrame, key: str, *carried: str) -> DataFrame:
    """A task for each chunk: key, what is carried along, chunk_id from 1, total, chunk, model."""
    rows = split.select(key, *carried, F.size("chunks").alias("total"), F.posexplode("chunks").alias("__at", "chunk"))
    return rows.select(key, *carried, (F.col("__at") + 1).alias("chunk_id"), "total", "chunk", in_turn(F.col("__at"), WORKER_MODELS).alias("model"))


def replied_block(reply: Column) -> Column:
    """The code that a reply holds, null where it holds none."""
    return F.coalesce(F.nullif(t.updated_block(reply), F.lit("")), F.nullif(t.fenced_block(reply), F.lit("")))


def chosen(chunk: Column, found: Column, summary: Column) -> Column:
    """The text to go on with: the code found in a reply, or the chunk where nothing changed, nothing was found, or far too little."""
    short = (t.utf16_length(found) < t.utf16_length(chunk) * 0.5) & (t.utf16_length(chunk) > 500)
    same = F.coalesce(t.says_no_change(summary), F.lit(False))
    return F.when(same | found.isNull() | F.coalesce(short, F.lit(False)), chunk).otherwise(found)


def with_replies(tasks: DataFrame, replies: DataFrame, key: str, arrived: str | None = None) -> DataFrame:
    """Tasks with the reply to each and its status, from replies that come in any order, twice, or not at all.

    Replies are rows of the key, chunk_id, reply and, where a worker failed, error; of several to a task the first to
    arrive stands, or the least one without `arrived`. A task that failed, or that nobody answered, goes on with its own
    chunk as the reply, which leaves the other tasks alone.
    """
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    found = F.struct(F.col("reply").alias("reply"), error.alias("error"))
    first = F.min(found) if arrived is None else F.min_by(found, arrived)
    held = replies.groupBy(F.col(key).alias("__key"), F.col("chunk_id").alias("__chunk")).agg(first.alias("__first"))
    rows = tasks.join(held, tasks[key].eqNullSafe(held["__key"]) & (tasks["chunk_id"] == held["__chunk"]), "left")
    said = F.col("__first.reply")
    why = F.coalesce(F.col("__first.error"), F.when(F.col("__chunk").isNull(), F.lit("no reply")).otherwise("failed"))
    status = F.when(said.isNotNull(), F.lit("completed")).otherwise(F.concat(F.lit("error: "), why))
    return rows.withColumns({"status": status, "reply": F.coalesce(said, F.col("chunk"))}).drop("__key", "__chunk", "__first")


def gather(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """From tasks with their replies: key, what is carried along, chunks in the order of the ids that replies name (else the tasks'), and summaries.

    Where tasks have a status, these come along as well, in the order of the tasks.
    """
    more = ["status"] if "status" in rows.columns else []
    # columns of their own, so that each pattern runs once
    rows = rows.select(key, *carried, *more, "chunk_id", "chunk", t.chunk_id(F.col("reply")).alias("__named"), replied_block(F.col("reply")).alias("__found"), t.changes_summary(F.col("reply")).alias("__summary"))
    line = F.when(F.col("__summary") != "", F.concat(F.lit("**Agent "), F.col("chunk_id").cast("string"), F.lit(":** "), F.col("__summary")))
    # where no id is named the task's stands in, and the task's settles ties
    text = chosen(F.col("chunk"), F.col("__found"), F.col("__summary"))
    item = F.struct(F.coalesce("__named", "chunk_id").alias("a"), F.col("chunk_id").alias("b"), text.alias("text"), line.alias("line"), *more)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__items"), *[F.any_value(c).alias(c) for c in carried])
    by_task = F.array_sort(F.transform("__items", lambda x: F.struct(x["b"].alias("b"), x["status"].alias("status")))) if more else None
    statuses = [F.transform(by_task, lambda x: x["status"]).alias("statuses")] if more else []
    return held.select(key, *carried, F.transform("__items", lambda x: x["text"]).alias("chunks"), F.filter(F.transform("__items", lambda x: x["line"]), lambda x: x.isNotNull()).alias("summaries"), *statuses)


def assembled(preamble: Column, chunks: Column) -> Column:
    """Preamble, chunks, and the end of the document where the preamble opens it and nothing closes it."""
    whole = F.concat(F.when(preamble != "", F.concat(preamble, F.lit("\n"))).otherwise(""), F.array_join(chunks, "\n"))
    open_ = ~whole.contains("\\end{document}") & preamble.contains("\\begin{document}")
    return F.when(open_, F.concat(whole, F.lit("\n\\end{document}\n"))).otherwise(whole)


def summary(tokens: Column, chunks: Column, workers: Column, summaries: Column) -> Column:
    head = F.format_string("✅ **Parallel editing complete!**\n\n📊 Document: ~%d tokens → %d chunks\n🤖 %d agents completed successfully\n\n**Changes Summary:**", tokens, chunks, workers)
    return F.array_join(F.concat(F.array(head), summaries), "\n")


def history(messages: DataFrame, group: str, order: str, role: Column, content: Column, failed: Column, has_code: Column, n: int = HISTORY) -> DataFrame:
    """The last messages of each conversation that didn't fail, without the code and documents that they carry."""
    rows = last_n(messages, group, order, n, ~F.coalesce(failed, F.lit(False)))
    return rows.withColumn("content", t.hide_document(t.hide_code(content, (role == "assistant") & has_code)))
