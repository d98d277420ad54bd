"""Conversation windows that stay exact for one very long conversation.

Ordered scans run in blocks of turns (see ``skew``); ranked cuts are pruned
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.operators.skew import next_in_blocks, running_in_blocks, top_k

# Window sizes.
MEMORY_PAIRS, HISTORY_TOKENS = 5, 2000


def qa_pairs(messages: DataFrame) -> DataFrame:
    """Each answer with the question right before it; unanswered questions drop out.

    System messages do not count; a later question replaces an open one; further
    answers before the next question are left out.
    """
    talk = messages.filter("role <> 'system'").withColumn("m", F.struct("role", "text", "turn"))
    linked = next_in_blocks(talk, ["conv_id"], F.col("turn"), ["turn"], "m", "after")
    return linked.filter("role = 'user' and after.role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("after.turn").alias("answer_turn"), F.col("after.text").alias("answer"))


def rolling_memory(pairs: DataFrame, n: int = MEMORY_PAIRS) -> DataFrame:
    """Last ``n`` pairs per conversation as one text, oldest first."""
    last = top_k(pairs, ["conv_id"], [F.desc("turn")], n)
    line = F.concat(F.lit("- Hỏi: "), "question", F.lit("\n  Đã trả lời: "), "answer")
    items = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("memory"))


def trim_history(messages: DataFrame, limit: int = HISTORY_TOKENS, tokens: Column | None = None) -> DataFrame:
    """Most recent messages whose running token total fits (default: words)."""
    cost = F.size(F.split(F.trim("text"), r"(?U)\s+")) if tokens is None else tokens
    summed = running_in_blocks(messages, ["conv_id"], F.col("turn"), ["turn"], cost.cast("bigint"), "sum", "total", descending=True)
    return summed.filter(F.col("total") <= limit).drop("total")


def state_history(messages: DataFrame) -> DataFrame:
    """Every checkpoint with its message count and last answer; ``turn`` descending is newest first."""
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    counted = running_in_blocks(messages, ["conv_id"], F.col("turn"), ["turn"], F.lit(1), "sum", "n_messages")
    return running_in_blocks(counted, ["conv_id"], F.col("turn"), ["turn"], answer, "last", "last_answer").drop("role", "text")


def rewind(messages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Messages up to a checkpoint (``conv_id, checkpoint``)."""
    return messages.join(checkpoints, "conv_id").filter("turn <= checkpoint").drop("checkpoint")


def thread_summary(messages: DataFrame, clarify: Column, cited: str = r"(?iuU)Điều\s*(\d+)") -> DataFrame:
    """Message count, whether a clarification was asked, and the cited clauses."""
    base = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.coalesce(F.bool_or(clarify), F.lit(False)).alias("needs_clarification"))
    cites = (
        messages.select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(cited), F.lit(1)))).alias("c")).distinct()
        .groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("cited_clauses")))
    return base.join(cites, "conv_id", "left").withColumn("cited_clauses", F.coalesce("cited_clauses", F.lit("")))
