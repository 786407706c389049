"""Conversations within a context budget: prune oldest turns to a soft limit, then cut the last message to a hard one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens a message costs besides its text, spare tokens and characters a token where a message is cut.
OVERHEAD, SPARE, CHARS_A_TOKEN = 4, 50, 3.5
#: Fixed value: what a cut message ends with.
NOTICE = "\n\n--- Maximum Length Limit Reached ---\nThe response is truncated.\n\n--- Final Step Reached ---\nYou must offer your final answer now."


def message_text(content: Column, name: Column | None = None, call: Column | None = None) -> Column:
    """Content, name and function call of a message as they count."""
    parts = [F.nullif(content, F.lit(""))]
    if name is not None:
        parts.append(F.concat(F.lit("name: "), F.nullif(name, F.lit(""))))
    if call is not None:
        parts.append(F.concat(F.lit("function_call: "), F.nullif(call, F.lit(""))))
    return F.concat_ws("\n", *parts)


def message_chars(role: Column, text: Column) -> Column:
    """Characters of ``role: text`` and a line break; 0 without text."""
    return F.when(F.length(text) > 0, F.length(F.coalesce(role, F.lit(""))) + F.length(text) + 3).otherwise(0).cast("long")


def list_tokens(chars: Column, messages: Column, tools: int = 0) -> Column:
    """Tokens of a list of messages: a quarter of the characters, an overhead each, and the tools' definitions."""
    return F.floor(chars / 4).cast("long") + OVERHEAD * messages + tools


def limit_context(messages: DataFrame, conversation: str, order: str, role: str, content: str, soft: int = 120_000, hard: int = 128_000, tools: int = 0, notice: str = NOTICE, head: int = 2) -> DataFrame:
    """The messages that are sent: ``messages`` without pruned turns, with ``status, token_count, original_count, n_pruned``.

    The first ``head`` messages stay. A turn is an assistant's message with all up to the next one; while the rest is over
    ``soft``, the oldest turn goes, the last one too; messages that no assistant leads stay. If what is left is over
    ``hard``, the last message is cut and ends with ``notice``. A limit of -1 is none. ``status`` is OK, PRUNED or
    HARD_LIMIT_EXCEEDED. Null contents cost their overhead only. Rows of equal order are taken in any order; give a whole one.

    What is left after dropping turns is a suffix total, so a conversation is one window, which spills, and no loop.
    """
    whole, by = Window.partitionBy(conversation), Window.partitionBy(conversation).orderBy(order)
    up_to, one = by.rowsBetween(Window.unboundedPreceding, 0), F.lit(1).cast("long")
    m = messages.withColumn("_c", message_chars(F.col(role), message_text(F.col(content)))).withColumn("_n", F.row_number().over(by))
    m = m.withColumn("_turn", F.sum(((F.col(role) == "assistant") & (F.col("_n") > head)).cast("int")).over(up_to))
    m = m.withColumn("_turn", F.coalesce("_turn", F.lit(0))).withColumn("original_count", list_tokens(F.sum("_c").over(whole), F.sum(one).over(whole), tools))
    loose = F.col("_turn") == 0
    later = Window.partitionBy(conversation).orderBy(F.desc("_turn")).rangeBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.when(loose, F.col("_c")).otherwise(0)).over(whole) + F.sum(F.when(loose, 0).otherwise(F.col("_c"))).over(later)
    count = F.sum(F.when(loose, one).otherwise(0)).over(whole) + F.sum(F.when(loose, 0).otherwise(one)).over(later)
    over = F.lit(False) if soft == -1 else F.col("original_count") > soft
    fits = loose | ~over | (list_tokens(chars, count, tools) <= soft)
    kept = m.withColumn("_fits", fits).withColumn("n_pruned", F.sum((~F.col("_fits")).cast("long")).over(whole)).where("_fits")

    size, rows = F.sum("_c").over(whole), F.sum(one).over(whole)
    kept = kept.withColumn("_over", over).withColumn("_last", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order))) == 1)
    kept = kept.withColumn("_size", size).withColumn("_rows", rows)
    after = list_tokens(F.col("_size"), F.col("_rows"), tools)
    if hard == -1:
        return kept.select(*messages.columns, F.when(F.col("_over"), "PRUNED").otherwise("OK").alias("status"), after.alias("token_count"), "original_count", "n_pruned")
    exceeded = after > hard
    history = list_tokens(F.col("_size") - F.col("_c"), F.col("_rows") - 1, tools)
    said = F.coalesce(F.col(content), F.lit(""))
    told = list_tokens(message_chars(F.lit("user"), F.lit(notice)), one, tools)
    left = F.lit(hard) - history - told - SPARE
    cut = F.when(left <= 0, F.lit("")).when(history + list_tokens(F.col("_c"), one, tools) + told <= hard, said).otherwise(F.substring(said, F.lit(1), F.floor(left * CHARS_A_TOKEN).cast("int")))
    kept = kept.withColumn("_exceeded", exceeded).withColumn("_text", F.when(F.col("_exceeded") & F.col("_last"), F.concat(cut, F.lit(notice))).otherwise(F.col(content)))
    final = F.sum(message_chars(F.col(role), message_text(F.col("_text")))).over(whole)
    status = F.when(F.col("_exceeded"), "HARD_LIMIT_EXCEEDED").when(F.col("_over"), "PRUNED").otherwise("OK")
    columns = [F.col("_text").alias(content) if c == content else F.col(c) for c in messages.columns]
    return kept.select(*columns, status.alias("status"), list_tokens(final, F.col("_rows"), tools).alias("token_count"), "original_count", "n_pruned")
