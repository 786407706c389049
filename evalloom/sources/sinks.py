"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.operators.positions import numbered


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def metrics_json(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """A long table of metrics, a folder for each value of ``by``."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)


def report_csv(rows: DataFrame, path: str, order: str, decimals: int | None = None) -> None:
    """One sorted CSV file with a header (a report: a row for each video at most); numbers to fixed places if asked."""
    if decimals is not None:
        rows = rows.select(*(F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    rows.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def boxes_text(boxes: DataFrame, path: str) -> None:
    """Frame, track, x1, y1, x2, y2, confidence and three placeholders, a folder for each clip."""
    six = [F.format_string("%.6f", c) for c in ("x1", "y1", "x2", "y2")]
    line = F.concat_ws(",", F.col("frame_id").cast("string"), F.col("track_id").cast("string"), *six, F.format_string("%.6f", F.col("confidence")), F.lit("-1"), F.lit("-1"), F.lit("-1"))
    boxes.select("clip_id", line.alias("value")).repartition("clip_id").sortWithinPartitions("clip_id", "value").write.mode("overwrite").partitionBy("clip_id").text(path)


def allowed_tracks(boxes: DataFrame, allowed: DataFrame) -> DataFrame:
    return boxes.join(allowed.select("clip_id", "track_id").distinct(), ["clip_id", "track_id"], "left_semi")


def chat_messages(rows: DataFrame, conversations: str = "conversations") -> DataFrame:
    """``from``/``value`` turns as ``role``/``content`` messages: those of human and gpt, empty ones too; conversations without any go."""
    known = F.filter(F.col(conversations), lambda x: x["from"].isin("human", "gpt"))
    message = lambda x: F.struct(F.when(x["from"] == "human", "user").otherwise("assistant").alias("role"), F.coalesce(x["value"], F.lit("")).alias("content"))
    return rows.withColumn("messages", F.transform(known, message)).where(F.size("messages") > 0).drop(conversations)


def batch_requests(rows: DataFrame, prompt: str, model: str, key: str | None = None) -> DataFrame:
    """``value``: one JSON request a line with ``custom_id`` ``task-<i>``, i the row's place by key; and the key beside it."""
    at = numbered(rows, [key or prompt, prompt], "ordinal")
    message = F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"))
    request = F.struct(F.format_string("task-%d", "ordinal").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return at.select(F.to_json(request).alias("value"), "ordinal", *([key] if key else []))


def index_table(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write once: nothing happens if the table is there."""
    w = rows.write.mode("ignore")
    (w.partitionBy(*by) if by else w).parquet(path)


def transcript(messages: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """One readable text for each conversation."""
    line = F.concat(F.lit("["), F.col(role), F.lit("] "), F.coalesce(F.col(text), F.lit("")))
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return messages.groupBy(conversation).agg(F.array_join(F.transform(s, lambda x: x["l"]), "\n").alias("transcript"))
