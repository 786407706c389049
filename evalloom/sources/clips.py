"""Clips, captions and transcripts: nodes with vectors from ``.npy`` files, period-keyed transcripts, logs by game."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.text import transcript_line


def npy_files(spark: SparkSession, root: str, buckets: Sequence[str] | None = None) -> DataFrame:
    """``path, content`` of the ``.npy`` files under a folder, or of those in some of its bucket folders only.

    Spark's reader lists and packs the files, from any store it knows; no task opens a path.
    """
    paths = [root] if buckets is None else [f"{root.rstrip('/')}/{b}" for b in buckets]
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(paths).select("path", "content")


def npy_vectors(files: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key`` (the file's base name) and ``v``: the array, without axes of length one, as doubles.

    Arrays of more than one real axis and contents that are no such file give a null vector. Pickled objects are never loaded.
    """

    def vector(content: bytes | None) -> list[float] | None:
        try:
            x = np.squeeze(np.load(io.BytesIO(content or b""), allow_pickle=False))
            return np.atleast_1d(x).astype(float).tolist() if x.ndim <= 1 else None
        except (ValueError, EOFError, TypeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [vector(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(v, pa.list_(pa.float64()))], [key, "v"])

    named = files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias(key), "content")
    return named.mapInArrow(run, f"{key} string, v array<double>")


def clip_nodes(clips: DataFrame, vectors: DataFrame, keep_missing: bool = False, key: str = "clip_id") -> DataFrame:
    """Clips with their vectors; clips without a file go, or stay with a null vector."""
    return clips.join(vectors.select(key, "v"), key, "left" if keep_missing else "inner").where(F.lit(keep_missing) | F.col("v").isNotNull())


def caption_nodes(clips: DataFrame, captions: DataFrame, keep_missing: bool = False, key: str = "clip_id") -> DataFrame:
    """Clips with ``text`` from ``captions`` (``key, text``); clips without one go, or stay with an empty text."""
    joined = clips.join(captions.select(key, "text"), key, "left" if keep_missing else "inner")
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def bucket_size(files: DataFrame, path: str = "path", first: str = "00") -> DataFrame:
    """``size``: how many files the first bucket folder holds."""
    return files.where(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1) == first).agg(F.count(F.lit(1)).alias("size"))


def clip_path(path: Column, root: str) -> Column:
    """A relative path under ``root``; an absolute one, or one with a scheme, as it is."""
    return F.when(path.rlike(r"^(/|[a-z][a-z0-9]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def period_transcripts(rows: DataFrame, key: str = "key", text: str = "ASR_transcript") -> DataFrame:
    """``game_id, period, transcript`` from keys ``<game>_period<n>``; a key without a period is its game's only one (0)."""
    parts = F.split(key, "_period")
    return rows.select(parts[0].alias("game_id"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)).alias("period"), F.col(text).alias("transcript"))


def logs_of(files: DataFrame, games: DataFrame) -> DataFrame:
    """``game_id, path`` of the files whose name up to the first ``_`` is one of the games; of several the last path."""
    name = F.substring_index(F.regexp_extract("path", r"([^/]*)$", 1), "_", 1)
    return files.select(name.alias("game_id"), "path").join(games.select(F.col("game_id").cast("string")).distinct(), "game_id").groupBy("game_id").agg(F.max("path").alias("path"))


def formatted_transcripts(asr: DataFrame, segments: DataFrame | None = None, offset: float = 60, least: int = 3, most: int = 200) -> DataFrame:
    """``game_id, text`` of ``game_id, period, transcript``: a header a period and the lines whose caption is longer than ``least`` and not over ``most``.

    With ``segments`` (``game_id, period, start, end``) a line stands once for each segment of its period that it lies in, widened
    by ``offset``. Periods come in order; lines that can't be read go; null transcripts are empty.
    """
    lines = F.split(F.coalesce("transcript", F.lit("")), "\n")
    parsed = F.filter(F.transform(lines, transcript_line), lambda x: x["start"].isNotNull() & x["end"].isNotNull())

    def words(x: Column) -> Column:
        return F.length(x["caption"]) - F.length(F.concat(F.lit("["), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit("] ")))

    rows = asr.select("game_id", "period", "transcript", F.filter(parsed, lambda x: (words(x) > least) & (words(x) <= most)).alias("l"))
    if segments is None:
        kept = F.transform("l", lambda x: x["caption"])
    else:
        held = segments.groupBy("game_id", "period").agg(F.collect_list(F.struct("start", "end")).alias("s"))
        rows = rows.join(held, ["game_id", "period"], "left")
        times = lambda x: F.coalesce(F.size(F.filter("s", lambda s: (x["start"] >= s["start"] - offset) & (x["end"] <= s["end"] + offset))), F.lit(0))
        kept = F.flatten(F.transform("l", lambda x: F.array_repeat(x["caption"], F.when(F.col("s").isNull(), 0).otherwise(times(x)))))
    part = F.array_join(F.concat(F.array(F.concat(F.lit("\n**Period "), F.col("period").cast("string"), F.lit("**"))), kept), "\n")
    parts = F.array_sort(F.collect_list(F.struct("period", "transcript", part.alias("t"))))
    return rows.groupBy("game_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))
