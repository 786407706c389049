"""Readers. All give lazy DataFrames; schemas are stated, not inferred, where the format allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

#: The columns of a game log, in file order.
GAME_LOG_COLUMNS = (
    "id action_id action_name player_id player_name team_id team_name opponent_id opponent_name opponent_team_id opponent_team_name "
    "teammate_id teammate_name period second pos_x pos_y possession_id possession_name possession_team_id possession_team_name "
    "possession_number possession_start_clear possession_end_clear playtype hand shot_type drive dribble_move contesting ts"
).split()


def load_task(spark: SparkSession, root: str, task: str, split: str, streaming: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """``root/task/split`` as Parquet; a stream needs the schema, which is read from the files if not given."""
    path = f"{root}/{task}/{split}"
    if not streaming:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of JSON lines; strict fails on a malformed one, else these come as a second frame (``_corrupt_record``)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), None
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    # from_json on text lines, so that filters on the corrupt column need no cache
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = rows.select(F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return parsed.where(F.col(f"r.{CORRUPT}").isNull()).select(*(f"r.{f.name}" for f in fields)), parsed.where(F.col(f"r.{CORRUPT}").isNotNull()).select(f"r.{CORRUPT}")


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object of objects as rows: ``key`` and the value's fields."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{value_schema}>")
    return whole.select(F.explode(m).alias("key", "v")).select("key", "v.*")


def keyed_json_union(spark: SparkSession, paths: Sequence[str], value_schema: str) -> DataFrame:
    """Several keyed files; the last file that has a key wins."""
    both = None
    for k, p in enumerate(paths):
        one = keyed_json(spark, p, value_schema).withColumn("_file", F.lit(k))
        both = one if both is None else both.unionByName(one)
    columns = [c for c in both.columns if c not in ("key", "_file")]
    return both.groupBy("key").agg(F.max_by(F.struct(*columns), "_file").alias("v")).select("key", "v.*")


def questions(spark: SparkSession, path: str, item_schema: str, start: int = 0, end: int | None = None) -> DataFrame:
    """A JSON list, or an object with the list under ``questions``; items [start, end) with their ``index``."""
    text = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", f"struct<questions:array<{item_schema}>>")["questions"], F.from_json("value", f"array<{item_schema}>"))
    rows = text.select(F.posexplode(items).alias("index", "q")).select("index", "q.*")
    return rows.where((F.col("index") >= start) & (F.lit(True) if end is None else F.col("index") < end))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files under a folder. A few tasks a core list its folders, not one for each of them."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.option("recursiveFileLookup", True).text(path)
    finally:
        spark.conf.set(key, before)


def boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box text files in a folder and those under it: frame, track, x1, y1, x2, y2[, confidence, ...]; blank and short lines are skipped. ``clip_id``: the file's name."""
    rows = _listed(spark, path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("clip_id"), F.split(F.trim("value"), r"\s*,\s*").alias("f"))
    number = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    named = [number(k).alias(c) for k, c in ((3, "x1"), (4, "y1"), (5, "x2"), (6, "y2"))]
    out = rows.where(F.size("f") >= 6).select("clip_id", number(1).cast("int").alias("frame_id"), number(2).cast("int").alias("track_id"), *named, F.coalesce(number(7), F.lit(1.0)).alias("confidence"))
    return out.where(F.col("frame_id").isNotNull() & F.col("track_id").isNotNull())


#: Classes of boxes that count as truth, and of those that a matcher ignores.
MOT_VALID, MOT_IGNORED = (1,), (2, 7, 8, 12)


def mot_results(spark: SparkSession, path: str, kind: str = "result", classes: Sequence[int] = MOT_VALID, ignored: Sequence[int] = MOT_IGNORED) -> DataFrame:
    """MOT rows (frame, id, left, top, width, height, mark or score, class, visibility) as boxes; short rows and frames under 1 go.

    ``result``: all, with their score. ``truth``: marked rows of the ``classes``, score 1. ``ignore``: rows of the
    ``ignored`` classes or of negative visibility, score 1.
    """
    if kind not in ("result", "truth", "ignore"):
        raise ValueError(f"unknown kind of rows: {kind}")
    f = F.split(F.trim("value"), r"\s*,\s*")
    n = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 7) & (n(1) >= 1))
    if kind == "truth":
        rows = rows.where((n(7).cast("int") != 0) & n(8).cast("int").isin(list(classes)))
    elif kind == "ignore":
        rows = rows.where(n(8).cast("int").isin(list(ignored)) | (n(9) < 0))
    score = n(7) if kind == "result" else F.lit(1.0)
    return rows.select(n(1).cast("int").alias("frame_id"), n(2).cast("int").alias("track_id"), n(3).alias("x1"), n(4).alias("y1"), (n(3) + n(5)).alias("x2"), (n(4) + n(6)).alias("y2"), score.alias("confidence"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """``name`` (base name without extension) and ``path`` of each listed line; of equal names the last line wins (of several files, that of the last by name).

    Files are read in splits; lines of a split come in order, so a line's place is its file, its split's start and its number there.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = lines.select(place.alias("n"), F.trim("value").alias("path")).where("path <> ''")
    return rows.withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).groupBy("name").agg(F.max_by("path", "n").alias("path"))


def game_log(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV with a header that is replaced by the fixed names; numbers are cast leniently."""
    numbers = {"period": "int", "second": "double", "pos_x": "double", "pos_y": "double"}
    raw = spark.read.schema(", ".join(f"{c} string" for c in GAME_LOG_COLUMNS)).option("sep", ";").option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(*(F.col(c).try_cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in GAME_LOG_COLUMNS))


def id_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Recursive file listing: ``path, length, modified``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def first_of(files: DataFrame, name: str, priority: str) -> DataFrame:
    """The path of least priority for each name."""
    return files.groupBy(name).agg(F.min_by("path", F.struct(priority, "path")).alias("path"))


def by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, JSON or JSON lines by the path's suffix."""
    read = spark.read.schema(schema) if schema else spark.read
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read.option("header", True).csv(path)
    if suffix == "jsonl":
        return read.json(path)
    if suffix == "json":
        return read.option("multiLine", True).json(path)
    if suffix == "parquet":
        return read.parquet(path)
    raise ValueError(f"no reader for {path}")


def result_files(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One JSON object in each file, named by it (``name``); summaries are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    named = rows.withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return named.where(F.col("name") != "summary")


def documents_from_metadata(meta: DataFrame, key: str, path_columns: Sequence[str]) -> DataFrame:
    """``doc_id, game_id, doc_type, path`` for each path column that is set."""
    pairs = F.array(*(F.struct(F.lit(c.removesuffix("_path")).alias("doc_type"), F.col(c).alias("path")) for c in path_columns))
    rows = meta.select(F.col(key).alias("game_id"), F.inline(pairs)).where("path is not null")
    return rows.select(F.concat_ws("_", "doc_type", "game_id").alias("doc_id"), "game_id", "doc_type", "path")


def season_documents(meta: DataFrame, kind: str, id_column: str, seasons: str) -> DataFrame:
    """``doc_id`` (kind_id_season) and path of each entry of a season map column."""
    rows = meta.select(F.col(id_column).alias("id"), F.explode(seasons).alias("season", "path"))
    return rows.select(F.concat_ws("_", F.lit(kind), "id", "season").alias("doc_id"), "id", "season", "path")
