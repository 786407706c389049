"""Sources and sinks on the test tables: files written from a table into the session's folder, read back by the readers."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.plans.catalog import query
from evalloom.plans.tables import read, rounded
from evalloom.sources import clips, outputs, readers, sinks
from evalloom.storage import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, false AS bad FROM events WHERE event_id % 9 <> 4 UNION ALL SELECT NULL, NULL, '{\"event_id\": ' || event_id || ', \"user', true FROM events WHERE event_id % 9 = 4")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, K1: appended JSON lines, cut ones apart."""
    path, e = _folder(spark), read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    sinks.append_json(e.where("event_id % 9 <> 4 and event_id % 2 = 0"), path)
    sinks.append_json(e.where("event_id % 9 <> 4 and event_id % 2 <> 0"), path)
    e.where("event_id % 9 = 4").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "user'))).write.mode("append").text(path)
    rows, bad = readers.jsonl(spark, path, "event_id long, user_id long, event_type string")
    none = F.lit(None).cast("long")
    return rows.withColumn("bad", F.lit(False)).unionByName(bad.select(none.alias("event_id"), none.alias("user_id"), F.col("_corrupt_record").alias("event_type"), F.lit(True).alias("bad")))


@query("SELECT event_id, user_id, event_type FROM events")
def strict_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, none malformed."""
    path = _folder(spark)
    read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.json(path)
    return readers.jsonl(spark, path, "event_id long, user_id long, event_type string", strict=True)[0]


@query("SELECT l_suppkey::VARCHAR AS clip_id, (l_orderkey * 8 + l_linenumber)::INT AS frame_id, (l_partkey % 3)::INT AS track_id, l_partkey % 10 + 0.25 AS x1, (l_suppkey % 10)::DOUBLE AS y1, l_partkey % 10 + 4.5 AS x2, l_suppkey % 10 + 5.125 AS y2, l_discount AS confidence FROM lineitem")
def box_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box text files by clip (a supplier each), written to six places and read back."""
    x, y = F.col("l_partkey") % 10, F.col("l_suppkey") % 10
    frame = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int")
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), frame.alias("frame_id"), (F.col("l_partkey") % 3).cast("int").alias("track_id"), (x + 0.25).alias("x1"), y.cast("double").alias("y1"), (x + 4.5).alias("x2"), (y + 5.125).alias("y2"), F.col("l_discount").alias("confidence"))
    path = _folder(spark)
    sinks.boxes_text(boxes, path)
    # the clip is the folder that the writer made
    return rounded(readers.boxes(spark, path).withColumn("clip_id", F.regexp_extract(F.input_file_name(), "clip_id=([^/]+)/", 1)))


@query("SELECT o_orderkey::VARCHAR AS name, 'new/' || o_orderkey || '.mp4' AS path FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'old/' || o_orderkey || '.mp4' FROM orders WHERE o_orderkey % 3 <> 0")
def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by base name, the later of equal names."""
    path, k = _folder(spark), F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    old = o.select(F.lit(0).alias("n"), k, F.concat(F.lit("old/"), k.cast("string"), F.lit(".mp4")).alias("line"))
    new = o.where("o_orderkey % 3 = 0").select(F.lit(1).alias("n"), k, F.concat(F.lit("new/"), k.cast("string"), F.lit(".mp4")).alias("line"))
    # lines of both lists in order, over the files
    old.unionByName(new).repartitionByRange("n", "o_orderkey").sortWithinPartitions("n", "o_orderkey").select("line").write.text(path)
    return readers.path_list(spark, path)


@query("SELECT DISTINCT source AS id FROM documents WHERE trim(source) <> ''")
def pool_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trimmed lines."""
    path = _folder(spark)
    read(spark, sf_dir, "documents").where("source is not null").select(F.concat(F.lit(" "), "source", F.lit("  "))).write.text(path)
    return readers.id_pool(spark, path)


@query("SELECT c_custkey::VARCHAR AS id, c_name AS player_name, (c_custkey % 4)::INT AS period, c_acctbal AS second FROM customer")
def game_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolon CSV with its header replaced by the fixed names."""
    path, c = _folder(spark), read(spark, sf_dir, "customer")
    values = {"id": F.col("c_custkey"), "player_name": F.col("c_name"), "period": F.col("c_custkey") % 4, "second": F.col("c_acctbal")}
    c.select(*(values.get(n, F.lit("")).cast("string").alias(f"column {k}") for k, n in enumerate(readers.GAME_LOG_COLUMNS))).write.option("sep", ";").option("header", True).csv(path)
    return readers.game_log(spark, path).select("id", "player_name", "period", "second")


@query("""SELECT 'clip' || s_suppkey AS name, s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'again ' || s_name ELSE s_name END AS caption FROM supplier""")
def keyed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions keyed by id in several files; the last file that has a key wins."""
    s = read(spark, sf_dir, "supplier")

    def put(rows: DataFrame, caption) -> str:
        path = _folder(spark)
        entry = F.struct(F.concat(F.lit("clip"), F.col("s_suppkey").cast("string")).alias("key"), F.struct(F.col("s_suppkey").alias("id"), caption.alias("caption")).alias("value"))
        rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(entry)))).coalesce(1).write.text(path)  # one file holds one object
        return path

    first, second = put(s, F.col("s_name")), put(s.where("s_suppkey % 4 = 0"), F.concat(F.lit("again "), F.col("s_name")))
    return readers.keyed_json_union(spark, [first, second], "struct<id:long,caption:string>").withColumnRenamed("key", "name")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS index, item_id, text FROM benchmark QUALIFY index BETWEEN 2 AND 8")
def question_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions under a key of one object, items [2, 9)."""
    path = _folder(spark)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x)
    read(spark, sf_dir, "benchmark").agg(listed.alias("questions")).coalesce(1).write.json(path)
    rows = readers.questions(spark, path, "struct<item_id:long,text:string>", 2, 9)
    return rows.select(F.col("index").cast("long").alias("index"), "item_id", "text")


@query("SELECT vec_id::VARCHAR AS clip_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, label FROM embeddings WHERE vec_id % 7 <> 3")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with vectors from array files, those without a file left out (contents as Spark's file reader gives them)."""
    e = read(spark, sf_dir, "embeddings")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = []
            for v in batch.column("embedding").to_pylist():
                held = io.BytesIO()
                np.save(held, np.array([v], dtype=np.float32))
                content.append(held.getvalue())
            path = [f"store/{k % 5:02d}/{k}.npy" for k in batch.column("vec_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(content, pa.binary())], ["path", "content"])

    folder = _folder(spark)
    e.where("vec_id % 7 <> 3").select("vec_id", "embedding").mapInArrow(written, "path string, content binary").write.parquet(folder)
    nodes = clips.clip_nodes(e.select(F.col("vec_id").cast("string").alias("clip_id"), "label"), clips.npy_vectors(spark.read.parquet(folder)))
    return nodes.select("clip_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "label")


_ASR_SQL = """WITH l AS (SELECT user_id, event_id % 3 AS period, event_id, (event_id * 37) % 3000 AS s, event_type || repeat('x', (event_id % 4 * 80)::INT) AS c FROM events WHERE event_type IS NOT NULL) """


def _asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    caption = F.concat("event_type", F.expr("repeat('x', cast(event_id % 4 * 80 as int))"))
    start = (i * 37) % 3000
    line = F.concat(F.lit("["), start.cast("string"), F.lit(".25s -> "), (start + 4).cast("string"), F.lit(".50s] "), caption)
    e = read(spark, sf_dir, "events").where("event_type is not null").select("user_id", (i % 3).alias("period"), F.struct(i.alias("i"), line.alias("l")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")
    keyed = e.groupBy("user_id", "period").agg(F.concat(F.lit("noise\n"), text).alias("ASR_transcript"))
    return clips.period_transcripts(keyed.select(F.format_string("%d_period%d", "user_id", "period").alias("key"), "ASR_transcript"))


@query(_ASR_SQL + """, p AS (SELECT user_id, period, chr(10) || '**Period ' || period || '**' || coalesce(chr(10) || string_agg('[' || s || '-' || (s + 4) || '] ' || c, chr(10) ORDER BY event_id) FILTER (length(c) > 3 AND length(c) <= 200), '') AS t FROM l GROUP BY 1, 2)
SELECT user_id::VARCHAR AS game_id, string_agg(t, chr(10) ORDER BY period) AS text FROM p GROUP BY 1""")
def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period-keyed transcripts as texts with headers, captions of a fitting length only."""
    return clips.formatted_transcripts(_asr(spark, sf_dir))


@query(_ASR_SQL + """, g AS (SELECT user_id, n, n % 3 AS period, n * 400 AS a, n * 400 + 100 AS b FROM (SELECT DISTINCT user_id FROM l), (SELECT unnest(range(6)) AS n)),
k AS (SELECT l.*, count(g.n) AS times FROM l LEFT JOIN g ON g.user_id = l.user_id AND g.period = l.period AND s >= a - 60 AND s + 4 <= b + 60 GROUP BY ALL),
e AS (SELECT user_id, period, event_id, '[' || s || '-' || (s + 4) || '] ' || c AS t, unnest(range(times)) AS again FROM k WHERE length(c) > 3 AND length(c) <= 200),
p AS (SELECT l.user_id, l.period, chr(10) || '**Period ' || l.period || '**' || coalesce(chr(10) || any_value(j.t), '') AS t FROM l LEFT JOIN (SELECT user_id, period, string_agg(t, chr(10) ORDER BY event_id) AS t FROM e GROUP BY 1, 2) j ON j.user_id = l.user_id AND j.period = l.period GROUP BY 1, 2)
SELECT user_id::VARCHAR AS game_id, string_agg(t, chr(10) ORDER BY period) AS text FROM p GROUP BY 1""")
def segment_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines near given segments, once for each segment."""
    asr = _asr(spark, sf_dir)
    n = F.explode(F.sequence(F.lit(0), F.lit(5)))
    segments = asr.select("game_id").distinct().select("game_id", n.alias("n")).select("game_id", (F.col("n") % 3).alias("period"), (F.col("n") * 400).alias("start"), (F.col("n") * 400 + 100).alias("end"))
    return clips.formatted_transcripts(asr, segments)


@query("SELECT o_orderkey AS id, o_custkey AS answer, o_orderkey % 5 = 4 AS pending FROM orders")
def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers appended in batches that overlap and come twice, each once; and what is still to be asked."""
    log = outputs.AnswerLog(spark, _folder(spark), "id long, answer long")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("answer"))
    for batch, where in enumerate(("id % 5 < 2", "id % 5 < 3", "id % 5 < 4")):
        log.append(o.where(where), batch)
        log.append(o.where(where), batch)
    return log.rows().withColumn("pending", F.lit(False)).unionByName(log.pending(o).withColumn("pending", F.lit(True)))


@query("SELECT o_orderkey AS id, max(o_orderkey % 4)::INT AS rank FROM orders GROUP BY 1 UNION ALL SELECT -1, 9")
def rank_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of ranks merged, cut lines left out; repeated ids once."""
    path, o = _folder(spark), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("rank"))
    for rank in range(4):
        o.where((F.col("rank") == rank) | ((F.col("rank") > rank) & (F.col("id") % 10 == 0))).withColumn("rank", F.lit(rank)).write.json(f"{path}/results_rank{rank}")
    spark.range(1).select(F.lit('{"id": -1, "rank": 9}\n{"id": 3, "ra')).write.text(f"{path}/results_rank9")
    rows, _ = outputs.worker_rows(spark, f"{path}/*", "id long, rank int")
    return outputs.merged(rows, "id", "worker", last_wins=True)
