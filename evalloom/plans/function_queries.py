"""Queries over the smaller functions: parsed texts, vectors, boxes, dataset rows, run listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import geometry, text, vectors
from evalloom.functions.geometry import Box
from evalloom.operators import boxes, datasets, logs, runs
from evalloom.plans.catalog import query
from evalloom.plans.tables import read, rounded
from evalloom.sources import clips, readers


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 7 WHEN 1 THEN 2 END AS got, CASE event_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 3 END AS total, CASE WHEN event_id % 2 = 0 THEN 'a' || chr(10) || event_id END AS answer, CASE WHEN event_id % 4 > 0 THEN 'Q' || event_id % 40 END AS kind,
['Ann ' || event_id, 'Bob'] AS names, CASE WHEN event_type = 'click' THEN 'press' ELSE event_type END AS alias, 'Who scored at ' || event_id || ' in {city}?' AS filled, event_id % 5 < 2 AS final,
'[Q' || event_id % 4 || ' ' || greatest(0, (CASE event_id % 3 WHEN 0 THEN 720 WHEN 1 THEN 1200 ELSE 600 END) - event_id % 900) // 60 || ':' || printf('%02d', greatest(0, (CASE event_id % 3 WHEN 0 THEN 720 WHEN 1 THEN 1200 ELSE 600 END) - event_id % 900) % 60) || ']' AS clock FROM events""")
def parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores, answer bodies, question types, clocks, names, aliases, placeholders, endings."""
    i = F.col("event_id")
    n = i.cast("string")
    scored = F.when(i % 3 == 0, F.concat(F.lit("Overall Score: "), (i % 7).cast("string"), F.lit(" / 9"))).when(i % 3 == 1, "a — **Supported\nb — contradicted\nc —supported").otherwise("none")
    body = F.when(i % 2 == 0, F.concat(F.lit("x <answer> a\n"), n, F.lit(" </answer> <answer>b</answer>"))).otherwise("<answer> open")
    kind = F.when(i % 4 > 0, F.concat(F.lit("Q"), (i % 40).cast("string"), F.lit("_single"))).otherwise("single_Q1")
    headers = F.concat(F.lit("## team: x\nAnn "), n, F.lit(": 3 goals: 2\nno name\nBob: 1\nAnn "), n, F.lit(": again"))
    ends = F.when(i % 5 == 0, "so <answer>").when(i % 5 == 1, "I cannot find the answer in the provided documents or videos.").otherwise("I cannot find the answer")
    league = F.when(i % 3 == 0, "3_NBA").when(i % 3 == 1, "6_NCAA Division I").otherwise("other")
    ratio = text.score_ratio(scored)
    return read(spark, sf_dir, "events").select(
        "event_id", ratio["got"].alias("got"), ratio["total"].alias("total"), text.answer_body(body).alias("answer"), text.question_type(kind).alias("kind"), text.names_before_colon(headers).alias("names"), text.mapped(F.col("event_type"), {"click": "press"}).alias("alias"),
        text.fill_placeholders(F.lit("Who scored at {time} in {city}?"), {"time": i, "city": F.lit(None).cast("string")}).alias("filled"), text.is_final(ends).alias("final"), text.remaining_clock(i % 4, i % 900, logs.period_seconds(league)).alias("clock")
    )


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine, round(greatest(0, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def paired_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cosine similarity and distance of paired features."""
    a = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = read(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    c = a.join(b, "vec_id")
    return rounded(c.select("vec_id", vectors.cosine(F.col("a"), F.col("b")).alias("cosine"), vectors.cosine_distance(F.col("a"), F.col("b")).alias("distance")))


@query("""WITH t AS (SELECT l_orderkey % 20 AS clip_id, l_linenumber + l_orderkey * 8 AS track_id, (l_partkey % 40)::DOUBLE AS x, l_orderkey % 9 AS age, l_orderkey % 2 AS side FROM lineitem), a AS (SELECT * FROM t WHERE side = 0), b AS (SELECT * FROM t WHERE side = 1),
d AS (SELECT a.clip_id, a.track_id AS ta, b.track_id AS tb, a.age AS ga, b.age AS gb FROM (SELECT clip_id, track_id, age, x FROM a) a JOIN (SELECT clip_id, track_id, age, x FROM b) b ON a.clip_id = b.clip_id AND a.x = b.x)
SELECT 0 AS side, clip_id, track_id FROM a WHERE (clip_id, track_id) NOT IN (SELECT clip_id, ta FROM d WHERE ga <= gb) UNION ALL SELECT 1, clip_id, track_id FROM b WHERE (clip_id, track_id) NOT IN (SELECT clip_id, tb FROM d WHERE ga > gb)""")
def twin_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two lists' tracks at one place the younger goes."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    x = (F.col("l_partkey") % 40).cast("double")
    t = l.select((F.col("l_orderkey") % 20).alias("clip_id"), (F.col("l_linenumber") + F.col("l_orderkey") * 8).alias("track_id"), (x * 100).alias("x1"), F.lit(0.0).alias("y1"), (x * 100 + 50).alias("x2"), F.lit(50.0).alias("y2"), (F.col("l_orderkey") % 9).alias("age"), (F.col("l_orderkey") % 2).alias("side"))
    a, b = boxes.drop_duplicate_tracks(t.where("side = 0"), t.where("side = 1"))
    return a.unionByName(b).select(F.col("side").cast("int").alias("side"), "clip_id", "track_id")


@query("""SELECT p_type AS label, template, replace(['a clip of {}', '{} by a player'][template + 1], '{}', p_type) AS text FROM (SELECT DISTINCT p_type FROM part), (SELECT unnest([0, 1])::INT AS template)""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label in every template."""
    return datasets.prompts(read(spark, sf_dir, "part").select(F.col("p_type").alias("label")), "label", ["a clip of {}", "{} by a player"])


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS paragraph, count(*) AS "stats/n", max(turn) AS "stats/turns/last" FROM conversations GROUP BY 1""")
def flat_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption arrays as one text, nested fields flattened with a separator."""
    each = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("paragraph"), F.struct(F.count(F.lit(1)).alias("n"), F.struct(F.max("turn").alias("last")).alias("turns")).alias("stats"))
    return datasets.flattened(datasets.paragraphs(each, "paragraph"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, o_orderkey) AS game_id, 'C' || o_custkey % 4 AS home, 'C' || o_custkey % 5 AS away, n_name AS report FROM orders LEFT JOIN nation ON n_nationkey = coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, o_orderkey) WHERE o_custkey % 4 < 3 AND o_custkey % 5 < 3")
def game_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games by their first key, of listed teams only, with the report if there is one."""
    c = F.col("o_custkey")
    name = F.concat(F.lit("C"), (c % 4).cast("string"), F.lit("  - C"), (c % 5).cast("string"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, c).alias("log"), F.col("o_orderkey").alias("fixture"), name.alias("name"))
    reports = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("game_id"), F.col("n_name").alias("report"))
    found = datasets.source_mapping(o, reports, ["log", "fixture"], ["C0", "C1", "C2"])
    return found.select("o_orderkey", "game_id", "home", "away", "report")


@query("""SELECT 'report_' || s_suppkey AS doc_id, s_suppkey AS id, 'report' AS kind, 'r/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT 'stats_' || s_suppkey, s_suppkey, 'stats', 's/' || s_suppkey FROM supplier
UNION ALL SELECT 'team_' || s_suppkey || '_' || y, s_suppkey, 'team', 't/' || y FROM supplier, (SELECT unnest([2021, 2022]) AS y)""")
def game_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document of a game and each season of an entity, from nested metadata."""
    k = F.col("s_suppkey")
    report = F.when(k % 3 > 0, F.concat(F.lit("r/"), k.cast("string")))
    seasons = F.create_map(F.lit("2021"), F.lit("t/2021"), F.lit("2022"), F.lit("t/2022"))
    meta = read(spark, sf_dir, "supplier").select(k.alias("id"), report.alias("report_path"), F.concat(F.lit("s/"), k.cast("string")).alias("stats_path"), seasons.alias("seasons"))
    games = readers.documents_from_metadata(meta, "id", ["report_path", "stats_path"]).select("doc_id", F.col("game_id").alias("id"), F.col("doc_type").alias("kind"), "path")
    return games.unionByName(readers.season_documents(meta, "team", "id", "seasons").select("doc_id", "id", F.lit("team").alias("kind"), "path"))


@query("""SELECT o_orderkey AS number, 'agent' || o_custkey % 3 AS run, printf('%08d', o_orderkey) AS stamp, CASE WHEN o_orderkey % 4 = 0 THEN 'gpu0/' ELSE 'all/' END || o_orderkey AS path FROM orders""")
def listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by the pattern of their names, numeric names only, of several places the first."""
    k = F.col("o_orderkey")
    whole = k.cast("string")
    places = [(1, F.concat(F.lit("all/"), whole), whole), (0, F.when(k % 4 == 0, F.concat(F.lit("gpu0/"), whole)), whole), (2, F.lit("all/readme"), F.lit("readme"))]
    names = F.array(*(F.struct(F.lit(r).alias("rank"), p.alias("path"), n.alias("name")) for r, p, n in places))
    o = read(spark, sf_dir, "orders").select(F.format_string("out/agent%d_%08d", (F.col("o_custkey") % 3), k).alias("folder"), k)
    files = read(spark, sf_dir, "orders").select(F.inline(names)).where("path is not null")
    first = readers.first_of(datasets.numeric_names(files, "name").drop("name").withColumnRenamed("number", "name"), "name", "rank").select(F.col("name").alias("number"), "path")
    found = datasets.runs_found(o, "folder", r"out/(agent\d+)_(\d{8})$").select("run", "stamp", F.col("stamp").cast("long").alias("number"))
    return found.join(first, "number").select("number", "run", "stamp", "path")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_comment ELSE 'fallback' END AS text, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'error' ELSE 'ok' END AS state FROM (SELECT o_orderkey, o_custkey, 'c' || o_custkey AS o_comment FROM orders) WHERE o_custkey % 5 > 0""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that aren't answered yet, with a fallback text; their responses, failed and empty ones apart."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    entries = o.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise(" ").alias("text"), F.lit("fallback").alias("other"))
    asked = datasets.pending_requests(entries, o.where("o_custkey % 5 = 0").select(k.alias("id")), "id", "text", "other")
    responses = o.select(k.alias("id"), F.when(k % 7 == 0, 500).otherwise(200).alias("status"), F.when(k % 11 == 0, "  ").otherwise("yes").alias("body"))
    good, bad = runs.demux(responses, asked, "id", "status", "body")
    return good.select("id", "text", F.lit("ok").alias("state")).unionByName(bad.select("id", "text", F.lit("error").alias("state")))


@query("SELECT s_suppkey::VARCHAR AS game_id, 'log/' || s_suppkey || '_b.csv' AS path FROM supplier WHERE s_suppkey % 2 = 0")
def logs_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the logs whose game is in a set, the last of several."""
    k = F.col("s_suppkey").cast("string")
    files = read(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("log/"), k, F.lit("_a.csv")), F.concat(F.lit("log/"), k, F.lit("_b.csv")), F.concat(F.lit("log/x"), k, F.lit(".csv")))).alias("path"))
    return clips.logs_of(files, read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("game_id")))


@query("""WITH r AS (SELECT 'task-' || o_orderkey AS custom_id, o_totalprice AS price FROM orders) SELECT o_orderkey AS ordinal, o_custkey, r.price FROM orders JOIN r ON r.custom_id = 'task-' || o_orderkey""")
def responses_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch responses joined by the number in their name."""
    o = read(spark, sf_dir, "orders")
    responses = o.select(F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("custom_id"), F.col("o_totalprice").alias("price"))
    return runs.by_ordinal(responses, o.select(F.col("o_orderkey").alias("ordinal"), "o_custkey")).select("ordinal", "o_custkey", "price")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, l_partkey % 50 + 30.0::DOUBLE AS x2, l_suppkey % 50 + 20.0::DOUBLE AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x2 - x1) * 0.5 * (y2 - y1) * 0.5, 6) AS area FROM b""")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes scaled and padded; here the area of those well inside the frame."""
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    b = geometry.scale_and_pad(Box(x, y, x + 30, y + 20), 0.5, 3.0, 4.0, 500.0, 500.0)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round((b.x2 - b.x1) * (b.y2 - b.y1), 6).alias("area"))
