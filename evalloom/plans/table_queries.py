"""Queries over logs, texts, samples, reports, sets and windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.functions import text
from evalloom.operators import datasets, logs, positions, reports, sampling
from evalloom.plans.catalog import query
from evalloom.plans.tables import read, rounded
from evalloom.sources import sinks
from evalloom.streaming import events as streams

# -- intervals: events as spans of a user --------------------------------------------------------------------------

_SPANS = "WITH e AS (SELECT event_id, user_id, event_type, (floor(epoch(ts))::BIGINT % 86400)::DOUBLE AS start, (floor(epoch(ts))::BIGINT % 86400)::DOUBLE + value AS \"end\" FROM events) "


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.pmod(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(86400)).cast("double")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.col("value")).alias("end"))


@query(_SPANS + """SELECT a.event_id, b.event_id AS span_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type <> 'purchase' AND b.event_type = 'purchase' AND a.start >= b.start - 3600 AND a."end" <= b."end" + 3600""")
def contained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items inside a span widened by an hour, same key."""
    e = _spans(spark, sf_dir)
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    return logs.within(e.where("event_type <> 'purchase'").select("event_id", "user_id", "start", "end"), spans, ["user_id"], 3600.0).select("event_id", "span_id")


@query(_SPANS + """SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM e a JOIN e b ON a.user_id % 20 = b.user_id % 20 AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.start < b."end" AND a."end" > b.start""")
def overlapping_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: strict overlaps, by key and time bucket."""
    e = _spans(spark, sf_dir).withColumn("k", F.col("user_id") % 20)
    side = lambda kind: e.where(F.col("event_type") == kind).select("k", "event_id", "start", "end")
    return logs.bucketed_overlaps(side("click"), side("purchase"), ["k"], 600.0).select("l_event_id", "r_event_id")


@query("SELECT o_orderkey, least(o_custkey % 720, o_orderkey % 720) < greatest(300, 420) AND greatest(o_custkey % 720, o_orderkey % 720) > least(300, 420) AS hit FROM orders")
def clock_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdown-clock overlap, bounds in either order."""
    from evalloom.operators.retrieval import clock_overlaps

    hit = clock_overlaps(F.col("o_custkey") % 720, F.col("o_orderkey") % 720, F.lit(420), F.lit(300))
    return read(spark, sf_dir, "orders").select("o_orderkey", hit.alias("hit"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND user_id % 4 = 1 AND (floor(epoch(ts))::BIGINT % 3600) BETWEEN 600 AND 660")
def log_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen actions of one period within a segment of a minute."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("action_name"), "event_type", (F.col("user_id") % 4).cast("int").alias("period"), F.pmod(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(3600)).alias("second"))
    return logs.select_actions(logs.segment(e, 600, 60), ["click", "purchase"], ["event_id", "user_id", "event_type"], ["event_id"], 1)


@query("""WITH e AS (SELECT user_id, event_id, (user_id + event_id) % 3 AS p, event_id % 5 AS s, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 4 ELSE 3 END AS c FROM events), o AS (SELECT *, lag(p) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p, s, c, event_id))
SELECT user_id, string_agg(CASE WHEN b IS DISTINCT FROM p THEN 'Period ' || p || ':' || chr(10) || event_type ELSE event_type END, chr(10) ORDER BY p, s, c, event_id) AS text FROM o GROUP BY 1""")
def play_by_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a game by period, clock and class of action (other actions before scores), a header where the period changes."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(F.col("user_id") + F.col("event_id"), F.lit(3)).alias("p"), (F.col("event_id") % 5).alias("second"), F.col("event_type").alias("action_name"))
    order = logs.play_order(e, {"purchase": 1, "click": 4}, "p")
    return logs.play_by_play(e, "user_id", F.struct(order.alias("o"), "event_id"), "p", F.col("action_name"))


@query("SELECT n_name AS team, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS players FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct players of each team."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return logs.rosters(c.select(F.col("n_name").alias("team"), F.col("c_mktsegment").alias("player")), "team", "player")


@query("SELECT doc_id, lang FROM documents WHERE doc_id // 4 NOT IN (SELECT doc_id // 4 FROM documents WHERE lang IS DISTINCT FROM 'en')")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games (four documents each) with any part in another language go."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 4).alias("game"))
    return logs.language_gate(d, "game", "lang", "en").select("doc_id", "lang")


# -- texts ---------------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, length(text) // 4 AS tokens, list_sort(list_distinct(regexp_extract_all(upper(text), '\\b([A-E])\\s*:', 1))) AS options,
trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(lower('<person> - ' || text), '[,.''!?"()*#:;~]', '', 'g'), '[-/]', ' ', 'g'), '<person>', 'person'), '\\s{2,}', ' ', 'g'), '\\n+$', ''), ' ') AS caption FROM conversations""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rough tokens, options, normalised caption."""
    c = F.col("text")
    caption = text.caption_normal(F.concat(F.lit("<person> - "), c))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.rough_tokens(c).alias("tokens"), text.options_in(c).alias("options"), caption.alias("caption"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 50) * 60.0::DOUBLE + event_id % 60 ELSE -1 END AS seconds, 2000 + event_id % 99 + 1 AS season, json_extract_string(props, '$.k') AS k,
CASE WHEN event_id % 4 = 0 THEN 'Right' WHEN event_id % 4 = 1 THEN 'Wrong' END AS verdict FROM events""")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock, season, JSON fields in free text, verdicts."""
    i = F.col("event_id")
    clock = F.when(i % 3 == 0, F.format_string("%02d:%02d", (i % 50).cast("int"), (i % 60).cast("int"))).otherwise("x")
    season = F.format_string("20-%02d", (i % 99 + 1).cast("int"))
    said = F.when(i % 4 == 0, '{"verdict": "Right"}').when(i % 4 == 1, "wrong - no match").when(i % 4 == 2, "**Right**").otherwise("maybe")
    return read(spark, sf_dir, "events").select(
        "event_id", text.clock_seconds(clock).alias("seconds"), text.season_year(season).cast("long").alias("season"), text.json_field(F.concat(F.lit("said: "), "props"), "k").alias("k"), text.verdict(said).alias("verdict")
    )


@query("SELECT p_partkey, printf('%02d/%d.mp4', p_partkey // 100, p_partkey) AS path, regexp_replace(p_name, '(_player0|_shot|_contested_shot)$', '') AS base, 'clips/a/bboxes/' || p_partkey AS moved FROM part")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket paths, stripped suffixes, first-occurrence rewrite."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.bucket_path(k, 100, ".mp4").alias("path"), text.strip_suffix(F.col("p_name"), ["_player0", "_shot", "_contested_shot"]).alias("base"), text.swap_first(F.concat(F.lit("bboxes/a/bboxes/"), k.cast("string")), "bboxes/", "clips/").alias("moved")
    )


@query("SELECT conv_id, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as one text."""
    return sinks.transcript(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# -- samples -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT (SELECT ceil(count(*) * 0.03)::BIGINT FROM orders)")
def sample_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three percent, rounded up."""
    return sampling.take(read(spark, sf_dir, "orders").select("o_orderkey"), "end:3%", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT - 1 AS chunk FROM orders")
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced chunks within a key."""
    return sampling.balanced_chunks(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 4, "o_orderkey", ["o_custkey"])


@query("SELECT o_custkey, o_orderkey, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / ceil(count(*) OVER (PARTITION BY o_custkey) / 3.0::DOUBLE))::INT AS chunk FROM orders")
def ceil_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous chunks of the ceiling size."""
    return sampling.ceil_chunks(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 3, "o_orderkey", ["o_custkey"])


@query("SELECT n_nationkey, copy::INT AS copy FROM nation, (SELECT unnest([1, 2, 3]) AS copy) UNION ALL SELECT r_regionkey, 1 FROM region")
def weighted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets repeated by weight."""
    return sampling.weighted_union([(read(spark, sf_dir, "nation").select("n_nationkey"), 3), (read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey")), 1)])


@query("SELECT p_partkey, list_transform(range(8), lambda i: trunc(i * ((p_size + 19)::DOUBLE / 7))::INT) AS frames FROM part")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform frame numbers, both ends included, truncated."""
    return read(spark, sf_dir, "part").select("p_partkey", sampling.uniform_indices((F.col("p_size") + 20).cast("double"), 8).alias("frames"))


@query("""WITH v AS (SELECT p_partkey, p_size * 7 AS total, 25 + p_partkey % 6 AS fps FROM part), s AS (SELECT *, fps / 0.7::DOUBLE AS step FROM v)
SELECT p_partkey, CASE WHEN floor(total / fps::DOUBLE * 0.7::DOUBLE) <= 1 THEN [0] ELSE list_sort(list_distinct(list_transform(range(ceil(total / step)::BIGINT), lambda i: least(round_even(i * step, 0)::INT, total::INT - 1)))) END AS frames FROM s""")
def fps_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers at a target rate, in steps from 0."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", sampling.frame_indices((F.col("p_size") * 7).cast("int"), (25 + F.col("p_partkey") % 6).cast("double"), 0.7).alias("frames"))


@query("""WITH g AS (SELECT p_partkey, unnest([{'g': 'a', 't': p_size, 'i': 0}, {'g': 'b', 't': p_size * 3, 'i': 1}, {'g': 'c', 't': p_size + 5, 'i': 2}]) AS x FROM part),
k AS (SELECT p_partkey, x.g AS game, x.i AS i, x.t AS t, 3 + (x.i < 2)::INT AS mine, unnest(range(3 + (x.i < 2)::INT)) AS k FROM g)
SELECT p_partkey, list(game || ':' || trunc(k * ((t - 1)::DOUBLE / (mine - 1)))::INT ORDER BY i, k) AS picks FROM k GROUP BY 1""")
def frames_over_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks spread over several games, the first ones one more."""
    n = F.col("p_size")
    picks = sampling.spread_picks(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(n, n * 3, n + 5), 11)
    return read(spark, sf_dir, "part").select("p_partkey", F.transform(picks, lambda x: F.concat(x["game"], F.lit(":"), x["frame"].cast("string"))).alias("picks"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS latest, median(l_quantity) OVER w AS median, round(avg(l_quantity) OVER w, 6) AS avg, round(avg(l_quantity) OVER a, 6) AS global_avg, sum(l_quantity) OVER a AS total
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS 49 PRECEDING), a AS (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def sliding_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V3: statistics of the last fifty values, and running ones."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return rounded(sampling.sliding_meter(l, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_quantity"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w, 6) AS whitened FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores within groups."""
    return rounded(sampling.whiten(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice").select("o_orderkey", "whitened"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def best_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two of each key."""
    return sampling.best_of_n(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 2, "o_orderkey").select("o_custkey", "o_orderkey")


@query("WITH g AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS g FROM nation), t AS (SELECT r_name, turn::INT AS turn, (row_number() OVER (ORDER BY r_name, turn) - 1) % 25 AS g FROM region, (SELECT unnest(range(7)) AS turn)) SELECT r_name, turn, n_name FROM t JOIN g USING (g)")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type takes the next games in turn."""
    return sampling.round_robin(read(spark, sf_dir, "region"), read(spark, sf_dir, "nation"), "r_name", "n_name", 7)


@query()
def megabatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded megabatches by falling length, modalities apart."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, -F.col("p_size")).otherwise(F.col("p_size")).alias("len"))
    return sampling.modality_megabatches(p, 64, "len", "p_partkey", 7)


@query("WITH p AS (SELECT p_brand, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS k FROM part) SELECT p_brand, count(*) AS n, list(p_partkey ORDER BY k) FILTER (WHERE n % 4 > 0 AND k % 4 = 1) AS second FROM p GROUP BY 1")
def dealt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that don't divide evenly are dealt in turn; here the second chunk of each."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    chunks = sampling.even_chunks(p, "p_brand", 4, "p_size", "p_partkey").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("p_brand")))
    row = F.when((F.col("n") % 4 > 0) & (F.col("chunk") == 1), F.struct(-F.col("p_size"), "p_partkey"))
    found = chunks.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("r"))
    return found.select("p_brand", "n", F.when(F.size("r") > 0, F.transform("r", lambda x: x["p_partkey"])).alias("second"))


@query()
def even_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows in each chunk, the longest to the lightest (sequential)."""
    return sampling.even_chunks(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", 4, "p_size", "p_partkey")


# -- positions -----------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders), b AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders) SELECT position, o_orderkey, o_custkey, k FROM a JOIN b USING (position)")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames side by side, row by row, of checked length."""
    o = read(spark, sf_dir, "orders")
    return positions.joined_by_position([(o.select("o_orderkey"), ["o_orderkey"]), (o.select("o_custkey", F.col("o_orderkey").alias("k")), ["o_custkey", "k"])])


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, (SELECT count(*) // 7 FROM orders) AS e FROM orders) SELECT o_orderkey, (n // e)::INT AS replica FROM n WHERE n < 7 * e AND n % e >= 3")
def replica_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contiguous blocks, the rest left out, resumed after three rows."""
    return sampling.replica_shard(read(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey", skip=3)


@query("""WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS item_idx, string_split(coalesce(text, ''), chr(10)) AS c FROM documents), t AS (SELECT item_idx, doc_id, unnest(range(len(c))) AS pos, unnest(c) AS text FROM i)
SELECT row_number() OVER (ORDER BY item_idx, pos) - 1 AS text_idx, item_idx, doc_id AS item, text FROM t""")
def caption_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: dense numbers of captions and their items."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("captions"))
    return datasets.text_map(d, "doc_id", "captions")


@query("""SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal, 'task-' || (row_number() OVER (ORDER BY item_id) - 1) AS custom_id, text AS prompt FROM benchmark""")
def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines numbered by key, and their keys."""
    lines = sinks.batch_requests(read(spark, sf_dir, "benchmark"), "text", "judge", "item_id")
    return lines.select("item_id", "ordinal", F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.body.messages[0].content").alias("prompt"))


@query("""WITH p AS (SELECT 0 AS part, s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier UNION ALL SELECT 1, c_custkey, row_number() OVER (ORDER BY c_custkey DESC) - 1, count(*) OVER () FROM customer UNION ALL SELECT 2, p_partkey, row_number() OVER (ORDER BY p_partkey) - 1, count(*) OVER () FROM part)
SELECT part, key, row_number() OVER (ORDER BY (2 * k + 1) / (2.0::DOUBLE * n), part) - 1 AS position FROM p""")
def proportional_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: sources interleaved in proportion to their lengths, each in its own order."""
    s, c, p = (read(spark, sf_dir, t).select(F.col(k).alias("key")) for t, k in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey")))
    return positions.interleaved([(s, ["key"]), (c, [F.desc("key")]), (p, ["key"])])


@query("SELECT conv_id, list(role || ': ' || CASE WHEN turn % 5 = 4 THEN '' ELSE text END ORDER BY turn) AS messages FROM conversations WHERE role <> 'system' GROUP BY 1")
def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of human and gpt as messages, empty ones too, other roles left out."""
    said = F.when(F.col("turn") % 5 != 4, F.col("text"))
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", kind.alias("from"), said.alias("value")))).alias("conversations"))
    return sinks.chat_messages(c).select("conv_id", F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])).alias("messages"))


# -- reports -------------------------------------------------------------------------------------------------------

_METRICS = """WITH m AS (SELECT r_name AS sport, p_type AS attribute, p_brand AS category, count(*) AS n, round(avg(l_quantity), 4) AS r100, round(avg(round(l_discount * 100)), 4) AS med_rank FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3) """


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    l = l.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))  # noqa: E741
    return l.groupBy(F.col("r_name").alias("sport"), F.col("p_type").alias("attribute"), F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("r100"), F.round(F.avg(F.round(F.col("l_discount") * 100)), 4).alias("med_rank"))


@query(_METRICS + "SELECT attribute, round(avg(r100), 6) AS mean_r100, count(*) AS entries FROM m WHERE n >= 5 GROUP BY 1 HAVING count(*) >= 3")
def attribute_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain mean by attribute over large enough entries."""
    return rounded(reports.difficulty(_metrics(spark, sf_dir)))


_WEIGHED = _METRICS + ", w AS (SELECT sport, attribute, sum(n)::BIGINT AS total, count(*) AS entries, sum(r100 * n) / sum(n) AS r100, sum(med_rank * n) / sum(n) AS med_rank FROM m WHERE n >= 5 GROUP BY 1, 2 HAVING sum(n) >= 10) "


@query(_WEIGHED + "SELECT sport, attribute, total, entries, round(r100, 9) AS r100, round(med_rank, 9) AS med_rank, CASE WHEN r100 >= 40 THEN 'EASY' WHEN r100 >= 25 THEN 'MODERATE' ELSE 'HARD' END AS verdict FROM w")
def attribute_retrievability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted by n over large enough entries, with a verdict."""
    return rounded(reports.retrievability(_metrics(spark, sf_dir)), 9)


@query(_WEIGHED + "SELECT attribute, count(*) AS groups, round(avg(r100), 6) AS mean_r100, CASE WHEN avg(r100) >= 35 THEN 'easy' WHEN avg(r100) < 25 THEN 'hard' ELSE 'mixed' END AS pattern FROM w GROUP BY 1 HAVING count(*) >= 2")
def cross_sport_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that are easy or hard over several groups, each weighted by n."""
    return rounded(reports.cross_group_patterns(_metrics(spark, sf_dir), "sport"))


@query(_METRICS + ", a AS (SELECT category, attribute, round(avg(r100), 6) AS mean FROM m WHERE n >= 10 GROUP BY 1, 2) SELECT category, arg_min(attribute, (mean, attribute)) AS hardest, min(mean) AS hardest_mean, arg_max(attribute, (mean, attribute)) AS easiest, max(mean) AS easiest_mean FROM a GROUP BY 1")
def category_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardest and easiest of each group by the mean over the sports that have enough rows."""
    return rounded(reports.extremes(_metrics(spark, sf_dir), ["category"], "attribute", "r100"))


@query(_METRICS + ", o AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY r100, med_rank DESC, attribute, category) AS h FROM m WHERE n >= 5) SELECT sport, attribute, category FROM o WHERE h <= 15")
def hardest_fifteen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen hardest of each group (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("sport").orderBy("r100", F.desc("med_rank"), "attribute", "category")
    return _metrics(spark, sf_dir).where("n >= 5").withColumn("h", F.row_number().over(w)).where("h <= 15").select("sport", "attribute", "category")


@query(_METRICS + "SELECT sport, attribute, max(CASE WHEN category = 'Brand#11' THEN r100 END) AS low, max(CASE WHEN category = 'Brand#12' THEN r100 END) AS high, round(max(CASE WHEN category = 'Brand#11' THEN r100 END) - max(CASE WHEN category = 'Brand#12' THEN r100 END), 6) AS delta FROM m GROUP BY 1, 2")
def bin_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two bins."""
    return rounded(reports.bin_delta(_metrics(spark, sf_dir), ["sport", "attribute"], "category", "Brand#11", "Brand#12", "r100"))


@query(_METRICS + """, a AS (SELECT sport, attribute, avg(r100) AS r100, sum(n)::DOUBLE AS n FROM m GROUP BY 1, 2), u AS (SELECT sport, attribute, 'r100' AS metric, r100 AS v FROM a UNION ALL SELECT sport, attribute, 'n', n FROM a)
SELECT attribute, metric, round(max(CASE WHEN sport = 'ASIA' THEN v END), 5) AS "ASIA", round(max(CASE WHEN sport = 'EUROPE' THEN v END), 5) AS "EUROPE" FROM u GROUP BY 1, 2""")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as rows, groups as columns."""
    a = _metrics(spark, sf_dir).groupBy("sport", "attribute").agg(F.avg("r100").alias("r100"), F.sum("n").alias("n"))
    return rounded(reports.wide(a, ["attribute"], "sport", ["ASIA", "EUROPE"], ["r100", "n"]), 5)


@query(_METRICS + ", a AS (SELECT sport, attribute, round(avg(med_rank), 4) AS v FROM m GROUP BY 1, 2) SELECT sport, string_agg(attribute, ' > ' ORDER BY v DESC, attribute) AS ordering FROM a GROUP BY 1")
def tier_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by falling value."""
    a = _metrics(spark, sf_dir).groupBy("sport", "attribute").agg(F.round(F.avg("med_rank"), 4).alias("v"))
    return reports.ordering(a, ["sport"], "attribute", "v")


@query("SELECT r_name, o_orderpriority FROM region, (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT r_name, o_orderpriority FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 480000")
def missing_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid less what is there."""
    o = read(spark, sf_dir, "orders")
    r = read(spark, sf_dir, "region")
    there = r.join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(o.where("o_totalprice > 480000"), F.col("c_custkey") == F.col("o_custkey"))
    return reports.missing_combinations([r.select("r_name"), o.select("o_orderpriority").distinct()], there, ["r_name", "o_orderpriority"])


# -- sets, joins ---------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection of keys."""
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of keys."""
    return read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(read(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("k"))).distinct()


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05")
def left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag difference."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.where("l_quantity > 40").select("l_orderkey").exceptAll(l.where("l_discount > 0.05").select("l_orderkey"))


@query("SELECT o_orderkey, coalesce(a.v, b.v) AS v FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON o_orderkey = a.l_orderkey LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON o_orderkey = b.l_orderkey")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup with a fallback key; misses stay null."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda f, n: l.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias(n))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(side("R", "a"), "o_orderkey", "left").join(side("N", "b"), "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b").alias("v"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' GROUP BY 1")
def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-joins along keys, filters at the scans."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    l = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    return l.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("n_orders"))


# -- windows of time, batch forms of the streams -------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    return rounded(streams.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type"), 4)


@query("SELECT s AS start, s + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS s FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of an hour, every half."""
    return rounded(streams.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type", slide="30 minutes"), 4)


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of six hours."""
    return streams.sessions(read(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
