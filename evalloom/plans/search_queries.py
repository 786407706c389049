"""Search queries on the test tables: nodes are the lines of documents, queries the benchmark items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions.vectors import unit
from evalloom.operators import blocks, search
from evalloom.operators.filters import Fields
from evalloom.plans.catalog import query
from evalloom.plans.tables import read
from evalloom.storage import shared_dir

_FIELDS = Fields(scalars=("lang", "source"), arrays=("tags",), aliases={"language": "lang"})


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), unit(F.col("embedding")).alias("v"))
    nodes = d.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("node_id"), "doc_id", "content", "lang", "source", F.array("lang", "source").alias("tags"))
    return nodes.join(v.withColumn("node_id", F.col("node_id") * 1_000_000), "node_id", "left")


def _index(spark: SparkSession, sf_dir: str) -> search.SearchIndex:
    """Built in two increments that overlap; the second is sent twice."""
    index = search.SearchIndex(spark, f"{shared_dir(spark)}/index/{uuid.uuid4().hex}", _FIELDS, shards=8)
    nodes = _nodes(spark, sf_dir)
    index.ingest(nodes.where("doc_id % 2 = 0"), "even")
    index.ingest(nodes, "all")
    index.ingest(nodes, "all")
    return index


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), unit(F.col("embedding")).alias("qv"))
    kind = F.col("item_id") % 5
    filters = (
        F.when(kind == 1, F.create_map(F.lit("language"), F.array(F.lit("en"), F.lit("de"))))
        .when(kind == 2, F.create_map(F.lit("tags"), F.array(F.lit("src1"), F.lit("fr")), F.lit("source"), F.array().cast("array<string>")))
        .when(kind == 3, F.create_map(F.lit("source"), F.array(F.lit("src2"), F.lit("src3"))))
        .when(kind == 4, F.create_map(F.lit("source"), F.array(F.lit("src2"), F.lit("none")), F.lit("lang"), F.array(F.lit("xx"))))
    )
    return b.join(v, "item_id", "left").select(F.col("item_id").alias("query_id"), F.when(kind != 3, F.col("text")).alias("query"), "qv", filters.alias("filters"))


_SEARCH_SQL = """WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id * 1000000 + unnest(range(len(l))) AS node_id, doc_id, lang, source, unnest(l) AS content FROM d),
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings),
t AS (SELECT node_id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM n),
c AS (SELECT count(*)::DOUBLE AS n_nodes, sum(len(w))::DOUBLE / count(*) AS mean FROM t WHERE len(w) > 0),
q AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 <> 3 THEN text END AS query, item_id % 5 AS kind FROM benchmark),
qt AS (SELECT DISTINCT query_id, kind, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM q),
p AS (SELECT node_id, len(w) AS len, unnest(w) AS term FROM t),
tf AS (SELECT term, node_id, any_value(len) AS len, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
ok AS (SELECT q.query_id, n.node_id FROM q JOIN n ON CASE q.kind WHEN 0 THEN true WHEN 1 THEN n.lang IN ('en', 'de') WHEN 2 THEN n.source = 'src1' OR n.lang = 'fr' WHEN 3 THEN n.source IN ('src2', 'src3') ELSE false END),
lx AS (SELECT qt.query_id, tf.node_id, round(sum(ln(1 + (n_nodes - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS s FROM qt JOIN tf USING (term) JOIN df USING (term), c GROUP BY 1, 2),
lr AS (SELECT query_id, node_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) - 1 AS rank FROM lx SEMI JOIN ok USING (query_id, node_id) QUALIFY rank < 50),
sr AS (SELECT q.query_id, b.vec_id * 1000000 AS node_id, round((list_dot_product(a.v, b.v) + 1) / 2, 4) AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY round((list_dot_product(a.v, b.v) + 1) / 2, 4) DESC, b.vec_id) - 1 AS rank
       FROM q JOIN u a ON a.vec_id = q.query_id JOIN u b ON true JOIN ok ON ok.query_id = q.query_id AND ok.node_id = b.vec_id * 1000000 WHERE q.query IS NOT NULL QUALIFY rank < 50),
f AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT query_id, node_id, rank FROM lr UNION ALL SELECT query_id, node_id, rank FROM sr) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) - 1 AS place FROM f QUALIFY place < 25),
h AS (SELECT fr.query_id, fr.node_id, place, least(round(fr.s * 30, 4), 1.0) AS rrf, round(sr.s, 4) AS semantic, round(lr.s / m.best, 4) AS bm25 FROM fr LEFT JOIN sr USING (query_id, node_id) LEFT JOIN lr USING (query_id, node_id) LEFT JOIN (SELECT query_id, max(s) AS best FROM lr GROUP BY 1) m ON m.query_id = fr.query_id
      UNION ALL SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) - 1, NULL, NULL, NULL FROM ok SEMI JOIN (SELECT query_id FROM q WHERE query IS NULL) USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node_id) <= 50),
g AS (SELECT h.query_id, n.doc_id, n.content, h.rrf, h.semantic, h.bm25, row_number() OVER (PARTITION BY h.query_id, n.doc_id ORDER BY -coalesce(h.rrf, 1), place) AS o, row_number() OVER (PARTITION BY h.query_id, n.doc_id, n.content ORDER BY -coalesce(h.rrf, 1), place) AS again, place FROM h JOIN n USING (node_id)),
r AS (SELECT query_id, doc_id, max(rrf) FILTER (WHERE o = 1) AS rrf, max(semantic) FILTER (WHERE o = 1) AS semantic, max(bm25) FILTER (WHERE o = 1) AS bm25, max(place) FILTER (WHERE o = 1) AS place, string_agg(content, chr(10) || '... ' ORDER BY o) FILTER (WHERE again = 1) AS j FROM g GROUP BY 1, 2) """


@query(_SEARCH_SQL + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY -coalesce(rrf, 1), place, doc_id) - 1 AS rank, doc_id, rrf, semantic, bm25, CASE WHEN length(j) > 500 THEN substr(j, 1, 500) || ' ... (truncated)' ELSE j END AS highlights FROM r QUALIFY rank < 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from a persisted index, each query with its own filters."""
    return _index(spark, sf_dir).documents(_asked(spark, sf_dir), 5, semantic_multiplier=10, lexical_multiplier=10)


@query("""WITH q AS (SELECT item_id AS query_id, unnest(['src2', 'none']) AS source FROM benchmark WHERE item_id % 5 = 4), k AS (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY 1)
SELECT query_id, CASE WHEN k.source IS NULL THEN 'Source ' || q.source || ' does not exist in the database.' ELSE 'xx does not exist for source ' || q.source || '.' END AS message FROM q LEFT JOIN k USING (source)""")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a filtered search found nothing, for the queries whose filters nothing fits."""
    q = _asked(spark, sf_dir).where("query_id % 5 = 4")
    nodes = _nodes(spark, sf_dir).select("node_id", "lang", "source", "tags")
    found = blocks.first_k(q, nodes, 5, "node_id", _FIELDS)
    kinds = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("entity")).agg(F.collect_set("lang").alias("kinds"))
    return search.missing(q, found, "source", "lang", kinds, "Source")


_CLIPS = Fields(scalars=("label",), intervals={"temporal_boundary": ("start", "end")}, clocks={"time_remaining": ("clock_low", "clock_high")}, aliases={"quarter": "label", "half": "label"})


def _clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(i.alias("clip_id"), unit(F.col("embedding")).alias("v"), F.col("label").cast("string").alias("label"), (i % 90).cast("double").alias("start"), (i % 90 + 5.4).alias("end"), (i % 700).alias("clock_low"), (i % 700 + 6).alias("clock_high"))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v, vec_id // 20 % 4 AS kind FROM u WHERE vec_id % 20 = 0),
p AS (SELECT q.query_id, u.vec_id AS clip_id, CASE WHEN kind <> 3 THEN round((list_dot_product(q.v, u.v) + 1) / 2, 4) END AS score FROM q JOIN u ON CASE kind WHEN 0 THEN true WHEN 1 THEN vec_id % 90 < 40.5 AND vec_id % 90 + 5.4 > 30
      WHEN 2 THEN vec_id % 700 < 600 AND vec_id % 700 + 6 > 525.5 ELSE label IN (1, 3) END)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clip_id) - 1 AS rank, clip_id, score FROM p QUALIFY rank < 10 AND coalesce(score, 1) >= 0.55""")
def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search among clips that fit each query's label, time or clock; without text the first that fit."""
    clips = _clip_rows(spark, sf_dir)
    kind = F.floor(F.col("clip_id") / 20) % 4
    filters = (
        F.when(kind == 1, F.create_map(F.lit("temporal_boundary"), F.array(F.lit("30-40.5"))))
        .when(kind == 2, F.create_map(F.lit("time_remaining"), F.array(F.lit("10:00-08:45.5"))))
        .when(kind == 3, F.create_map(F.lit("quarter"), F.array(F.lit("1"), F.lit("3"))))
    )
    queries = clips.where("clip_id % 20 = 0").select(F.col("clip_id").alias("query_id"), F.when(kind != 3, F.col("v")).alias("qv"), filters.alias("filters"))
    return search.clips(queries, clips, _CLIPS, 10, least=0.55)


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round((list_dot_product(q.v, i.v) + 1) / 2, 4) AS first FROM u q JOIN u i ON q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, item_id) AS r FROM p QUALIFY r <= 8),
s AS (SELECT query_id, item_id, first, (query_id * 31 + item_id * 17) % 101 / 100.0::DOUBLE AS score FROM k)
SELECT query_id, item_id, first, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank FROM s""")
def second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight of exact search, scored again behind the model boundary (here by arithmetic on the ids)."""
    items = _clip_rows(spark, sf_dir).select(F.col("clip_id").alias("item_id"), "v")
    queries = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("qv"))
    best = blocks.block_top_k(queries, items, 8)
    return blocks.rerank(best.withColumn("q", F.col("query_id")).withColumn("i", F.col("item_id")), 8, _arithmetic, {"q": "query", "i": "item"})


def _arithmetic():
    return lambda rows: [(r["query"] * 31 + r["item"] * 17) % 101 / 100.0 for r in rows]
