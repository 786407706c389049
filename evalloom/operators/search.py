"""Hybrid search over a persisted index: lexical and vector retrieval, fusion, documents with highlights, diagnosis of none.

The index is a folder of tables. ``nodes`` hold content, metadata and vectors; ``postings`` one row a term and node, by
shard of the term and sorted by term, so that a search reads its terms' shards only; ``lengths`` and ``frequencies`` the
sums that BM25 needs. Every ingested increment is a directory of each table and counts once its line is in ``manifest``:
a run that dies before leaves nothing that is read, and the next run under the same name overwrites it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.operators.blocks import Best, Kept, block_top_k, by_filters, first_k
from evalloom.operators.filters import Fields
from evalloom.operators.retrieval import CARRIED, K1, RRF_K, B, fuse, terms, top_k

SHARDS = 64
#: Scores are compared at so many places, so that sums in another order rank alike.
PLACES = 6
#: Scores of queries and nodes that a task holds at a time.
HELD = 1 << 22


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``node_id, terms`` each distinct term of a batch with its nodes, the counts there and the nodes' lengths."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column("node_id")))
        n, lists = len(batch), batch.column("terms")
        words = lists.flatten().dictionary_encode()
        places = words.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(lists).to_numpy()
        pairs, tf = np.unique(places, return_counts=True)
        term, row = pairs // max(n, 1), pairs % max(n, 1)
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=int)
        ends = pa.array(np.append(start, len(term)), pa.int32())
        length = pc.list_value_length(lists).to_numpy()[row]
        held = [pa.array(batch.column("node_id").to_numpy()[row], pa.int64()), pa.array(tf, pa.int32()), pa.array(length, pa.int32())]
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[start])), *(pa.ListArray.from_arrays(ends, x) for x in held)], ["term", "nodes", "tf", "length"])


class Matches(Kept):
    """The best k nodes of each query by BM25, of postings that come node by node.

    ``asked``: ``query_id, no, idf, mean``, a row for each query and term ``no``.
    """

    def __init__(self, asked: pa.Table, filters: dict | None, k: int, fields: Fields):
        ids, self.who = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
        super().__init__(ids, k, "node_id", PLACES)
        no = asked.column("no").to_numpy()
        order = np.argsort(no, kind="stable")
        self.who, n = self.who[order], int(no.max()) + 1 if len(no) else 0
        self.start = np.searchsorted(no[order], np.arange(n + 1))
        self.idf = asked.column("idf").to_numpy()[order][self.start[:-1]] if n else np.zeros(0)
        self.mean, self.fields = asked.column("mean")[0].as_py() if n else None, fields
        self.groups = None if filters is None else by_filters([filters.get(q) for q in ids.tolist()])

    def add(self, rows: pa.Table) -> None:
        """Whole nodes, sorted by ``node_id, _no``; where there are filters, a row without ``_no`` has a node's metadata."""
        if not len(self.ids) or not len(rows):
            return
        node = rows.column("node_id").to_numpy()
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        hit = np.asarray(rows.column("_no").is_valid())
        fits = None
        if self.groups is not None:
            met = np.flatnonzero(~hit)
            fits = np.zeros((len(self.groups), len(first)), dtype=bool)
            for batch in rows.select(["node_id", *self.fields.columns()]).take(pa.array(met)).combine_chunks().to_batches():
                for g, (filters, _) in enumerate(self.groups):
                    fits[g, of[met[: len(batch)]]] = self.fields.mask(batch, filters)
                met = met[len(batch) :]
        some = rows.filter(pa.array(hit))
        of, no, tf, length = of[hit], *(some.column(c).to_numpy() for c in ("_no", "_tf", "_length"))
        w = self.idf[no] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))
        step = min(Best.COLUMNS, max(1, HELD // len(self.ids)))
        for at in range(0, len(first), step):
            to = min(at + step, len(first))
            here = slice(*np.searchsorted(of, (at, to)))
            n = self.start[no[here] + 1] - self.start[no[here]]
            each = np.repeat(np.arange(len(n)), n)
            who = self.who[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.start[no[here]][each]]
            scores = np.bincount(who * (to - at) + of[here][each] - at, w[here][each], len(self.ids) * (to - at)).astype(float).reshape(len(self.ids), to - at)
            scores[scores == 0] = -np.inf
            if fits is None:
                self.merge(np.arange(len(self.ids)), scores, node[first[at:to]])
                continue
            for g, (_, members) in enumerate(self.groups):
                self.merge(members, np.where(fits[g, None, at:to], scores[members], -np.inf), node[first[at:to]])


class SearchIndex:
    """An index of nodes ``node_id, doc_id, content, v`` and the metadata of ``fields``."""

    def __init__(self, spark: SparkSession, path: str, fields: Fields, shards: int = SHARDS):
        self.spark, self.path, self.fields, self.shards = spark, path.rstrip("/"), fields, shards
        self.refresh()

    def refresh(self) -> None:
        """See what others have ingested since."""
        self._known = self.increments()

    # -- writing --

    def _exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def increments(self) -> list[str]:
        """Names of the committed increments."""
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/manifest").select("name").collect()) if self._exists("manifest") else []

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/increment={i}" for i in self._known)).drop("increment")

    def nodes(self) -> DataFrame:
        return self._table("nodes")

    def _shard(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.shards)).cast("int")

    def ingest(self, nodes: DataFrame, increment: str) -> bool:
        """Add the nodes that the index hasn't, under a name; False if that increment is in already.

        Of rows that repeat a node_id one is taken, the least by content. Null content is empty. As a sink of a stream:
        ``foreachBatch(lambda rows, number: index.ingest(rows, f"batch{number}"))``.
        """
        self.refresh()
        if increment in self._known:
            return False
        columns = ["node_id", "doc_id", "content", "v", *self.fields.columns()]
        new = nodes.where("node_id is not null").withColumn("content", F.coalesce("content", F.lit(""))).select(*columns)
        new = new.groupBy("node_id").agg(F.min_by(F.struct(*columns[1:]), "content").alias("r")).select("node_id", "r.*")
        if self._known:
            new = new.join(self.nodes().select("node_id"), "node_id", "left_anti")

        def put(rows: DataFrame, table: str, *by: str) -> DataFrame:
            where = f"{self.path}/{table}/increment={increment}"
            rows.write.mode("overwrite").partitionBy(*by).parquet(where)
            return self.spark.read.parquet(where)

        kept = put(new, "nodes")
        cut = kept.select("node_id", terms(F.col("content")).alias("terms")).where(F.size("terms") > 0)
        # a term is shuffled once with all its nodes of a batch
        counted = cut.select(F.col("node_id").cast("long"), "terms").mapInArrow(_counted, "term string, nodes array<long>, tf array<int>, length array<int>")
        dealt = counted.withColumn("shard", self._shard(F.col("term"))).repartition("shard", F.pmod(F.xxhash64(F.col("nodes")[0]), F.lit(8)))
        flat = dealt.select("term", F.inline(F.arrays_zip(F.col("nodes").alias("node_id"), "tf", "length")), "shard").withColumn("tf", F.col("tf").cast("long"))
        written = put(flat.sortWithinPartitions("shard", "term", "node_id"), "postings", "shard")
        put(written.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df")).repartition("shard").sortWithinPartitions("shard", "term"), "frequencies", "shard")
        put(cut.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("length")), "lengths")
        self.spark.createDataFrame([(increment,)], "name string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._known = sorted([*self._known, increment])
        return True

    # -- reading --

    def lexical(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """``query_id, node_id, score, rank``: the best k nodes of each query by BM25, among those that fit its filters.

        Frequencies and lengths are those of the whole index. Each distinct term of a query counts once.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).withColumn("shard", self._shard(F.col("term")))
        wanted = asked.select("shard", "term").distinct()
        totals = self._table("lengths").agg(F.sum("n").alias("n_nodes"), (F.sum("length") / F.sum("n")).alias("mean"))
        df = self._table("frequencies").join(wanted, ["shard", "term"], "left_semi").groupBy("shard", "term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.col("n_nodes") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = df.crossJoin(F.broadcast(totals)).select("shard", "term", idf.alias("idf"), "mean")  # one row of totals
        if asked.count() > CARRIED:
            return self._joined(queries, asked.join(weights, ["shard", "term"]), k, where)
        return self._matched(queries, asked.join(weights, ["shard", "term"]), k, where)

    def _matched(self, queries: DataFrame, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
        """Few terms travel with the tasks. Postings are dealt by node, so its scores are made in one task and no pair of a query and a node is a row."""
        held = asked.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "shard", "term", "idf", "mean").toArrow()
        names = {t: k for k, t in enumerate(sorted(set(zip(held.column("shard").to_pylist(), held.column("term").to_pylist(), strict=True))))}
        block = held.append_column("no", pa.array([names[t] for t in zip(held.column("shard").to_pylist(), held.column("term").to_pylist(), strict=True)], pa.int32()))
        numbers = self.spark.createDataFrame([(*t, k) for t, k in names.items()], "shard int, term string, no int")
        postings = self._table("postings").where(F.col("shard").isin(sorted({s for s, _ in names})))
        rows = postings.join(F.broadcast(numbers), ["shard", "term"]).select(F.col("node_id").cast("long").alias("node_id"), F.col("no").alias("_no"), F.col("tf").cast("int").alias("_tf"), F.col("length").alias("_length"))
        filters, fields = None, self.fields
        if "filters" in queries.columns or where is not None:
            filters = {r["query_id"]: r["filters"] for r in queries.select(F.col("query_id").cast("long").alias("query_id"), "filters").collect()} if "filters" in queries.columns else {}
            allowed = self.nodes() if where is None else self.nodes().where(where)
            rows = rows.unionByName(allowed.select(F.col("node_id").cast("long").alias("node_id"), *fields.columns()), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, waiting = Matches(block, filters, k, fields), []
            for batch in batches:
                if not len(batch):
                    continue
                # the last node goes on in the next batch
                node = batch.column("node_id").to_numpy()
                end = int(np.searchsorted(node, node[-1]))
                if end or (waiting and waiting[-1].column("node_id")[0] != batch.column("node_id")[0]):
                    found.add(pa.Table.from_batches([*waiting, batch.slice(0, end)]))
                    waiting = []
                waiting.append(batch.slice(end))
            if waiting:
                found.add(pa.Table.from_batches(waiting))
            yield found.rows()

        scored = rows.repartition("node_id").sortWithinPartitions("node_id", "_no").mapInArrow(run, "query_id long, node_id long, score double")
        return top_k(scored, k, "node_id")

    def _joined(self, queries: DataFrame, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
        """Any number of terms: pairs of a query and a node that share a term are rows."""
        hits = self._table("postings").join(asked, ["shard", "term"])
        hits = hits.select("query_id", "node_id", (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))).alias("w"))
        scored = hits.groupBy("query_id", "node_id").agg(F.round(F.sum("w"), PLACES).alias("score"))
        return top_k(self._fitting(scored, queries, where), k, "node_id")

    def _fitting(self, scored: DataFrame, queries: DataFrame, where: Column | None) -> DataFrame:
        allowed = self.nodes() if where is None else self.nodes().where(where)
        if "filters" not in queries.columns:
            return scored if where is None else scored.join(allowed.select("node_id"), "node_id", "left_semi")
        met = scored.join(queries.select("query_id", "filters"), "query_id").join(allowed.select("node_id", *self.fields.columns()), "node_id")
        return met.where(self.fields.matches(F.col("filters"))).select("query_id", "node_id", "score")

    def semantic(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """``query_id, node_id, score, rank``: the best k nodes by (1 + dot product) / 2, exactly."""
        items = self.nodes() if where is None else self.nodes().where(where)
        return block_top_k(queries, items.select("node_id", "v", *self.fields.columns()), k, "node_id", self.fields)

    def filtered(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """Of queries without text that have filters, the first k nodes that fit, by id; no scores."""
        items = self.nodes() if where is None else self.nodes().where(where)
        return first_k(queries, items.select("node_id", *self.fields.columns()), k, "node_id", self.fields)

    def documents(self, queries: DataFrame, k: int = 5, semantic_multiplier: int = 100, lexical_multiplier: int = 100, fusion_multiplier: int = 5, least: float = 0.0, longest: int = 500, where: Column | None = None) -> DataFrame:
        """``query_id, rank, doc_id, rrf, semantic, bm25, highlights`` of the best k documents of each query.

        ``queries``: ``query_id, query, qv, filters`` (a map of lists). Queries with text are answered by both retrievers,
        fused by reciprocal ranks; a document has the scores of its best node and the distinct contents of all its found
        nodes, best first, joined and cut. Queries without text but with filters give the first fitting nodes, unscored;
        queries with neither give nothing.
        """
        said = F.trim(F.coalesce("query", F.lit("")))
        named = ~F.lower(said).isin("none", "null", "")
        filters = F.filter(F.map_values("filters"), lambda v: F.size(v) > 0)
        texts = queries.where(named)
        bare = queries.where(~named & (F.coalesce(F.size(filters), F.lit(0)) > 0))
        lexical = self.lexical(texts, k * lexical_multiplier, where)
        semantic = self.semantic(texts, k * semantic_multiplier, where)
        fused = fuse([semantic, lexical], k * fusion_multiplier, "node_id", RRF_K)
        best = lexical.groupBy("query_id").agg(F.max("score").alias("best"))
        found = (
            fused.select("query_id", "node_id", F.col("rank").alias("place"), F.least(F.round(F.col("score") * 30, 4), F.lit(1.0)).alias("rrf"))
            .join(semantic.select("query_id", "node_id", F.round("score", 4).alias("semantic")), ["query_id", "node_id"], "left")
            .join(lexical.select("query_id", "node_id", F.col("score").alias("s")), ["query_id", "node_id"], "left")
            .join(best, "query_id", "left")
            .select("query_id", "node_id", "place", "rrf", "semantic", F.when(F.col("best") > 0, F.round(F.col("s") / F.col("best"), 4)).alias("bm25"))
        )
        unscored = self.filtered(bare, k * semantic_multiplier, where).select("query_id", "node_id", F.col("rank").alias("place"), *(F.lit(None).cast("double").alias(c) for c in ("rrf", "semantic", "bm25")))
        rows = found.unionByName(unscored).join(self.nodes().select("node_id", "doc_id", "content"), "node_id")
        return grouped(rows, k, least, longest)


def grouped(rows: DataFrame, k: int, least: float = 0.0, longest: int = 500, mark: str = "\n... ", cut: str = " ... (truncated)") -> DataFrame:
    """Documents from found nodes (``query_id, doc_id, place, content, rrf, semantic, bm25``): the best k whose score is ``least`` or more.

    Unscored nodes count as 1. Ties go to the smaller ``place``. At most the fused nodes of one query meet in a group.
    """
    order = F.struct((-F.coalesce("rrf", F.lit(1.0))).alias("s"), "place", F.struct("rrf", "semantic", "bm25", "content").alias("r"))
    docs = rows.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(order)).alias("found"))
    first = F.col("found")[0]
    joined = F.array_join(F.array_distinct(F.transform("found", lambda x: x["r"]["content"])), mark)
    text = F.when(F.length(joined) > longest, F.concat(F.substring(joined, 1, longest), F.lit(cut))).otherwise(joined)
    docs = docs.where(-first["s"] >= least)
    best = Window.partitionBy("query_id").orderBy(first["s"], first["place"], "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
    return ranked.select("query_id", "rank", "doc_id", *(first["r"][c].alias(c) for c in ("rrf", "semantic", "bm25")), text.alias("highlights"))


def missing(queries: DataFrame, found: DataFrame, entity: str, kind: str, entities: DataFrame, label: str = "Game") -> DataFrame:
    """``query_id, message`` for queries that found nothing: filtered entities that don't exist, or lack the kind asked for.

    ``entities``: ``entity, kinds`` (an array of what exists for it).
    """
    empty = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    asked = empty.select("query_id", F.explode(F.col("filters")[entity]).alias("entity"), F.col("filters")[kind].alias("asked"))
    met = asked.join(entities.select("entity", "kinds"), "entity", "left")
    gone = F.concat(F.lit(f"{label} "), F.col("entity"), F.lit(" does not exist in the database."))
    lacks = F.filter("asked", lambda x: ~F.array_contains("kinds", x))
    said = F.when(F.col("kinds").isNull(), F.array(gone)).otherwise(F.transform(lacks, lambda x: F.concat(x, F.lit(f" does not exist for {label.lower()} "), F.col("entity"), F.lit("."))))
    return met.select("query_id", F.explode(said).alias("message"))


def clips(queries: DataFrame, clips: DataFrame, fields: Fields, k: int, least: float = 0.0, item: str = "clip_id") -> DataFrame:
    """``query_id, rank, item, score`` of clips (``item, v``, metadata): exact search within each query's filters.

    The best k are taken first, then those under ``least`` are left out. Queries without a vector give the first k clips
    that fit, without a score.
    """
    scored = block_top_k(queries, clips, k, item, fields).where(F.col("score") >= least)
    unscored = first_k(queries.where("qv is null"), clips, k, item, fields)
    return scored.select("query_id", "rank", item, "score").unionByName(unscored.select("query_id", "rank", item, "score"))

