"""Hybrid retrieval: BM25 over an inverted index, exact vector search, rank fusion, grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.vectors import dot

K1, B = 1.2, 0.75
RRF_K = 60
#: Terms of all queries that go to every task.
CARRIED = 200_000


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``term, doc_id, tf, doc_len``: written once, this is the index; searches join it by term."""
    t = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    counted = t.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    return counted.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score`` of every document that shares a term; each distinct query term counts once.

    Texts are dealt by document once; a document's terms, weights and scores are made where it lies, so no posting and no
    pair of a query and a document is shuffled. Up to ``CARRIED`` terms of queries go to every task; more are joined.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    distinct = wanted.select("term").distinct()
    few = F.broadcast if wanted.count() <= CARRIED else lambda rows: rows
    corpus = docs.select(terms(F.col(text)).alias("terms")).agg(F.count_if(F.size("terms") > 0).alias("n_docs"), (F.sum(F.size("terms")) / F.count_if(F.size("terms") > 0)).alias("avg_len"))
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").select("doc_id", terms(F.col("text")).alias("terms"))
    each = t.select("doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    tf = each.join(few(distinct), "term", "left_semi").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", idf.alias("idf"), "avg_len")  # one row of corpus totals
    w = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return tf.join(few(asked), "term").groupBy("query_id", "doc_id").agg(F.sum(w).alias("score"))


def vector_scores(queries: DataFrame, items: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(1 + dot) / 2, rounded to four places, of each query (``query_id, qv``) with the items (``item_id, v``) that share ``on``.

    The queries are a stated set; filters on the items belong before the call.
    """
    score = F.round((dot(F.col("qv"), F.col("v")) + 1) / 2, 4)
    joined = queries.join(items, list(on)) if on else queries.crossJoin(items)
    return joined.select("query_id", "item_id", score.alias("score"))


def top_k(scored: DataFrame, k: int, item: str = "item_id", least: float | None = None) -> DataFrame:
    """The best k of each query with their 0-based ``rank``; ties by item id. Spark prunes groups before the shuffle."""
    kept = scored if least is None else scored.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(item))
    # Spark prunes by the row number itself, not by an expression of it
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def fuse(rankings: Sequence[DataFrame], k: int, item: str = "item_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings with 0-based ``rank``: sum of 1 / (constant + rank); the best k of each query."""
    both = rankings[0].select("query_id", item, "rank")
    for more in rankings[1:]:
        both = both.unionByName(more.select("query_id", item, "rank"))
    fused = both.groupBy("query_id", item).agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))
    return top_k(fused, k, item)


def normal_scores(scored: DataFrame, kind: str) -> DataFrame:
    """Scores in 0..1: ``rrf`` times 30 and at most 1, ``bm25`` over the query's best, ``semantic`` rounded."""
    s = F.col("score")
    if kind == "rrf":
        return scored.withColumn("score", F.least(F.round(s * 30, 4), F.lit(1.0)))
    if kind == "bm25":
        best = F.max("score").over(Window.partitionBy("query_id"))
        return scored.withColumn("score", F.when(best > 0, F.round(s / best, 4)).otherwise(0.0))
    return scored.withColumn("score", F.round(s, 4))


def group_by_document(hits: DataFrame, most: int = 500, sep: str = "\n... ", mark: str = " ... (truncated)", k: int | None = None, least: float = 0.0) -> DataFrame:
    """The best k documents at ``least`` or above: best score and distinct sentences, best first, joined and cut (``query_id, doc_id, score, sentence``)."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("sentence").alias("t"))))
    joined = F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["t"])), sep)
    docs = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), joined.alias("t")).where(F.col("score") >= least)
    text = F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit(mark))).otherwise(F.col("t"))
    docs = docs.select("query_id", "doc_id", "score", text.alias("highlight"))
    return docs if k is None else top_k(docs, k, "doc_id").drop("rank")


def sentence_windows(docs: DataFrame, doc_id: str, text: str, reach: int = 3) -> DataFrame:
    """One row for each sentence with the ``reach`` ones before and after it."""
    s = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), s.alias("sentences"))
    start = F.greatest(F.col("pos") - reach + 1, F.lit(1))
    stop = F.least(F.col("pos") + reach + 1, F.size("sentences"))
    return rows.select("doc_id", "sentences", F.posexplode("sentences").alias("pos", "sentence")).select("doc_id", "pos", "sentence", F.array_join(F.slice("sentences", start, stop - start + 1), " ").alias("window"))


def date_filter(column: Column, value: str) -> Column:
    """``D``, ``D..``, ``..D`` and ``D..D`` (inclusive)."""
    if ".." not in value:
        return F.to_date(column) == F.to_date(F.lit(value))
    low, high = value.split("..", 1)
    out = F.lit(True)
    if low:
        out = out & (F.to_date(column) >= F.to_date(F.lit(low)))
    if high:
        out = out & (F.to_date(column) <= F.to_date(F.lit(high)))
    return out


def metadata_filter(filters: Mapping[str, object], arrays: Sequence[str] = (), dates: Sequence[str] = (), expand: Mapping[str, Sequence[str]] | None = None, column: str = "doc_type") -> Column:
    """Conjunction of equality, any-of, array overlap and date ranges; empty and missing values don't filter."""
    out = F.lit(True)
    for key, value in filters.items():
        if value is None or value == [] or value == "":
            continue
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if expand and key == column:
            values = [x for v in values for x in expand.get(v, [v])]
        if key in dates:
            out = out & date_filter(F.col(key), str(values[0]))
        elif key in arrays:
            out = out & F.arrays_overlap(F.col(key), F.array(*map(F.lit, values)))
        else:
            out = out & F.col(key).isin(values)
    return out


def restrict_to_types(filters: Mapping[str, object], valid_for: Mapping[str, Sequence[str]], column: str = "doc_type") -> tuple[dict[str, object], list[str]]:
    """Filters that hold only for some document types: dropped with a warning for others, else the types are restricted."""
    out, warnings = dict(filters), []
    for key, types in valid_for.items():
        if out.get(key) in (None, [], ""):
            continue
        asked = out.get(column)
        if asked:
            asked_list = list(asked) if isinstance(asked, (list, tuple)) else [asked]
            if not set(asked_list) & set(types):
                warnings.append(f"{key} doesn't apply to {', '.join(asked_list)}")
                out.pop(key)
        else:
            out[column] = list(types)
    return out, warnings


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Strict overlap of two intervals."""
    return (start < to) & (end > from_)


def clock_overlaps(low: Column, high: Column, a: Column, b: Column) -> Column:
    """Overlap on a countdown clock: bounds in either order."""
    return (F.least(low, high) < F.greatest(a, b)) & (F.greatest(low, high) > F.least(a, b))
