"""The queries of this subpackage, each over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), vocabulary_file())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(_read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_matches

    return license_matches(_read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import coverage

    found = coverage(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_items", "item_id", "coverage", "contaminated")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_recurring_lines

    return drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), vocabulary_file())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(_read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import repair

    return repair(_read(spark, sf_dir, "conversations"))


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_search import top_products

    return top_products(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express on small tables; tests hold the others against brute force or by hand."""
    return {"op3_embedding_dedup": _LINKED_VECTORS, "op6_near_duplicates": _LINKED_DOCUMENTS, "op11_source_divergence": _DIVERGENCE, "op13_exact_search": _TOP_PRODUCTS}


_LINKED_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) >= 0.9::DOUBLE * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM e JOIN r ON id = vec_id LEFT JOIN n ON a = vec_id GROUP BY vec_id
"""

_LINKED_DOCUMENTS = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON id = doc_id GROUP BY doc_id
"""

_DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM t GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, t.term, t.c AS all_c, coalesce(k.c, 0) AS c FROM g JOIN t USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM w GROUP BY 1, 2, 3) k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n.n + v.v) AS p, 1 + (1000000000::HUGEINT * (all_c + 1)) // (v.n + v.v) AS q FROM c JOIN n USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""

_TOP_PRODUCTS = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)::INTEGER AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""
