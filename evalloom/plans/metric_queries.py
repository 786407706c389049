"""Metric queries: calibration, accuracy, scores and run hygiene on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import probability, text
from evalloom.operators import accuracy, calibration, runs
from evalloom.plans.catalog import query
from evalloom.plans.tables import read, rounded

#: Answers made from documents by arithmetic on doc_id: four options with probabilities, the true one, a prediction.
ANSWERS_SQL = """
WITH b AS (SELECT doc_id, lang, source, n_chars, 1 + doc_id % 7 AS a, 1 + doc_id % 5 AS b, 1 + doc_id % 3 AS c, 1 + doc_id % 11 AS d FROM documents),
answers AS (SELECT doc_id, lang, source, n_chars, a::DOUBLE / (a+b+c+d) AS pa, b::DOUBLE / (a+b+c+d) AS pb, c::DOUBLE / (a+b+c+d) AS pc, d::DOUBLE / (a+b+c+d) AS pd,
  substr('ABCD', 1 + (n_chars % 4)::INT, 1) AS truth, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr('ABCD', 1 + ((doc_id + n_chars // 3) % 4)::INT, 1) END AS predicted FROM b)
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    parts = [(1 + F.col("doc_id") % m).cast("double") for m in (7, 5, 3, 11)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    options = F.create_map(*(x for k, p in zip("ABCD", parts, strict=True) for x in (F.lit(k), p / total)))
    letter = lambda n: F.substring(F.lit("ABCD"), (1 + n % 4).cast("int"), F.lit(1))
    predicted = F.when(F.col("doc_id") % 9 != 0, letter(F.col("doc_id") + F.floor(F.col("n_chars") / 3)))
    return d.select("*", options.alias("probabilities"), letter(F.col("n_chars")).alias("truth"), predicted.alias("predicted"))


_SAMPLES = ANSWERS_SQL + """, s AS (SELECT p, (o = truth)::INT AS hit FROM (
  SELECT truth, 'A' AS o, pa AS p FROM answers UNION ALL SELECT truth, 'B', pb FROM answers UNION ALL SELECT truth, 'C', pc FROM answers UNION ALL SELECT truth, 'D', pd FROM answers)),
bins AS (SELECT least(floor(p * 10)::INT, 9) AS bin, count(*) AS n, avg(p) AS confidence, avg(hit) AS accuracy FROM s GROUP BY 1)
"""


@query(_SAMPLES + "SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: bins of option probabilities."""
    return rounded(calibration.calibration_bins(calibration.option_samples(answers(spark, sf_dir)), 10))


@query(_SAMPLES + "SELECT round(sum(abs(accuracy - confidence)) / 10, 6) AS ce_unweighted, round(sum(abs(accuracy - confidence) * n) / sum(n), 6) AS ce_weighted, sum(n)::BIGINT AS n FROM bins")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: unweighted and weighted calibration error."""
    return rounded(calibration.calibration_error(calibration.option_samples(answers(spark, sf_dir)), 10))


@query(ANSWERS_SQL + """, x AS (SELECT pa+pb+pc+pd AS s, CASE truth WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc WHEN 'D' THEN pd END AS p, coalesce(predicted = truth, false) AS ok FROM answers)
SELECT round(min(s), 6) AS sum_min, round(max(s), 6) AS sum_max, round(avg(s), 6) AS sum_mean, round(stddev_samp(s), 6) AS sum_std, round(min(p), 6) AS truth_min, round(max(p), 6) AS truth_max, round(avg(p), 6) AS truth_mean, round(median(p), 6) AS truth_median, count(p) AS truth_n,
round(avg(p) FILTER (ok), 6) AS correct_mean, round(median(p) FILTER (ok), 6) AS correct_median, count(p) FILTER (ok) AS correct_n, round(avg(p) FILTER (NOT ok), 6) AS wrong_mean, round(median(p) FILTER (NOT ok), 6) AS wrong_median, count(p) FILTER (NOT ok) AS wrong_n FROM x""")
def calibration_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of probabilities and probability of the truth, over all, correct and wrong answers."""
    return rounded(calibration.diagnostics(answers(spark, sf_dir)))


@query(ANSWERS_SQL + """, x AS (SELECT CASE predicted WHEN 'A' THEN pa WHEN 'B' THEN pb WHEN 'C' THEN pc WHEN 'D' THEN pd END AS p, coalesce(predicted = truth, false) AS ok FROM answers)
SELECT round(min(p), 6) AS min, round(max(p), 6) AS max, round(avg(p), 6) AS mean, round(avg(p) FILTER (ok), 6) AS correct_mean, round(avg(p) FILTER (NOT ok), 6) AS wrong_mean FROM x""")
def predicted_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the predicted option, over all, correct and wrong answers."""
    return rounded(calibration.predicted_probabilities(answers(spark, sf_dir)))


@query(ANSWERS_SQL + """, x AS (SELECT greatest(pa, pb, pc, pd) AS c, coalesce(predicted = truth, false) AS ok FROM answers)
SELECT t AS at_least, count(*) FILTER (WHERE c >= t) AS n, round(avg(CASE WHEN c >= t THEN ok::INT::DOUBLE END), 6) AS accuracy FROM x, (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]) AS t) GROUP BY t""")
def accuracy_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy at or above a confidence."""
    a = answers(spark, sf_dir).select(F.array_max(F.map_values("probabilities")).alias("c"), F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)).alias("ok"))
    return rounded(calibration.accuracy_above(a, "c", "ok", (0.3, 0.4, 0.5)))


@query(ANSWERS_SQL + """SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, count(*) FILTER (WHERE predicted = truth) AS correct, count(*) AS total, round(avg((predicted = truth)::INT::DOUBLE), 4) AS accuracy
FROM answers WHERE predicted IS NOT NULL GROUP BY ROLLUP (lang)""")
def letter_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by type and overall; unreadable rows don't count."""
    return accuracy.letter_accuracy(answers(spark, sf_dir), ["lang"], "predicted", "truth")


@query(ANSWERS_SQL + """SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, CASE WHEN grouping(lang) = 1 THEN NULL ELSE source END AS source, count(*) FILTER (WHERE predicted = truth) AS correct, count(*) AS total, round(avg(coalesce(predicted = truth, false)::INT::DOUBLE), 4) AS accuracy
FROM answers GROUP BY GROUPING SETS ((lang, source), ())""")
def exact_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-match accuracy by two columns and overall; a missing prediction is wrong."""
    return accuracy.exact_accuracy(answers(spark, sf_dir), ["lang", "source"], "predicted", "truth")


@query(ANSWERS_SQL + """, g AS (SELECT source, count(*) FILTER (WHERE predicted = truth) AS c, count(*) AS n FROM answers GROUP BY 1)
SELECT round(sum(c)::DOUBLE / sum(n), 6) AS micro, round(avg(round(c::DOUBLE / n, 4)), 6) AS macro, sum(n)::BIGINT AS n FROM g""")
def goal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro accuracy and mean of rounded group accuracies."""
    a = answers(spark, sf_dir).withColumn("ok", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False)))
    return rounded(accuracy.goal_accuracy(a, "source", "ok"))


@query(ANSWERS_SQL + """SELECT lang, round(avg(((pa - (truth='A')::INT)**2 + (pb - (truth='B')::INT)**2 + (pc - (truth='C')::INT)**2 + (pd - (truth='D')::INT)**2) / 4), 6) AS brier, round(3.0::DOUBLE / 16, 6) AS random_brier FROM answers GROUP BY lang""")
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass Brier score and that of a uniform guess."""
    options = F.array(*map(F.lit, "ABCD"))
    a = answers(spark, sf_dir)
    return rounded(a.groupBy("lang").agg(F.avg(probability.brier(F.col("probabilities"), F.col("truth"), options)).alias("brier"), F.first(probability.random_brier(options)).alias("random_brier")))


@query("""WITH x AS (SELECT doc_id, [doc_id % 5, doc_id % 3, 0.5 * (doc_id % 4)]::DOUBLE[] AS l FROM documents),
e AS (SELECT doc_id, list_transform(l, lambda v: exp(v - list_max(l))) AS g FROM x)
SELECT doc_id, round(g[1] / list_sum(g), 6) AS pa, round(g[2] / list_sum(g), 6) AS pb, round(g[3] / list_sum(g), 6) AS pc FROM e""")
def option_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """softmax over option logits."""
    i = F.col("doc_id")
    logits = F.create_map(F.lit("A"), (i % 5).cast("double"), F.lit("B"), (i % 3).cast("double"), F.lit("C"), 0.5 * (i % 4))
    p = probability.softmax(logits, F.array(*map(F.lit, "ABC")))
    return rounded(read(spark, sf_dir, "documents").select("doc_id", p.alias("p")).select("doc_id", *(F.col("p")[k].alias(f"p{k.lower()}") for k in "ABC")))


_SCORES_SQL = "WITH s AS (SELECT lang, source, (doc_id % 7)::INT - 1 AS score, (doc_id % 4)::INT AS got, (doc_id % 6)::INT AS total, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 10 END AS style, (doc_id % 3)::DOUBLE AS cost FROM documents) "


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "lang", "source", ((i % 7).cast("int") - 1).alias("score"), (i % 4).cast("int").alias("got"), (i % 6).cast("int").alias("total"), F.when(i % 5 != 0, i % 10).alias("style"), (i % 3).cast("double").alias("cost")
    )


@query(_SCORES_SQL + "SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, round(coalesce(avg(CASE WHEN score > -1 THEN score END), -1), 6) AS score, count(*) FILTER (WHERE score > -1) AS succeeded, count(*) AS total FROM s GROUP BY ROLLUP (lang)")
def judged_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of judge scores that succeeded."""
    return rounded(accuracy.judged_mean(scores(spark, sf_dir), ["lang"], "score"))


@query(_SCORES_SQL + "SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, round(avg(CASE WHEN total > 0 THEN got::DOUBLE / total END), 6) AS score, count(CASE WHEN total > 0 THEN 1 END) AS n FROM s GROUP BY ROLLUP (lang)")
def factual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the samples' ratios."""
    return rounded(accuracy.factual(scores(spark, sf_dir), ["lang"], "got", "total"))


@query(_SCORES_SQL + "SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, round(sum(CASE WHEN total > 0 THEN got END)::DOUBLE / sum(CASE WHEN total > 0 THEN total END), 6) AS micro, round(avg(CASE WHEN total > 0 THEN got::DOUBLE / total END), 6) AS macro, count(CASE WHEN total > 0 THEN 1 END) AS n FROM s GROUP BY ROLLUP (lang)")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums."""
    return rounded(accuracy.coverage(scores(spark, sf_dir), ["lang"], "got", "total"))


@query(_SCORES_SQL + "SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE lang END AS lang, round(avg(score), 6) AS score, round(avg(style), 6) AS style, round(sum(cost), 6) AS cost FROM s GROUP BY ROLLUP (lang)")
def judge_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of judge dimensions with their own nulls, total cost."""
    return rounded(accuracy.score_means(scores(spark, sf_dir), ["lang"], ["score", "style"], "cost"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE greatest(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 6 END, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE doc_id % 5 END) END AS best FROM documents""")
def best_of_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of several judge scores; none 0, all failed -1."""
    i = F.col("doc_id")
    s = F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.when(i % 3 != 0, i % 6), F.when(i % 2 != 0, i % 5)))
    return read(spark, sf_dir, "documents").select("doc_id", accuracy.best_of(s).cast("long").alias("best"))


@query("SELECT lang, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS failed FROM (SELECT lang, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars::DOUBLE END AS v FROM documents) GROUP BY lang")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation, median, failures."""
    d = read(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 8 != 0, F.col("n_chars").cast("double")).alias("v"))
    return rounded(accuracy.corpus_summary(d, "v", ["lang"]))


@query("""SELECT event_type AS model, round(sum((input_tokens - cached_tokens) * ip + cached_tokens * cp + output_tokens * op) / 1e6 * 0.5, 6) AS cost, count(*) AS n FROM (
SELECT event_type, user_id % 1000 AS input_tokens, user_id % 100 AS cached_tokens, event_id % 300 AS output_tokens FROM events) JOIN (SELECT event_type, 2.0::DOUBLE AS ip, 0.5::DOUBLE AS cp, 8.0::DOUBLE AS op FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY 1""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token cost with cached tokens at batch price."""
    e = read(spark, sf_dir, "events")
    usage = e.select(F.col("event_type").alias("model"), (F.col("user_id") % 1000).alias("input_tokens"), (F.col("user_id") % 100).alias("cached_tokens"), (F.col("event_id") % 300).alias("output_tokens"))
    prices = e.select(F.col("event_type").alias("model")).distinct().select("model", F.lit(2.0).alias("input_price"), F.lit(0.5).alias("cached_price"), F.lit(8.0).alias("output_price"))
    return rounded(accuracy.token_cost(usage, prices, batch=True))


# -- runs: events as attempts; key user_id, success event_type <> 'error' ------------------------------------------

_ATTEMPTS_SQL = "WITH a AS (SELECT event_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id END AS qid, event_type <> 'purchase' AS ok, value, user_id % 10 AS worker FROM events) "


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select("event_id", F.when(u % 13 != 0, u).alias("qid"), (F.col("event_type") != "purchase").alias("ok"), "value", (u % 10).alias("worker"))


@query(_ATTEMPTS_SQL + "SELECT event_id, qid, ok FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ok::INT DESC, event_id DESC) AS r FROM a WHERE qid IS NOT NULL) WHERE r = 1 UNION ALL SELECT event_id, qid, ok FROM a WHERE qid IS NULL")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success beats failure, else the later row; rows without id stay."""
    return runs.keep_best(attempts(spark, sf_dir).select("event_id", "qid", "ok"), "qid", "ok", "event_id")


@query(_ATTEMPTS_SQL + "SELECT worker, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, round(sum(value), 4) AS seconds, count(CASE WHEN NOT ok THEN 'x' END) AS errors, round(avg(value), 4) AS seconds_each, round(100 * avg(ok::INT::DOUBLE), 4) AS success_percent FROM a GROUP BY ROLLUP (worker)")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by worker and over all."""
    a = attempts(spark, sf_dir).withColumn("error", F.when(~F.col("ok"), F.lit("x")))
    return rounded(runs.run_stats(a, "worker", "ok", "value", "error"), 4)


@query("SELECT count(DISTINCT coalesce(CASE WHEN event_id % 3 = 0 THEN user_id END, event_id)) AS n_ids FROM events")
def distinct_question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids by a chain of fallbacks."""
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("question_id"), F.col("event_id").alias("index"))
    return runs.distinct_ids(e, "question_id", "index")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def unprocessed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join on processed ids."""
    done = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.unprocessed(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


_VERDICTS_SQL = """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Right' ELSE 'Wrong' END AS verdict FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'Right' WHEN toxic = 1 THEN 'Wrong' END AS v FROM labels),
m AS (SELECT doc_id, coalesce(n.v, c.verdict) AS verdict FROM c FULL JOIN n USING (doc_id)) """


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "Right").otherwise("Wrong").alias("verdict"))
    new = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Right").when(F.col("toxic") == 1, "Wrong").alias("verdict"))
    return runs.overlay(cached, new, "doc_id", "verdict")


@query(_VERDICTS_SQL + "SELECT doc_id, verdict FROM m")
def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer verdicts over cached ones."""
    return verdicts(spark, sf_dir)


@query(_VERDICTS_SQL + "SELECT lang, count(*) FILTER (WHERE verdict = 'Right') AS correct, count(verdict) AS judged, count(*) - count(verdict) AS unjudged, count(*) AS total, round(avg(coalesce(verdict = 'Right', false)::INT::DOUBLE), 6) AS accuracy FROM documents LEFT JOIN m USING (doc_id) GROUP BY lang")
def judged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unjudged results count as wrong."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return runs.judged_counts(runs.judged(d, verdicts(spark, sf_dir), "doc_id"), "lang")


@query("SELECT lang AS run, count(*) AS total, count(l.doc_id) AS covered, count(*) > 0 AND count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang")
def run_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, covered and complete."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("run"), F.col("doc_id").alias("id"))
    return runs.completeness(d, d.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi"), "run")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert to the latest row of each key."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return runs.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, sha256(doc_id::VARCHAR || '|||' || lang || '|||' || CASE WHEN doc_id % 5 = 0 THEN 'None' ELSE source END) AS cache_key FROM documents")
def judge_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest of question, gold and prediction."""
    key = text.judge_key(F.col("doc_id").cast("string"), F.col("lang"), F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    return read(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))
