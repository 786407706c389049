"""Queries over model outputs: context limits, tool calls, log-probabilities, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import extraction, text
from evalloom.operators import context
from evalloom.plans.catalog import query
from evalloom.plans.tables import read

#: Turns removed one after the other, each number tried: the smallest that fits, else all.
_CONTEXT_SQL = """WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN length(coalesce(text, '')) > 0 THEN length(role) + length(text) + 3 ELSE 0 END AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
k AS (SELECT *, sum((role = 'assistant' AND n > 2)::INT) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM m),
t AS (SELECT conv_id, unnest(range(0, max(k)::BIGINT + 1)) AS j, sum(c)::BIGINT // 4 + 4 * count(*) AS original FROM k GROUP BY 1),
s AS (SELECT t.conv_id, j, any_value(original) AS original, (coalesce(sum(c) FILTER (k = 0 OR k > j), 0))::BIGINT // 4 + 4 * count(*) FILTER (k = 0 OR k > j) AS tokens FROM t JOIN k USING (conv_id) GROUP BY 1, 2),
b AS (SELECT conv_id, any_value(original) AS original, coalesce(min(j) FILTER (tokens <= {soft}), max(j)) AS j FROM s GROUP BY 1),
r AS (SELECT k.*, original, sum((NOT (k = 0 OR k > j))::INT) OVER (PARTITION BY conv_id)::BIGINT AS n_pruned, k = 0 OR k > j AS stays FROM k JOIN b USING (conv_id)),
f AS (SELECT *, sum(c) OVER (PARTITION BY conv_id) AS size, count(*) OVER (PARTITION BY conv_id) AS rows, max(n) OVER (PARTITION BY conv_id) AS last FROM r WHERE stays),
g AS (SELECT *, size::BIGINT // 4 + 4 * rows AS after, (size - c)::BIGINT // 4 + 4 * (rows - 1) AS history FROM f) """


@query(_CONTEXT_SQL.format(soft=200) + "SELECT conv_id, turn, role, CASE WHEN original > 200 THEN 'PRUNED' ELSE 'OK' END AS status, after AS token_count, original AS original_count, n_pruned FROM g")
def pruned_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest assistant-led turns dropped until the rest fits the budget."""
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return context.limit_context(m, "conv_id", "turn", "role", "text", soft=200, hard=-1).drop("text")


_NOTICE_SQL = "chr(10) || chr(10) || '--- Maximum Length Limit Reached ---' || chr(10) || 'The response is truncated.' || chr(10) || chr(10) || '--- Final Step Reached ---' || chr(10) || 'You must offer your final answer now.'"


@query(_CONTEXT_SQL.format(soft=400) + f""", w AS (SELECT {_NOTICE_SQL} AS notice), x AS (SELECT *, (length(notice) + 7) // 4 + 4 AS told, n = last AND after > 300 AS cut FROM g, w),
y AS (SELECT *, CASE WHEN NOT cut THEN text WHEN 300 - history - told - 50 <= 0 THEN notice WHEN history + c::BIGINT // 4 + 4 + told <= 300 THEN coalesce(text, '') || notice
  ELSE substr(coalesce(text, ''), 1, floor((300 - history - told - 50) * 3.5)::BIGINT) || notice END AS body FROM x)
SELECT conv_id, turn, role, body AS text, CASE WHEN after > 300 THEN 'HARD_LIMIT_EXCEEDED' WHEN original > 400 THEN 'PRUNED' ELSE 'OK' END AS status, (sum(CASE WHEN length(coalesce(body, '')) > 0 THEN length(role) + length(body) + 3 ELSE 0 END) OVER (PARTITION BY conv_id))::BIGINT // 4 + 4 * rows AS token_count,
original AS original_count, n_pruned FROM y""")
def limited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned to a soft limit, the last message cut to a hard one."""
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return context.limit_context(m, "conv_id", "turn", "role", "text", soft=400, hard=300)


@query("""SELECT conv_id, turn, 0 AS position, 'search' AS name, text AS asked, conv_id % 9 AS k, turn % 3 = 2 AS repaired FROM conversations WHERE turn % 3 > 0
UNION ALL SELECT conv_id, turn, 1, 'look', 'again', turn, false FROM conversations WHERE turn % 3 = 1""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls in free text, by a table function: tagged, several, unclosed with a brace lacking, and none."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    call = F.to_json(F.struct(F.lit("search").alias("name"), F.struct(F.col("text").alias("query"), (F.col("conv_id") % 9).alias("k")).alias("arguments")))
    closed = F.concat(F.lit("So {this} is it. <tool_call>"), call, F.lit("</tool_call> and <tool_call>{'name': 'look', arguments: {'query': 'again', \"k\": "), F.col("turn").cast("string"), F.lit(",},}</tool_call>"))
    lacking = F.concat(F.lit("<think>{</think><tool_call>"), F.expr("substring(call, 1, length(call) - 1)"))
    said = F.when(F.col("turn") % 3 == 1, closed).when(F.col("turn") % 3 == 2, lacking).otherwise("{nothing}")
    rows = c.withColumn("call", call).select("conv_id", "turn", said.alias("said"))
    found = rows.lateralJoin(extraction.ToolCalls(F.col("said").outer()))
    return found.select("conv_id", "turn", "position", "name", F.get_json_object("arguments", "$.query").alias("asked"), F.get_json_object("arguments", "$.k").cast("long").alias("k"), "repaired")


@query("SELECT event_id, '{\"k\": ' || (event_id % 7) || ', \"s\": \"} {\"}' AS object FROM events WHERE event_id % 3 < 2")
def last_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last whole object after thoughts, tags and fences; texts without one give no row."""
    i = F.col("event_id")
    whole = F.concat(F.lit('{"k": '), (i % 7).cast("string"), F.lit(', "s": "} {"}'))
    said = F.when(i % 3 == 0, F.concat(F.lit("<think>{}</think>{\"k\": {}} then <answer>```json\n{1} "), whole, F.lit("\n```</answer> {\"x\": 1}"))).when(i % 3 == 1, F.concat(F.lit("{a} {"), F.lit("} "), whole, F.lit(" {"))).otherwise("no { object")
    return read(spark, sf_dir, "events").select("event_id", said.alias("said")).lateralJoin(extraction.LastObject(F.col("said").outer())).select("event_id", "object")


@query("""WITH a AS (SELECT event_id, unnest([{'o': 'A', 'p': CASE WHEN event_id % 3 = 0 THEN -1.0 WHEN event_id % 3 = 1 AND event_id % 5 > 0 THEN -3.0 END}, {'o': 'B', 'p': CASE WHEN event_id % 3 = 0 THEN -2.0 - event_id % 4 END}]) AS x FROM events),
b AS (SELECT event_id, x.o AS o, coalesce(x.p, -100.0)::DOUBLE AS p, max(x.p) OVER (PARTITION BY event_id) IS NULL AS none FROM a)
SELECT event_id, o AS option, round(CASE WHEN none THEN 0.5 ELSE exp(p) / sum(exp(p)) OVER (PARTITION BY event_id) END, 9) AS probability FROM b""")
def option_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first position that holds an option, then the softmax; missing options count -100, none at all evenly."""
    i, kind = F.col("event_id"), F.col("event_id") % 3

    def alt(token: str, p) -> object:
        return F.struct(F.lit(token).alias("token"), F.lit(p).cast("double").alias("logprob") if not hasattr(p, "cast") else p.cast("double").alias("logprob"))

    none = F.array().cast("array<struct<token:string,logprob:double>>")
    second = F.when(kind == 0, F.array(alt(" A", -1.0), alt("x", -0.5), alt("B", -2.0 - i % 4), alt("A", -9.0))).otherwise(F.lit(None).cast("array<struct<token:string,logprob:double>>"))
    third = F.when((kind < 2) & (i % 5 > 0), F.array(alt("A", -3.0))).otherwise(none)
    positions = F.when((kind == 2) & (i % 2 == 0), F.lit(None).cast("array<array<struct<token:string,logprob:double>>>")).otherwise(F.array(F.array(alt("The", -0.1)), second, third))
    options = F.array(F.lit("A"), F.lit("B"))
    found = read(spark, sf_dir, "events").select("event_id", text.option_logprobs(positions, options).alias("m"))
    each = found.select("event_id", F.explode(options).alias("option"), "m").select("event_id", "option", F.coalesce(F.try_element_at("m", F.col("option")), F.lit(-100.0)).alias("p"), F.col("m").isNull().alias("none"))
    from pyspark.sql import Window

    total = F.sum(F.exp("p")).over(Window.partitionBy("event_id"))
    return each.select("event_id", "option", F.round(F.when(F.col("none"), 0.5).otherwise(F.exp("p") / total), 9).alias("probability"))


@query("""SELECT event_id, 'Who, ' || event_id || '?' AS question, ['w0', 'w1', 'w2'] AS wrong, event_id % 3 = 0 AS yes, CASE WHEN event_id % 3 = 2 THEN '' ELSE 'as ' || event_id END AS explanation, CASE WHEN event_id % 2 = 0 THEN 'Why ' || event_id END AS revised,
CASE event_id % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'ab' || event_id ELSE '' END AS body, [event_id::VARCHAR, 'c1'] AS ids, ['one' || chr(10) || event_id, 'two'] AS answers FROM events""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question triples, decisions, revisions, response bodies, ids of results, numbered answers."""
    i = F.col("event_id")
    n = i.cast("string")
    triple = F.concat(F.lit("Question 1: Who, "), n, F.lit("?\nCorrect answer: me\nWrong answer 1: w0\nWrong answer 2: w1\nWrong answer 3: w2\nQuestion 4: no\nWrong answer 1: last"))
    said = F.when(i % 3 == 2, "Maybe. Explanation: none").otherwise(F.concat(F.lit("Decision: "), F.when(i % 3 == 0, " YES ").otherwise("no"), F.lit("\nExplanation: x Explanation: as "), n))
    revised = F.when(i % 2 == 0, F.concat(F.lit("Fine.\nRevised question:\n  Why "), n, F.lit(" \nRevised question: b")))
    blocks = F.concat(F.lit('{"output_text": " ", "output": [{"content": [{"text": "a"}, {"type": "x"}]}, {"message": {"content": [{"text": "b"}]}}, {"message": {"content": "'), n, F.lit('"}}]}'))
    body = F.when(i % 3 == 0, '{"output_text": " out "}').when(i % 3 == 1, blocks).otherwise("no json")
    ids = F.concat(F.lit('[{"doc_id": "'), n, F.lit('", "clip_id": "c0"}, {"clip_id": "c1"}, {"message": "none"}]'))
    answers = F.concat(F.lit("Answer 1: one\n"), n, F.lit("\nAnswer iv:  two "))
    t = text.question_triple(triple)
    d = text.decision(said)
    return read(spark, sf_dir, "events").select(
        "event_id", t["questions"][0].alias("question"), t["wrong"][0].alias("wrong"), d["yes"].alias("yes"), d["explanation"].alias("explanation"), text.revised_question(F.coalesce(revised, F.lit("none"))).alias("revised"),
        text.response_text(body).alias("body"), text.result_ids(ids).alias("ids"), text.numbered_answers(answers).alias("answers")
    )
