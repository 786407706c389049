"""Objects and calls in free text against a plain scanner, context limits against a plain loop."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from evalloom.functions import extraction
from evalloom.operators import context


def nested(rng: random.Random, depth: int = 0):
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return rng.choice([1, "a", "} {", 'quote " and \\ back', None, "é\n", "{", "'", True, 2.5])
    if kind < 0.5:
        return [nested(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["name", "k", "x y", "}"]): nested(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_objects_equal_a_plain_scanner(spark):
    rng = random.Random(1)
    texts, expected = [], []
    for k in range(300):
        objects = [json.dumps({"o": nested(rng)}, ensure_ascii=rng.random() < 0.5) for _ in range(rng.randint(0, 3))]
        text = "".join(rng.choice(["text ", "it's } ", "]\n", ""]) + o for o in objects)
        lacking = rng.randint(0, 1)
        if objects and lacking:
            text = text[:-1]
        texts.append((k, text))
        expected += [(k, j, json.loads(o)) for j, o in enumerate(objects)]
    rows = spark.createDataFrame([*texts, (-1, None), (-2, ""), (-3, "x" * 100_000 + '{"o": 1}')], "id long, said string").repartition(3)
    got = rows.lateralJoin(extraction.JsonObjects(F.col("said").outer())).collect()
    assert sorted(((r["id"], r["position"], json.loads(r["object"])) for r in got if r["id"] >= 0), key=lambda x: x[:2]) == expected
    assert [(r["start"], r["lacking"]) for r in got if r["id"] == -3] == [(100_000, 0)] and not any(r["id"] in (-1, -2) for r in got)


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ('<tool_call>{"name": "a", "arguments": {"q": "x } y"}}</tool_call> <tool_call>{"name": "b"}</tool_call>', [("a", '{"q": "x } y"}', False), ("b", None, False)]),
        ('<tool_call>{"name": "a", "arguments": {"q": 1}', [("a", '{"q": 1}', True)]),
        ('<tool_call>{"name": "a", "query": {"q": 1}', []),
        ("<tool_call>{'name': 'it', args: 1, arguments: {'q': 'say \"hi\"',},}</tool_call>", [("it", '{"q": "say \\"hi\\""}', False)]),
        ('so {"name": "a", "arguments": {}}</tool_call>', [("a", "{}", False)]),
        ('first {x} then {"name": "a", "arguments": {"b": [1, 2]}} done', [("a", '{"b": [1, 2]}', False)]),
        ('<tool_call><think>{</think>{"name": "a", "arguments": {}}</tool_call>', [("a", "{}", False)]),
        ('<tool_call>[{"name": "a"}, {"x": 1}, {"name": "b", "arguments": {"k": 1}}]</tool_call>', [("a", None, False)]),
        ('[Tool Call]: find({"q": "x"})', [("find", '{"q": "x"}', False)]),
        ("[Tool Call]: find(what?)", [("find", "{}", False)]),
        ("[Tool Call]: find()", [("find", "{}", False)]),
        ("<tool_call>nothing</tool_call>", []),
        ("", []),
    ],
)
def test_tool_calls(text, calls):
    assert [c[1:] for c in extraction.tool_calls(text)] == calls


def test_table_functions_in_sql(spark):
    extraction.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT name, repaired FROM tool_calls('<tool_call>{\"name\": \"a\", \"arguments\": {}')").collect()] == [("a", True)]
    assert spark.sql("SELECT object FROM last_object('{\"a\": 1} x {\"b\": {}} }')").first()[0] == '{"b": {}}'
    assert spark.sql("SELECT * FROM tool_calls(NULL)").count() == 0


def plain_limit(messages: list[tuple], soft: int, hard: int, tools: int):
    def count(rows):
        return len("".join(f"{r}: {c}\n" for r, c in rows if c)) // 4 + 4 * len(rows) + tools

    original = count(messages)
    kept, status = list(enumerate(messages)), "OK"
    if soft != -1 and original > soft:
        status = "PRUNED"
        while count([m for _, m in kept]) > soft:
            leads = [k for k, (i, (role, _)) in enumerate(kept) if i >= 2 and role == "assistant"]
            if not leads:
                break
            end = leads[1] if len(leads) > 1 else len(kept)
            del kept[leads[0] : end]
    rows = [m for _, m in kept]
    if hard != -1 and count(rows) > hard:
        status = "HARD_LIMIT_EXCEEDED"
        history, told = count(rows[:-1]), count([("user", context.NOTICE)])
        left = hard - history - told - 50
        role, said = rows[-1]
        said = said or ""
        body = "" if left <= 0 else said if history + count([rows[-1]]) + told <= hard else said[: int(left * 3.5)]
        rows[-1] = (role, body + context.NOTICE)
    return [(i, r, c, status, count(rows), original, len(messages) - len(rows)) for (i, _), (r, c) in zip(kept, rows, strict=True)]


@pytest.mark.parametrize(("soft", "hard", "tools"), [(60, 100, 0), (200, 150, 7), (-1, 90, 0), (40, -1, 3), (-1, -1, 0), (5, 5, 0)])
def test_context_limits_equal_a_plain_loop(spark, soft, hard, tools):
    rng = random.Random(soft)
    talks = [[(rng.choice(["user", "assistant", "system", "tool"]), rng.choice([None, "", "x" * rng.randint(1, 300), "words é " * rng.randint(1, 40)])) for _ in range(rng.randint(1, 12))] for _ in range(120)]
    rows = [(k, i, r, c, 5) for k, t in enumerate(talks) for i, (r, c) in enumerate(t)]
    df = spark.createDataFrame(rows, "conv long, pos long, role string, content string, tokens int").repartition(5)
    got = context.limit_context(df, "conv", "pos", "role", "content", soft, hard, tools)
    found = sorted((r["conv"], r["pos"], r["role"], r["content"] or "", r["status"], r["token_count"], r["original_count"], r["n_pruned"]) for r in got.collect())
    assert found == sorted((k, i, r, c or "", *rest) for k, t in enumerate(talks) for i, r, c, *rest in plain_limit(t, soft, hard, tools))
    assert got.columns[:5] == df.columns and context.limit_context(df.limit(0), "conv", "pos", "role", "content").count() == 0
