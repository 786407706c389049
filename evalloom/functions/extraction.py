"""Table functions over model outputs: JSON objects and tool calls in free text.

A scanner walks the braces once, knows strings and escapes, and says how many braces an unfinished object lacks.
Register with ``register(spark)`` for SQL, or join laterally: ``rows.lateralJoin(ToolCalls(F.col("text").outer()))``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TAG = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
_NAKED = re.compile(r'\{\s*"name":')
_PLAIN = re.compile(r"\[Tool Call\]:\s*([a-zA-Z0-9_]+)\((.*)\)", re.DOTALL)
# A string in either quotes, a bare word before a colon, a comma before a closing sign.
_LENIENT = re.compile(r"""("(?:[^"\\]|\\.)*")|'((?:[^'\\]|\\.)*)'|([A-Za-z_$][\w$]*)(?=\s*:)|(,)(?=\s*[}\]])""", re.DOTALL)


def object_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """``start, end, lacking`` of the outermost brace-delimited runs; the last one may lack closing braces.

    Quotes count within braces only. A quote that is never closed would hide all braces behind it, so such a run is
    walked again without strings.
    """
    at = text.find("{")
    while at >= 0:
        end, depth = _walk(text, at, strings=True)
        if depth < 0:
            end, depth = _walk(text, at, strings=False)
        yield at, end, depth
        at = text.find("{", end)


def _walk(text: str, at: int, strings: bool) -> tuple[int, int]:
    """End of the run that starts at ``at`` and the braces it lacks; -1 where the text ends within a string."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = strings
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1, 0
    return len(text), -1 if quoted else depth


def lenient(text: str):
    """The JSON value of a text that may have single quotes, bare keys and trailing commas; ValueError where there is none."""
    try:
        return json.loads(text, strict=False)
    except ValueError:

        def mended(m: re.Match) -> str:
            double, single, word, _ = m.groups()
            if double is not None:
                return double
            if single is not None:
                return '"' + single.replace("\\'", "'").replace('"', '\\"') + '"'
            return f'"{word}"' if word is not None else ""

        return json.loads(_LENIENT.sub(mended, text), strict=False)


def unthought(text: str) -> str:
    """Without ``<think>`` blocks; an unclosed one runs to the end."""
    return re.sub(r"<think>.*", "", re.sub(r"<think>.*?</think>", "", text, flags=re.DOTALL), flags=re.DOTALL).strip()


def _candidates(text: str) -> list[str]:
    """Texts that may hold a call: tagged, half tagged, or naked objects that begin with a name."""
    if found := _TAG.findall(text):
        return found
    if "<tool_call>" in text:
        return [text.split("<tool_call>", 1)[1]]
    if "</tool_call>" in text and "{" in (head := text.rsplit("</tool_call>", 1)[0]):
        return [head[head.index("{") :]]
    return [text[m.start() :] for m in _NAKED.finditer(text)]


def tool_calls(text: str | None) -> Iterator[tuple[int, str, str, bool]]:
    """``position, name, arguments, repaired`` of the calls in a text; arguments as JSON with sorted keys.

    A whole object needs a name. One that lacks closing braces is repaired only if that gives a name and an object of
    arguments: nothing is invented. Where no call is tagged or naked, ``[Tool Call]: name(json)`` counts, with empty arguments if they
    can't be read.
    """
    calls: list[tuple[dict, bool]] = []
    candidates = _candidates(text or "")
    for raw in candidates:
        body = unthought(raw)
        span = next(object_spans(body), None)
        if span:
            start, end, lacking = span
            try:
                value = lenient(body[start:end] + "}" * max(lacking, 0))
            except ValueError:
                value = None
            if isinstance(value, dict) and (isinstance(value.get("name"), str) and isinstance(value.get("arguments"), dict) if lacking else "name" in value):
                calls.append((value, lacking > 0))
                continue
        try:
            value = lenient(body)
        except ValueError:
            continue
        calls += [(v, False) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict) and "name" in v]
    if not candidates and (m := _PLAIN.search(text or "")):
        try:
            arguments = lenient(m.group(2).strip() or "{}")
        except ValueError:
            arguments = {}
        calls.append(({"name": m.group(1), "arguments": arguments}, False))
    for k, (call, repaired) in enumerate(calls):
        arguments = call.get("arguments")
        yield k, str(call["name"]), None if arguments is None else json.dumps(arguments, sort_keys=True, ensure_ascii=False), repaired


def last_object(text: str | None) -> str | None:
    """The last whole object of an answer, after thoughts, ``<answer>`` tags and code fences are taken off; null without one."""
    body = unthought(text or "")
    if "<answer>" in body:
        body = body.split("<answer>")[1].split("</answer>")[0]
    fence = "```json" if "```json" in body else "```"
    if fence in body:
        body = body.split(fence)[1].split("```")[0]
    whole = [body[a:b] for a, b, lacking in object_spans(body) if not lacking]
    return whole[-1] if whole else None


@udtf(returnType="position int, name string, arguments string, repaired boolean", useArrow=True)
class ToolCalls:
    """``tool_calls`` of a text as rows; none for null."""

    def eval(self, text: str):
        yield from tool_calls(text)


@udtf(returnType="position int, start int, object string, lacking int", useArrow=True)
class JsonObjects:
    """The outermost objects of a text as rows, completed where braces lack."""

    def eval(self, text: str):
        for k, (start, end, lacking) in enumerate(object_spans(text or "")):
            yield k, start, text[start:end] + "}" * max(lacking, 0), lacking


@udtf(returnType="object string", useArrow=True)
class LastObject:
    """``last_object`` of a text as a row; none where there is none."""

    def eval(self, text: str):
        found = last_object(text)
        if found is not None:
            yield (found,)


def register(spark: SparkSession) -> None:
    """``tool_calls(text)``, ``json_objects(text)`` and ``last_object(text)`` as table functions of SQL."""
    for name, function in (("tool_calls", ToolCalls), ("json_objects", JsonObjects), ("last_object", LastObject)):
        spark.udtf.register(name, function)
