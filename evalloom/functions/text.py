"""Text, JSON and clock expressions over model outputs and logs. All are null for null input unless stated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_null(c: Column) -> Column:
    """``regexp_extract`` gives '' where nothing matches; null here."""
    return F.nullif(c, F.lit(""))


def numbered_answers(text: Column, most: int = 5, number: str = r"(?:\d+|[iv]+)") -> Column:
    """Bodies after ``Answer i:`` (digits or small roman numerals) up to the next one, trimmed, the first ``most``."""
    head = rf"Answer {number}:"
    found = F.regexp_extract_all(text, F.lit(rf"(?s){head}\s*(.+?)(?={head}|\z)"), F.lit(1))
    return F.slice(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), 1, most)


def question_triple(text: Column) -> Column:
    """struct(questions, correct, wrong): the lines after ``Question 1-3:`` and ``Correct answer:``, and those after ``Wrong answer 1-3:`` in threes."""
    wrong = F.regexp_extract_all(text, F.lit(r"(?d)Wrong answer [1-3]: (.*)"), F.lit(1))
    starts = F.when(F.size(wrong) > 0, F.sequence(F.lit(1), F.size(wrong), F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.struct(
        F.regexp_extract_all(text, F.lit(r"(?d)Question [1-3]: (.*)"), F.lit(1)).alias("questions"),
        F.regexp_extract_all(text, F.lit(r"(?d)Correct answer: (.*)"), F.lit(1)).alias("correct"),
        F.transform(starts, lambda i: F.slice(wrong, i, 3)).alias("wrong"),
    )


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def decision(text: Column) -> Column:
    """struct(yes, explanation): whether the line after ``Decision:`` is yes, in any case, and what follows the last ``Explanation:``.

    Without a decision: false and an empty explanation; without an explanation: the whole text.
    """
    said = text.rlike("Decision:")
    word = _trimmed(F.regexp_extract(text, r"(?d)Decision:(.*)", 1))
    return F.struct((said & (F.lower(word) == "yes")).alias("yes"), F.when(said, _trimmed(F.substring_index(text, "Explanation:", -1))).otherwise("").alias("explanation"))


def revised_question(text: Column) -> Column:
    """The line after the first ``Revised question:``; null without one."""
    return or_null(_trimmed(F.regexp_extract(text, r"(?d)Revised question:\s*(.+)", 1)))


#: The parts of a response body that hold text.
RESPONSE = "output_text string, output array<struct<content:array<struct<text:string>>,message:struct<content:string>>>"


def response_text(body: Column) -> Column:
    """Text of a response body in JSON: ``output_text`` if it isn't blank, else the texts of all content blocks, joined; empty without any."""
    b = F.from_json(body, RESPONSE)
    blocks = "array<struct<text:string>>"

    def texts(c: Column) -> Column:
        return F.filter(F.transform(F.coalesce(c, F.array().cast(blocks)), lambda x: x["text"]), lambda t: t.isNotNull())

    def of_message(c: Column) -> Column:
        listed = F.from_json(c, blocks)
        return F.when(c.startswith("["), texts(listed)).when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.transform(b["output"], lambda x: F.concat(texts(x["content"]), of_message(x["message"]["content"]))))
    whole = _trimmed(b["output_text"])
    return F.when(F.length(whole) > 0, whole).otherwise(F.coalesce(_trimmed(F.array_join(parts, "")), F.lit("")))


def result_ids(response: Column) -> Column:
    """Ids of a tool's JSON list of results: ``doc_id``, else ``clip_id``; results without either are left out."""
    rows = F.from_json(response, "array<struct<doc_id:string,clip_id:string>>")
    return F.filter(F.transform(rows, lambda x: F.coalesce(x["doc_id"], x["clip_id"])), lambda x: x.isNotNull())


def option_logprobs(positions: Column, options: Column) -> Column:
    """Log-probabilities by option (a map) at the first position that holds an option; null where none does.

    ``positions``: an array, by place of the token, of arrays of struct(token, logprob). Tokens are trimmed, so a bare and a
    spaced token are one option: the first counts.
    """

    def held(alternatives: Column) -> Column:
        named = F.transform(F.coalesce(alternatives, F.array().cast("array<struct<token:string,logprob:double>>")), lambda x: F.struct(_trimmed(x["token"]).alias("o"), x["logprob"].cast("double").alias("p")))
        return F.filter(named, lambda x: F.array_contains(options, x["o"]))

    def as_map(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda x: x["o"]))
        return F.map_from_arrays(names, F.transform(names, lambda o: F.filter(found, lambda x: x["o"] == o)[0]["p"]))

    hit = F.try_element_at(F.filter(positions, lambda p: F.size(held(p)) > 0), F.lit(1))
    return F.when(hit.isNotNull(), as_map(held(hit)))


def option_logits(logits: Column, options: Column) -> Column:
    """By option the larger of the logits of its bare and its spaced token; ``logits`` maps tokens to numbers."""
    return F.map_from_arrays(options, F.transform(options, lambda o: F.greatest(F.try_element_at(logits, o), F.try_element_at(logits, F.concat(F.lit(" "), o)))))


def option_letter(text: Column, last: bool = False, letters: str = "A-E") -> Column:
    """First (or last) free-standing option letter."""
    found = F.regexp_extract_all(text, F.lit(rf"\b([{letters}])\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1))


def options_in(text: Column, letters: str = "A-E") -> Column:
    """Sorted distinct free-standing letters before a colon, in any case."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(rf"\b([{letters}])\s*:"), F.lit(1))))


def question_type(entry_id: Column) -> Column:
    return or_null(F.regexp_extract(entry_id, r"^(Q\d+)", 1))


def strip_suffix(c: Column, suffixes: Sequence[str]) -> Column:
    """Without the longest of the suffixes that it ends with."""
    ordered = "|".join(sorted((s.replace(".", r"\.") for s in suffixes), key=len, reverse=True))
    return F.regexp_replace(c, f"(?:{ordered})$", "")


def answer_body(text: Column) -> Column:
    return or_null(F.trim(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)))


def without_thinking(text: Column) -> Column:
    """What stands after the first ``</think>``; all of it where there is none."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, F.trim(F.substring(text, at + len("</think>"), F.length(text)))).otherwise(text)


#: Fixed value: what a model says that gives up.
NOT_FOUND = "I cannot find the answer in the provided documents or videos."


def is_final(text: Column, phrase: str = NOT_FOUND) -> Column:
    return F.contains(text, F.lit("<answer>")) | F.contains(text, F.lit(phrase))


def verdict(content: Column) -> Column:
    """``Right`` or ``Wrong``: exactly so in a JSON object, else the first word without outer signs, in any case; else null."""
    strict = F.get_json_object(content, "$.verdict")
    word = F.lower(F.regexp_extract(content, r"^\s*[.,:;\"'`]*([^\s]*?)[.,:;\"'`]*(?:\s|$)", 1))
    return F.when(strict.isin("Right", "Wrong"), strict).when(word == "right", "Right").when(word == "wrong", "Wrong")


def score_ratio(text: Column, good: str = "Supported", bad: str = "Contradicted") -> Column:
    """``Overall Score: X/Y`` as struct(got, total); else counts of the two marks after a long dash, in any case; both null without any."""
    x = or_null(F.regexp_extract(text, r"Overall Score:\s*(\d+)\s*/\s*(\d+)", 1)).cast("int")
    y = or_null(F.regexp_extract(text, r"Overall Score:\s*(\d+)\s*/\s*(\d+)", 2)).cast("int")
    n_good = F.regexp_count(text, F.lit(rf"(?i)\u2014\s*\*{{0,2}}{good}"))
    n_bad = F.regexp_count(text, F.lit(rf"(?i)\u2014\s*\*{{0,2}}{bad}"))
    some = n_good + n_bad > 0
    return F.struct(F.coalesce(x, F.when(some, n_good)).alias("got"), F.coalesce(y, F.when(some, n_good + n_bad)).alias("total"))


def json_field(text: Column, key: str) -> Column:
    """A key of a JSON object in free text: the whole text, else its outermost braces, else a pattern."""
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    pattern = or_null(F.regexp_extract(text, rf'"{key}"\s*:\s*"?([^",}}\s]+)', 1))
    return F.coalesce(F.get_json_object(text, f"$.{key}"), F.get_json_object(braces, f"$.{key}"), pattern)


def judge_key(question_id: Column, gold: Column, predicted: Column) -> Column:
    """Cache key; missing parts print as ``None``."""
    none = F.lit("None")
    return F.sha2(F.concat(F.coalesce(question_id, none), F.lit("|||"), F.coalesce(gold, none), F.lit("|||"), F.coalesce(predicted, none)), 256)


def clock_seconds(text: Column) -> Column:
    """Seconds of the first two parts of ``MM:SS``, any further parts ignored; -1 where they are no numbers, null included."""
    parts = F.split(text, ":")
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    first, second = (F.when(p.rlike(number), F.trim(p).try_cast("double")) for p in (F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))))
    return F.coalesce(first * 60 + second, F.lit(-1.0))


def season_year(code: Column) -> Column:
    """``21-22`` as 2022; a plain year as it is."""
    end = or_null(F.regexp_extract(code, r"^\d+-(\d+)$", 1)).cast("int")
    return F.coalesce(F.when(end < 100, 2000 + end).otherwise(end), code.try_cast("int"))


def remaining_clock(period: Column, elapsed: Column, length: Column) -> Column:
    """``[Qp m:ss]`` of the time left in a period, not below 0."""
    left = F.greatest(F.lit(0), (length - elapsed).cast("int"))
    return F.format_string("[Q%d %d:%02d]", period.cast("int"), F.floor(left / 60).cast("int"), (left % 60).cast("int"))


def transcript_line(line: Column) -> Column:
    """struct(start, end, caption) of ``[1.0s -> 2.5s] words``: whole seconds, and ``[1-2] words``; nulls for other lines."""
    pattern = r"\[(.*)\..*s -> (.*)\..*s\](.*)"
    start, end = (F.trim(F.regexp_extract(line, pattern, k)).try_cast("int") for k in (1, 2))
    words = F.trim(F.regexp_extract(line, pattern, 3))
    return F.struct(start.alias("start"), end.alias("end"), F.concat(F.lit("["), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("] "), words).alias("caption"))


def names_before_colon(text: Column) -> Column:
    """Distinct names before the first colon of the lines that have one, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[^:#]+:"))
    return F.array_distinct(F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1))))


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The value under the lower-cased key, else the input; one map lookup."""
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c))), c)


def fill_placeholders(text: Column, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by the column, where it isn't null."""
    for name, value in values.items():
        text = F.when(value.isNotNull(), F.replace(text, F.lit("{" + name + "}"), value.cast("string"))).otherwise(text)
    return text


def bucket_path(number: Column, size: int, suffix: str = "") -> Column:
    """``bb/number``: the bucket ``number // size``, zero-padded to two digits or more."""
    return F.concat(F.format_string("%02d/", F.floor(number / size).cast("long")), number.cast("string"), F.lit(suffix))


def swap_first(path: Column, old: str, new: str) -> Column:
    """The first occurrence only."""
    at = F.instr(path, old)
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(new), F.substring(path, at + len(old), F.length(path)))).otherwise(path)


def caption_normal(text: Column, most_words: int | None = None) -> Column:
    """Lower case, signs dropped, dashes and slashes to blanks, single blanks; optionally the first words only."""
    out = F.translate(F.lower(text), ",.'!?\"()*#:;~", "")
    out = F.replace(F.regexp_replace(out, "[-/]", " "), F.lit("<person>"), F.lit("person"))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"\n+$", ""))
    return out if most_words is None else F.array_join(F.slice(F.split(out, " "), 1, most_words), " ")


def rough_tokens(text: Column) -> Column:
    """A quarter of the length, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")
