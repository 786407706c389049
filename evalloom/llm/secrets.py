"""Operator 4: secret scan by patterns and by an inferred grammar of credential formats.

The base patterns find assignments, access keys and hex strings. Their matches in a bounded sample of documents
(``max_docs``, a parameter: those with the smallest hash of doc_id among the documents with a match) are the labelled
credentials. Their prefix tree over character classes is made a probabilistic automaton by merging states whose
continuations are statistically compatible (Hoeffding bound, tried in the order of the tree). Every run of 16 or more
credential characters in any text is then scored: it is reported (kind ``format``) if the automaton finds it about as
likely, for each character, as the labelled credentials, and likelier than a character-pair model of the other runs in
the sample does. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_batches, texts

# The base patterns, their kinds in order, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")}
_TABLE = {ord(c): k for c, k in _CLASSES.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class State:
    ends: int = 0
    seen: int = 0
    to: dict[str, int] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)


class Automaton:
    """Probabilistic deterministic automaton inferred from strings of classes."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = [State()]
        for s in sorted(strings):
            at = 0
            for c in s:
                node = self.states[at]
                node.seen += 1
                node.count[c] = node.count.get(c, 0) + 1
                if c not in node.to:
                    node.to[c] = len(self.states)
                    self.states.append(State())
                at = node.to[c]
            self.states[at].seen += 1
            self.states[at].ends += 1
        self.infer()

    def differ(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > (1 / math.sqrt(n) + 1 / math.sqrt(m)) * self.bound

    def compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            p, q = (self.states[k] for k in todo.pop())
            if self.differ(p.ends, p.seen, q.ends, q.seen):
                return False
            for c in {*p.to, *q.to}:
                if self.differ(p.count.get(c, 0), p.seen, q.count.get(c, 0), q.seen):
                    return False
            todo += [(p.to[c], q.to[c]) for c in q.to if c in p.to]
        return True

    def fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            k, j = todo.pop()
            p, q = self.states[k], self.states[j]
            p.ends, p.seen = p.ends + q.ends, p.seen + q.seen
            for c, n in q.count.items():
                p.count[c] = p.count.get(c, 0) + n
                if c in p.to:
                    todo.append((p.to[c], q.to[c]))
                else:
                    p.to[c] = q.to[c]

    def infer(self) -> None:
        red, kept = [0], {0}
        while True:
            # the first state below the kept ones, in their order (folding may give kept states new ones)
            edge = next(((r, c) for r in red for c in sorted(self.states[r].to) if self.states[r].to[c] not in kept), None)
            if edge is None:
                break
            above, c = edge
            blue = self.states[above].to[c]
            for r in red:
                if self.compatible(r, blue):
                    self.states[above].to[c] = r
                    self.fold(r, blue)
                    break
            else:
                red.append(blue)
                kept.add(blue)
        number = {r: i for i, r in enumerate(red)}
        self.states = [State(s.ends, s.seen, {c: number[t] for c, t in s.to.items()}, s.count) for s in (self.states[r] for r in red)]

    def likelihood(self, s: str) -> float:
        """Log likelihood of the string; unseen steps count as half an occurrence and stay in the state."""
        at, out = 0, 0.0
        for c in s:
            state = self.states[at]
            out += math.log((state.count.get(c, 0) + (0 if c in state.to else 0.5)) / (state.seen + 6))
            at = state.to.get(c, at)
        return out + math.log((self.states[at].ends + 0.5) / (self.states[at].seen + 6))


class Pairs:
    """Character-pair model of the runs that are no credentials."""

    def __init__(self, strings: list[str]):
        self.count: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for s in strings:
            for a, b in zip("^" + s, s + "$", strict=True):
                self.count[a][b] += 1
        self.count = {a: dict(x) for a, x in self.count.items()}
        self.total = {a: sum(x.values()) for a, x in self.count.items()}

    def likelihood(self, s: str) -> float:
        return sum(math.log((self.count.get(a, {}).get(b, 0) + 0.5) / (self.total.get(a, 0) + 6)) for a, b in zip("^" + s, s + "$", strict=True))


@dataclass
class Grammar:
    automaton: Automaton
    others: Pairs
    least: float

    @staticmethod
    def fit(good: list[str], other: list[str]) -> Grammar:
        """The automaton of four fifths of the credentials; the others set the least likelihood (a little under their 2 % quantile)."""
        held = good[4::5]
        automaton = Automaton([s for k, s in enumerate(good) if k % 5 != 4])
        scores = sorted(automaton.likelihood(s) / len(s) for s in held)
        return Grammar(automaton, Pairs(other), scores[len(scores) // 50] - 0.05)

    def accepts(self, run: str) -> bool:
        s = run.translate(_TABLE)
        score = self.automaton.likelihood(s)
        return score >= self.least * len(s) and score > self.others.likelihood(s) + 4.0


def runs_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential characters that no base span touches; both lists are walked once."""
    out, ordered, at, reached = [], sorted(spans), 0, 0
    for m in RUN.finditer(text):
        # the furthest end of the spans that start before the run ends
        while at < len(ordered) and ordered[at][0] < m.end():
            reached = max(reached, ordered[at][2])
            at += 1
        if reached <= m.start():
            out.append((m.start(), m.end()))
    return out


def infer_grammar(docs: DataFrame, max_docs: int = 2000, per_doc: int = 20, longest: int = 256, repeats: int = 50, least: int = 20) -> Grammar | None:
    """Grammar of the credentials in a bounded sample of labelled strings; None where there are fewer than ``least``.

    The bounds hold for the fit alone, scans cover whole texts: ``max_docs`` documents, of each ``per_doc`` credentials
    and as many other runs (those of the smallest checksum, wherever they stand), none longer than ``longest``
    characters, and a class string counts ``repeats`` times at most. Null and empty texts give no strings.
    """

    def some(strings: list[str]) -> list[str]:
        return sorted((v for v in strings if len(v) <= longest), key=lambda v: (zlib.crc32(v.encode()), v))[:per_doc]

    source = texts(docs)
    anything = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    chosen = source.where(F.col("text").rlike(anything)).groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id")

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, other = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            values = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] + [text[a:b] for a, k, b in spans if k]
            good += [v.translate(_TABLE) for v in some(values)]
            other += [v.translate(_TABLE) for v in some([text[a:b] for a, b in runs_outside(text, spans)])]
        rows = good + other
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([True] * len(good) + [False] * len(other), pa.bool_())], ["s", "good"])

    # at most max_docs ids
    rows = map_batches(source.join(F.broadcast(chosen), "doc_id"), label, "s string, good boolean").groupBy("s", "good").count().collect()
    good = [s for r in sorted(rows) if r["good"] for s in [r["s"]] * min(r["count"], repeats)]
    if len(good) < least:
        return None
    return Grammar.fit(good, [s for r in sorted(rows) if not r["good"] for s in [r["s"]] * min(r["count"], repeats)])


def scan_secrets(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` of each row of ``docs`` (``doc_id``, ``text``).

    Spans are kind:start:end in code points, end exclusive, by start and then kind, comma-joined; a text without any
    (null and empty texts too) has the empty string and its digest. Repeated rows give a row each, other columns are
    ignored, an empty table gives an empty one. Without a grammar there are base spans only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most 2 * max_docs * per_doc short strings' states

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = shared.value, []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text)
            more = [(a, 3, b) for a, b in runs_outside(text, base) if model.accepts(text[a:b])] if model else []
            name = [",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans) for spans in (base, sorted(base + more))]
            kinds = [k for _, k, _ in base]
            rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(name[0].encode()).hexdigest(), name[1], len(more)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return map_batches(texts(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def find_secrets(docs: DataFrame, max_docs: int = 2000) -> DataFrame:
    return scan_secrets(docs, infer_grammar(docs, max_docs))
