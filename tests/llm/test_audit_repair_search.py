"""Operators 11 to 13 against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import conversation_repair, exact_search, source_divergence
from evalloom.llm.conversation_repair import repair
from evalloom.llm.exact_search import Tree, top_products
from evalloom.llm.source_divergence import divergence, shares

# -- 11 --


def plain_divergence(rows: list[tuple], least: int = 3, ranks: int = 200) -> set[tuple]:
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = term.findall(text.translate(lower))
        langs[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [w for w, c in docs[lang].items() if c >= least]
        all_n = {w: sum(counts[lang, s][w] for s in sources) for w in kept}

        def share(n: dict, kept=kept) -> dict:
            total = sum(n[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (n[w] + 1) // total for w in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(all_n)
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return Counter(out)


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    rng = random.Random(11)
    words = [w + v for w in "an bé co ΔX Zz ü 漢 ab".split() for v in ("", "a", "b", "ab", "É")]
    rows = []
    for k in range(160):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", "sé", "", None])
        rows.append((rng.choice([" ", ", ", "\n", "-7_"]).join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 60))), lang, source))
    rows += [(None, "en", "none"), ("", "en", "blank"), ("12 _ \x00", "en", "blank"), ("rare words only", "xx", "a"), (None, "xx", "b"), ("alone alone", "yy", "a")]
    rows += [rows[3]] * 4 + [("long " * 30_000 + "tail", "de", "s1")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 2, "CHUNK": 3, "RANGE": 2, "HELD": 20, "ENTRIES": 5}])
def test_divergence(spark, texts, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(source_divergence, name, value)
    # columns that clash with the operator's own
    df = spark.createDataFrame([(*r, 1, "x") for r in texts], "text string, lang string, source string, term int, chunk string").repartition(5)
    got = Counter(tuple(r) for r in divergence(df, ranks=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(texts, ranks=7)
    assert ("xx", "a", "pair", "b", 0, 1) in got and not any(k[0] == "yy" for k in got)
    assert divergence(df.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(500):
        total = rng.randint(1, 10 ** rng.randint(1, 15))
        n = rng.randint(0, total - 1)
        assert shares(np.array([n]), total)[0] == 1 + 10**9 * (n + 1) // total


# -- 12 --

SPACE = "\x20\t\n\v\f\r"


def plain_damage(rows: list[tuple]) -> dict:
    """Damaged rows by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows_of = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows_of += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_faults(rows: list[tuple]) -> list[str | None]:
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], faults: list[str | None]) -> tuple[int, str, str]:
    """Least (cost, audit) over all edits whose roles fit the pattern, by growing sets of ways; and the repaired text."""
    fits = re.compile("(s?(ua)+)?")
    state_of = {"": "", "s": "s", "u": "u", "su": "u", "ua": "a", "sua": "a"}
    # ways: what the roles so far amount to -> best (cost, audit, lines)
    ways = {"": (0, "", ())}

    def put(into: dict, roles: str, way: tuple) -> None:
        state = state_of[roles] if roles in state_of else None
        if state is None:
            return
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def follow(state: str, initial: str) -> str:
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        return {"s": "s", "u": "u", "a": "ua"}[initial] if initial and initial in allowed else "x"

    def inserted(ways: dict) -> dict:
        for _ in range(4):
            new = dict(ways)
            for state, (cost, audit, lines) in ways.items():
                for role in ("user", "assistant"):
                    put(new, follow(state, role[0]), (cost + 2, audit + "I", (*lines, f"{role}:")))
            ways = new
        return ways

    ways = inserted(ways)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in ways.items():
            if state not in new or (cost + 3, audit + "D") < new[state][:2]:
                new[state] = (cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            charge = fault == "truncated"
            put(new, follow(state, role[:1]), (cost + charge, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                put(new, follow(state, other[0]), (cost + 2 + charge, audit + "R", (*lines, f"{other}:{text}")))
        ways = inserted(new)
    cost, audit, lines = min((w for s, w in ways.items() if s in ("", "a")), key=lambda w: w[:2])
    assert fits.fullmatch("".join(x[0] for x in lines))
    return cost, audit, "\n".join(lines)


def plain_repair(rows: list[tuple]) -> dict:
    out = {}
    for conv, kept in plain_damage(rows).items():
        faults = plain_faults(kept)
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, text = cheapest(kept, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talks() -> list[tuple]:
    rng = random.Random(12)
    rows = []
    for conv in range(150):
        roles = rng.choice([["user", "assistant"], ["user", "assistant"], ["assistant"], ["tool", "user"], ["system", "user", "assistant", ""]])
        turn = 0
        for k in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = "system" if k == 0 and rng.random() < 0.3 else roles[k % len(roles)] if rng.random() < 0.8 else rng.choice(["user", "assistant", "tool", None, "Unknown"])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "No", "So what? \n", "é!", " ", None, "", f"Text {rng.randint(0, 3)}.", "a b\n\x0b"])))
            turn += rng.choice([1, 1, 1, 2, 0])
    rows += [(900, None, None, None), (None, 1, "user", "x."), (None, None, "assistant", "y"), (901, 5, "user", "long " * 50_000 + "end.")]
    rows += [(902, t, "user" if t % 2 == 0 else "assistant", f"{t} is said.") for t in range(700)]
    return rows + rows[:20]


@pytest.mark.parametrize("segment", [256, 3])
def test_repair(spark, talks, segment):
    df = spark.createDataFrame([(*r, 7, "a") for r in talks], "conv_id long, turn long, role string, text string, cost int, nth string").repartition(5)
    expected = plain_repair(talks)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(df, segment).collect()}
    assert got == expected
    assert repair(df.limit(0)).count() == 0


def test_segments_give_the_same_paths(talks):
    by_conv = defaultdict(list)
    for row in plain_damage(talks).items():
        by_conv[row[0]] = row[1]
    for segment in (1, 2, 5, 1000):
        for rows in by_conv.values():
            held = conversation_repair.Conversation(segment)
            faults = plain_faults(rows)
            for (turn, role, text), fault in zip(rows, faults, strict=True):
                held.add(turn, role, text, fault)
            cost, audit, text = cheapest(rows, faults)
            assert held.result()[-3:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_dropped_conversation(spark):
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair(spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- 13 --


def plain_products(rows: list[tuple], k: int = 5) -> list[tuple]:
    good = [(i, np.floor(np.array(v, dtype=np.float64) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(good):
        if i % 50 == 0:
            found = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, x, strict=True))), j) for to, (j, x) in enumerate(good) if to != at and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors() -> list[tuple]:
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((6, 8))
    rows = [(k, [float(x) for x in centres[k % 6] + 0.2 * rng.standard_normal(8)]) for k in range(600)]
    rows += [(k, [0.5] * 8) for k in range(600, 900)]  # copies: ties by the hundred
    rows += [(1000, None), (1050, []), (1051, []), (1100, [0.0] * 8), (1150, [float("nan")] * 8), (1200, [None, *[1.0] * 7]), (1250, [float("inf")] * 8), (-50, [-0.3] * 8), (1300, [1.0, 2.0]), (1301, [3.0, -1.0]), (None, [9.0] * 8), (1350, [7.5])]
    return [*rows, rows[50], rows[51]]


@pytest.mark.parametrize("sizes", [{}, {"tree_rows": 50, "QUERIES": 7, "PIVOTS": 3}])
def test_top_products(spark, vectors, monkeypatch, sizes):
    sizes = dict(sizes)
    options = {k: sizes.pop(k) for k in list(sizes) if k == "tree_rows"}
    for name, value in sizes.items():
        monkeypatch.setattr(exact_search, name, value)
    df = spark.createDataFrame([(*r, 1, "c") for r in vectors], "vec_id long, embedding array<double>, row int, cluster string").repartition(3)
    got = sorted(tuple(r) for r in top_products(df, **options).collect())
    assert got == plain_products(vectors)
    assert top_products(df.limit(0)).count() == 0


def test_tree_prunes_and_large_products_are_exact():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(np.eye(16), 200, axis=0) * 2 + 0.05 * rng.standard_normal((3200, 16))))
    ids = np.arange(3200)
    tree = Tree.load(ids, ids, x)
    rows = np.array([5, 777, 3000, 3001])
    found, computed = tree.search(x[rows], rows, 5)
    for row, best in zip(rows, found, strict=True):
        expected = sorted(((int(s), -int(i)) for i, s in enumerate(x @ x[row]) if i != row), reverse=True)[:5]
        assert sorted(best, reverse=True) == expected
        (floored,), _ = tree.search(x[[row]], np.array([row]), 5, [expected[2]])
        assert sorted(floored, reverse=True) == expected[:2]
    assert computed < 4 * 1000
    huge = np.array([[2.0**30 + 1, 1], [2.0**30, 3]])
    assert exact_search.dots(huge, huge[:1].T)[:, 0].tolist() == [(2**30 + 1) ** 2 + 1, (2**30 + 1) * 2**30 + 3]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_exact_search"])
def test_queries_agree_with_sql(spark, name):
    import compare

    from evalloom.llm import queries

    assert not compare.difference(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001")


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    from evalloom.llm import queries

    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.01").collect()} == plain_repair(rows)


def test_products_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = top_products(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("page", F.lit(0)), tree_rows=40)
    assert sorted(tuple(r) for r in got.collect()) == plain_products(rows)
