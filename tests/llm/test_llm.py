"""The training-data operators against brute force, on small fixtures with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm import embedding_dedup, near_dup, suffix_dedup
from evalloom.llm._graph import components
from evalloom.llm._words import Words
from evalloom.llm.decontamination import coverage, tiles
from evalloom.llm.licenses import license_matches
from evalloom.llm.line_dedup import drop_recurring_lines
from evalloom.llm.packing import pack
from evalloom.llm.queries import vocabulary_file
from evalloom.llm.secrets import Grammar, find_secrets, infer_grammar
from evalloom.llm.token_counts import token_counts, transducer
from evalloom.llm.toxicity import fit, keep_clean, score_toxicity

SYLLABLES = "an ti on er re th ed ou le la ñe éx ß".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(5)
    shared = sentence(rng, 60)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(30)]
    texts = [*base, *base[:6], *(t + " tail" for t in base[:8]), *(f"{sentence(rng, 20)} {shared} {sentence(rng, 20)}" for _ in range(6))]
    texts += [None, "", " \n\t", "x", "one two", "a" * 5000, "ab" * 400, "it's 'sabc <|endoftext|>DON'T! 123 ΑΣ", "é" * 300]
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, out[3], (None, "lost")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns that clash with the operators' own
    return spark.createDataFrame([(*r, 7, "b") for r in rows], "doc_id long, text string, component long, bucket string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(docs, empty, rows):
    tokenizer = transducer(vocabulary_file()) and __import__("tokenizers").Tokenizer.from_file(vocabulary_file())
    expected = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts(docs, vocabulary_file()).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts(empty, vocabulary_file()).count() == 0


def test_chunks_of_any_size_count_alike():
    from evalloom.llm._pretokens import PreTokens

    pre = PreTokens(["thanonontion " * 40 + "x" * 700, "ab cd"], vocabulary_file())
    t = transducer(vocabulary_file())
    sums = {int(t.deltas(pre.data, pre.last, chunk).sum()) for chunk in (1, 3, 64, 10_000)}
    assert len(sums) == 1


def removed(rows):
    seen: dict[bytes, int] = {}
    out = {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.setdefault(data[p : p + 100], i)
        out[i] = (len(data), sum(cover), sum(1 for x in bytes(cover).split(b"\0") if x), hashlib.sha256(bytes(c for c, m in zip(data, cover, strict=True) if not m)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup(docs, empty, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    expected = removed(rows)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_documents_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 500)
    text = sentence(random.Random(2), 500).encode()
    got = list(suffix_dedup.segments([1], [text]))
    starts = sorted(s + k for e, _ in got for s, n in zip(e["start"], e["n"], strict=True) for k in range(n))
    assert starts == list(range(len(text) - 99))


def test_levels_stay_few():
    levels, rng = suffix_dedup.Levels(), np.random.default_rng(0)
    for _ in range(64):
        e = np.zeros(10, dtype=suffix_dedup.ENTRY)
        e["key"] = e["content"] = np.sort(rng.integers(0, 2**60, 10).astype(np.uint64))
        levels.add(e)
    assert len(levels.levels) <= 7
    assert sum(map(len, levels.levels)) == 640


def unions(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("small", [1000, 2])
def test_embedding_dedup(spark, small, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    x[20:40] = x[0] + 0.2 * rng.standard_normal((20, 16))
    x[40:50] = x[1]
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    comp = unions(60, list(zip(*np.nonzero(near), strict=True)))
    bad = [(60, None), (61, []), (62, [0.0] * 16), (63, [None] + [1.0] * 15), (64, [float("nan")] * 16), (65, [float("inf")] * 16), (66, [1.0, 2.0])]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))] + bad + [(0, x[0].astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = embedding_dedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((int(near[k].sum()) - 1, comp[k]) if k < 60 else (0, k))
        assert r["kept"] == (r["component_id"] == k)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


BASE = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(40)]
    texts = [f'say token = "{h}" now' for h in hexes] + [None, "", "PassWord: abc", "password=abcdef api_key:'x.y+z/1'", "AKIA123", "AKIA" + "Z9" * 10, f"é {hexes[0]} {hexes[1]}", "ſecret=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    for r in find_secrets(df).collect():
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in BASE.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) or not base
    assert find_secrets(df.limit(0)).count() == 0
    assert infer_grammar(df.limit(3)) is None


def test_automaton_tells_formats_apart():
    rng = random.Random(4)
    good = ["".join(rng.choice("dh") for _ in range(40)) for _ in range(200)]
    g = Grammar.fit(good, ["l" * 20, "ldld" * 6])
    assert len(g.automaton.states) < 200 * 40 / 10
    fresh = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(50)]
    assert sum(map(g.accepts, fresh)) >= 40
    assert not g.accepts("thquickbrownfoxjumpsoverthelazyd")


def test_licenses(spark):
    filler = sentence(random.Random(8), 50)
    rows = [(0, f"{filler}\nReleased under the MIT License.\n{filler}"), (1, "ALL RIGHTS   RESERVED"), (2, filler), (3, None), (4, ""), (5, "Licensed under the Apache License"), (6, "all reserved rights"), (0, "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = {(r["doc_id"], r["license_id"]) for r in license_matches(df).collect()}
    assert got == {(0, "mit"), (0, "gpl-3.0"), (1, "all-rights-reserved")}
    assert license_matches(df.limit(0)).count() == 0
    assert license_matches(df, {}).count() == 0


def shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("whole", [1000, 2])
def test_near_duplicates(docs, empty, rows, whole, monkeypatch):
    monkeypatch.setattr(near_dup, "WHOLE", whole)
    known = {i: shingles(t, 3) for i, t in rows if i is not None}
    ids = sorted(known)
    links = [(a, b) for a in ids for b in ids if a < b and known[a] and 100 * len(known[a] & known[b]) >= 85 * len(known[a] | known[b])]
    comp = unions(len(ids), links)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(known[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(17)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (4, b), (8, c), (9, c), (9, d), (6, f"{d} z"), (7, f"{c} z"), (7, None), (None, d), (None, f"{a} w"), (5, sentence(rng, 60))]
    sets = [shingles(t, 3) for _, t in rows]
    nodes = range(len(rows))
    named = [i for i in nodes if rows[i][0] is not None]  # rows without an id link only with equal sets
    links = [(i, j) for i in nodes for j in range(i) if sets[i] and sets[i] == sets[j]]
    links += [(i, j) for i in named for j in named if rows[i][0] == rows[j][0] is not None and sets[i] and sets[j] or sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = unions(len(rows), links)
    least = {k: min((rows[i][0] for i in nodes if comp[i] == k and rows[i][0] is not None), default=None) for k in comp}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    expected = [(i, len(s), least[k]) for (i, _), s, k in zip(rows, sets, comp, strict=True)]
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, expected))


def test_pruning_keeps_similar_pairs():
    rule = near_dup.least_matches(0.85, 1e-4)
    assert all(m < 0.85 * n for n, m in rule)
    assert rule[-1][1] > 0.7 * rule[-1][0]


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 140)}}


def test_tiles_catch_reordered_passages():
    item = np.arange(30, dtype=np.uint64)
    doc = np.concatenate((np.arange(15, 30), [99], np.arange(15), [98])).astype(np.uint64)
    assert tiles(doc, item, np.arange(len(doc) - 4), 5) == 30
    assert tiles(np.arange(100, 140, dtype=np.uint64), item, np.arange(10), 5) == 0


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, sentence(rng, 30)) for k in range(5)] + [(9, None), (10, ""), (None, "x y z a b c"), (11, "too short")]
    filler = sentence(rng, 80)
    w = items[1][1].split()
    texts = [f"{filler} {items[0][1]} {filler}", " ".join(w[15:] + ["odd"] + w[:15]), filler, None, "", items[2][1].replace("t", "T"), " ".join(items[3][1].split()[:10])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("coverage", F.lit("mine"))
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in coverage(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0: (True, 0), 1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, 2), 6: (False, 3)}


def plain_tiles(doc: list, item: list, least: int) -> int:
    """Greedy string tiling as published: the longest matches of unmarked words, marked in order of place, until none is left."""
    taken_item, taken_doc, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        longest, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not taken_item[i + k] and not taken_doc[j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(i, j)]
                elif k == longest >= least:
                    found.append((i, j))
        if longest < least:
            return covered
        for i, j in found:
            if not any(taken_item[i : i + longest]) and not any(taken_doc[j : j + longest]):
                taken_item[i : i + longest] = taken_doc[j : j + longest] = [True] * longest
                covered += longest


def test_tiles_equal_plain_tiling():
    rng = random.Random(5)
    for _ in range(300):
        letters, least = rng.choice([2, 3, 6]), rng.choice([2, 3, 5])
        item = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        doc: list[int] = []
        while len(doc) < 40:
            at = rng.randrange(len(item))
            doc += item[at : at + rng.randrange(1, 14)] if rng.random() < 0.6 else [rng.randrange(letters + 2)]
        a, b = np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64)
        runs = Words.runs(a, least)[: max(0, len(a) - least + 1)]
        assert tiles(b, a, np.flatnonzero(np.isin(Words.runs(b, least), runs)), least) == plain_tiles(doc, item, least)


def test_tiles_of_one_repeated_word():
    doc, item = np.full(20_000, 7, dtype=np.uint64), np.full(5000, 7, dtype=np.uint64)
    assert tiles(doc, item, np.arange(len(doc) - 4), 5) == 5000


def test_decontamination_equals_plain_tiling(docs, empty, rows):
    items = docs.where("doc_id < 10").select(F.col("doc_id").alias("item_id"), "text")
    known = {i: t for i, t in rows if i is not None and i < 10}

    def tokens(text: str | None) -> list[str]:
        return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    clash = docs.withColumn("_words", F.lit(1)).withColumn("row", F.lit(2)).withColumn("hits", F.lit(3))
    got = coverage(clash, items)
    assert {"_words", "row", "hits"} <= set(got.columns)
    texts = dict(rows)
    for r in got.where("doc_id is not null").collect():
        shares = {i: plain_tiles(tokens(texts[r["doc_id"]]), tokens(t), 5) / len(tokens(t)) for i, t in known.items() if tokens(t)}
        best = max(shares.values())
        assert r["n_items"] == sum(s >= 0.8 for s in shares.values()) and r["contaminated"] == (r["n_items"] > 0)
        assert abs(r["coverage"] - best) < 1e-12
        assert r["item_id"] == (min(i for i, s in shares.items() if s == best) if best else None)
    assert coverage(empty, items).count() == 0
    assert coverage(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = sentence(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["blasted", "blastedly", "wretched"])
        rows.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic)))
    return spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    model = fit(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 402
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert keep_clean(docs, model).columns == docs.columns
    assert fit(docs, labels.limit(0)).bias == 0.0
    assert score_toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85, 0.95])
def test_bands_meet_pairs_at_the_threshold(threshold):
    bands, rows = near_dup.banding(threshold)
    assert bands * rows <= near_dup.SIGNATURE and (1 - threshold**rows) ** bands <= 5e-5


def test_large_buckets_lose_no_pair(spark):
    # All share one band; of each two neighbours the other values agree, no other band does.
    rng = np.random.default_rng(3)
    n, (bands, rows) = 40, near_dup.banding(0.85)
    sig = rng.integers(0, 1 << 16, (n, near_dup.SIGNATURE), dtype=np.uint16)
    sig[1::2] = sig[::2]
    sig[:, :rows] = 7
    for k in range(1, bands):
        sig[1::2, k * rows] += 1
    # Full sets: every other pair shares 92 of 108 shingles (over 0.85), the rest 91 of 109 (under it).
    sets = []
    for i in range(0, n, 2):
        both = 92 if i % 4 == 0 else 91
        a = np.arange(100, dtype=np.uint64) + np.uint64(1000 * i)
        sets += [a, np.concatenate((a[:both], np.arange(500, 600 - both, dtype=np.uint64) + np.uint64(1000 * i)))]
    data = [(1, 0, i, i, i % 4, sig[i].tobytes(), np.sort(sets[i]).tobytes()) for i in range(n)]
    cells = [(min(p, q) * 4 + max(p, q), *r[1:]) for r in data for p in [r[4]] for q in range(4)]
    df = spark.createDataFrame(cells, "key long, band int, id long, component long, part int, sig binary, x binary").repartition("key").sortWithinPartitions("key")
    got = sorted((r["a"], r["b"]) for r in df.mapInArrow(near_dup.across(85, 1e-4), "a long, b long").collect())
    assert got == [(i, i + 1) for i in range(0, n, 4)]


def test_line_dedup(spark, docs, empty):
    rng = random.Random(12)
    rows = [(k, "\n".join([sentence(rng, 12), f"posted on day {k} by user{k} here", sentence(rng, 12), "subscribe to our letter today", sentence(rng, 9)])) for k in range(12)]
    copies = [(100 + k, rows[0][1].replace("posted", "sent")) for k in range(20)]
    variable = [(200 + k, f"{sentence(rng, 10)}\nthank you very much dear {rng.choice(SYLLABLES)}{k * 'x'} for the visit\n{sentence(rng, 11)}") for k in range(9)]
    df = spark.createDataFrame([*rows, *copies, *variable, (300, None), (301, "")], "doc_id long, text string").withColumn("n_lines", F.lit("mine"))
    got = {r["doc_id"]: r for r in drop_recurring_lines(df).collect()}
    assert all(got[k]["n_dropped"] == 2 and got[k]["n_lines"] == 5 for k, _ in rows)
    assert got[0]["text"] == "\n".join(np.array(rows[0][1].split("\n"))[[0, 2, 4]])
    assert all(got[k]["n_dropped"] <= 1 for k, _ in copies)  # the letter's line only
    assert all(got[k]["n_dropped"] == 1 for k, _ in variable)
    assert (got[300]["text"], got[300]["n_lines"], got[301]["text"], got[301]["n_lines"]) == (None, 0, "", 1)
    assert drop_recurring_lines(empty).count() == 0
    clash = docs.withColumn("gone", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("row", F.lit(3)).withColumn("doc", F.lit(4))
    assert drop_recurring_lines(clash).columns == [*clash.columns, "n_lines", "n_dropped"]
    assert drop_recurring_lines(clash).where("gone = 1 and _row = 2 and row = 3 and doc = 4").count() == docs.count()


def test_line_dedup_in_skewed_input(spark):
    rng = random.Random(14)
    passage = sentence(rng, 12)
    base = [sentence(rng, 10) for _ in range(10)]

    def near(k: int) -> str:  # one line of ten is changed
        return "\n".join([*base[: k % 10], sentence(rng, 10), *base[k % 10 + 1 :], passage])

    hot = [(k, near(k)) for k in range(300)]
    others = [(1000 + k, f"{sentence(rng, 9)}\n{passage}\n{sentence(rng, 9)}") for k in range(12)]
    logs = [(2000 + k, "\n".join(f"worker {rng.random()} took job {rng.random()} from queue" for _ in range(100))) for k in range(20)]
    short = [(3000 + k, f"{sentence(rng, 5)}\nread more about our offers") for k in range(8)]
    got = {r["doc_id"]: r["n_dropped"] for r in drop_recurring_lines(spark.createDataFrame([*hot, *others, *logs, *short], "doc_id long, text string")).collect()}
    assert all(got[k] == 1 for k, _ in [*hot, *others, *short])  # the passage only: near copies keep what only they share
    assert all(got[k] == 100 for k, _ in logs)


def test_batches_without_tokens(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    tokenizer = __import__("tokenizers").Tokenizer.from_file(vocabulary_file())
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, vocabulary_file()).collect()} == want
    assert {r["doc_id"]: r["doc_tokens"] for r in pack(df, vocabulary_file()).collect()} == {i: n + 1 for i, n in want.items()}


def plain_line_dedup(rows: list[tuple[int, str | None]], least: int = 6, depth: int = 3, similarity: float = 0.7) -> dict:
    """(doc_id, text) -> numbers of the lines that go; all pairs are compared, every part of a leaf is a list."""
    docs = sorted({(i, t or "") for i, t in rows})
    cut_up = [[x.strip(" \t\r\f\x0b") for x in t.split("\n")] for _, t in docs]
    sets = [{x for x in t.split("\n") if x.strip(" \t\r\f\x0b")} for _, t in docs]
    root = list(range(len(docs)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if 2 * sum(map(len, sets[a] & sets[b])) > sum(map(len, sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k, own in enumerate(cut_up):
        for at, line in enumerate(own):
            tokens = ["<*>" if re.search("[0-9]", x) else x for x in line.split()]
            if any(x != "<*>" for x in tokens):
                groups[(len(tokens), *tokens[:depth])].append((find(k), (k, at), tokens))
    gone = set()

    def drop(some: list) -> bool:
        if len({f for f, _, _ in some}) < least:
            return False
        gone.update(place for _, place, _ in some)
        return True

    work = []
    for leaf in groups.values():
        same = defaultdict(list)
        for x in leaf:
            same[tuple(x[2])].append(x)
        work.append([x for some in same.values() if not drop(some) for x in some])
    while work:
        part = work.pop()
        if len({f for f, _, _ in part}) < least:
            continue
        counts = [Counter(column) for column in zip(*(x[2] for x in part))]
        pattern = [max((n, t) for t, n in c.items())[1] for c in counts]
        alike = [sum(a == b != "<*>" for a, b in zip(x[2], pattern)) >= math.ceil(len(pattern) * similarity) for x in part]
        if drop([x for x, yes in zip(part, alike) if yes]):
            part = [x for x, yes in zip(part, alike) if not yes]
        open_places = [(max(c.values()), -at) for at, c in enumerate(counts) if len(c) > 1]
        if open_places:
            split = defaultdict(list)
            for x in part:
                split[x[2][-max(open_places)[1]]].append(x)
            work.extend(split.values())
    return {doc: sorted(at for k, at in gone if k == i) for i, doc in enumerate(docs)}


def test_line_dedup_equals_the_plain_version(spark):
    rng = random.Random(21)
    names = [a + b for a in SYLLABLES[:6] for b in SYLLABLES[:6]]
    shared = [sentence(rng, 14) for _ in range(8)]
    kinds = [
        lambda k: f"open the door of {rng.choice(names)} before {rng.choice(names)} comes home tonight again dear",
        lambda k: f"open the door at {rng.choice(names)} only when nobody {rng.choice(names)} looks this way",
        lambda k: f"open the door {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)} {rng.choice(names)}",
        lambda k: f"page {k} of {rng.randrange(99)}",
        lambda k: rng.choice(["share this", "12 14", "back 9"]),
        lambda k: rng.choice(shared),
    ]
    rows = [(k, "\n".join([sentence(rng, 25), *[rng.choice(kinds)(k) for _ in range(rng.randrange(6))], sentence(rng, 25)])) for k in range(60)]
    for k in range(70, 80):  # copies with a word more, families of their own
        rows.append((k, rows[k % 3][1] + "\nadded"))
    long = sentence(rng, 218)  # ten documents, of whose text one line is 71 %
    few = [sentence(rng, 2) for _ in range(10 * 40)]
    rows += [(100 + k, "\n".join([long, *[x[:14] for x in few[40 * k : 40 * k + 40]]])) for k in range(10)]
    rows += [(200 + k, "\n".join([shared[0], shared[1], sentence(rng, 9), sentence(rng, 9)])) for k in range(12)]
    rows += [rows[5], (5, rows[6][1]), (300, None), (301, ""), (302, " \n\t\n"), (303, "\n".join(sentence(rng, 8) for _ in range(4000))), (304, "x" * 1_500_000)]
    want = plain_line_dedup(rows)
    assert not any(0 in want[(100 + k, rows[70 + k][1])] for k in range(10))
    got = drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("was", F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(rows)
    for r in got:
        gone = want[(r["doc_id"], r["was"])]
        assert r["n_dropped"] == len(gone)
        assert (r["text"] or "") == "\n".join(x for at, x in enumerate(r["was"].split("\n")) if at not in gone)
    by_text = {r["doc_id"]: r["text"] for r in got}
    assert not any("open the door of" in (t or "") or "open the door at" in (t or "") for k, t in by_text.items() if k < 60)
    assert any("12 14" in (t or "") for t in by_text.values()) and not any("share this" in (t or "").split("\n") for t in by_text.values())


@pytest.mark.parametrize("open_windows", [1, 8])
def test_packing(docs, empty, rows, open_windows):
    tokenizer = __import__("tokenizers").Tokenizer.from_file(vocabulary_file())
    got = pack(docs, vocabulary_file(), 64, open_windows, 4).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    pieces = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(own)
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for i, own in ids.items():
        assert sum(n for _, n in pieces[i]) == sum(map(len, own))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert 60 < at <= 64 or at & (at - 1) == 0
    assert pack(empty, vocabulary_file()).count() == 0


def test_pipeline(spark, docs, labelled, tmp_path):
    rng = random.Random(13)
    poison = sentence(rng, 40)
    _, labels = labelled
    train = labelled[0].select("doc_id", "text")
    more = [(1000, poison), (1001, sentence(rng, 90)), (1002, None), (1003, "")]
    copies = sentence(rng, 80)
    more += [(2000 + k, copies) for k in range(5)]
    whole = train.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, poison)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "packing"]
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert {1001, 1002, 1003, 2000} <= ids
    assert not ids & {1000, 2001, 2002, 2003, 2004}
    assert len([k for k in range(400) if k % 4 == 0 and k in ids]) < 10
    assert len([k for k in range(400) if k % 4 and k in ids]) > 285


def test_stages_take_odd_rows_and_empty_tables(spark, labelled, tmp_path):
    rng = random.Random(31)
    item, clean = sentence(rng, 40), sentence(rng, 60)
    rows = [(1, clean), (1, clean), (1, sentence(rng, 50)), (2, None), (3, ""), (4, "\n \n"), (5, sentence(rng, 30000)), (6, f"{sentence(rng, 20)} {item}"), (None, sentence(rng, 30)), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    for name in ("source", "row", "family", "component", "score", "kept", "gone", "contaminated"):
        odd = odd.withColumn(name, F.lit(name))
    odd = odd.withColumn("n_chars", F.length("text").cast("long"))
    labelled[1].write.parquet(str(tmp_path / "full" / "labels.parquet"))
    labelled[1].limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    items = spark.createDataFrame([(0, item), (1, None), (None, ""), (0, item)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "full" / "benchmark.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for tables in ("full", "none"):
            got = stage(spark, odd, str(tmp_path / tables))
            kept = sorted((r["doc_id"] or 0 for r in got.select("doc_id").collect()))
            if name == "packing":
                assert set(kept) == {0, 1, 2, 3, 4, 5, 6}
                continue
            assert got.columns == odd.columns
            gone = {6} if (name, tables) == ("decontamination", "full") else set()
            assert kept == sorted(i or 0 for i, _ in rows if i not in gone), (name, tables)
        nothing = stage(spark, odd.limit(0), str(tmp_path / "full"))
        assert nothing.count() == 0
        assert name == "packing" or nothing.columns == odd.columns


def test_sql_agrees(spark):
    import compare

    from evalloom.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert not compare.difference(spark, name, queries.queries()[name], sql, "/root/testdata/sf0.001")


def test_passes_follow_the_rows():
    assert [embedding_dedup.passes_for(n, 0.9, 32) for n in (0, 10, 100_000, 1_000_000, 10_000_000)] == [24, 24, 24, 36, 61]
    # isolated pairs just over the threshold among many vectors, by the passes' own keys and windows
    rng, n, pairs, dim = np.random.default_rng(0), 50_000, 200, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, r = x[:pairs], rng.standard_normal((pairs, dim))
    r -= (r * a).sum(1, keepdims=True) * a
    x[pairs : 2 * pairs] = 0.902 * a + np.sqrt(1 - 0.902**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    met = np.zeros(pairs, dtype=bool)
    for k in range(embedding_dedup.passes_for(n, 0.9, 32)):
        place = np.empty(n, dtype=np.int64)
        place[np.argsort((x @ embedding_dedup.planes(dim, k) > 0) @ (np.int64(1) << np.arange(embedding_dedup.BITS)), kind="stable")] = np.arange(n)
        met |= np.abs(place[:pairs] - place[pairs : 2 * pairs]) <= 32
    assert met.mean() >= 0.95


def test_vectors_that_repeat_an_id_count_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    for order in (rows, rows[::-1]):
        got = embedding_dedup.near_vectors(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_runs_outside_spans():
    from evalloom.llm.secrets import RUN, runs_outside

    rng = random.Random(9)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aB3_-/") for _ in range(rng.randint(1, 40))) for _ in range(12))
        spans = sorted((a, rng.randint(0, 2), a + rng.randint(1, 60)) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 6))))
        plain = [(m.start(), m.end()) for m in RUN.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]
        assert runs_outside(text, spans) == plain
