"""Operator 11: divergence between sources of a language, by two-dimensional tiling of group blocks.

Terms are counted by (lang, source) in the tasks that read the texts, with the number of documents that hold them. The kept
terms of a language are dealt to chunks by hash and numbered within them; a group's counts in a chunk are packed as numbers
and counts. Groups are dealt to blocks by hash; the packed vectors of a block go to the tile of each pair of blocks that it
is in, cut into ranges of chunks so that no tile grows with the vocabulary. A tile's task walks its chunks one after the
other and adds to the submatrix of its pairs, both ways. In a chunk only the terms that one of its groups holds are laid
out; all others have the same share in each pair, known from the totals, and are added by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions, slices

#: Groups of a block and terms of a chunk, about; chunks that a tile's task walks through at most.
BLOCK, CHUNK, RANGE = 8, 8192, 16
#: Terms that a counting task holds before it hands them on; entries that are packed at once.
HELD, ENTRIES = 1 << 19, 1 << 20
ONE = 1_000_000_000

_BLANK = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(ONE * (count + 1) / total)``, exact while ``total`` is under 9e15: long division, three digits a step."""
    out, rest = np.divmod(np.asarray(count, dtype=np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def share(count: Column, total: Column) -> Column:
    """As ``shares``, in decimals."""
    exact = (count + 1).cast("decimal(19,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.call_function("div", exact, total.cast("decimal(19,0)")) + 1


def gain(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: partial sums of occurrences and of documents that hold the term, null as empty."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    most = HELD

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n, d = zip(*terms.values(), strict=True)
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), names, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for whole in batches:
            for batch in slices(whole):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    here: dict[bytes, int] = {}
                    for term in text.encode().translate(_BLANK).split():
                        here[term] = here.get(term, 0) + 1
                    if not here:
                        continue
                    of = held.setdefault((lang, source), {})
                    size -= len(of)
                    for term, n in here.items():
                        if (sums := of.get(term)) is None:
                            of[term] = [n, 1]
                        else:
                            sums[0] += n
                            sums[1] += 1
                    size += len(of)
                    if size > most:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return rows.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """``lang, source, term, n, all_n, head``: counts of the terms in at least ``least`` documents of the language.

    ``all_n`` is the language's count, and one row a term and language is its ``head``.
    """
    counts = counted(docs).repartition(partitions(docs.sparkSession), "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("all_n"), F.sum("docs").over(of_term).alias("all_docs"), (F.min("source").over(of_term) == F.col("source")).alias("head"))
    return told.where(F.col("all_docs") >= least).drop("all_docs")


def pack_chunks(terms: DataFrame) -> DataFrame:
    """``lang, chunk, source, at, n``: numbers of terms in their chunk (4 bytes each) and counts (8 bytes each)."""
    most = ENTRIES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, term_of, number, size = None, None, -1, 0
        held: dict[str, tuple[list[int], list[int]]] = {}

        def out() -> pa.RecordBatch:
            at = [np.array(a, dtype="i4").tobytes() for a, _ in held.values()]
            n = [np.array(c, dtype="i8").tobytes() for _, c in held.values()]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(held)), pa.array([key[1]] * len(held), pa.int64()), pa.array(list(held)), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "chunk", "source", "at", "n"])

        for batch in batches:
            for lang, chunk, term, source, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "term", "source", "n")), strict=True):
                if (lang, chunk) != key or size >= most:
                    if held:
                        yield out()
                    if (lang, chunk) != key:
                        key, term_of, number = (lang, chunk), None, -1
                    held, size = {}, 0
                if term != term_of:
                    term_of, number = term, number + 1
                at, counts = held.setdefault(source, ([], []))
                at.append(number)
                counts.append(n)
                size += 1
        if held:
            yield out()

    ordered = terms.select("lang", "chunk", "term", "source", "n").repartition(partitions(terms.sparkSession), "lang", "chunk").sortWithinPartitions("lang", "chunk", "term", "source")
    return ordered.mapInArrow(work, "lang string, chunk long, source string, at binary, n binary")


class Tile:
    """The submatrix of the pairs of two blocks of groups (of one with itself, if ``same``)."""

    def __init__(self, lang: str, same: bool, first: bool, vocabulary: int):
        self.lang, self.same, self.vocabulary = lang, same, vocabulary
        self.first, self.names, self.totals, self.side, self.sums = first, [], [], [], None
        self.chunk, self.held = None, []

    def group(self, source: str, total: int, right: bool) -> None:
        self.names.append(source)
        self.totals.append(total + self.vocabulary)
        self.side.append(right)

    def _ready(self) -> None:
        if self.sums is not None:
            return
        right = np.array(self.side, dtype=bool)
        self.rows = np.arange(len(right)) if self.same else np.flatnonzero(~right)
        self.columns = self.rows if self.same else np.flatnonzero(right)
        self.number = {s: k for k, s in enumerate(self.names)}
        # share of a term that a group doesn't hold
        self.rest = np.array([int(shares(np.zeros(1), t)[0]) if self.vocabulary else 1 for t in self.totals], dtype=np.int64)
        p, q = self.rest[self.rows, None], self.rest[None, self.columns]
        self.none = (p - q) ** 2 // q, (p - q) ** 2 // p
        start = self.vocabulary if self.first else 0
        self.sums = self.none[0] * start, self.none[1] * start

    def add(self, chunk: int, source: str, at: bytes, n: bytes) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.held.append((source, at, n))

    def close(self) -> None:
        """Add the chunk that is held to the sums."""
        self._ready()
        if not self.held:
            return
        at = [np.frombuffer(a, "i4") for _, a, _ in self.held]
        terms = np.unique(np.concatenate(at))
        p = np.repeat(self.rest[:, None], len(terms), axis=1)
        for (source, _, n), a in zip(self.held, at, strict=True):
            k = self.number[source]
            p[k, np.searchsorted(terms, a)] = shares(np.frombuffer(n, "i8"), self.totals[k])
        q = p[self.columns]
        for i, r in enumerate(self.rows):
            square = (p[r] - q) ** 2
            self.sums[0][i] += (square // q).sum(1) - len(terms) * self.none[0][i]
            if not self.same:
                self.sums[1][i] += (square // p[r]).sum(1) - len(terms) * self.none[1][i]
        self.held = []

    def pairs(self) -> list[tuple[str, str, str, int]]:
        """``lang, source, item, part of the value``."""
        self.close()
        out = []
        for i, r in enumerate(self.rows.tolist()):
            for j, c in enumerate(self.columns.tolist()):
                if r != c:
                    out.append((self.lang, self.names[r], self.names[c], int(self.sums[0][i, j])))
                    if not self.same:
                        out.append((self.lang, self.names[c], self.names[r], int(self.sums[1][i, j])))
        return out


def divergence(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` of each (lang, source) group of ``docs`` (``lang, source, text``; others are ignored).

    Part ``pair`` has each other source of the language, ranked by the divergence from it over all kept terms; part ``term``
    the group's first ``ranks`` terms of a larger share than the language's. Null text, lang and source are empty. Each row
    is a document, repeated ones too; no doc_id is read. Groups without kept terms take part in the pairs with count 0; in a
    language without kept terms all pairs are 0. Ties go to the item that is less in UTF-8. A language of one source has no
    pairs. Texts are read whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    kept = cut(kept_terms(docs, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = cut(every.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "heads"]))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("vocabulary"), F.count(F.lit(1)).alias("groups"))
    langs = cut(langs.withColumn("blocks", F.ceil(F.col("groups") / BLOCK)).withColumn("chunks", F.greatest(F.ceil(F.col("vocabulary") / CHUNK), F.lit(1))))
    groups = cut(groups.drop("heads").join(langs.select("lang", "vocabulary", "blocks", "chunks", "lang_total"), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))

    chunked = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    packed = pack_chunks(chunked)
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("chunks") - 1) / RANGE)))
    heads = groups.withColumn("range", ranges).select("lang", "source", "block", "blocks", "range", "vocabulary", "total", F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("n"))
    vectors = packed.join(groups.select("lang", "source", "block", "blocks", "vocabulary", "total"), ["lang", "source"])
    rows = heads.unionByName(vectors.withColumn("range", F.floor(F.col("chunk") / RANGE)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    names = ("lang", "low", "high", "range", "chunk", "source", "block", "vocabulary", "total", "at", "n")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])

        for batch in batches:
            for lang, low, high, part, chunk, source, block, vocabulary, total, at, n in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (lang, low, high, part) != key:
                    if tile:
                        yield out(tile.pairs())
                    key, tile = (lang, low, high, part), Tile(lang, low == high, part == 0, vocabulary)
                if chunk < 0:
                    tile.group(source, total, block == high)
                else:
                    tile.add(chunk, source, at, n)
        if tile:
            yield out(tile.pairs())

    dealt = rows.select(*names).repartition(partitions(spark), "lang", "low", "high", "range").sortWithinPartitions("lang", "low", "high", "range", "chunk", "source")
    parts = dealt.mapInArrow(tiles, "lang string, source string, item string, value long")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("total") + F.col("vocabulary")), share(F.col("all_n"), F.col("lang_total") + F.col("vocabulary"))
    scored = kept.join(groups.select("lang", "source", "total", "vocabulary", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = scored.where("p > q").withColumn("value", gain(F.col("p"), F.col("q"))).drop("p", "q")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))
