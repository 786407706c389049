"""Operator 9: line dedup by a log-template tree, in DataFrame functions only.

A line's tokens that hold a digit are variable fields. The tree has a fixed depth: token count, then the first
``depth`` tokens (all of them in shorter lines); lines of a leaf that agree in all tokens but the variable ones have the
same template. Lines without any other token are data and have none. A leaf whose lines don't agree is generalised: at
each place the leaf's most frequent token counts as constant, and lines that agree with at least ``similarity`` of
these share one template. What is left of the leaf is split by its tokens at one place, the one with the most frequent
token that not all lines have, and each part is generalised in the same way, until no part holds enough families: a
leaf has as many templates as its lines show.

Documents that share more than half of their text (distinct non-blank lines, weighted by length) are one family, and so
are those that such links connect: copies and near copies, but not documents that only share some lines. A template
recurs if its lines stand in documents of at least ``least`` families, however many lines or copies there are. So lines
that only copies of one document share are left to the near-duplicate operators. Lines of recurring templates are
dropped from all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut

#: Rows of a leaf table (8 bytes each) up to which it is broadcast; beyond it is joined by a shuffle.
SMALL = 200_000
#: Lines drawn from each document, by length, by which alike documents meet; two that share half of their text draw other lines each time with 2**-KEYS at most.
KEYS = 10
#: Longest line that counts with its whole length.
LENGTH = (1 << 20) - 1


def masked(line: Column) -> Column:
    """The line with each token that holds a digit replaced by one sign."""
    variable = F.regexp_replace(line, r"(?<!\S)[^\s\d]*+\d\S*+", "<*>")
    return F.btrim(F.when(line.rlike("[0-9]"), variable).otherwise(line), F.lit(" \t\r\f\x0b"))


def tokens_of(masked_line: Column) -> Column:
    return F.split(masked_line, r"\s+")


def lines(docs: DataFrame, depth: int) -> DataFrame:
    """``row`` of the document, ``family`` (equal for equal sets of lines), ``pos``, ``leaf`` (null in lines of variable fields only), ``template`` and the masked ``line`` of each line that isn't blank.

    A document's first such line also has the ``set`` of its lines: 44 bits of hash and 20 of length each.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.select(row_key(docs).alias("row"), split.alias("lines"))
    marks = F.transform("lines", lambda x: F.when(~blank(x), F.xxhash64(x).bitwiseAND(~LENGTH).bitwiseOR(F.least(F.length(x), F.lit(LENGTH)))))
    rows = rows.select("row", marks.alias("marks"), "lines")
    rows = rows.select("row", F.sort_array(F.array_distinct(F.array_compact("marks"))).alias("set"), F.array_position(F.transform("marks", lambda x: x.isNotNull()), True).alias("head"), "lines")
    each = rows.select("row", F.xxhash64("set").alias("family"), "set", "head", F.posexplode("lines").alias("pos", "line"))
    each = each.select("row", "family", F.when(F.col("pos") + 1 == F.col("head"), F.col("set")).alias("set"), "pos", masked(F.col("line")).alias("line")).where("line <> ''").withColumn("tokens", tokens_of(F.col("line")))
    leaf = F.when(F.exists("tokens", lambda x: x != "<*>"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)))
    return each.select("row", "family", "set", "pos", leaf.alias("leaf"), F.xxhash64("tokens").alias("template"), "line")


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\x0b")) == ""


def length(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(LENGTH))


def drawn(k: int) -> Column:
    """One line of ``set``, as a hash: each with a chance in proportion to its length, the same one for equal sets.

    Each line has an exponential waiting time whose rate is its length. The first of two sets' lines is a common one with
    the share of their text, by length, that is common.
    """

    def wait(x: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(x, F.lit(k)), 11) + 0.5) / float(1 << 53)
        return F.log(uniform) / x.bitwiseAND(LENGTH)

    return F.xxhash64(F.array_max(F.transform("set", wait)))


def related(every: DataFrame) -> DataFrame:
    """``family, root`` of the families that links join with others; ``root`` stands for all that are joined."""
    sets = cut(every.where("set is not null").groupBy("family").agg(F.any_value("set").alias("set")))

    keys = sets.withColumn("drawn", F.array(*[drawn(k) for k in range(KEYS)])).withColumn("size", F.log2(length(F.col("set"))))
    # A draw alone; with the next one, so that a line of many documents heads fewer keys; with a class of sizes.
    alone = [F.col("drawn")[k] for k in range(KEYS)]
    both = [F.xxhash64(F.lit("both"), F.col("drawn")[k], F.col("drawn")[k + 1]) for k in range(0, KEYS, 2)]
    sized = [F.xxhash64(F.lit("size"), F.col("drawn")[k], F.floor((F.col("size") + 2.0 * k / KEYS) / 2)) for k in range(1, KEYS, 2)]
    keys = keys.select("family", F.explode(F.array_distinct(F.array(*alone, *both, *sized))).alias("key"))
    # Each is compared with the first one that has the same key, so there are no more pairs than keys.
    first = keys.groupBy("key").agg(F.min("family").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "a")
    pairs = keys.join(first, "key").where("family <> a").select("a", F.col("family").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("family").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("family").alias("b"), F.col("set").alias("y")), "b")

    both = length(F.array_intersect("x", "y"))
    links = cut(pairs.where(2 * both > length(F.col("x")) + length(F.col("y")) - both).select("a", "b"))
    return cut(components(links).select(F.col("id").alias("family"), F.col("component").alias("root")))


def rooted(some: DataFrame, roots: DataFrame) -> DataFrame:
    return some.join(roots, "family", "left").withColumn("family", F.coalesce("root", "family")).drop("root")


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def recurring(where: DataFrame, key: str, least: int) -> DataFrame:
    """Keys in at least ``least`` families."""
    return where.select(key, "family").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least).select(key)


def dropped_lines(docs: DataFrame, least: int, depth: int, similarity: float) -> DataFrame:
    """``row, pos`` of the lines of recurring templates."""
    # One pass over the texts; later steps read only the columns that they need.
    table = cut(lines(docs, depth))
    roots = related(table)
    every = table.where("leaf is not null").drop("set")
    seen = cut(rooted(every.select("leaf", "template", "family").distinct(), roots))
    templates = cut(recurring(seen, "template", least))
    # Leaves that recur although (beside such templates) no template of theirs does.
    open_leaves = cut(recurring(seen.join(templates, "template", "left_anti"), "leaf", least))
    plain = every.join(templates, "template", "left_semi").select("row", "pos")
    count = open_leaves.count()
    if not count:
        return plain
    small = F.broadcast(open_leaves) if count <= SMALL else open_leaves
    within = every.join(small, "leaf").join(templates, "template", "left_anti").withColumn("tokens", tokens_of(F.col("line")))
    within = cut(rooted(within.select("leaf", "row", "pos", "family", "tokens"), roots))
    return reduce(DataFrame.unionByName, generalised(within, least, similarity), plain)


def generalised(within: DataFrame, least: int, similarity: float) -> Iterator[DataFrame]:
    """``row, pos`` of the lines (``leaf, row, pos, family, tokens``) that agree with a recurring pattern of their leaf or of a part of it.

    A split fixes a place that lines of the part differed in, so there are no more rounds than places, and in each
    round a line goes to one part.
    """
    while True:
        places = within.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
        constant = places.groupBy("leaf", "place").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("n"), F.count(F.lit(1)).alias("different"))
        pattern = constant.groupBy("leaf").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("pattern"),
            F.max(F.when(F.col("different") > 1, F.struct("n", (-F.col("place")).alias("at")))).alias("split"),
        )
        agree = F.aggregate(F.zip_with("tokens", "pattern", lambda a, b: (a.eqNullSafe(b) & (a != "<*>")).cast("int")), F.lit(0), lambda s, x: s + x)
        alike = (agree >= F.ceil(F.size("pattern") * similarity)).alias("alike")
        tried = cut(within.join(pattern, "leaf").select("leaf", "row", "pos", "family", "tokens", alike, F.get("tokens", -F.col("split.at")).alias("token")))
        good = cut(recurring(tried.where("alike"), "leaf", least))
        yield tried.where("alike").join(good, "leaf", "left_semi").select("row", "pos")
        rest = tried.join(good.withColumn("good", F.lit(True)), "leaf", "left").where("token is not null and not (alike and good is not null)")
        rest = rest.select(F.xxhash64("leaf", "token").alias("leaf"), "row", "pos", "family", "tokens")
        parts = cut(recurring(rest, "leaf", least))
        count = parts.count()
        if not count:
            return
        within = rest.join(F.broadcast(parts) if count <= SMALL else parts, "leaf", "left_semi")


def drop_recurring_lines(docs: DataFrame, least: int = 6, depth: int = 3, similarity: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and any others) with ``text`` less its recurring lines, ``n_lines`` and ``n_dropped``.

    Null texts stay null, empty ones empty (0 and 1 lines, none dropped). Lines of variable fields only stay, as
    does a line that recurs only within one document or only in copies. Texts of any length are read whole; in the share
    that makes copies a line counts with 1,048,575 characters at most. Rows that agree in doc_id and text are one
    document and lose the same lines. Columns named ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an
    empty one.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_lines(docs, least, depth, similarity).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    # All of a row's columns go as one, so that none of their names can clash.
    keyed = docs.select(F.struct(*columns).alias("doc"), row_key(docs).alias("row")).join(gone.hint("shuffle_hash"), "row", "left")
    split = F.split(F.col("doc")["text"], "\n", -1)
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc")["text"]).otherwise(kept).alias("text")
    return keyed.select(
        *[text if c == "text" else F.col("doc")[c].alias(c) for c in columns],
        F.when(F.col("doc")["text"].isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        n.cast("long").alias("n_dropped"),
    )
