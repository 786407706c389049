"""Dataset building: retrieval maps, nested fields, mappings between sources, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.positions import numbered


def text_map(items: DataFrame, item: str, captions: str) -> DataFrame:
    """One row for each caption: ``text_idx`` (dense, by item and place), ``item_idx`` (by item), the text."""
    places = numbered(items.select(F.col(item).alias("item")).distinct(), ["item"], "item_idx")
    rows = items.select(F.col(item).alias("item"), F.posexplode(captions).alias("pos", "text")).join(places, "item")
    return numbered(rows, ["item_idx", "pos", "text"], "text_idx").select("text_idx", "item_idx", "item", "text")


def negatives(items: DataFrame, item: str, *columns: str) -> DataFrame:
    """All negatives of an item as one array, in the columns' order, distinct."""
    arrays = [F.coalesce(F.col(c), F.array().cast(items.schema[c].dataType)) for c in columns]
    return items.select(item, F.array_distinct(F.concat(*arrays)).alias("negatives"))


def prompts(labels: DataFrame, label: str, templates: Sequence[str]) -> DataFrame:
    """Every distinct label in every template (``{}`` stands for it)."""
    texts = F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col(label)) for t in templates))
    return labels.select(label).distinct().select(label, F.posexplode(texts).alias("template", "text"))


def paragraphs(items: DataFrame, captions: str, sep: str = " ") -> DataFrame:
    """Caption arrays joined to one text."""
    return items.withColumn(captions, F.array_join(captions, sep))


def flattened(rows: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(sep.join((*path, f.name)))

    return rows.select(*walk(rows.schema, ()))


def source_mapping(mapping: DataFrame, reports: DataFrame, keys: Sequence[str], teams: Sequence[str] | None = None) -> DataFrame:
    """Games with the first key that is set, both teams from ``home - away`` names (whitelisted if asked), and the report if there is one."""
    sides = F.split("name", r"\s+-\s+")
    out = mapping.withColumn("game_id", F.coalesce(*keys)).withColumn("home", F.get(sides, F.lit(0))).withColumn("away", F.get(sides, F.lit(1)))
    if teams is not None:
        out = out.where(F.col("home").isin(list(teams)) & F.col("away").isin(list(teams)))
    return out.join(reports, "game_id", "left")


def missing_entities(spark_requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that no entity has: the diagnosis of an empty filtered search."""
    return spark_requested.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def pending_requests(entries: DataFrame, done: DataFrame, key: str, text: str, fallback: str) -> DataFrame:
    """Entries not yet answered, with the fallback where the text is missing; those with neither go."""
    rows = entries.join(done.select(key).distinct(), key, "left_anti")
    return rows.withColumn(text, F.coalesce(F.nullif(F.trim(text), F.lit("")), F.col(fallback))).where(F.col(text).isNotNull()).drop(fallback)


def numeric_names(listing: DataFrame, name: str) -> DataFrame:
    """Entries whose name is a number, with it."""
    return listing.withColumn("number", F.col(name).try_cast("long")).where("number is not null")


def runs_found(listing: DataFrame, path: str, pattern: str) -> DataFrame:
    """``run`` and ``stamp`` (groups 1 and 2 of the pattern) of the paths that match."""
    return listing.where(F.col(path).rlike(pattern)).select(path, F.regexp_extract(path, pattern, 1).alias("run"), F.regexp_extract(path, pattern, 2).alias("stamp"))
