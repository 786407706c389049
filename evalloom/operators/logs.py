"""Game logs and transcripts: filters, ordering, sentences, interval joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import transcript_line

#: Seconds in a period by league; other basketball leagues have the last.
PERIOD_SECONDS = {"3_NBA": 720, "68_China. CBA": 720, "137_United States. NBA G-League": 720, "6_NCAA Division I": 1200}
OTHER_PERIOD_SECONDS = 600
#: Classes of actions at one time, in order; actions that aren't named stand between assists and scores.
ACTION_CLASS = {"Foul": 1, "Technical foul": 1, "Pick'n'Roll": 1, "Post": 1, "Screen": 1, "Assisting": 2, "1+": 4, "1-": 4, "2+": 4, "2-": 4, "3+": 4, "3-": 4}
OTHER_CLASS = 3


def period_seconds(league: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in sorted(PERIOD_SECONDS.items()) for x in (k, v)))
    return F.coalesce(F.try_element_at(table, league), F.lit(OTHER_PERIOD_SECONDS))


def select_actions(log: DataFrame, actions: Sequence[str], columns: Sequence[str], order: Sequence[str], period: int | None = None, period_column: str = "period") -> DataFrame:
    """Columns of the rows with one of the actions (and in one period), in order."""
    out = log.where(F.col("action_name").isin(list(actions)))
    if period is not None:
        out = out.where(F.col(period_column) == period)
    return out.select(*columns).orderBy(*order)


def segment(log: DataFrame, start: float, length: float = 60.0, clock: str = "second") -> DataFrame:
    """Rows within [start, start + length], both ends included."""
    return log.where(F.col(clock).between(start, start + length))


def play_order(log: DataFrame, rank: Mapping[str, int] | None = None, period: str = "period", clock: str = "second", other: int = OTHER_CLASS) -> Column:
    """Struct to sort by: period, clock, class of the action (``other`` if it has none)."""
    table = F.create_map(*(F.lit(x) for k, v in sorted((rank or ACTION_CLASS).items()) for x in (k, v)))
    return F.struct(F.col(period).alias("_period"), F.col(clock).alias("_clock"), F.coalesce(F.try_element_at(table, F.col("action_name")), F.lit(other)).alias("_class"))


def play_by_play(log: DataFrame, game: str, order: Column, period: str, sentence: Column) -> DataFrame:
    """One text for each game: sentences in order, a header line where the period changes."""
    w = Window.partitionBy(game).orderBy("_o")
    lines = log.withColumn("_o", order).withColumn("_s", sentence)
    changed = F.coalesce(F.lag(period).over(w) != F.col(period), F.lit(True))
    lines = lines.withColumn("_line", F.when(changed, F.concat(F.lit("Period "), F.col(period).cast("string"), F.lit(":\n"), F.col("_s"))).otherwise(F.col("_s")))
    return lines.groupBy(game).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def transcript_rows(asr: DataFrame, keys: Sequence[str], text: str = "transcript") -> DataFrame:
    """Keys with start, end and caption of each readable line."""
    lines = asr.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select(*keys, "pos", transcript_line(F.col("line")).alias("t")).where("t.start is not null").select(*keys, "pos", "t.*")


def within(items: DataFrame, spans: DataFrame, keys: Sequence[str], slack: float = 0.0) -> DataFrame:
    """Items inside a span (widened by ``slack``) with the same keys: an equality join with range conditions, never a bare range join."""
    s = spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})
    return items.join(s, list(keys)).where((F.col("start") >= F.col("span_start") - slack) & (F.col("end") <= F.col("span_end") + slack))


def bucketed_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Pairs of intervals that overlap (strictly), by time buckets so that a busy key is split: a pair is kept in the bucket where the later one starts."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        renamed = df.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys))
        return renamed.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}start") / bucket), F.floor(F.col(f"{p}end") / bucket))))

    both = spread(left, "l_").join(spread(right, "r_"), [*keys, "_b"])
    first = F.floor(F.greatest("l_start", "r_start") / bucket)
    return both.where((F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start")) & (F.col("_b") == first)).drop("_b")


def rosters(log: DataFrame, team: str, player: str, order: str | None = None) -> DataFrame:
    """Distinct players of each team: sorted, or by first appearance."""
    players = log.where(F.col(player).isNotNull()).groupBy(team, player).agg(F.min(order).alias("_o") if order else F.lit(0).alias("_o"))
    return players.groupBy(team).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", player))), lambda x: x[player]).alias("players"))


def language_gate(asr: DataFrame, game: str, language: str, wanted: str) -> DataFrame:
    """Games all of whose periods are in the wanted language."""
    wrong = asr.where(~F.col(language).eqNullSafe(F.lit(wanted))).select(game).distinct()
    return asr.join(wrong, game, "left_anti")
