"""Problem 3: totals and averages per entity and day over trailing periods, also for days without activity.

The state of a day is yesterday's totals plus what arrives today minus what expires today (what arrived `window` days
ago). Days on which nothing arrives or expires leave the totals as they are, so the versioned state keeps a row only for
days of change, and a day in between reads the row before it. Corrections touch the days from the corrected one to
window - 1 days after it; only those are recomputed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import runtime
from millrace.sources.versions import VersionedFolder

WINDOWS = (7, 30)


def daily_amounts(events: DataFrame, entity: str, day: str, amount: str) -> DataFrame:
    """Arrivals (entity, day, amount, n) of each day; null amounts count as 0. Null entities or days give no row."""
    e = events.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return e.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.sum(F.coalesce(amount, F.lit(0)).cast("long")).alias("amount"), F.count(F.lit(1)).alias("n"))


def advance(yesterday: DataFrame | None, daily: DataFrame, first: int, last: int, windows: Sequence[int] = WINDOWS, since: int | None = None) -> DataFrame:
    """State rows (entity, window_days, day, until, total, n) of the days first to last, at the days on which a total changes.

    yesterday: totals (entity, window_days, total, n) at the end of the day before first, None for nothing. To them come, day
    by day, that day's arrivals less what expires on it: the three meet by (entity, window, day), and each state is the one
    before plus their difference. `until` is the last day for which a row holds, so a span of one day is the plain step from
    yesterday to today. Entities stay in the state once they are in it. Arrivals before `since` never counted, so they do
    not expire. An entity has at most as many rows as there are days, whatever the number of its events.
    """
    counted = daily if since is None else daily.where(F.col("day") >= since)
    sides = F.array(*[F.struct(F.lit(w).alias("window_days"), (F.col("day") + shift).alias("day"), (F.col("amount") * sign).alias("amount"), (F.col("n") * sign).alias("n")) for w in windows for shift, sign in ((0, 1), (w, -1))])
    moves = counted.where((F.col("day") <= last) & (F.col("day") >= first - max(windows))).select("entity", F.explode(sides).alias("m")).select("entity", "m.*").where((F.col("day") >= first) & (F.col("day") <= last))
    if yesterday is not None:
        moves = moves.unionByName(yesterday.select("entity", "window_days", F.lit(first).alias("day"), F.col("total").alias("amount"), "n"))
    met = moves.groupBy("entity", "window_days", "day").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    w = Window.partitionBy("entity", "window_days").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return met.select(
        "entity", "window_days", "day", (F.coalesce(F.lead("day").over(w), F.lit(last + 1)) - 1).alias("until"),
        F.sum("amount").over(run).alias("total"), F.sum("n").over(run).alias("n"),
    )


def every_day(state: DataFrame) -> DataFrame:
    """State of all days: each row repeated for the days it holds. average is per event, null without events."""
    days = state.select("entity", "window_days", F.explode(F.sequence("day", "until")).alias("day"), "total", "n")
    return days.withColumn("average", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def first_peak(state: DataFrame) -> DataFrame:
    """(entity, window_days, day): the first day on which the total is at its maximum. Totals only move on days that have
    a state row, so those days are enough."""
    return state.groupBy("entity", "window_days").agg(F.max(F.struct("total", (-F.col("day")).alias("d"))).alias("m")).select("entity", "window_days", (-F.col("m.d")).alias("day"))


class RollingStore:
    """Versioned state on disk, carried on span by span (a day, or as many as have come in).

    `<root>/v<N>/span=<first>-<last>/` holds the state rows of a span that version N wrote, `v<N>/manifest` the spans of
    version N with the versions that hold them. A version comes into force by one rename. extend() adds the days after the
    last span from the totals at its end; correct() takes changed daily amounts and writes the spans they touch anew.
    """

    def __init__(self, spark: SparkSession, root: str, windows: Sequence[int] = WINDOWS):
        self.spark, self.root, self.windows = spark, root.rstrip("/"), tuple(windows)
        self._folder = VersionedFolder(spark, root)

    def spans(self) -> list[tuple[int, int, int]]:
        """(first day, last day, version that holds it) in order, of the version in force."""
        n = self._folder.version()
        return [tuple(x) for x in json.loads(self._folder.read(f"v{n}/manifest"))] if n else []

    def _path(self, span: tuple[int, int, int]) -> str:
        first, last, version = span
        return f"{self.root}/v{version}/span={first}-{last}"

    def state(self, first: int | None = None, last: int | None = None) -> DataFrame | None:
        """Rows of the spans that hold days from first to last; None before anything is published."""
        paths = [self._path(s) for s in self.spans() if (last is None or s[0] <= last) and (first is None or s[1] >= first)]
        return self.spark.read.parquet(*paths) if paths else None

    def _span(self, daily: DataFrame, first: int, last: int, before: list[tuple[int, int, int]], version: int) -> tuple[int, int, int]:
        yesterday = self.spark.read.parquet(self._path(before[-1])).where(F.col("until") == first - 1) if before else None
        rows = advance(yesterday, daily, first, last, self.windows, before[0][0] if before else first)
        span = (first, last, version)
        runtime.persist_table(rows, "rolling", self._path(span))
        return span

    def _publish(self, spans: list[tuple[int, int, int]], version: int) -> None:
        self._folder.write(f"v{version}/manifest", json.dumps(spans))
        self._folder.publish(version)

    def extend(self, daily: DataFrame, last: int, first: int | None = None) -> None:
        """Adds the days up to last: those after the last span, or in an empty store from first on, which is by default the
        first day of daily. Nothing to add changes nothing."""
        spans = self.spans()
        start = spans[-1][1] + 1 if spans else first if first is not None else daily.agg(F.min("day")).first()[0]
        if start is None or start > last:
            return
        version = self._folder.version() + 1
        self._publish([*spans, self._span(daily, start, last, spans, version)], version)

    def correct(self, daily: DataFrame, changed_days: Sequence[int]) -> None:
        """Writes anew the spans that changed daily amounts touch: from the changed day to the last on which it counts."""
        version, out = self._folder.version() + 1, []
        for first, last, held in self.spans():
            touched = any(d <= last and d + max(self.windows) >= first for d in changed_days)
            out.append(self._span(daily, first, last, out, version) if touched else (first, last, held))
        self._publish(out, version)
