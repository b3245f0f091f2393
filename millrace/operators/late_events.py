"""Problem 2: per-period aggregates by event time that late records correct, up to a cut-off.

State is a multiset per event day: (period, value, load, n), where n is what that load added to or took from the count of
the value. A late record adds to the counts of its own day, a corrected one takes its old value out and puts its new one
in. Aggregates after any load are those of the counts summed up to it, so medians, distincts and extremes are exact and
can go back as well as forward. What arrives beyond the cut-off is left out of the state and reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions.columns import day_number
from millrace.functions.multiset import order_statistics

CUTOFF_DAYS = 7


def adjustments(versions: DataFrame, key: Sequence[str], load: str, period: str, value: str, cutoff_days: int = CUTOFF_DAYS) -> DataFrame:
    """What each load does to the multisets: rows (key, load_day, period, value, n, verdict, first).

    versions: rows of records with `load` (yyyy-MM-dd), `period` (epoch day, int) and `value` (long). Rows of one record
    and load are one version (should they differ, the greatest counts). n is +1 for the value a version puts in and -1
    for the one it takes out; `first` marks a record's first arrival. verdict: `on_time` if the load is not after the
    period, `corrects` within the cut-off, `too_late` beyond; too late adjustments are reported but are no part of the
    state. Null periods or loads that are no dates have no place in time and give no row. A record's versions are at
    most as many as loads, so its group is small however many copies it has: copies combine before the shuffle.
    """
    v = versions.select(*key, day_number(F.col(load)).alias("load_day"), F.col(period).alias("period"), F.col(value).alias("value"))
    v = v.where("load_day is not null and period is not null")
    history = v.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("load_day", "period", "value"))).alias("h"))
    # Of several contents in one load the last in order stays; then each version is paired with the one before it.
    last = F.filter("h", lambda x, i: (i == F.size("h") - 1) | (F.get("h", i + 1)["load_day"] != x["load_day"]))
    history = history.select(*key, last.alias("h"))
    verdict = lambda x, p: F.when(x["load_day"] <= p, "on_time").when(x["load_day"] - p <= cutoff_days, "corrects").otherwise("too_late")
    row = lambda x, p, val, n, first: F.struct(
        x["load_day"].alias("load_day"), p.alias("period"), val.alias("value"), F.lit(n).cast("long").alias("n"), verdict(x, p).alias("verdict"), first.alias("first")
    )

    # A version beyond the cut-off changes nothing, so the value to take out is the one of the last version within it: it is
    # carried along the history in order, one step per version.
    kind = "array<struct<load_day:int,period:int,value:bigint,n:bigint,verdict:string,first:boolean>>"

    def step(state, x):
        old = state["live"]
        counts = x["load_day"] - x["period"] <= cutoff_days
        same = old.isNotNull() & old["period"].eqNullSafe(x["period"]) & old["value"].eqNullSafe(x["value"])
        put = row(x, x["period"], x["value"], 1, F.size(state["out"]) == 0)
        take = row(x, old["period"], old["value"], -1, F.lit(False))
        added = F.when(same, F.array().cast(kind)).when(old.isNotNull() & counts, F.array(put, take)).otherwise(F.array(put))
        return F.struct(F.when(counts, x).otherwise(old).alias("live"), F.concat(state["out"], added).alias("out"))

    nothing = F.struct(F.lit(None).cast("struct<load_day:int,period:int,value:bigint>").alias("live"), F.array().cast(kind).alias("out"))
    return history.select(*key, F.inline(F.aggregate("h", nothing, step, lambda state: state["out"])))


def multiset(adjusted: DataFrame) -> DataFrame:
    """The state: net count changes n by (period, value, load_day, verdict), and how many of them are first arrivals. Cells
    with the verdict `too_late` are kept to be reported; no aggregate counts them."""
    cells = adjusted.groupBy("period", "value", "load_day", "verdict").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("arrivals"))
    return cells.where("n <> 0 or arrivals > 0")


def late_arrivals(adjusted: DataFrame, state: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, period, load_day, value, verdict) of the records behind the state's cells of late first arrivals: those that
    correct a period, and those that came too late to. The cells are few (periods x values x loads), the records of a hot
    cell stay where they are if the cells can be broadcast; else adaptive skew handling splits the cell."""
    cells = state.where("verdict <> 'on_time' and arrivals > 0").select(F.col("period").alias("_p"), F.col("value").alias("_v"), F.col("load_day").alias("_l"), F.col("verdict").alias("_w"))
    cell = (F.col("period") == F.col("_p")) & F.col("value").eqNullSafe(F.col("_v")) & (F.col("load_day") == F.col("_l")) & (F.col("verdict") == F.col("_w"))
    return adjusted.where("first and verdict <> 'on_time'").join(runtime.broadcast_if_small(cells), cell, "left_semi").select(*key, "period", "load_day", "value", "verdict")


def corrected_aggregates(state: DataFrame) -> DataFrame:
    """For each period and each load that changed it: records, total, median, distincts and extremes after that load.

    Null values count in `records` only. A period has at most as many versions as loads touch it, so the state grows by
    that factor at most.
    """
    state = state.where("verdict <> 'too_late' and n <> 0").groupBy("period", "value", "load_day").agg(F.sum("n").alias("n")).where("n <> 0")
    loads = state.select("period", F.col("load_day").alias("as_of")).distinct()
    seen = state.join(runtime.broadcast_if_small(loads), "period").where("load_day <= as_of").groupBy("period", "as_of", "value").agg(F.sum("n").alias("n")).where("n > 0")
    seen = runtime.persist_table(seen, "multiset-versions")
    counts = seen.groupBy("period", "as_of").agg(F.sum("n").alias("records"))
    stats = order_statistics(seen, ["period", "as_of"])
    return counts.join(stats, ["period", "as_of"], "left").select("period", "as_of", "records", F.coalesce("total", F.lit(0)).alias("total"), "median", F.coalesce("distincts", F.lit(0)).alias("distincts"), "lowest", "highest")


class PeriodStore:
    """The multiset state on disk, one directory per load, so that a load done twice replaces itself.

    apply() takes one load's adjustments; aggregates() derives the figures of the periods that load touched from all
    directories up to it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def apply(self, adjusted: DataFrame, load_day: int) -> None:
        delta = multiset(adjusted.where(F.col("load_day") == load_day)).where("verdict <> 'too_late'")
        delta = delta.groupBy("period", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        delta.write.mode("overwrite").parquet(f"{self.root}/load_day={load_day}")

    def state(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).schema("period int, value bigint, n bigint, load_day int").parquet(self.root)

    def aggregates(self, load_day: int) -> DataFrame:
        state = self.state().where(F.col("load_day") <= load_day)
        touched = state.where(F.col("load_day") == load_day).select("period").distinct()
        live = state.join(touched, "period", "left_semi").groupBy("period", "value").agg(F.sum("n").alias("n")).where("n > 0")
        return order_statistics(live, ["period"])
