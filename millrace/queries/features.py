"""Queries of the feature engine: aggregations, point-in-time joins, staging, quality, streams and models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.dates import PartitionRange
from millrace.models import predict
from millrace.plans import staging
from millrace.plans.derive import coalesced_join, only_left_keys, without_skew
from millrace.plans.join import compute_group_by, compute_join
from millrace.plans.mutations import temporal_entities
from millrace.plans.shapes import aggregate, parts_of
from millrace.plans.snapshot import snapshot_entities, snapshot_events
from millrace.plans.temporal import temporal_events
from millrace.quality import stats
from millrace.runtime import read_table
from millrace.serving.fetcher import lambda_merge
from millrace.serving.kv import FolderStore
from millrace.serving.online import WindowLookup, stream_rows, upload_rows
from millrace.sources.tables import Catalog
from millrace.spec import (
    Accuracy, Aggregation, BootstrapPart, Derivation, EntitySource, EventSource, ExternalPart, GroupBy, Join, JoinPart, JoinSource, ModelTransforms, Operation, Query, StagingQuery,
)
from millrace.streaming import tiles

O = Operation  # noqa: E741
Queries = dict[str, Callable[[SparkSession, str], DataFrame]]
QUERIES: Queries = {}
MONTH = PartitionRange("2024-01-01", "2024-01-31")
SPLIT = 1_705_276_800_000  # 2024-01-15
CDC_DAY = "2001-09-01"


def query(f):
    QUERIES[f.__name__] = f
    return f


def events(spark: SparkSession, d: str) -> DataFrame:
    """events with ts in epoch milliseconds and ds."""
    e = read_table(spark, d, "events").withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    return e.withColumn("ds", F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd"))


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'purchase'")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, lists as text, so that rows compare by value."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def exploded(df: DataFrame, keys: list[str], column: str, digits: int = 6) -> DataFrame:
    return rounded(df.select(*keys, F.explode(column).alias("bucket", "amount")), digits)


def pit(spark: SparkSession, d: str, *aggs: Aggregation) -> DataFrame:
    return temporal_events(purchases(spark, d), events(spark, d), ["user_id"], parts_of(aggs))


@query
def pit_multi_window(spark, d):
    w = ("1h", "1d", "7d")
    return rounded(pit(spark, d, *[Aggregation("value", o, w) for o in (O.SUM, O.COUNT, O.AVERAGE, O.MIN, O.MAX)]))


@query
def tile_join_14d(spark, d):
    return rounded(pit(spark, d, Aggregation("value", O.SUM, ("30m", "14d")), Aggregation("value", O.COUNT, ("30m", "14d"))))


@query
def pit_unbounded(spark, d):
    return rounded(pit(spark, d, Aggregation("value", O.SUM), Aggregation("value", O.COUNT), Aggregation("value", O.LAST), Aggregation("value", O.FIRST)))


@query
def pit_first_last(spark, d):
    return rounded(pit(spark, d, Aggregation("event_type", O.FIRST, ("1d",)), Aggregation("event_type", O.LAST, ("1d",))))


@query
def pit_last_k(spark, d):
    return rounded(pit(spark, d, Aggregation("event_id", O.LAST_K, ("7d",), k=3), Aggregation("event_id", O.FIRST_K, ("7d",), k=3)))


@query
def pit_top_k(spark, d):
    return rounded(pit(spark, d, Aggregation("event_id", O.TOP_K, ("7d",), k=3), Aggregation("event_id", O.BOTTOM_K, ("7d",), k=3)))


@query
def pit_bucketed_by_event_type(spark, d):
    return exploded(pit(spark, d, Aggregation("value", O.SUM, ("1d",), buckets=("event_type",))), ["user_id", "ts"], "value_sum_1d_by_event_type")


@query
def pit_unique_count(spark, d):
    return pit(spark, d, Aggregation("event_type", O.UNIQUE_COUNT, ("1d", "7d")))


@query
def pit_histogram(spark, d):
    return exploded(pit(spark, d, Aggregation("event_type", O.HISTOGRAM, ("7d",))), ["user_id", "ts"], "event_type_histogram_7d")


@query
def pit_variance(spark, d):
    # Values have two decimals, so variances of few are often halfway between two roundings; their roots are not.
    v = pit(spark, d, Aggregation("value", O.VARIANCE, ("7d",)))
    return rounded(v.select("user_id", "ts", F.sqrt("value_variance_7d").alias("value_deviation_7d")), 4)


@query
def snapshot_events_daily(spark, d):
    aggs = [Aggregation("value", o, ("1d", "7d", None)) for o in (O.SUM, O.COUNT, O.MAX)]
    return rounded(snapshot_events(events(spark, d), ["user_id"], parts_of(aggs), MONTH.start, MONTH.end))


@query
def snapshot_events_bucketed(spark, d):
    aggs = [Aggregation("value", O.COUNT, ("3d",), buckets=("event_type",))]
    return exploded(snapshot_events(events(spark, d), ["user_id"], parts_of(aggs), MONTH.start, MONTH.end), ["user_id", "ds"], "value_count_3d_by_event_type")


@query
def snapshot_entities_users(spark, d):
    u = read_table(spark, d, "users").where("user_id is not null").withColumn("ts", F.unix_millis(F.to_timestamp("ds", "yyyy-MM-dd")))
    return snapshot_entities(u, ["user_id"], parts_of([Aggregation("email_verified", O.COUNT), Aggregation("email_verified", O.MAX, ("1d",)), Aggregation("account_created_ds", O.MIN)]))


@query
def entity_passthrough(spark, d):
    c = read_table(spark, d, "customer").withColumn("ds", F.lit("2024-01-31"))
    g = GroupBy("customer", [EntitySource("customer", Query({"c_custkey": None, "c_mktsegment": None, "c_acctbal": "round(c_acctbal, 2)"}))], ["c_custkey"])
    return compute_group_by(Catalog(spark, {"customer": c}), g, PartitionRange("2024-01-31", "2024-01-31"))


def _simple(name: str, digits: int = 6, **args) -> None:
    o = args.pop("op")

    def run(spark, d):
        return rounded(aggregate(events(spark, d), ["user_id"], parts_of([Aggregation(operation=o, **args)])), digits)

    QUERIES[name] = run


_simple("gb_sum", op=O.SUM, input_column="value")
_simple("gb_count", op=O.COUNT, input_column="value")
_simple("gb_average", op=O.AVERAGE, input_column="value")
_simple("gb_min", op=O.MIN, input_column="value")
_simple("gb_max", op=O.MAX, input_column="event_type")
_simple("gb_variance", 4, op=O.VARIANCE, input_column="value")
_simple("gb_skew", 4, op=O.SKEW, input_column="value")
_simple("gb_kurtosis", 4, op=O.KURTOSIS, input_column="value")
_simple("gb_first", op=O.FIRST, input_column="event_id")
_simple("gb_last", op=O.LAST, input_column="event_id")
_simple("gb_first_k", op=O.FIRST_K, input_column="event_id", k=5)
_simple("gb_last_k", op=O.LAST_K, input_column="event_id", k=5)
_simple("gb_top_k", op=O.TOP_K, input_column="event_id", k=5)
_simple("gb_bottom_k", op=O.BOTTOM_K, input_column="event_id", k=5)
_simple("gb_unique_count", op=O.UNIQUE_COUNT, input_column="event_type")
_simple("gb_unique_top_k", op=O.UNIQUE_TOP_K, input_column="event_type", k=2)
_simple("gb_approx_unique_count", op=O.APPROX_UNIQUE_COUNT, input_column="event_id")
_simple("gb_approx_percentile", op=O.APPROX_PERCENTILE, input_column="value", percentiles=(0.1, 0.5, 0.9))


@query
def gb_unique_top_k_struct(spark, d):
    e = events(spark, d).withColumn("s", F.struct(F.lpad((F.round("value", 2) * 100).cast("bigint").cast("string"), 12, "0").alias("sort_key"), F.col("event_id").alias("unique_id")))
    out = aggregate(e, ["user_id"], parts_of([Aggregation("s", O.UNIQUE_TOP_K, k=3)]))
    return rounded(out.select("user_id", F.transform("s_unique_top3", lambda x: x["unique_id"]).alias("ids")))


@query
def gb_histogram(spark, d):
    return exploded(aggregate(events(spark, d), ["user_id"], parts_of([Aggregation("event_type", O.HISTOGRAM)])), ["user_id"], "event_type_histogram")


@query
def gb_frequent_k(spark, d):
    return exploded(aggregate(events(spark, d), ["event_type"], parts_of([Aggregation("user_id", O.APPROX_FREQUENT_K, k=5)])), ["event_type"], "user_id_approx_frequent_k")


@query
def gb_heavy_hitters(spark, d):
    return exploded(aggregate(events(spark, d), ["user_id"], parts_of([Aggregation("event_type", O.APPROX_HEAVY_HITTERS_K, k=4)])), ["user_id"], "event_type_approx_heavy_hitters_k")


@query
def gb_bucketed(spark, d):
    return exploded(aggregate(events(spark, d), ["user_id"], parts_of([Aggregation("value", O.AVERAGE, buckets=("event_type",))])), ["user_id"], "value_average_by_event_type")


@query
def vector_explode_average(spark, d):
    v = read_table(spark, d, "embeddings").withColumn("ts", F.lit(0).cast("long"))
    return rounded(aggregate(v, ["label"], parts_of([Aggregation("embedding", O.AVERAGE), Aggregation("embedding", O.COUNT), Aggregation("embedding", O.MAX)])), 4)


@query
def map_explode_sum(spark, d):
    e = events(spark, d).withColumn("m", F.create_map("event_type", "value"))
    return exploded(aggregate(e, ["user_id"], parts_of([Aggregation("m", O.SUM)])), ["user_id"], "m_sum")


def _catalog(spark, d, **more) -> Catalog:
    return Catalog(spark, {"events": events(spark, d), "purchases": purchases(spark, d), **more})


def _events_source(columns=("user_id", "value", "event_type"), table="events", **args) -> EventSource:
    return EventSource(table, Query({c: None for c in columns}, time_column="ts"), **args)


def _daily() -> GroupBy:
    return GroupBy("daily", [_events_source()], ["user_id"], [Aggregation("value", O.SUM, ("1d", "7d")), Aggregation("value", O.COUNT, ("7d",))])


def _live() -> GroupBy:
    return GroupBy("live", [_events_source()], ["user_id"], [Aggregation("value", O.SUM, ("1h", "1d"))], Accuracy.TEMPORAL)


LEFT = EventSource("purchases", Query({"event_id": None, "user_id": None}, time_column="ts"))


@query
def join_events_snapshot_shift(spark, d):
    return rounded(compute_join(_catalog(spark, d), Join("j", LEFT, [JoinPart(_daily())]), MONTH))


@query
def join_events_temporal(spark, d):
    return rounded(compute_join(_catalog(spark, d), Join("j", LEFT, [JoinPart(_live())]), MONTH))


@query
def join_multi_part_prefixed(spark, d):
    left = EventSource("purchases", Query({"event_id": None, "buyer": "user_id"}, time_column="ts"))
    parts = [JoinPart(_daily(), {"buyer": "user_id"}, "own"), JoinPart(_live(), {"buyer": "user_id"})]
    return rounded(compute_join(_catalog(spark, d), Join("j", left, parts, external_parts=[ExternalPart("risk", {"score": "double"})]), MONTH).drop("ext_risk_score"))


@query
def join_entities_snapshot(spark, d):
    users = read_table(spark, d, "users").where("user_id is not null").select("user_id", "ds").distinct()
    views = read_table(spark, d, "item_views").where("ts between 1500000000000 and 1900000000000")
    g = GroupBy("views", [EventSource("item_views", Query({"user_id": None, "item_id": None, "time_spent_ms": None}, time_column="ts"))], ["user_id"], [Aggregation("item_id", O.COUNT, ("7d",)), Aggregation("time_spent_ms", O.MAX, ("7d",))])
    catalog = Catalog(spark, {"users": users, "item_views": views})
    return compute_join(catalog, Join("j", EntitySource("users", Query({"user_id": None})), [JoinPart(g)]), PartitionRange("2024-01-18", "2024-03-31"))


@query
def join_skew_filter(spark, d):
    return without_skew(purchases(spark, d).select("event_id", "user_id", "event_type"), {"user_id": [1, 2, 3], "event_type": ["view"]})


@query
def join_coalesced(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("note")).groupBy("c_custkey").agg(F.max("note").alias("note"))
    c = read_table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("note"))
    return coalesced_join(c, o, ["c_custkey"])


@query
def join_small_left(spark, d):
    left = purchases(spark, d).select("user_id").distinct()
    right = only_left_keys(events(spark, d), left, ["user_id"], 5000)
    return rounded(left.join(right.groupBy("user_id").agg(F.sum("value").alias("total")), "user_id", "left"), 4)


@query
def join_bootstrap(spark, d):
    e = purchases(spark, d)
    ready = e.where("event_id % 3 = 0").select("event_id", "ds", F.col("event_id").cast("double").alias("daily_value_sum_1d"), F.lit(0.0).alias("daily_value_sum_7d"), F.lit(7).cast("long").alias("daily_value_count_7d"))
    left = EventSource("purchases", Query({"event_id": None, "user_id": None}, time_column="ts"))
    j = Join("j", left, [JoinPart(_daily())], row_ids=["event_id"], bootstrap_parts=[BootstrapPart("ready", Query({"event_id": None, "daily_value_sum_1d": None, "daily_value_sum_7d": None, "daily_value_count_7d": None}))])
    return rounded(compute_join(_catalog(spark, d, ready=ready), j, MONTH))


@query
def derivations_wildcard(spark, d):
    g = GroupBy("g", [_events_source()], ["user_id"], [Aggregation("value", O.SUM, ("7d",)), Aggregation("value", O.COUNT, ("7d",)), Aggregation("value", O.MAX, ("7d",))], derivations=[Derivation("*", "*"), Derivation("per_event", "value_sum_7d / value_count_7d"), Derivation("peak", "value_max_7d")])
    return rounded(compute_group_by(_catalog(spark, d), g, MONTH))


@query
def join_derivations(spark, d):
    j = Join("j", LEFT, [JoinPart(_daily())], derivations=[Derivation("*", "*"), Derivation("mean_7d", "daily_value_sum_7d / daily_value_count_7d")])
    return rounded(compute_join(_catalog(spark, d), j, MONTH))


@query
def chained_group_by(spark, d):
    parent = Join("parent", LEFT, [JoinPart(_live())])
    g = GroupBy("chained", [JoinSource(parent, Query({"user_id": None, "spent": "live_value_sum_1d"}, time_column="ts"))], ["user_id"], [Aggregation("spent", O.MAX, ("7d",)), Aggregation("spent", O.COUNT, ("7d",))])
    return rounded(snapshot_events(_chained_rows(spark, d, g), ["user_id"], g.parts(), MONTH.start, MONTH.end))


def _chained_rows(spark, d, g):
    from millrace.plans.join import group_by_rows

    return group_by_rows(_catalog(spark, d), g, MONTH)


@query
def multi_source_union(spark, d):
    low = events(spark, d).where("event_type <> 'purchase'").withColumn("cents", F.round(F.col("value") * 100))
    sources = [EventSource("purchases", Query({"user_id": None, "amount": "round(value, 2)"}, time_column="ts")), EventSource("low", Query({"user_id": None, "amount": "cents / 100"}, time_column="ts"))]
    g = GroupBy("u", sources, ["user_id"], [Aggregation("amount", O.SUM, ("7d",)), Aggregation("amount", O.COUNT, ("7d",))])
    return rounded(compute_group_by(_catalog(spark, d, low=low), g, MONTH), 4)


@query
def cumulative_latest(spark, d):
    u = read_table(spark, d, "users")
    source = EventSource("users", Query({"user_id": None, "email_verified": None}, wheres=["user_id is not null"]), is_cumulative=True)
    g = GroupBy("c", [source], ["user_id"], [Aggregation("email_verified", O.COUNT), Aggregation("email_verified", O.MAX)])
    return compute_group_by(Catalog(spark, {"users": u}), g, PartitionRange("2024-03-31", "2024-03-31"))


def _changes(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts")).where(F.col("ts") < F.unix_millis(F.to_timestamp(F.lit(CDC_DAY))))
    snap = o.select("o_custkey", "ts", "o_totalprice", F.date_sub(F.lit(CDC_DAY).cast("date"), 1).cast("string").alias("ds"))
    at = F.unix_millis(F.to_timestamp(F.lit(CDC_DAY))) + F.pmod(F.col("o_orderkey"), F.lit(20)) * 3_600_000
    row = lambda price, before: o.select("o_orderkey", "o_custkey", "ts", price.alias("o_totalprice"), at.alias("mutation_ts"), F.lit(before).alias("is_before"), F.lit(CDC_DAY).alias("ds"))
    updates = row(F.col("o_totalprice"), True).unionByName(row(F.col("o_totalprice") + 100, False)).where("o_orderkey % 7 = 0")
    deletes = row(F.col("o_totalprice"), True).where("o_orderkey % 11 = 0 and o_orderkey % 7 <> 0")
    asked = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.array(*[F.unix_millis(F.to_timestamp(F.lit(CDC_DAY))) + h * 3_600_000 for h in (5, 19)])).alias("ts"))
    return asked, snap, updates.unionByName(deletes).drop("o_orderkey")


@query
def mutation_aggregates(spark, d):
    aggs = [Aggregation("o_totalprice", O.AVERAGE), Aggregation("o_totalprice", O.SUM), Aggregation("o_totalprice", O.COUNT), Aggregation("o_totalprice", O.MAX), Aggregation("o_totalprice", O.COUNT, ("90d",))]
    return rounded(temporal_entities(*_changes(spark, d), ["o_custkey"], parts_of(aggs)))


@query
def staging_query_macros(spark, d):
    q = StagingQuery("s", "SELECT ds, event_type, count(*) AS n FROM events WHERE ds BETWEEN {{ start_date(offset=-2, lower_bound='2024-01-05') }} AND {{ end_date(upper_bound='2024-01-20') }} GROUP BY ds, event_type", "2024-01-01")
    return staging.staging_frame(_catalog(spark, d), q, PartitionRange("2024-01-06", "2024-01-31"))


@query
def staging_rollup(spark, d):
    q = StagingQuery("s", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "2024-01-01")
    return staging.staging_frame(Catalog(spark, {"lineitem": read_table(spark, d, "lineitem")}), q, MONTH)


@query
def scan_partition_range(spark, d):
    q = Query({"user_id": None, "seconds": "time_spent_ms div 1000"}, wheres=["user_id is not null", "time_spent_ms > 0 or item_id is null"])
    return Catalog(spark, {"item_views": read_table(spark, d, "item_views")}).scan("item_views", q, PartitionRange("2024-02-10", "2024-02-20"))


@query
def lambda_merge_live(spark, d):
    end = 1_705_708_800_000  # 2024-01-20
    q = purchases(spark, d).where(F.col("ts") >= end)
    return rounded(lambda_merge(q, events(spark, d), ["user_id"], parts_of([Aggregation("value", O.SUM, ("1d", "7d", None)), Aggregation("value", O.COUNT, ("7d",)), Aggregation("value", O.LAST)]), end))


@query
def lookups_merged(spark, d):
    """The same answers from a store: partials uploaded up to the day, the events since as they stream in, and lookups."""
    end = 1_705_708_800_000  # 2024-01-20
    e = events(spark, d)
    parts = parts_of([Aggregation("value", O.SUM, ("1d", "7d", None)), Aggregation("value", O.COUNT, ("7d",)), Aggregation("value", O.LAST)])
    store = FolderStore(spark, runtime.own_path(spark, "store"))
    store.bulk_put("live_batch", upload_rows(e, ["user_id"], parts, end))
    store.bulk_put("live_stream", stream_rows(e.where(F.col("ts") >= end), ["user_id"], parts))
    asked = purchases(spark, d).where(F.col("ts") >= end)
    return rounded(WindowLookup(store, "live", e, ["user_id"], parts).over(asked))


@query
def stats_hourly(spark, d):
    s = stats.column_stats(events(spark, d), ["value", "event_type"])
    return rounded(s.withColumn("value_deviation", F.sqrt("value_variance")).drop("value_variance"), 4)


@query
def stats_merged(spark, d):
    s = stats.column_stats(events(spark, d), ["value", "event_type"])
    return rounded(stats.merge_stats(s, ["value", "event_type"]), 3)


@query
def stats_null_rates(spark, d):
    v = read_table(spark, d, "item_views").where("ts is not null")
    return rounded(stats.null_rates(stats.column_stats(v, ["user_id", "item_id", "time_spent_ms"], bucket_ms=86_400_000), ["user_id", "item_id", "time_spent_ms"]))


@query
def enhanced_stats_low_card(spark, d):
    s = stats.enhanced_stats(events(spark, d), ["event_type"], bucket_ms=86_400_000)
    return s.select("bucket", "total_count", "event_type_unique_count", F.explode("event_type_histogram").alias("event_type", "n"))


@query
def enhanced_stats_percentiles(spark, d):
    s = stats.enhanced_stats(events(spark, d), ["event_id", "value"], bucket_ms=86_400_000)
    return rounded(s)


@query
def drift_histogram(spark, d):
    e = events(spark, d)
    return rounded(stats.histogram_drift(e.where(F.col("ts") < SPLIT), e.where(F.col("ts") >= SPLIT), "event_type"))


@query
def drift_percentiles(spark, d):
    return rounded(stats.percentile_drift(stats.summarize(events(spark, d), ["value", "props"]), 86_400_000))


@query
def drift_sketches(spark, d):
    e = events(spark, d)
    return rounded(stats.sketch_distance(e.where(F.col("ts") < SPLIT), e.where(F.col("ts") >= SPLIT), "value"))


@query
def tile_drift(spark, d):
    s = stats.column_stats(events(spark, d), ["value"], bucket_ms=86_400_000)
    return rounded(stats.tile_changes(s, "bucket", ["total_count", "value_average"], 86_400_000), 4)


@query
def tile_series(spark, d):
    s = events(spark, d).groupBy("event_type", "ds").agg(F.count(F.lit(1)).alias("n"))
    return rounded(stats.pivoted(s, "ds", ["n"], "event_type"))


def _shaken(spark, d) -> DataFrame:
    return events(spark, d).where("event_id % 10 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"), F.when(F.col("event_id") % 4 == 0, "other").otherwise(F.col("event_type")).alias("event_type"))


@query
def compare_metrics(spark, d):
    return rounded(stats.compare_metrics(events(spark, d).select("event_id", "value", "event_type"), _shaken(spark, d), ["event_id"], ["value", "event_type"]), 5)


@query
def consistency_check(spark, d):
    logged = _shaken(spark, d)
    return rounded(stats.consistency(logged.unionByName(logged), events(spark, d).select("event_id", "value", "event_type"), ["event_id"], ["value"]), 5)


@query
def side_by_side_diff(spark, d):
    return rounded(stats.differences(events(spark, d).select("event_id", "value", "event_type"), _shaken(spark, d), ["event_id"]))


@query
def skew_keys(spark, d):
    return stats.heavy_keys(read_table(spark, d, "checkouts"), "user_id", 0.02)


@query
def timestamp_checks(spark, d):
    return stats.timestamp_checks(read_table(spark, d, "checkouts"))


@query
def edit_distances(spark, d):
    per = events(spark, d).groupBy("user_id", "ds").agg(F.sort_array(F.collect_list(F.struct("ts", "event_type"))).alias("x")).select("user_id", "ds", F.col("x.event_type").alias("x"))
    nxt = per.select("user_id", F.date_sub(F.to_date("ds"), 1).cast("string").alias("ds"), F.col("x").alias("y"))
    return per.join(nxt, ["user_id", "ds"]).select("user_id", "ds", stats.edit_distance(spark, F.col("x"), F.col("y")).alias("e")).select("user_id", "ds", "e.insert", "e.delete")


@query
def scalar_functions(spark, d):
    e = events(spark, d)
    return rounded(e.selectExpr(
        "event_id", "value + 2 * 3 as added", "event_id % 7 as modulo", "abs(10 - value) as distance", "cast(value as int) as whole", "concat_ws('-', event_type, cast(user_id as string)) as joined", "ascii(event_type) as first_code",
        "regexp_extract(props, '([0-9]+)', 1) as number_text", "length(props) as size", "if(value > 50, 'high', 'low') as level", "coalesce(nullif(event_type, 'view'), 'none') as kind", "case when value < 10 then 1 when value < 50 then 2 else 3 end as grade",
        "event_type <=> null as unknown", "get_json_object(props, '$.k') as k", "cast(unbase64(base64(cast(event_type as binary))) as string) as same", "dayofweek(timestamp_millis(ts)) as weekday", "day(timestamp_millis(ts)) as day_of_month",
        "date_format(date_trunc('HOUR', timestamp_millis(ts)), 'yyyy-MM-dd HH') as hour", "cast(date_add(to_date(ds), 3) as string) as later", "cast(aggregate(array_repeat(2, 3), 0, (a, x) -> a + x, a -> a * 10) as int) as folded",
        "array_min(transform(array(3, 1, 2), x -> x + user_id)) as least", "cardinality(map('a', 1, 'b', 2)) as entries", "element_at(map('a', user_id), 'a') as looked_up",
    ))


@query
def generators(spark, d):
    return events(spark, d).selectExpr("event_id", "inline(array(struct(event_type as word, 1 as side), struct(reverse(event_type) as word, 2 as side)))")


@query
def set_functions(spark, d):
    e = events(spark, d).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    wanted = F.array(F.lit("purchase"), F.lit("error"))
    return rounded(e.select("user_id", F.sort_array(F.array_distinct(F.array_append("kinds", F.lit("extra")))).alias("added"), F.coalesce(F.arrays_overlap("kinds", wanted), F.lit(False)).cast("int").alias("any_of")))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = read_table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    return s.withColumn("event_time", F.col("ts").cast("timestamp"))


def _run_stream(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and reads back what it wrote, with the micro-batch of each row."""
    out = runtime.fresh_path(spark, name)
    write = lambda df, k: df.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/rows/part={k}")
    tiles.to_batches(stream, write, f"{out}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("part")


@query
def stream_tiles(spark, d):
    parts = parts_of([Aggregation("value", o, ("1d",)) for o in (O.SUM, O.COUNT, O.MAX)])
    s = _stream(spark, d)
    rows = _run_stream(spark, tiles.tiled(s, ["user_id"], parts), "stream-tiles", "update")
    last = stats.running_rank(rows, ["user_id", "tile_start"], [F.desc("_batch")], 1)
    return rounded(tiles.finished(last, ["user_id"], parts, {f.name: f.dataType for f in s.schema.fields}))


@query
def stream_cdc_tiles(spark, d):
    parts = parts_of([Aggregation("value", o, ("1d",)) for o in (O.SUM, O.COUNT)])
    s = _stream(spark, d)
    before = F.when(F.col("event_id") % 5 == 0, F.struct("user_id", "value"))
    changes = tiles.before_and_after(s.select("event_time", before.alias("before"), F.struct("user_id", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value")).alias("after")), "before", "after")
    rows = _run_stream(spark, tiles.tiled(changes, ["user_id"], parts, sign="sign"), "stream-cdc", "update")
    last = stats.running_rank(rows, ["user_id", "tile_start"], [F.desc("_batch")], 1)
    return rounded(last.select("user_id", "tile_start", F.col("value_sum__s").alias("value_sum"), F.col("value_count__n").alias("value_count")))


@query
def stream_enriched(spark, d):
    features = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    s = _stream(spark, d).where("event_type = 'purchase'").select("event_id", "user_id")
    return _run_stream(spark, tiles.enriched(s, features, ["user_id"]), "stream-enriched", "append").drop("_batch")


@query
def stream_chained_tiles(spark, d):
    features = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    parts = parts_of([Aggregation("value", O.SUM, ("14d",)), Aggregation("value", O.COUNT, ("14d",))])
    s = tiles.enriched(_stream(spark, d).where("event_type = 'purchase'"), features, ["user_id"])
    rows = _run_stream(spark, tiles.tiled(s, ["c_mktsegment"], parts), "stream-chained", "update")
    last = stats.running_rank(rows, ["c_mktsegment", "tile_start"], [F.desc("_batch")], 1)
    return rounded(tiles.finished(last, ["c_mktsegment"], parts, {f.name: f.dataType for f in s.schema.fields}))


def _late_stream(spark: SparkSession, d: str) -> tiles.TileFolder:
    """events arriving in three runs of one stream: before and after the middle of the month without every 50th event, and
    then those, most of which are too late for their hour."""
    path, e = runtime.own_path(spark, "late"), read_table(spark, d, "events")
    parts = parts_of([Aggregation("value", o, ("1d",)) for o in (O.SUM, O.COUNT)])
    folder = tiles.TileFolder(spark, f"{path}/out", ["user_id"], parts)
    middle = F.col("ts") < F.lit("2024-01-15").cast(e.schema["ts"].dataType)
    for arriving in (e.where("event_id % 50 <> 0").where(middle), e.where("event_id % 50 <> 0").where(~middle), e.where("event_id % 50 = 0")):
        arriving.write.mode("append").parquet(f"{path}/in")
        folder.run(spark.readStream.schema(e.schema).parquet(f"{path}/in").withColumn("event_time", F.col("ts").cast("timestamp")), f"{path}/checkpoint")
    return folder


@query
def stream_late_tiles(spark, d):
    """Tiles without what came too late for them, and whether they still take rows."""
    kinds = {f.name: f.dataType for f in read_table(spark, d, "events").schema.fields}
    return rounded(_late_stream(spark, d).tiles(kinds))


@query
def stream_late_rows(spark, d):
    """The rows that came too late."""
    return _late_stream(spark, d).late().select("event_id", "user_id")


@query
def model_transform_batch(spark, d):
    m = ModelTransforms({"x": "value / 10", "n": "length(event_type)"}, {"score": "raw * 2", "high": "cast(raw > 5 as int)"}, ["event_id"], batch_size=100)
    return rounded(predict(events(spark, d), m, _linear, "raw double"))


def _linear(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"raw": frame["x"] * 0.5 + frame["n"]})
