"""The feature engine: boundaries, tiles against pairs on random data, golden changes, sources and sinks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.dates import PartitionRange, contiguous, render, shift, unfilled
from millrace.models import predict
from millrace.plans import planner, staging
from millrace.plans.derive import coalesced_join, derive, without_skew
from millrace.plans.join import compute_join
from millrace.plans.mutations import temporal_entities
from millrace.plans.shapes import aggregate, parts_of, shapes
from millrace.plans.snapshot import snapshot_entities, snapshot_events
from millrace.plans.temporal import temporal_by_pairs, temporal_events
from millrace.quality import stats
from millrace.queries.features import QUERIES
from millrace.serving.fetcher import Fetcher, lambda_merge
from millrace.serving.kv import FolderStore, MemoryStore, RemoteStore, encoded, flatten_log
from millrace.sources.tables import Catalog, DataPointer, Topic, export_table, load_folder
from millrace.spec import (
    Accuracy, Aggregation, Derivation, EntitySource, EventSource, ExternalPart, GroupBy, Join, JoinPart, ModelTransforms, Operation, Query, StagingQuery, Window,
)
from millrace.streaming import tiles

O = Operation  # noqa: E741
HOUR = 3_600_000


def value(v):
    if isinstance(v, dict):
        return tuple(sorted((k, value(x)) for k, x in v.items()))
    if isinstance(v, list):
        return tuple(value(x) for x in v)
    return float(f"{v:.5g}") if isinstance(v, float) else v


def table(df, keys=2):
    return {tuple(r[:keys]): tuple(value(x) for x in r[keys:]) for r in df.collect()}


def random_events(spark, seed, n=400):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        ts = None if rng.random() < 0.03 else rng.choice([rng.randrange(20 * 24 * 60) * 60_000, 10 * 24 * HOUR + rng.randrange(600) * 1000])
        data.append((rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.choice(["x", None, "y"]), ts, rng.choice([None, 1.5, 2.0, -3.25, 7.0]), rng.choice([None, [], [1.0, None], [2.0]]), rng.choice([None, {}, {"m": 1.0}, {"n": None, "m": 2.0}])))
    return spark.createDataFrame(data, "k string, b string, ts long, v double, l array<double>, m map<string,double>")


EVERY = [
    *[Aggregation("v", o, ("30m", "1d", "14d", None), k=2) for o in (O.SUM, O.COUNT, O.AVERAGE, O.MIN, O.MAX, O.VARIANCE, O.UNIQUE_COUNT, O.TOP_K, O.BOTTOM_K, O.UNIQUE_TOP_K)],
    Aggregation("v", O.SUM, ("300h", "13h", "35m")), Aggregation("v", O.LAST, ("1d", None)), Aggregation("v", O.FIRST, ("1d",)), Aggregation("v", O.LAST_K, ("1d",), k=2), Aggregation("b", O.HISTOGRAM, ("1d", None)), Aggregation("v", O.SUM, ("1d", None), buckets=("b",)),
    Aggregation("l", O.SUM, ("1d", None)), Aggregation("m", O.AVERAGE, ("14d",)), Aggregation("b", O.APPROX_FREQUENT_K, ("1d",), k=1),
]


def test_tiles_agree_with_pairs_on_random_data_with_nulls_and_a_hot_key(spark):
    e = random_events(spark, 1)
    q = random_events(spark, 2, 60).select("k", "ts")
    parts = parts_of(EVERY)
    assert table(temporal_events(q, e, ["k"], parts)) == table(temporal_by_pairs(q, e, ["k"], parts))


def edge_queries(spark):
    """Queries and events at the edges of weeks, days, hours and five minutes."""
    at = [week * 7 * 24 * HOUR + step + d for week in (-1, 0, 1, 2, 3) for step in (0, 24 * HOUR, HOUR, 300_000) for d in (-1, 0, 1)]
    e = spark.createDataFrame([(k, t, "xyz"[i % 3]) for i, t in enumerate(at) for k in ("a", "b")], "k string, ts long, w string")
    return e.select("k", "ts"), e


def test_histograms_meet_tiles_between_bounds_and_list_none(spark, tiny):
    q, e = edge_queries(spark)
    parts = parts_of([Aggregation("w", O.HISTOGRAM, ("7d", "1d", "1h", "14d"))])
    assert table(temporal_events(q, e, ["k"], parts)) == table(temporal_by_pairs(q, e, ["k"], parts))
    plan = QUERIES["pit_histogram"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "merge" in plan  # a list of tiles was taken for small and broadcast


def test_unique_counts_of_two_windows_meet_tiles_between_bounds_and_list_none(spark, tiny):
    q, e = edge_queries(spark)
    parts = parts_of([Aggregation("w", O.UNIQUE_COUNT, ("1d", "7d"))])
    assert table(temporal_events(q, e, ["k"], parts)) == table(temporal_by_pairs(q, e, ["k"], parts))
    plan = QUERIES["pit_unique_count"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "merge" in plan


def test_unique_counts_broadcast_no_side_thought_to_be_small(spark, tiny):
    counts = QUERIES["pit_unique_count"](spark, tiny)
    assert counts.count() == QUERIES["pit_histogram"](spark, tiny).select("user_id", "ts").distinct().count()
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "SortMergeJoin" in plan  # the queries were broadcast


def test_temporal_of_nothing(spark):
    e = random_events(spark, 1)
    parts = parts_of(EVERY[:3])
    assert temporal_events(e.limit(0), e, ["k"], parts).count() == 0
    q = random_events(spark, 2, 20).select("k", "ts").dropna()
    assert all(set(v) == {None} for v in table(temporal_events(q, e.limit(0), ["k"], parts)).values())


def test_window_boundaries(spark):
    e = spark.createDataFrame([("k", 500, 10.0), ("k", 2000, 100.0), ("k", 2000, 200.0), ("k", 2500, 50.0), ("k", 4000, 300.0)], "k string, ts long, v double")
    q = spark.createDataFrame([("k", t) for t in (1000, 2000, 3000)], "k string, ts long")
    got = table(temporal_events(q, e, ["k"], parts_of([Aggregation("v", O.COUNT), Aggregation("v", O.SUM, ("1h",))])))
    assert got == {("k", 1000): (1, 10.0), ("k", 2000): (3, 310.0), ("k", 3000): (4, 360.0)}


def test_window_begins_on_its_grid(spark):
    assert [Window.of(w).tail_hop() for w in ("14d", "12d", "11d", "12h", "11h", "30m", None)] == [24 * HOUR, 24 * HOUR, HOUR, HOUR, 300_000, 300_000, 24 * HOUR]
    at = 30 * 24 * HOUR + 30 * 60_000
    e = spark.createDataFrame([("k", 29 * 24 * HOUR + m * 60_000, 1.0) for m in (-1, 0, 29, 31)], "k string, ts long, v double")
    got = table(temporal_events(spark.createDataFrame([("k", at)], "k string, ts long"), e, ["k"], parts_of([Aggregation("v", O.COUNT, ("1d",))])))
    assert got == {("k", at): (3,)}  # the tail goes down to the full hour


def test_aggregates_of_nothing_are_null_and_infinities_vanish(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", float("inf"), 1), ("c", 2.0, 1)], "k string, v double, ts long")
    parts = parts_of([Aggregation("v", o) for o in (O.COUNT, O.SUM, O.AVERAGE, O.VARIANCE, O.SKEW, O.UNIQUE_COUNT, O.HISTOGRAM)])
    got = table(aggregate(df, ["k"], parts), 1)
    assert got["a",] == (None,) * 7
    assert got["b",][:3] == (1, None, None)
    assert got["c",][:5] == (1, 2.0, 2.0, 0.0, None)


def test_moments(spark):
    df = spark.createDataFrame([("k", float(v), 0) for v in (1, 2, 3, 10)], "k string, v double, ts long")
    got = table(aggregate(df, ["k"], parts_of([Aggregation("v", o) for o in (O.VARIANCE, O.SKEW, O.KURTOSIS)])), 1)
    assert got["k",] == pytest.approx((12.5, 1.0182, -0.7696), abs=1e-3)
    assert table(aggregate(df.where("v <= 2"), ["k"], parts_of([Aggregation("v", O.SKEW), Aggregation("v", O.KURTOSIS)])), 1)["k",] == (None, None)


def test_unique_top_k_by_id(spark):
    df = spark.createDataFrame([("k", ("b", 1, 5), 0), ("k", ("a", 1, 6), 0), ("k", ("c", 2, 7), 0), ("k", None, 0)], "k string, s struct<sort_key:string,unique_id:long,value:int>, ts long")
    got = aggregate(df, ["k"], parts_of([Aggregation("s", O.UNIQUE_TOP_K, k=2)])).head().s_unique_top2
    assert [(r.sort_key, r.unique_id) for r in got] == [("c", 2), ("b", 1)]


def test_sketches_are_close(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("v"), F.lit(0).cast("long").alias("ts"))
    r = aggregate(df, ["k"], parts_of([Aggregation("v", O.APPROX_UNIQUE_COUNT), Aggregation("v", O.APPROX_PERCENTILE, percentiles=(0.25, 0.5))])).head()
    assert abs(r.v_approx_unique_count - 20_000) < 1600
    assert abs(r.v_approx_percentile[0] - 5000) < 600 and abs(r.v_approx_percentile[1] - 10_000) < 600


def test_snapshots(spark):
    day = 24 * HOUR
    e = spark.createDataFrame([("a", 0, 1.0), ("a", 2 * day - 1, 2.0), ("b", 3 * day, None), (None, 0, 5.0)], "k string, ts long, v double")
    parts = parts_of([Aggregation("v", O.SUM, ("1d", "2d", None))])
    assert table(snapshot_events(e, ["k"], parts, "1970-01-01", "1970-01-04")) == {("a", "1970-01-01"): (1.0, 1.0, 1.0), ("a", "1970-01-02"): (2.0, 3.0, 3.0), ("a", "1970-01-03"): (None, 2.0, 3.0), ("a", "1970-01-04"): (None, None, 3.0)}
    s = e.withColumn("ds", F.lit("1970-01-02"))
    assert table(snapshot_entities(s, ["k"], parts)) == {("a", "1970-01-02"): (2.0, 3.0, 3.0), ("b", "1970-01-02"): (None, None, None), (None, "1970-01-02"): (None, 5.0, 5.0)}


def millis(spark, text):
    return spark.range(1).select(F.unix_millis(F.to_timestamp(F.lit(text)))).head()[0]


def test_changes_golden(spark):
    t = lambda x: millis(spark, f"2021-{x}")
    q = spark.createDataFrame([(1, t("04-10 01:00:00")), (1, t("04-10 02:30:00")), (2, t("04-10 23:00:00"))], "listing_id int, ts long")
    snap = [(1, "04-04 00:30", 4), (2, "04-04 01:40", 3), (3, "04-04 06:00", 4), (1, "04-04 12:30", 5), (1, "04-05 00:30", 4), (2, "04-05 03:40", 3), (3, "04-05 04:00", 4), (1, "04-05 02:30", 5)]
    s = spark.createDataFrame([(i, t(f"{x}:00"), r, "2021-04-09") for i, x, r in snap], "listing_id int, ts long, rating int, ds string")
    m = spark.createDataFrame([(i, t(f"04-10 {a}:00"), r, t(f"04-10 {b}:00"), False, "2021-04-10") for i, a, r, b in ((1, "02:00", 2, "02:00"), (2, "10:00", 3, "02:10"), (3, "23:00", 4, "02:15"))], "listing_id int, ts long, rating int, mutation_ts long, is_before boolean, ds string")
    got = temporal_entities(q, s, m, ["listing_id"], parts_of([Aggregation("rating", O.AVERAGE)]))
    assert [r.rating_average for r in got.orderBy("listing_id", "ts").collect()] == [4.5, 4.0, 3.0]


def test_changes_take_rows_back(spark):
    day = 24 * HOUR
    s = spark.createDataFrame([("a", 5, 4.0, "x", "1970-01-01"), ("b", 5, 1.0, "y", "1970-01-01")], "k string, ts long, v double, c string, ds string")
    m = spark.createDataFrame([("a", 5, 4.0, "x", day + 10, True, "1970-01-02"), ("a", 5, 6.0, "z", day + 20, False, "1970-01-02"), ("b", 5, 1.0, "y", day + 10, True, "1970-01-02")], "k string, ts long, v double, c string, mutation_ts long, is_before boolean, ds string")
    q = spark.createDataFrame([(k, day + t) for k in "abc" for t in (10, 15, 25)], "k string, ts long")
    parts = parts_of([Aggregation("v", O.COUNT, (None, "30d")), Aggregation("v", O.AVERAGE), Aggregation("v", O.MAX), Aggregation("c", O.HISTOGRAM)])
    got = table(temporal_entities(q, s, m, ["k"], parts))
    assert got["a", day + 10] == (1, 1, 4.0, 4.0, (("x", 1),))
    assert got["a", day + 15] == (0, 0, None, 4.0, None)
    assert got["a", day + 25] == (1, 1, 6.0, 6.0, (("z", 1),))
    assert got["b", day + 25] == (0, 0, None, 1.0, None)
    assert got["c", day + 25] == (None,) * 5


def test_join_keeps_every_left_row_and_marks_external_columns(spark):
    left = spark.createDataFrame([(1, None, 10), (2, "a", 24 * HOUR + 5), (2, "a", 24 * HOUR + 5), (3, "zz", None)], "id int, who string, ts long")
    right = spark.createDataFrame([("a", 100, 2.0), ("a", 24 * HOUR + 1, 4.0)], "k string, ts long, v double")
    g = lambda acc: GroupBy("g", [EventSource("right", Query({"k": None, "v": None}, time_column="ts"))], ["k"], [Aggregation("v", O.SUM, ("1d",))], acc)
    j = Join("j", EventSource("left", Query({"id": None, "who": None}, time_column="ts")), [JoinPart(g(Accuracy.TEMPORAL), {"who": "k"}, "t"), JoinPart(g(None), {"who": "k"})], external_parts=[ExternalPart("x", {"s": "int"})])
    got = sorted((r.id, r.t_g_v_sum_1d, r.g_v_sum_1d, r.ext_x_s) for r in compute_join(Catalog(spark, {"left": left, "right": right}), j, None).collect())
    assert got == [(1, None, None, None), (2, 6.0, 2.0, None), (2, 6.0, 2.0, None), (3, None, None, None)]


def test_derive_skew_and_coalesce(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    assert derive(df, [Derivation("*", "*"), Derivation("c", "a"), Derivation("d", "a + b")], ["k"]).columns == ["k", "b", "c", "d"]
    s = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (None, 1), (None, 2)], "x int, y int")
    assert without_skew(s, {"x": [1], "y": [1]}).count() == 4
    left = spark.createDataFrame([(1, "l"), (2, None)], "k int, n string")
    right = spark.createDataFrame([(1, "r", 5), (2, "r", 6)], "k int, n string, m int")
    assert sorted(tuple(r) for r in coalesced_join(left, right, ["k"]).collect()) == [(1, "l", 5), (2, "r", 6)]
    with pytest.raises(ValueError, match="types"):
        coalesced_join(left, right.withColumn("n", F.lit(1)), ["k"])


def test_declarations_are_checked():
    source = EventSource("t", Query({"k": None}))
    for bad in (lambda: GroupBy("g", [EventSource("t", Query({"ts": None}))], ["k"], []), lambda: GroupBy("g", [source], ["x"], []), lambda: GroupBy("g", [source], ["k"]), lambda: GroupBy("g", [source], ["k"], [Aggregation("k", O.COUNT, ("1h",))]), lambda: Aggregation("k", O.APPROX_PERCENTILE, percentiles=(2,)), lambda: Window.of("1w")):
        with pytest.raises(ValueError):
            bad()
    names = [p.name for p in Aggregation("v", O.LAST_K, ("7d", None), ("b",), k=5).parts()]
    assert names == ["v_last5_7d_by_b", "v_last5_by_b"]
    assert GroupBy("g", [EventSource("t", Query({"k": None}), topic="kafka://x")], ["k"], []).inferred_accuracy == Accuracy.TEMPORAL


def test_dates_and_macros():
    r = PartitionRange("2024-02-27", "2024-03-01")
    assert r.partitions() == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"] and shift("2024-03-01", -1) == "2024-02-29"
    assert r.steps(3) == [PartitionRange("2024-02-27", "2024-02-29"), PartitionRange("2024-03-01", "2024-03-01")]
    assert contiguous(["2024-01-03", "2024-01-01", "2024-01-02", "2024-01-05"]) == [PartitionRange("2024-01-01", "2024-01-03"), PartitionRange("2024-01-05", "2024-01-05")]
    assert unfilled(r, ["2024-02-28"], [["2024-02-27", "2024-02-29", "2024-03-01"]]) == [PartitionRange("2024-02-29", "2024-03-01")]
    sql = render("a {{ start_date }} {{end_date(offset=-1)}} {{ start_date(offset=-9, lower_bound='2024-02-25') }} {{ latest_date(upper_bound=2024-01-01) }} {{ max_date(table=t) }}", r, "2024-03-02", lambda t: f"max-{t}")
    assert sql == "a '2024-02-27' '2024-02-29' '2024-02-25' '2024-01-01' 'max-t'"


def test_pointers_and_topics():
    assert DataPointer.parse("ns.table") == DataPointer("ns.table")
    assert DataPointer.parse("s3+parquet://b/x.csv") == DataPointer("s3://b/x.csv", "parquet")
    assert DataPointer.parse("file://a/b.csv") == DataPointer("file://a/b.csv", "csv")
    assert DataPointer.parse("bigquery(a=1, b=2)://p.d.t") == DataPointer("p.d.t", "bigquery", (("a", "1"), ("b", "2")))
    assert Topic.parse("kafka://t/host=h/path=a//b") == Topic("t", "kafka", {"host": "h", "path": "a/b"}) and Topic.parse("t").bus == "kafka"
    with pytest.raises(ValueError):
        Topic.parse("kafka://")


def test_sink_overwrites_partitions_and_expands(spark):
    c = Catalog(spark)
    spark.sql("DROP TABLE IF EXISTS sink")
    c.insert(spark.createDataFrame([("d1", 1), ("d2", 2)], "ds string, a int"), "sink", properties={"semantic_hash": "one"})
    c.insert(spark.createDataFrame([("d2", "n")], "ds string, b string"), "sink")
    assert sorted((r.ds, r.a, r.b) for r in spark.table("sink").collect()) == [("d1", 1, None), ("d2", None, "n")]
    assert c.partitions("sink") == ["d1", "d2"]
    assert c.archive_if_changed("sink", "one") is None
    archived = c.archive_if_changed("sink", "two")
    assert archived and not c.exists("sink") and c.exists(archived)
    spark.sql(f"DROP TABLE {archived}")


def test_staging_backfill_fills_only_what_is_missing(spark):
    c = Catalog(spark)
    for t in ("src", "out"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    c.insert(spark.createDataFrame([(f"2024-01-0{k}", k) for k in (1, 2, 4)], "ds string, v int"), "src")
    q = StagingQuery("out", "SELECT ds, v * 2 AS w FROM src WHERE ds BETWEEN {{ start_date }} AND {{ end_date }}", "2024-01-01")
    assert staging.backfill(c, q, "2024-01-04", ["src"]) == [PartitionRange("2024-01-01", "2024-01-02"), PartitionRange("2024-01-04", "2024-01-04")]
    assert staging.backfill(c, q, "2024-01-04", ["src"]) == []
    assert sorted((r.ds, r.w) for r in spark.table("out").collect()) == [("2024-01-01", 2), ("2024-01-02", 4), ("2024-01-04", 8)]
    for t in ("src", "out"):
        spark.sql(f"DROP TABLE {t}")


def test_scan_prunes(spark, tmp_path):
    spark.range(10).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 5 + 1).cast("string")).alias("ds"), F.lit(1).alias("unused")).write.partitionBy("ds").parquet(str(tmp_path / "t.parquet"))
    tables = load_folder(spark, str(tmp_path))
    df = Catalog(spark, tables).scan("t", Query({"x": "id + 1"}, wheres=["id > 2"]), PartitionRange("2024-01-02", "2024-01-03"))
    plan = df._jdf.queryExecution().toString()
    assert sorted((r.x, str(r.ds)) for r in df.collect()) == [(7, "2024-01-02"), (8, "2024-01-03")]
    assert "PartitionFilters: [isnotnull(ds" in plan and "GreaterThan(id,2)" in plan and "unused" not in plan.split("Physical Plan")[1]
    export_table(df, str(tmp_path / "o.csv"), "csv", header="true")
    assert load_folder(spark, str(tmp_path), "csv", header="true")["o"].count() == 2


def test_planner_orders_hashes_and_reuses():
    g = GroupBy("g", [EventSource("t", Query({"k": None, "v": None}))], ["k"], [Aggregation("v", O.SUM)])
    j = lambda **left: Join("j", EventSource("l", Query({"k": None, **left})), [JoinPart(g)], derivations=[Derivation("*", "*")])
    a, b = planner.plan_join(j()), planner.plan_join(j(more=None))
    assert [n.kind for n in a] == ["left", "part", "merge", "derive"]
    assert a[1].hash == b[1].hash and a[0].hash != b[0].hash
    assert planner.changed(a, a) == [] and [n.kind for n in planner.changed(a, b)] == ["left", "part", "merge", "derive"]
    order = []
    assert planner.run(a[::-1], lambda n: order.append(n.kind)) and order == ["left", "part", "merge", "derive"]
    assert set(planner.column_hashes(g)) == {"v_sum"}


def test_drift_by_percentiles():
    a = [float(k) for k in range(21)]
    assert stats.percentile_distance(a, a, "psi") == 0
    assert stats.interval_shares([0.0, 10.0], [0.0, 4.0, 10.0]) == pytest.approx([0.4, 0.6])
    far = [k + 100 for k in a]
    assert stats.percentile_distance(a, far, "psi") > 0.2 and stats.percentile_distance(a, far, "hellinger") == pytest.approx(1.0, abs=1e-6)


def test_drift_by_sketches(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    same, far = stats.sketch_distance(df, df, "v").head(), stats.sketch_distance(df, df.select((F.col("v") + 5000).alias("v")), "v").head()
    assert same.largest < 0.03 and same.psi < 0.05 and far.largest > 0.9 and far.psi > 1
    assert stats.sketch_distance(df, df.limit(0), "v").head().psi is None


def test_differences_tolerate_and_match_nulls(spark):
    a = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.000001), (None, 3.0), (4, None)], "k int, v double")
    assert sorted((r.k or 0, r.a_v, r.b_v) for r in stats.differences(a, b, ["k"]).collect()) == [(0, 2.0, 3.0), (3, None, None), (4, None, None)]


def test_compare_lists(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, None)], "k int, l array<string>")
    b = spark.createDataFrame([(1, ["y", "z", "z"]), (2, ["q"])], "k int, l array<string>")
    r = stats.compare_metrics(a, b, ["k"], ["l"]).head()
    assert (r.l_inserts, r.l_deletes, r.l_mismatch_length, r.l_left_null) == (1, 3, 1, 1)


def test_edits_make_the_right_like_the_left(spark):
    df = spark.createDataFrame([([], ["a", "b"]), (["a", "b", "c"], None), (None, None), (["a", "b"], ["b", "a"])], "x array<string>, y array<string>")
    got = df.select(stats.edit_distance(spark, F.col("x"), F.col("y")).alias("e")).select("e.insert", "e.delete")
    assert [tuple(r) for r in got.collect()] == [(0, 2), (3, 0), (0, 0), (1, 1)]


def test_moments_survive_large_means(spark):
    data = [(g, t, 1e9 + (k * 37 % 101) * 0.01 + g) for g in range(2) for t in range(3) for k in range(40)]
    df = spark.createDataFrame(data, "g int, t int, v double")
    parts = parts_of([Aggregation("v", o) for o in (O.VARIANCE, O.SKEW, O.KURTOSIS)])
    s = shapes(df, ["g", "t"], parts, "t")[0]
    tiles = s.tiles(s.frame, ["g", "t"])
    got = {r.g: r for r in s.final(s.merge_tiles(tiles, ["g"], lambda p: None), ["g"]).collect()}
    for g in range(2):
        x = np.array([v - 1e9 for h, _, v in data if h == g])
        y = x - x.mean()
        m2, m3, m4 = (y**2).mean(), (y**3).mean(), (y**4).mean()
        assert (got[g].v_variance, got[g].v_skew, got[g].v_kurtosis) == pytest.approx((m2, m3 / m2**1.5, m4 / m2**2 - 3), rel=1e-5, abs=1e-6)


def test_predict_in_batches(spark):
    m = ModelTransforms({"x": "v + 1"}, {"y": "p * 2"}, ["id"], batch_size=3)
    df = spark.range(10).select("id", F.col("id").alias("v"))

    def doubled(frame):
        assert len(frame) <= 3
        return frame.rename(columns={"x": "p"}).astype(float)

    assert {r.id: r.y for r in predict(df, m, doubled, "p double").collect()} == {k: (k + 1) * 2.0 for k in range(10)}


def test_runner_computes_only_what_is_missing_or_changed(spark):
    import uuid

    from millrace.plans.runner import JoinRunner, drop

    name = f"j_{uuid.uuid4().hex[:8]}"
    ev = spark.createDataFrame([(k % 3, k * 3_600_000, float(k), f"1970-01-{1 + k // 24:02d}") for k in range(24 * 9)], "u long, ts long, v double, ds string")
    left = ev.where("v % 5 = 0").select("u", "ts", "ds", F.col("v").alias("id"))
    src = lambda: EventSource("ev", Query({"u": None, "v": None}, time_column="ts"))
    part = lambda n, *w: JoinPart(GroupBy(n, [src()], ["u"], [Aggregation("v", O.SUM, w)]))
    j = lambda a, b: Join(name, EventSource("left", Query({"u": None, "id": None}, time_column="ts")), [part("a", *a), part("b", *b)])
    catalog = Catalog(spark, {"ev": ev, "left": left})
    days = PartitionRange("1970-01-03", "1970-01-06")
    first = JoinRunner(catalog, j(("1d",), ("2d",)))
    want = lambda join, days: sorted(tuple(r) for r in compute_join(catalog, join, days).select("u", "id", *sorted(c for c in compute_join(catalog, join, days).columns if c[:2] in ("a_", "b_"))).collect())
    got = lambda df: sorted(tuple(r) for r in df.select("u", "id", *sorted(c for c in df.columns if c[:2] in ("a_", "b_"))).collect())
    assert got(first.run(days)) == want(first.join, days) and len(first.log) == 4
    assert got(first.run(days)) == want(first.join, days) and first.log == []
    more = PartitionRange("1970-01-03", "1970-01-08")
    assert got(first.run(more)) == want(first.join, more) and {str(x[1]) for x in first.log} == {str([PartitionRange("1970-01-07", "1970-01-08")])}
    changed = JoinRunner(catalog, j(("1d", "3d"), ("2d",)))
    assert got(changed.run(more)) == want(changed.join, more)
    assert [columns for _, _, columns in changed.log] == [["a_v_sum_3d"], []]
    drop(changed)


def test_rows_are_evaluated_without_a_job(spark):
    from millrace.serving.online import RowEvaluator

    group = "no-jobs"
    spark.sparkContext.setJobGroup(group, "rows")
    evaluate = RowEvaluator(spark, "a bigint, s string, l array<double>", {"b": "a * 2", "t": "upper(s)", "m": "aggregate(l, 0D, (x, y) -> x + y)"}, ["a > 1 or a is null"])
    assert evaluate([{"a": 2, "s": "x'y", "l": [1.5, 2.0]}, {"a": 1}, {"a": None, "s": None}]) == [{"b": 4, "t": "X'Y", "m": 3.5}, None, {"b": None, "t": None, "m": None}]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0
    spark.sparkContext.setJobGroup("others", "")


def test_lookups_equal_batch_for_every_operation(spark, tmp_path):
    from millrace.serving.online import WindowLookup, stream_rows, upload_rows

    rng, hour = random.Random(11), 3_600_000
    end = 20_000 * 24 * hour
    rows_ = [(rng.choice(["a", "b", "c"]), end - rng.randrange(-30 * hour, 200 * hour), rng.choice([None, *[float(x) for x in range(9)]]), rng.choice([None, "x", "y", "z"]), rng.choice([None, "p", "q"])) for _ in range(500)]
    e = spark.createDataFrame(rows_, "k string, ts long, v double, w string, b string")
    aggs = [Aggregation("v", o, ("6h", None), k=3) for o in O if o not in (O.HISTOGRAM, O.APPROX_FREQUENT_K, O.APPROX_HEAVY_HITTERS_K, O.APPROX_UNIQUE_COUNT, O.APPROX_PERCENTILE)]
    aggs += [Aggregation("w", o, ("5d", None), k=2) for o in (O.HISTOGRAM, O.APPROX_FREQUENT_K, O.APPROX_HEAVY_HITTERS_K, O.UNIQUE_TOP_K)] + [Aggregation("v", O.SUM, ("5d", None), buckets=("b",)), Aggregation("v", O.APPROX_UNIQUE_COUNT, ("5d",), k=8), Aggregation("v", O.APPROX_PERCENTILE, ("5d",), k=64)]
    parts = parts_of(aggs)
    store = FolderStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # repeated writes change nothing
        store.bulk_put("g_batch", upload_rows(e, ["k"], parts, end))
        store.bulk_put("g_stream", stream_rows(e.where(F.col("ts") >= end), ["k"], parts))
    asked = [(k, end + h * hour + 77) for k in ("a", "b", "nobody") for h in (0, 3, 29)]
    got = WindowLookup(store, "g", e, ["k"], parts)([({"k": k}, t) for k, t in asked])
    q = spark.createDataFrame(asked, "k string, ts long")
    want = {(r.k, r.ts): r for r in lambda_merge(q, e, ["k"], parts, end).collect()}
    for (k, t), g in zip(asked, got, strict=True):
        r = want[k, t].asDict(recursive=True)
        for p in parts:
            a, b = g[p.name], r[p.name]
            if isinstance(b, float):
                assert a == pytest.approx(b, rel=1e-6), (k, t, p.name)
            elif p.operation in (O.APPROX_PERCENTILE,):
                assert (a is None) == (b is None)
            else:
                assert a == b, (k, t, p.name)


def test_lookups_of_a_table_equal_single_ones_and_leave_the_driver_alone(spark, tmp_path, tiny, monkeypatch):
    from millrace.serving import online

    rng, end = random.Random(13), 20_000 * 24 * HOUR
    data = [(rng.choice(["a", "b", "q\"c"]), 7, end - rng.randrange(-30 * HOUR, 200 * HOUR), rng.choice([None, 1.5, 2.0, -3.0]), rng.choice([None, "x", "y", 'z"'])) for _ in range(300)]
    e = spark.createDataFrame(data, "k string, n int, ts long, v double, w string")
    plain = [Aggregation("v", o, ("6h", "5d", None), k=2) for o in (O.SUM, O.COUNT, O.AVERAGE, O.LAST, O.LAST_K, O.VARIANCE)]
    others = [Aggregation("w", o, ("5d", None), k=2) for o in (O.HISTOGRAM, O.UNIQUE_COUNT, O.UNIQUE_TOP_K)] + [Aggregation("v", O.SUM, ("5d", None), buckets=("w",))]
    asked = [(k, 7, end + h * HOUR + 77) for k in ("a", "b", "q\"c", "nobody") for h in (0, 3, 29)]
    q = spark.createDataFrame([*asked, asked[0], (None, 7, end), ("a", 7, None)], "k string, n int, ts long")
    monkeypatch.setattr(online, "REQUESTS", 5)
    monkeypatch.setattr(online, "HELD", 2000)
    for name, parts in (("plain", parts_of(plain)), ("all", parts_of(plain + others))):
        store = FolderStore(spark, str(tmp_path / name))
        store.bulk_put("g_batch", online.upload_rows(e, ["k", "n"], parts, end))
        store.bulk_put("g_stream", online.stream_rows(e.where(F.col("ts") >= end), ["k", "n"], parts))
        lookup = online.WindowLookup(store, "g", e, ["k", "n"], parts)
        single = lookup([({"k": k, "n": n}, t) for k, n, t in asked])
        assert table(lookup.over(q), 3) == {key: tuple(value(g[p.name]) for p in parts) for key, g in zip(asked, single, strict=True)}

    def refuse(*_):
        raise AssertionError("the driver read the store")

    monkeypatch.setattr(online.WindowLookup, "__call__", refuse)
    monkeypatch.setattr(FolderStore, "multi_get", refuse)  # executors import the package anew
    QUERIES["lookups_merged"](spark, tiny)


def test_executors_write_in_batches_with_retries(spark, tmp_path):
    folder = str(tmp_path / "remote")

    def connect(folder=folder):
        import json as j
        import os
        import uuid

        from millrace.serving.kv import KVStore as Base

        class Files(Base):
            failed = False

            def create(self, dataset):
                os.makedirs(f"{folder}/{dataset}", exist_ok=True)

            def put(self, dataset, rows):
                if not Files.failed:
                    Files.failed = True
                    raise OSError("try again")
                with open(f"{folder}/{dataset}/{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(j.dumps(r) for r in rows))

            def get(self, dataset, key, start=None):
                return []

        return Files()

    store = RemoteStore(connect, batch=7, pause=0.01)
    store.bulk_put("d", spark.range(100).selectExpr("cast(id as string) as key", "'v' as value", "id as millis"))
    import json
    from pathlib import Path

    seen = [tuple(json.loads(x)) for f in Path(folder, "d").iterdir() for x in f.read_text().splitlines()]
    assert sorted(seen) == sorted((str(i), "v", i) for i in range(100))


def test_fetcher_answers_from_the_store(spark):
    store = MemoryStore()
    g = GroupBy("g", [EventSource("t", Query({"k": None, "v": None}))], ["k"], [Aggregation("v", O.SUM)])
    store.bulk_put("g", encoded(spark.createDataFrame([("a", 1.5), ("a", 2.5)], "k string, v_sum double").limit(1), ["k"], ["v_sum"], 5))
    join = Join("j", EventSource("l", Query({"who": None})), [JoinPart(g, {"who": "k"})], external_parts=[ExternalPart("x", {"s": "int"})], derivations=[Derivation("*", "*"), Derivation("twice", "g_v_sum * 2")])
    f = Fetcher(spark, store, {"j": join}, {"g": g}, {"x": lambda keys: {"s": 3}})
    assert f.fetch_join("j", {"who": "a"}) == {"g_v_sum": 1.5, "ext_x_s": 3, "twice": 3.0}
    assert "g_exception" in Fetcher(spark, store, {"j": Join("j", join.left, join.parts)}, {"g": g}).fetch_join("j", {})
    store.put("g", [("k", "new", 9), ("k", "old", 1), ("k", "newer", 9)])
    assert [(v.value, v.millis) for v in store.get("g", "k")] == [("old", 1), ("newer", 9)] and store.get("g", "k", 5)[0].value == "newer"


def test_lookup_equals_batch_before_the_query(spark):
    e = random_events(spark, 5)
    end = 8 * 24 * HOUR
    q = random_events(spark, 6, 40).select("k", "ts").where(F.col("ts") >= end)
    parts = parts_of([Aggregation("v", o, ("1d", "14d", None)) for o in (O.SUM, O.COUNT, O.MAX)])
    earlier = temporal_by_pairs(q.withColumn("ts", F.col("ts") - 1), e, ["k"], parts)
    same = {(k, t + 1): v for (k, t), v in table(earlier).items() if (t + 1) % 300_000}
    got = table(lambda_merge(q, e, ["k"], parts, end))
    assert {k: got[k] for k in same} == same


def test_log_is_flattened_by_schema(spark):
    log = spark.createDataFrame([('{"k":1}', '{"a":2}', 5, "h1"), ('{"k":2}', '{"b":"x"}', 6, "h2"), ('{"k":3}', "{}", 7, "h3")], "key string, value string, ts long, schema_hash string")
    log = log.withColumns({c: F.base64(F.col(c).cast("binary")) for c in ("key", "value")})
    assert sorted(tuple(r) for r in flatten_log(log, "k int", {"h1": "a int", "h2": "b string"}).select("k", "a", "b").collect()) == [(1, 2, None), (2, None, "x")]


def test_stream_to_store_and_late_rows(spark, tmp_path):
    src = tmp_path / "src"
    data = [(k, f"u{k % 2}", f"2024-01-01 00:{m:02d}:00", 1.0) for k, m in enumerate((0, 1, 2, 50))]
    spark.createDataFrame(data, "id int, u string, t string, v double").withColumn("event_time", F.to_timestamp("t")).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    store = MemoryStore()
    tiles.to_store(stream().withColumn("ms", F.unix_millis("event_time")), store, "raw", ["u"], ["v"], "ms", str(tmp_path / "c1")).awaitTermination()
    assert len(store.get("raw", '{"u":"u0"}')) == 2
    parts = parts_of([Aggregation("v", O.SUM, ("1h",))])
    tiles.to_store(tiles.tiled(stream(), ["u"], parts), store, "tiles", ["u"], ["v_sum__s"], "tile_start", str(tmp_path / "c2"), "update").awaitTermination()
    assert [v.value for v in store.get("tiles", '{"u":"u0"}')] == ['{"v_sum__s":2.0}']
    batch = tiles.tiled(spark.read.parquet(str(src)), ["u"], parts)
    merged = tiles.merged_tiles(batch, ["u"], parts, {"v": spark.read.parquet(str(src)).schema["v"].dataType})
    assert {r.u: r.v_sum for r in merged.collect()} == {"u0": 2.0, "u1": 2.0}


def test_entities_join_on_their_day(spark):
    left = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-02")], "k string, ds string")
    right = spark.createDataFrame([("a", "2024-01-02", 5), ("a", "2024-01-01", 9)], "k string, ds string, v int")
    g = GroupBy("g", [EntitySource("right", Query({"k": None, "v": None}))], ["k"])
    j = Join("j", EntitySource("left", Query({"k": None})), [JoinPart(g)])
    got = compute_join(Catalog(spark, {"left": left, "right": right}), j, PartitionRange("2024-01-02", "2024-01-02"))
    assert sorted((r.k, r.g_v) for r in got.collect()) == [("a", 5), ("b", None)]


def test_analyzer_finds_what_would_go_wrong(spark):
    from millrace.quality.analyzer import analyze, evaluate

    left = spark.createDataFrame([("a", 1_700_000_000_000), ("a", None), ("b", 5)], "k string, ts long").withColumn("ds", F.lit("2023-11-14"))
    right = spark.createDataFrame([(1, "2023-11-13", 1.0)], "k int, ds string, v double")
    c = Catalog(spark, {"left": left, "right": right, "fine": right.withColumn("k", F.lit("a"))})
    join = lambda t: Join("j", EventSource("left", Query({"k": None}, time_column="ts")), [JoinPart(GroupBy("g", [EventSource(t, Query({"k": None, "v": None}))], ["k"], [Aggregation("v", O.SUM, ("3d",))]))])
    days = PartitionRange("2023-11-14", "2023-11-14")
    assert "key k is string on the left, integer on the right" in evaluate(c, join("right"), days).errors[0]
    r = evaluate(c, join("fine"), days)
    assert not r.errors and r.schema["g_v_sum_3d"] == "double"
    r = analyze(c, join("fine"), days)
    assert r.errors == ["left: 1 of 3 times are no epoch milliseconds"] and any("fine lacks 3 of 4 days" in w for w in r.warnings)


def test_sensors_and_footers(spark, tmp_path):
    from millrace.sources.sensors import footer_stats, is_ready, recompute, wait

    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", None)], "ds string, v int")
    c = Catalog(spark, {"t": df})
    assert is_ready(c, "t", PartitionRange("2024-01-01", "2024-01-02")) and not is_ready(c, "t", PartitionRange("2024-01-01", "2024-01-03"))
    assert is_ready(c, "t", PartitionRange("2024-01-02", "2024-01-02"), time_column="ds") and is_ready(c, "t", None, trigger="v > 0") and not is_ready(c, "none_such", None)
    calls = []
    assert not wait(lambda: calls.append(1) or False, 3, 5, lambda s: calls.append(s)) and calls == [1, 5.0, 1, 5.0, 1]
    df.coalesce(1).write.parquet(str(tmp_path / "f"))
    assert sorted((r.column_name, r["rows"], r.nulls) for r in footer_stats(spark, str(tmp_path / "f")).collect()) == [("ds", 2, 0), ("v", 2, 1)]
    old = {"left": "1", "bootstrap": "1", "a": "1", "b": "1", "derivations": "1"}
    assert recompute(old, old) == set() and recompute(old, {**old, "a": "2"}) == {"a", "final"} and recompute(old, {**old, "left": "2"}) == {"a", "b", "final"}
    assert recompute(old, {**old, "c": "1"}) == {"final"} and recompute(old, {k: v for k, v in old.items() if k != "b"}) == {"b", "final"}


def test_bootstrap_columns_must_fit(spark):
    from millrace.plans.join import derived_from
    from millrace.spec import BootstrapPart

    left = spark.createDataFrame([(1, "a", 24 * HOUR + 5)], "id int, k string, ts long").withColumn("ds", F.lit("1970-01-02"))
    right = spark.createDataFrame([("a", 100, 2.0)], "k string, ts long, v double")
    boot = spark.createDataFrame([(1, "1970-01-02", 7.0, 1)], "id int, ds string, g_v_sum_1d double, other int")
    g = GroupBy("g", [EventSource("right", Query({"k": None, "v": None}, time_column="ts"))], ["k"], [Aggregation("v", O.SUM, ("1d",))])
    join = lambda *cols: Join("j", EventSource("left", Query({"id": None, "k": None}, time_column="ts")), [JoinPart(g)], row_ids=["id"], bootstrap_parts=[BootstrapPart("boot", Query({"id": None, **dict.fromkeys(cols)}))])
    c = Catalog(spark, {"left": left, "right": right, "boot": boot})
    days = PartitionRange("1970-01-02", "1970-01-02")
    assert [r.g_v_sum_1d for r in compute_join(c, join("g_v_sum_1d"), days).collect()] == [7.0]
    with pytest.raises(ValueError, match="other"):
        compute_join(c, join("g_v_sum_1d", "other"), days)
    assert derived_from("a_1 / nullif(b, 0)", ["a", "a_1", "b"]) == ["a_1", "b"]


def test_upload_answers_lookups(spark):
    from millrace.functions.columns import prefixed, snake_case_columns
    from millrace.serving.fetcher import upload

    right = spark.createDataFrame([("a", 100, 2.0), ("a", 24 * HOUR + 1, 4.0)], "k string, ts long, v double")
    g = GroupBy("g", [EventSource("right", Query({"k": None, "v": "v + length({{ start_date }}) - 10"}, time_column="ts"))], ["k"], [Aggregation("v", O.SUM, ("1d", "7d"))])
    store = MemoryStore()
    store.bulk_put("g", upload(Catalog(spark, {"right": right}), g, "1970-01-02"))
    assert Fetcher(spark, store, {}, {"g": g}).fetch_group_by("g", {"k": "a"}) == {"v_sum_1d": 4.0, "v_sum_7d": 6.0}
    assert '"keys": ["k"]' in store.get("g", "info")[0].value and store.get("g", "info")[0].millis == 48 * HOUR
    assert prefixed(snake_case_columns(spark.createDataFrame([(1, 2)], "userId int, refundAmt int")), "x", ["user_id"]).columns == ["user_id", "x_refund_amt"]
