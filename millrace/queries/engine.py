"""Queries of sources, sinks, planning and declarations: what surrounds the computation of features."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.dates import PartitionRange, unfilled
from millrace.plans import planner, staging
from millrace.plans.derive import derive, derive_over_left
from millrace.plans.runner import JoinRunner, drop
from millrace.plans.join import compute_group_by, compute_join, derived_from, left_keys, source_frame
from millrace.plans.shapes import aggregate, parts_of
from millrace.quality import stats
from millrace.quality.analyzer import analyze, evaluate
from millrace.queries.features import MONTH, events, purchases, rounded
from millrace.runtime import read_table
from millrace.sources import sensors
from millrace.sources.tables import Catalog, DataPointer, Topic, export_table, load_folder
from millrace.spec import Aggregation, BootstrapPart, Derivation, EntitySource, EventSource, GroupBy, Join, JoinPart, Operation, Query, StagingQuery

O = Operation  # noqa: E741
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _table(spark: SparkSession) -> str:
    return f"millrace_{uuid.uuid4().hex[:12]}"


# --- sources and sinks


@query
def partitions_listed(spark, d):
    """Loads of users as a partitioned table lists them, from its metadata alone."""
    name = _table(spark)
    catalog = Catalog(spark)
    catalog.insert(read_table(spark, d, "users").where("ds is not null"), name)
    try:
        return _rows(spark, "ds string", [(x,) for x in catalog.partitions(name)])
    finally:
        spark.sql(f"DROP TABLE {name}")


@query
def partitions_of_time(spark, d):
    """Days of a table without partitions, between its first and last time, and the newest of them."""
    catalog = Catalog(spark, {"events": read_table(spark, d, "events")})
    newest = sensors.newest_time(catalog, "events", "ts")
    return _rows(spark, "ds string, newest boolean", [(x, x == newest) for x in catalog.virtual_partitions("events", "ts")])


@query
def sink_overwrites_partitions(spark, d):
    """users written, then its loads of February written again with a column more: other loads stay, their new column is null."""
    name = _table(spark)
    catalog = Catalog(spark)
    u = read_table(spark, d, "users").select("user_id", "email_verified", "ds")
    catalog.insert(u, name)
    catalog.insert(u.where("ds between '2024-02-01' and '2024-02-29'").withColumn("seen", F.col("user_id") % 7).distinct(), name)
    try:
        return runtime.persist_table(spark.table(name), "sink")
    finally:
        spark.sql(f"DROP TABLE {name}")


@query
def exported_and_loaded(spark, d):
    """events written as JSON lines and orders as CSV into a folder, and read back by the names of the files."""
    path = runtime.own_path(spark, "export")
    export_table(events(spark, d).select("event_id", "event_type", "value"), f"{path}/events.json", "json")
    export_table(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), f"{path}/orders.csv", "csv", header="true")
    e = load_folder(spark, path, "json")["events"].select(F.lit("events").alias("source"), F.col("event_type").alias("kind"), "value")
    o = load_folder(spark, path, "csv", header="true")["orders"].select(F.lit("orders").alias("source"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").cast("double").alias("value"))
    return e.unionByName(o).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query
def formatted_partitions(spark, d):
    """A range of loads from a table whose partitions are written yyyyMMdd under another name."""
    u = read_table(spark, d, "users").withColumn("day", F.replace("ds", F.lit("-"), F.lit(""))).drop("ds")
    q = Query({"user_id": None, "email_verified": None}, partition_column="day", partition_format="yyyyMMdd", wheres=["user_id is not null"])
    return Catalog(spark, {"users": u}).scan("users", q, None)


@query
def unfilled_steps(spark, d):
    """Days of the first quarter without a load of users, as ranges cut into steps of three days."""
    have = Catalog(spark, {"users": read_table(spark, d, "users")}).partitions("users")
    found = unfilled(PartitionRange("2024-01-01", "2024-03-31"), have, skip_first_hole=False)
    return _rows(spark, "first string, last string", [(s.start, s.end) for r in found for s in r.steps(3)])


@query
def pointers_and_topics(spark, d):
    pointers = ["my_db.my_table", "s3+parquet://bucket/path", "file://folder/table.csv", "delta(versionAsOf=3)://lake/table", "bigquery://project.set.table"]
    out = [("pointer", p, DataPointer.parse(p).location, DataPointer.parse(p).format or "") for p in pointers]
    for t in ("kafka://events/host=h/port=9", "pubsub://views/project=p", "clicks/serde=avro", "file://a//b/format=json"):
        parsed = Topic.parse(t)
        out.append(("topic", t, parsed.name, ",".join([parsed.bus, *[f"{k}={v}" for k, v in sorted(parsed.params.items())]])))
    return _rows(spark, "kind string, text string, name string, rest string", out)


@query
def footer_statistics(spark, d):
    """Rows and nulls of each column of users and item_views from their files' footers."""
    out = None
    for t in ("users", "item_views"):
        own = sensors.footer_stats(spark, f"{d}/{t}.parquet").groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls")).withColumn("table_name", F.lit(t))
        out = own if out is None else out.unionByName(own)
    return out.select("table_name", "column_name", "rows", "nulls")


@query
def sensors_ready(spark, d):
    catalog = Catalog(spark, {"users": read_table(spark, d, "users"), "events": read_table(spark, d, "events")})
    day = lambda a, b: PartitionRange(a, b)
    checks = {
        "exists": sensors.is_ready(catalog, "users", None), "missing": sensors.is_ready(catalog, "nowhere_at_all", None), "quarter": sensors.is_ready(catalog, "users", day("2024-01-01", "2024-03-31")),
        "time": sensors.is_ready(catalog, "events", day("2024-01-01", "2024-01-30"), time_column="ts"), "later": sensors.is_ready(catalog, "events", day("2024-01-01", "2024-06-30"), time_column="ts"),
        "trigger": sensors.is_ready(catalog, "users", None, trigger="email_verified = 1"),
    }
    return _rows(spark, "check string, ready boolean", list(checks.items()))


@query
def functions_of_users(spark, d):
    """A source whose setups declare a function that its selections use, and a run date."""
    q = Query({"user_id": None, "doubled": "millrace_doubled(value)", "run": "{{ end_date }}"}, time_column="ts", setups=["CREATE OR REPLACE TEMPORARY FUNCTION millrace_doubled(x DOUBLE) RETURNS DOUBLE RETURN x * 2"])
    out = source_frame(Catalog(spark, {"events": events(spark, d)}), EventSource("events", q), MONTH)
    return rounded(out.select("user_id", "ts", "doubled", "run"), 6)


# --- derivations, macros, listings


@query
def derivations_over_columns(spark, d):
    """Derived columns that the left side has already keep their values where they are not null; others are computed."""
    e = events(spark, d).select("event_id", "user_id", "value", F.when(F.col("event_id") % 3 == 0, F.lit(-1.0)).alias("halved"))
    return rounded(derive_over_left(e, [Derivation("halved", "value / 2"), Derivation("renamed", "value")], ["event_id", "user_id", "halved"], ["value"]))


@query
def derivations_renamed(spark, d):
    """`*` keeps what no other derivation takes over unchanged; a rename takes its column over."""
    e = events(spark, d).select("event_id", "value", "event_type")
    return rounded(derive(e, [Derivation("*", "*"), Derivation("kind", "event_type"), Derivation("more", "value + 1")], ensure=["event_id"]))


def _join(window: str = "7d", extra: Sequence[Derivation] = (), key: str = "user_id") -> Join:
    g = GroupBy("daily", [EventSource("events", Query({"user_id": None, "value": None}, time_column="ts"))], ["user_id"], [Aggregation("value", O.SUM, ("1d", window))])
    h = GroupBy("kinds", [EventSource("events", Query({"user_id": None, "event_type": None}, time_column="ts"))], ["user_id"], [Aggregation("event_type", O.LAST, ("7d",))])
    return Join("plan", EventSource("purchases", Query({"event_id": None, key: "user_id"}, time_column="ts")), [JoinPart(g, {key: "user_id"}), JoinPart(h, {key: "user_id"})], bootstrap_parts=[BootstrapPart("ready", Query({"event_id": None}), ["event_id"])], derivations=extra)


@query
def planned_steps(spark, d):
    """Steps of a join, and which of them run again after one window changed."""
    old, new = planner.plan_join(_join("7d", [Derivation("*", "*")])), planner.plan_join(_join("3d", [Derivation("*", "*")]))
    again = {n.output for n in planner.changed(old, new)}
    return _rows(spark, "step int, kind string, inputs int, again boolean", [(k, n.kind, len(n.inputs), n.output in again) for k, n in enumerate(new)])


@query
def recomputed_tables(spark, d):
    """Which tables are dropped after which edit."""
    base = {"left": "a", "bootstrap": "b", "p1": "c", "p2": "d", "derivations": "e"}
    edits = {"none": {}, "left": {"left": "x"}, "part": {"p2": "x"}, "derivation": {"derivations": "x"}, "bootstrap": {"bootstrap": "x"}}
    out = [(name, ",".join(sorted(sensors.recompute(base, {**base, **e})))) for name, e in edits.items()]
    out += [("removed", ",".join(sorted(sensors.recompute(base, {k: v for k, v in base.items() if k != "p1"})))), ("added", ",".join(sorted(sensors.recompute(base, {**base, "p3": "f"}))))]
    return _rows(spark, "edit string, dropped string", out)


@query
def hashes_compared(spark, d):
    """Which hashes an edit changes: of a part, of its columns, of the whole declaration."""
    a, b = _join("7d"), _join("3d")
    renamed = _join("7d", key="buyer")
    same = lambda x, y: x == y
    columns = lambda j: planner.column_hashes(j.parts[0].group_by)
    rows = [
        ("other part", same(planner.part_hash(a, 1), planner.part_hash(b, 1))), ("changed part", same(planner.part_hash(a, 0), planner.part_hash(b, 0))),
        ("kept column", same(columns(a)["value_sum_1d"], columns(b)["value_sum_1d"])), ("renamed key", same(planner.part_hash(a, 0), planner.part_hash(renamed, 0))),
        ("whole", same(staging.semantic_hash(a), staging.semantic_hash(b))), ("itself", same(staging.semantic_hash(a), staging.semantic_hash(_join("7d")))),
    ]
    return _rows(spark, "compared string, equal boolean", rows)


@query
def names_listed(spark, d):
    """Fields that expressions depend on, and the keys that a join needs on its left."""
    fields = ["value_sum_1d", "value_sum_7d", "event_type_last_7d"]
    out = [("depends", e, ",".join(derived_from(e, fields))) for e in ("value_sum_1d / value_sum_7d", "upper(event_type_last_7d)", "1 + 1", "value_sum_1")]
    out += [("keys", k, ",".join(left_keys(_join("7d", key=k)))) for k in ("user_id", "buyer")]
    return _rows(spark, "kind string, text string, names string", out)


@query
def dry_run_schema(spark, d):
    """Columns and types that a join will have, and how many errors and warnings its analysis over the data finds."""
    j = Join("j", EventSource("purchases", Query({"event_id": None, "user_id": None}, time_column="ts")), _join().parts)
    catalog = Catalog(spark, {"events": events(spark, d), "purchases": purchases(spark, d)})
    r = evaluate(catalog, j, MONTH)
    bad = evaluate(catalog, Join("j", EventSource("purchases", Query({"event_id": None}, time_column="ts")), j.parts), MONTH)
    found = analyze(catalog, j, MONTH)
    out = [(c, kind) for c, kind in r.schema.items()] + [("errors", str(len(r.errors) + len(found.errors))), ("errors without key", str(len(bad.errors)))]
    return _rows(spark, "column_name string, type string", out)


# --- sketches within their bounds


@query
def approx_unique_within(spark, d):
    """Per day: whether the sketch of distinct events is within 5 % of their number."""
    e = events(spark, d)
    a = aggregate(e, ["ds"], parts_of([Aggregation("event_id", O.APPROX_UNIQUE_COUNT, k=10)])).join(e.groupBy("ds").agg(F.count_distinct("event_id").alias("n")), "ds")
    return a.select("ds", "n", (F.abs(F.col("event_id_approx_unique_count") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


@query
def approx_percentile_within(spark, d):
    """Per kind of event: whether the sketch's quartiles have ranks within 3 % of what was asked for."""
    e = events(spark, d)
    q = aggregate(e, ["event_type"], parts_of([Aggregation("value", O.APPROX_PERCENTILE, k=200, percentiles=(0.25, 0.5, 0.75))])).withColumnRenamed("value_approx_percentile", "q")
    below = lambda k, op: F.avg((F.col("value").cast("float") < F.col("q")[k] if op == "<" else F.col("value").cast("float") <= F.col("q")[k]).cast("double"))
    ranks = e.where("value is not null").join(q, "event_type").groupBy("event_type").agg(*[c for k in range(3) for c in (below(k, "<").alias(f"l{k}"), below(k, "<=").alias(f"h{k}"))])
    near = lambda k, p: (F.col(f"l{k}") <= p + 0.03) & (F.col(f"h{k}") >= p - 0.03)
    return ranks.select("event_type", near(0, 0.25).alias("lower"), near(1, 0.5).alias("middle"), near(2, 0.75).alias("upper"))


@query
def sketch_drift_within(spark, d):
    """Distances between sketches of a column and itself, and of it and itself moved far away."""
    e = events(spark, d).where("value is not null").select("value")
    same, far = stats.sketch_distance(e, e, "value"), stats.sketch_distance(e, e.select((F.col("value") + 1e6).alias("value")), "value")
    return same.select(F.lit("same").alias("pair"), (F.col("largest") < 0.03).alias("near"), (F.col("psi") < 0.05).alias("stable")).unionByName(far.select(F.lit("far").alias("pair"), (F.col("largest") < 0.9).alias("near"), (F.col("psi") < 1).alias("stable")))


@query
def percentile_drift_within(spark, d):
    """Drift of the percentiles of values from each ten days to the next lies within what equal distributions give; that of
    values that jump in the middle of the month lies beyond it."""
    e = events(spark, d).where("value is not null")
    doubled = e.withColumn("value", F.when(F.col("ds") >= "2024-01-16", F.col("value") * 1000 + 1e6).otherwise(F.col("value")))
    drift = lambda x: stats.percentile_drift(stats.summarize(x, ["value"], tile_ms=864_000_000), 864_000_000)
    calm = drift(e).agg(F.max("drift").alias("x")).select(F.lit("calm").alias("series"), (F.col("x") < 3).alias("near"))
    return calm.unionByName(drift(doubled).agg(F.max("drift").alias("x")).select(F.lit("jump").alias("series"), (F.col("x") < 3).alias("near")))


@query
def entities_without_aggregation(spark, d):
    """The snapshot of an entity as it is, on each of its days."""
    g = GroupBy("u", [EntitySource("users", Query({"user_id": None, "email_verified": None}, wheres=["user_id is not null"]))], ["user_id"])
    u = read_table(spark, d, "users").distinct()
    return compute_group_by(Catalog(spark, {"users": u}), g, PartitionRange("2024-01-01", "2024-03-31"))


@query
def staging_backfilled(spark, d):
    """A staging query filled in step by step into its table, a second time without anything to do."""
    name = _table(spark)
    u = read_table(spark, d, "users")
    catalog = Catalog(spark, {"users": u})
    q = StagingQuery(name, "SELECT ds, count(*) AS n, count(email_verified) AS known FROM users WHERE ds BETWEEN {{ start_date }} AND {{ end_date }} GROUP BY ds", "2024-01-01")
    first = staging.backfill(catalog, q, "2024-03-31", ["users"], step_days=5)
    again = staging.backfill(catalog, q, "2024-03-31", ["users"], step_days=5)
    try:
        return runtime.persist_table(spark.table(name).withColumn("again", F.lit(len(again) > 0)).withColumn("steps", F.lit(len(first) > 0)), "staging")
    finally:
        spark.sql(f"DROP TABLE {name}")


@query
def join_run_in_steps(spark, d):
    """A join run over its tables: first half of the month, then all of it, then with a window more, for which the kept
    columns are taken over from the old table."""
    name = _table(spark)
    left = EventSource("purchases", Query({"event_id": None, "user_id": None}, time_column="ts"))
    g = lambda *w: GroupBy("daily", [EventSource("events", Query({"user_id": None, "value": None}, time_column="ts"))], ["user_id"], [Aggregation("value", O.SUM, w), Aggregation("value", O.COUNT, ("7d",))])
    j = lambda *w: Join(name, left, [JoinPart(g(*w))], derivations=[Derivation("*", "*"), Derivation("mean_7d", "daily_value_sum_7d / daily_value_count_7d")])
    catalog = Catalog(spark, {"events": events(spark, d), "purchases": purchases(spark, d)})
    runner = JoinRunner(catalog, j("7d"))
    runner.run(PartitionRange("2024-01-01", "2024-01-15"))
    runner.run(MONTH)
    again = JoinRunner(catalog, j("7d", "1d"))
    out = runtime.persist_table(rounded(again.run(MONTH).drop("ts_ds")), "join")
    drop(again)
    return out


@query
def reruns_of_a_join(spark, d):
    """A join's left side alone when every part is bootstrapped: the bootstrap decides all values."""
    ready = purchases(spark, d).select("event_id", "ds", F.lit(1.0).alias("daily_value_sum_1d"), F.lit(2.0).alias("daily_value_sum_7d"))
    left = EventSource("purchases", Query({"event_id": None, "user_id": None}, time_column="ts"))
    j = Join("j", left, [_join().parts[0]], row_ids=["event_id"], bootstrap_parts=[BootstrapPart("ready", Query({"event_id": None, "daily_value_sum_1d": None, "daily_value_sum_7d": None}))])
    out = compute_join(Catalog(spark, {"events": events(spark, d), "purchases": purchases(spark, d), "ready": ready}), j, MONTH)
    return rounded(out.select("event_id", "user_id", "daily_value_sum_1d", "daily_value_sum_7d"))
