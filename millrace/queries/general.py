"""Queries of the general problems 1 to 7 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from millrace.functions import columns as C
from millrace.operators import bitemporal, entity_features, heavy_hitters, incremental, late_events, profile, rolling
from millrace.runtime import broadcast_if_small, own_path, persist_table, read_table

HOUSE_ACCOUNTS_BELOW = 10
LAST_DAY = 19_813  # 2024-03-31
SHARE = 0.005

RETURN_CONTENT = ["ts", "user_id", "product_id", "refund_amt", "type"]


def _returns(spark: SparkSession, d: str) -> DataFrame:
    """Raw checkouts under the names used here: key, ds, ts, user_id, product_id, refund_amt, type."""
    return read_table(spark, d, "checkouts").select(C.return_key("return_id").alias("key"), "ds", "ts", "user_id", "product_id", "refund_amt", C.clean_label("return_type").alias("type"))


def _newest_returns(spark: SparkSession, d: str, *content: str, persons: bool = False) -> DataFrame:
    """Returns in newest version with millis, the event time. A return's user is that of its newest version, so persons
    are told apart after that."""
    r = _returns(spark, d).withColumn("millis", C.event_millis("ts"))
    r = C.newest_version(r, ["key"], "ds", content)
    return r.where(F.col("user_id") >= HOUSE_ACCOUNTS_BELOW) if persons else r


def _record_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the records of both tables: table_name, record_key (as bytes), load (day as a number), content (digest),
    done. The digits of a return are packed two to a byte behind a mark of their parity, as all versions are shuffled."""
    done = broadcast_if_small(persist_table(_done_loads(spark, d), "done-loads"))
    digits = F.col("key")
    packed = F.unhex(F.when(F.length(digits) % 2 == 0, F.concat(F.lit("00"), digits)).otherwise(F.concat(F.lit("1"), digits)))
    returns = _returns(spark, d).select(F.lit("checkouts").alias("table_name"), packed.alias("record_key"), "ds", C.fingerprint([F.col(c) for c in RETURN_CONTENT]).alias("content"))
    u = read_table(spark, d, "users").where("user_id is not null")
    users = u.select(F.lit("users").alias("table_name"), F.col("user_id").cast("string").cast("binary").alias("record_key"), "ds", C.fingerprint([F.col("account_created_ds"), F.col("email_verified")]).alias("content"))
    return returns.unionByName(users).join(done.withColumn("done", F.lit(True)), ["table_name", "ds"], "left").select("table_name", "record_key", C.day_number(F.col("ds")).alias("load"), "content", F.coalesce("done", F.lit(False)).alias("done"))


def _done_loads(spark: SparkSession, d: str) -> DataFrame:
    loads = [read_table(spark, d, t).select(F.lit(t).alias("table_name"), "ds").distinct() for t in ("checkouts", "users")]
    return incremental.processed_loads(loads[0].unionByName(loads[1]), "ds", read_table(spark, d, "run_log"))


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, record_key as text, change) of the next run."""
    found = incremental.pending_changes(_record_versions(spark, d), ["table_name", "record_key"], "load", ["content"], "done")
    digits = F.lower(F.hex("record_key"))
    text = F.when(F.col("table_name") == "users", F.col("record_key").cast("string")).otherwise(F.when(digits.startswith("0"), F.substring(digits, 3, 1 << 30)).otherwise(F.substring(digits, 2, 1 << 30)))
    return found.select("table_name", text.alias("record_key"), "change")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d).where("change <> 'removed'").select("table_name", "record_key")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each table are new or changed."""
    return _changed(spark, d).groupBy("table_name", "change").agg(F.count(F.lit(1)).alias("records"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    r = _returns(spark, d).withColumn("period", C.epoch_day(C.event_millis("ts"))).where("period is not null")
    return late_events.adjustments(r, ["key"], "ds", "period", "refund_amt")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    adjusted = persist_table(_arrivals(spark, d), "adjustments")
    state = persist_table(late_events.multiset(adjusted), "multiset")
    late = late_events.late_arrivals(adjusted, state, ["key"])
    return late.select(F.col("key").alias("return_id"), C.day_string(F.col("period")).alias("event_ds"), "verdict")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Refund figures of each event day after each load that changed it."""
    a = late_events.corrected_aggregates(persist_table(late_events.multiset(_arrivals(spark, d)), "multiset"))
    return a.select(
        C.day_string(F.col("period")).alias("event_ds"), C.day_string(F.col("as_of")).alias("as_of_ds"), "records", F.col("total").alias("refund_total"), F.col("median").alias("refund_median"),
        F.col("distincts").alias("refund_distincts"), F.col("lowest").alias("refund_lowest"), F.col("highest").alias("refund_highest"),
    )


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    """State of all days from a store: the days up to the last month as one span, then that month carried on from it."""
    r = _newest_returns(spark, d, "user_id", "refund_amt", "millis", persons=True).withColumn("day", C.epoch_day(F.col("millis")))
    daily = persist_table(rolling.daily_amounts(r, "user_id", "day", "refund_amt"), "daily")
    store = rolling.RollingStore(spark, own_path(spark, "rolling"))
    for last in (LAST_DAY - 31, LAST_DAY):
        store.extend(daily, last)
    found = store.state()
    return rolling.advance(None, daily, LAST_DAY, LAST_DAY).limit(0) if found is None else found


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.first_peak(_rolling(spark, d)).select(F.col("entity").alias("user_id"), "window_days", C.day_string(F.col("day")).alias("ds"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of every user, day and window, days without returns included."""
    days = rolling.every_day(_rolling(spark, d))
    return days.select(F.col("entity").alias("user_id"), "window_days", C.day_string(F.col("day")).alias("ds"), F.col("total").alias("refund_total"), F.col("n").alias("returns"), F.round("average", 6).alias("refund_average"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of all columns of checkouts and users per load."""
    checks = {"refund_amt": F.expr("try_cast(value as bigint) not between 0 and 10000"), "email_verified": ~F.col("value").isin("0", "1"), "account_created_ds": ~C.valid_date(F.col("value"))}
    parts = []
    for table, numeric in (("checkouts", ["refund_amt"]), ("users", [])):
        t = read_table(spark, d, table)
        cols = [c for c in t.columns if c != "ds"]
        counts = profile.value_counts(t, "ds", cols)
        parts.append(profile.profile(counts, {c: x for c, x in checks.items() if c in cols}, numeric).withColumn("table_name", F.lit(table)))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    profiled = persist_table(_profiles(spark, d), "profiles")
    odd = profile.odd_loads(profiled.withColumn("column_name", F.concat_ws(".", "table_name", "column_name")))
    named = odd.select(F.split_part("column_name", F.lit("."), F.lit(1)).alias("table_name"), F.split_part("column_name", F.lit("."), F.lit(2)).alias("column_name"), F.col("load").alias("ds"))
    asked = (F.col("table_name") == "checkouts") & (F.col("column_name") == "refund_amt") | (F.col("table_name") == "users") & F.col("column_name").isin("account_created_ds", "email_verified")
    return named.where(asked).distinct()


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Exact profile of every column of both tables per load."""
    return _profiles(spark, d).select("table_name", "column_name", F.col("load").alias("ds"), "rows", "nulls", "distincts", "lowest", "highest", "invalid", "top", "median")


def p4_stability(spark: SparkSession, d: str) -> DataFrame:
    """Each load's distribution of every column of both tables against all loads."""
    parts = []
    for table in ("checkouts", "users"):
        t = read_table(spark, d, table)
        counts = persist_table(profile.value_counts(t, "ds", [c for c in t.columns if c != "ds"]), "value-counts")
        parts.append(profile.stability(counts).withColumn("table_name", F.lit(table)))
    return parts[0].unionByName(parts[1]).select("table_name", "column_name", F.col("load").alias("ds"), F.round("psi", 6).alias("psi"), F.round("chi_square", 4).alias("chi_square"), "cells")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.above_share(read_table(spark, d, "checkouts"), ["product_id", "user_id"], SHARE).select("column_name", "item_value")


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent products and users with bounds of their counts, from the sketch alone."""
    return heavy_hitters.most_frequent(read_table(spark, d, "checkouts"), ["product_id", "user_id"], 50)


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each column's 50 items from the sketch alone: whether the bounds hold for all, and whether the ten that are most
    frequent by exact counts are among them."""
    c = read_table(spark, d, "checkouts")
    sketched = persist_table(heavy_hitters.most_frequent(c, ["product_id", "user_id"], 50), "sketched")
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).alias("item_value")) for x in ("product_id", "user_id")]))
    exact = persist_table(c.select(cells.alias("x")).select("x.*").where("item_value is not null").groupBy("column_name", "item_value").agg(F.count(F.lit(1)).alias("n")), "exact-counts")
    best = exact.groupBy(F.col("column_name").alias("c")).agg(InternalFunction.collect_top_k(F.col("n"), 10, False).alias("best")).select("c", F.array_min("best").alias("tenth"))
    both = exact.join(F.broadcast(sketched), ["column_name", "item_value"], "left").join(F.broadcast(best), F.col("column_name") == F.col("c"))
    held = F.coalesce((F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high")), F.lit(True))
    return both.groupBy("column_name").agg(F.count("low").alias("items"), F.bool_and(held).alias("within"), F.bool_and((F.col("n") <= F.col("tenth")) | F.col("low").isNotNull()).alias("none_missing"))


def _typed_returns(spark: SparkSession, d: str) -> DataFrame:
    r = _newest_returns(spark, d, "user_id", "refund_amt", "millis", "type", persons=True)
    return r.where("millis is not null and type is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lead = entity_features.leaders(_typed_returns(spark, d), "user_id", "type", "millis", "refund_amt")
    return lead.select(F.col("entity").alias("user_id"), "feature", F.col("kind").alias("return_type"))


def p6_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per user with count, total and latest time of each return type."""
    kinds = read_table(spark, d, "checkouts").select(C.clean_label("return_type").alias("k")).where("k is not null").distinct()
    found = kinds.limit(entity_features.MAX_TYPES + 1).collect()
    if len(found) > entity_features.MAX_TYPES:
        raise ValueError("too many return types for columns")
    return entity_features.wide(_typed_returns(spark, d), "user_id", "type", "millis", "refund_amt", sorted(r.k for r in found)).withColumnRenamed("entity", "user_id")


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Returns of persons with what users held for them at event time: key, day, seen_day, known_day, email_verified,
    newest_email_verified; null where nothing was known, for returns without event time and for persons without users row.
    What is asked for is what held on the event day (day) as known on that day (seen_day)."""
    u = read_table(spark, d, "users").where(F.col("user_id") >= HOUSE_ACCOUNTS_BELOW).select("user_id", C.day_number(F.col("ds")).alias("load_day"), "email_verified")
    rects = bitemporal.rectangles(u, "user_id", "load_day", ["email_verified"])
    loads = u.agg(F.min("load_day"), F.max("load_day")).first()
    newest = _newest_returns(spark, d, "user_id", "millis", persons=True).withColumn("day", C.epoch_day(F.col("millis")))
    points = persist_table(newest.select("key", F.col("user_id").alias("who"), "day", F.col("day").alias("seen_day")), "points")
    return bitemporal.locate(points, "who", "day", "seen_day", rects, (loads[0] or 0, loads[1] or 0), ["key"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cases = _known(spark, d).where(F.col("day").isNotNull() & ~F.col("email_verified").eqNullSafe(F.col("newest_email_verified")))
    return cases.select(F.col("key").alias("return_id"), F.coalesce(C.day_string(F.col("known_day")), F.lit("none")).alias("known_ds"))


def p7_known(spark: SparkSession, d: str) -> DataFrame:
    """Every return of a person that has an event time, with the email_verified known then."""
    return _known(spark, d).where("day is not null").select(F.col("key").alias("return_id"), C.day_string(F.col("known_day")).alias("known_ds"), "email_verified")


def p7_returns(spark: SparkSession, d: str) -> DataFrame:
    """Every return of a person with the email_verified known at its event time, null where nothing was known: no users row
    by then or at all, or no event time."""
    return _known(spark, d).select(F.col("key").alias("return_id"), C.day_string(F.col("known_day")).alias("known_ds"), "email_verified")


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p2_found, p2_daily, p3_found, p3_rolling, p4_found, p4_profile, p4_stability, p5_found, p5_top, p5_bounds, p6_found, p6_features, p7_found, p7_known, p7_returns)}
