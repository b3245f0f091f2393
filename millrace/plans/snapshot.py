"""Aggregates as of midnight: of events for every day, and of entity snapshots by their partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import DAY_MS, day_number, day_string
from millrace.plans.shapes import aggregate, join_groups, shapes
from millrace.spec import AggregationPart


def snapshot_events(events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], start: str, end: str, ts: str = "ts") -> DataFrame:
    """(keys, ds, parts) for each ds from start to end: aggregates over [ds + 1d - window, ds + 1d).

    Events are summed up by day once; a day's partials then serve every ds whose window holds it, so a row travels once
    whatever the number of windows and days. Rows in which every part is null are left out. Rows need a key that is not
    null and a ts.
    """
    keys = list(keys)
    spark = events.sparkSession
    first, last = spark.range(1).select(day_number(F.lit(start)), day_number(F.lit(end))).head()
    has_key = None
    for k in keys:
        has_key = F.col(k).isNotNull() if has_key is None else has_key | F.col(k).isNotNull()
    rows = events.where(has_key & F.col(ts).isNotNull()).withColumn("_day", F.floor(F.col(ts) / DAY_MS).cast("int"))
    longest = [p.window.millis for p in parts]
    reach = None if None in longest else max(longest) // DAY_MS - 1
    rows = rows.where(F.col("_day") <= last)
    if reach is not None:
        rows = rows.where(F.col("_day") >= first - reach)
    out = []
    for s in shapes(rows, [*keys, "_day"], parts, ts):
        tiles = s.tiles(s.frame, [*keys, "_day"])
        upto = F.lit(last) if reach is None else F.least(F.lit(last), F.col("_day") + reach)
        spread = tiles.withColumn("_out", F.explode(F.sequence(F.greatest(F.lit(first), F.col("_day")), upto)))
        within = lambda p: None if p.window.millis is None else F.col("_day") > F.col("_out") - p.window.millis // DAY_MS
        out.append(s.final(s.merge_tiles(spread, [*keys, "_out"], within), [*keys, "_out"]))
    if len(out) == 1:
        joined = out[0]
    else:
        base = out[0].select(*keys, "_out")
        for o in out[1:]:
            base = base.unionByName(o.select(*keys, "_out"))
        joined = join_groups(base.distinct(), out, [*keys, "_out"])
    some = F.coalesce(*[F.col(f"`{p.name}`").isNotNull() & F.lit(True) for p in parts][:1])
    for p in parts[1:]:
        some = some | F.col(f"`{p.name}`").isNotNull()
    return joined.where(some).select(*keys, day_string(F.col("_out")).alias("ds"), *[F.col(f"`{p.name}`") for p in parts])


def snapshot_entities(entities: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart] | None, ds: str = "ds", ts: str = "ts") -> DataFrame:
    """(keys, ds, parts) of entity rows by their partition; windows reach over ts in [ds + 1d - window, ds + 1d). Without
    parts the rows pass through."""
    if parts is None:
        return entities.drop(ts) if ts in entities.columns else entities
    end = (day_number(F.col(ds)) + 1).cast("long") * DAY_MS
    within = lambda p: None if p.window.millis is None else (F.col(ts) >= end - p.window.millis) & (F.col(ts) < end)
    return aggregate(entities, [*keys, ds], parts, within, ts)
