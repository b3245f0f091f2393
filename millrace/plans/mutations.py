"""Point-in-time aggregates over entities that change during the day.

The state of a key at ts is the snapshot of the day before plus the day's mutations recorded before ts. A mutation with
is_before takes its row back: operations that can (count, sum, average, histogram) subtract it, others ignore it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import DAY_MS, day_number
from millrace.plans.shapes import Shape, join_groups, shapes
from millrace.plans.temporal import _tail
from millrace.spec import AggregationPart, Operation

_SIGNED = (Operation.COUNT, Operation.SUM, Operation.AVERAGE)


def _signed(s: Shape, p: AggregationPart, value: Column, sign: Column, ts: Column, wrap=lambda c: c) -> dict[str, Column]:
    if s.mode == "value" or p.operation == Operation.COUNT:
        return {"n": wrap(F.sum(F.when(value.isNotNull(), sign)))}
    if p.operation in _SIGNED:
        total = {"s": wrap(F.sum(value * sign))}
        return total if p.operation == Operation.SUM else {**total, "n": wrap(F.sum(F.when(value.isNotNull(), sign)))}
    return s.op(p).partial(F.when(sign > 0, value), ts, wrap)


def temporal_entities(queries: DataFrame, snapshot: DataFrame, mutations: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts", mutation_ts: str = "mutation_ts", is_before: str = "is_before") -> DataFrame:
    """(keys, ts, parts) for each distinct query without nulls.

    snapshot: rows with keys, ts, ds; mutations: the same with mutation_ts and is_before. A row counts if its ts is before
    the query's and inside the window; a mutation must be recorded strictly before the query. Each query is judged by
    itself. A count of rows that were all taken back is 0, a count of nothing is null.
    """
    keys = list(keys)
    q = queries.select(*keys, ts).dropna().distinct().withColumn("_day", F.floor(F.col(ts) / DAY_MS).cast("int"))
    snap = snapshot.withColumn("_day", day_number(F.col("ds")) + 1).withColumns({"_sign": F.lit(1), "_at": F.lit(None).cast("long")})
    muts = mutations.withColumn("_day", day_number(F.col("ds"))).withColumns({"_sign": F.when(F.coalesce(F.col(is_before), F.lit(False)), -1).otherwise(1), "_at": F.col(mutation_ts).cast("long")})
    cols = list(dict.fromkeys([*keys, ts, *[c for p in parts for c in (p.input_column, p.bucket) if c]]))
    log = snap.select(*cols, "_day", "_sign", "_at").unionByName(muts.where(F.col(mutation_ts).isNotNull()).select(*cols, "_day", "_sign", "_at")).dropna(subset=keys)
    results = []
    for window in dict.fromkeys(p.window for p in parts):
        own, asked, by = [p for p in parts if p.window == window], q, ["_day"]
        rows = log
        if window.millis is not None:
            # Within a day the window's far end stands on few instants of its grid. Each gets its own running aggregate.
            asked, by = q.withColumn("_tail", _tail(own[0], F.col(ts))), ["_day", "_tail"]
            rows = log.join(asked.select(*keys, *by).distinct(), [*keys, "_day"]).where(F.col(ts) >= F.col("_tail"))
        results += [_running(s, asked, keys, by, ts) for s in shapes(rows, [*keys, *by, "_sign", "_at"], own, ts)]
    return join_groups(q.select(*keys, ts), results, [*keys, ts]).select(*keys, ts, *[F.col(f"`{p.name}`") for p in parts])


def _finish(s: Shape, merged: DataFrame, by: list[str]) -> DataFrame:
    """As Shape.final, with real zeros of counts kept and emptied buckets left out."""
    plain = s.mode == "plain"
    if plain and any(p.operation == Operation.COUNT for p in s.parts):
        counts = {p.name: F.col(f"`{p.name}__n`") for p in s.parts if p.operation == Operation.COUNT}
        out = s.final(merged.select("*", *[c.alias(f"_n_{n}") for n, c in counts.items()]), by) if len(counts) < len(s.parts) else merged.select(*by)
        zeros = merged.select(*by, *[c.alias(n) for n, c in counts.items()])
        return join_groups(out.drop(*counts), [zeros], by)
    return s.final(merged, by)


def _running(s: Shape, q: DataFrame, keys: list[str], by: list[str], ts: str) -> DataFrame:
    """Rows count for a query from the later of their own ts and their recording on: they enter a running aggregate there,
    within each key and `by`, and queries read what is before them. One sorted pass serves all queries of a key's day."""
    enter = F.greatest(F.coalesce(F.col("_at"), F.lit(-(2**62)).cast("long")), F.col(ts))
    log = s.frame.where(F.col(ts).isNotNull()).withColumn("_enter", enter).withColumn("_q", F.lit(False))
    w = Window.partitionBy(*keys, *by, *s.extra).orderBy("_enter").rangeBetween(Window.unboundedPreceding, -1)
    value = lambda p: F.when(~F.col("_q"), F.col("_extra") if s.mode == "value" else F.col(f"`{p.input_column}`"))
    asked = q.withColumn("_enter", F.col(ts)).withColumn("_q", F.lit(True)).withColumn("_sign", F.lit(0))
    if s.extra:  # every bucket of the key's day answers every query of it
        asked = asked.join(s.frame.select(*keys, *by, *s.extra).distinct(), [*keys, *by])
    seen = log.unionByName(asked, allowMissingColumns=True)
    cols = [c.alias(f"{p.name}__{n}") for p in s.parts for n, c in _signed(s, p, value(p), F.col("_sign"), F.col(ts), lambda c: c.over(w)).items()]
    running = seen.select(*keys, ts, *s.extra, "_q", *cols).where("_q").drop("_q")
    if s.mode != "plain":
        first = F.col(f"`{s.parts[0].name}__n`") if f"{s.parts[0].name}__n" in running.columns else None
        running = running.where(first > 0) if first is not None else running
    return _finish(s, running, [*keys, ts])
