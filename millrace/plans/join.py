"""From declarations to DataFrames: sources, group bys and joins of their parts to a left side."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.dates import PartitionRange, render, shift
from millrace.functions.columns import DAY_MS
from millrace.plans.derive import coalesced_join, derive, derive_over_left, without_skew
from millrace.plans.mutations import temporal_entities
from millrace.plans.snapshot import snapshot_entities, snapshot_events
from millrace.plans.temporal import temporal_events
from millrace.sources.tables import Catalog
from millrace.spec import Accuracy, BootstrapPart, EntitySource, EventSource, GroupBy, Join, JoinPart, JoinSource, Source


def source_frame(catalog: Catalog, source: Source, days: PartitionRange | None, mutations: bool = False) -> DataFrame:
    """Rows of a source with `ts` (epoch milliseconds) and, where the table has it, `ds`.

    Events without a time column stand at the last millisecond of their ds. A cumulative source is read in its newest
    partition only. The output of a join can be a source.
    """
    q = source.query
    if days is not None:  # expressions may use the date macros of staging queries
        fill = lambda text: render(text, days, days.end) if text and "{{" in text else text
        q = replace(q, selects={k: fill(v) for k, v in q.selects.items()}, wheres=[fill(w) for w in q.wheres])
    for s in q.setups:
        catalog.spark.sql(s)
    if isinstance(source, JoinSource):
        name = f"_join_{source.join.name}"
        inner = Catalog(catalog.spark, {**catalog.tables, name: compute_join(catalog, source.join, days)})
        return source_frame(inner, EventSource(name, q), days)
    table = (source.mutation_table if mutations else source.snapshot_table) if isinstance(source, EntitySource) else source.table
    if isinstance(source, EventSource) and source.is_cumulative:
        newest = max(catalog.partitions(table, q.partition_column), default=None)
        days = PartitionRange(newest, newest) if newest else days
    elif days is not None and q.start_partition:
        days = PartitionRange(max(days.start, q.start_partition), days.end)
    if days is not None and q.end_partition:
        days = PartitionRange(days.start, min(days.end, q.end_partition))
    fills = {"ts": q.time_column or (f"(unix_date(to_date({q.partition_column})) + 1L) * {DAY_MS} - 1")}
    if isinstance(source, EntitySource) and not q.time_column:
        fills = {}
    if mutations:
        fills |= {"mutation_ts": q.mutation_time_column or "mutation_ts", "is_before": q.reversal_column or "is_before"}
    return catalog.scan(table, q, days, fills)


def group_by_rows(catalog: Catalog, g: GroupBy, days: PartitionRange | None, mutations: bool = False) -> DataFrame:
    """All sources of a group by, columns aligned by name; rows all of whose keys are null are left out."""
    frames = [source_frame(catalog, s, days, mutations) for s in g.sources]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.where(reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in g.keys]))


def reach(g: GroupBy, days: PartitionRange, first: str | None = None) -> PartitionRange | None:
    """Partitions of events that windows of `days` look back to; None for all."""
    lengths = [p.window.millis for p in g.parts()]
    if None in lengths or not lengths:
        return PartitionRange(first or "0001-01-01", days.end)
    return PartitionRange(shift(days.start, -(max(lengths) // DAY_MS) - 1), days.end)


def compute_group_by(catalog: Catalog, g: GroupBy, days: PartitionRange) -> DataFrame:
    """Snapshot of a group by for each day: (keys, ds, features), with its derivations."""
    if all(isinstance(s, EntitySource) for s in g.sources):
        rows = group_by_rows(catalog, g, days)
        out = snapshot_entities(rows, g.keys, g.parts() if g.aggregations is not None else None)
    else:
        out = snapshot_events(group_by_rows(catalog, g, reach(g, days)), g.keys, g.parts(), days.start, days.end)
    return derive(out, g.derivations, ensure=[*g.keys, "ds"])


def compute_part(catalog: Catalog, left: DataFrame, part: JoinPart, left_events: bool, days: PartitionRange) -> tuple[DataFrame, list[str]]:
    """Features of one part with the left's key names and prefixed columns, and the columns to join on."""
    g = part.group_by
    keys = list(g.keys)
    names = {k: part.left_key(k) for k in keys}
    entities = all(isinstance(s, EntitySource) for s in g.sources)
    if left_events and g.inferred_accuracy == Accuracy.TEMPORAL:
        queries = left.select(*[F.col(names[k]).alias(k) for k in keys], "ts")
        if entities:
            yesterday = days.shifted(-1)
            snap = group_by_rows(catalog, g, PartitionRange(yesterday.start, days.end))
            out = temporal_entities(queries, snap, group_by_rows(catalog, g, days, mutations=True), keys, g.parts())
        else:
            out = temporal_events(queries, group_by_rows(catalog, g, reach(g, days)), keys, g.parts())
        out, on = derive(out, g.derivations, ensure=[*keys, "ts"]), [*keys, "ts"]
    else:
        # Events on the left see the state of the midnight before them: ds of the day before, shifted onto their day.
        wanted = days.shifted(-1) if left_events else days
        out = compute_group_by(catalog, g, wanted)
        if left_events:
            out = out.withColumn("ts_ds", F.date_add(F.to_date("ds"), 1).cast("string")).drop("ds")
            on = [*keys, "ts_ds"]
        else:
            on = [*keys, "ds"]
        if "ts" in out.columns:
            out = out.drop("ts")
    prefix = part.column_prefix()
    out = out.select(*[F.col(c).alias(names.get(c, c)) for c in on], *[F.col(f"`{c}`").alias(prefix + c) for c in out.columns if c not in on])
    return out, [names.get(c, c) for c in on]


def left_frame(catalog: Catalog, join: Join, days: PartitionRange | None) -> DataFrame:
    """Left rows without skewed keys; `ts_ds`, the day of ts, for events."""
    left = without_skew(source_frame(catalog, join.left, days), join.skew_keys)
    if isinstance(join.left, EntitySource):
        return left
    return left.withColumn("ts_ds", F.date_from_unix_date(F.floor(F.col("ts") / DAY_MS).cast("int")).cast("string"))


def _bootstrap_keys(join: Join, part: BootstrapPart) -> list[str]:
    keys = list(part.key_columns or join.row_ids)
    if not keys:
        raise ValueError("a bootstrap part needs key columns or the join's row ids")
    return [*keys, *[c for c in ("ds",) if c not in keys]]


def bootstrap(catalog: Catalog, join: Join, left: DataFrame, days: PartitionRange | None) -> tuple[DataFrame, dict[str, set[str]]]:
    """left with the columns of its bootstrap tables (the first table that has a row wins, of a table's rows of one key the last in order) and `matched_hashes`, the tables
    that matched each row; and for each table's hash the columns it provides."""
    provided: dict[str, set[str]] = {}
    out = left.withColumn("matched_hashes", F.array().cast("array<string>"))
    for b in join.bootstrap_parts:
        h = hashlib.md5(repr(b).encode()).hexdigest()[:12]
        keys = [k for k in _bootstrap_keys(join, b) if k in left.columns]
        table = catalog.scan(b.table, b.query, days).drop("ts")
        keys = [k for k in keys if k in table.columns]
        rest = [c for c in table.columns if c not in keys]
        # Of several rows of one key the one whose values come last in order counts, in every run.
        order = F.to_json(F.struct(*rest)) if rest else F.lit("")
        rows = table.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), order).alias("_row"))
        rows = rows.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        provided[h] = {c for c in rows.columns if c not in keys}
        out = coalesced_join(out, rows.withColumn("_hit", F.lit(True)), keys)
        out = out.withColumn("matched_hashes", F.when(F.col("_hit"), F.array_append("matched_hashes", F.lit(h))).otherwise(F.col("matched_hashes"))).drop("_hit")
    return out, provided


def check_bootstrap(provided: dict[str, str], fields: dict[str, str]) -> None:
    """Every column that a bootstrap table provides must be a field of the join, of the same type."""
    wrong = [f"{c} ({kind}, the join has {fields.get(c, 'no such field')})" for c, kind in provided.items() if fields.get(c) != kind]
    if wrong:
        raise ValueError(f"bootstrap columns do not fit: {', '.join(wrong)}")


def derived_from(expression: str, fields: Sequence[str]) -> list[str]:
    """Fields whose names occur in an expression as identifiers."""
    words = set(re.findall(r"[A-Za-z_]\w*", expression))
    return [f for f in fields if f in words]


def compute_join(catalog: Catalog, join: Join, days: PartitionRange | None) -> DataFrame:
    """The left side with the features of every part, external columns (null offline) and derivations.

    Every left row stays, whatever its keys. Rows whose bootstrap tables already provide all columns of a part are not
    computed for it.
    """
    left = left_frame(catalog, join, days)
    base_columns = list(left.columns)
    events = not isinstance(join.left, EntitySource)
    if days is None:
        column = "ts_ds" if events else "ds"
        lo, hi = left.agg(F.min(column), F.max(column)).head()
        days = PartitionRange(lo or "1970-01-02", hi or "1970-01-02")
    provided: dict[str, set[str]] = {}
    out = left
    if join.bootstrap_parts:
        out, provided = bootstrap(catalog, join, left, days)
    probes = [compute_part(catalog, left, p, events, days) for p in join.parts] if provided else []
    if provided:
        fields = {f.name: f.dataType.simpleString() for probe, _ in probes for f in probe.schema.fields}
        fields |= {f"ext_{e.source}_{n}": kind for e in join.external_parts for n, kind in e.columns.items()}
        fields |= {f.name: f.dataType.simpleString() for f in left.schema.fields}
        derived = {d.name for d in join.derivations}
        check_bootstrap({f.name: f.dataType.simpleString() for f in out.schema.fields if any(f.name in c for c in provided.values()) and f.name not in derived}, fields)
    for k, part in enumerate(join.parts):
        asked = out
        if provided:
            probe, on = probes[k]
            fields = {c for c in probe.columns if c not in on}
            covering = [h for h, cols in provided.items() if fields <= cols]
            if covering:
                asked = out.where(~F.arrays_overlap("matched_hashes", F.array(*[F.lit(h) for h in covering])))
        features, on = compute_part(catalog, asked, part, events, days)
        if not on:
            raise ValueError("a part needs keys")
        out = coalesced_join(out, features, on)
    for e in join.external_parts:
        for name, kind in e.columns.items():
            out = out.withColumn(f"ext_{e.source}_{name}", F.lit(None).cast(kind))
    if join.derivations:
        out = derive_over_left(out, join.derivations, base_columns, [c for c in out.columns if c not in base_columns and c != "matched_hashes"])
    return out.drop("matched_hashes")


def left_keys(join: Join) -> Sequence[str]:
    return sorted({p.left_key(k) for p in join.parts for k in p.group_by.keys})
