"""Checks of declarations against data before anything is computed: schemas, keys, times, availability, hot keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.dates import PartitionRange, shift
from millrace.functions.columns import DAY_MS
from millrace.plans.join import compute_part, left_frame, source_frame
from millrace.quality.stats import heavy_keys, timestamp_checks
from millrace.sources.tables import Catalog
from millrace.spec import EntitySource, EventSource, GroupBy, Join, JoinSource


@dataclass
class Report:
    """schema: output columns with types; errors stop a run, warnings do not."""

    schema: dict[str, str] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _plain(kind: T.DataType) -> str:
    return "integer" if isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType) else kind.simpleString()


def evaluate(catalog: Catalog, join: Join, days: PartitionRange | None = None) -> Report:
    """Dry run of a join: every expression is analyzed, nothing is read. Key types must agree, parts must find their keys on
    the left, and no two columns may share a name."""
    r = Report()
    try:
        left = left_frame(catalog, join, days)
    except Exception as e:
        r.errors.append(f"left: {str(e).splitlines()[0]}")
        return r
    r.schema = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    kinds = {f.name: f.dataType for f in left.schema.fields}
    for p in join.parts:
        name = p.group_by.name
        missing = [p.left_key(k) for k in p.group_by.keys if p.left_key(k) not in kinds]
        if missing:
            r.errors.append(f"{name}: left has no {missing}")
            continue
        if any(x.window.millis is None for x in p.group_by.parts()) and any(isinstance(s, EventSource) and not s.query.start_partition and not s.is_cumulative for s in p.group_by.sources):
            r.warnings.append(f"{name}: a window without bound reads all partitions; give its sources a start_partition")
        try:
            for s in p.group_by.sources:
                right = {f.name: f.dataType for f in source_frame(catalog, s, days).schema.fields}
                r.errors += [f"{name}: key {k} is {_plain(kinds[p.left_key(k)])} on the left, {_plain(right[k])} on the right" for k in p.group_by.keys if _plain(kinds[p.left_key(k)]) != _plain(right[k])]
            out, on = compute_part(catalog, left.limit(0), p, not isinstance(join.left, EntitySource), days or PartitionRange("2000-01-01", "2000-01-02"))
            for f in out.schema.fields:
                if f.name not in on:
                    if f.name in r.schema:
                        r.errors.append(f"{name}: column {f.name} exists twice")
                    r.schema[f.name] = f.dataType.simpleString()
        except Exception as e:
            r.errors.append(f"{name}: {str(e).splitlines()[0]}")
    return r


def availability(catalog: Catalog, g: GroupBy, days: PartitionRange) -> list[str]:
    """What is missing of the partitions that the group by's windows reach back to."""
    lengths = [p.window.millis for p in g.parts() if p.window.millis is not None]
    need = PartitionRange(shift(days.start, -(max(lengths, default=0) // DAY_MS)), days.end)
    out = []
    for s in g.sources:
        if isinstance(s, JoinSource):
            continue
        table = s.snapshot_table if isinstance(s, EntitySource) else s.table
        start = max(need.start, s.query.start_partition or need.start)
        have = set(catalog.partitions(table, s.query.partition_column))
        gone = [d for d in PartitionRange(start, need.end).partitions() if d not in have]
        if gone:
            out.append(f"{table} lacks {len(gone)} of {len(PartitionRange(start, need.end).partitions())} days, first {gone[0]}")
    return out


def analyze(catalog: Catalog, join: Join, days: PartitionRange, hot_share: float = 0.01) -> Report:
    """evaluate, and with data: times that cannot be epoch milliseconds are errors; null times, missing partitions and keys
    that hold more than hot_share of the left are warnings."""
    r = evaluate(catalog, join, days)
    if r.errors:
        return r
    left = left_frame(catalog, join, days)
    if "ts" in left.columns:
        t = timestamp_checks(left).head()
        if t.bad_ts:
            r.errors.append(f"left: {t.bad_ts} of {t['rows']} times are no epoch milliseconds")
        if t.null_ts:
            r.warnings.append(f"left: {t.null_ts} times are null")
    for k in sorted({p.left_key(k) for p in join.parts for k in p.group_by.keys}):
        n = heavy_keys(left, k, hot_share).count()
        if n:
            r.warnings.append(f"left: {n} values of {k} hold more than {hot_share:.0%} of the rows each")
    for p in join.parts:
        r.warnings += availability(catalog, p.group_by, days)
    return r


def sample(df: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """A share of the rows, for looking at; no operator uses it."""
    return df.sample(share, seed)


def readable_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(f"{ts}_text", F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd HH:mm:ss"))
