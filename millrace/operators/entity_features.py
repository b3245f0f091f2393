"""Problem 6: one wide row per entity from events of hundreds of types.

Events combine by (entity, type) before anything is moved, so an entity with a third of all events is at most as many
rows as there are types. The runs are bucketed by entity and sorted by entity and type; each bucket is then streamed once,
and a row per entity leaves it without another shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime

#: Most types that become columns; beyond it the wide form is refused rather than cut.
MAX_TYPES = 5000
#: Entities per emitted batch of wide rows.
WIDE_ROWS = 512


def runs(events: DataFrame, entity: str, kind: str, time: str, amount: str) -> DataFrame:
    """(entity, kind, n, total, latest) bucketed by entity and sorted by (entity, kind) within each bucket.

    Null entities and kinds have no row; null amounts count as 0; null times do not count for `latest`, but their events
    do for n and total.
    """
    e = events.where(F.col(entity).isNotNull() & F.col(kind).isNotNull())
    r = e.groupBy(F.col(entity).alias("entity"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(amount, F.lit(0)).cast("long")).alias("total"), F.max(F.col(time).cast("long")).alias("latest")
    )
    return r.repartition(runtime.shuffle_partitions(events.sparkSession), "entity").sortWithinPartitions("entity", "kind")


def _whole_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The stream cut only between entities."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        ids = t.column("entity").to_numpy()
        if not len(ids):
            continue
        cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


LEADERS = "entity bigint, feature string, kind string"


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_entities(batches):
        ids = t.column("entity").to_numpy()
        starts = _starts(ids)
        kinds = t.column("kind").combine_chunks()
        lens = np.diff(np.r_[starts, len(ids)])
        out_e, out_f, out_k = [], [], []
        for feature, name in (("n", "count"), ("latest", "recency"), ("total", "total")):
            known = t.column(feature).is_valid().to_numpy()
            v = t.column(feature).fill_null(np.iinfo(np.int64).min).to_numpy()
            best = np.repeat(np.maximum.reduceat(v, starts), lens)
            at = np.where((v == best) & known, np.arange(len(v)), len(v))
            first = np.minimum.reduceat(at, starts)
            first = first[first < len(v)]
            out_e.append(ids[first])
            out_f.extend([name] * len(first))
            out_k.append(kinds.take(pa.array(first)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_e)), pa.array(out_f, pa.string()), pa.concat_arrays(out_k)], names=["entity", "feature", "kind"])


def leaders(events: DataFrame, entity: str, kind: str, time: str, amount: str) -> DataFrame:
    """(entity, feature, kind): of each entity the type with the most events (`count`), the latest time (`recency`; no row
    if the entity has no time) and the greatest total (`total`); ties go to the first type in order."""
    return runtime.map_arrow(runs(events, entity, kind, time, amount), _lead, LEADERS)


def column_names(kinds: Sequence[str]) -> list[str]:
    """Identifiers for types, in their order; types that would get the same one are numbered."""
    out: list[str] = []
    for k in kinds:
        name = base = re.sub(r"\W+", "_", k) or "blank"
        i = 2
        while name in out:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def _widen(kinds: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(kinds, pa.string())
        import pyarrow.compute as pc

        for t in _whole_entities(batches):
            ids = t.column("entity").to_numpy()
            starts = _starts(ids)
            kind = pc.index_in(t.column("kind").combine_chunks(), known).to_numpy(zero_copy_only=False)
            values = {f: (t.column(f).fill_null(0).to_numpy(), t.column(f).is_valid().to_numpy()) for f in ("n", "total", "latest")}
            for a in range(0, len(starts), WIDE_ROWS):
                own = starts[a : a + WIDE_ROWS]
                lo, hi = own[0], starts[a + WIDE_ROWS] if a + WIDE_ROWS < len(starts) else len(ids)
                row = np.searchsorted(own, np.arange(lo, hi), side="right") - 1
                arrays = [pa.array(ids[own])]
                for f in ("n", "total", "latest"):
                    v, ok = values[f]
                    cell, there = np.zeros((len(kinds), len(own)), np.int64), np.zeros((len(kinds), len(own)), bool)
                    cell[kind[lo:hi].astype(np.int64), row], there[kind[lo:hi].astype(np.int64), row] = v[lo:hi], ok[lo:hi]
                    if f == "latest":
                        arrays += [pa.array(cell[k], mask=~there[k]) for k in range(len(kinds))]
                    else:
                        arrays += [pa.array(cell[k]) for k in range(len(kinds))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def wide(events: DataFrame, entity: str, kind: str, time: str, amount: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """One row per entity: entity, count_*, total_* (0 without events) and latest_* (null without) for each type.

    kinds: the types that become columns, in order; by default all there are, sorted. More than MAX_TYPES are an error.
    """
    if kinds is None:
        found = events.where(F.col(kind).isNotNull()).select(F.col(kind).alias("k")).distinct().limit(MAX_TYPES + 1).collect()
        if len(found) > MAX_TYPES:
            raise ValueError(f"more than {MAX_TYPES} types")
        kinds = sorted(r.k for r in found)
    kinds = list(kinds)
    names = column_names(kinds)
    fields = [pa.field("entity", pa.int64()), *[pa.field(f"{f}_{n}", pa.int64()) for f in ("count", "total", "latest") for n in names]]
    ddl = ", ".join(f"`{f.name}` bigint" for f in fields)
    own = events.where(F.col(kind).isin(kinds)) if kinds else events.limit(0)
    return runtime.map_arrow(runs(own, entity, kind, time, amount), _widen(kinds, pa.schema(fields)), ddl)
