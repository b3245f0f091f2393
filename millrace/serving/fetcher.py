"""Lookups that merge what batch summed up with what streamed in since."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dates import PartitionRange
from millrace.functions.columns import DAY_MS
from millrace.plans.join import compute_group_by
from millrace.plans.shapes import Shape, join_groups, shapes
from millrace.plans.temporal import BIN, floor_to, framed, query_partials
from millrace.serving.kv import KVStore, encoded
from millrace.serving.online import RowEvaluator
from millrace.sources.tables import Catalog
from millrace.spec import AggregationPart, Derivation, GroupBy, Join


def batch_upload(events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], batch_end: int, ts: str = "ts") -> list[tuple[Shape, DataFrame]]:
    """For each shape of the parts its tiles before batch_end: (keys, hop start, partials) on the grid of each window's far
    end. They are what an upload stores, and all that a lookup later needs of the batch side."""
    rows = events.where(F.col(ts) < batch_end)
    out = []
    for s in shapes(rows, keys, parts, ts):
        hops = sorted({p.window.tail_hop() for p in s.parts})
        tiles = [s.tiles(s.frame.withColumn("_start", floor_to(F.col(ts), h)).withColumn("_hop", F.lit(h)), [*keys, "_start", "_hop"]) for h in hops]
        merged = tiles[0]
        for t in tiles[1:]:
            merged = merged.unionByName(t)
        out.append((s, merged))
    return out


def lambda_merge(queries: DataFrame, events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], batch_end: int, ts: str = "ts") -> DataFrame:
    """(keys, ts, parts) as a lookup at ts answers: batch tiles up to batch_end, raw events from there, strictly before ts.

    Windows are sawtooth as in batch; ts must not be before batch_end.
    """
    keys = list(keys)
    q = queries.select(*keys, ts).dropna().distinct().where(F.col(ts) >= batch_end).withColumn("_bin", floor_to(F.col(ts), BIN))
    asked, bins = q.drop("_bin").withColumnRenamed(ts, "_at"), q.select(*keys, "_bin").distinct()
    grids_fit = all(p.window.millis is None or p.window.millis % p.window.tail_hop() == 0 for p in parts)
    recent = events.where(F.col(ts) >= batch_end)
    results = []
    for (s, tiles), live in zip(batch_upload(events, keys, parts, batch_end, ts), shapes(recent, keys, parts, ts), strict=True):
        tail = lambda p: floor_to(F.col("_at") - p.window.millis, p.window.tail_hop())
        takes = lambda p: (F.col("_hop") == p.window.tail_hop()) & (F.lit(True) if p.window.millis is None else F.col("_start") >= tail(p))
        if s.mode == "plain" and grids_fit:
            hops = sorted({p.window.tail_hop() for p in s.parts})
            runs = [framed(s, [p for p in s.parts if p.window.tail_hop() == h], tiles.where(F.col("_hop") == h).drop("_hop"), q, keys, ts, h) for h in hops]
            old = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
        else:
            old = s.merge_tiles(asked.join(tiles, keys), [*keys, "_at"], takes).withColumnRenamed("_at", ts)
        fresh = query_partials(live, q, bins, keys, ts, strict=True)
        results.append(s.final(s.merge(old.unionByName(fresh, allowMissingColumns=True), [*keys, ts]), [*keys, ts]))
    return join_groups(q.select(*keys, ts), results, [*keys, ts]).select(*keys, ts, *[F.col(f"`{p.name}`") for p in parts])


def upload(catalog: Catalog, g: GroupBy, ds: str) -> DataFrame:
    """What a store needs to answer for a group by as of the midnight after ds: (key, value, millis) with keys and features as
    JSON, at that midnight; and under the key `info` the names of keys and features and the day."""
    day = PartitionRange(ds, ds)
    features = compute_group_by(catalog, g, day)
    end = int((date.fromisoformat(ds) - date(1970, 1, 1)).days + 1) * DAY_MS
    values = [c for c in features.columns if c not in (*g.keys, "ds")]
    info = json.dumps({"keys": list(g.keys), "values": values, "ds": ds})
    note = catalog.spark.range(1).select(F.lit("info").alias("key"), F.lit(info).alias("value"), F.lit(end).cast("long").alias("millis"))
    return encoded(features, list(g.keys), values, end).unionByName(note)


class Fetcher:
    """Answers requests from a key-value store that holds finished feature rows per group by (JSON by key)."""

    def __init__(self, spark: SparkSession, store: KVStore, joins: Mapping[str, Join] = (), group_bys: Mapping[str, GroupBy] = (), external: Mapping[str, Callable[[dict], dict]] | None = None):
        self.spark, self.store, self.joins, self.group_bys, self.external = spark, store, dict(joins), dict(group_bys), dict(external or {})
        self.log: list[dict] = []

    def _read(self, dataset: str, key: str) -> str | None:
        found = self.store.get(dataset, key)
        return found[-1].value if found else None

    def fetch_group_by(self, name: str, keys: dict) -> dict:
        g = self.group_bys[name]
        missing = [k for k in g.keys if k not in keys]
        if missing:
            raise KeyError(f"{name} needs {missing}")
        value = self._read(name, json.dumps({k: keys[k] for k in g.keys}, separators=(",", ":")))
        return json.loads(value) if value else {}

    def fetch_join(self, name: str, keys: dict) -> dict:
        """Features of every part under its prefix; a part that fails answers with `<part>_exception`."""
        join, out = self.joins[name], {}
        for p in join.parts:
            try:
                got = self.fetch_group_by(p.group_by.name, {k: keys[p.left_key(k)] for k in p.group_by.keys})
                out |= {p.column_prefix() + k: v for k, v in got.items()}
            except Exception as e:
                out[f"{p.column_prefix()}exception"] = repr(e)
        for e in join.external_parts:
            try:
                answer = self.external[e.source](keys)
                out |= {f"ext_{e.source}_{k}": answer.get(k) for k in e.columns}
            except Exception as x:
                out[f"ext_{e.source}_exception"] = repr(x)
        if join.derivations:
            out = self._derive(out, join.derivations)
        self.log.append({"join": name, "keys": keys, "values": out})
        return out

    def _derive(self, row: dict, derivations: Sequence[Derivation]) -> dict:
        """Renames are done in place; expressions are evaluated as SQL without a Spark job."""
        if all(d.name == "*" or re.fullmatch(r"\w+", d.expression) for d in derivations):
            taken = {d.expression for d in derivations if d.name != "*"}
            out = {k: v for k, v in row.items() if k not in taken} if any(d.name == "*" for d in derivations) else {}
            return out | {d.name: row.get(d.expression) for d in derivations if d.name != "*"}
        kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
        columns = [c for c in row if c.isidentifier()]
        schema = ", ".join(f"`{c}` {kinds.get(type(row[c]), 'double' if row[c] is None else 'string')}" for c in columns)
        taken, named = {d.expression for d in derivations if d.name != "*"}, {d.name for d in derivations}
        selects: dict[str, str] = {}
        for d in derivations:
            selects |= {c: f"`{c}`" for c in columns if c not in taken and c not in named} if d.name == "*" else {d.name: d.expression}
        return RowEvaluator(self.spark, schema, selects)([row])[0]
