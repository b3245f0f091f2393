"""Lookups of windowed features: stored batch partials, what streamed in since, and expressions over single rows, none of
which starts a Spark job. Tables of requests are looked up by executors."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime
from millrace.operators.aggregates import Op
from millrace.plans.shapes import Shape, join_groups, shapes
from millrace.plans.temporal import floor_to
from millrace.serving.kv import KVStore, TimedValue
from millrace.spec import AggregationPart, Operation

#: Rows evaluated in one go.
CHUNK = 256
#: Requests of a table that a task looks up at once, and characters of found partials that it holds before it passes them on.
REQUESTS, HELD = 2000, 4_000_000


class RowEvaluator:
    """SQL selections and filters over single rows, for services. The rows are constants of the plan, which the optimizer
    evaluates as it would any constant: there is no job, task or shuffle."""

    def __init__(self, spark: SparkSession, schema: str | T.StructType, selects: Mapping[str, str], wheres: Sequence[str] = (), setups: Sequence[str] = ()):
        self.spark, self.selects, self.wheres = spark, dict(selects), list(wheres)
        self.schema = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        for s in setups:
            spark.sql(s)

    def __call__(self, rows: Sequence[Mapping]) -> list[dict | None]:
        """One answer per row, None where a filter does not hold."""
        out: list[dict | None] = [None] * len(rows)
        cols = ", ".join(f"({e}) AS `{n}`" for n, e in self.selects.items())
        where = " AND ".join(f"({w})" for w in self.wheres) or "true"
        for start in range(0, len(rows), CHUNK):
            own = rows[start : start + CHUNK]
            marks = ", ".join(f"({k}, :p{k})" for k in range(len(own)))
            text = f"SELECT _i, {cols} FROM (SELECT _i, _r.* FROM (SELECT _i, from_json(_j, '{self.schema}') AS _r FROM VALUES {marks} AS _t(_i, _j))) WHERE {where}"
            for r in self.spark.sql(text, args={f"p{k}": json.dumps(dict(x), default=str) for k, x in enumerate(own)}).collect():
                found = r.asDict(recursive=True)
                out[start + found.pop("_i")] = found
        return out


def _rows(s: Shape, k: int, tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles as rows (keys, t, row): row is JSON of shape k, value or bucket, hop, start and partials."""
    partials = F.struct(*[F.col(f"`{c}`") for c in tiles.columns if "__" in c])
    extra = F.to_json(F.struct(F.col("_extra").alias("x"))) if s.extra else F.lit(None).cast("string")
    row = F.struct(F.lit(k).alias("s"), extra.alias("e"), F.col("_hop").alias("h"), F.col("_start").alias("t"), F.to_json(partials).alias("p"))
    return tiles.select(*keys, F.col("_start").alias("t"), row.alias("row"))


def _stored(rows: Sequence[DataFrame], keys: Sequence[str], millis: int | str) -> DataFrame:
    every = reduce(DataFrame.unionByName, rows)
    by = [*keys] if isinstance(millis, int) else [*keys, "t"]
    value = F.to_json(F.collect_list("row"), {"ignoreNullFields": "false"})
    at = F.lit(millis).cast("long") if isinstance(millis, int) else F.col("t")
    return every.groupBy(*by).agg(value.alias("value")).select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), "value", at.alias("millis"))


def upload_rows(events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], batch_end: int, ts: str = "ts") -> DataFrame:
    """(key, value, millis) to be stored: per key the partials of everything before batch_end that a lookup at or after it
    can need. Windows keep tiles on the grid of their far end, as far back as they reach; no window keeps one tile."""
    out = []
    for k, s in enumerate(shapes(events.where(F.col(ts) < batch_end).dropna(subset=list(keys)), keys, parts, ts)):
        for hop in sorted({p.window.tail_hop() for p in s.parts if p.window.millis is not None}):
            reach = max(p.window.millis for p in s.parts if p.window.millis is not None and p.window.tail_hop() == hop)
            near = s.frame.where(F.col(ts) >= batch_end - reach - hop)
            out.append(_rows(s, k, s.tiles(near.withColumn("_start", floor_to(F.col(ts), hop)), [*keys, "_start"]).withColumn("_hop", F.lit(hop)), keys))
        if any(p.window.millis is None for p in s.parts):
            out.append(_rows(s, k, s.tiles(s.frame, keys).withColumns({"_start": F.lit(-1).cast("long"), "_hop": F.lit(0)}), keys))
    return _stored(out, keys, batch_end)


def stream_rows(events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts", tile: int = 1) -> DataFrame:
    """(key, value, millis) of what streams in, in tiles of `tile` milliseconds (1: instants) under their start. A tile counts
    for a lookup once it has begun, so with wider tiles lookups answer for the end of the running tile."""
    out = []
    for k, s in enumerate(shapes(events.where(F.col(ts).isNotNull()).dropna(subset=list(keys)), keys, parts, ts)):
        tiles = s.tiles(s.frame.withColumn("_start", floor_to(F.col(ts), tile)), [*keys, "_start"]).withColumn("_hop", F.lit(1))
        out.append(_rows(s, k, tiles, keys))
    return _stored(out, keys, "t")


def _merged(op: Op, base: str, column: str, kind: str, kinds: Mapping[str, str]) -> Column:
    """A struct of the partials in a JSON array, merged one after another."""
    rows = F.transform(F.from_json(F.col(column), kind), lambda x: F.struct(*[x[f"{base}__{n}"].alias(n) for n in kinds]))
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in kinds.items()])

    def step(a: Column, b: Column) -> Column:
        both = op.combine({n: a[n] for n in kinds}, {n: b[n] for n in kinds})
        return F.struct(*[both[n].cast(t).alias(n) for n, t in kinds.items()])

    return F.aggregate(rows, nothing, step)


#: A key's stored rows by shape and value or bucket: when they streamed in (-1 << 62: with the upload), start, hop (None:
#: streamed in), partials.
Kept = dict[tuple[int, str | None], list[tuple[int, int, int | None, str]]]


def _parsed(batch: Sequence[TimedValue], stream: Sequence[TimedValue]) -> Kept:
    """What counts of a key: the last upload, and what streamed in from its end on."""
    out: Kept = defaultdict(list)
    end = batch[-1].millis if batch else -(1 << 62)
    for r in json.loads(batch[-1].value) if batch else []:
        out[r["s"], r.get("e")].append((-(1 << 62), r["t"], r["h"], r["p"]))
    for v in stream:
        if v.millis >= end:
            for r in json.loads(v.value):
                out[r["s"], r.get("e")].append((v.millis, r["t"], None, r["p"]))
    return out


def _chosen(plan: Sequence[tuple[int, AggregationPart]], kept: Kept, at: int) -> Iterator[tuple[int, str | None, list[str | None]]]:
    """For each shape and value or bucket of a key, the partials that each column takes for a request, as JSON arrays. plan:
    the shape and part of each column."""
    takes = []
    for j, p in plan:
        hop = p.window.tail_hop()
        takes.append((j, -(1 << 62), 0) if p.window.millis is None else (j, (at - p.window.millis) // hop * hop, hop))
    for (k, extra), every in kept.items():
        own = [r for r in every if r[0] < at]
        if own:
            yield k, extra, ["[" + ",".join([p for _, t, h, p in own if t >= tail and (h is None or h == hop)]) + "]" if j == k else None for j, tail, hop in takes]


def _look(store: KVStore, name: str, names: Sequence[str], plan: Sequence[tuple[int, AggregationPart]], everyone: bool):
    """For batches of requests (keys, time, key as stored) rows of (keys, time, shape, value or bucket, partials by column).
    everyone: requests without partials have a row, too."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, REQUESTS):
                asked = batch.slice(start, REQUESTS)
                keys, times = asked.column(asked.num_columns - 1).to_pylist(), asked.column(asked.num_columns - 2).to_pylist()
                wanted = set(keys)
                old, new = store.multi_get(f"{name}_batch", wanted), store.multi_get(f"{name}_stream", wanted)
                parsed: dict[str, Kept] = {}
                places: list[int] = []
                found: list[tuple] = []
                size = 0

                def table():
                    own = asked.take(pa.array(places, pa.int64()))
                    columns = zip(*found, strict=True)
                    kinds = [pa.int32(), pa.string(), *[pa.string()] * len(plan)]
                    return pa.RecordBatch.from_arrays([*own.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], list(names))

                for i, (key, at) in enumerate(zip(keys, times, strict=True)):
                    if key not in parsed:  # requests come in order of keys
                        parsed = {key: _parsed(old.get(key) or [], new.get(key) or [])}
                    chosen = [*_chosen(plan, parsed[key], at)]
                    if everyone and not chosen:
                        chosen = [(0, None, ["[]"] * len(plan))]
                    for k, extra, values in chosen:
                        places.append(i)
                        found.append((k, extra, *values))
                        size += sum(len(v) for v in values if v)
                        if size > HELD:
                            yield table()
                            places, found, size = [], [], 0
                if found:
                    yield table()

    return run


class WindowLookup:
    """Answers for the features of one group by from a store: `<name>_batch` holds upload_rows, `<name>_stream` stream_rows.

    Partials are chosen per window and merged by the same operations as in batch.
    """

    def __init__(self, store: KVStore, name: str, schema: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts"):
        """schema: a frame with the columns of the events; only its types are used."""
        self.spark, self.store, self.name, self.keys, self.parts, self.ts = schema.sparkSession, store, name, list(keys), list(parts), ts
        self.shapes = shapes(schema.limit(0), keys, parts, ts)
        self.plan = [(j, p) for j, s in enumerate(self.shapes) for p in s.parts]
        self.columns = [f"c{c}" for c in range(len(self.plan))]
        self.partials: list[dict[str, Column]] = []
        kinds = [{f.name: f.dataType for f in s.tiles(s.frame, keys).schema.fields} for s in self.shapes]
        for column, (j, p) in zip(self.columns, self.plan, strict=True):
            names = list(self.shapes[j].stored(p, p.base))
            types = {n: kinds[j][f"{p.base}__{n}"].simpleString() for n in names}
            kind = "array<struct<" + ", ".join(f"`{p.base}__{n}`: {types[n]}" for n in names) + ">>"
            merged = _merged(self.shapes[j].op(p), p.base, column, kind, types)
            self.partials.append({n: merged[n] for n in names})
        self.selects = [self.shapes[j].op(p).final(c).alias(column) for column, (j, p), c in zip(self.columns, self.plan, self.partials, strict=True)]

    def key(self, keys: Mapping) -> str:
        return json.dumps({k: keys[k] for k in self.keys}, separators=(",", ":"))

    def __call__(self, requests: Sequence[tuple[Mapping, int]]) -> list[dict]:
        """Features for each (keys, time), of events strictly before the time."""
        wanted = {self.key(k) for k, _ in requests}
        batch, stream = self.store.multi_get(f"{self.name}_batch", wanted), self.store.multi_get(f"{self.name}_stream", wanted)
        parsed = {key: _parsed(batch.get(key) or [], stream.get(key) or []) for key in wanted}
        rows, owners = [], []
        for number, (keys, at) in enumerate(requests):
            for k, extra, values in _chosen(self.plan, parsed[self.key(keys)], at):
                rows.append(dict(zip(self.columns, values, strict=True)))
                owners.append((number, k, extra))
        values = self._evaluated(rows)
        gathered: list[dict] = [defaultdict(dict) for _ in requests]
        for (number, k, extra), answer in zip(owners, values, strict=True):
            for v, (j, p) in zip(answer, self.plan, strict=True):
                if j == k and v is not None:
                    gathered[number][p.name][None if extra is None else json.loads(extra).get("x")] = v
        by_name = {p.name: (self.shapes[j], p) for j, p in self.plan}
        return [{p.name: self._gather(*by_name[p.name], g.get(p.name, {})) for p in self.parts} for g in gathered]

    def over(self, requests: DataFrame) -> DataFrame:
        """(keys, ts, parts) for each distinct request whose keys and ts are not null: the same answers for a table of
        requests. Executors read the store and merge, so the driver holds neither requests nor answers. The store must be
        one that executors reach."""
        by = [*self.keys, self.ts]
        q = requests.select(*self.keys, F.col(self.ts).cast("long").alias(self.ts)).dropna().distinct()
        everyone = len(self.shapes) == 1 and self.shapes[0].mode == "plain"
        kinds = ", ".join(["_s int", "_e string", *[f"{c} string" for c in self.columns]])
        names = [*by, "_s", "_e", *self.columns]
        asked = self.store.gathered(q.withColumn("_key", F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})), "_key")
        rows = runtime.map_arrow(asked, _look(self.store, self.name, names, self.plan, everyone), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields], kinds]))
        if len(self.shapes) > 1:
            rows = runtime.persist_table(rows, "lookups")
        results = []
        for k, s in enumerate(self.shapes):
            extra = [F.from_json("_e", T.StructType([T.StructField("x", s.frame.schema["_extra"].dataType)]))["x"].alias("_extra")] if s.extra else []
            own = [c.alias(f"{p.name}__{n}") for (j, p), partials in zip(self.plan, self.partials, strict=True) if j == k for n, c in partials.items()]
            results.append(s.final(rows.where(F.col("_s") == k).select(*by, *extra, *own), by))
        return (results[0] if everyone else join_groups(q, results, by)).select(*by, *[F.col(f"`{p.name}`") for p in self.parts])

    def _evaluated(self, rows: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        for start in range(0, len(rows), CHUNK):
            own = rows[start : start + CHUNK]
            schema = ", ".join(f"`{c}` string" for c in self.columns)
            marks = ", ".join(f"({k}, :p{k})" for k in range(len(own)))
            base = self.spark.sql(f"SELECT _i, _r.* FROM (SELECT _i, from_json(_j, '{schema}') AS _r FROM VALUES {marks} AS _t(_i, _j))", args={f"p{k}": json.dumps(r) for k, r in enumerate(own)})
            found = {r[0]: tuple(r)[1:] for r in base.select("_i", *self.selects).collect()}
            out += [found[k] for k in range(len(own))]
        return out

    @staticmethod
    def _gather(s: Shape, p: AggregationPart, values: dict):
        """The output of a part from its value per bucket or value, as Shape.final gathers it."""
        if s.mode == "plain":
            return values.get(None)
        values = {k: v for k, v in values.items() if k is not None}
        if not values:
            return None
        if s.mode == "bucket":
            return values
        if p.operation == Operation.UNIQUE_COUNT:
            return len(values)
        if p.operation == Operation.UNIQUE_TOP_K:
            return sorted(values, reverse=True)[: p.size]
        ordered = sorted(((-v, str(k)) for k, v in values.items()))
        if p.size > 0:
            ordered = ordered[: p.size]
        total = sum(values.values())
        heavy = p.operation == Operation.APPROX_HEAVY_HITTERS_K
        return {k: -v for v, k in ordered if not heavy or -v * p.size > total} or None
