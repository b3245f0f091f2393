"""Three levels of aggregation shared by all plans: rows -> partials, partials -> windows, windows -> output columns.

Parts fall into shapes. Plain parts aggregate by group. Bucketed parts, maps and map inputs aggregate by group and bucket
and become maps; exact distinct counts, histograms and distinct top values aggregate by group and value first. So no group
ever collects its rows: what a task holds is bounded by output size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from millrace.operators.aggregates import Op, op_for, partial_columns
from millrace.spec import Aggregation, AggregationPart, Operation

Condition = Callable[[AggregationPart], Column | None]

TIMED = (Operation.FIRST, Operation.LAST, Operation.FIRST_K, Operation.LAST_K)
#: Counted by value first. Frequent and heavy items are thus exact: no sketch, and no group in one task.
BY_VALUE = (Operation.UNIQUE_COUNT, Operation.HISTOGRAM, Operation.APPROX_FREQUENT_K, Operation.APPROX_HEAVY_HITTERS_K)
_COUNT = op_for(AggregationPart("x", Operation.COUNT))


def parts_of(aggregations: Sequence[Aggregation]) -> list[AggregationPart]:
    return [p for a in aggregations for p in a.parts()]


@dataclass
class Shape:
    """Parts that aggregate over one frame: by `extra` as well as the group, if it has one."""

    frame: DataFrame
    mode: str
    parts: list[AggregationPart]
    kinds: dict[str, T.DataType]
    ts: str

    @property
    def extra(self) -> list[str]:
        return [] if self.mode == "plain" else ["_extra"]

    def op(self, part: AggregationPart) -> Op:
        return _COUNT if self.mode == "value" else op_for(part, self.kinds[part.input_column])

    def _input(self, part: AggregationPart) -> Column:
        return F.col("_extra") if self.mode == "value" else F.col(f"`{part.input_column}`")

    def rows(self, by: Sequence[str], condition: Condition) -> DataFrame:
        """Partials of each part (named after it) straight from the rows."""
        cols = []
        for p in self.parts:
            c = condition(p)
            v = self._input(p) if c is None else F.when(c, self._input(p))
            cols += partial_columns(p.name, self.op(p).partial(v, F.col(self.ts)))
        return self.frame.groupBy(*by, *self.extra).agg(*cols)

    def bases(self) -> dict[str, AggregationPart]:
        return {p.base: p for p in self.parts}

    def tiles(self, frame: DataFrame, by: Sequence[str]) -> DataFrame:
        """Partials without windows, named after each part's base: every window is merged from the same ones."""
        cols = [c for b, p in self.bases().items() for c in partial_columns(b, self.op(p).partial(self._input(p), F.col(self.ts)))]
        return frame.groupBy(*by, *self.extra).agg(*cols)

    def coarser(self, tiles: DataFrame, keys: Sequence[str], hop: int) -> DataFrame:
        """Tiles of `hop` milliseconds from finer ones with `_start`."""
        cols = [c for b, p in self.bases().items() for c in partial_columns(b, self.op(p).merge(self.stored(p, b)))]
        start = F.col("_start") - F.pmod(F.col("_start"), F.lit(hop))
        return tiles.withColumn("_start", start).groupBy(*keys, "_start", *self.extra).agg(*cols)

    def stored(self, part: AggregationPart, name: str, where: Column | None = None) -> dict[str, Column]:
        names = self.op(part).partial(F.lit(None), F.lit(None))
        return {n: F.col(f"`{name}__{n}`") if where is None else F.when(where, F.col(f"`{name}__{n}`")) for n in names}

    def merge_tiles(self, tiles: DataFrame, by: Sequence[str], condition: Condition) -> DataFrame:
        """Window partials (named after the parts) from tiles (named after the bases)."""
        cols = [c for p in self.parts for c in partial_columns(p.name, self.op(p).merge(self.stored(p, p.base, condition(p))))]
        return tiles.groupBy(*by, *self.extra).agg(*cols)

    def merge(self, partials: DataFrame, by: Sequence[str]) -> DataFrame:
        cols = [c for p in self.parts for c in partial_columns(p.name, self.op(p).merge(self.stored(p, p.name)))]
        return partials.groupBy(*by, *self.extra).agg(*cols)

    def final(self, merged: DataFrame, by: Sequence[str]) -> DataFrame:
        """Output columns by group."""
        values = {p.name: self.op(p).final(self.stored(p, p.name)) for p in self.parts}
        if self.mode == "plain":
            return merged.select(*by, *[v.alias(n) for n, v in values.items()])
        named = merged.where(F.col("_extra").isNotNull()).select(*by, "_extra", *[v.alias(n) for n, v in values.items()])
        return named.groupBy(*by).agg(*[self._gather(p).alias(p.name) for p in self.parts])

    def _gather(self, p: AggregationPart) -> Column:
        v, has = F.col(f"`{p.name}`"), F.col(f"`{p.name}`").isNotNull()
        if self.mode == "value" and p.operation == Operation.UNIQUE_COUNT:
            n = F.count(v)
            return F.when(n > 0, n)
        if self.mode == "value" and p.operation == Operation.UNIQUE_TOP_K:
            best = InternalFunction.collect_top_k(F.when(has, F.col("_extra")), p.size, False)
            return F.when(F.size(best) > 0, F.sort_array(best, asc=False))
        if self.mode == "value":
            count = v.cast("int") if p.operation == Operation.HISTOGRAM else v
            entry = F.struct((-v).alias("o"), F.col("_extra").cast("string").alias("k"), count.alias("v"))
            if p.size > 0:  # ties in count go to the first key in order
                pairs = F.sort_array(InternalFunction.collect_top_k(F.when(has, entry), p.size, True))
                if p.operation == Operation.APPROX_HEAVY_HITTERS_K:  # heavy: more than 1/k of the group
                    total = F.sum(v)
                    pairs = F.filter(pairs, lambda x: x["v"] * p.size > total)
            else:
                pairs = F.collect_list(F.when(has, entry))
            pairs = F.transform(pairs, lambda x: F.struct(x["k"], x["v"]))
        else:
            pairs = F.collect_list(F.when(has, F.struct(F.col("_extra").alias("k"), v.alias("v"))))
        return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def shapes(df: DataFrame, keep: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts") -> list[Shape]:
    """The shapes of parts over df; frames hold the columns `keep`, ts and the inputs."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keep = list(dict.fromkeys([*keep, ts]))
    groups: dict[tuple, list[AggregationPart]] = {}
    for p in parts:
        kind = kinds[p.input_column]
        scalar = p.operation in TIMED
        if p.bucket:
            if not isinstance(kinds[p.bucket], T.StringType):
                raise ValueError(f"bucket {p.bucket} must be a string")
            key = ("bucket", p.bucket)
        elif isinstance(kind, T.MapType) and not scalar:
            key = ("map", p.input_column)
        else:
            exploded = p.input_column if isinstance(kind, T.ArrayType) and not scalar else None
            struct_ids = p.operation == Operation.UNIQUE_TOP_K and isinstance(kind, T.StructType)
            by_value = p.operation in BY_VALUE or (p.operation == Operation.UNIQUE_TOP_K and not struct_ids)
            key = ("value", p.input_column, exploded) if by_value else ("plain", exploded)
        groups.setdefault(key, []).append(p)
    out = []
    for key, own in groups.items():
        inputs = list(dict.fromkeys(p.input_column for p in own))
        mine = dict(kinds)
        if key[0] == "bucket":
            frame = df.where(F.col(key[1]).isNotNull()).select(*keep, *[c for c in inputs if c not in keep], F.col(key[1]).alias("_extra"))
            mode = "bucket"
        elif key[0] == "map":
            frame = df.select(*[c for c in keep if c != key[1]], F.explode(F.col(key[1])).alias("_extra", key[1]))
            mine[key[1]] = kinds[key[1]].valueType
            mode = "bucket"
        else:
            exploded = key[-1]
            if exploded:
                frame = df.select(*[c for c in keep if c != exploded], F.explode(F.col(exploded)).alias(exploded))
                mine[exploded] = kinds[exploded].elementType
            else:
                frame = df.select(*keep, *[c for c in inputs if c not in keep])
            mode = key[0]
            if mode == "value":
                frame = frame.where(F.col(key[1]).isNotNull()).withColumn("_extra", F.col(key[1]))
        out.append(Shape(frame, mode, own, mine, ts))
    return out


def join_groups(base: DataFrame, others: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Left joins on the group; null keys are keys like others."""
    for k, other in enumerate(others):
        own = other.select(*[F.col(b).alias(f"_{k}_{b}") for b in by], *[c for c in other.columns if c not in by])
        on = None
        for b in by:
            same = F.col(b).eqNullSafe(F.col(f"_{k}_{b}"))
            on = same if on is None else on & same
        base = base.join(own, on, "left").drop(*[f"_{k}_{b}" for b in by])
    return base


def aggregate(df: DataFrame, by: Sequence[str], parts: Sequence[AggregationPart], condition: Condition = lambda p: None, ts: str = "ts") -> DataFrame:
    """Groups df's rows by `by`: one column per part, over the rows for which condition(part) holds."""
    by, found, plain = list(by), [], None
    for s in shapes(df, by, parts, ts):
        result = s.final(s.rows(by, condition), by)
        if s.mode == "plain" and plain is None and all(not isinstance(df.schema[p.input_column].dataType, T.ArrayType) or p.operation in TIMED for p in s.parts):
            plain = result
        else:
            found.append(result)
    base = plain if plain is not None else df.select(*by).distinct()
    return join_groups(base, found, by).select(*by, *[F.col(f"`{p.name}`") for p in parts])
