"""The catalogue of aggregate operations.

Each operation is given as partial aggregates over rows, the way to merge partials of several groups, the way to combine
two partials in one row, and the final value. Batch tiles, streaming tiles, uploads and lookups share them. Null inputs are
ignored, a group without inputs gives null for every operation (counts included), and NaN or infinite results become null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

from millrace.spec import AggregationPart, Operation

Partials = dict[str, Column]
Wrap = Callable[[Column], Column]


@dataclass(frozen=True)
class Op:
    """over_rows(value, ts, w): named partial aggregates over rows. over_partials(c, w): the same over partial columns
    c[name]. w wraps every aggregate call, so that partials can run over a window. combine(a, b): one partial from two; None
    where no expression does it. final(c): the value. deletable: partials can be taken back by rows of negative sign."""

    over_rows: Callable[[Column, Column, Wrap], Partials]
    over_partials: Callable[[Partials, Wrap], Partials]
    final: Callable[[Partials], Column]
    combine: Callable[[Partials, Partials], Partials] | None = None
    deletable: bool = False

    def partial(self, value: Column, ts: Column, w: Wrap = lambda c: c) -> Partials:
        return self.over_rows(value, ts, w)

    def merge(self, c: Partials, w: Wrap = lambda c: c) -> Partials:
        return self.over_partials(c, w)

    def direct(self, value: Column, ts: Column) -> Column:
        return self.final(self.partial(value, ts))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _add(names: list[str]):
    return (lambda c, w: {n: w(F.sum(c[n])) for n in names}), (lambda a, b: {n: _plus(a[n], b[n]) for n in names})


def _widened(value: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.DecimalType):
        return value
    return value.cast("double") if isinstance(kind, T.FloatType | T.DoubleType) else value.cast("long")


def _some(n: Column) -> Column:
    """Null for a count of nothing."""
    return F.when(n > 0, n)


def _pair(value: Column, ts: Column) -> Column:
    return F.when(value.isNotNull() & ts.isNotNull(), F.struct(ts.alias("t"), value.alias("v")))


def _keep(k: int, descending: bool) -> Callable[[Column], Column]:
    return lambda arrays: F.slice(F.sort_array(arrays, asc=not descending), 1, k)


def _k_best(k: int, descending: bool, timed: bool) -> Op:
    keep = _keep(k, descending)
    name = "best"
    own = (lambda v, t: _pair(v, t)) if timed else (lambda v, t: v)
    final = (lambda c: F.transform(c[name], lambda x: x["v"])) if timed else (lambda c: c[name])
    return Op(
        over_rows=lambda v, t, w: {name: keep(w(InternalFunction.collect_top_k(own(v, t), k, not descending)))},
        over_partials=lambda c, w: {name: keep(F.flatten(w(F.collect_list(c[name]))))},
        combine=lambda a, b: {name: keep(F.concat(F.coalesce(a[name], F.slice(b[name], 1, 0)), F.coalesce(b[name], F.slice(a[name], 1, 0))))},
        final=lambda c: F.when(F.size(c[name]) > 0, final(c)),
    )


def _unique_best(k: int, by_id: bool) -> Op:
    """Distinct values in descending order. Structs (sort_key, unique_id, ...) are distinct by unique_id, of which the
    greatest counts. Beyond 2k distinct values a merge keeps the first 2k."""

    def keep(arrays: Column, size: int) -> Column:
        ordered = F.sort_array(F.array_distinct(arrays), asc=False)
        if by_id:
            ids = F.transform(ordered, lambda x: x["unique_id"])
            ordered = F.filter(ordered, lambda x, i: F.array_position(ids, x["unique_id"]) == i + 1)
        return F.slice(ordered, 1, size)

    return Op(
        over_rows=lambda v, t, w: {"best": keep(w(F.collect_set(v)), 2 * k)},
        over_partials=lambda c, w: {"best": keep(F.flatten(w(F.collect_list(c["best"]))), 2 * k)},
        combine=lambda a, b: {"best": keep(F.concat(F.coalesce(a["best"], F.slice(b["best"], 1, 0)), F.coalesce(b["best"], F.slice(a["best"], 1, 0))), 2 * k)},
        final=lambda c: F.when(F.size(c["best"]) > 0, F.slice(c["best"], 1, k)),
    )


def _central(order: int, final: Callable[[Partials], Column]) -> Op:
    """Central moments up to `order`: n, mean and the sums m2.. of powers of distances from the mean. Two partials merge by
    the distance of their means, so no digits are lost to large means or many merges. A merge gathers partials, which are
    tiles, never rows."""
    names = ["n", "mean", *[f"m{k}" for k in range(2, order + 1)]]

    def partial(v: Column, t: Column, w: Wrap) -> Partials:
        x = v.cast("double")
        n = w(F.count(v))
        m2 = w(F.var_pop(x)) * n
        out = {"n": n, "mean": w(F.avg(x)), "m2": m2}
        spread = lambda c: F.when(m2 > 0, c).when(n > 0, F.lit(0.0))
        if order > 2:
            out["m3"] = spread(w(F.skewness(x)) * F.pow(m2, F.lit(1.5)) / F.sqrt(n))
        if order > 3:
            out["m4"] = spread((w(F.kurtosis(x)) + 3) * m2 * m2 / n)
        return out

    def both(a: Partials, b: Partials) -> Partials:
        na, nb = a["n"].cast("double"), b["n"].cast("double")
        n, gap = na + nb, b["mean"] - a["mean"]
        out = {"n": a["n"] + b["n"], "mean": a["mean"] + gap * nb / n, "m2": a["m2"] + b["m2"] + gap * gap * na * nb / n}
        if order > 2:
            out["m3"] = a["m3"] + b["m3"] + F.pow(gap, F.lit(3)) * na * nb * (na - nb) / (n * n) + 3 * gap * (na * b["m2"] - nb * a["m2"]) / n
        if order > 3:
            out["m4"] = (
                a["m4"] + b["m4"] + F.pow(gap, F.lit(4)) * na * nb * (na * na - na * nb + nb * nb) / (n * n * n)
                + 6 * gap * gap * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4 * gap * (na * b["m3"] - nb * a["m3"]) / n
            )
        return out

    def combine(a: Partials, b: Partials) -> Partials:
        merged, some_a, some_b = both(a, b), F.coalesce(a["n"], F.lit(0)) > 0, F.coalesce(b["n"], F.lit(0)) > 0
        return {x: F.when(some_a & some_b, merged[x]).when(some_a, a[x]).otherwise(b[x]) for x in names}

    def merge(c: Partials, w: Wrap) -> Partials:
        row = F.when(c["n"] > 0, F.struct(*[c[x].cast("long" if x == "n" else "double").alias(x) for x in names]))
        nothing = F.struct(*[(F.lit(0).cast("long") if x == "n" else F.lit(None).cast("double")).alias(x) for x in names])
        step = lambda a, b: F.struct(*[x.alias(k) for k, x in combine({k: a[k] for k in names}, {k: b[k] for k in names}).items()])
        total = F.aggregate(w(F.collect_list(row)), nothing, step)
        return {x: total[x] for x in names}

    return Op(partial, merge, final, combine)


def _varied(c: Partials) -> Column:
    """Whether the values differ by more than rounding."""
    return c["m2"] > 1e-20 * c["n"] * c["mean"] * c["mean"]


def _guarded_skew(c: Partials) -> Column:
    return F.when((c["n"] >= 3) & _varied(c), F.sqrt(c["n"]) * c["m3"] / F.pow(c["m2"], F.lit(1.5)))


def _guarded_kurtosis(c: Partials) -> Column:
    return F.when((c["n"] >= 4) & _varied(c), c["n"] * c["m4"] / (c["m2"] * c["m2"]) - 3)


def _extreme(agg, pick) -> Op:
    return Op(lambda v, t, w: {"x": w(agg(v))}, lambda c, w: {"x": w(agg(c["x"]))}, lambda c: c["x"], lambda a, b: {"x": pick(a["x"], b["x"])})


def _timed(agg, pick) -> Op:
    return Op(lambda v, t, w: {"p": w(agg(_pair(v, t)))}, lambda c, w: {"p": w(agg(c["p"]))}, lambda c: c["p"]["v"], lambda a, b: {"p": pick(a["p"], b["p"])})


def op_for(part: AggregationPart, kind: T.DataType | None = None) -> Op:
    """The operation of a part whose input has type `kind`."""
    k = part.size
    o = part.operation
    if o == Operation.COUNT:
        merge, combine = _add(["n"])
        return Op(lambda v, t, w: {"n": w(F.count(v))}, merge, lambda c: _some(c["n"]), combine, deletable=True)
    if o == Operation.SUM:
        merge, combine = _add(["s"])
        return Op(lambda v, t, w: {"s": w(F.sum(_widened(v, kind)))}, merge, lambda c: finite(c["s"]) if isinstance(kind, T.FloatType | T.DoubleType) else c["s"], combine, deletable=True)
    if o == Operation.AVERAGE:
        merge, combine = _add(["s", "n"])
        return Op(lambda v, t, w: {"s": w(F.sum(v.cast("double"))), "n": w(F.count(v))}, merge, lambda c: F.when(c["n"] > 0, finite(c["s"] / c["n"])), combine, deletable=True)
    if o == Operation.MIN:
        return _extreme(F.min, F.least)
    if o == Operation.MAX:
        return _extreme(F.max, F.greatest)
    if o == Operation.FIRST:
        return _timed(F.min, F.least)
    if o == Operation.LAST:
        return _timed(F.max, F.greatest)
    if o == Operation.VARIANCE:
        return _central(2, lambda c: F.when(c["n"] > 0, c["m2"] / c["n"]))
    if o == Operation.SKEW:
        return _central(3, _guarded_skew)
    if o == Operation.KURTOSIS:
        return _central(4, _guarded_kurtosis)
    if o == Operation.UNIQUE_COUNT:
        return Op(
            lambda v, t, w: {"u": w(F.collect_set(v))}, lambda c, w: {"u": F.array_distinct(F.flatten(w(F.collect_list(c["u"]))))},
            lambda c: _some(F.size(c["u"]).cast("long")), lambda a, b: {"u": F.when(a["u"].isNull(), b["u"]).when(b["u"].isNull(), a["u"]).otherwise(F.array_union(a["u"], b["u"]))},
        )
    if o == Operation.APPROX_UNIQUE_COUNT:
        bits = max(4, k + 4)  # twice as many registers a bit: about the error of a compressed sketch of size k
        either = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.hll_union(a, b, True))
        return Op(lambda v, t, w: {"h": w(F.hll_sketch_agg(_sketchable(v, kind), F.lit(bits)))}, lambda c, w: {"h": w(F.hll_union_agg(c["h"], F.lit(True)))}, lambda c: _some(F.hll_sketch_estimate(c["h"])), lambda a, b: {"h": either(a["h"], b["h"])})
    if o == Operation.APPROX_PERCENTILE:
        ranks = F.array(*[F.lit(float(p)) for p in part.percentiles])
        either = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.call_function("kll_sketch_merge_float", a, b))
        return Op(
            lambda v, t, w: {"k": F.when(w(F.count(v)) > 0, w(F.call_function("kll_sketch_agg_float", v.cast("float"), F.lit(k))))},
            lambda c, w: {"k": F.when(w(F.count(c["k"])) > 0, w(F.call_function("kll_merge_agg_float", c["k"], F.lit(k))))},
            lambda c: F.when(c["k"].isNotNull(), F.call_function("kll_sketch_get_quantile_float", c["k"], ranks)), lambda a, b: {"k": either(a["k"], b["k"])},
        )
    if o in (Operation.LAST_K, Operation.FIRST_K):
        return _k_best(k, o == Operation.LAST_K, timed=True)
    if o in (Operation.TOP_K, Operation.BOTTOM_K):
        return _k_best(k, o == Operation.TOP_K, timed=False)
    if o == Operation.UNIQUE_TOP_K:
        return _unique_best(k, by_id=isinstance(kind, T.StructType) and "unique_id" in kind.names)
    raise ValueError(f"{o} is planned as a bucketed count")


def _sketchable(v: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.LongType | T.IntegerType | T.StringType | T.BinaryType):
        return v
    if isinstance(kind, T.ShortType | T.ByteType):
        return v.cast("int")
    return v.cast("string")


def partial_columns(prefix: str, partials: Partials) -> list[Column]:
    return [c.alias(f"{prefix}__{n}") for n, c in partials.items()]


def stored(op: Op, prefix: str, of: str = "") -> Partials:
    """The columns in which partial_columns put an operation's partials, of a table alias if one is given."""
    names = op.partial(F.lit(None).cast("double"), F.lit(None).cast("long"))
    return {n: F.col(f"{of}.`{prefix}__{n}`" if of else f"`{prefix}__{n}`") for n in names}
