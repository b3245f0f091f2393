"""Projections after aggregation, key filters and joins that merge columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.spec import Derivation


def derive(df: DataFrame, derivations: Sequence[Derivation], ensure: Sequence[str] = (), base: Sequence[str] | None = None) -> DataFrame:
    """Ordered projection by derivations. `*` stands for the base columns (all but `ensure` by default) that no other
    derivation takes over unchanged; columns of `ensure` stay in front."""
    if not derivations:
        return df
    base = [c for c in df.columns if c not in ensure] if base is None else list(base)
    taken = {d.expression for d in derivations if d.name != "*"}
    named = {d.name for d in derivations}
    cols: list[Column] = [F.col(f"`{c}`") for c in ensure if c not in named]
    for d in derivations:
        if d.name == "*":
            cols += [F.col(f"`{c}`") for c in base if c not in taken and c not in named]
        else:
            cols.append(F.expr(d.expression).alias(d.name))
    return df.select(*cols)


def derive_over_left(df: DataFrame, derivations: Sequence[Derivation], left: Sequence[str], base: Sequence[str]) -> DataFrame:
    """As derive, but a column that the left side or a bootstrap already has keeps its value where it is not null."""
    kept = [Derivation(d.name, f"coalesce(`{d.name}`, {d.expression})") if d.name != "*" and d.name in df.columns and d.name in left else d for d in derivations]
    return derive(df, kept, ensure=[c for c in left if c not in {d.name for d in derivations}], base=base)


def without_skew(df: DataFrame, skew: Mapping[str, Sequence[object]]) -> DataFrame:
    """Leaves out rows all of whose declared keys hold a skewed value; a null key is skewed too. Several keys combine by OR:
    one key that is not skewed keeps the row."""
    if not skew:
        return df
    return df.where(reduce(lambda a, b: a | b, [F.col(k).isNotNull() & ~F.col(k).isin(list(v)) for k, v in skew.items()]))


def coalesced_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys in which columns of both sides become coalesce(left, right); their types must agree."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    kinds = {f.name: f.dataType for f in left.schema.fields}
    for f in right.schema.fields:
        if f.name in shared and f.dataType != kinds[f.name]:
            raise ValueError(f"column {f.name} has different types on the two sides")
    moved = right.select(*keys, *[F.col(f"`{c}`").alias(f"_r_{c}" if c in shared else c) for c in right.columns if c not in keys])
    joined = left.join(moved, list(keys), "left")
    return joined.select(*[F.coalesce(f"`{c}`", f"`_r_{c}`").alias(c) if c in shared else F.col(f"`{c}`") for c in [*left.columns, *[c for c in moved.columns if c not in keys and not c.startswith("_r_")]]])


def only_left_keys(right: DataFrame, left: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """right without rows whose keys the left lacks, if the left has few enough keys to be sent to every task; it never
    changes a join's result."""
    own = left.select(*keys).distinct().limit(limit + 1)
    return right.join(F.broadcast(own), list(keys), "left_semi") if own.count() <= limit else right
