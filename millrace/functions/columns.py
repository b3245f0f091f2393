"""Column expressions shared by the operators; all are built-in, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def return_key(col: str | Column) -> Column:
    """The hexadecimal digits of an identifier in lower case; other characters do not count."""
    return F.regexp_replace(F.lower(F.col(col) if isinstance(col, str) else col), "[^0-9a-f]", "")


def event_millis(col: str | Column) -> Column:
    """Epoch milliseconds of a ts that may be in seconds (below 1e11) or microseconds (above 1e14); null beyond a long."""
    c = F.col(col) if isinstance(col, str) else col
    return (
        F.when(c < F.lit(100_000_000_000), F.try_multiply(c, F.lit(1000).cast("long")))
        .when(c > F.lit(100_000_000_000_000), (c - F.pmod(c, F.lit(1000))) / 1000)
        .otherwise(c)
        .cast("long")
    )


def epoch_day(millis: Column) -> Column:
    """UTC day of epoch milliseconds, as an int: it shuffles in a quarter of a date string."""
    return F.floor(millis / F.lit(DAY_MS)).cast("int")


def day_string(day: Column) -> Column:
    return F.date_from_unix_date(day).cast("string")


def day_number(ds: Column) -> Column:
    """Inverse of day_string; null for what is not a date written yyyy-MM-dd."""
    return F.when(valid_date(ds), F.unix_date(F.try_to_timestamp(ds, F.lit("yyyy-MM-dd")).cast("date")))


def valid_date(c: Column) -> Column:
    """An existing date written yyyy-MM-dd; null stays null."""
    return F.when(c.isNotNull(), c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull())


def clean_label(col: str) -> Column:
    return F.lower(F.trim(F.col(col), F.lit(" \t\r\n")))


def fingerprint(cols: Sequence[Column], salt: int = 0) -> Column:
    """64 bits over values and their nullness: (null, 1) and (1, null) differ, nulls equal nulls."""
    return F.xxhash64(F.lit(salt), *[x for c in cols for x in (c, c.isNull())])


def newest_version(df: DataFrame, keys: Sequence[str], order: str, content: Sequence[str]) -> DataFrame:
    """One row per key: the content at the greatest `order`; rows tied in it are decided by the content itself.

    A max over structs, so copies of a key shrink before the shuffle: a key holding a third of all rows sends one row
    from each partition.
    """
    best = F.max(F.struct(order, *content)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, f"_best.{order}", *[f"_best.{c}" for c in content])


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Columns in camel case renamed to snake case."""
    import re

    return df.withColumnsRenamed({c: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower() for c in df.columns})


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keep})
