"""Problem 4: exact profile of every column per load, and comparison between loads.

Columns are unpivoted to (load, column, value) and counted. All figures come from those value counts: frequencies,
distincts, ranges, the most common value, medians by cumulative counts. Distributions of loads are compared by the
population stability index and chi-square over the same counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import runtime
from millrace.functions.columns import day_number
from millrace.functions.multiset import cumulative, order_statistics

LOAD_ROWS = 30
#: Cells of a column's values beyond the most common: by range for numbers and dates, by hash for others.
REST_CELLS = 64


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load, column_name, value as string, n), null values included. Equal values combine before the shuffle, so a load
    or a value that holds a third of all rows sends one row from each partition."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(load).alias("load"), cells.alias("x")).groupBy("load", "x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def profile(counts: DataFrame, invalid: Mapping[str, Column], numeric: Sequence[str] = ()) -> DataFrame:
    """One row per load and column from value_counts.

    rows, nulls, distincts, lowest and highest (as text; numeric columns by number), invalid and top (rows of the most
    common value; null without values); for `numeric` columns also the exact median. invalid: by column, a condition on
    `value` that marks a non-null value as a violation. A column without rows has no row.
    """
    bad = F.lit(False)
    for name, test in invalid.items():
        bad = bad | ((F.col("column_name") == name) & F.coalesce(test, F.lit(False)))
    n = F.col("n")
    has = F.col("value").isNotNull()
    number = F.when(F.col("column_name").isin(*numeric), F.expr("try_cast(value as bigint)")) if numeric else F.lit(None).cast("long")
    shown = F.struct(number.alias("number"), F.col("value").alias("text"))
    counts = runtime.persist_table(counts, "value-counts")
    base = counts.groupBy("load", "column_name").agg(
        F.sum(n).alias("rows"), F.sum(F.when(has, 0).otherwise(n)).alias("nulls"), F.count("value").alias("distincts"),
        F.min(F.when(has, shown)).getField("text").alias("lowest"), F.max(F.when(has, shown)).getField("text").alias("highest"),
        F.sum(F.when(has & bad, n).otherwise(0)).alias("invalid"), F.max(F.when(has, n)).alias("top"),
    )
    if not numeric:
        return base.withColumn("median", F.lit(None).cast("double"))
    numbers = counts.where(F.col("column_name").isin(*numeric)).groupBy("load", "column_name", F.expr("try_cast(value as bigint)").alias("value")).agg(F.sum("n").alias("n"))
    medians = order_statistics(numbers, ["load", "column_name"]).select(F.col("load").alias("l"), F.col("column_name").alias("c"), "median")
    return base.join(medians, F.col("load").eqNullSafe(F.col("l")) & (F.col("column_name") == F.col("c")), "left").drop("l", "c")


def odd_loads(profiled: DataFrame, share_limit: float = 0.25, median_factor: float = 3.0, least_rows: int = LOAD_ROWS) -> DataFrame:
    """Loads of at least `least_rows` rows one of whose measures departs from the median of that measure over all such
    loads: null share, invalid share and share of the most common value by more than share_limit, the median of numeric
    columns by more than median_factor either way. Shares of non-null values are unknown, hence no departure, in a load
    that has none. One row (column_name, load, measure) per departure."""
    values = F.col("rows") - F.col("nulls")
    share = lambda c: F.when(values > 0, F.col(c) / values)
    p = profiled.where(F.col("rows") >= least_rows).select("column_name", "load", (F.col("nulls") / F.col("rows")).alias("null_share"), share("invalid").alias("invalid_share"), share("top").alias("top_share"), "median")
    names = ["null_share", "invalid_share", "top_share", "median"]
    # One row per load: the middle over loads is a plain percentile over a calendar's worth of rows.
    middle = p.groupBy("column_name").agg(*[F.percentile(m, F.lit(0.5)).alias(f"mid_{m}") for m in names])
    off = [F.when(F.abs(F.col(m) - F.col(f"mid_{m}")) > share_limit, m) for m in names[:3]]
    med, mid = F.col("median"), F.col("mid_median")
    off.append(F.when((med > mid * median_factor) | (med < mid / median_factor), "median"))
    return p.join(middle, "column_name").select("column_name", "load", F.explode(F.array_compact(F.array(*off))).alias("measure"))


def rest_cuts(overall: DataFrame) -> DataFrame:
    """(cc, cuts): per column the REST_CELLS - 1 numbers that cut its distinct numbers and dates into ranges of equally many,
    by exact ranks."""
    numbers = overall.where("value is not null").select("column_name", number_of(F.col("value")).alias("value")).where("value is not null").distinct().withColumn("n", F.lit(1).cast("long"))
    numbers = runtime.persist_table(numbers, "distinct-numbers")
    ranks = cumulative(numbers, ["column_name"])
    sizes = numbers.groupBy(F.col("column_name").alias("cc")).agg(F.count(F.lit(1)).alias("size"))
    cell = F.floor(F.col("upto") * REST_CELLS / F.col("size"))
    # The last number of each range is a cut; the range before it ends there.
    cuts = ranks.join(F.broadcast(sizes), F.col("column_name") == F.col("cc")).where((cell > F.floor((F.col("upto") - 1) * REST_CELLS / F.col("size"))) & (cell < REST_CELLS))
    return cuts.groupBy("cc").agg(F.sort_array(F.collect_list("value")).alias("cuts"))


def number_of(value: Column) -> Column:
    """Days of dates and values of decimal numbers, null for other text."""
    return F.coalesce(day_number(value).cast("double"), F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.cast("double")))


def stability(counts: DataFrame, bins: int = 20, floor: float = 1e-5) -> DataFrame:
    """Population stability index and chi-square of each load's values against all loads together, per column.

    Cells are the `bins` most common values over all loads, one for nulls, and for all other values REST_CELLS ranges of
    numbers and dates, which hold equally many distinct ones, and REST_CELLS hash cells of what is neither. Empty shares
    count as `floor`. One row (load, column_name, psi, chi_square, cells).
    """
    overall = runtime.persist_table(counts.groupBy("column_name", "value").agg(F.sum("n").alias("n")), "overall-counts")
    ranked = overall.where("value is not null").withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))).where(F.col("r") <= bins)
    tops = ranked.select(F.col("column_name").alias("c"), F.col("value").alias("v"), F.col("r"))
    cuts = rest_cuts(overall)
    # The number is bound once: within the filter it would be parsed again for every cut.
    ranged = bins + 1 + F.transform(F.array(number_of(F.col("value"))), lambda y: F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < y)))[0]
    hashed = bins + 1 + REST_CELLS + F.pmod(F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long"), F.lit(REST_CELLS)).cast("int")
    cell = F.when(F.col("value").isNull(), 0).otherwise(F.coalesce("r", F.when(number_of(F.col("value")).isNotNull(), ranged), hashed))
    marked = counts.join(F.broadcast(tops), (F.col("column_name") == F.col("c")) & (F.col("value") == F.col("v")), "left").join(F.broadcast(cuts), F.col("column_name") == F.col("cc"), "left")
    by_load = marked.groupBy("load", "column_name", cell.alias("cell")).agg(F.sum("n").alias("n"))
    of_all = by_load.groupBy("column_name", "cell").agg(F.sum("n").alias("all_n"))
    loads = by_load.groupBy("load", "column_name").agg(F.sum("n").alias("load_n"))
    sizes = of_all.groupBy("column_name").agg(F.sum("all_n").alias("size"))
    grid = loads.join(of_all, "column_name").join(sizes, "column_name")
    same = F.col("g.load").eqNullSafe(F.col("b.load")) & (F.col("g.column_name") == F.col("b.column_name")) & (F.col("g.cell") == F.col("b.cell"))
    pairs = grid.alias("g").join(by_load.alias("b"), same, "left").select("g.load", "g.column_name", "g.load_n", (F.coalesce("b.n", F.lit(0)) / F.col("g.load_n")).alias("p"), (F.col("g.all_n") / F.col("g.size")).alias("q"))
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))
    return pairs.groupBy("load", "column_name").agg(
        F.sum((p - q) * F.log(p / q)).alias("psi"), F.sum(F.col("load_n") * (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) / q).alias("chi_square"), F.count(F.lit(1)).alias("cells")
    )
