"""Statistics of columns by time, drift between periods, and comparison of two versions of a table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime

LOW_CARDINALITY = 100
PERCENTILES = [k / 20 for k in range(21)]
#: Shares of nothing count as this in the stability index.
EMPTY_SHARE = 1e-5
#: Moderate and severe drift by metric.
THRESHOLDS = {"psi": (0.1, 0.2), "hellinger": (0.05, 0.15), "jensen_shannon": (0.05, 0.15)}


def bucketed(ts: str, bucket_ms: int) -> Column:
    return F.col(ts) - F.pmod(F.col(ts), F.lit(bucket_ms))


def column_stats(df: DataFrame, columns: Sequence[str], ts: str = "ts", bucket_ms: int = 3_600_000) -> DataFrame:
    """One row per time bucket: total rows and, per column, nulls; for numbers also zeros, min, max, average, variance.
    All of it in one aggregate."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("total_count")]
    for c in columns:
        x = F.col(c)
        aggs.append(F.sum(x.isNull().cast("long")).alias(f"{c}_null_sum"))
        if isinstance(kinds[c], T.NumericType):
            aggs += [F.sum((x == 0).cast("long")).alias(f"{c}_zero_sum"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x.cast("double")).alias(f"{c}_average"), F.var_pop(x.cast("double")).alias(f"{c}_variance")]
    return df.groupBy(bucketed(ts, bucket_ms).alias("bucket")).agg(*aggs)


def merge_stats(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of buckets merged into those of the whole range."""
    n = F.col("total_count")
    aggs = [F.sum(n).alias("total_count")]
    for c in columns:
        aggs.append(F.sum(f"{c}_null_sum").alias(f"{c}_null_sum"))
        if f"{c}_average" in stats.columns:
            own, mean, var = n - F.col(f"{c}_null_sum"), F.col(f"{c}_average"), F.col(f"{c}_variance")
            total = F.sum(own)
            middle = F.sum(own * mean) / total
            aggs += [F.sum(f"{c}_zero_sum").alias(f"{c}_zero_sum"), F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), middle.alias(f"{c}_average"), (F.sum(own * (var + mean * mean)) / total - middle * middle).alias(f"{c}_variance")]
    return stats.agg(*aggs)


def null_rates(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stats.select("bucket", *[(F.col(f"{c}_null_sum") / F.col("total_count")).alias(f"{c}_null_rate") for c in columns])


def cardinalities(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in columns]).head()
    return {c: row[c] for c in columns}


def enhanced_stats(df: DataFrame, columns: Sequence[str], ts: str = "ts", bucket_ms: int = 3_600_000, low: int = LOW_CARDINALITY) -> DataFrame:
    """column_stats plus, by cardinality: exact distincts and a histogram for few values, approximate distincts and 21
    percentiles for many numbers; trues of booleans. Histograms count by value before they are gathered."""
    from millrace.plans.shapes import aggregate
    from millrace.spec import Aggregation, Operation

    kinds = {f.name: f.dataType for f in df.schema.fields}
    card = cardinalities(df, [c for c in columns if not isinstance(kinds[c], T.BooleanType)])
    flat = df.withColumn("bucket", bucketed(ts, bucket_ms))
    for c in columns:
        if isinstance(kinds[c], T.BooleanType):
            flat = flat.withColumn(f"{c}_true_sum_in", F.col(c).cast("long"))
    aggregations = []
    for c in columns:
        if isinstance(kinds[c], T.BooleanType):
            aggregations.append(Aggregation(f"{c}_true_sum_in", Operation.SUM))
        elif card[c] <= low:
            aggregations += [Aggregation(c, Operation.UNIQUE_COUNT), Aggregation(c, Operation.HISTOGRAM)]
        else:
            aggregations.append(Aggregation(c, Operation.APPROX_UNIQUE_COUNT))
            if isinstance(kinds[c], T.NumericType):
                aggregations.append(Aggregation(c, Operation.APPROX_PERCENTILE, percentiles=PERCENTILES))
    rich = aggregate(flat, ["bucket"], [p for a in aggregations for p in a.parts()])
    return column_stats(df, columns, ts, bucket_ms).join(rich, "bucket", "left")


def drift_terms(metric: str, a: Column, b: Column) -> Column:
    """Contribution of one cell with shares a and b."""
    if metric == "psi":
        a, b = F.when(a == 0, EMPTY_SHARE).otherwise(a), F.when(b == 0, EMPTY_SHARE).otherwise(b)
        return (b - a) * F.log(b / a)
    if metric == "hellinger":
        return F.pow(F.sqrt(a) - F.sqrt(b), F.lit(2)) / 2
    m = (a + b) / 2
    kl = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return (kl(a) + kl(b)) / 2


def histogram_drift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row (psi, hellinger, jensen_shannon) between the value distributions of a column in two frames."""
    side = lambda d, n: d.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias(n))
    both = side(before, "a").join(side(after, "b"), "value", "full")
    # Shares need totals: they ride along as one-row aggregates of the counted values.
    counted = runtime.persist_table(both.fillna(0, ["a", "b"]), "drift")
    sums = counted.agg(F.sum("a"), F.sum("b")).head()
    total_a, total_b = (float(x or 0) or math.nan for x in sums)
    a, b = F.col("a") / F.lit(total_a), F.col("b") / F.lit(total_b)
    return counted.agg(*[F.sum(drift_terms(m, a, b)).alias(m) for m in THRESHOLDS])


def severity(metric: str, score: Column) -> Column:
    moderate, severe = THRESHOLDS[metric]
    return F.when(score < moderate, "LOW").when(score < severe, "MODERATE").when(score.isNotNull(), "SEVERE")


def interval_shares(percentiles: Sequence[float], breaks: Sequence[float]) -> list[float]:
    """How many of the equal steps between percentiles fall between each two breaks; a step across a break is divided in
    proportion. Steps of no width belong where they lie; breaks are left inclusive, right exclusive."""
    out = [0.0] * (len(breaks) - 1)
    for lo, hi in zip(percentiles, percentiles[1:], strict=False):
        for k, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False)):
            if lo == hi:
                out[k] += a <= lo < b
            else:
                out[k] += max(0.0, min(hi, b) - max(lo, a)) / (hi - lo)
    return out


def percentile_distance(a: Sequence[float], b: Sequence[float], metric: str) -> float:
    """Drift between two distributions given by their percentiles."""
    breaks = sorted({*a, *b})
    pa, pb = interval_shares(a, breaks), interval_shares(b, breaks)
    sa, sb = sum(pa), sum(pb)
    if not sa or not sb:
        return math.nan
    total = 0.0
    for x, y in zip((v / sa for v in pa), (v / sb for v in pb), strict=True):
        if metric == "psi":
            x, y = x or EMPTY_SHARE, y or EMPTY_SHARE
            total += (y - x) * math.log(y / x)
        elif metric == "hellinger":
            total += (math.sqrt(x) - math.sqrt(y)) ** 2 / 2
        else:
            m = (x + y) / 2
            total += sum(v * math.log(v / m) for v in (x, y) if v > 0) / 2
    return total


def sketch_distance(before: DataFrame, after: DataFrame, column: str, k: int = 200) -> DataFrame:
    """One row (largest, psi): the largest gap between the cumulative distributions of a number in two frames, and the
    stability index over twenty cells of the first, both from sketches of bounded size. Null if a side has no values."""
    spark = before.sparkSession
    sketch = lambda d: d.agg(F.when(F.count(column) > 0, F.call_function("kll_sketch_agg_double", F.col(column).cast("double"), F.lit(k)))).head()[0]
    a, b = sketch(before), sketch(after)
    one = spark.range(1)
    if a is None or b is None:
        return one.select(*[F.lit(None).cast("double").alias(n) for n in ("largest", "psi")])
    points = F.array(*[F.lit(p) for p in PERCENTILES])
    quantiles = one.select(*[F.call_function("kll_sketch_get_quantile_double", F.lit(bytes(s)), points).alias(n) for n, s in (("a", a), ("b", b))]).head()
    cells = sorted(set(quantiles.a))
    at = F.array(*[F.lit(float(x)) for x in [*cells, *sorted(set(quantiles.b))]])
    ra, rb = one.select(*[F.call_function("kll_sketch_get_rank_double", F.lit(bytes(s)), at) for s in (a, b)]).head()
    psi = 0.0
    for k in range(len(cells) + 1):
        p, q = (max(0.0, (r[k] if k < len(cells) else 1.0) - (r[k - 1] if k else 0.0)) or EMPTY_SHARE for r in (ra, rb))
        psi += (q - p) * math.log(q / p)
    return one.select(F.lit(max(abs(x - y) for x, y in zip(ra, rb, strict=True))).alias("largest"), F.lit(psi).alias("psi"))


def summarize(df: DataFrame, columns: Sequence[str], ts: str = "ts", tile_ms: int = 86_400_000) -> DataFrame:
    """Tiles of drift summaries: (tile, column_name, rows, nulls, percentiles). The tile of a row is round(ts / size) * size.
    Arrays and maps are summed up by their lengths, strings by theirs."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tile = (F.round(F.col(ts) / tile_ms) * tile_ms).cast("long")
    measure = lambda c: F.size(c) if isinstance(kinds[c], T.ArrayType | T.MapType) else F.length(c) if isinstance(kinds[c], T.StringType) else F.col(c)
    rows = df.select(tile.alias("tile"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), measure(c)).cast("double").alias("x")) for c in columns])).alias("s")).select("tile", "s.*")
    return rows.groupBy("tile", "column_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("x").isNull().cast("long")).alias("nulls"), F.percentile_approx("x", PERCENTILES).alias("percentiles"))


def percentile_drift(summaries: DataFrame, lookback_ms: int, metric: str = "psi") -> DataFrame:
    """(tile, column_name, drift) of each tile against the tile lookback_ms before it."""
    old = summaries.select((F.col("tile") + lookback_ms).alias("tile"), "column_name", F.col("percentiles").alias("before"))

    runtime.send_package(summaries.sparkSession)

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or not len(x) or not len(y) else percentile_distance(list(x), list(y), metric) for x, y in zip(a, b, strict=True)], dtype="float64")

    return summaries.join(old, ["tile", "column_name"]).select("tile", "column_name", distance("before", "percentiles").alias("drift"))


def tile_changes(stats: DataFrame, tile: str, measures: Sequence[str], lookback_ms: int) -> DataFrame:
    """Per cent change of each measure against the tile lookback_ms before; null where there is none or it was 0."""
    old = stats.select((F.col(tile) + lookback_ms).alias(tile), *[F.col(m).alias(f"_old_{m}") for m in measures])
    change = lambda m: F.when(F.col(f"_old_{m}") != 0, (F.col(m) - F.col(f"_old_{m}")) / F.col(f"_old_{m}") * 100)
    return stats.join(old, tile).select(tile, *[change(m).alias(f"{m}_change") for m in measures])


def pivoted(series: DataFrame, tile: str, names: Sequence[str], by: str) -> DataFrame:
    """One row per `by` with every measure as an array in the order of tiles."""
    ordered = F.sort_array(F.collect_list(F.struct(tile, *names)))
    return series.groupBy(by).agg(ordered.alias("s")).select(by, F.col(f"s.{tile}").alias(tile), *[F.col(f"s.{n}").alias(n) for n in names])


def _edits(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(left, right, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b):
                diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
        out.append((len(a) - row[-1], len(b) - row[-1]))
    return pd.DataFrame(out, columns=["insert", "delete"], dtype="int32")


def edit_distance(spark: SparkSession, left: Column, right: Column) -> Column:
    """Struct (insert, delete): fewest insertions into and deletions from the right list that make it like the left one,
    without substitutions. A null list counts as empty."""
    runtime.send_package(spark)
    return F.pandas_udf(_edits, "insert int, delete int")(left, right)


def compare_metrics(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], mapping: Mapping[str, str] | None = None) -> DataFrame:
    """One row of metrics of two versions of a table, joined in full on keys: for each column both_null, left_null,
    right_null, mismatch and total; for numbers also the mean symmetric relative error (smape); for lists insertions,
    deletions and length mismatches in total. mapping names the right side's column where it differs."""
    mapping = mapping or {}
    a = left.select(*keys, *[F.col(c).alias(f"{c}_left") for c in columns])
    b = right.select(*keys, *[F.col(mapping.get(c, c)).alias(f"{c}_right") for c in columns])
    both = a.join(b, list(keys), "full")
    kinds = {f.name: f.dataType for f in left.schema.fields}
    aggs = []
    for c in columns:
        x, y = F.col(f"{c}_left"), F.col(f"{c}_right")
        count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
        aggs += [count(x.isNull() & y.isNull()).alias(f"{c}_both_null"), count(x.isNull() & y.isNotNull()).alias(f"{c}_left_null"), count(x.isNotNull() & y.isNull()).alias(f"{c}_right_null"), F.count(F.lit(1)).alias(f"{c}_total")]
        if not isinstance(kinds[c], T.MapType):
            aggs.append(count(x != y).alias(f"{c}_mismatch"))
        if isinstance(kinds[c], T.NumericType):
            size = F.abs(x) + F.abs(y)
            aggs.append(F.avg(F.when(size != 0, 2 * F.abs(x - y).cast("double") / size).when(size == 0, 0.0)).alias(f"{c}_smape"))
        if isinstance(kinds[c], T.ArrayType):
            both = both.withColumn(f"_{c}_edit", edit_distance(left.sparkSession, x, y))
            aggs += [F.sum(F.col(f"_{c}_edit.insert")).alias(f"{c}_inserts"), F.sum(F.col(f"_{c}_edit.delete")).alias(f"{c}_deletes"), count(F.size(x) != F.size(y)).alias(f"{c}_mismatch_length")]
    return both.agg(*aggs)


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Rows that the two frames do not share, with `a_<column>` and `b_<column>` side by side. Null keys are equal; numbers
    differ beyond the tolerance."""
    columns = [c for c in a.columns if c not in keys]
    left = a.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    on = reduce(lambda x, y: x & y, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    kinds = {f.name: f.dataType for f in a.schema.fields}

    def off(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if isinstance(kinds[c], T.FloatType | T.DoubleType | T.DecimalType):
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
        if isinstance(kinds[c], T.MapType):
            return ~F.array_sort(F.map_entries(x)).eqNullSafe(F.array_sort(F.map_entries(y)))
        return ~x.eqNullSafe(y)

    wrong = reduce(lambda x, y: x | y, [off(c) for c in columns], F.lit(False)) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return left.join(right, on, "full").where(wrong).select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], *[F.col(f"{s}_{c}") for c in columns for s in "ab"])


def consistency(logged: DataFrame, recomputed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Metrics of logged answers against the recomputed ones; keys logged several times count once."""
    return compare_metrics(logged.dropDuplicates(list(keys)), recomputed, keys, columns)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, rows) of the values that hold more than `share` of the non-null rows."""
    from millrace.operators.heavy_hitters import above_share

    found = above_share(df, [key], share)
    return found.select(F.col("item_text").cast(df.schema[key].dataType).alias(key), F.col("n").alias("rows"))


def timestamp_checks(df: DataFrame, ts: str = "ts", low: int = 31_536_000_000, high: int = 4_102_473_599_999) -> DataFrame:
    """Rows, null times and times outside of what epoch milliseconds of 1971 to 2099 can be."""
    t = F.col(ts)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(t.isNull().cast("long")).alias("null_ts"), F.sum(F.coalesce((t < low) | (t > high), F.lit(False)).cast("long")).alias("bad_ts"))


def running_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group; partial limits go before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
