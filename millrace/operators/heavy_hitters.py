"""Problem 5: most frequent items in bounded memory.

Each partition feeds a sketch of two parts. The heavy part is an array of buckets with a few exact lanes each; a newcomer
to a full bucket casts votes against it, and when the votes outweigh the weakest lane by RATIO, that lane is evicted and
the newcomer takes its place. Evicted and rejected counts go to the light part, an array of counters. Partitions merge by
recombining buckets: counts of equal items add up, the strongest lanes of each bucket stay, the rest falls into the
counters. For every item, lane count <= true count <= lane count + its counter, so an item outside the heavy part is no
more frequent than its counter says: counters above a threshold tell exactly where something could be missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime

BUCKETS, LANES, CELLS, RATIO = 1024, 8, 1 << 16, 8
#: Sketches per core of the session at most: beyond that a task fills one sketch from several splits of the input.
SKETCHES_PER_CORE = 8
#: Rows gathered before the sketch takes them, so that copies are counted once per chunk.
CHUNK = 1 << 18

SKETCH = "col int, cell int, bucket int, item bigint, n bigint"


def slots(h):
    """Bucket and counter of a 64-bit hash, for numpy arrays and for columns alike."""
    if isinstance(h, Column):
        return F.shiftrightunsigned(h, 54).cast("int"), F.shiftrightunsigned(h, 20).bitwiseAND(CELLS - 1).cast("int")
    u = h.astype(np.uint64)
    return (u >> np.uint64(54)).astype(np.int64), ((u >> np.uint64(20)) & np.uint64(CELLS - 1)).astype(np.int64)


class ElasticSketch:
    """The sketch of one partition and column. add() takes distinct items with their hashes and counts."""

    def __init__(self) -> None:
        self.item = np.zeros((BUCKETS, LANES), np.int64)
        self.hash = np.zeros((BUCKETS, LANES), np.int64)
        self.n = np.zeros((BUCKETS, LANES), np.int64)
        self.votes = np.zeros(BUCKETS, np.int64)
        self.light = np.zeros(CELLS, np.int64)
        self.rows = 0

    def add(self, item: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        self.rows += int(n.sum())
        bucket, _ = slots(h)
        held = (self.item[bucket] == item[:, None]) & (self.n[bucket] > 0)
        hit = held.any(axis=1)
        self.n[bucket[hit], held[hit].argmax(axis=1)] += n[hit]
        item, h, n, bucket = item[~hit], h[~hit], n[~hit], bucket[~hit]
        order = np.lexsort((-n, bucket))
        item, h, n, bucket = item[order], h[order], n[order], bucket[order]
        first = np.r_[True, bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
        turn = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0)) if len(bucket) else bucket
        by_turn = np.argsort(turn, kind="stable")
        ends = np.cumsum(np.bincount(turn)) if len(bucket) else []
        start = 0
        for end in ends:  # each turn has at most one newcomer per bucket
            k = by_turn[start:end]
            self._turn(item[k], h[k], n[k], bucket[k])
            start = end

    def _turn(self, item: np.ndarray, h: np.ndarray, n: np.ndarray, b: np.ndarray) -> None:
        lane = self.n[b].argmin(axis=1)
        weakest = self.n[b, lane]
        free = weakest == 0
        votes = self.votes[b] + np.where(free, 0, n)
        swap = ~free & (votes >= RATIO * weakest)
        lost, cell_in = ~free & ~swap, slots(h)[1]
        np.add.at(self.light, cell_in[lost], n[lost])
        np.add.at(self.light, slots(self.hash[b[swap], lane[swap]])[1], weakest[swap])
        self.votes[b] = np.where(swap, 0, votes)
        take = free | swap
        at = (b[take], lane[take])
        self.item[at], self.hash[at], self.n[at] = item[take], h[take], n[take]

    def rows_out(self, col: int) -> pa.RecordBatch:
        """Sketch rows: lanes, counters (bucket -1) and the number of values (bucket -2)."""
        b, lane = np.nonzero(self.n)
        c = np.nonzero(self.light)[0]
        cell = np.r_[slots(self.hash[b, lane])[1], c, [0]].astype(np.int32)
        bucket = np.r_[b, np.full(len(c), -1), [-2]].astype(np.int32)
        item = np.r_[self.item[b, lane], np.zeros(len(c) + 1, np.int64)]
        n = np.r_[self.n[b, lane], self.light[c], [self.rows]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), col, np.int32)), pa.array(cell), pa.array(bucket), pa.array(item), pa.array(n)], names=["col", "cell", "bucket", "item", "n"])


def _fill(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [ElasticSketch() for _ in range(width)]
        pending: list[list[pa.RecordBatch]] = [[]]

        def flush() -> None:
            if not pending[0]:
                return
            t = pa.Table.from_batches(pending[0])
            pending[0] = []
            for k, s in enumerate(sketches):
                mask = t.column(2 * k).is_valid()
                item, h = (t.column(2 * k + j).filter(mask).to_numpy() for j in (0, 1))
                if len(item):
                    u, at, n = np.unique(item, return_index=True, return_counts=True)
                    s.add(u, h[at], n)

        size = 0
        for b in batches:
            pending[0].append(b)
            size += b.num_rows
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        for k, s in enumerate(sketches):
            yield s.rows_out(k)

    return run


def _items(df: DataFrame, columns: Sequence[str]) -> list[tuple[Column, Column]]:
    """Of each column its item (the value itself for integers, else its hash) and hash."""
    kinds = dict(zip(df.columns, [f.dataType for f in df.schema.fields], strict=True))
    out = []
    for c in columns:
        h = F.when(F.col(c).isNotNull(), F.xxhash64(c))
        whole = isinstance(kinds[c], T.LongType | T.IntegerType | T.ShortType | T.ByteType)
        out.append((F.col(c).cast("long") if whole else h, h))
    return out


def sketch(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged sketch of the columns in one pass over df: (lanes, counters, totals).

    lanes: (col, item, cell, low, high), bounds of the item's count; counters: (col, cell, n); totals: (col, rows), the
    non-null values. col is the position in `columns`. A task holds BUCKETS x LANES lanes and CELLS counters per
    column however many rows or values it has, and there are at most SKETCHES_PER_CORE tasks a core: what is merged grows with
    the cluster, not with the table. Nulls are not counted. An empty table has totals of 0 or no row.
    """
    pairs = _items(df, columns)
    flat = df.select(*[x.alias(f"_{k}{j}") for k, pair in enumerate(pairs) for j, x in (("i", pair[0]), ("h", pair[1]))])
    flat = flat.coalesce(SKETCHES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    parts = runtime.persist_table(runtime.map_arrow(flat, _fill(len(pairs)), SKETCH), "sketch-parts")
    lanes = parts.where("bucket >= 0").groupBy("col", "bucket", "item", "cell").agg(F.sum("n").alias("n"))
    strongest = Window.partitionBy("col", "bucket").orderBy(F.desc("n"), "item")
    ranked = runtime.persist_table(lanes.withColumn("r", F.row_number().over(strongest)), "sketch-lanes")
    counters = parts.where("bucket = -1").select("col", "cell", "n").unionByName(ranked.where(F.col("r") > LANES).select("col", "cell", "n"))
    counters = runtime.persist_table(counters.groupBy("col", "cell").agg(F.sum("n").alias("n")), "sketch-counters")
    kept = ranked.where(F.col("r") <= LANES).select("col", "item", "cell", F.col("n").alias("low"))
    bounds = kept.join(counters.withColumnRenamed("n", "more"), ["col", "cell"], "left").select("col", "item", "cell", "low", (F.col("low") + F.coalesce("more", F.lit(0))).alias("high"))
    totals = parts.where("bucket = -2").groupBy("col").agg(F.sum("n").alias("rows"))
    return bounds, counters, totals


def most_frequent(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k items with the greatest lane counts of each column: (column_name, item_value, low, high, rows)."""
    bounds, _, totals = sketch(df, columns)
    top = bounds.withColumn("r", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("low"), "item"))).where(F.col("r") <= k)
    return top.join(totals, "col").select(_name(columns).alias("column_name"), F.col("item").alias("item_value"), "low", "high", "rows")


def _name(columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col") + 1)


def above_share(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """Exactly the items held by more than `share` of the non-null rows: (column_name, item_value, item_text, n, rows).

    item_value is the value of integer columns and the hash of others, item_text the value as text.

    Candidates are the lanes whose upper bound exceeds the share; they are at most BUCKETS x LANES per column, and a second
    pass counts them. If a counter exceeds the share, an item outside the lanes may hide in it: the second pass then also
    counts the items that fall into that counter (at most 1/share such counters per column), so none is missed.
    """
    bounds, counters, totals = sketch(df, columns)
    totals = runtime.persist_table(totals, "sketch-totals")
    enough = F.col("rows") * share
    candidates = bounds.join(totals, "col").where(F.col("high") > enough).select("col", "item")
    full = counters.join(totals, "col").where(F.col("n") > enough).select("col", "cell")
    kept = bounds.select("col", "item")
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("col"), i.alias("item"), slots(h)[1].alias("cell"), F.col(c).cast("string").alias("text")) for k, (c, (i, h)) in enumerate(zip(columns, _items(df, columns), strict=True))]))
    rows = df.select(cells.alias("x")).select("x.*").where("item is not null")
    hits = rows.join(F.broadcast(candidates), ["col", "item"], "left_semi").select("col", "item", "text")
    if not full.isEmpty():
        hidden = rows.join(F.broadcast(full), ["col", "cell"], "left_semi").join(F.broadcast(kept), ["col", "item"], "left_anti").select("col", "item", "text")
        hits = hits.unionByName(hidden)
    exact = hits.groupBy("col", "item", "text").agg(F.count(F.lit(1)).alias("n")).join(totals, "col").where(F.col("n") > enough)
    return exact.select(_name(columns).alias("column_name"), F.col("item").alias("item_value"), F.col("text").alias("item_text"), "n", "rows")
