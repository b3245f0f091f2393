"""Streams of events: rows straight to a store, tiles of partial aggregates, changes taken back, and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.aggregates import Partials, op_for, partial_columns
from millrace.plans.mutations import _SIGNED
from millrace.serving.kv import KVStore, encoded
from millrace.sources.versions import VersionedFolder
from millrace.spec import AggregationPart, Operation

#: How far events may come out of order before the tile they belong to is closed.
LATENESS = "5 minutes"


def tile_hop(parts: Sequence[AggregationPart]) -> int:
    """Tiles as wide as the finest grid of any window."""
    return min(p.window.tail_hop() for p in parts)


def _signed_partials(p: AggregationPart, df: DataFrame, sign: str | None) -> Partials:
    op = op_for(p, df.schema[p.input_column].dataType)
    v = F.col(p.input_column)
    t = F.unix_millis(F.col("event_time"))
    if sign is None:
        return op.partial(v, t)
    s = F.col(sign)
    if p.operation == Operation.COUNT:
        return {"n": F.sum(F.when(v.isNotNull(), s))}
    if p.operation in _SIGNED:
        total = {"s": F.sum(v * s)}
        return total if p.operation == Operation.SUM else {**total, "n": F.sum(F.when(v.isNotNull(), s))}
    return op.partial(F.when(s > 0, v), t)


def tiled(events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], hop_ms: int | None = None, sign: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """(keys, tile_start, tile_end, partials) by event time, for streams and tables alike.

    events has keys, `event_time` (timestamp) and the inputs; in a stream, what is later than `lateness` behind the newest
    event is dropped from its tile (and counted in the query's progress). sign: a column of +1 and -1; rows of -1 take
    counts, sums and averages back and are ignored by other operations. One partial serves all windows of its base.
    """
    bases = {p.base: p for p in parts}
    width = F.window("event_time", f"{hop_ms or tile_hop(parts)} milliseconds")
    flat = events.withWatermark("event_time", lateness) if events.isStreaming else events
    aggs = [c for b, p in bases.items() for c in partial_columns(b, _signed_partials(p, events, sign))]
    out = flat.groupBy(*keys, width.alias("_w")).agg(*aggs)
    return out.select(*keys, F.unix_millis("_w.start").alias("tile_start"), F.unix_millis("_w.end").alias("tile_end"), *[c for c in out.columns if "__" in c])


def finished(tiles: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], kinds: dict) -> DataFrame:
    """Values of each tile from its partials."""
    bases = {p.base: p for p in parts}
    cols = []
    for b, p in bases.items():
        op = op_for(p, kinds[p.input_column])
        cols.append(op.final({n: F.col(f"`{b}__{n}`") for n in op.partial(F.lit(None), F.lit(None))}).alias(b))
    return tiles.select(*keys, "tile_start", *cols)


def merged_tiles(tiles: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], kinds: dict) -> DataFrame:
    """Values per key over all tiles, from partials that may repeat a tile in later versions: callers pass each once."""
    bases = {p.base: p for p in parts}
    ops = {b: op_for(p, kinds[p.input_column]) for b, p in bases.items()}
    names = {b: list(op.partial(F.lit(None), F.lit(None))) for b, op in ops.items()}
    merged = tiles.groupBy(*keys).agg(*[c for b, op in ops.items() for c in partial_columns(b, op.merge({n: F.col(f"`{b}__{n}`") for n in names[b]}))])
    return merged.select(*keys, *[op.final({n: F.col(f"`{b}__{n}`") for n in names[b]}).alias(b) for b, op in ops.items()])


def to_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Runs a stream into a function of micro-batches. With `once` it takes what is there and ends."""
    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=interval)).start()


def to_store(stream: DataFrame, store: KVStore, dataset: str, keys: list[str], values: list[str], millis: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each row of a stream into a key-value store under its keys and time: events as they are, or tiles as they change.
    A micro-batch that is repeated writes the same keys and times again, so nothing doubles."""
    return to_batches(stream, lambda df, _: store.bulk_put(dataset, encoded(df, keys, values, millis)), checkpoint, mode)


class TileFolder:
    """Tiles of a stream with what came too late for them, in a folder: `tiles/batch=<k>`, `late/batch=<k>` and `seen/<k>`.

    Each micro-batch adds its partials; a row is late if its tile had ended before the newest event time of the batches
    before, less the lateness allowed, and is put aside instead of dropped. `seen/<k>` is that newest time after batch k. All
    three are named by the batch, so a batch that is repeated after a failure replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], parts: Sequence[AggregationPart], hop_ms: int | None = None, lateness_ms: int = 300_000):
        self.spark, self.root, self.keys, self.parts = spark, root.rstrip("/"), list(keys), list(parts)
        self.hop, self.lateness, self._folder = hop_ms or tile_hop(parts), lateness_ms, VersionedFolder(spark, root)

    def _seen(self, batch: int) -> int | None:
        found = self._folder.read(f"seen/{batch}") if batch >= 0 else None
        return int(found) if found else None

    def write(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch: rows have keys, event_time and the inputs."""
        before = self._seen(batch - 1)
        closed = None if before is None else before - self.lateness
        at = F.unix_millis("event_time")
        late = F.lit(False) if closed is None else F.coalesce(at - F.pmod(at, F.lit(self.hop)) + self.hop <= closed, F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={batch}")
        tiled(rows.where(~late), self.keys, self.parts, self.hop).write.mode("overwrite").parquet(f"{self.root}/tiles/batch={batch}")
        newest = rows.agg(F.max(at)).first()[0]
        newest = max(x for x in (before, newest, -(1 << 62)) if x is not None)
        self._folder.write(f"seen/{batch}", str(newest))
        self._folder.publish(batch + 1)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        to_batches(stream, self.write, checkpoint, "append").awaitTermination()

    def late(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/late").drop("batch")

    def tiles(self, kinds: dict) -> DataFrame:
        """(keys, tile_start, values, complete): complete tiles take no more rows."""
        parts = self.spark.read.parquet(f"{self.root}/tiles").drop("batch")
        closed = (self._seen(self._folder.version() - 1) or 0) - self.lateness
        merged = merged_tiles(parts, [*self.keys, "tile_start", "tile_end"], self.parts, kinds)
        return merged.withColumn("complete", F.col("tile_end") <= closed).drop("tile_end")


def enriched(stream: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each event of a stream with the features of its keys from a table: a left join, so no event is lost."""
    return stream.join(features, list(keys), "left")


def before_and_after(changes: DataFrame, before: str, after: str) -> DataFrame:
    """Change records with structs of the row before and after as rows with `sign`: the old row is taken back."""
    rows = F.array_compact(F.array(F.when(F.col(before).isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col(before).alias("row"))), F.when(F.col(after).isNotNull(), F.struct(F.lit(1).alias("sign"), F.col(after).alias("row")))))
    rest = [c for c in changes.columns if c not in (before, after)]
    return changes.select(*rest, F.explode(rows).alias("_x")).select(*rest, F.col("_x.sign").alias("sign"), "_x.row.*")
