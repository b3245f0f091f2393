"""Point-in-time aggregates: for each query (keys, ts), aggregates of the events in a sawtooth window up to ts.

A window W ends at ts itself (inclusive) and begins at floor(ts - W, hop), where hop is the grid of its length. Events are
summed up in tiles of five minutes once, and those in tiles of an hour and a day. Tiles and queries of a key lie in one sorted
run, in which range frames merge each query's tiles; queries at the same place of a grid share a frame. A run is cut into
blocks as long as the longest window, with each tile in its own block and the next, so a hot key is spread over as many tasks
as it has blocks. What lies between the start of the query's five minutes and ts is a running aggregate inside them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.shapes import Shape, aggregate, shapes
from millrace.spec import UNIT_MS, AggregationPart

BIN = 5 * UNIT_MS["m"]
HOUR, DAY = UNIT_MS["h"], UNIT_MS["d"]
#: The next larger tile.
UP = {BIN: HOUR, HOUR: DAY}


def floor_to(c: Column, step: int) -> Column:
    return c - F.pmod(c, F.lit(step))


def _tail(part: AggregationPart, at: Column) -> Column | None:
    """First instant of the part's window for a query at `at`; None for unbounded."""
    return None if part.window.millis is None else floor_to(at - part.window.millis, part.window.tail_hop())


def temporal_events(queries: DataFrame, events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts") -> DataFrame:
    """(keys, ts, parts) for each distinct query whose keys and ts are not null; parts are null where no event counts.

    queries and events both have keys and ts (epoch milliseconds). Events with null ts never count. Windows must be whole
    multiples of five minutes.
    """
    keys = list(keys)
    if any(p.window.millis is not None and p.window.millis % BIN for p in parts):
        raise ValueError("windows must be multiples of five minutes")
    q = queries.select(*keys, ts).dropna().distinct().withColumn("_bin", floor_to(F.col(ts), BIN))
    bins = q.select(*keys, "_bin").distinct()
    rows = events.where(F.col(ts).isNotNull()).dropna(subset=keys)
    found = shapes(rows, keys, parts, ts)
    results = []
    for s in found:
        partials = query_partials(s, q, bins, keys, ts)
        # The values of a query go to one task at once, not each to its own and then there.
        partials = partials.repartition(*keys, ts) if s.extra else partials
        results.append(s.final(s.merge(partials, [*keys, ts]), [*keys, ts]))
    if len(found) == 1 and found[0].mode == "plain":  # its heads have every query
        return results[0].select(*keys, ts, *[F.col(f"`{p.name}`") for p in parts])
    return reduce(lambda left, r: merged(left, r, [*keys, ts], "left"), results, q.select(*keys, ts)).select(*keys, ts, *[F.col(f"`{p.name}`") for p in parts])


def merged(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A merge join on columns that are never null. Neither side is broadcast, however small it is thought to be: the size of
    queries is estimated from that of the files, and the driver would hold them whole."""
    return left.join(right.hint("merge"), list(on), how)


def query_partials(s: Shape, q: DataFrame, bins: DataFrame, keys: list[str], ts: str, strict: bool = False) -> DataFrame:
    """Rows of partials that, merged by (keys, ts), make up each query's windows. q has keys, ts and `_bin`, bins the
    distinct keys and `_bin`. strict: events at the very time of the query do not count."""
    return _head(s, q, keys, ts, strict).unionByName(_tiled(s, q, bins, keys, ts), allowMissingColumns=True)


def _head(s: Shape, q: DataFrame, keys: list[str], ts: str, strict: bool) -> DataFrame:
    """Partials of the events from the start of each query's bin up to the query."""
    own = s.frame.withColumn("_bin", floor_to(F.col(ts), BIN))
    if s.mode == "plain":
        # Queries and events of a bin in one sorted run: a running aggregate serves all its queries.
        seen = own.withColumn("_q", F.lit(False)).unionByName(q.withColumn("_q", F.lit(True)), allowMissingColumns=True)
        w = Window.partitionBy(*keys, "_bin").orderBy(ts).rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
        value = lambda p: F.when(~F.col("_q"), F.col(f"`{p.input_column}`"))
        bases = s.bases()
        running = seen.select(*keys, ts, "_q", *[c.alias(f"{b}__{n}") for b, p in bases.items() for n, c in s.op(p).partial(value(p), F.col(ts), lambda c: c.over(w)).items()]).where("_q")
        cols = [F.col(f"`{p.base}__{n}`").alias(f"{p.name}__{n}") for p in s.parts for n in s.stored(p, p.base)]
        return running.select(*keys, ts, *cols)
    near = q.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col(ts).alias("_q_ts"), F.col("_bin").alias("_q_bin"))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_q_{k}") for k in keys]) & (F.col("_bin") == F.col("_q_bin")) & (F.col(ts) < F.col("_q_ts") if strict else F.col(ts) <= F.col("_q_ts"))
    # Rows of one instant first combine, so a bin holds at most its distinct instants.
    instants = s.tiles(own, [*keys, "_bin", ts])
    hit = instants.join(near.hint("merge"), on).drop(ts).withColumnRenamed("_q_ts", ts)
    return s.merge_tiles(hit, [*keys, "_bin", ts], lambda p: None).drop("_bin")  # by bin too, as they lie after the join


def _takes(part: AggregationPart, hop: int, b: Column) -> tuple[Column, Column] | None:
    """First and end of the tiles of one size that a part takes for bin b: coarse ones from its tail on, finer ones for what
    is left of the current day and hour."""
    own, tail = part.window.tail_hop(), _tail(part, b)
    if own == hop:
        return None if tail is None else (tail, floor_to(b, hop))
    return (floor_to(b, UP[hop]), floor_to(b, hop)) if own > hop else None


def _tiled(s: Shape, q: DataFrame, bins: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Partials of the tiles between each part's tail and the bin, for every query."""
    b = F.col("_bin")
    fine = s.tiles(s.frame.withColumn("_start", floor_to(F.col(ts), BIN)), [*keys, "_start"])
    tiles = {BIN: fine, HOUR: s.coarser(fine, keys, HOUR)}
    tiles[DAY] = s.coarser(tiles[HOUR], keys, DAY)
    by_query, by_bin = [], []
    for hop in (DAY, HOUR, BIN):
        parts = [p for p in s.parts if _takes(p, hop, b)]
        if parts:
            aligned = all(p.window.tail_hop() > hop or p.window.millis % hop == 0 for p in parts)
            if s.mode == "plain" and aligned:
                by_query.append(framed(s, parts, tiles[hop], q, keys, ts, hop))
            else:
                by_bin.append(_listed(s, parts, tiles[hop], bins, keys, hop))
    if any(p.window.millis is None for p in s.parts):
        if s.extra:
            by_bin.append(_before_today(s, tiles[DAY], bins, keys))
        else:
            by_query.append(framed(s, [p for p in s.parts if p.window.millis is None], tiles[DAY], q, keys, ts, DAY))
    if by_bin:
        both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), by_bin)
        by_query.append(merged(q, both, [*keys, "_bin"]).drop("_bin"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), by_query)


def framed(s: Shape, parts: list[AggregationPart], tiles: DataFrame, q: DataFrame, keys: list[str], ts: str, hop: int) -> DataFrame:
    """For each query the tiles of one size that its windows take, in one sorted run of tiles and queries: a range frame of
    the window's length merges the tiles of its own grid (all before for no length), a frame from the start of the current
    day or hour the finer ones. q has `_bin`."""
    own = [p.window.millis for p in parts if p.window.tail_hop() == hop]
    up = UP.get(hop, hop)
    block = None if None in own else -(-max([up, *own]) // up) * up
    place = (lambda c: F.lit(0).cast("long")) if block is None else lambda c: F.floor(c / block).cast("long")
    home = place(F.col("_start"))
    blocks = F.explode(F.array(home, home + 1)) if own and block is not None else home
    marks = q.select(*keys, ts, floor_to(F.col("_bin"), hop).alias("_start")).withColumns({"_q": F.lit(True), "_block": home})
    seen = tiles.withColumn("_block", blocks).withColumn("_q", F.lit(False)).unionByName(marks, allowMissingColumns=True).withColumn("_up", floor_to(F.col("_start"), up))
    seen = seen.repartition(*keys, "_block")

    def frame(p: AggregationPart):
        if p.window.tail_hop() != hop:
            return Window.partitionBy(*keys, "_block", "_up").orderBy("_start").rangeBetween(Window.unboundedPreceding, -1)
        run = Window.partitionBy(*keys, "_block").orderBy("_start")
        return run.rangeBetween(Window.unboundedPreceding if p.window.millis is None else -p.window.millis, -1)

    cols = [c.alias(f"{p.name}__{n}") for p in parts for n, c in s.op(p).merge(s.stored(p, p.base), lambda c, p=p: c.over(frame(p))).items()]
    return seen.select(*keys, ts, "_q", *cols).where("_q").drop("_q")


def _listed(s: Shape, parts: list[AggregationPart], tiles: DataFrame, bins: DataFrame, keys: list[str], hop: int) -> DataFrame:
    """The same by joining bins to the tiles between their bounds: for buckets and values, which would have to be asked about
    one by one, and for windows that do not fit their own grid. A run is cut into blocks as long as the longest range, and a
    bin meets the tiles of its own block and of the one before. Neither side is broadcast, however small it is thought to be."""
    ranges = {p.name: _takes(p, hop, F.col("_bin")) for p in parts}
    first = reduce(F.least, [a for a, _ in ranges.values()]) if len(ranges) > 1 else next(iter(ranges.values()))[0]
    end = floor_to(F.col("_bin"), hop)
    block = max(-(-p.window.millis // hop) * hop if p.window.tail_hop() == hop else UP[hop] for p in parts)
    place = lambda c: F.floor(c / block).cast("long")
    marks = bins.where(first < end).withColumn("_block", F.explode(F.array(place(end) - 1, place(end))))
    near = tiles.withColumn("_block", place(F.col("_start"))).join(marks.hint("merge"), [*keys, "_block"]).where((F.col("_start") >= first) & (F.col("_start") < end))
    limits = {name: (F.col("_start") >= a) & (F.col("_start") < e) for name, (a, e) in ranges.items()}
    return s.merge_tiles(near, [*keys, "_bin"], lambda p: limits.get(p.name, F.lit(False)))


def _before_today(s: Shape, days: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Partials by bucket of everything before the day of each bin, for unbounded parts: a bucket's days are merged up to each
    of its days once, and a bin takes the last of them before its own day."""
    parts = [p for p in s.parts if p.window.millis is None]
    w = Window.partitionBy(*keys, "_extra").orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    cols = [c.alias(f"{p.name}__{n}") for p in parts for n, c in s.op(p).merge(s.stored(p, p.base), lambda c: c.over(w)).items()]
    after = Window.partitionBy(*keys, "_extra").orderBy("_start")
    running = days.select(*keys, "_extra", "_start", F.lead("_start").over(after).alias("_next"), *cols)
    asked = bins.withColumn("_day", floor_to(F.col("_bin"), DAY))
    holds = (F.col("_start") < F.col("_day")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("_day")))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}") == F.col(f"r.{k}") for k in keys])
    joined = asked.alias("a").join(running.alias("r"), same & holds)
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], "_bin", "_extra", *[F.col(c) for c in running.columns if "__" in c])


def temporal_by_pairs(queries: DataFrame, events: DataFrame, keys: Sequence[str], parts: Sequence[AggregationPart], ts: str = "ts") -> DataFrame:
    """The same result by joining each query to its events. For small inputs and as a check on the tiles: a hot key costs
    the product of its queries and events."""
    keys = list(keys)
    q = queries.select(*keys, ts).dropna().distinct()
    right = events.where(F.col(ts).isNotNull()).select(*[F.col(c).alias(f"_r_{c}") if c in keys or c == ts else F.col(c) for c in events.columns])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys]) & (F.col(f"_r_{ts}") <= F.col(ts))
    joined = q.join(right, on, "left").withColumnRenamed(ts, "_at").withColumnRenamed(f"_r_{ts}", ts)
    within = lambda p: None if p.window.millis is None else F.col(ts) >= _tail(p, F.col("_at"))
    return aggregate(joined, [*keys, "_at"], parts, within, ts).withColumnRenamed("_at", ts)

