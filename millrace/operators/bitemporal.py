"""Problem 7: attributes as known at the time of an event.

Versions of an entity span a plane of valid time (when an attribute held) and recorded time (when it was known). At any
point of the plane exactly one version is current, so the plane splits into disjoint rectangles. With versions loaded on
days d1 < d2 < ..., known from the day after, version j is current

- for valid days d_j .. d_{j+1}-1 from recorded day d_j + 1 on, and
- for valid days from d_{j+1} on while recorded days are d_j + 1 .. d_{j+1}, until the next version is known;

before d1, or before anything is known, a rectangle with no version. Rectangles are listed in the cells of a grid over the
plane, events look into the one cell that holds their point, and a comparison with the bounds finds the rectangle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_DAYS = 16
#: Most cells that are told apart as occupied, and points of one entity in one cell that stay together.
MAX_CELLS, HOT_POINTS = 1000, 500_000
#: Beyond any day: open ends of rectangles.
FAR = 10_000_000


def rectangles(versions: DataFrame, entity: str, load_day: str, attributes: Sequence[str]) -> DataFrame:
    """(entity, v_from, v_to, r_from, r_to, known_day, <attributes>, newest_<attributes>); ends are exclusive.

    known_day and attributes are null where no version is known. newest_*: the attributes of the entity's newest version.
    Rows of one load are one version (should they differ, the greatest counts); null entities and days have no row. An
    entity has at most as many versions as loads, and copies combine before the shuffle.
    """
    v = versions.where(F.col(entity).isNotNull() & F.col(load_day).isNotNull())
    per = v.groupBy(F.col(entity).alias("entity")).agg(F.sort_array(F.collect_set(F.struct(F.col(load_day).alias("d"), F.struct(*attributes).alias("a")))).alias("h"))
    per = per.withColumn("h", F.filter("h", lambda x, i: (i == F.size("h") - 1) | (F.get("h", i + 1)["d"] != x["d"])))
    per = per.withColumn("newest", F.element_at("h", -1)["a"])
    row = lambda vf, vt, rf, rt, d, a: F.struct(vf.alias("v_from"), vt.alias("v_to"), rf.alias("r_from"), rt.alias("r_to"), d.alias("known_day"), a.alias("a"))
    far, past, nothing = F.lit(FAR), F.lit(-FAR), F.lit(None)

    def split(x, i):
        nxt = F.coalesce(F.get("h", i + 1)["d"], far)
        return F.array(row(x["d"], nxt, x["d"] + 1, far, x["d"], x["a"]), row(nxt, far, x["d"] + 1, nxt + 1, x["d"], x["a"]))

    first = F.get("h", F.lit(0))["d"]
    unknown = F.get("h", F.lit(0))
    no_day, no_attr = F.when(F.lit(False), unknown["d"]), F.when(F.lit(False), unknown["a"])
    before = F.array(row(past, first, past, far, no_day, no_attr), row(first, far, past, first + 1, no_day, no_attr))
    all_of = F.concat(before, F.flatten(F.transform("h", split)))
    flat = per.select("entity", "newest", F.inline(all_of)).where("v_from < v_to and r_from < r_to")
    return flat.select("entity", "v_from", "v_to", "r_from", "r_to", "known_day", *[F.col(f"a.{c}").alias(c) for c in attributes], *[F.col(f"newest.{c}").alias(f"newest_{c}") for c in attributes])


def occupied(points: DataFrame, entity: str, valid_day: str, known_day: str, bounds: tuple[int, int], grid_days: int) -> tuple[list[tuple[int, int]] | None, dict]:
    """The grid cells that hold points, or None if they are more than MAX_CELLS; and the entities with more than HOT_POINTS
    points in a cell, with how many. One pass; points combine before they move."""
    at = lambda c: F.floor(_within(F.col(c), bounds) / grid_days).cast("int")
    per = points.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e"), at(valid_day).alias("v"), at(known_day).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    hot = F.collect_list(F.when(F.col("n") > HOT_POINTS, F.struct("e", "n")))  # at most rows / HOT_POINTS in all
    rows = per.where("v is not null and r is not null").groupBy("v", "r").agg(hot.alias("hot")).limit(MAX_CELLS + 1).collect()
    most: dict = {}
    for r in rows:
        for x in r.hot:
            most[x.e] = max(most.get(x.e, 0), x.n)
    return (None if len(rows) > MAX_CELLS else [(r.v, r.r) for r in rows]), most


def _within(day: Column, bounds: tuple[int, int]) -> Column:
    """Beyond the first and last day on which any rectangle ends, all days are alike: they count as the day next to them."""
    return F.greatest(F.lit(bounds[0] - 1), F.least(F.lit(bounds[1] + 1), day))


def locate(points: DataFrame, entity: str, valid_day: str, known_day: str, rects: DataFrame, bounds: tuple[int, int], spread: Sequence[str], grid_days: int = GRID_DAYS) -> DataFrame:
    """Joins each point (entity, valid_day, known_day) to the rectangle that holds it; columns of points come first.

    bounds: lowest and highest load day of any version. Rectangles are listed in the cells of a grid over both axes that hold
    points (all cells if those are more than MAX_CELLS). Every point has one row; those without entity or day, and those of
    entities without any rectangle, have nulls. The points of a hot entity are spread over groups by a hash of the columns
    `spread`, its rectangles (a few per load) are copied to each group. A column of points that has the name of one of rects
    comes out as `point_<name>`.
    """
    cells, hot = occupied(points, entity, valid_day, known_day, bounds, grid_days)
    at = lambda c: F.floor(_within(c, bounds) / grid_days).cast("int")
    span = lambda a, b: (at(F.col(a)), at(F.col(b) - 1))
    (va, vb), (ra, rb) = span("v_from", "v_to"), span("r_from", "r_to")
    if cells is None:
        listed = F.flatten(F.transform(F.sequence(va, vb), lambda v: F.transform(F.sequence(ra, rb), lambda r: F.struct(v.alias("v"), r.alias("r")))))
    else:
        known = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r in cells]).cast("array<struct<v:int,r:int>>")
        listed = F.filter(known, lambda c: (c["v"] >= va) & (c["v"] <= vb) & (c["r"] >= ra) & (c["r"] <= rb))
    parts = lambda c: reduce(lambda w, e: w.when(c == F.lit(e), -(-hot[e] // HOT_POINTS)), hot, F.when(F.lit(False), 1)).otherwise(1)
    copies = F.explode(F.sequence(F.lit(0), parts(F.col("entity")) - 1)) if hot else F.lit(0)
    index = rects.withColumn("_cell", F.explode(listed)).withColumn("_salt", copies)
    carried = [c for c in rects.columns if c != "entity"]
    index = index.select(F.col("entity").alias("_entity"), F.col("_cell.v").alias("_rv"), F.col("_cell.r").alias("_rr"), F.col("_salt").alias("_rs"), *carried)
    clash = {c: f"point_{c}" for c in points.columns if c in carried}
    entity, valid_day, known_day = (clash.get(c, c) for c in (entity, valid_day, known_day))
    salt = F.pmod(F.xxhash64(*[clash.get(c, c) for c in spread]), parts(F.col(entity))).cast("int") if hot else F.lit(0)
    p = points.withColumnsRenamed(clash).withColumns({"_v": at(F.col(valid_day)), "_r": at(F.col(known_day)), "_s": salt})
    on = (F.col(entity) == F.col("_entity")) & (F.col("_v") == F.col("_rv")) & (F.col("_r") == F.col("_rr")) & (F.col("_s") == F.col("_rs"))
    inside = (F.col(valid_day) >= F.col("v_from")) & (F.col(valid_day) < F.col("v_to")) & (F.col(known_day) >= F.col("r_from")) & (F.col(known_day) < F.col("r_to"))
    return p.join(index, on & inside, "left").drop("_v", "_r", "_s", "_entity", "_rv", "_rr", "_rs")
