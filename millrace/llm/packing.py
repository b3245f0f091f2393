"""Problem 8: items of varying length into containers of fixed capacity with little unused space.

The corpus is reduced to a histogram of lengths, which a capacity bounds whatever the number of items. Over it stands the
configuration linear program: a configuration is a multiset of lengths that fits a container, and each length's items must
be covered by as few configurations as possible. Multiplicative weights solve it: prices start at the lengths and fall as
lengths are covered, and each round buys the configuration worth most, found by dynamic programming over the capacity,
until every length is covered. No solution is below the items' total over the capacity, which tells how good it is. The
fractional solution is rounded; what is left is filled by the same knapsack to the last item. Items take their places in
the plan by rank within their length, in parallel.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace import runtime

#: Finest division of a capacity in the plan: larger capacities count in units, lengths rounded up.
UNITS = 4096
#: Purchases by which the step of the fractional solution is scaled, how fast prices fall, and what long items cost more.
PURCHASES, DECAY, LONG = 1000, 3.0, 1.0
#: Lengths that a purchase considers first, and the unused share of a container up to which their best is taken.
ORACLE_CLASSES, GAP = (24, 96), 0.002
#: Items ranked in one group; hotter lengths are cut into salted groups.
GROUP_ITEMS = 500_000


def load_tokenizer(path: str, pattern: str | None = None):
    """A function from a list of texts to their token counts, by the kind of file: .tiktoken, .json or .model. `pattern` is
    the splitting pattern of a .tiktoken file, by default the one that comes with the files."""
    if path.endswith(".tiktoken"):
        import tiktoken

        pattern = pattern or default_pattern()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in p.encode(texts, num_threads=1)]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _count(name: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(SparkFiles.get(name), pattern)
        for b in batches:
            sizes = count([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["item", "size"])

    return run


def token_sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """(item, size) of each row: its id and tokens of the whole text; null texts have none. The driver's tokenizer file is sent
    to the executors."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name, pattern = os.path.basename(tokenizer), default_pattern() if tokenizer.endswith(".tiktoken") else None
    return runtime.map_arrow(docs.select(F.col(doc_id).cast("long").alias("item"), F.col(text).cast("string").alias("text")), _count(name, pattern), "item long, size long", runtime.TEXT_ROWS)


@dataclass
class Config:
    """`copies` containers, each with `amounts[k]` items of class `classes[k]`."""

    copies: int
    classes: np.ndarray
    amounts: np.ndarray


class Knapsack:
    """The most valuable content of one container: bounded knapsack by dynamic programming over the units."""

    def __init__(self, sizes: np.ndarray, units: int):
        self.sizes, self.units = sizes, units

    def best(self, values: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Amount of each class, at most limit[k] of class k. Amounts are put together from powers of two of a class."""
        parts = []
        for k in np.flatnonzero((limit > 0) & (values > 0)).tolist():
            left, chunk = min(int(limit[k]), self.units // int(self.sizes[k])), 1
            while left > 0:
                parts.append((k, min(chunk, left)))
                left, chunk = left - chunk, chunk * 2
        worth, sums = np.zeros(self.units + 1, np.float32), np.empty(self.units + 1, np.float32)
        taken = np.zeros((len(parts), self.units + 1), bool)
        for row, (k, c) in zip(taken, parts, strict=True):
            w = c * int(self.sizes[k])
            rest, above = sums[: self.units + 1 - w], worth[w:]
            np.add(worth[: self.units + 1 - w], np.float32(c * values[k]), out=rest)
            np.greater(rest, above, out=row[w:])
            np.maximum(rest, above, out=above)
        amounts, at = np.zeros(len(self.sizes), np.int64), self.units
        for row, (k, c) in zip(taken[::-1], parts[::-1], strict=True):
            if row[at]:
                amounts[k] += c
                at -= c * int(self.sizes[k])
        return amounts


def fullest(sack: Knapsack, values: np.ndarray, limit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Amounts of the configuration worth most. Those of the classes `first` and of evenly spread others are tried before
    all, a few at first: a configuration without more than GAP of unused space is as good as any, to that share."""
    there = np.flatnonzero(limit)
    for n in ORACLE_CLASSES:
        if len(there) > 2 * n:
            some = np.zeros(len(limit), np.int64)
            chosen = np.r_[first[:n], there[:: -(-len(there) // n)]]
            some[chosen] = limit[chosen]
            a = sack.best(values, some)
            if a @ sack.sizes >= (1 - GAP) * sack.units:
                return a
    return sack.best(values, limit)


def least_containers(sack: Knapsack, demand: np.ndarray, prices: list[np.ndarray]) -> float:
    """A lower bound on the containers of any packing, fractional ones included: the items' total over the capacity, dual
    feasible functions for items beyond a half, a third and so on of it, and duals from prices: what all items are worth over
    what a container can hold of it."""
    part = sack.sizes / sack.units
    bounds = [float(demand @ part)]
    for k in range(1, 8):
        up = (k + 1) * part
        bounds.append(float(demand @ np.where(up == np.floor(up), part, np.floor(up) / k)))
    for p in prices:
        bounds.append(float(p @ demand) / float(p @ sack.best(p, demand)) * (1 - 1e-5))
    return max(bounds)


def cover(sack: Knapsack, demand: np.ndarray, prices: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """The fractional solution: configurations and how often each is used, which together cover every class exactly once.
    `prices` receives the weights at a quarter, a half and three quarters of the way, for bounds.

    Prices start at the lengths, long ones a little above, and fall as a class is covered. A purchase covers a class of its
    configuration by a step or to the end, so there are at most len(demand) / step of them: PURCHASES, or the classes.
    """
    need, bought, step = np.ones(len(demand)), {}, min(1.0, (len(demand) + 1) / PURCHASES)
    worth = sack.sizes * (1 + LONG * sack.sizes / sack.units)
    bulk = demand * sack.sizes / max(1, int(demand @ sack.sizes))
    while (need > 0).any():
        if len(prices) < 3 and 1 - need @ bulk >= (len(prices) + 1) / 4:
            prices.append(worth * np.exp(DECAY * (need - 1)))
        limit = np.where(need > 0, demand, 0)
        open_ = np.flatnonzero(need > 0)
        a = fullest(sack, worth * np.exp(DECAY * (need - 1)), limit, open_[np.argsort(-need[open_] * sack.sizes[open_], kind="stable")])
        k = np.flatnonzero(a)
        share = a[k] / demand[k]
        times = min((need[k] / share).min(), (step / share).min())
        need[k] -= times * share
        need[need < 1e-9] = 0
        key = a.tobytes()
        bought[key] = (a, bought[key][1] + times) if key in bought else (a, times)
    return list(bought.values())


def plan(sizes: np.ndarray, demand: np.ndarray, units: int, shares: dict[str, float] | None = None) -> list[Config]:
    """Configurations that place exactly demand[k] items of size sizes[k] (1..units) each. Sizes ascend. `shares` receives
    the units placed by the rounded program (`lp`) and by the knapsack after it (`knapsack`), the value of the fractional
    solution in containers (`value`) and a bound below which no solution is (`bound`)."""
    sack, left = Knapsack(sizes, units), demand.astype(np.int64).copy()
    out: list[Config] = []

    def use(amounts: np.ndarray, copies: int) -> None:
        k = np.flatnonzero(amounts)
        out.append(Config(copies, k, amounts[k]))
        left[k] -= copies * amounts[k]

    prices: list[np.ndarray] = []
    bought = cover(sack, left.copy(), prices)
    # Rounding carries the fractions on, so that the rounded uses add up to the fractional ones where items are left.
    carry = 0.0
    for a, times in sorted(bought, key=lambda x: -x[1]):
        k = np.flatnonzero(a)
        copies = int(min(np.floor(times + carry + 1e-9), (left[k] // a[k]).min()))
        carry = min(carry + times - copies, 1.0)
        if copies > 0:
            use(a, copies)
    by_lp = int(sizes @ (demand - left))
    while left.any():  # prefer long items a little: short ones fit anywhere later
        there = np.flatnonzero(left)
        a = fullest(sack, sizes * (1 + 0.1 * sizes / units), left, there[::-1])
        k = np.flatnonzero(a)
        use(a, int((left[k] // a[k]).min()))
    if shares is not None:
        shares |= {"lp": by_lp, "knapsack": int(sizes @ demand) - by_lp, "value": float(sum(t for _, t in bought)), "bound": least_containers(sack, demand, prices) if len(demand) else 0.0}
    return out


def _layout(configs: list[Config]) -> list[tuple[int, int, int, int, int]]:
    """Rows (class, first rank, past last rank, first container, items per container)."""
    rank: dict[int, int] = {}
    rows, container = [], 0
    for c in configs:
        for k, a in zip(c.classes.tolist(), c.amounts.tolist(), strict=True):
            start = rank.get(k, 0)
            rank[k] = start + c.copies * a
            rows.append((k, start, rank[k], container, a))
        container += c.copies
    return rows


LAYOUT = "container_kind string, class int, rank_from long, rank_to long, first_container long, per_container long, containers long, lp_share double, lp_value double, at_least double"


def _planned(key: tuple, histogram: pd.DataFrame) -> pd.DataFrame:
    """Layout rows of one kind of container from its histogram (class, n)."""
    kind, capacity = key
    own = histogram.sort_values("class")
    sizes, shares = own["class"].to_numpy(np.int64), {}
    configs = plan(sizes, own["n"].to_numpy(np.int64), int(capacity) // -(-int(capacity) // UNITS), shares)
    rows = pd.DataFrame(_layout(configs), columns=["class", "rank_from", "rank_to", "first_container", "per_container"])
    rows["class"] = sizes[rows["class"].to_numpy(np.int64)]
    placed = shares["lp"] + shares["knapsack"]
    return rows.assign(container_kind=kind, containers=sum(c.copies for c in configs), lp_share=shares["lp"] / max(placed, 1), lp_value=shares["value"], at_least=shares["bound"])[[x.split()[0] for x in LAYOUT.split(", ")]]


def pieces_of(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container_kind, capacity, item, piece, size, class) of the items' pieces for each kind; items without size have none."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity"), F.lit(-(-c // UNITS)).cast("long").alias("unit")) for k, c in capacities.items()]))
    held = items.where("size > 0").select("item", "size", kinds.alias("k")).select("item", "size", "k.*")
    cuts = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div capacity"))).alias("piece"))
    pieces = cuts.select("container_kind", "capacity", "item", "piece", F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).alias("size"), "unit")
    # A piece longer than the whole units of its container fills them all.
    return pieces.withColumn("class", F.expr("least((size + unit - 1) div unit, capacity div unit)").cast("int")).drop("unit")


def layouts(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """The plans of all kinds: which ranks of which class go where, the containers used, the share of units that the rounded
    program places, the value of its fractional solution and the bound below it. Each kind is planned by one task from its
    histogram, which has at most UNITS rows."""
    runtime.send_package(items.sparkSession)
    histogram = pieces_of(items, capacities).groupBy("container_kind", "capacity", "class").agg(F.count(F.lit(1)).alias("n"))
    planned = histogram.repartition(len(capacities), "container_kind").groupBy("container_kind", "capacity").applyInPandas(_planned, LAYOUT)
    return runtime.persist_table(planned, "pack-layout")


def sized(items: DataFrame) -> DataFrame:
    return runtime.persist_table(items.select("item", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "pack-items")


def pack(items: DataFrame, capacities: dict[str, int], layout: DataFrame | None = None) -> DataFrame:
    """(container_kind, container_id, item, piece, size) of items (item, size) for each kind of container.

    An item longer than the capacity is cut into full pieces and a rest; no other is cut. Items of size 0 or null need no
    container: they have one row with null container_id, piece 0 and size 0. Rows that repeat are items of their own.
    Capacities below 1 are an error. layout: that of the same items, if it is there already.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be at least 1")
    if not capacities:
        return items.select(F.lit("").alias("container_kind"), F.lit(None).cast("long").alias("container_id"), "item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size")).limit(0)
    if layout is None:
        items = sized(items)
        layout = layouts(items, capacities)
    pieces = pieces_of(items, capacities).drop("capacity")
    hottest = layout.groupBy("container_kind", "class").agg(F.max("rank_to").alias("n")).agg(F.max("n")).first()[0] or 1

    salt = F.pmod(F.xxhash64("item", "piece"), F.lit(-(-hottest // GROUP_ITEMS))).cast("int")
    group = ["container_kind", "class", "salt"]
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("container_kind", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = salted.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("item", "piece")) - 1)
    ranked = local.join(offsets, group).select("container_kind", "class", "item", "piece", "size", (F.col("r") + F.col("offset")).alias("rank"))
    places = layout.select(F.col("container_kind").alias("k"), F.col("class").alias("c"), "rank_from", "rank_to", "first_container", "per_container")
    on = (F.col("container_kind") == F.col("k")) & (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.join(runtime.broadcast_if_small(places), on).select("container_kind", (F.col("first_container") + F.expr("(rank - rank_from) div per_container")).alias("container_id"), "item", "piece", "size")
    kinds = F.explode(F.array(*[F.lit(k) for k in capacities]))
    nothing = items.where(F.coalesce("size", F.lit(0)) <= 0).select(kinds.alias("container_kind"), F.lit(None).cast("long").alias("container_id"), "item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("size"))
    return placed.unionByName(nothing)
