"""Problem 1: put out only what is new or changed since the last successful run.

A record table is summed up in a Merkle tree. A record's place on a 63-bit line is its range (a small number that records
changed together tend to share, such as the load that brought the record) followed by a hash of its key. A leaf is one
contiguous range of the line, a node above it a union of ranges: FANOUT_BITS at a time up to the records' ranges, which
are the root's children. A leaf's digest is the xor of its records' digests, so it is built by a map-side combining aggregate whatever the
order of rows. The saved tree is compared with the current one level by level, below differing nodes only; saved records
lie on disk by range and leaf, and only those of differing leaves are read and written anew. Output, tree and records
become visible together, by one rename.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import runtime
from millrace.functions.columns import fingerprint
from millrace.sources.versions import VersionedFolder

FANOUT_BITS = 4
#: Records that a leaf holds on average when the tree is laid out; beyond 2**GROWN_BITS times as many it is laid out anew.
LEAF_RECORDS, GROWN_BITS = 16, 2
RANGE_BITS, LINE_BITS = 15, 63
#: Versions whose changed leaves are read side by side; then all live records are written into one.
LIVE_VERSIONS = 16


def place(keys: Sequence[Column], ordinal: Column) -> Column:
    """Position on the line: the range (0 to 2**15 - 1, null as 0) and 48 bits of the key's hash."""
    span = LINE_BITS - RANGE_BITS
    r = F.coalesce(ordinal.cast("long"), F.lit(0)).bitwiseAND(F.lit((1 << RANGE_BITS) - 1).cast("long"))
    return F.shiftleft(r, span).bitwiseOR(F.shiftrightunsigned(fingerprint(keys), 64 - span))


def node_at(position: Column, level: int) -> Column:
    return F.shiftright(position, LINE_BITS - level)


def bits_for(records: int, ranges: int) -> int:
    """Depth in bits at which a leaf holds about LEAF_RECORDS records."""
    per_range = max(1, records // max(1, ranges) // LEAF_RECORDS)
    return min(LINE_BITS, RANGE_BITS + (per_range - 1).bit_length())


def levels_of(bits: int) -> list[int]:
    """Depths in bits of the tree's levels from the ranges, which are the root's children, down to the leaves."""
    return [RANGE_BITS, *range(bits, RANGE_BITS, -FANOUT_BITS)[::-1]]


def tree(records: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Nodes (level, node, digest, records) of all levels over records with `_place` and `_digest`. A node's digest is the xor
    of its leaves' hashes, so all levels come from one aggregate of the leaves. No record gives no node."""
    one = F.xxhash64(fingerprint([F.col(k) for k in keys], 1), F.col("_digest"))
    leaves = records.groupBy(node_at(F.col("_place"), bits).alias("leaf")).agg(F.bit_xor(one).alias("digest"), F.count(F.lit(1)).alias("records"))
    at = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("leaf", bits - level).alias("node")) for level in levels_of(bits)]))
    nodes = leaves.select("records", F.xxhash64("leaf", "digest", "records").alias("digest"), at.alias("x"))
    return nodes.groupBy("x.level", "x.node").agg(F.bit_xor("digest").alias("digest"), F.sum("records").alias("records"))


def differing_leaves(saved: DataFrame, current: DataFrame, bits: int) -> DataFrame | None:
    """Leaves (node) in which two trees (level, node, digest, records) differ, or None. From the ranges down, each level is
    compared below the differing nodes of the level above only, and nothing is read below a level without any."""
    at, up = levels_of(bits), None
    for k, level in enumerate(at):
        sides = [t.where(F.col("level") == level).select("node", "digest", "records") for t in (saved, current)]
        if up is not None:
            sides = [s.join(up, F.shiftright("node", level - at[k - 1]) == F.col("_up"), "left_semi") for s in sides]
        both = sides[0].withColumn("_s", F.lit(0)).unionByName(sides[1].withColumn("_s", F.lit(1)))
        pick = lambda s: F.max(F.when(F.col("_s") == s, F.struct("digest", "records")))
        unlike = both.groupBy("node").agg(pick(0).alias("a"), pick(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
        frontier = runtime.persist_table(unlike.select("node"), f"merkle-frontier-{level}")
        found = frontier.limit(runtime.BROADCAST_ROWS + 1).count()
        if not found:
            return None
        up = frontier.select(F.col("node").alias("_up"))
        up = F.broadcast(up) if found <= runtime.BROADCAST_ROWS else up
    return frontier


def record_states(versions: DataFrame, keys: Sequence[str], load: str, content: Sequence[str], processed: str) -> DataFrame:
    """From all versions of all records, two states in one pass: (keys, first, current) of all loads and (saved_first, saved)
    of the processed ones (null if there is none): the first load and the digest of the newest version. Copies combine
    before the one shuffle. load is a number that grows with the loads."""
    d = fingerprint([F.col(c) for c in content], 2)
    v = versions.select(*keys, F.col(load).alias("_l"), F.struct(F.col(load).alias("l"), d.alias("d")).alias("_v"), F.col(processed).alias("_p"))
    newest = v.groupBy(*keys).agg(F.min("_l").alias("first"), F.max("_v").alias("c"), F.min(F.when(F.col("_p"), F.col("_l"))).alias("saved_first"), F.max(F.when(F.col("_p"), F.col("_v"))).alias("s"))
    return newest.select(*keys, "first", F.col("c.d").alias("current"), "saved_first", F.col("s.d").alias("saved"))


def pending_changes(versions: DataFrame, keys: Sequence[str], load: str, content: Sequence[str], processed: str) -> DataFrame:
    """(keys, change) of records whose newest version differs from what the processed loads left behind: `new` or `changed`.

    A store is seeded with the state that the processed loads left behind, and its next run is one over all loads. Records
    lie on the tree's line by their first load: new records fill leaves of their own, and leaves of old loads without
    corrections are not touched. Null keys are keys like others; no version gives no row.
    """
    keys, spark = list(keys), versions.sparkSession
    states = runtime.persist_table(record_states(versions, keys, load, content, processed), "merkle-states")
    low = F.lit(states.agg(F.min("first")).first()[0] or 0)
    store = IncrementalStore(spark, runtime.own_path(spark, "incremental"), keys)
    store.seed(states.where("saved_first is not null").select(*keys, (F.col("saved_first") - low).alias("_range"), F.col("saved").alias("_content")), ["_content"], "_range")
    return store.run(states.select(*keys, (F.col("first") - low).alias("_range"), F.col("current").alias("_content")), ["_content"], "_range").drop("_content")


def processed_loads(loads: DataFrame, load: str, runs: DataFrame) -> DataFrame:
    """Of the distinct loads (table_name, load) those that a run with run_status success covers."""
    ok = runs.where(F.col("run_status") == "success").select(F.col("table_name").alias("_t"), "ds_from", "ds_to")
    hit = (F.col("table_name") == F.col("_t")) & (F.col("ds_from") <= F.col(load)) & (F.col(load) <= F.col("ds_to"))
    return loads.join(ok, hit, "left_semi")


class IncrementalStore:
    """Saved records with their tree, and the runs that carry them on.

    `<root>/v<N>/tree` is the whole tree after run N, whose leaves name the version that wrote their records;
    `v<N>/records/_part=<range>` holds the leaves that run N wrote, `v<N>/output` what it put out, `v<N>/manifest` the depth
    and the versions still in use. `<root>/CURRENT` names the version in force. A run writes a whole new version and then
    renames one small file over CURRENT, so a run that dies earlier leaves the old version in force and is repeated in
    full, one that ends is not repeated.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self._folder = VersionedFolder(spark, root)
        #: Of the last run: leaves of the saved tree, those of them that were read as they differ, and their records.
        self.report: dict[str, int] = {}

    def version(self) -> int:
        return self._folder.version()

    def publish(self, version: int) -> None:
        self._folder.publish(version)

    def run(self, current: DataFrame, content: Sequence[str], ordinal: str | None = None) -> DataFrame:
        """Publishes the next version from the records' current state (one row per key) and returns its output: keys, change
        (`new`, `changed` or `removed`) and content, which is null for removed records.

        ordinal: a column of small numbers that records changed together share; without it records lie by the hash of their
        key alone. Equal content in another range is no change. current is read more than once: it should be a table.
        """
        now = self.stage(current, content, ordinal)
        self.publish(now)
        return self.output(now)

    def seed(self, current: DataFrame, content: Sequence[str], ordinal: str | None = None) -> None:
        """The first version, of records that were put out before there was a store: it puts out nothing."""
        if self.version():
            raise ValueError("the store has a version already")
        self.publish(self.stage(current, content, ordinal, put_out=False))

    def stage(self, current: DataFrame, content: Sequence[str], ordinal: str | None = None, put_out: bool = True) -> int:
        """Everything of a run but the rename."""
        keys, content, old = self.keys, list(content), self.version()
        n = old + 1
        at = f"{self.root}/v{n}"
        position = place([F.col(k) for k in keys], F.col(ordinal) if ordinal else F.lit(0))
        now = current.select(*keys, *content, position.alias("_place"), fingerprint([F.col(c) for c in content], 2).alias("_digest"))
        size = now.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(node_at(F.col("_place"), RANGE_BITS)).alias("r")).first()
        bits, live = bits_for(size.n, size.r), []
        if not old:
            self._lay_out(now, f"{at}/records")
            self._tree_out(tree(now, keys, bits).withColumn("version", F.lit(n)), f"{at}/tree")
            if put_out:
                now.select(*keys, F.lit("new").alias("change"), *content).write.mode("overwrite").parquet(f"{at}/output")
            self._folder.write(f"v{n}/manifest", json.dumps({"bits": bits, "live": [n]}))
            return n
        manifest, before = json.loads(self._folder.read(f"v{old}/manifest")), self.spark.read.parquet(f"{self.root}/v{old}/tree")
        saved = self._leaves_read(manifest["live"], manifest["bits"], T.StructType([*now.schema.fields, T.StructField("_part", T.IntegerType())]))
        if bits - manifest["bits"] <= GROWN_BITS and len(manifest["live"]) < LIVE_VERSIONS:
            bits, live = manifest["bits"], manifest["live"]
        else:  # laid out anew: what is saved is read in full, at the depth that fits now
            rows = runtime.persist_table(saved(before.where(F.col("level") == manifest["bits"])), "merkle-saved").withColumn("node", node_at(F.col("_place"), bits))
            before = runtime.persist_table(tree(rows, keys, bits).withColumn("version", F.lit(0)), "merkle-tree")
            saved = lambda leaves: rows.join(leaves.select("node"), "node", "left_semi")
        after = runtime.persist_table(tree(now, keys, bits), "merkle-tree")
        changed = differing_leaves(before, after, bits)
        changed = after.select("node").limit(0) if changed is None else changed
        mark = runtime.broadcast_if_small(changed.select(F.col("node").alias("_n")))
        was = before.where(F.col("level") == bits).select("node", "version", "records").join(mark, F.col("node") == F.col("_n"), "left_semi")
        read = was.agg(F.count(F.lit(1)).alias("leaves"), F.sum("records").alias("records")).first()
        self.report = {"leaves": before.where(F.col("level") == bits).count(), "leaves read": read.leaves, "records read": read.records or 0}
        fresh = now.join(mark, node_at(F.col("_place"), bits) == F.col("_n"), "left_semi")
        self._lay_out(fresh if live else now, f"{at}/records")
        kept = before.where(F.col("level") == bits).select(F.col("node").alias("_old"), F.col("version").alias("_version"))
        versions = after.join(mark, (F.col("level") == bits) & (F.col("node") == F.col("_n")), "left").join(kept, (F.col("level") == bits) & (F.col("node") == F.col("_old")), "left")
        self._tree_out(versions.select("level", "node", "digest", "records", F.when(F.col("_n").isNull() & F.lit(bool(live)), F.col("_version")).otherwise(n).alias("version")), f"{at}/tree")
        if put_out:
            out = self._unlike(saved(was).select(*keys, *content, "_digest"), fresh, content)
            out.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/output")
        self._folder.write(f"v{n}/manifest", json.dumps({"bits": bits, "live": [*live, n]}))
        return n

    def _tree_out(self, nodes: DataFrame, path: str) -> None:
        nodes.sortWithinPartitions("level", "node").write.mode("overwrite").option("compression", "zstd").parquet(path)

    def _lay_out(self, records: DataFrame, path: str) -> None:
        """Records by range, a hot range in several files, each in the order of the line."""
        by_range = records.withColumn("_part", node_at(F.col("_place"), RANGE_BITS).cast("int"))
        by_range.hint("rebalance", "_part").sortWithinPartitions("_part", "_place").write.mode("overwrite").option("compression", "zstd").partitionBy("_part").parquet(path)

    def _leaves_read(self, live: Sequence[int], bits: int, schema: T.StructType) -> Callable[[DataFrame], DataFrame]:
        """A function from leaves (node, version) to the saved records in them; ranges without such leaves are not read."""

        def saved(leaves: DataFrame) -> DataFrame:
            wanted = runtime.broadcast_if_small(leaves.select(F.col("node").alias("_n"), F.col("version").alias("_v"), F.shiftright("node", bits - RANGE_BITS).cast("int").alias("_p")))
            each = [self.spark.read.schema(schema).parquet(f"{self.root}/v{v}/records").withColumn("_version", F.lit(v)) for v in live]
            on = (node_at(F.col("_place"), bits) == F.col("_n")) & (F.col("_version") == F.col("_v"))
            found = [x.join(wanted.where(F.col("_v") == v), (F.col("_part") == F.col("_p")) & on, "left_semi").drop("_part", "_version") for v, x in zip(live, each, strict=True)]
            return reduce(DataFrame.unionByName, found)

        return saved

    def _unlike(self, old: DataFrame, new: DataFrame, content: Sequence[str]) -> DataFrame:
        """Rows (keys, change, content) of the keys whose digests differ between two sets of leaves."""
        keys = self.keys
        cells = lambda df, s: df.select(*keys, F.lit(s).alias("_s"), F.struct("_digest", F.struct(*content).alias("c")).alias("_x"))
        pick = lambda s: F.max(F.when(F.col("_s") == s, F.col("_x")))
        pairs = cells(old, 0).unionByName(cells(new, 1)).groupBy(*keys).agg(pick(0).alias("_a"), pick(1).alias("_b")).where(~F.col("_a._digest").eqNullSafe(F.col("_b._digest")))
        change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").otherwise("changed")
        return pairs.select(*keys, change.alias("change"), *[F.col(f"_b.c.{c}").alias(c) for c in content])

    def output(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version}/output")
