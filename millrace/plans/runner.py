"""Runs a planned join step by step over tables: only what is missing or changed is computed."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.dates import PartitionRange, contiguous, unfilled
from millrace.plans import planner
from millrace.plans.derive import coalesced_join, derive_over_left
from millrace.plans.join import bootstrap, compute_part, left_frame
from millrace.plans.planner import Node
from millrace.sources.tables import Catalog
from millrace.spec import Aggregation, EntitySource, GroupBy, Join


class JoinRunner:
    """Every step of a join has a table named after it, partitioned by `ds`, which carries the step's hash.

    A step whose table has the hash and the days is not run. One that lacks days runs for those alone. One whose hash changed
    has its table renamed and starts anew; a part then takes over the columns whose own hashes are what they were, for the
    days that the old table has, and computes only the others. A run that dies between two steps is carried on by the next.
    """

    def __init__(self, catalog: Catalog, join: Join):
        self.catalog, self.join, self.spark = catalog, join, catalog.spark
        self.events = not isinstance(join.left, EntitySource)
        #: Of the last run: (step, days computed, columns computed) of every step that ran.
        self.log: list[tuple[str, list[PartitionRange], list[str]]] = []

    def run(self, days: PartitionRange) -> DataFrame:
        """Fills in all steps for these days and returns the join's rows."""
        self.log = []
        nodes = planner.plan_join(self.join)
        stale: set[str] = set()
        for node in nodes:
            if set(node.after) & stale or self._hash(node.output) not in (None, node.hash):
                stale.add(node.name)
        order = planner.run(nodes, lambda node: self._step(node, days, node.name in stale))
        return self._table(next(n for n in nodes if n.name == order[-1]).output, days)

    def _hash(self, table: str) -> str | None:
        return self._properties(table).get("semantic_hash")

    def _filled(self, table: str) -> set[str]:
        """Days that a step's table has been computed for; days without rows have no partition."""
        return {d for a, b in json.loads(self._properties(table).get("filled", "[]")) for d in PartitionRange(a, b).partitions()}

    def _properties(self, table: str) -> dict[str, str]:
        if not self.spark.catalog.tableExists(table):
            return {}
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}

    def _table(self, name: str, days: PartitionRange) -> DataFrame:
        return self.spark.table(name).where((F.col("ds") >= days.start) & (F.col("ds") <= days.end))

    def _step(self, node: Node, days: PartitionRange, stale: bool) -> None:
        old = None
        if stale and self.spark.catalog.tableExists(node.output):
            old = self.catalog.archive_if_changed(node.output, node.hash)
            if old is None:  # its own hash is the same, but what it is made of is not
                self.spark.sql(f"DROP TABLE {node.output}")
        missing = unfilled(days, self._filled(node.output), skip_first_hole=False)
        if not missing:
            return
        columns: list[str] = []
        for part in missing:
            made, columns = self._computed(node, part, old)
            properties = {"semantic_hash": node.hash}
            if node.kind == "part":
                k = self._number(node)
                properties |= {"left_hash": planner.left_hash(self.join, k), "column_hashes": json.dumps(planner.column_hashes(self.join.parts[k].group_by)).replace("'", "")}
            self.catalog.insert(made, node.output, properties=properties)
            ranges = [[r.start, r.end] for r in contiguous({*self._filled(node.output), *part.partitions()})]
            self.spark.sql(f"ALTER TABLE {node.output} SET TBLPROPERTIES ('filled'='{json.dumps(ranges)}')")
        self.log.append((node.output, missing, columns))

    def _number(self, node: Node) -> int:
        return [n.output for n in planner.plan_join(self.join) if n.kind == "part"].index(node.output)

    def _computed(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        make: dict[str, Callable] = {"left": self._left, "bootstrap": self._bootstrap, "part": self._part, "merge": self._merge, "derive": self._derive}
        return make[node.kind](node, days, old)

    def _left(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        left = left_frame(self.catalog, self.join, days)
        return (left if "ds" in left.columns else left.withColumn("ds", F.col("ts_ds"))), left.columns

    def _bootstrap(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        out, _ = bootstrap(self.catalog, self.join, self._table(node.inputs[0], days), days)
        return out, out.columns

    def _part(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        k = self._number(node)
        part, g = self.join.parts[k], self.join.parts[k].group_by
        asked = self._table(node.inputs[0], days)
        kept = self._kept(k, old, days)
        parts = [p for p in g.parts() if p.name not in kept]
        base = None
        if kept:
            prefix = part.column_prefix()
            base = self._table(old, days)
            on = [c for c in base.columns if not c.startswith(prefix) and c != "ds" or c in self._on(part)]
            base = base.select(*on, *[prefix + c for c in kept], *[c for c in ("ds",) if c not in on])
            if not parts:
                return base, []
            aggregations = [Aggregation(p.input_column, p.operation, (p.window.label or None,), (p.bucket,) if p.bucket else (), p.k, p.percentiles) for p in parts]
            part = replace(part, group_by=replace(g, aggregations=aggregations))
        out, on = compute_part(self.catalog, asked, part, self.events, days)
        if "ds" not in on:
            day = F.col("ts_ds") if "ts_ds" in on else F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")).cast("string")
            out = out.withColumn("ds", day).where((F.col("ds") >= days.start) & (F.col("ds") <= days.end))
        computed = [c for c in out.columns if c not in (*on, "ds")]
        if base is not None:
            out = base.join(out.drop(*([] if "ds" in on else ["ds"])), on, "full")
            if "ds" not in on:
                out = out.withColumn("ds", F.coalesce("ds", F.col("ts_ds") if "ts_ds" in on else F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")).cast("string")))
        return out, computed

    def _on(self, part) -> list[str]:
        return [*[part.left_key(k) for k in part.group_by.keys], "ts", "ts_ds"]

    def _kept(self, k: int, old: str | None, days: PartitionRange) -> list[str]:
        """Features that the old table of a part has as they would be computed now."""
        g: GroupBy = self.join.parts[k].group_by
        if old is None or g.derivations or g.aggregations is None or not set(days.partitions()) <= self._filled(old):
            return []
        had = self._properties(old)
        if had.get("left_hash") != planner.left_hash(self.join, k):
            return []
        before, now = json.loads(had.get("column_hashes", "{}")), planner.column_hashes(g)
        return [p.name for p in g.parts() if before.get(p.name) == now[p.name]]

    def _merge(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        out = self._table(node.inputs[0], days).drop("matched_hashes")
        for part, table in zip(self.join.parts, node.inputs[1:], strict=True):
            features = self._table(table, days)
            prefix = part.column_prefix()
            on = [c for c in features.columns if not c.startswith(prefix) and (c != "ds" or not self.events)]
            out = coalesced_join(out, features.drop(*([] if "ds" in on else ["ds"])), on)
        for e in self.join.external_parts:
            for name, kind in e.columns.items():
                out = out.withColumn(f"ext_{e.source}_{name}", F.lit(None).cast(kind))
        return out, []

    def _derive(self, node: Node, days: PartitionRange, old: str | None) -> tuple[DataFrame, list[str]]:
        merged = self._table(node.inputs[0], days)
        left = left_frame(self.catalog, self.join, days).columns
        left = [*left, *[c for c in ("ds",) if c not in left]]
        return derive_over_left(merged, self.join.derivations, left, [c for c in merged.columns if c not in left]), []


def drop(runner: JoinRunner) -> None:
    """Drops the tables of all steps and their renamed predecessors."""
    names = {n.output for n in planner.plan_join(runner.join)}
    for t in runner.spark.catalog.listTables():
        if not t.isTemporary and any(t.name == n.lower() or t.name.startswith(n.lower() + "_") for n in names):
            runner.spark.sql(f"DROP TABLE {t.name}")
