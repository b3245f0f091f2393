"""Free SQL with date macros, filled in partition by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from millrace.dates import PartitionRange, render, shift, unfilled
from millrace.sources.tables import Catalog
from millrace.spec import StagingQuery, canonical


def staging_frame(catalog: Catalog, query: StagingQuery, days: PartitionRange, latest: str | None = None) -> DataFrame:
    """The rendered query over `days`; tables of the catalog can be named in it."""
    for name, df in catalog.tables.items():
        df.createOrReplaceTempView(name)
    for s in query.setups:
        catalog.spark.sql(s)
    newest = lambda t: max(catalog.partitions(t, query.partition_column))
    return catalog.spark.sql(render(query.query, days, latest or days.end, newest))


def backfill(catalog: Catalog, query: StagingQuery, end: str, inputs: Sequence[str] = (), step_days: int = 14) -> list[PartitionRange]:
    """Runs the query for every day up to end that the output table lacks and all inputs have, step by step; the last
    recompute_days are run again. Returns the ranges that were written."""
    have = catalog.partitions(query.name, query.partition_column)
    if query.recompute_days:
        have = [d for d in have if d <= shift(end, -query.recompute_days)]
    present = [catalog.partitions(t, query.partition_column) for t in inputs]
    done = []
    for r in unfilled(PartitionRange(query.start_partition, end), have, present, skip_first_hole=False):
        for step in r.steps(step_days):
            partitions = (query.partition_column, *query.extra_partitions)
            catalog.insert(staging_frame(catalog, query, step, end), query.name, partitions, properties={"semantic_hash": semantic_hash(query)})
            done.append(step)
    return done


def semantic_hash(declaration: object) -> str:
    import hashlib

    return hashlib.md5(canonical(declaration).encode()).hexdigest()
