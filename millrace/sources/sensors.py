"""Waiting for inputs, and statistics that files carry in their footers."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime
from millrace.dates import PartitionRange
from millrace.sources.tables import Catalog


def newest_time(catalog: Catalog, table: str, time_column: str) -> str | None:
    """Date of the newest timestamp."""
    return catalog.read(table).agg(F.max(F.to_date(time_column)).cast("string")).head()[0]


def is_ready(catalog: Catalog, table: str, days: PartitionRange | None, partition_column: str = "ds", time_column: str | None = None, trigger: str | None = None) -> bool:
    """Without days: the table exists. With a trigger expression: some row of it holds. With a time column: its newest date
    reaches the end. Else: all partitions are there."""
    if not catalog.exists(table):
        return False
    if trigger is not None:
        return bool(catalog.read(table).agg(F.max(F.expr(trigger))).head()[0])
    if days is None:
        return True
    if time_column is not None:
        return (newest_time(catalog, table, time_column) or "") >= days.end
    return set(days.partitions()) <= set(catalog.partitions(table, partition_column))


def wait(ready: Callable[[], bool], tries: int = 3, pause: float = 180.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Asks a bounded number of times."""
    for k in range(tries):
        if ready():
            return True
        if k + 1 < tries:
            sleep(pause)
    return False


def footer_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, column_name, rows, nulls) of each parquet file from its footer alone; nulls are null where a file has no
    statistics. Files are read where they are listed: one task a file, and no data page."""
    runtime.send_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return files.repartition(runtime.shuffle_partitions(spark), "path").mapInPandas(_footers, "path string, column_name string, rows long, nulls long")


def _footers(frames):
    import pandas as pd
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for frame in frames:
        out = []
        for p in frame["path"]:
            store, at = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file:///") else p)
            with store.open_input_file(at) as f:
                meta = pq.ParquetFile(f).metadata
            nulls: dict[str, int | None] = {}
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    col = meta.row_group(g).column(c)
                    s = col.statistics
                    known = s.null_count if s is not None and s.has_null_count else None
                    name = col.path_in_schema
                    nulls[name] = None if known is None or nulls.get(name, 0) is None else nulls.get(name, 0) + known
            out += [(p, name, meta.num_rows, n) for name, n in nulls.items()]
        yield pd.DataFrame(out, columns=["path", "column_name", "rows", "nulls"]).astype({"nulls": "Int64"})


def recompute(old: Mapping[str, str], new: Mapping[str, str], base: tuple[str, ...] = ("left", "bootstrap")) -> set[str]:
    """Tables of a join to drop, from hashes of its pieces: all parts if the left or the bootstrap changed, else the changed
    and the deleted ones; and the final table (`final`) if any part is dropped or anything was added or derived anew."""
    parts = {k for k in {*old, *new} if k not in (*base, "derivations")}
    if any(old.get(b) != new.get(b) for b in base):
        dropped = {k for k in parts if k in old}
    else:
        dropped = {k for k in parts if k in old and old[k] != new.get(k)}
    added = {k for k in parts if k not in old}
    return dropped | ({"final"} if dropped or added or old.get("derivations") != new.get("derivations") else set())
