"""Tables by name: scans with pruned partitions, listings, and partitioned sinks that overwrite only what they write."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dates import PartitionRange, shift
from millrace.spec import Query


@dataclass(frozen=True)
class DataPointer:
    """`table`, `s3+parquet://path`, `format(option=value)://name`, `file://path.csv`: where data is and how to read it."""

    location: str
    format: str | None = None
    options: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def parse(text: str) -> DataPointer:
        m = re.fullmatch(r"(?:([A-Za-z0-9]+)(?:\+([A-Za-z0-9]+))?(?:\(([^)]*)\))?://)?([^:]+)", text)
        if not m:
            raise ValueError(f"not a data pointer: {text}")
        catalog, fmt, opts, path = m.groups()
        options = tuple(tuple(x.strip() for x in o.split("=", 1)) for o in (opts or "").split(",") if "=" in o)
        if catalog is None:
            return DataPointer(path)
        if fmt:
            return DataPointer(f"{catalog}://{path}", fmt, options)
        if catalog.lower() in ("s3", "gcs", "hdfs", "file"):
            ext = path.rsplit(".", 1)[1] if "." in path.rsplit("/", 1)[-1] else None
            return DataPointer(f"{catalog}://{path}", ext, options) if ext else DataPointer(path, catalog, options)
        return DataPointer(path, catalog, options)


@dataclass(frozen=True)
class Topic:
    """`bus://topic/key=value/...`; `//` inside a value stands for a slash; the bus is kafka if not given."""

    name: str
    bus: str
    params: Mapping[str, str]

    @staticmethod
    def parse(text: str) -> Topic:
        bus, sep, rest = text.partition("://")
        if not sep:
            bus, rest = "kafka", text
        if not rest:
            raise ValueError(f"not a topic: {text}")
        name, *fields = [x.replace("\0", "/") for x in rest.replace("//", "\0").split("/")]
        return Topic(name, bus, {k: v for k, _, v in (f.partition("=") for f in fields)})


class Catalog:
    """Tables of a session, with names that stand for given DataFrames in front of them."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def read(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        p = DataPointer.parse(name)
        return self.spark.read.format(p.format).options(**dict(p.options)).load(p.location) if p.format else self.spark.table(p.location)

    def exists(self, name: str) -> bool:
        return name in self.tables or self.spark.catalog.tableExists(name)

    def partitions(self, name: str, column: str = "ds", where: Mapping[str, str] | None = None) -> list[str]:
        """Sorted partition values of a table; empty if it does not exist. Metadata answers where there are partitions."""
        if not self.exists(name):
            return []
        if name not in self.tables:
            found = [c.name for c in self.spark.catalog.listColumns(name) if c.isPartition]
            if column in found:
                rows = [dict(kv.split("=", 1) for kv in r.partition.split("/")) for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]
                return sorted({r[column] for r in rows if all(r.get(k) == v for k, v in (where or {}).items())})
        df = self.read(name)
        for k, v in (where or {}).items():
            df = df.where(F.col(k) == v)
        return sorted(r[0] for r in df.select(F.col(column).cast("string")).distinct().collect() if r[0] is not None)

    def virtual_partitions(self, name: str, time_column: str) -> list[str]:
        """Days between the first and last timestamp of a table that has no partitions."""
        lo, hi = self.read(name).agg(F.min(F.to_date(time_column)).cast("string"), F.max(F.to_date(time_column)).cast("string")).head()
        return PartitionRange(lo, hi).partitions() if lo else []

    def scan(self, name: str, query: Query, days: PartitionRange | None = None, fills: Mapping[str, str] | None = None) -> DataFrame:
        """Range of partitions, filters, then selections, so that all but the needed files and columns are pruned.

        The range is half open at the day after its end, which fits dates and timestamps alike. A selection of None is the
        column itself; `fills` add columns that are not selected; no selections and no fills keep every column. The
        partition column comes out as `ds`.
        """
        df = self.read(name)
        column = query.partition_column
        if days is not None and column in df.columns:
            text = F.col(column) if not query.time_partitioned else F.col(column).cast("timestamp")
            df = df.where((text >= F.lit(days.start)) & (text < F.lit(shift(days.end, 1))))
        for clause in query.wheres:
            df = df.where(f"({clause})")
        selects = {**(fills or {}), **{k: v or f"`{k}`" for k, v in query.selects.items()}}
        if not query.selects:
            for k, v in (fills or {}).items():
                df = df.withColumn(k, F.expr(v))
            out = df
        else:
            kept = [] if "ds" in selects or column not in df.columns else [column]
            out = df.select(*[F.expr(v).alias(k) for k, v in selects.items()], *kept)
        if column != "ds" and column in out.columns:
            out = out.withColumnRenamed(column, "ds")
        if "ds" in out.columns and (query.time_partitioned or query.partition_format != "yyyy-MM-dd"):
            as_date = F.to_date("ds") if query.time_partitioned else F.to_date("ds", query.partition_format)
            out = out.withColumn("ds", F.date_format(as_date, "yyyy-MM-dd"))
        return out

    def insert(self, df: DataFrame, name: str, partitions: tuple[str, ...] = ("ds",), auto_expand: bool = True, format: str = "parquet", properties: Mapping[str, str] | None = None) -> None:
        """Writes df's partitions, replacing only those it has. The table is created if missing; with auto_expand new columns
        are added to it and columns that df lacks are filled with nulls."""
        spark = self.spark
        data = [c for c in df.columns if c not in partitions]
        df = df.select(*data, *partitions)
        if not spark.catalog.tableExists(name):
            df.limit(0).write.format(format).partitionBy(*partitions).saveAsTable(name)
            if properties:
                spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES (" + ", ".join(f"'{k}'='{v}'" for k, v in properties.items()) + ")")
        have = spark.table(name).schema
        known = {f.name for f in have.fields}
        added = [f for f in df.schema.fields if f.name not in known]
        if added and not auto_expand:
            raise ValueError(f"{name} lacks columns {[f.name for f in added]}")
        if added:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS (" + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added) + ")")
        final = spark.table(name).schema
        row = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in final.fields])
        # By path, where the mode is an option of this write alone: by name it would be a setting of the whole session.
        about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        if about["Provider"].lower() not in ("parquet", "orc", "csv", "json", "avro"):  # a table format that replaces partitions by itself
            row.writeTo(name).overwritePartitions()
            return
        row.write.format(about["Provider"]).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).save(about["Location"])
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        spark.catalog.refreshTable(name)

    def archive_if_changed(self, name: str, semantic_hash: str) -> str | None:
        """Renames a table whose `semantic_hash` property differs; returns the archive's name. New tables carry the hash."""
        if not self.spark.catalog.tableExists(name):
            return None
        props = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if props.get("semantic_hash") in (None, semantic_hash):
            return None
        to = f"{name}_{hashlib.md5(props['semantic_hash'].encode()).hexdigest()[:8]}"
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {to}")
        if any(c.isPartition for c in self.spark.catalog.listColumns(to)):  # the files moved with the table's folder
            self.spark.sql(f"MSCK REPAIR TABLE {to} SYNC PARTITIONS")
        return to


def load_folder(spark: SparkSession, folder: str, format: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """Every file or directory `<name>.<format>` of a local folder as a table."""
    from pathlib import Path

    return {p.stem: spark.read.format(format).options(**options).load(str(p)) for p in sorted(Path(folder).glob(f"*.{format}"))}


def export_table(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").format(format).options(**options).save(path)


def stream(spark: SparkSession, topic: Topic, schema: str | None = None, **options: str) -> DataFrame:
    """A stream of a topic: Kafka-like buses need their connector on the class path; `file` reads a folder of parquet."""
    if topic.bus == "file":
        return spark.readStream.schema(schema).format(topic.params.get("format", "parquet")).options(**options).load(f"/{topic.name}" if not topic.name.startswith("/") else topic.name)
    source = {"kafka": "kafka", "pubsub": "pubsub", "kinesis": "aws-kinesis"}.get(topic.bus, topic.bus)
    reader = spark.readStream.format(source).options(**options)
    if topic.bus == "kafka":
        host = topic.params.get("host", "localhost") + (f":{topic.params['port']}" if "port" in topic.params else "")
        reader = reader.option("kafka.bootstrap.servers", host).option("subscribe", topic.name)
    return reader.load()
