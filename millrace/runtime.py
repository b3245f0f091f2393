"""What every operator needs from the session: a shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of texts.
TEXT_ROWS = 1000
#: Most rows of a side that may be broadcast, and most rows any operator brings to the driver.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares: spark.checkpoint.dir. Only where it is unset (tests, one machine) a local one is made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex[:12]}-{name}"


_written: list[tuple[SparkSession, str]] = []


def drop_tables(spark: SparkSession | None = None) -> None:
    """Deletes the tables that persist_table wrote to the shared folder in this process (of one session, if given). What was
    built on them can no longer be computed. Also done when the process ends."""
    for s, path in [x for x in _written if spark is None or x[0] is spark]:
        _written.remove((s, path))
        try:
            p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; its folder is the cluster's to clean
            return


atexit.register(drop_tables)


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that drop_tables deletes."""
    path = fresh_path(spark, name)
    _written.append((spark, path))
    return path


def persist_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or own_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side counted to be within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def send_package(spark: SparkSession) -> None:
    """Sends the package to the executors, where it need not be installed, for functions that run there."""
    sc = spark.sparkContext
    if not getattr(sc, "_millrace_sent", False):
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="millrace-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/millrace-code", "zip", package.parent, package.name))
        sc._millrace_sent = True


def map_arrow(df: DataFrame, function: Callable, schema: str, most_rows: int | None = None) -> DataFrame:
    """df.mapInArrow after the package has been sent to the executors. most_rows lowers the session's rows per Arrow batch,
    where rows are long: a batch has to fit a worker's memory."""
    spark = df.sparkSession
    send_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if most_rows is not None and not 0 < int(spark.conf.get(name)) <= most_rows:
        spark.conf.set(name, most_rows)
    return df.mapInArrow(function, schema)
