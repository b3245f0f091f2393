"""Key-value stores with versions by time, and the tables that feed them."""

from __future__ import annotations

import bisect
import itertools
import threading
import time
from abc import ABC, abstractmethod
from collections import defaultdict
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import runtime


@dataclass(frozen=True)
class TimedValue:
    value: str
    millis: int


class KVStore(ABC):
    """get returns the versions of a key at or after `start` in order of time."""

    @abstractmethod
    def create(self, dataset: str) -> None: ...

    @abstractmethod
    def put(self, dataset: str, rows: Iterable[tuple[str, str, int]]) -> None: ...

    @abstractmethod
    def get(self, dataset: str, key: str, start: int | None = None) -> list[TimedValue]: ...

    def multi_get(self, dataset: str, keys: Iterable[str], start: int | None = None) -> dict[str, list[TimedValue]]:
        return {k: self.get(dataset, k, start) for k in keys}

    def bulk_put(self, dataset: str, table: DataFrame) -> None:
        """Writes a table (key string, value string, millis long). Stores outside of the driver override this, so that
        executors write."""
        self.create(dataset)
        self.put(dataset, ((r.key, r.value, r.millis) for r in table.toLocalIterator()))

    def gathered(self, requests: DataFrame, key: str) -> DataFrame:
        """Requests with the stored key in column `key`, so distributed and in such order that executors look them up well."""
        return requests.repartition(key).sortWithinPartitions(key)


class MemoryStore(KVStore):
    """In one process. A value put at a key's existing time replaces it."""

    def __init__(self) -> None:
        self._data: dict[str, dict[str, list[TimedValue]]] = {}
        self._lock = threading.Lock()

    def create(self, dataset: str) -> None:
        with self._lock:
            self._data.setdefault(dataset, defaultdict(list))

    def put(self, dataset: str, rows: Iterable[tuple[str, str, int]]) -> None:
        self.create(dataset)
        with self._lock:
            for key, value, millis in rows:
                versions = self._data[dataset][key]
                k = bisect.bisect_left([v.millis for v in versions], millis)
                if k < len(versions) and versions[k].millis == millis:
                    versions[k] = TimedValue(value, millis)
                else:
                    versions.insert(k, TimedValue(value, millis))

    def get(self, dataset: str, key: str, start: int | None = None) -> list[TimedValue]:
        with self._lock:
            versions = list(self._data.get(dataset, {}).get(key, []))
        return [v for v in versions if start is None or v.millis >= start]

    def datasets(self) -> list[str]:
        return sorted(self._data)


class FolderStore(KVStore):
    """In a shared folder: `<root>/<dataset>/bucket=<b>/`, rows of a key in one bucket. Executors write tables; a lookup reads
    the files of one bucket. Of rows of one key and time the one put last counts, so writes can be repeated."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spark": None}  # executors only read

    def create(self, dataset: str) -> None:
        """Datasets are made by their first rows."""

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def gathered(self, requests: DataFrame, key: str) -> DataFrame:
        """Each bucket is read by one task."""
        return requests.repartitionById(self.buckets, self._bucket(key)).sortWithinPartitions(key)

    def bulk_put(self, dataset: str, table: DataFrame) -> None:
        rows = table.select("key", "value", F.col("millis").cast("long").alias("millis"), F.lit(time.time_ns()).alias("put"), self._bucket("key").alias("bucket"))
        rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key", "millis").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{dataset}")

    def put(self, dataset: str, rows: Iterable[tuple[str, str, int]]) -> None:
        self.bulk_put(dataset, self.spark.createDataFrame(list(rows), "key string, value string, millis long"))

    def get(self, dataset: str, key: str, start: int | None = None) -> list[TimedValue]:
        return self.multi_get(dataset, [key], start)[key]

    def multi_get(self, dataset: str, keys: Iterable[str], start: int | None = None) -> dict[str, list[TimedValue]]:
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        by_bucket: dict[int, list[str]] = defaultdict(list)
        for k in keys:
            h = xxhash.xxh64_intdigest(k.encode(), seed=42)
            by_bucket[(h - (1 << 64) if h >> 63 else h) % self.buckets].append(k)
        out: dict[str, dict[int, tuple[int, str]]] = {k: {} for own in by_bucket.values() for k in own}
        store, base = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root.removeprefix('file:')}")
        for b, own in by_bucket.items():
            at = f"{base}/{dataset}/bucket={b}"
            if store.get_file_info(at).type == fs.FileType.NotFound:
                continue
            wanted = ds.field("key").isin(own)
            if start is not None:
                wanted = wanted & (ds.field("millis") >= start)
            for r in ds.dataset(at, filesystem=store, format="parquet").to_table(filter=wanted).to_pylist():
                held = out[r["key"]].get(r["millis"])
                if held is None or held[0] <= r["put"]:
                    out[r["key"]][r["millis"]] = (r["put"], r["value"])
        return {k: [TimedValue(v, t) for t, (_, v) in sorted(found.items())] for k, found in out.items()}


class RemoteStore(KVStore):
    """A store reached over a client that executors can make for themselves. Each partition writes in batches, several at a
    time; a batch that fails is tried again after a pause, and fails the task after the last try, so that Spark runs it anew.
    Writing a row twice is harmless: it has the same key and time."""

    def __init__(self, connect: Callable[[], KVStore], batch: int = 500, parallel: int = 4, tries: int = 3, pause: float = 0.5):
        self.connect, self.batch, self.parallel, self.tries, self.pause = connect, batch, parallel, tries, pause

    def create(self, dataset: str) -> None:
        self.connect().create(dataset)

    def put(self, dataset: str, rows: Iterable[tuple[str, str, int]]) -> None:
        client = self.connect()

        def send(batch: list[tuple[str, str, int]]) -> None:
            for k in range(self.tries):
                try:
                    return client.put(dataset, batch)
                except Exception:
                    if k + 1 == self.tries:
                        raise
                    time.sleep(self.pause * 2**k)

        waiting: set = set()
        with ThreadPoolExecutor(self.parallel) as pool:
            source = iter(rows)
            while batch := list(itertools.islice(source, self.batch)):
                if len(waiting) >= 2 * self.parallel:
                    done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                    for f in done:
                        f.result()
                waiting.add(pool.submit(send, batch))
            for f in waiting:
                f.result()

    def get(self, dataset: str, key: str, start: int | None = None) -> list[TimedValue]:
        return self.connect().get(dataset, key, start)

    def bulk_put(self, dataset: str, table: DataFrame) -> None:
        self.create(dataset)
        runtime.send_package(table.sparkSession)
        store = self
        table.select("key", "value", "millis").foreachPartition(lambda rows: store.put(dataset, ((r.key, r.value, r.millis) for r in rows)))


def encoded(df: DataFrame, keys: list[str], values: list[str], millis: str | int) -> DataFrame:
    """(key, value, millis): keys and values as JSON with the fields in order."""
    at = F.lit(millis).cast("long") if isinstance(millis, int) else F.col(millis).cast("long")
    return df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("value"), at.alias("millis"))


def flatten_log(log: DataFrame, key_schema: str, value_schemas: dict[str, str]) -> DataFrame:
    """A log of answers (key, value as base64 JSON, ts, schema_hash) as a wide typed table. Each row is read by the schema its
    hash names; columns of other schemas are null, rows of unknown hashes are left out."""
    out = None
    for h, schema in value_schemas.items():
        own = log.where(F.col("schema_hash") == h)
        text = lambda c: F.unbase64(F.col(c)).cast("string")
        rows = own.select(F.from_json(text("key"), key_schema).alias("k"), F.from_json(text("value"), schema).alias("v"), "ts", "schema_hash").select("k.*", "v.*", "ts", "schema_hash")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
