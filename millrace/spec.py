"""Declarations: what to compute, as plain data. Plans turn them into DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum


class Operation(StrEnum):
    MIN = "min"
    MAX = "max"
    FIRST = "first"
    LAST = "last"
    UNIQUE_COUNT = "unique_count"
    APPROX_UNIQUE_COUNT = "approx_unique_count"
    COUNT = "count"
    SUM = "sum"
    AVERAGE = "average"
    VARIANCE = "variance"
    SKEW = "skew"
    KURTOSIS = "kurtosis"
    APPROX_PERCENTILE = "approx_percentile"
    LAST_K = "last_k"
    FIRST_K = "first_k"
    TOP_K = "top_k"
    BOTTOM_K = "bottom_k"
    HISTOGRAM = "histogram"
    APPROX_FREQUENT_K = "approx_frequent_k"
    APPROX_HEAVY_HITTERS_K = "approx_heavy_hitters_k"
    UNIQUE_TOP_K = "unique_top_k"


class Accuracy(StrEnum):
    TEMPORAL = "temporal"
    SNAPSHOT = "snapshot"


UNIT_MS = {"d": 86_400_000, "h": 3_600_000, "m": 60_000}


@dataclass(frozen=True)
class Window:
    """A length of time; None milliseconds is unbounded."""

    millis: int | None = None
    label: str = ""

    @staticmethod
    def of(text: str | None) -> Window:
        """`7d`, `12h`, `30m`; None or a length of 0 or less is unbounded."""
        if text is None:
            return Window()
        m = re.fullmatch(r"(-?\d+)([dhm])", text)
        if not m:
            raise ValueError(f"not a window: {text}")
        n = int(m[1])
        return Window(n * UNIT_MS[m[2]], text) if 0 < n < 2**31 - 1 else Window()

    def tail_hop(self) -> int:
        """Grid on which the window's far end moves: days from 12 days on, hours from 12 hours on, else 5 minutes."""
        if self.millis is None or self.millis >= 12 * UNIT_MS["d"]:
            return UNIT_MS["d"]
        return UNIT_MS["h"] if self.millis >= 12 * UNIT_MS["h"] else 5 * UNIT_MS["m"]


@dataclass(frozen=True)
class Aggregation:
    input_column: str
    operation: Operation
    windows: Sequence[str | None] = (None,)
    buckets: Sequence[str] = ()
    k: int | None = None
    percentiles: Sequence[float] = (0.5,)

    def __post_init__(self):
        if any(not 0 <= p <= 1 for p in self.percentiles):
            raise ValueError("percentiles lie between 0 and 1")

    def parts(self) -> list[AggregationPart]:
        """One output column for each window and bucket."""
        return [AggregationPart(self.input_column, self.operation, Window.of(w), b, self.k, tuple(self.percentiles)) for b in (self.buckets or (None,)) for w in (self.windows or (None,))]


DEFAULT_K = {Operation.APPROX_PERCENTILE: 128, Operation.APPROX_UNIQUE_COUNT: 8, Operation.APPROX_FREQUENT_K: 8, Operation.APPROX_HEAVY_HITTERS_K: 8, Operation.HISTOGRAM: 0}
WITH_K = {Operation.LAST_K: "last", Operation.FIRST_K: "first", Operation.TOP_K: "top", Operation.BOTTOM_K: "bottom", Operation.UNIQUE_TOP_K: "unique_top"}


@dataclass(frozen=True)
class AggregationPart:
    input_column: str
    operation: Operation
    window: Window = Window()
    bucket: str | None = None
    k: int | None = None
    percentiles: tuple[float, ...] = (0.5,)

    @property
    def size(self) -> int:
        return self.k if self.k is not None else DEFAULT_K.get(self.operation, 1)

    @property
    def base(self) -> str:
        """Name without the window: parts that share it share their partial aggregates."""
        op = f"{WITH_K[self.operation]}{self.size}" if self.operation in WITH_K else str(self.operation)
        return f"{self.input_column}_{op}" + (f"_by_{self.bucket}" if self.bucket else "")

    @property
    def name(self) -> str:
        op = f"{WITH_K[self.operation]}{self.size}" if self.operation in WITH_K else str(self.operation)
        return f"{self.input_column}_{op}" + (f"_{self.window.label}" if self.window.label else "") + (f"_by_{self.bucket}" if self.bucket else "")


@dataclass(frozen=True)
class Query:
    """Selection from a table: name -> expression (None keeps the column), filters, range of partitions, time column."""

    selects: Mapping[str, str | None] = field(default_factory=dict)
    wheres: Sequence[str] = ()
    start_partition: str | None = None
    end_partition: str | None = None
    time_column: str | None = None
    setups: Sequence[str] = ()
    mutation_time_column: str | None = None
    reversal_column: str | None = None
    partition_column: str = "ds"
    partition_format: str = "yyyy-MM-dd"
    time_partitioned: bool = False


@dataclass(frozen=True)
class EventSource:
    table: str
    query: Query = Query()
    topic: str | None = None
    is_cumulative: bool = False

    def __post_init__(self):
        if self.query.mutation_time_column or self.query.reversal_column:
            raise ValueError("event sources have no mutations")


@dataclass(frozen=True)
class EntitySource:
    snapshot_table: str
    query: Query = Query()
    mutation_table: str | None = None
    mutation_topic: str | None = None


@dataclass(frozen=True)
class JoinSource:
    join: Join
    query: Query = Query()


Source = EventSource | EntitySource | JoinSource


@dataclass(frozen=True)
class Derivation:
    """An output column; name `*` with expression `*` keeps base columns that no other derivation merely renames."""

    name: str
    expression: str


@dataclass(frozen=True)
class GroupBy:
    name: str
    sources: Sequence[Source]
    keys: Sequence[str]
    aggregations: Sequence[Aggregation] | None = None
    accuracy: Accuracy | None = None
    derivations: Sequence[Derivation] = ()

    def __post_init__(self):
        for s in self.sources:
            if "ts" in s.query.selects:
                raise ValueError("ts is reserved; name the time column instead")
            missing = [k for k in self.keys if s.query.selects and k not in s.query.selects]
            if missing:
                raise ValueError(f"keys not selected: {missing}")
        if len({frozenset(s.query.selects) for s in self.sources}) > 1:
            raise ValueError("all sources must select the same columns")
        if self.aggregations is None and not all(isinstance(s, EntitySource) and not s.mutation_table for s in self.sources):
            raise ValueError("only entities without mutations can go without aggregations")
        if self.inferred_accuracy == Accuracy.SNAPSHOT and any(p.window.label[-1:] in ("h", "m") for p in self.parts()):
            raise ValueError("snapshot accuracy knows windows of days only")

    @property
    def inferred_accuracy(self) -> Accuracy:
        if self.accuracy:
            return self.accuracy
        live = any(getattr(s, "topic", None) or getattr(s, "mutation_topic", None) for s in self.sources)
        return Accuracy.TEMPORAL if live else Accuracy.SNAPSHOT

    def parts(self) -> list[AggregationPart]:
        return [p for a in self.aggregations or () for p in a.parts()]


@dataclass(frozen=True)
class JoinPart:
    group_by: GroupBy
    key_mapping: Mapping[str, str] = field(default_factory=dict)
    prefix: str | None = None

    def left_key(self, key: str) -> str:
        """Name on the left of a key of the group by."""
        return next((left for left, right in self.key_mapping.items() if right == key), key)

    def column_prefix(self, long_names: bool = True) -> str:
        own = self.group_by.name if long_names else "_".join(self.left_key(k) for k in self.group_by.keys)
        return f"{self.prefix}_{own}_" if self.prefix else f"{own}_"


@dataclass(frozen=True)
class BootstrapPart:
    table: str
    query: Query = Query()
    key_columns: Sequence[str] = ()


@dataclass(frozen=True)
class ExternalPart:
    """Values that only an online service has: null columns offline."""

    source: str
    columns: Mapping[str, str]


@dataclass(frozen=True)
class Join:
    name: str
    left: Source
    parts: Sequence[JoinPart]
    skew_keys: Mapping[str, Sequence[object]] = field(default_factory=dict)
    row_ids: Sequence[str] = ()
    bootstrap_parts: Sequence[BootstrapPart] = ()
    external_parts: Sequence[ExternalPart] = ()
    derivations: Sequence[Derivation] = ()
    use_long_names: bool = True


@dataclass(frozen=True)
class StagingQuery:
    name: str
    query: str
    start_partition: str
    partition_column: str = "ds"
    setups: Sequence[str] = ()
    recompute_days: int = 0
    extra_partitions: Sequence[str] = ()


@dataclass(frozen=True)
class ModelTransforms:
    """Input expressions, a predictor over batches, output expressions, and columns that pass through."""

    inputs: Mapping[str, str]
    outputs: Mapping[str, str]
    passthrough: Sequence[str] = ()
    batch_size: int = 1024


def canonical(value: object) -> str:
    """Stable JSON of a declaration, for hashing."""
    from dataclasses import asdict, is_dataclass

    return json.dumps(asdict(value) if is_dataclass(value) and not isinstance(value, type) else value, sort_keys=True, default=str)
