"""Partitions as dates, ranges of them, and date macros in SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, timedelta


def shift(ds: str, days: int) -> str:
    return (date.fromisoformat(ds) + timedelta(days=days)).isoformat()


@dataclass(frozen=True, order=True)
class PartitionRange:
    """Days from start to end, both included; empty if start is after end."""

    start: str
    end: str

    def partitions(self) -> list[str]:
        n = (date.fromisoformat(self.end) - date.fromisoformat(self.start)).days
        return [shift(self.start, k) for k in range(n + 1)]

    def shifted(self, days: int) -> PartitionRange:
        return PartitionRange(shift(self.start, days), shift(self.end, days))

    def intersect(self, other: PartitionRange) -> PartitionRange:
        return PartitionRange(max(self.start, other.start), min(self.end, other.end))

    def steps(self, days: int) -> list[PartitionRange]:
        p = self.partitions()
        return [PartitionRange(p[k], p[min(k + days, len(p)) - 1]) for k in range(0, len(p), days)]


def contiguous(partitions: Iterable[str]) -> list[PartitionRange]:
    """Fewest ranges that hold exactly these days."""
    out: list[PartitionRange] = []
    for ds in sorted(set(partitions)):
        if out and shift(out[-1].end, 1) == ds:
            out[-1] = PartitionRange(out[-1].start, ds)
        else:
            out.append(PartitionRange(ds, ds))
    return out


def unfilled(wanted: PartitionRange, existing: Iterable[str], inputs: Iterable[Iterable[str]] = (), skip_first_hole: bool = True) -> list[PartitionRange]:
    """Ranges of wanted days that the output lacks and every input has. With skip_first_hole, days before the first
    existing one count as left out on purpose."""
    have = set(existing)
    first = min(have) if have and skip_first_hole else wanted.start
    missing = {d for d in wanted.partitions() if d not in have and d >= first}
    for present in inputs:
        missing &= set(present)
    return contiguous(missing)


_MACRO = r"\{{\{{\s*{}\s*(?:\(([^()]*)\))?\s*\}}\}}"


def _arguments(text: str | None) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (text or "").split(","):
        if part.strip():
            name, _, value = part.partition("=")
            out[name.strip()] = value.strip().strip("'\"")
    return out


def _moved(ds: str, args: dict[str, str]) -> str:
    if args.get("lower_bound", "") > args.get("upper_bound", "~"):
        raise ValueError("lower_bound is after upper_bound")
    ds = shift(ds, int(args.get("offset", 0)))
    return min(max(ds, args.get("lower_bound", ds)), args.get("upper_bound", "~") if "upper_bound" in args else max(ds, args.get("lower_bound", ds)))


def render(sql: str, days: PartitionRange, latest: str, max_date: Callable[[str], str] | None = None) -> str:
    """Replaces {{ start_date }}, {{ end_date }}, {{ latest_date }} (with offset, lower_bound, upper_bound) and
    {{ max_date(table=t) }} by quoted dates."""
    for name, ds in (("start_date", days.start), ("end_date", days.end), ("latest_date", latest)):
        sql = re.sub(_MACRO.format(name), lambda m, ds=ds: f"'{_moved(ds, _arguments(m[1]))}'", sql)
    return re.sub(_MACRO.format("max_date"), lambda m: f"'{max_date(_arguments(m[1])['table'])}'", sql)
