"""A join as steps with inputs and hashes, and a runner that executes what changed, in order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from millrace.plans.staging import semantic_hash
from millrace.spec import EntitySource, EventSource, GroupBy, Join, JoinSource, Source, canonical


@dataclass(frozen=True)
class Node:
    """One step: its output table, what it reads, and a hash of everything that decides its content."""

    name: str
    kind: str
    output: str
    inputs: tuple[str, ...]
    hash: str
    after: tuple[str, ...] = field(default=())


def tables_of(source: Source) -> list[str]:
    if isinstance(source, EventSource):
        return [source.table]
    if isinstance(source, EntitySource):
        return [t for t in (source.snapshot_table, source.mutation_table) if t]
    if isinstance(source, JoinSource):
        return [source.join.name]
    raise TypeError(type(source))


def _md5(*parts: str) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def left_hash(join: Join, k: int) -> str:
    """Of what the left contributes to a part: table, key and time expressions, filters, and the names of the keys."""
    p, q = join.parts[k], join.left.query
    keys = {key: q.selects.get(p.left_key(key)) for key in p.group_by.keys}
    return _md5(canonical([tables_of(join.left), sorted(keys.items()), q.time_column, sorted(q.wheres)]), canonical(dict(p.key_mapping)), p.prefix or "")


def part_hash(join: Join, k: int) -> str:
    """Of a part and of what the left contributes to it: edits of other left columns keep the part's table."""
    return _md5(left_hash(join, k), canonical(join.parts[k].group_by))


def plan_join(join: Join) -> list[Node]:
    """left -> bootstrap -> parts -> merge -> derivation; steps that have nothing to do are left out."""
    left = Node(f"{join.name}__left", "left", f"{join.name}__left", tuple(tables_of(join.left)), semantic_hash(join.left))
    nodes, last = [left], left
    if join.bootstrap_parts:
        last = Node(f"{join.name}__bootstrap", "bootstrap", f"{join.name}__bootstrap", (left.output, *[b.table for b in join.bootstrap_parts]), _md5(left.hash, canonical([b.__dict__ for b in join.bootstrap_parts])), (left.name,))
        nodes.append(last)
    parts = []
    for k, p in enumerate(join.parts):
        h = part_hash(join, k)
        out = f"{join.name}__part_{k}_{p.group_by.name}"
        parts.append(Node(out, "part", out, (last.output, *[t for s in p.group_by.sources for t in tables_of(s)]), h, (last.name,)))
    merge = Node(f"{join.name}__merged", "merge", f"{join.name}__merged" if join.derivations else join.name, (last.output, *[n.output for n in parts]), _md5(last.hash, *[n.hash for n in parts]), (last.name, *[n.name for n in parts]))
    nodes += [*parts, merge]
    if join.derivations:
        nodes.append(Node(f"{join.name}__derived", "derive", join.name, (merge.output,), _md5(merge.hash, canonical([d.__dict__ for d in join.derivations])), (merge.name,)))
    return nodes


def plan_group_by(g: GroupBy) -> list[Node]:
    return [Node(f"{g.name}__backfill", "group_by", g.name, tuple(t for s in g.sources for t in tables_of(s)), semantic_hash(g))]


def changed(old: list[Node], new: list[Node]) -> list[Node]:
    """Steps whose hash is new, and everything after them."""
    known = {n.name: n.hash for n in old}
    dirty: set[str] = set()
    for n in new:
        if known.get(n.name) != n.hash or dirty & set(n.after):
            dirty.add(n.name)
    return [n for n in new if n.name in dirty]


def run(nodes: list[Node], execute: Callable[[Node], None]) -> list[str]:
    """Executes each step after those it waits for; returns the order."""
    done: list[str] = []
    waiting = list(nodes)
    names = {n.name for n in nodes}
    while waiting:
        ready = [n for n in waiting if all(a in done or a not in names for a in n.after)]
        if not ready:
            raise ValueError("steps wait for each other")
        for n in ready:
            execute(n)
            done.append(n.name)
            waiting.remove(n)
    return done


def column_hashes(g: GroupBy) -> dict[str, str]:
    """For each feature a hash of what decides it alone: sources, filters, keys and its own input expression."""
    out = {}
    for p in g.parts():
        parts = []
        for s in g.sources:
            q = s.query
            parts += [*tables_of(s), str(getattr(s, "is_cumulative", False)), q.time_column or "", *sorted(q.wheres), *[f"{k}={q.selects.get(k) or k}" for k in g.keys], str(q.selects.get(p.input_column) or p.input_column), str(q.selects.get(p.bucket) or p.bucket)]
        out[p.name] = _md5(*sorted(parts), p.name)
    return out
