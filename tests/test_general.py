"""Problems 1 to 7 on small tables: brute force, nulls, ties, repeats, empty tables, clashing columns, hot groups."""

from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions.multiset import order_statistics
from millrace.operators import bitemporal, entity_features, heavy_hitters, incremental, late_events, profile, rolling


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# --- shared expressions


def test_event_millis_units_and_null(spark):
    df = spark.createDataFrame([(1704743074,), (1704743074123,), (1704743074123999,), (None,), (-5,)], "ts long")
    assert [r[0] for r in df.select(C.event_millis("ts")).collect()] == [1704743074000, 1704743074123, 1704743074123, None, -5000]


def test_return_key_ignores_case_and_other_characters(spark):
    df = spark.createDataFrame([("{4B1C-d4 31}",), ("4b1cd431",), (None,), ("",)], "r string")
    assert [r[0] for r in df.select(C.return_key("r")).collect()] == ["4b1cd431", "4b1cd431", None, ""]


def test_valid_date(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-2-9",), ("0000-00-00",), ("",), (None,), ("20240101",)], "d string")
    assert [r[0] for r in df.select(C.valid_date(F.col("d"))).collect()] == [True, False, False, False, False, None, False]


def test_fingerprint_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (None, 1)], "a int, b int").select(C.fingerprint([F.col("a"), F.col("b")]))
    f = [r[0] for r in df.collect()]
    assert f[0] == f[3] and len(set(f)) == 3


def test_order_statistics_against_plain_medians(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([None, *range(-3, 9), 10**12])) for g in ["a", "b", None] for _ in range(rng.randrange(1, 60))]
    ms = spark.createDataFrame(data, "g string, value long").groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    found = {r.g: (r["items"], r.distincts, r.lowest, r.highest, r.total, r.median) for r in order_statistics(ms, ["g"]).collect()}
    plain = defaultdict(list)
    for g, v in data:
        if v is not None:
            plain[g].append(v)
    assert found == {g: (len(v), len(set(v)), min(v), max(v), sum(v), float(statistics.median(v))) for g, v in plain.items()}
    assert order_statistics(ms.limit(0), ["g"]).count() == 0


# --- 1


def versions(spark, data):
    return spark.createDataFrame(data, "k string, ds int, a long, b string, done boolean, _place int, node string, _digest string, saved int")


def brute_changes(data):
    out = {}
    for k in {d[0] for d in data}:
        own = [d for d in data if d[0] == k]
        newest = max(own, key=lambda d: d[1])
        seen = [d for d in own if d[4]]
        if not newest[4]:
            if not seen:
                out[k] = "new"
            elif max(seen, key=lambda d: d[1])[2:4] != newest[2:4]:
                out[k] = "changed"
    return out


def test_pending_changes_match_brute_force_with_clashing_columns(spark):
    rng = random.Random(1)
    done = {i: rng.random() < 0.6 for i in range(8)}
    content = {}
    data = []
    for _ in range(1500):
        k, ds = rng.choice([None, "hot", *map(str, range(300))]), rng.randrange(8)
        a, b = content.setdefault((k, ds), (rng.choice([None, 1, 2]), rng.choice([None, "x"])))
        data += [(k, ds, a, b, done[ds], 1, "n", "d", 2)] * (400 if k == "hot" and rng.random() < 0.2 else 1)
    found = incremental.pending_changes(versions(spark, data), ["k"], "ds", ["a", "b"], "done")
    assert dict(map(tuple, found.collect())) == brute_changes(data)


def test_pending_changes_of_nothing(spark):
    assert incremental.pending_changes(versions(spark, []), ["k"], "ds", ["a", "b"], "done").count() == 0


def test_trees_find_new_changed_and_removed(spark, tmp_path, monkeypatch):
    data = [(str(i), i % 40, i) for i in range(2000)]
    a = spark.createDataFrame(data, "k string, r int, v long")
    b = spark.createDataFrame([(k, 39 if k == "3" else r, -1 if k == "7" else v) for k, r, v in data[1:]] + [("2000", 5, 1), (None, None, 1)], "k string, r int, v long")
    store = incremental.IncrementalStore(spark, str(tmp_path / "s"), ["k"])
    store.seed(a, ["v"], "r")
    want = Counter([("0", "removed", None), ("7", "changed", -1), ("2000", "new", 1), (None, "new", 1)])
    assert rows(store.run(b, ["v"], "r")) == want
    # Only leaves with a change are read: that of the record that moved, of those gone, changed and next to new ones.
    assert store.report["leaves"] > 100 and store.report["leaves read"] <= 6
    assert store.run(b, ["v"], "r").count() == 0 and store.report["leaves read"] == 0
    # Back to the old state, with leaves of three versions side by side, and laid out anew.
    back = Counter([("0", "new", 0), ("7", "changed", 7), ("2000", "removed", None), (None, "removed", None)])
    assert rows(store.run(a, ["v"], "r")) == back
    monkeypatch.setattr(incremental, "LIVE_VERSIONS", 1)
    assert rows(store.run(b, ["v"], "r")) == want
    monkeypatch.setattr(incremental, "GROWN_BITS", -1)
    assert rows(store.run(a, ["v"], "r")) == back and rows(store.run(b, ["v"], "r")) == want


def test_the_tree_decides_what_is_read(spark, tmp_path, monkeypatch):
    a = spark.createDataFrame([(i, i % 20, i) for i in range(1000)], "k int, r int, v long")
    b = a.withColumn("v", F.expr("if(k in (3, 5), -1, v)"))
    store = incremental.IncrementalStore(spark, str(tmp_path / "s"), ["k"])
    store.seed(a, ["v"], "r")
    for part in (tmp_path / "s/v1/records").glob("_part=*"):
        if part.name not in ("_part=3", "_part=5"):
            for f in part.glob("*.parquet"):
                f.write_bytes(b"not to be read")
            for f in part.glob(".*.crc"):
                f.unlink()
    n = store.stage(b, ["v"], "r")
    assert rows(store.output(n)) == Counter([(3, "changed", -1), (5, "changed", -1)])
    monkeypatch.setattr(incremental, "differing_leaves", lambda *_: None)
    assert store.output(store.stage(b, ["v"], "r")).count() == 0


def test_store_survives_a_run_that_dies_before_it_publishes(spark, tmp_path):
    store = incremental.IncrementalStore(spark, str(tmp_path / "s"), ["k"])
    day1 = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, v long")
    assert rows(store.run(day1, ["v"])) == Counter([("a", "new", 1), ("b", "new", None), (None, "new", 3)])
    day2 = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4)], "k string, v long")
    store.stage(day2, ["v"])  # dies here
    assert store.version() == 1
    again = incremental.IncrementalStore(spark, str(tmp_path / "s"), ["k"])
    expected = Counter([("b", "changed", 2), ("c", "new", 4), (None, "removed", None)])
    assert rows(again.run(day2, ["v"])) == expected
    assert again.version() == 2 and again.run(day2, ["v"]).count() == 0


def test_processed_loads(spark):
    loads = spark.createDataFrame([("t", "2024-01-01"), ("t", "2024-01-02"), ("u", "2024-01-01"), ("t", None)], "table_name string, ds string")
    runs = spark.createDataFrame([("t", "2024-01-01", "2024-01-01", "success"), ("t", "2024-01-02", "2024-01-03", "failed"), ("u", None, "2024-01-05", "success")], "table_name string, ds_from string, ds_to string, run_status string")
    assert rows(incremental.processed_loads(loads, "ds", runs)) == Counter([("t", "2024-01-01")])


# --- 2

ARRIVALS = "key string, ds string, period int, value long, n int, h int, verdict string"
DAY0 = 19754  # 2024-02-01


def ds(k):
    return str(np.datetime64(DAY0 + k, "D"))


def arrivals(spark, data):
    return spark.createDataFrame([(*d, 5, 6, "clash") for d in data], ARRIVALS)


def test_late_events_match_a_replay(spark):
    rng = random.Random(2)
    data = []
    for k in range(120):
        period = rng.choice([None, *[DAY0 + rng.randrange(5)] * 6])
        for load in sorted(rng.sample(range(14), rng.randrange(1, 4))):
            row = (None if k == 0 else f"k{k}", ds(load), period, rng.choice([None, 1, 2, 3, 100]))
            data += [row] * rng.randrange(1, 3)
    adjusted = late_events.adjustments(arrivals(spark, data), ["key"], "ds", "period", "value")
    first = {}
    for key, load, period, _ in data:
        if period is not None:
            first[key] = min(first.get(key, (load, period)), (load, period))
    verdict = lambda late: "on_time" if late <= 0 else "corrects" if late <= 7 else "too_late"
    got = {r.key: r.verdict for r in adjusted.where("first").collect()}
    assert got == {k: verdict(int(np.datetime64(load, "D").astype(int)) - p) for k, (load, p) in first.items()}
    final = {(r.period, r.as_of): (r.records, r.total, r.median, r.distincts, r.lowest, r.highest) for r in late_events.corrected_aggregates(late_events.multiset(adjusted)).collect()}
    assert final
    for (period, as_of), (records, total, median, distincts, lowest, highest) in final.items():
        state = {}
        for key, load, p, v in sorted(set(data), key=lambda d: d[1]):
            day = int(np.datetime64(load, "D").astype(int))
            if p == period and day <= as_of and day - p <= 7:
                state[key] = v
        known = [v for v in state.values() if v is not None]
        assert (records, total, distincts) == (len(state), sum(known), len(set(known)))
        assert (median, lowest, highest) == ((float(statistics.median(known)), min(known), max(known)) if known else (None, None, None))


def test_late_events_of_nothing_and_bad_loads(spark):
    assert late_events.adjustments(arrivals(spark, []), ["key"], "ds", "period", "value").count() == 0
    assert late_events.adjustments(arrivals(spark, [("a", "no date", DAY0, 1), ("b", None, DAY0, 1), ("c", ds(0), None, 1)]), ["key"], "ds", "period", "value").count() == 0


def test_late_arrivals_come_from_the_state(spark):
    data = [("a", ds(0), DAY0, 10), ("b", ds(2), DAY0, 10), ("b", ds(3), DAY0, 4), ("c", ds(9), DAY0, None), ("c", ds(9), DAY0, None), (None, ds(4), DAY0 + 4, 1), ("d", ds(8), DAY0 + 1, 7)]
    adjusted = late_events.adjustments(arrivals(spark, data), ["key"], "ds", "period", "value")
    state = late_events.multiset(adjusted)
    assert rows(late_events.late_arrivals(adjusted, state, ["key"]).select("key", "period", "verdict")) == Counter([("b", DAY0, "corrects"), ("c", DAY0, "too_late"), ("d", DAY0 + 1, "corrects")])
    assert rows(late_events.late_arrivals(adjusted, state.where("value is not null"), ["key"]).select("key")) == Counter([("b",), ("d",)])


def test_period_store_repeats_a_load_without_doubling(spark, tmp_path):
    data = [("a", ds(0), DAY0, 10), ("b", ds(0), DAY0, 20), ("a", ds(2), DAY0, 40), ("c", ds(3), DAY0, 5), ("d", ds(9), DAY0, 999)]
    adjusted = late_events.adjustments(arrivals(spark, data), ["key"], "ds", "period", "value")
    store = late_events.PeriodStore(spark, str(tmp_path / "p"))
    for k in (0, 2, 2, 3, 9):
        store.apply(adjusted, DAY0 + k)
    got = store.aggregates(DAY0 + 3).head()
    assert (got["items"], got.total, got.median) == (3, 65, 20.0)
    assert store.aggregates(DAY0 + 9).count() == 0


# --- 3


def test_rolling_matches_brute_force(spark):
    rng = random.Random(3)
    last = DAY0 + 50
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *[DAY0 + rng.randrange(60)] * 9]), rng.choice([None, -5, 0, 3, 10])) for _ in range(150)] + [(9, DAY0 + 2, -7), (9, DAY0 + 2, -7)]
    daily = rolling.daily_amounts(spark.createDataFrame(data, "user long, d int, amt long"), "user", "d", "amt")
    state = rolling.advance(None, daily, DAY0, last, (7, 30))
    got = {(r.entity, r.window_days, r.day): (r.total, r.n) for r in rolling.every_day(state).collect()}
    expected, peaks = {}, {}
    for u in {d[0] for d in data if d[0] is not None and d[1] is not None and d[1] <= last}:
        own = [(d, a or 0) for v, d, a in data if v == u and d is not None and d <= last]
        for w in (7, 30):
            for day in range(min(d for d, _ in own), last + 1):
                inside = [a for d, a in own if day - w < d <= day]
                expected[u, w, day] = (sum(inside), len(inside))
            days = [k for k in expected if k[:2] == (u, w)]
            peaks[u, w] = min(days, key=lambda k: (-expected[k][0], k[2]))[2]
    assert got == expected
    assert {(r.entity, r.window_days): r.day for r in rolling.first_peak(state).collect()} == peaks
    assert rolling.advance(None, daily.limit(0), DAY0, last).count() == 0


def test_rolling_store_steps_and_corrects(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randrange(3), DAY0 + rng.randrange(12), rng.randrange(50)) for _ in range(40)]
    daily = rolling.daily_amounts(spark.createDataFrame(data, "user long, d int, amt long"), "user", "d", "amt")
    store = rolling.RollingStore(spark, str(tmp_path / "r"), (3,))
    assert store.state() is None
    store.extend(daily.limit(0), DAY0 + 1)
    for d in range(DAY0, DAY0 + 8):
        store.extend(daily, d, first=DAY0)
    store.extend(daily, DAY0 + 11)
    store.extend(daily, DAY0 + 11)
    changed = rolling.daily_amounts(spark.createDataFrame([*data, (1, DAY0 + 4, 1000), (2, DAY0 - 9, 5)], "user long, d int, amt long"), "user", "d", "amt")
    before = store.spans()
    store.correct(changed, [DAY0 + 4])
    again = rolling.RollingStore(spark, str(tmp_path / "r"), (3,))  # another process
    moved = [a[0] - DAY0 for a, b in zip(again.spans(), before, strict=True) if a != b]
    assert moved == [4, 5, 6, 7] and [s[:2] for s in before] == [*[(DAY0 + k, DAY0 + k) for k in range(8)], (DAY0 + 8, DAY0 + 11)]
    plain = rolling.daily_amounts(spark.createDataFrame([*data, (1, DAY0 + 4, 1000)], "user long, d int, amt long"), "user", "d", "amt")
    want = {(r.entity, r.day): (r.total, r.n) for r in rolling.every_day(rolling.advance(None, plain, DAY0, DAY0 + 11, (3,))).collect()}
    assert {(r.entity, r.day): (r.total, r.n) for r in rolling.every_day(again.state()).collect()} == want


def test_rolling_store_that_dies_keeps_its_version(spark, tmp_path, monkeypatch):
    daily = spark.createDataFrame([(1, DAY0, 5, 1)], "entity long, day int, amount long, n long")
    store = rolling.RollingStore(spark, str(tmp_path / "r"), (3,))
    store.extend(daily, DAY0)
    monkeypatch.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.extend(daily, DAY0 + 5)
    again = rolling.RollingStore(spark, str(tmp_path / "r"), (3,))
    assert [s[1] for s in again.spans()] == [DAY0]
    again.extend(daily, DAY0 + 5)
    assert [(r.day, r.until, r.total) for r in again.state().orderBy("day").collect()] == [(DAY0, DAY0, 5), (DAY0 + 1, DAY0 + 2, 5), (DAY0 + 3, DAY0 + 5, 0)]


# --- 4


def test_profile_of_nulls_ties_and_violations(spark):
    data = [("l1", 5, "x"), ("l1", 5, None), ("l1", None, ""), ("l1", -1, "y"), (None, None, None), ("l2", 10**15, "x" * 70_000)]
    df = spark.createDataFrame(data, "load string, v long, s string")
    counts = profile.value_counts(df, "load", ["v", "s"])
    p = {(r.load, r.column_name): r for r in profile.profile(counts, {"v": F.col("value").cast("long") < 0}, ["v"]).collect()}
    r = p["l1", "v"]
    assert (r.rows, r.nulls, r.distincts, r.lowest, r.highest, r.invalid, r.top, r.median) == (4, 1, 2, "-1", "5", 1, 2, 5.0)
    assert (p[None, "v"].nulls, p[None, "v"].top, p[None, "v"].median) == (1, None, None)
    assert p["l1", "s"].distincts == 3 and p["l1", "s"].lowest == "" and len(p["l2", "s"].highest) == 70_000
    assert profile.profile(profile.value_counts(df.limit(0), "load", ["v"]), {}, ["v"]).count() == 0


def test_odd_loads(spark):
    data = []
    for k in range(9):
        for i in range(40):
            v = 1000 + i if k == 3 else None if k == 4 and i < 20 else -5 if k == 5 and i < 20 else 7 if k == 6 and i < 20 else 10 + i
            data.append((f"l{k}", v))
    data += [("small", 10**6)] * 29
    counts = profile.value_counts(spark.createDataFrame(data, "load string, v long"), "load", ["v"])
    found = profile.odd_loads(profile.profile(counts, {"v": F.col("value").cast("long") < 0}, ["v"]))
    assert {(r.load, r.measure) for r in found.collect()} == {("l3", "median"), ("l4", "null_share"), ("l5", "invalid_share"), ("l5", "top_share"), ("l6", "top_share")}


def test_stability_is_zero_for_equal_loads(spark):
    df = spark.createDataFrame([(load, v) for load in "ab" for v in [1, 1, 2, None]] + [("c", 9)] * 4, "load string, v long")
    s = {r.load: r.psi for r in profile.stability(profile.value_counts(df, "load", ["v"])).collect()}
    assert s["a"] == pytest.approx(s["b"]) and s["c"] > s["a"]


def test_stability_sees_shifts_among_rare_values(spark):
    day = "date_format(date_add(date'2024-01-01', cast(v as int)), 'yyyy-MM-dd')"
    df = spark.range(4000).selectExpr("if(id % 4 = 0, 'odd', concat('l', id % 4)) AS load", "if(id % 4 = 0, id + 9000, id) AS v").selectExpr("load", "v", f"{day} AS s", "concat('t', if(load = 'odd', 0, v % 900)) AS t")
    psi = {(r.column_name, r.load): r.psi for r in profile.stability(profile.value_counts(df, "load", ["v", "s", "t"])).collect()}
    assert all(psi[c, "odd"] > 2 and psi[c, "odd"] > psi[c, "l1"] for c in ("v", "s"))
    assert len(psi) == 12


# --- 5


def test_sketch_bounds_hold():
    rng = np.random.default_rng(0)
    s = heavy_hitters.ElasticSketch()
    values = rng.zipf(1.2, 200_000) % 100_000
    hashed = (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
    for k in range(0, len(values), 50_000):
        u, at, n = np.unique(values[k : k + 50_000], return_index=True, return_counts=True)
        s.add(u, hashed[k : k + 50_000][at], n)
    true = Counter(values.tolist())
    assert s.rows == len(values) == int(s.n.sum() + s.light.sum())
    held = {int(i): int(n) for i, n in zip(s.item[s.n > 0], s.n[s.n > 0], strict=True)}
    cell = {int(i): int(heavy_hitters.slots(h.reshape(1))[1][0]) for i, h in zip(s.item[s.n > 0], s.hash[s.n > 0], strict=True)}
    assert all(held[i] <= true[i] <= held[i] + s.light[cell[i]] for i in held)
    assert {i for i, _ in true.most_common(20)} <= set(held)


def test_above_share_is_exact_also_for_strings_nulls_and_clashes(spark):
    rng = random.Random(6)
    data = [(rng.choice([None, 7, 7, 7, *range(100, 130)]), rng.choice([None, "hot", "hot", *map(str, range(40))]), 1, 2, 3) for _ in range(4000)]
    df = spark.createDataFrame(data, "a long, b string, col int, item int, cell int").repartition(7)
    got = {(r.column_name, r.item_value): r.n for r in heavy_hitters.above_share(df, ["a", "b"], 0.05).collect()}
    a = Counter(d[0] for d in data if d[0] is not None)
    assert {v: n for (c, v), n in got.items() if c == "a"} == {v: n for v, n in a.items() if n > 0.05 * sum(a.values())}
    b = Counter(d[1] for d in data if d[1] is not None)
    assert sorted(n for (c, _), n in got.items() if c == "b") == sorted(n for n in b.values() if n > 0.05 * sum(b.values()))
    assert heavy_hitters.above_share(df.limit(0), ["a", "b"], 0.05).count() == 0
    assert heavy_hitters.above_share(df.where("a is null").select("a"), ["a"], 0.05).count() == 0


def test_items_squeezed_out_of_the_lanes_are_still_found(spark, monkeypatch):
    monkeypatch.setattr(heavy_hitters, "LANES", 1)
    monkeypatch.setattr(heavy_hitters, "slots", lambda h: (F.lit(0), F.lit(3)) if not isinstance(h, np.ndarray) else (np.zeros(len(h), np.int64), np.full(len(h), 3)))
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 40 + [(i,) for i in range(3, 60)], "v long").coalesce(1)
    # The workers import the module anew, so the parts are made here with the squeezed sketch.
    u, n = np.unique(np.array([r.v for r in df.collect()]), return_counts=True)
    s = heavy_hitters.ElasticSketch()
    s.item, s.hash, s.n = (x[:, :1] for x in (s.item, s.hash, s.n))
    s.add(u, u, n)
    parts = spark.createDataFrame(s.rows_out(0).to_pandas(), heavy_hitters.SKETCH)
    monkeypatch.setattr(heavy_hitters.runtime, "map_arrow", lambda *a: parts)
    got = heavy_hitters.above_share(df, ["v"], 0.2)
    assert {r.item_value for r in got.collect()} == {1, 2}


# --- 6

EVENTS = "who long, type string, millis long, amt long, entity int, kind int, n int, total int, latest int"


def test_features_and_leaders_match_brute_force(spark):
    rng = random.Random(7)
    kinds = ["b.x", "a", "", "c d"]
    data = [(rng.choice([None, 5, 5, 5, *range(20)]), rng.choice([None, *kinds]), rng.choice([None, *range(50)]), rng.choice([None, -3, 0, 4]), 1, 1, 1, 1, 1) for _ in range(800)]
    df = spark.createDataFrame(data, EVENTS).repartition(5)
    own = defaultdict(lambda: defaultdict(list))
    for who, kind, t, amt, *_ in data:
        if who is not None and kind is not None:
            own[who][kind].append((t, amt or 0))
    latest = lambda v: max((t for t, _ in v if t is not None), default=None)
    want = Counter()
    for who, by in own.items():
        want[who, "count", min(by, key=lambda k: (-len(by[k]), k))] += 1
        want[who, "total", min(by, key=lambda k: (-sum(a for _, a in by[k]), k))] += 1
        timed = {k: latest(v) for k, v in by.items() if latest(v) is not None}
        if timed:
            want[who, "recency", min(timed, key=lambda k: (-timed[k], k))] += 1
    assert rows(entity_features.leaders(df, "who", "type", "millis", "amt")) == want
    wide = entity_features.wide(df, "who", "type", "millis", "amt")
    assert wide.columns[1:5] == ["count_blank", "count_a", "count_b_x", "count_c_d"]
    got = {r.entity: r for r in wide.collect()}
    assert set(got) == set(own)
    for who, by in own.items():
        for kind, name in zip(sorted(kinds), ["blank", "a", "b_x", "c_d"], strict=True):
            v = by.get(kind, [])
            assert (got[who][f"count_{name}"], got[who][f"total_{name}"], got[who][f"latest_{name}"]) == (len(v), sum(a for _, a in v), latest(v))
    assert entity_features.wide(df.limit(0), "who", "type", "millis", "amt").columns == ["entity"]
    assert entity_features.leaders(df.limit(0), "who", "type", "millis", "amt").count() == 0


def test_column_names_are_unique():
    assert entity_features.column_names(["a.b", "a_b", "a b", ""]) == ["a_b", "a_b_2", "a_b_3", "blank"]


# --- 7


def test_every_point_lies_in_one_rectangle(spark):
    rng = random.Random(8)
    v = [(u, DAY0 + d, rng.choice([None, 0, 1]), 3) for u in (None, 1, 2, 3) for d in rng.sample(range(40), 4)]
    versions_ = spark.createDataFrame(v + v, "u long, load int, flag int, known_day int")
    rects = bitemporal.rectangles(versions_, "u", "load", ["flag"])
    points = spark.createDataFrame([(u, DAY0 + a, DAY0 + b) for u in (1, 2, 3, 99) for a in range(-3, 45, 4) for b in range(-3, 45, 5)], "entity long, valid int, known int")
    got = bitemporal.locate(points, "entity", "valid", "known", rects, (DAY0, DAY0 + 40), ["valid", "known"], grid_days=7)
    found = {(r.valid, r.known, r.known_day, r.flag, r.newest_flag): 1 for r in got.where("entity <> 99").collect()}
    assert got.where("entity = 99 and known_day is null").count() == len(range(-3, 45, 4)) * len(range(-3, 45, 5))
    assert got.where("entity <> 99").count() == 3 * len(range(-3, 45, 4)) * len(range(-3, 45, 5))
    for (valid, known, known_day, flag, newest), _ in found.items():
        assert known_day is None or (known_day <= valid and known_day < known)
        assert any(u is not None and newest == f for u, d, f, _ in v)
        assert known_day is None or any(d == known_day and f == flag for _, d, f, _ in v)


def test_diagonal_agrees_with_the_latest_complete_load(spark):
    rng = random.Random(9)
    v = [(u, DAY0 + d, rng.choice([None, 0, 1])) for u in range(5) for d in rng.sample(range(40), rng.randrange(1, 5))]
    rects = bitemporal.rectangles(spark.createDataFrame(v, "u long, load int, flag int"), "u", "load", ["flag"])
    pts = [(u if u < 6 else 0, DAY0 + d) for u in range(60) for d in range(-2, 42, 3)]
    got = bitemporal.locate(spark.createDataFrame(pts, "who long, day int"), "who", "day", "day", rects, (DAY0, DAY0 + 40), ["day"])
    want = Counter()
    for u, day in pts:
        own = sorted((d, f) for w, d, f in v if w == u)
        before = [x for x in own if x[0] < day]
        want[u, day, *(before[-1] if before else (None, None)), own[-1][1] if own else None] += 1
    assert Counter((r.who, r.day, r.known_day, r.flag, r.newest_flag) for r in got.collect()) == want
    assert bitemporal.locate(spark.createDataFrame([], "who long, day int"), "who", "day", "day", rects, (0, 0), ["day"]).count() == 0
    assert bitemporal.rectangles(spark.createDataFrame([], "u long, load int, flag int"), "u", "load", ["flag"]).count() == 0


def test_points_without_versions_or_day_stay_if_all_are_kept(spark):
    rects = bitemporal.rectangles(spark.createDataFrame([(1, DAY0, 1)], "u long, load int, flag int"), "u", "load", ["flag"])
    points = spark.createDataFrame([(1, DAY0 + 2), (1, DAY0 - 2), (1, None), (2, DAY0 + 2), (None, DAY0)], "who long, day int")
    got = bitemporal.locate(points, "who", "day", "day", rects, (DAY0, DAY0), ["day"])
    assert Counter((r.who, r.day, r.known_day, r.flag) for r in got.collect()) == Counter([(1, DAY0 + 2, DAY0, 1), (1, DAY0 - 2, None, None), (1, None, None, None), (2, DAY0 + 2, None, None), (None, DAY0, None, None)])


@pytest.mark.parametrize("cells,hot", [(1000, 20), (2, 500_000), (2, 20)])
def test_grid_and_groups_change_nothing(spark, monkeypatch, cells, hot):
    monkeypatch.setattr(bitemporal, "MAX_CELLS", cells)
    monkeypatch.setattr(bitemporal, "HOT_POINTS", hot)
    rng = random.Random(10)
    v = [(u, DAY0 + d, rng.choice([None, 0, 1])) for u in range(4) for d in rng.sample(range(40), 3)]
    rects = bitemporal.rectangles(spark.createDataFrame(v, "u long, load int, flag int"), "u", "load", ["flag"])
    pts = [(k, 0 if k % 3 else k % 7, DAY0 + rng.randrange(-400, 400), DAY0 + rng.randrange(-400, 400), "x") for k in range(400)]
    got = bitemporal.locate(spark.createDataFrame(pts, "id int, who long, valid int, known int, flag string"), "who", "valid", "known", rects, (DAY0, DAY0 + 40), ["id"])
    assert {"point_flag", "flag"} <= set(got.columns)
    want = {}
    for k, u, valid, known, _ in pts:
        own = [(d, f) for w, d, f in v if w == u and d <= valid and d < known]
        want[k] = max(own, key=lambda x: x[0]) if own else (None, None)
    assert {r.id: (r.known_day, r.flag) for r in got.collect()} == want and got.count() == 400
