"""The feature engine's results in SQL, over whole tables. Times are epoch milliseconds by truncation."""

E = """e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ts, strftime(ts, '%Y-%m-%d') AS ds, CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS day FROM events)"""
Q = "q AS (SELECT DISTINCT user_id, ts FROM e WHERE event_type = 'purchase')"
HOUR, DAY = 3_600_000, 86_400_000


def tail(millis: int) -> str:
    hop = DAY if millis >= 12 * DAY else HOUR if millis >= 12 * HOUR else 300_000
    return f"((q.ts - {millis}) // {hop}) * {hop}"


def pit(columns: list[str], longest: int | None) -> str:
    low = f" AND e.ts >= {tail(longest)}" if longest else ""
    return f"WITH {E}, {Q} SELECT q.user_id, q.ts, {', '.join(columns)} FROM q LEFT JOIN e ON q.user_id = e.user_id AND e.ts <= q.ts{low} GROUP BY q.user_id, q.ts"


def when(x: str, millis: int | None) -> str:
    return f"CASE WHEN e.ts >= {tail(millis)} THEN {x} END" if millis else x


def numbers(label: str, millis: int | None, ops=("sum", "count", "average", "min", "max"), x: str = "value") -> list[str]:
    sql = {"sum": "round(sum({}), 6)", "count": "nullif(count({}), 0)", "average": "round(avg({}), 6)", "min": "round(min({}), 6)", "max": "round(max({}), 6)"}
    return [f"{sql[o].format(when('e.' + x, millis))} AS {x}_{o}{'_' + label if label else ''}" for o in ops]


def text_list(x: str, order: str, k: int) -> str:
    return f"array_to_string(list_slice(list({x} ORDER BY {order}) FILTER (WHERE e.event_id IS NOT NULL), 1, {k}), ',')"


def daily(keys: str, ops: dict[str, str], start: str, end: str, source: str = "e", rows: str = "count(*) > 0") -> str:
    """Snapshot per key and day: `ops` maps output names to aggregates with {n} replaced by the days of the window."""
    return f"""days AS (SELECT strftime(d, '%Y-%m-%d') AS ds, date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS day FROM (SELECT unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d)),
snap AS (SELECT {keys}, d.ds, {', '.join(f'{v} AS {k}' for k, v in ops.items())} FROM {source} e JOIN days d ON e.day <= d.day GROUP BY {keys}, d.ds)"""


def in_days(x: str, n: int | None) -> str:
    return f"CASE WHEN e.day > d.day - {n} THEN {x} END" if n else x


SUMS = {"value_sum_1d": f"sum({in_days('value', 1)})", "value_sum_7d": f"sum({in_days('value', 7)})", "value_count_7d": f"nullif(count({in_days('value', 7)}), 0)"}
SOME = "(value_sum_1d IS NOT NULL OR value_sum_7d IS NOT NULL OR value_count_7d IS NOT NULL)"
SHIFTED = f"{daily('user_id', SUMS, '2023-12-31', '2024-01-30')}, shifted AS (SELECT user_id, strftime(CAST(ds AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') AS ts_ds, value_sum_1d, value_sum_7d, value_count_7d FROM snap WHERE {SOME})"
PURCHASES = "p AS (SELECT *, ds AS ts_ds FROM e WHERE event_type = 'purchase' AND ds BETWEEN '2024-01-01' AND '2024-01-31')"
LIVE = f"""live AS (SELECT q.user_id, q.ts, sum({when('e.value', HOUR)}) AS live_value_sum_1h, sum({when('e.value', DAY)}) AS live_value_sum_1d FROM q LEFT JOIN e ON q.user_id = e.user_id AND e.ts <= q.ts AND e.ts >= {tail(DAY)} GROUP BY q.user_id, q.ts)"""


def gb(expr: str, name: str) -> str:
    return f"WITH {E} SELECT user_id, {expr} AS {name} FROM e GROUP BY user_id"


MOMENTS = f"WITH {E}, m AS (SELECT user_id, avg(value) AS mean, count(value) AS n FROM e GROUP BY 1), c AS (SELECT e.user_id, m.n, sum((value - mean) ** 2) AS m2, sum((value - mean) ** 3) AS m3, sum((value - mean) ** 4) AS m4 FROM e JOIN m ON e.user_id = m.user_id GROUP BY 1, 2)"
SHAKEN = "s AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE event_type END AS event_type FROM e WHERE event_id % 10 <> 0)"
TYPES = "t AS (SELECT event_type, count(*) FILTER (WHERE ts < 1705276800000) AS a, count(*) FILTER (WHERE ts >= 1705276800000) AS b FROM e GROUP BY 1), r AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM t)"
KL = "(CASE WHEN {x} > 0 THEN {x} * ln({x} / ((p + q) / 2)) ELSE 0 END)"
DAYS = f"h AS (SELECT (ts // {DAY}) * {DAY} AS bucket, count(*) AS n, avg(value) AS a FROM e GROUP BY 1)"


def count_if(x: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {x} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def compared(c: str, numeric: bool) -> list[str]:
    x, y = f"l.{c}", f"r.{c}"
    out = [f"{count_if(f'{x} IS NULL AND {y} IS NULL')} AS {c}_both_null", f"{count_if(f'{x} IS NULL AND {y} IS NOT NULL')} AS {c}_left_null", f"{count_if(f'{x} IS NOT NULL AND {y} IS NULL')} AS {c}_right_null", f"count(*) AS {c}_total", f"{count_if(f'{x} <> {y}')} AS {c}_mismatch"]
    if numeric:
        out.append(f"round(avg(CASE WHEN abs({x}) + abs({y}) <> 0 THEN 2 * abs({x} - {y}) / (abs({x}) + abs({y})) WHEN abs({x}) + abs({y}) = 0 THEN 0 END), 5) AS {c}_smape")
    return out


CDC = f"""base AS (SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) // 1000 AS ts FROM orders WHERE o_orderdate < TIMESTAMP '2001-09-01'),
t0 AS (SELECT epoch_us(TIMESTAMP '2001-09-01') // 1000 AS d0),
log AS (
  SELECT o_custkey, ts, o_totalprice, -1 AS at, 1 AS sign FROM base
  UNION ALL SELECT o_custkey, ts, o_totalprice, d0 + (o_orderkey % 20) * {HOUR}, -1 FROM base, t0 WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
  UNION ALL SELECT o_custkey, ts, o_totalprice + 100, d0 + (o_orderkey % 20) * {HOUR}, 1 FROM base, t0 WHERE o_orderkey % 7 = 0),
asked AS (SELECT DISTINCT o_custkey, d0 + unnest([5, 19]) * {HOUR} AS ts FROM base, t0)"""

# Rows arrive before the newest time is known, but for every 50th event: those are late if their hour had ended by then.
LATE = f"""c AS (SELECT max(ts) FILTER (WHERE event_id % 50 <> 0) - 300000 AS before, max(ts) - 300000 AS closed FROM e),
x AS (SELECT e.*, (ts // {HOUR}) * {HOUR} AS start, closed, event_id % 50 = 0 AND (ts // {HOUR}) * {HOUR} + {HOUR} <= before AS late FROM e, c)"""

SQL = {
    "pit_multi_window": pit([c for w, m in (("1h", HOUR), ("1d", DAY), ("7d", 7 * DAY)) for c in numbers(w, m)], 7 * DAY),
    "tile_join_14d": pit([c for w, m in (("30m", HOUR // 2), ("14d", 14 * DAY)) for c in numbers(w, m, ("sum", "count"))], 14 * DAY),
    "pit_unbounded": pit([*numbers("", None, ("sum", "count")), "round(arg_max(e.value, (e.ts, e.value)), 6) AS value_last", "round(arg_min(e.value, (e.ts, e.value)), 6) AS value_first"], None),
    "pit_first_last": pit(["arg_min(e.event_type, (e.ts, e.event_type)) AS event_type_first_1d", "arg_max(e.event_type, (e.ts, e.event_type)) AS event_type_last_1d"], DAY),
    "pit_last_k": pit([f"{text_list('e.event_id', 'e.ts DESC, e.event_id DESC', 3)} AS event_id_last3_7d", f"{text_list('e.event_id', 'e.ts, e.event_id', 3)} AS event_id_first3_7d"], 7 * DAY),
    "pit_top_k": pit([f"{text_list('e.event_id', 'e.event_id DESC', 3)} AS event_id_top3_7d", f"{text_list('e.event_id', 'e.event_id', 3)} AS event_id_bottom3_7d"], 7 * DAY),
    "pit_bucketed_by_event_type": f"WITH {E}, {Q} SELECT q.user_id, q.ts, e.event_type AS bucket, round(sum(e.value), 6) AS amount FROM q JOIN e ON q.user_id = e.user_id AND e.ts <= q.ts AND e.ts >= {tail(DAY)} GROUP BY 1, 2, 3 HAVING sum(e.value) IS NOT NULL",
    "pit_unique_count": pit([f"nullif(count(DISTINCT {when('e.event_type', m)}), 0) AS event_type_unique_count_{w}" for w, m in (("1d", DAY), ("7d", 7 * DAY))], 7 * DAY),
    "pit_histogram": f"WITH {E}, {Q} SELECT q.user_id, q.ts, e.event_type AS bucket, CAST(count(*) AS INTEGER) AS amount FROM q JOIN e ON q.user_id = e.user_id AND e.ts <= q.ts AND e.ts >= {tail(7 * DAY)} GROUP BY 1, 2, 3",
    "pit_variance": pit(["round(sqrt(var_pop(e.value)), 4) AS value_deviation_7d"], 7 * DAY),
    "snapshot_events_daily": f"""WITH {E}, {daily('user_id', {f'value_{o}{w}': s.format(in_days('value', n)) for o, s in (('sum', 'round(sum({}), 6)'), ('count', 'nullif(count({}), 0)'), ('max', 'round(max({}), 6)')) for w, n in (('_1d', 1), ('_7d', 7), ('', None))}, '2024-01-01', '2024-01-31')} SELECT * FROM snap WHERE value_count IS NOT NULL""",
    "snapshot_events_bucketed": f"WITH {E}, {daily('user_id, event_type', {'amount': f'nullif(count({in_days('value', 3)}), 0)'}, '2024-01-01', '2024-01-31')} SELECT user_id, ds, event_type AS bucket, amount FROM snap WHERE amount IS NOT NULL",
    "snapshot_entities_users": "SELECT user_id, ds, nullif(count(email_verified), 0) AS email_verified_count, max(email_verified) AS email_verified_max_1d, min(account_created_ds) AS account_created_ds_min FROM users WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "entity_passthrough": "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal, '2024-01-31' AS ds FROM customer",
    "gb_sum": gb("round(sum(value), 6)", "value_sum"),
    "gb_count": gb("nullif(count(value), 0)", "value_count"),
    "gb_average": gb("round(avg(value), 6)", "value_average"),
    "gb_min": gb("round(min(value), 6)", "value_min"),
    "gb_max": gb("max(event_type)", "event_type_max"),
    "gb_variance": gb("round(var_pop(value), 4)", "value_variance"),
    "gb_skew": f"{MOMENTS} SELECT user_id, round(CASE WHEN n >= 3 AND m2 > 0 THEN sqrt(n) * m3 / power(m2, 1.5) END, 4) AS value_skew FROM c",
    "gb_kurtosis": f"{MOMENTS} SELECT user_id, round(CASE WHEN n >= 4 AND m2 > 0 THEN n * m4 / (m2 * m2) - 3 END, 4) AS value_kurtosis FROM c",
    "gb_first": gb("arg_min(event_id, (ts, event_id))", "event_id_first"),
    "gb_last": gb("arg_max(event_id, (ts, event_id))", "event_id_last"),
    "gb_first_k": gb(text_list("event_id", "ts, event_id", 5), "event_id_first5"),
    "gb_last_k": gb(text_list("event_id", "ts DESC, event_id DESC", 5), "event_id_last5"),
    "gb_top_k": gb(text_list("event_id", "event_id DESC", 5), "event_id_top5"),
    "gb_bottom_k": gb(text_list("event_id", "event_id", 5), "event_id_bottom5"),
    "gb_unique_count": gb("nullif(count(DISTINCT event_type), 0)", "event_type_unique_count"),
    "gb_unique_top_k": gb("array_to_string(list_slice(list(DISTINCT event_type ORDER BY event_type DESC), 1, 2), ',')", "event_type_unique_top2"),
    "gb_unique_top_k_struct": gb("array_to_string(list_slice(list(event_id ORDER BY lpad(CAST(CAST(round(value, 2) * 100 AS BIGINT) AS VARCHAR), 12, '0') DESC, event_id DESC), 1, 3), ',')", "ids"),
    "gb_histogram": f"WITH {E} SELECT user_id, event_type AS bucket, CAST(count(*) AS INTEGER) AS amount FROM e GROUP BY 1, 2",
    "gb_frequent_k": f"WITH {E}, c AS (SELECT event_type, CAST(user_id AS VARCHAR) AS bucket, count(*) AS amount FROM e GROUP BY 1, 2) SELECT event_type, bucket, amount FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY amount DESC, bucket) <= 5",
    "gb_heavy_hitters": f"WITH {E}, c AS (SELECT user_id, event_type AS bucket, count(*) AS amount FROM e GROUP BY 1, 2), t AS (SELECT *, sum(amount) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, bucket) AS r FROM c) SELECT user_id, bucket, amount FROM t WHERE amount * 4 > total AND r <= 4",
    "gb_bucketed": f"WITH {E} SELECT user_id, event_type AS bucket, round(avg(value), 6) AS amount FROM e GROUP BY 1, 2 HAVING count(value) > 0",
    "vector_explode_average": "SELECT label, round(avg(CAST(x AS DOUBLE)), 4) AS embedding_average, count(x) AS embedding_count, round(CAST(max(x) AS DOUBLE), 4) AS embedding_max FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label",
    "map_explode_sum": f"WITH {E} SELECT user_id, event_type AS bucket, round(sum(value), 6) AS amount FROM e GROUP BY 1, 2 HAVING sum(value) IS NOT NULL",
    "join_events_snapshot_shift": f"WITH {E}, {SHIFTED}, {PURCHASES} SELECT p.ts, p.event_id, p.user_id, p.ds, p.ts_ds, round(value_sum_1d, 6) AS daily_value_sum_1d, round(value_sum_7d, 6) AS daily_value_sum_7d, value_count_7d AS daily_value_count_7d FROM p LEFT JOIN shifted s ON s.user_id = p.user_id AND s.ts_ds = p.ts_ds",
    "join_events_temporal": f"WITH {E}, {Q}, {PURCHASES}, {LIVE} SELECT p.ts, p.event_id, p.user_id, p.ds, p.ts_ds, round(live_value_sum_1h, 6) AS live_value_sum_1h, round(live_value_sum_1d, 6) AS live_value_sum_1d FROM p LEFT JOIN live s ON s.user_id = p.user_id AND s.ts = p.ts",
    "join_multi_part_prefixed": f"WITH {E}, {Q}, {SHIFTED}, {PURCHASES}, {LIVE} SELECT p.ts, p.event_id, p.user_id AS buyer, p.ds, p.ts_ds, round(value_sum_1d, 6) AS own_daily_value_sum_1d, round(value_sum_7d, 6) AS own_daily_value_sum_7d, value_count_7d AS own_daily_value_count_7d, round(live_value_sum_1h, 6) AS live_value_sum_1h, round(live_value_sum_1d, 6) AS live_value_sum_1d FROM p LEFT JOIN shifted s ON s.user_id = p.user_id AND s.ts_ds = p.ts_ds LEFT JOIN live v ON v.user_id = p.user_id AND v.ts = p.ts",
    "join_entities_snapshot": """WITH u AS (SELECT DISTINCT user_id, ds, date_diff('day', DATE '1970-01-01', CAST(ds AS DATE)) AS day FROM users WHERE user_id IS NOT NULL),
        v AS (SELECT user_id, CAST(floor(ts / 86400000.0) AS BIGINT) AS day, count(item_id) AS n, max(time_spent_ms) AS m FROM item_views WHERE ts BETWEEN 1500000000000 AND 1900000000000 GROUP BY 1, 2)
        SELECT u.user_id, u.ds, CAST(nullif(sum(n), 0) AS BIGINT) AS views_item_id_count_7d, max(m) AS views_time_spent_ms_max_7d FROM u LEFT JOIN v ON v.user_id = u.user_id AND v.day <= u.day AND v.day > u.day - 7 GROUP BY u.user_id, u.ds""",
    "join_skew_filter": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND (user_id NOT IN (1, 2, 3) OR event_type NOT IN ('view'))",
    "join_coalesced": "WITH o AS (SELECT o_custkey, max(CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END) AS note FROM orders GROUP BY 1) SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, o.note) AS note FROM customer LEFT JOIN o ON o_custkey = c_custkey",
    "join_small_left": "SELECT user_id, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id",
    "join_bootstrap": f"WITH {E}, {SHIFTED}, {PURCHASES} SELECT p.ts, p.event_id, p.user_id, p.ds, p.ts_ds, CASE WHEN p.event_id % 3 = 0 THEN p.event_id ELSE round(value_sum_1d, 6) END AS daily_value_sum_1d, CASE WHEN p.event_id % 3 = 0 THEN 0 ELSE round(value_sum_7d, 6) END AS daily_value_sum_7d, CASE WHEN p.event_id % 3 = 0 THEN 7 ELSE value_count_7d END AS daily_value_count_7d FROM p LEFT JOIN shifted s ON s.user_id = p.user_id AND s.ts_ds = p.ts_ds",
    "derivations_wildcard": f"WITH {E}, {daily('user_id', {'s': f'sum({in_days('value', 7)})', 'c': f'nullif(count({in_days('value', 7)}), 0)', 'm': f'max({in_days('value', 7)})'}, '2024-01-01', '2024-01-31')} SELECT user_id, ds, round(s, 6) AS value_sum_7d, c AS value_count_7d, round(s / c, 6) AS per_event, round(m, 6) AS peak FROM snap WHERE c IS NOT NULL",
    "join_derivations": f"WITH {E}, {SHIFTED}, {PURCHASES} SELECT p.ts, p.event_id, p.user_id, p.ds, p.ts_ds, round(value_sum_1d, 6) AS daily_value_sum_1d, round(value_sum_7d, 6) AS daily_value_sum_7d, value_count_7d AS daily_value_count_7d, round(value_sum_7d / value_count_7d, 6) AS mean_7d FROM p LEFT JOIN shifted s ON s.user_id = p.user_id AND s.ts_ds = p.ts_ds",
    "chained_group_by": f"WITH {E}, {Q}, {PURCHASES}, {LIVE}, j AS (SELECT p.user_id, p.day, live_value_sum_1d AS spent FROM p LEFT JOIN live s ON s.user_id = p.user_id AND s.ts = p.ts), {daily('user_id', {'m': f'max({in_days('spent', 7)})', 'c': f'nullif(count({in_days('spent', 7)}), 0)'}, '2024-01-01', '2024-01-31', 'j')} SELECT user_id, ds, round(m, 6) AS spent_max_7d, c AS spent_count_7d FROM snap WHERE c IS NOT NULL",
    "multi_source_union": f"WITH {E}, x AS (SELECT user_id, day, round(value, 2) AS amount FROM e), {daily('user_id', {'s': f'sum({in_days('amount', 7)})', 'c': f'nullif(count({in_days('amount', 7)}), 0)'}, '2024-01-01', '2024-01-31', 'x')} SELECT user_id, ds, round(s, 4) AS amount_sum_7d, c AS amount_count_7d FROM snap WHERE c IS NOT NULL",
    "cumulative_latest": "SELECT user_id, '2024-03-31' AS ds, nullif(count(email_verified), 0) AS email_verified_count, max(email_verified) AS email_verified_max FROM users WHERE user_id IS NOT NULL AND ds = (SELECT max(ds) FROM users) GROUP BY user_id HAVING count(email_verified) > 0",
    "mutation_aggregates": f"""WITH {CDC} SELECT a.o_custkey, a.ts, round(sum(sign * o_totalprice) / nullif(sum(sign), 0), 6) AS o_totalprice_average, round(sum(sign * o_totalprice), 6) AS o_totalprice_sum, CAST(sum(sign) AS BIGINT) AS o_totalprice_count,
        round(max(CASE WHEN sign > 0 THEN o_totalprice END), 6) AS o_totalprice_max, CAST(sum(CASE WHEN l.ts >= ((a.ts - {90 * DAY}) // {DAY}) * {DAY} THEN sign END) AS BIGINT) AS o_totalprice_count_90d
        FROM asked a LEFT JOIN log l ON l.o_custkey = a.o_custkey AND l.ts < a.ts AND l.at < a.ts GROUP BY 1, 2""",
    "staging_query_macros": f"WITH {E} SELECT ds, event_type, count(*) AS n FROM e WHERE ds BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1, 2",
    "staging_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "scan_partition_range": "SELECT user_id, time_spent_ms // 1000 AS seconds, ds FROM item_views WHERE ds >= '2024-02-10' AND ds <= '2024-02-20' AND user_id IS NOT NULL AND (time_spent_ms > 0 OR item_id IS NULL)",
    "lambda_merge_live": f"""WITH {E}, q AS (SELECT DISTINCT user_id, ts FROM e WHERE event_type = 'purchase' AND ts >= 1705708800000)
        SELECT q.user_id, q.ts, round(sum({when('e.value', DAY)}), 6) AS value_sum_1d, round(sum({when('e.value', 7 * DAY)}), 6) AS value_sum_7d, round(sum(e.value), 6) AS value_sum, nullif(count({when('e.value', 7 * DAY)}), 0) AS value_count_7d, round(arg_max(e.value, (e.ts, e.value)), 6) AS value_last
        FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.ts < q.ts GROUP BY 1, 2""",
    "stats_hourly": f"WITH {E} SELECT (ts // {HOUR}) * {HOUR} AS bucket, count(*) AS total_count, {count_if('value IS NULL')} AS value_null_sum, {count_if('value = 0')} AS value_zero_sum, round(min(value), 4) AS value_min, round(max(value), 4) AS value_max, round(avg(value), 4) AS value_average, round(sqrt(var_pop(value)), 4) AS value_deviation, {count_if('event_type IS NULL')} AS event_type_null_sum FROM e GROUP BY 1",
    "stats_merged": f"WITH {E} SELECT count(*) AS total_count, {count_if('value IS NULL')} AS value_null_sum, {count_if('value = 0')} AS value_zero_sum, round(min(value), 3) AS value_min, round(max(value), 3) AS value_max, round(avg(value), 3) AS value_average, round(var_pop(value), 3) AS value_variance, {count_if('event_type IS NULL')} AS event_type_null_sum FROM e",
    "stats_null_rates": f"SELECT (ts // {DAY}) * {DAY} AS bucket, " + ", ".join(f"round((count(*) - count({c})) / count(*), 6) AS {c}_null_rate" for c in ("user_id", "item_id", "time_spent_ms")) + " FROM item_views WHERE ts IS NOT NULL GROUP BY 1",
    "enhanced_stats_low_card": f"WITH {E}, c AS (SELECT (ts // {DAY}) * {DAY} AS bucket, event_type, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY 1, 2) SELECT bucket, event_type, n, CAST(sum(n) OVER (PARTITION BY bucket) AS BIGINT) AS total_count, count(*) OVER (PARTITION BY bucket) AS event_type_unique_count FROM c",
    "drift_histogram": f"WITH {E}, {TYPES} SELECT round(sum((greatest(q, 0) + (q = 0)::INT * 1e-5 - p - (p = 0)::INT * 1e-5) * ln((q + (q = 0)::INT * 1e-5) / (p + (p = 0)::INT * 1e-5))), 6) AS psi, round(sum((sqrt(p) - sqrt(q)) ** 2 / 2), 6) AS hellinger, round(sum(({KL.format(x='p')} + {KL.format(x='q')}) / 2), 6) AS jensen_shannon FROM r",
    "tile_drift": f"WITH {E}, {DAYS} SELECT h.bucket, round((h.n - o.n) / o.n * 100, 4) AS total_count_change, round((h.a - o.a) / o.a * 100, 4) AS value_average_change FROM h JOIN h o ON o.bucket = h.bucket - {DAY}",
    "tile_series": f"WITH {E}, c AS (SELECT event_type, ds, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, array_to_string(list(ds ORDER BY ds), ',') AS ds, array_to_string(list(n ORDER BY ds), ',') AS n FROM c GROUP BY 1",
    "compare_metrics": f"WITH {E}, {SHAKEN} SELECT {', '.join([*compared('value', True), *compared('event_type', False)])} FROM e l FULL JOIN s r ON l.event_id = r.event_id",
    "consistency_check": f"WITH {E}, {SHAKEN} SELECT {', '.join(compared('value', True))} FROM s l FULL JOIN e r ON l.event_id = r.event_id",
    "side_by_side_diff": f"WITH {E}, {SHAKEN} SELECT coalesce(l.event_id, r.event_id) AS event_id, round(l.value, 6) AS a_value, round(r.value, 6) AS b_value, l.event_type AS a_event_type, r.event_type AS b_event_type FROM e l FULL JOIN s r ON l.event_id = r.event_id WHERE r.event_id IS NULL OR l.event_type IS DISTINCT FROM r.event_type OR NOT coalesce(abs(l.value - r.value) <= 1e-5, l.value IS NULL AND r.value IS NULL)",
    "skew_keys": "SELECT user_id, count(*) AS rows FROM checkouts WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 0.02 * (SELECT count(user_id) FROM checkouts)",
    "timestamp_checks": f"SELECT count(*) AS rows, {count_if('ts IS NULL')} AS null_ts, {count_if('ts < 31536000000 OR ts > 4102473599999')} AS bad_ts FROM checkouts",
    "edit_distances": f"""WITH {E}, per AS (SELECT user_id, day, ds, list(event_type ORDER BY ts, event_type) AS x FROM e GROUP BY 1, 2, 3),
        pair AS (SELECT a.user_id, a.ds, a.x, b.x AS y FROM per a JOIN per b ON a.user_id = b.user_id AND b.day = a.day + 1),
        runs AS (SELECT user_id, ds, x, y, list_reduce(x, lambda p, v: list_transform(range(1, len(y) + 2), lambda j: greatest(p[j], coalesce(list_max(list_transform(range(1, j), lambda i: CASE WHEN y[i] = v THEN p[i] + 1 ELSE 0 END)), 0))), list_transform(range(0, len(y) + 1), lambda i: i * 0)) AS r FROM pair)
        SELECT user_id, ds, len(x) - r[len(y) + 1] AS insert, len(y) - r[len(y) + 1] AS delete FROM runs""",
    "scalar_functions": f"""WITH {E} SELECT event_id, round(value + 6, 6) AS added, event_id % 7 AS modulo, round(abs(10 - value), 6) AS distance, CAST(trunc(value) AS INTEGER) AS whole, concat_ws('-', event_type, CAST(user_id AS VARCHAR)) AS joined, ascii(event_type) AS first_code,
        regexp_extract(props, '([0-9]+)', 1) AS number_text, CAST(length(props) AS INTEGER) AS size, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level, coalesce(nullif(event_type, 'view'), 'none') AS kind, CASE WHEN value < 10 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END AS grade,
        event_type IS NULL AS unknown, json_extract_string(props, '$.k') AS k, event_type AS same, CAST(dayofweek(make_timestamp(ts * 1000)) + 1 AS INTEGER) AS weekday, CAST(day(make_timestamp(ts * 1000)) AS INTEGER) AS day_of_month,
        strftime(date_trunc('hour', make_timestamp(ts * 1000)), '%Y-%m-%d %H') AS hour, strftime(CAST(ds AS DATE) + INTERVAL 3 DAY, '%Y-%m-%d') AS later, 60 AS folded, 1 + user_id AS least, 2 AS entries, user_id AS looked_up FROM e""",
    "generators": "SELECT event_id, event_type AS word, 1 AS side FROM events UNION ALL SELECT event_id, reverse(event_type), 2 FROM events",
    "set_functions": "WITH k AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_append(kinds, 'extra')), ',') AS added, CAST(list_has_any(kinds, ['purchase', 'error']) AS INTEGER) AS any_of FROM k",
    "stream_tiles": f"WITH {E} SELECT user_id, (ts // {HOUR}) * {HOUR} AS tile_start, round(sum(value), 6) AS value_sum, nullif(count(value), 0) AS value_count, round(max(value), 6) AS value_max FROM e GROUP BY 1, 2",
    "stream_cdc_tiles": f"WITH {E} SELECT user_id, (ts // {HOUR}) * {HOUR} AS tile_start, round(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE value END), 6) AS value_sum, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS value_count FROM e GROUP BY 1, 2",
    "stream_enriched": "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'",
    "stream_chained_tiles": f"WITH {E} SELECT c_mktsegment, (ts // {DAY}) * {DAY} AS tile_start, round(sum(value), 6) AS value_sum, nullif(count(value), 0) AS value_count FROM e LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' GROUP BY 1, 2",
    "stream_late_tiles": f"WITH {E}, {LATE} SELECT user_id, start AS tile_start, round(sum(value), 6) AS value_sum, nullif(count(value), 0) AS value_count, start + {HOUR} <= any_value(closed) AS complete FROM x WHERE NOT late GROUP BY 1, 2",
    "stream_late_rows": f"WITH {E}, {LATE} SELECT event_id, user_id FROM x WHERE late",
    "model_transform_batch": "SELECT event_id, round((value / 10 * 0.5 + length(event_type)) * 2, 6) AS score, CAST(value / 10 * 0.5 + length(event_type) > 5 AS INTEGER) AS high FROM events",
}

SQL["lookups_merged"] = SQL["lambda_merge_live"]
