"""The same results in SQL, written from the definitions, for the queries that plain SQL can express on whole tables."""

RETURNS = """
returns AS (
  SELECT regexp_replace(lower(return_id), '[^0-9a-f]', '', 'g') AS key, ds, ts, user_id, product_id, refund_amt,
         lower(trim(return_type)) AS type,
         CASE WHEN ts < 100000000000 THEN ts * 1000 WHEN ts > 100000000000000 THEN ts // 1000 ELSE ts END AS millis
  FROM checkouts),
newest AS (
  SELECT *, CAST(floor(millis / 86400000.0) AS INTEGER) AS day
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds DESC) AS rn FROM returns) WHERE rn = 1)
"""

DAY = "strftime(DATE '1970-01-01' + CAST({} AS INTEGER), '%Y-%m-%d')"

P1_CASES = f"""
WITH {RETURNS},
versions AS (
  SELECT 'checkouts' AS table_name, key AS record_key, ds, hash(ts, user_id, product_id, refund_amt, type) AS content FROM returns
  UNION ALL
  SELECT 'users', CAST(user_id AS VARCHAR), ds, hash(account_created_ds, email_verified) FROM users WHERE user_id IS NOT NULL),
done AS (
  SELECT DISTINCT v.table_name, v.ds FROM (SELECT DISTINCT table_name, ds FROM versions) v JOIN run_log l
  ON l.table_name = v.table_name AND l.run_status = 'success' AND l.ds_from <= v.ds AND v.ds <= l.ds_to),
marked AS (SELECT v.*, d.ds IS NOT NULL AS done FROM versions v LEFT JOIN done d ON d.table_name = v.table_name AND d.ds = v.ds),
states AS (
  SELECT table_name, record_key, arg_max(content, ds) AS cur, arg_max(done, ds) AS cur_done, bool_or(done) AS any_done,
         arg_max(content, ds) FILTER (WHERE done) AS saved
  FROM marked GROUP BY 1, 2),
cases AS (
  SELECT table_name, record_key, CASE WHEN any_done THEN 'changed' ELSE 'new' END AS change
  FROM states WHERE NOT cur_done AND (NOT any_done OR cur IS DISTINCT FROM saved))
"""

P2_DAILY = f"""
WITH {RETURNS},
v AS (
  SELECT DISTINCT key, date_diff('day', DATE '1970-01-01', CAST(ds AS DATE)) AS load_day, CAST(floor(millis / 86400000.0) AS INTEGER) AS period, refund_amt AS value
  FROM returns WHERE millis IS NOT NULL),
ok AS (SELECT * FROM v WHERE load_day - period <= 7),
loads AS (
  SELECT period, load_day AS as_of FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS rn FROM ok WINDOW w AS (PARTITION BY key ORDER BY load_day))
  WHERE rn = 1 OR value IS DISTINCT FROM before GROUP BY 1, 2),
seen AS (
  SELECT l.period, l.as_of, ok.value, row_number() OVER (PARTITION BY l.period, l.as_of, ok.key ORDER BY ok.load_day DESC) AS rn
  FROM ok JOIN loads l ON l.period = ok.period AND ok.load_day <= l.as_of)
SELECT {DAY.format("period")} AS event_ds, {DAY.format("as_of")} AS as_of_ds, count(*) AS records, CAST(coalesce(sum(value), 0) AS BIGINT) AS refund_total,
       median(value) AS refund_median, count(DISTINCT value) AS refund_distincts, min(value) AS refund_lowest, max(value) AS refund_highest
FROM seen WHERE rn = 1 GROUP BY period, as_of
"""

P3_DAYS = f"""
WITH {RETURNS},
own AS (SELECT user_id, day, coalesce(refund_amt, 0) AS amt FROM newest WHERE user_id >= 10 AND day IS NOT NULL AND day <= 19813),
daily AS (SELECT user_id, day, sum(amt) AS amt, count(*) AS n FROM own GROUP BY 1, 2),
days AS (SELECT user_id, unnest(range(min(day), 19814)) AS day FROM own GROUP BY 1),
filled AS (SELECT d.user_id, d.day, coalesce(y.amt, 0) AS amt, coalesce(y.n, 0) AS n FROM days d LEFT JOIN daily y USING (user_id, day)),
rolling AS (
  SELECT user_id, 7 AS window_days, day, sum(amt) OVER w AS total, sum(n) OVER w AS n FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING)
  UNION ALL
  SELECT user_id, 30, day, sum(amt) OVER w, sum(n) OVER w FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING))
"""

P4_PARTS = """
cells AS (
  SELECT 'checkouts' AS table_name, 'refund_amt' AS column_name, ds, CAST(refund_amt AS VARCHAR) AS value, NOT refund_amt BETWEEN 0 AND 10000 AS bad FROM checkouts
  UNION ALL
  SELECT 'users', 'account_created_ds', ds, account_created_ds, account_created_ds IS NOT NULL AND NOT (regexp_full_match(account_created_ds, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(account_created_ds AS DATE) IS NOT NULL) FROM users
  UNION ALL
  SELECT 'users', 'email_verified', ds, CAST(email_verified AS VARCHAR), email_verified NOT IN (0, 1) FROM users),
counts AS (SELECT table_name, column_name, ds, value, any_value(bad) AS bad, count(*) AS n FROM cells GROUP BY 1, 2, 3, 4),
meas AS (
  SELECT table_name, column_name, ds, sum(n) AS total, sum(n) FILTER (WHERE value IS NULL) AS nulls, sum(n) FILTER (WHERE bad) AS bad, max(n) FILTER (WHERE value IS NOT NULL) AS top
  FROM counts GROUP BY 1, 2, 3),
med AS (SELECT 'refund_amt' AS column_name, ds, median(refund_amt) AS med FROM checkouts GROUP BY ds),
m AS (
  SELECT table_name, meas.column_name, meas.ds, coalesce(nulls, 0) / total AS a, coalesce(bad, 0) / nullif(total - coalesce(nulls, 0), 0) AS b, top / nullif(total - coalesce(nulls, 0), 0) AS c, med AS d
  FROM meas LEFT JOIN med ON med.column_name = meas.column_name AND med.ds = meas.ds WHERE total >= 30),
mid AS (SELECT column_name, median(a) AS a, median(b) AS b, median(c) AS c, median(d) AS d FROM m GROUP BY 1)
"""


def _profile(table: str, columns: dict[str, str]) -> str:
    tests = {"refund_amt": "NOT refund_amt BETWEEN 0 AND 10000", "email_verified": "email_verified NOT IN (0, 1)", "account_created_ds": "account_created_ds IS NOT NULL AND NOT (regexp_full_match(account_created_ds, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(account_created_ds AS DATE) IS NOT NULL)"}
    parts = []
    for c, kind in columns.items():
        number = c == "refund_amt"
        low = f"CAST(min({c}) AS VARCHAR)" if number else f"min(CAST({c} AS VARCHAR))"
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, g.ds, rows, nulls, distincts, lowest, highest, invalid, top, median FROM "
            f"(SELECT ds, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distincts, {low} AS lowest, {low.replace('min(', 'max(')} AS highest, "
            f"count(*) FILTER (WHERE {tests.get(c, 'false')}) AS invalid, {'median(' + c + ')' if number else 'CAST(NULL AS DOUBLE)'} AS median FROM {table} GROUP BY ds) g "
            f"LEFT JOIN (SELECT ds, max(n) AS top FROM (SELECT ds, {c}, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY ds, {c}) GROUP BY ds) t ON t.ds = g.ds"
        )
    return " UNION ALL ".join(parts)


CHECKOUTS = dict.fromkeys(("ts", "return_id", "user_id", "product_id", "refund_amt", "return_type"), "")
USERS = dict.fromkeys(("user_id", "account_created_ds", "email_verified"), "")

P7 = f"""
WITH {RETURNS},
v AS (SELECT DISTINCT user_id, ds, date_diff('day', DATE '1970-01-01', CAST(ds AS DATE)) AS load_day, email_verified FROM users),
last AS (SELECT user_id, arg_max(struct_pack(e := email_verified), load_day).e AS newest FROM v GROUP BY 1),
r AS (SELECT n.key, n.user_id, n.day, l.newest FROM newest n LEFT JOIN last l ON l.user_id = n.user_id WHERE n.user_id >= 10),
best AS (
  SELECT r.key, any_value(r.day) AS day, any_value(r.newest) AS newest, max(v.load_day) AS load_day, arg_max(struct_pack(e := v.email_verified), v.load_day).e AS known
  FROM r LEFT JOIN v ON v.user_id = r.user_id AND v.load_day < r.day GROUP BY r.key)
"""

def stability(table: str, columns: tuple[str, ...]) -> str:
    """Index and chi-square of each load's cells: 20 common values, nulls, 64 ranges of numbers, 64 hash cells."""
    number = "coalesce(CASE WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(date_diff('day', DATE '1970-01-01', try_cast(value AS DATE)) AS DOUBLE) END, CASE WHEN regexp_full_match(value, '-?[0-9]+([.][0-9]+)?') THEN CAST(value AS DOUBLE) END)"
    return f"""SELECT * FROM (WITH cells AS ({' UNION ALL '.join(f"SELECT ds AS load, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns)}),
        counts AS (SELECT load, column_name, value, count(*) AS n FROM cells GROUP BY 1, 2, 3),
        overall AS (SELECT column_name, value, sum(n) AS n FROM counts GROUP BY 1, 2),
        tops AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM overall WHERE value IS NOT NULL QUALIFY r <= 20),
        numbers AS (SELECT DISTINCT column_name, {number} AS x FROM overall WHERE value IS NOT NULL AND {number} IS NOT NULL),
        ranks AS (SELECT column_name, x, row_number() OVER (PARTITION BY column_name ORDER BY x) AS k, count(*) OVER (PARTITION BY column_name) AS size FROM numbers),
        cuts AS (SELECT column_name, list(x) AS cuts FROM ranks WHERE k * 64 // size > (k - 1) * 64 // size AND k * 64 // size < 64 GROUP BY 1),
        marked AS (SELECT c.load, c.column_name, c.n, CASE WHEN c.value IS NULL THEN 0 WHEN t.r IS NOT NULL THEN t.r WHEN {number.replace('value', 'c.value')} IS NOT NULL THEN 21 + len(list_filter(coalesce(u.cuts, []), lambda x: x < {number.replace('value', 'c.value')})) ELSE 85 + CAST('0x' || substr(md5(c.value), 1, 8) AS BIGINT) % 64 END AS cell
            FROM counts c LEFT JOIN tops t ON t.column_name = c.column_name AND t.value = c.value LEFT JOIN cuts u ON u.column_name = c.column_name),
        by_load AS (SELECT load, column_name, cell, sum(n) AS n FROM marked GROUP BY 1, 2, 3), of_all AS (SELECT column_name, cell, sum(n) AS n FROM by_load GROUP BY 1, 2),
        loads AS (SELECT load, column_name, sum(n) AS n FROM by_load GROUP BY 1, 2), sizes AS (SELECT column_name, sum(n) AS n FROM of_all GROUP BY 1),
        shares AS (SELECT l.load, l.column_name, l.n AS load_n, greatest(coalesce(b.n, 0) / l.n, 1e-5) AS p, greatest(a.n / s.n, 1e-5) AS q, coalesce(b.n, 0) / l.n - a.n / s.n AS gap FROM loads l JOIN of_all a ON a.column_name = l.column_name JOIN sizes s ON s.column_name = l.column_name
            LEFT JOIN by_load b ON b.load IS NOT DISTINCT FROM l.load AND b.column_name = l.column_name AND b.cell = a.cell)
        SELECT '{table}' AS table_name, column_name, load AS ds, round(sum((p - q) * ln(p / q)), 6) AS psi, round(sum(load_n * gap * gap / q), 4) AS chi_square, count(*) AS cells FROM shares GROUP BY column_name, load)"""


SQL = {
    "p1_found": f"{P1_CASES} SELECT table_name, record_key FROM cases",
    "p1_changes": f"{P1_CASES} SELECT table_name, change, count(*) AS records FROM cases GROUP BY 1, 2",
    "p2_found": f"""WITH {RETURNS}, f AS (SELECT key, arg_min(millis, ds) AS millis, min(ds) AS ds FROM returns WHERE millis IS NOT NULL GROUP BY key),
        l AS (SELECT key, CAST(floor(millis / 86400000.0) AS INTEGER) AS day, date_diff('day', DATE '1970-01-01', CAST(ds AS DATE)) - CAST(floor(millis / 86400000.0) AS INTEGER) AS late FROM f)
        SELECT key AS return_id, {DAY.format("day")} AS event_ds, CASE WHEN late <= 7 THEN 'corrects' ELSE 'too_late' END AS verdict FROM l WHERE late > 0""",
    "p2_daily": P2_DAILY,
    "p3_found": f"""{P3_DAYS} SELECT user_id, window_days, {DAY.format("day")} AS ds FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id, window_days ORDER BY total DESC, day) AS rn FROM rolling) WHERE rn = 1""",
    "p3_rolling": f"""{P3_DAYS} SELECT user_id, window_days, {DAY.format("day")} AS ds, CAST(total AS BIGINT) AS refund_total, CAST(n AS BIGINT) AS returns,
        round(CASE WHEN n > 0 THEN total / n END, 6) AS refund_average FROM rolling""",
    "p4_found": f"""WITH {P4_PARTS} SELECT DISTINCT table_name, m.column_name, ds FROM m JOIN mid USING (column_name)
        WHERE abs(m.a - mid.a) > 0.25 OR abs(m.b - mid.b) > 0.25 OR abs(m.c - mid.c) > 0.25 OR m.d > 3 * mid.d OR m.d < mid.d / 3""",
    "p4_profile": f"{_profile('checkouts', CHECKOUTS)} UNION ALL {_profile('users', USERS)}",
    "p5_found": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS item_value FROM checkouts WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) * 200 > (SELECT count({c}) FROM checkouts)" for c in ("product_id", "user_id")
    ),
    "p6_found": f"""WITH {RETURNS}, r AS (SELECT user_id, type, count(*) AS n, max(millis) AS latest, sum(coalesce(refund_amt, 0)) AS total FROM newest
          WHERE user_id >= 10 AND millis IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2),
        ranked AS (
          SELECT user_id, 'count' AS feature, type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS rn FROM r
          UNION ALL SELECT user_id, 'recency', type, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, type) FROM r
          UNION ALL SELECT user_id, 'total', type, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, type) FROM r)
        SELECT user_id, feature, type AS return_type FROM ranked WHERE rn = 1""",
    "p4_stability": stability("checkouts", ("ts", "return_id", "user_id", "product_id", "refund_amt", "return_type")) + " UNION ALL " + stability("users", ("user_id", "account_created_ds", "email_verified")),
    "p5_bounds": "SELECT c.column_name, 50 AS items, true AS within, true AS none_missing FROM (VALUES ('product_id'), ('user_id')) AS c(column_name)",
    "p6_features": f"""WITH {RETURNS}, k AS (SELECT DISTINCT type FROM returns WHERE type IS NOT NULL),
        r AS (SELECT user_id, type, count(*) AS n, sum(coalesce(refund_amt, 0)) AS total, max(millis) AS latest FROM newest WHERE user_id >= 10 AND type IS NOT NULL AND millis IS NOT NULL GROUP BY 1, 2),
        f AS (SELECT u.user_id, regexp_replace(k.type, '[^a-zA-Z0-9_]+', '_', 'g') AS name, coalesce(r.n, 0) AS n, coalesce(r.total, 0) AS total, r.latest FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN k LEFT JOIN r ON r.user_id = u.user_id AND r.type = k.type),
        x AS (SELECT user_id, 'count_' || name AS f, CAST(n AS BIGINT) AS v FROM f UNION ALL SELECT user_id, 'total_' || name, CAST(total AS BIGINT) FROM f UNION ALL SELECT user_id, 'latest_' || name, latest FROM f)
        SELECT * FROM (PIVOT x ON f USING first(v) GROUP BY user_id)""",
    "p7_found": f"""{P7} SELECT key AS return_id, coalesce({DAY.format("load_day")}, 'none') AS known_ds FROM best WHERE day IS NOT NULL AND known IS DISTINCT FROM newest""",
    "p7_known": f"""{P7} SELECT key AS return_id, {DAY.format("load_day")} AS known_ds, known AS email_verified FROM best WHERE day IS NOT NULL""",
    "p7_returns": f"""{P7} SELECT key AS return_id, {DAY.format("load_day")} AS known_ds, known AS email_verified FROM best""",
}
