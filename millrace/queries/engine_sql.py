"""Results of the queries around the computation, in SQL."""

from millrace.queries.features_sql import PURCHASES, SHIFTED, E


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


def list_text(rows: list[tuple]) -> list[str]:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ["(" + ", ".join(show(x) for x in r) + ")" for r in rows]


SQL = {
    "partitions_listed": "SELECT DISTINCT ds FROM users WHERE ds IS NOT NULL",
    "partitions_of_time": "WITH r AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events) SELECT strftime(day, '%Y-%m-%d') AS ds, day = b AS newest FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day, b FROM r)",
    "sink_overwrites_partitions": "SELECT user_id, email_verified, NULL::BIGINT AS seen, ds FROM users WHERE ds NOT BETWEEN '2024-02-01' AND '2024-02-29' UNION ALL SELECT DISTINCT user_id, email_verified, user_id % 7, ds FROM users WHERE ds BETWEEN '2024-02-01' AND '2024-02-29'",
    "exported_and_loaded": "SELECT 'events' AS source, event_type AS kind, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY 2 UNION ALL SELECT 'orders', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2",
    "formatted_partitions": "SELECT user_id, email_verified, ds FROM users WHERE user_id IS NOT NULL",
    "unfilled_steps": """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT day FROM d WHERE strftime(day, '%Y-%m-%d') NOT IN (SELECT ds FROM users WHERE ds IS NOT NULL)),
        g AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM h), s AS (SELECT day, run, (row_number() OVER (PARTITION BY run ORDER BY day) - 1) // 3 AS step FROM g)
        SELECT strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last FROM s GROUP BY run, step""",
    "pointers_and_topics": values("kind, text, name, rest", *list_text([
        ("pointer", "my_db.my_table", "my_db.my_table", ""), ("pointer", "s3+parquet://bucket/path", "s3://bucket/path", "parquet"), ("pointer", "file://folder/table.csv", "file://folder/table.csv", "csv"), ("pointer", "delta(versionAsOf=3)://lake/table", "lake/table", "delta"), ("pointer", "bigquery://project.set.table", "project.set.table", "bigquery"),
        ("topic", "kafka://events/host=h/port=9", "events", "kafka,host=h,port=9"), ("topic", "pubsub://views/project=p", "views", "pubsub,project=p"), ("topic", "clicks/serde=avro", "clicks", "kafka,serde=avro"), ("topic", "file://a//b/format=json", "a/b", "file,format=json"),
    ])),
    "footer_statistics": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls FROM {t}" for t, cs in (("users", ("ds", "user_id", "account_created_ds", "email_verified")), ("item_views", ("user_id", "item_id", "time_spent_ms", "ts", "ds"))) for c in cs),
    "sensors_ready": "SELECT * FROM (VALUES ('exists', true), ('missing', false), ('quarter', (SELECT count(DISTINCT ds) FILTER (WHERE ds BETWEEN '2024-01-01' AND '2024-03-31') = 91 FROM users)), ('time', (SELECT max(ts) >= TIMESTAMP '2024-01-30' FROM events)), ('later', (SELECT max(ts) >= TIMESTAMP '2024-06-30' FROM events)), ('trigger', (SELECT max(email_verified) = 1 OR bool_or(email_verified = 1) FROM users))) AS t(\"check\", ready)",
    "functions_of_users": f"WITH {E} SELECT user_id, ts, round(value * 2, 6) AS doubled, '2024-01-31' AS run FROM e WHERE ds BETWEEN '2024-01-01' AND '2024-01-31'",
    "derivations_over_columns": "SELECT event_id, user_id, round(CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE value / 2 END, 6) AS halved, round(value, 6) AS renamed FROM events",
    "derivations_renamed": "SELECT event_id, round(value, 6) AS value, event_type AS kind, round(value + 1, 6) AS more FROM events",
    "planned_steps": values("step, kind, inputs, again", *list_text([(0, "left", 1, False), (1, "bootstrap", 2, False), (2, "part", 2, True), (3, "part", 2, False), (4, "merge", 3, True), (5, "derive", 1, True)])),
    "recomputed_tables": values("edit, dropped", *list_text([("none", ""), ("left", "final,p1,p2"), ("part", "final,p2"), ("derivation", "final"), ("bootstrap", "final,p1,p2"), ("removed", "final,p1"), ("added", "final")])),
    "hashes_compared": values("compared, equal", *list_text([("other part", True), ("changed part", False), ("kept column", True), ("renamed key", False), ("whole", False), ("itself", True)])),
    "names_listed": values("kind, text, names", *list_text([("depends", "value_sum_1d / value_sum_7d", "value_sum_1d,value_sum_7d"), ("depends", "upper(event_type_last_7d)", "event_type_last_7d"), ("depends", "1 + 1", ""), ("depends", "value_sum_1", ""), ("keys", "user_id", "user_id"), ("keys", "buyer", "buyer")])),
    "dry_run_schema": values("column_name, type", *list_text([("event_id", "bigint"), ("user_id", "bigint"), ("ts", "bigint"), ("ds", "string"), ("ts_ds", "string"), ("daily_value_sum_1d", "double"), ("daily_value_sum_7d", "double"), ("kinds_event_type_last_7d", "string"), ("errors", "0"), ("errors without key", "2")])),
    "approx_unique_within": f"WITH {E} SELECT ds, count(DISTINCT event_id) AS n, true AS within FROM e GROUP BY ds",
    "approx_percentile_within": "SELECT DISTINCT event_type, true AS lower, true AS middle, true AS upper FROM events WHERE value IS NOT NULL",
    "sketch_drift_within": values("pair, near, stable", "('same', true, true)", "('far', false, false)"),
    "percentile_drift_within": values("series, near", "('calm', true)", "('jump', false)"),
    "entities_without_aggregation": "SELECT DISTINCT user_id, email_verified, ds FROM users WHERE user_id IS NOT NULL AND ds BETWEEN '2024-01-01' AND '2024-03-31'",
    "staging_backfilled": "SELECT ds, count(*) AS n, count(email_verified) AS known, false AS again, true AS steps FROM users WHERE ds BETWEEN '2024-01-01' AND '2024-03-31' GROUP BY ds",
    "join_run_in_steps": f"WITH {E}, {SHIFTED}, {PURCHASES} SELECT p.ts, p.event_id, p.user_id, p.ds, round(value_sum_7d, 6) AS daily_value_sum_7d, round(value_sum_1d, 6) AS daily_value_sum_1d, value_count_7d AS daily_value_count_7d, round(value_sum_7d / value_count_7d, 6) AS mean_7d FROM p LEFT JOIN shifted s ON s.user_id = p.user_id AND s.ts_ds = p.ts_ds",
    "reruns_of_a_join": "SELECT event_id, user_id, 1.0::DOUBLE AS daily_value_sum_1d, 2.0::DOUBLE AS daily_value_sum_7d FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'",
}
