"""Every registered query runs on the smallest tables and agrees with its SQL where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(SQL) <= set(QUERIES)


def rows_of(con, sql):
    return con.execute(sql).fetchone()[0]


def whole(rows, con):
    """One row per document, whose contributions add up to its distance."""
    parts = [c for c in rows[0].asDict() if c.startswith("from_")]
    assert len(rows) == rows_of(con, "SELECT count(*) FROM documents")
    assert all(abs(sum(r[c] for c in parts) - r.distance) < 0.01 * (1 + len(parts)) for r in rows if r.distance is not None)
    assert all(r.word_count == 0 for r in rows if r.distance is None)


#: What must hold of the rows of queries that SQL does not express.
HOLDS = {
    "p5_top": lambda rows, con: len(rows) == 100 and all(r.low <= r.high and 0 < r.low <= r.rows for r in rows),
    "p8_packing": lambda rows, con: len({(r.container_kind, r.doc_id) for r in rows}) == 3 * rows_of(con, "SELECT count(*) FROM documents"),
    "p8_fill": lambda rows, con: len(rows) == 3 and all(r.at_least <= r.containers <= 1.02 * r.at_least + 2 and r.fill <= 1 for r in rows),
    "p10_found": lambda rows, con: 0.1 < len(rows) / rows_of(con, "SELECT count(*) FROM documents") < 0.5,
    "p10_statistics": lambda rows, con: whole(rows, con) is None,
    "gb_approx_unique_count": lambda rows, con: len(rows) == rows_of(con, "SELECT count(DISTINCT user_id) FROM events"),
    "gb_approx_percentile": lambda rows, con: len(rows) == rows_of(con, "SELECT count(DISTINCT user_id) FROM events"),
    "enhanced_stats_percentiles": lambda rows, con: len(rows) == rows_of(con, "SELECT count(DISTINCT CAST(ts AS DATE)) FROM events"),
    "drift_percentiles": lambda rows, con: len(rows) > 0,
    "drift_sketches": lambda rows, con: len(rows) == 1,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, tiny, name):
    if name in SQL:
        same_columns, ours, theirs, _ = differences(spark, con, QUERIES[name], SQL[name], tiny)
        assert same_columns and not ours and not theirs
    else:
        assert HOLDS[name](QUERIES[name](spark, tiny).collect(), con)
