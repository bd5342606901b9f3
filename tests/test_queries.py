"""Every registered query that has a DuckDB twin gives the same rows at the smallest scale."""

import math
import os

import duckdb
import pytest

from tributary import plans

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bool)) else round(float(v), 6)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", [n for n in plans.queries() if n in plans.oracle_sql() and n[:5] in ("q_a01", "q_a09", "q_j03", "q_g01", "q_g15", "q_w02", "q_t01", "q_c02", "q_c03", "q_m04", "q_p13", "q_k06", "q_l04")])
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q_j06_settlements", "q_r07_matched_stream"])
def test_settlements_beyond_a_million_authorisations(spark, tmp_path, name):
    db = duckdb.connect()
    # ten authorisations whose numbers differ in the seventh digit only, on one day
    db.sql(f"COPY (SELECT 2000000 + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts FROM range(20) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = plans.queries()[name](spark, str(tmp_path)), db.sql(plans.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["q_j06_settlements", "q_r07_matched_stream"])
@pytest.mark.parametrize("first", [5_000_000_000, 2**60])
def test_settlements_of_large_ids(spark, tmp_path, name, first):
    db = duckdb.connect()
    db.sql(f"COPY (SELECT {first} + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts FROM range(80) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = plans.queries()[name](spark, str(tmp_path)), db.sql(plans.oracle_sql()[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_matched_stream_rounds_seconds_as_sql(spark, tmp_path):
    db = duckdb.connect()
    # seconds of an authorisation and of its settlement: out of order within a second, about a day apart, halves
    pairs = [(10.6, 10.4), (10.4, 10.3), (10.6, 10.7), (0.4, 86400.6), (0.6, 86400.6), (0.6, 86401.4), (0.6, 86401.6), (10.5, 10.4), (11.5, 11.4), (10.5, 86410.5), (0.5, 86401.5)]
    rows = ", ".join(f"({2 * i + 2 + j}, {t})" for i, p in enumerate(pairs) for j, t in enumerate(p))
    db.sql(f"COPY (SELECT e.id::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_microseconds((e.t * 1000000)::BIGINT) AS ts FROM (VALUES {rows}) e(id, t)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = plans.queries()["q_r07_matched_stream"](spark, str(tmp_path)), db.sql(plans.oracle_sql()["q_r07_matched_stream"])
    assert 0 < len(want.fetchall()) < len(pairs)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
