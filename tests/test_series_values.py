"""Series with values that the small tables don't have, against SQL."""

import duckdb

from levelforge import catalog


def test_noise_of_series_with_zeros(spark, tmp_path):
    path = tmp_path / "events.parquet"
    v = "CASE WHEN user_id = 3 THEN 0.0 WHEN user_id > 0 AND i = 3 + 17 * (user_id - 1) THEN 0.0 WHEN i % 4 = 0 THEN 260.0 ELSE 60.0 + i END"
    duckdb.sql(f"COPY (SELECT i + 40 * user_id AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, user_id, 'view' AS event_type, ({v})::DOUBLE AS value FROM range(40) a(i), range(4) u(user_id)) TO '{path}'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    expected = sorted(con.sql(catalog.oracle_sql()["noise_decision"]).fetchall())
    got = sorted(tuple(r) for r in catalog.queries()["noise_decision"](spark, str(tmp_path)).collect())
    assert str(got) == str(expected) and len({str(r[1:]) for r in got}) > 1
