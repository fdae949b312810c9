"""Labels by a mean that ties with the bound."""

from itertools import permutations

import duckdb

from trajecta.plans.registry import ORACLE_SQL, QUERIES


def test_a_mean_at_the_bound_does_not_depend_on_the_order(spark, tmp_path):
    values = (9.39, 2.83, 137.78)  # 150 in decimals; as doubles, some orders give more
    rows = [(u, float("nan") if u == 6 and i == 0 else v) for u, p in enumerate([*permutations(values), values]) for i, v in enumerate(p)]
    frame = spark.createDataFrame([(u, "view", v) for u, v in rows], "user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in QUERIES["consensus_labels"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(con.execute(ORACLE_SQL["consensus_labels"]).fetchall())
    assert {r[0]: r[2] for r in got if r[0] < 6} == {u: 0.0 for u in range(6)}
