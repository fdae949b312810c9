"""SQL that states tail probabilities, at sizes that small tables don't reach."""

import math

import duckdb
import pytest

from trajecta.plans import behaviour as H
from trajecta.plans import subjects as S
from trajecta.plans.batteries import term_sql
from trajecta.plans.battery import Model


@pytest.mark.parametrize("z", [0.0, 0.5, -3.0, 7.9, -8.1, 23.9, -27.0, 37.0, 60.0, 1e4])
def test_normal_tail_of_any_size(z):
    found = duckdb.connect().execute(f"SELECT {H.normal_tail_sql(f'({z}::DOUBLE)')}").fetchone()[0]
    assert found == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-12)


@pytest.mark.parametrize("values", [[float(i) for i in range(1, 1001)], [1.0, 1.0, -1.0, 2.0, -3.0, 3.0, 3.0], [1.0, -1.0, 2.0, 2.0] * 15 + [5.0] * 9])
def test_signed_rank_sql_with_ties_and_many_subjects(spark, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE d AS SELECT unnest(?::DOUBLE[]) AS v", [values])
    want = con.execute(f"WITH RECURSIVE {H.SIGNED_RANK_TIES} SELECT n, w_plus, round(p, 9) FROM test").fetchone()
    got = S.signed_rank_test(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (got["n"], got["w_plus"]) == want[:2] and got["p"] == pytest.approx(want[2], abs=1e-8)


def test_battery_sql_at_a_large_z():
    """A term far from zero: p is 0, where a short series gave 1."""
    con = duckdb.connect()
    con.execute("CREATE TABLE rows_ AS SELECT i % 40 AS user_id, i % 400 AS block, (i * 7919 % 1009) / 1009.0 AS a, a + (i * 104729 % 997) / 997.0 AS y FROM range(20000) t(i)")
    p = con.execute(term_sql(Model(("one",), "y", ("a",)), "a", "'one' AS model")).fetchone()[4]
    assert p == 0
