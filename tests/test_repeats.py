"""Queries on tables larger ones resemble: prices that repeat within a race, entries without a race."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import oracle_check
from conftest import SMALL

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def repeats(tmp_path_factory):
    """The small tables; in some races a price comes twice, once with all the rest, and some races have no date."""
    out = tmp_path_factory.mktemp("repeats")
    con = duckdb.connect()
    con.execute(f"""
        CREATE TABLE l AS SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice) AS rn,
                                 count(*) OVER (PARTITION BY l_orderkey) AS n
        FROM '{SMALL}/lineitem.parquet'""")
    con.execute(f"""
        COPY (SELECT * EXCLUDE (rn, n) FROM l
              UNION ALL SELECT * EXCLUDE (rn, n) REPLACE (l_quantity + 0.25 AS l_quantity, l_partkey + 1 AS l_partkey)
              FROM l WHERE rn = 1 AND n > 2 AND l_orderkey % 3 = 0
              UNION ALL SELECT * EXCLUDE (rn, n) FROM l WHERE rn = 1 AND n > 2 AND l_orderkey % 3 = 1
              UNION ALL SELECT * EXCLUDE (rn, n) REPLACE (l_orderkey + 1000000 AS l_orderkey)
              FROM l WHERE l_orderkey < 40) TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"COPY (SELECT * FROM '{SMALL}/orders.parquet') TO '{out}/orders.parquet' (FORMAT parquet)")
    return str(out)


def test_align_keeps_entries_that_share_a_price(spark, repeats):
    con = oracle_check.connect(repeats)
    got, want = QUERIES["align"](spark, repeats).toPandas(), con.execute(ORACLE["align"]).df()
    assert want.duplicated(["race_id", "price"]).sum() > 500
    assert oracle_check.difference(got, want) is None


def test_history_in_windows_equals_history_by_days(spark):
    """Missing runners and dates, several starts on a date, results and quantities that are missing."""
    from pyspark.sql import functions as F

    from furlong.operators import history

    n = F.col("id")
    rows = spark.range(3000).select(
        n.alias("entry"),
        F.when(n % 17 != 0, (F.xxhash64(n) % 60).cast("string")).alias("hrNo"),
        F.when(n % 13 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.pmod(F.xxhash64(n, F.lit(1)), F.lit(25))).cast("int"))).alias("race_date"),
        F.pmod(F.xxhash64(n, F.lit(2)), F.lit(9)).alias("finish"),
        F.when(n % 7 != 0, F.pmod(F.xxhash64(n, F.lit(3)), F.lit(50)).cast("double")).alias("qty"),
    )
    for default in (None, 25.5):
        got = [
            history.with_history(rows, qty="qty", default=default, hot=hot, parts=parts)
            for hot, parts in (((), 3), ((), None), (history_all_hot(), None))
        ]
        want = history.start_days(rows, total="qty")
        want = history.prior_starts(history.rest_days(history.previous_result(want)))
        want = history.prior_mean(want, "total", name="prior_qty", default=default)
        want = history.attach_history(rows, want, ["prev_result", "rest_days", "prior_starts", "prior_qty"])
        want = sorted(want.select(sorted(want.columns)).collect(), key=lambda r: r["entry"])
        for g in got:
            assert sorted(g.select(sorted(g.columns)).collect(), key=lambda r: r["entry"]) == want


def history_all_hot():
    from furlong.scale.skew import ALL_HOT

    return ALL_HOT
