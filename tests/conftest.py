import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from furlong.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "furlong-tests")
    yield session
    session.stop()


@pytest.fixture
def all_hot(spark):
    """Treat keys of a hundred rows as hot, so that small tables have some."""
    spark.conf.set("furlong.skew.minRows", "100")
    yield
    spark.conf.unset("furlong.skew.minRows")


@pytest.fixture(scope="session")
def skewed_dir(tmp_path_factory):
    """The small tables with one race, one runner and one user holding a third each."""
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    con.execute(f"""
        CREATE TABLE l AS SELECT *, row_number() OVER (ORDER BY l_orderkey, l_extendedprice) AS rn
        FROM '{SMALL}/lineitem.parquet'""")
    # an early race, so that the later splits keep their races
    race = con.execute(
        f"SELECT o_orderkey FROM '{SMALL}/orders.parquet' ORDER BY o_orderdate, o_orderkey LIMIT 1"
    ).fetchone()[0]
    con.execute(f"""
        COPY (SELECT CASE WHEN rn % 3 = 0 THEN {race} ELSE l_orderkey END AS l_orderkey,
                     CASE WHEN rn % 3 = 1 THEN 11 ELSE l_partkey END AS l_partkey,
                     l_suppkey, l_linenumber, l_quantity,
                     CASE WHEN rn % 3 = 0 THEN 1000.0::DOUBLE + rn ELSE l_extendedprice END AS l_extendedprice,
                     l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
              FROM l) TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""
        COPY (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
                     event_type, value, props
              FROM '{SMALL}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)""")
    for name in ("orders", "customer", "nation", "region", "supplier", "part"):
        con.execute(
            f"COPY (SELECT * FROM '{SMALL}/{name}.parquet') TO '{out}/{name}.parquet' (FORMAT parquet)"
        )
    return str(out)
