"""Tables far larger than what they come from are made by as many tasks as they fill."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewall.operators import series
from tidewall.plans.catalogue import QUERIES
from tidewall.plans.standins import oracle, standin
from tidewall.sources.shared import ROWS_A_TASK


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.fixture(scope="module")
def cells(tmp_path_factory):
    """400 cells of 2404 days; orders of some days, of one before the first, of the last, of none, and of a null customer and day."""
    d = str(tmp_path_factory.mktemp("cells"))
    duckdb.sql(f"copy (select i as c_custkey from range(24000) t(i)) to '{d}/customer.parquet'")
    days = "case when i % 97 = 0 then null when i % 89 = 0 then timestamp '1994-12-31' when i % 83 = 0 then timestamp '2001-07-31' else timestamp '1995-01-01' + to_days(cast(i * 7 % 2403 as int)) end"
    duckdb.sql(f"copy (select i as o_orderkey, case when i % 101 <> 0 then i * 31 % 12000 end as o_custkey, case when i % 79 <> 0 then i / 8 end as o_totalprice, {days} as o_orderdate from range(5000) t(i)) to '{d}/orders.parquet'")
    return d


def test_daily_series_are_dealt_by_their_own_rows(spark, cells):
    rain = standin(spark, cells, "si_rain")
    assert rain.count() == 400 * 2404
    assert most_in_a_task(rain) < 1.5 * ROWS_A_TASK < 400 * 2404
    for table in (rain, QUERIES["load_daily"](spark, cells), series.series_gaps(rain.filter("i <> 5"))):
        assert most_in_a_task(table) < 1.5 * ROWS_A_TASK


def test_daily_series_equal_their_sql(spark, cells):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{cells}/{t}.parquet'")
    want = con.execute(oracle("si_rain") + " select cell_id, cast(date as varchar), value, i from si_rain where value <> 0 or cell_id in (0, 399) order by 1, 4").fetchall()
    got = standin(spark, cells, "si_rain").filter("value <> 0 or cell_id in (0, 399)").select("cell_id", F.col("date").cast("string"), "value", "i").orderBy("cell_id", "i").collect()
    assert len(want) > 2404 * 2 + 1000 and [tuple(r) for r in got] == want


def test_stations_are_dealt_by_their_own_rows(spark, tmp_path):
    duckdb.sql(f"copy (select i as c_custkey, 1 as c_nationkey, 1.0::double as c_acctbal, 'm' as c_mktsegment from range(20000) t(i)) to '{tmp_path}/customer.parquet'")
    df = QUERIES["stations"](spark, str(tmp_path))
    assert df.count() == 20000 * 42
    assert most_in_a_task(df) < 1.5 * ROWS_A_TASK < 20000 * 42


def test_events_are_dealt_by_their_own_rows(spark, tmp_path):
    """Twice over, as many items as one task may hold make two tasks, whatever they weigh."""
    duckdb.sql(f"copy (select i as o_orderkey, i % 5000 as o_custkey, timestamp '1996-01-01' as o_orderdate, '1-U' as o_orderpriority, 1.0::double as o_totalprice, 'O' as o_orderstatus from range(50000) t(i)) to '{tmp_path}/orders.parquet'")
    duckdb.sql(f"copy (select i % 50000 as l_orderkey, i // 50000 as l_partkey, 1 as l_suppkey, 1 as l_linenumber, 2.0::double as l_extendedprice, 'A' as l_returnflag, 'O' as l_linestatus, timestamp '1995-06-01' as l_shipdate from range({2 * ROWS_A_TASK}) t(i)) to '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"copy (select i as c_custkey, 1 as c_nationkey, 1.0::double as c_acctbal, 'm' as c_mktsegment from range(5000) t(i)) to '{tmp_path}/customer.parquet'")
    events = standin(spark, str(tmp_path), "si_event")
    assert events.count() == 2 * ROWS_A_TASK and most_in_a_task(events) < 1.2 * ROWS_A_TASK
    assert "hashpartitioning(o_custkey" in events._jdf.queryExecution().executedPlan().toString()
    assert most_in_a_task(QUERIES["lookback_events"](spark, str(tmp_path))) < 1.2 * ROWS_A_TASK
