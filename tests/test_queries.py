"""Every query with SQL against DuckDB, on small tables of the driver's shape with ties, repeated values and empty corners."""

import datetime as dt
import random

import duckdb
import pytest

from statweave.plans import cluster_queries, source_queries  # noqa: F401  they register their queries
from statweave.plans.queries import ORACLES, QUERIES
from statweave.sources.storage import release, tables

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def made(rng):
    money, day = lambda: round(rng.uniform(-900, 9000), 2), lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randrange(900))
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(10)]
    return {
        "region": [(i, f"REGION {i}") for i in range(5)],
        "nation": [(i, f"NATION{i}" if i % 2 else f"NATION {i}", i % 5) for i in range(25)],
        "customer": [(i, f"Customer#{i}", rng.randrange(25), money(), rng.choice(["HOUSEHOLD", "MACHINERY"])) for i in range(150)],
        "supplier": [(i, f"Supplier#{i}", rng.randrange(25), money()) for i in range(60)],
        "part": [(i, f"small {i}", f"Brand#{i % 3}", "ECONOMY", rng.randrange(1, 50), 900 + i / 10) for i in range(120)],
        "orders": [(i, rng.randrange(150), rng.choice("OFP"), rng.uniform(900, 450_000), day(), f"{i % 5}-LOW") for i in range(700)],
        "lineitem": [(i // 3, i % 120, i % 60, i % 3, float(rng.randrange(1, 51)), rng.uniform(900, 90_000), rng.randrange(11) / 100, rng.randrange(9) / 100, "N", "O", day()) for i in range(900)],
        "events": [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), rng.randrange(50), rng.choice(["click", "view", "error"]), round(rng.expovariate(0.05), 2), "{}") for i in range(1000)],
        "embeddings": [(i, [c + rng.gauss(0, 0.3) for c in centers[i % 10]], i % 10) for i in range(120)],
    }


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path, con = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name, rows in made(random.Random(8)).items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return path, con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return repr(value.replace(tzinfo=None)) if isinstance(value, dt.datetime) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    path, con = data
    before = tables()
    df = QUERIES[name](spark, path)
    got = sorted([plain(r[c]) for c in sorted(df.columns)] for r in df.collect())
    release(before)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    at = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted([plain(r[i]) for i in at] for r in cursor.fetchall())
