import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from pagelens.plans import catalogue, platform

ORACLES = catalogue.oracle_sql() | platform.oracle_sql()
QUERIES = catalogue.queries() | platform.queries()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_fetch_blocks_of_a_page_with_a_thousand_cards(spark, tmp_path):
    duckdb.sql("SELECT 1 + range AS p_partkey, 'new bolt' AS p_name, 'Brand#1' AS p_brand, 9.5::DOUBLE AS p_retailprice FROM range(1005)").write_parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet')")
    want = db.execute(ORACLES["fetch_blocks"]).fetchall()
    assert len(want) == 10 and sorted(map(tuple, QUERIES["fetch_blocks"](spark, str(tmp_path)).collect())) == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
