"""Every query with SQL against DuckDB on the small tables, and independence of partitioning."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from quaylark.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows_of(df):
    names = sorted(df.columns)
    return sorted(str([plain(r[c]) for c in names]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_is_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    assert rows_of(df) == sorted(str([plain(r[i]) for i in order]) for r in got.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() == 6
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["joint_beam_decode", "code_bijection", "exact_dedupe_keeper", "curve_onset", "noise_pool_draws"])
def test_partitioning_does_not_matter(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = rows_of(catalogue.QUERIES[name](spark, sf_dir))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
