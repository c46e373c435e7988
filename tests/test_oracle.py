"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from utxolens.plans.queries import QUERIES as LIBRARY
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

# the optional training-data queries have tests of their own
QUERIES = {k: v for k, v in E.queries().items() if k in LIBRARY}
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in LIBRARY}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert msg.startswith(("OK", "SPARK-ONLY")), msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["type", "block_hash", "tx_idx", "tx_hash", "idx", "amount"]
    assert df.count() == 100


def test_oracles_cover_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)          # every query has a DuckDB oracle


def test_pubkey_addresses_brute_force(spark):
    """The query without a DuckDB oracle, against plain Python on the same rows."""
    import hashlib

    from utxolens.functions.validate import b58encode, ripemd160

    rows = QUERIES["pubkey_addresses"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        key = bytes.fromhex(r.pubkey_hex)
        h = ripemd160(hashlib.sha256(key).digest())
        body = b"\x00" + h
        check = hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4]
        assert r.hash160 == h.hex() and r.address == b58encode(body + check)
    # every raw-key output of the fixture (class 3: '21 02<sha> ac') is present
    import duckdb
    n = duckdb.sql(f"""SELECT count(*) FROM read_parquet('{SF_SMALL}/lineitem.parquet')
                       WHERE l_suppkey % 8 = 3 AND l_linenumber <> 7""").fetchall()[0][0]
    assert len(rows) == n


def test_shell_sql_matches_operators(spark):
    """The shell transcript's SQL over registered views equals the operators."""
    from utxolens.operators import blocks as B
    from utxolens.sources import fixtures as fx
    from utxolens.sources.tables import register_views

    v = register_views(spark, SF_SMALL, prefix="t_")
    sql = spark.sql(f"SELECT YEAR(ts) AS year, COUNT(1) AS n_blocks FROM {v['blocks']} "
                    "GROUP BY YEAR(ts) ORDER BY year")
    op = B.blocks_per_year(fx.block_index(spark, SF_SMALL))
    assert [tuple(r) for r in sql.collect()] == [tuple(r) for r in op.collect()]
    sql2 = spark.sql(f"""SELECT YEAR(ts) AS year, MONTH(ts) AS month, COUNT(1) AS n_blocks
                         FROM (SELECT * from {v['blocks']} WHERE transactionCounter<10)
                         GROUP BY YEAR(ts), MONTH(ts) ORDER BY YEAR(ts), MONTH(ts)""")
    op2 = B.small_blocks_per_month(fx.block_index(spark, SF_SMALL), 10)
    assert [tuple(r) for r in sql2.collect()] == [tuple(r) for r in op2.collect()]
