
from pyspark.sql import functions as F

import __spark_entry__ as E
from utxolens.plans.queries import QUERIES as LIBRARY
from tests.conftest import SF_SMALL
from utxolens.operators import utxo
from utxolens.sources import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_is_hash_aggregate_without_python(spark):
    p = _plan(utxo.unspent_keys(fx.elements(spark, SF_SMALL), "amount"))
    assert "HashAggregate" in p and "SortAggregate" not in p
    assert "Python" not in p


def test_top_k_plans(spark):
    q = E.queries()
    for name in ["top_unspent", "top_unspent_with_script", "blocks_fewest_tx", "largest_blocks",
                 "top_addresses", "blocks_without_opcodes"]:
        p = _plan(q[name](spark, SF_SMALL))
        assert "TakeOrderedAndProject" in p, name


def test_top_unspent_has_no_python_and_broadcasts_bounded_side(spark):
    p = _plan(E.queries()["top_unspent"](spark, SF_SMALL))
    assert "Python" not in p
    assert "BroadcastExchange" in p


def test_filter_and_pruning_reach_scan(spark):
    el = fx.elements(spark, SF_SMALL).where(F.col("type") == 0).select("tx_hash", "idx")
    p = el._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p
    # the type = 0 filter prunes the outputs branch: one lineitem scan, and it
    # reads only the columns the inputs need
    assert p.count("FileScan parquet") == 1
    read_schema = p.split("ReadSchema: ")[1].split(">")[0]
    assert "l_extendedprice" not in read_schema and "l_orderkey" in read_schema


def test_block_rollups_have_partial_aggregation(spark):
    p = _plan(E.queries()["block_extremes_per_month"](spark, SF_SMALL))
    assert p.count("HashAggregate") >= 2


def test_large_k_does_not_force_broadcast(spark, monkeypatch):
    monkeypatch.setattr(utxo, "MAX_BROADCAST_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(utxo.top_unspent(fx.elements(spark, SF_SMALL), 100))
        assert "BroadcastHashJoin" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scale_rules_hold_for_every_query(spark):
    """No cross/nested-loop joins, no collected groups, no windows; every
    query scans the given parquet tables, or block files written from them."""
    for name, fn in LIBRARY.items():
        p = _plan(fn(spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "collect_list",
                    "collect_set", "Window"):
            assert bad not in p, (name, bad)
        assert "FileScan parquet" in p or "Scan parquet" in p or "BatchScan blockfile" in p, name


def test_address_queries_scan_once(spark):
    """Outputs and inputs are read once each (plus the fixture's orders), and no
    script moves: two exchanges of the fixture's join, one of the fold."""
    el = fx.elements(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, exchanges in ((utxo.output_addresses(el), 3), (utxo.top_addresses(el, 10), 3),
                              (utxo.address_balances(el), 4)):
            p = _plan(df)
            assert p.count("Exchange hashpartitioning") == exchanges
            assert p.count("FileScan parquet") == 3
            assert "SortAggregate" not in p and "BroadcastExchange" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recent_nested_blocks_prune_months(spark, tmp_path):
    from utxolens.operators import blocks

    day = 86400
    path = str(tmp_path / "blocks")
    (spark.createDataFrame([(f"b{d}", d * day) for d in range(0, 120, 10)], "block_hash string, t int")
     .withColumn("month", F.date_format(F.timestamp_seconds("t"), "yyyy-MM"))
     .write.partitionBy("month").parquet(path))
    b = spark.read.parquet(path)
    out = blocks.recent_blocks_nested(b, 30)
    assert sorted(r.t // day for r in out.collect()) == [90, 100, 110]
    filters = [x.split("], PushedFilters")[0] for x in _plan(out).split("PartitionFilters: [")[1:]]
    assert any("month" in x for x in filters)
    plain = b.drop("month")
    assert blocks.recent_blocks_nested(plain, 30).count() == 3


def test_scripts_are_parsed_once_and_let_filters_down(spark):
    from utxolens.operators import scriptstats as ss

    el = fx.elements(spark, SF_SMALL)

    def logical(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    inputs = logical(ss.script_chunks(el).where("type = 0"))
    assert inputs.count("Relation [") == 1 and inputs.count("ArrowEvalPython") == 1
    outputs = el.where("type = 1")
    for df in (ss.script_chunks(outputs), ss.script_flags(outputs), ss.script_pubkeys(outputs),
               ss.cltv_channels(el), ss.nonminimal_pushes(outputs), ss.block_script_structs(outputs)):
        assert logical(df).count("ArrowEvalPython") == 1
