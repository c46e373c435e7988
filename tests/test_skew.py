"""A single outpoint carrying a third of all rows (e.g. a shared null
outpoint): results stay exact and the fold keeps its partial step."""

from pyspark.sql import functions as F

from utxolens.operators import modes, utxo


def _skewed(spark, n=30_000):
    base = spark.range(0, n, numPartitions=12)
    hot = F.col("id") % 3 == 0
    return base.select(
        F.when(hot, F.lit(0)).otherwise(F.lit(1)).alias("type"),
        F.lit("blk").alias("block_hash"),
        F.lit(0).alias("tx_idx"),
        F.when(hot, F.lit("0" * 64)).otherwise(F.col("id").cast("string")).alias("tx_hash"),
        F.when(hot, F.lit(4294967295)).otherwise(F.lit(0)).cast("bigint").alias("idx"),
        F.col("id").alias("amount"),
        F.unhex(F.lit("76a914" + "11" * 20 + "88ac")).alias("script"),
    )


def test_hot_outpoint_fold_and_join(spark):
    el = _skewed(spark)
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
    try:
        u = utxo.unspent_outputs(el)
        assert u.count() == 20_000                     # every non-hot output is unspent
        st = {r.state: r.c for r in utxo.outpoint_state(el).groupBy("state")
              .agg(F.count(F.lit(1)).alias("c")).collect()}
        assert st == {1: 20_000, 2: 1}                 # the hot key is one matched outpoint
        top = utxo.top_unspent(el, 5).collect()
        assert [r.amount for r in top] == [29999, 29998, 29996, 29995, 29993]
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    plan = utxo.unspent_keys(el)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan                     # map-side combine before the shuffle


def test_hot_group_mode(spark):
    df = spark.range(0, 30_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
        (F.col("id") % 7).cast("int").alias("v"))
    got = {r.g: r["mode"] for r in modes.mode_max(df, "g", "v").collect()}
    from collections import Counter
    want = {}
    for g, keep in (("hot", lambda i: i % 3 == 0), ("cold", lambda i: i % 3 != 0)):
        c = Counter(i % 7 for i in range(30_000) if keep(i))
        want[g] = max(c, key=lambda v: (c[v], v))
    assert got == want


def test_compact_keys_match_string_keys(spark):
    import hashlib
    rows = []
    for i in range(400):
        h = hashlib.sha256(str(i % 150).encode()).hexdigest()
        rows.append((i % 3 % 2, "b", 0, h, i % 4, i, b"\x76\xa9\x14" + bytes(20) + b"\x88\xac"))
    el = spark.createDataFrame(rows, "type int, block_hash string, tx_idx int, tx_hash string, "
                                     "idx bigint, amount bigint, script binary")
    a = sorted(map(tuple, utxo.unspent_outputs(el).collect()))
    b = sorted(map(tuple, utxo.unspent_outputs(el, compact_keys=True).collect()))
    assert a == b and len(a) > 0
    assert (sorted(map(tuple, utxo.outpoint_state(el).collect()))
            == sorted(map(tuple, utxo.outpoint_state(el, True).collect())))
    assert ([tuple(r) for r in utxo.top_addresses(el, 7).collect()]
            == [tuple(r) for r in utxo.top_addresses(el, 7, compact_keys=True).collect()])
    plan = utxo.unspent_keys(el, compact_keys=True)._jdf.queryExecution().executedPlan().toString()
    assert "unhex(tx_hash" in plan


def test_single_pass_strategy_matches(spark):
    el = _skewed(spark, 3000)
    a = sorted(map(tuple, utxo.unspent_outputs(el).collect()))
    b = sorted(map(tuple, utxo.unspent_outputs(el, strategy="single_pass").collect()))
    assert a == b and len(a) == 2000
    assert utxo.unspent_outputs(el, strategy="single_pass").columns == el.columns
