"""Row-address top-k, Bloom-filtered semi-join, template codes through the fold."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from utxolens.functions import scripts as S
from utxolens.operators import blocks as B
from utxolens.operators import keyfilter, rowaddress, scriptstats, utxo
from utxolens.sources import fixtures as fx


@pytest.fixture(scope="module")
def stored(spark):
    """The elements of the small tables in 40 files, and how many they are."""
    path = os.path.join(tempfile.mkdtemp(prefix="utxolens-stored-"), "elements")
    fx.elements(spark, SF_SMALL).repartition(40).write.parquet(path)
    return spark.read.parquet(path), path


def leaves(df):
    """File scans of an executed plan, adaptive stages looked into."""
    df.collect()
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in name:
            open_.append(node.plan())
        else:
            kids = node.children()
            open_ += [kids.apply(i) for i in range(kids.size())]
            if name.startswith("Scan parquet"):
                found.append(node)
    return found


def files_read(df):
    return sum(n.metrics().get("numFiles").get().value() for n in leaves(df))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("with_script", [False, True])
@pytest.mark.parametrize("k", [3, 100])
def test_top_by_address_equals_the_join(spark, stored, with_script, k):
    df, _ = stored
    assert rowaddress.with_address(df) is not None
    got = utxo.top_unspent(df, k, with_script)
    want = utxo.top_unspent(fx.elements(spark, SF_SMALL), k, with_script)     # a view: no addresses
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert got.schema == want.schema
    hexed = df.withColumn("tx_hash", F.sha2("tx_hash", 256))                  # derived, still addressed
    assert rows(utxo.top_unspent(hexed, k, with_script, compact_keys=True)) \
        == rows(utxo.top_unspent(hexed.union(hexed.limit(0)), k, with_script))


def rows_of_tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_a_task_folds_a_bounded_number_of_rows(spark, stored, monkeypatch):
    """However many rows a split holds; the rows of an outpoint stay together."""
    df, _ = stored
    want = [tuple(r) for r in utxo.top_unspent(df, 50).collect()]
    most, folded, fold = max(rows_of_tasks(df)), [], utxo.unspent_keys
    monkeypatch.setattr(utxo, "FOLD_ROWS", most // 7, raising=False)
    monkeypatch.setattr(utxo, "unspent_keys", lambda e, *a, **k: folded.append(e) or fold(e, *a, **k))
    assert [tuple(r) for r in utxo.top_unspent(df, 50).collect()] == want
    assert max(rows_of_tasks(folded[0])) < most // 5
    assert folded[0].count() == df.count()
    placed = folded[0].withColumn("task", F.spark_partition_id())
    assert (placed.groupBy("tx_hash", "idx", "_file").agg(F.countDistinct("task").alias("n"))
            .where("n > 1").count() == 0)


def test_second_scan_opens_the_winners_files_only(spark, stored):
    df, _ = stored
    assert files_read(utxo.top_unspent(df, 3)) <= 3 < 40
    assert files_read(utxo.top_unspent(df, 100, with_script=True)) <= 40
    assert files_read(df.select("script")) == 40


def test_views_without_addresses_fall_back(spark, stored):
    df, path = stored
    view = fx.elements(spark, SF_SMALL)
    assert rowaddress.with_address(view) is None
    assert rowaddress.with_address(spark.createDataFrame([(1,)], "a int")) is None
    assert rowaddress.with_address(df.union(df)) is None
    empty = df.where("type = 7")
    assert utxo.top_unspent(empty, 5).count() == 0


def test_top_of_nested_blocks(spark):
    d = tempfile.mkdtemp(prefix="utxolens-nested-")
    blocks = [(f"b{i:02d}", 1000 + i, [(f"{i:064x}", [], [(i * 10 + j, bytes([i, j])) for j in range(3)]),
                                       (f"{i + 100:064x}", [(f"{i - 1:064x}", 2, b"s")] if i else [], [])])
              for i in range(30)]
    schema = ("block_hash string, t int, transactions array<struct<tx_hash:string,inputs:array<struct<"
              "prev_hash:string,prev_idx:bigint,script:binary>>,outputs:array<struct<value:bigint,script:binary>>>>")
    plain = spark.createDataFrame(blocks, schema)
    plain.repartition(15).write.parquet(os.path.join(d, "t"))
    stored = spark.read.parquet(os.path.join(d, "t"))
    for with_script in (False, True):
        got = utxo.top_unspent_nested(stored, 4, with_script)
        want = utxo.top_unspent(B.elements_from_blocks(plain), 4, with_script, compact_keys=True)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
        assert [tuple(r) for r in utxo.top_unspent_nested(plain, 4, with_script).collect()] \
            == [tuple(r) for r in want.collect()]
        assert files_read(got) <= 4
    assert utxo.top_unspent_nested(stored.where("t < 0"), 4).count() == 0


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("tx_hash"), F.col("id").alias("idx"))
    held = keyfilter.build(keys, utxo.KEY, 20_000)
    every = spark.range(0, 40_000).select(F.col("id").cast("string").alias("tx_hash"), F.col("id").alias("idx"))
    kept = {r.idx for r in every.where(held.test(*utxo.KEY)).collect()}
    assert set(range(0, 40_000, 2)) <= kept
    assert len(kept) - 20_000 <= 40                        # 0.2 % of the others
    assert held.size <= 20_000 * keyfilter.BITS_PER_KEY / 8 + keyfilter.BLOCK
    assert keyfilter.build(keys, utxo.KEY, 20_000, max_bytes=1000) is None
    none = keyfilter.build(keys.where("idx < 0"), utxo.KEY, 0)
    assert every.where(none.test(*utxo.KEY)).count() == 0


def test_blocks_of_hashes_agree_with_the_native_side(spark):
    h = np.array([-1, 0, 1, -2 ** 63, 2 ** 63 - 1, 12345, -98765], np.int64)
    for blocks in (1, 3, 977):
        byte, _ = keyfilter._places(h, blocks)
        assert (byte[:, 0] // keyfilter.BLOCK).tolist() == [int(v) % 2 ** 64 % blocks for v in h.tolist()]


@pytest.mark.parametrize("compact", [False, True])
def test_filtered_unspent_outputs_are_exact(spark, stored, compact):
    df, _ = stored
    if compact:
        df = df.withColumn("tx_hash", F.sha2("tx_hash", 256))
    want = rows(utxo.unspent_outputs(df, compact))
    assert rows(utxo.unspent_outputs(df, compact, strategy="filter")) == want
    keys = utxo.unspent_keys(df, compact_keys=compact)
    unbounded = utxo._filtered_unspent(df.where("type = 1"), keys, compact, max_bytes=10)
    assert rows(unbounded) == want


def test_payload_shuffle_is_about_the_survivors(spark, stored):
    df, _ = stored
    spent = df.where("type = 1").select(F.lit(0).alias("type"), "block_hash", "tx_idx", "tx_hash", "idx",
                                        F.lit(0).cast("bigint").alias("amount"), "script")
    most = df.union(spent.where(F.xxhash64("tx_hash") % 10 != 0))       # a tenth survives at most
    got = utxo.unspent_outputs(most, strategy="filter")
    survivors = got.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") > plan.index("LeftSemi")       # below the join, before its shuffle
    keys = utxo.unspent_keys(most)
    held = keyfilter.build(keys, utxo.KEY, survivors)
    moved = most.where("type = 1").where(held.test(*utxo.KEY)).count()
    assert survivors <= moved <= 1.05 * survivors
    assert moved < 0.3 * most.where("type = 1").count()


def test_template_codes_spell_the_parser_structure(spark):
    key = b"\x21\x02" + b"k" * 32
    scripts = [None, b"", b"\x6a\x01", b"\x76\xa9\x14" + b"h" * 20 + b"\x88\xac", b"\xa9\x14" + b"h" * 20 + b"\x87",
               key + b"\xac", b"\x00\x14" + b"h" * 20, b"\x51\x20" + b"h" * 32, b"\x03abc", b"\x00"]
    scripts += [bytes([0x50 + m]) + key * n + bytes([0x50 + k, 0xAE])
                for m in range(1, 17) for n, k in ((1, 1), (2, 3), (3, 16))]
    df = spark.createDataFrame([(s,) for s in scripts], "script binary")
    for r in df.select("script", S.template_code(F.col("script")).alias("c"),
                       S.template_structure(S.template_code(F.col("script"))).alias("t")).collect():
        assert r.c is not None
        assert r.t == S.structure(None if r.script is None else bytes(r.script)), r.script


def test_other_scripts_have_no_template(spark):
    df = spark.createDataFrame([(b"\x76\xa9\x4c",), (b"\x63\x51",)], "script binary")
    code = S.template_code(F.col("script"))
    assert [tuple(r) for r in df.select(code, S.template_structure(code)).collect()] == [(None, None)] * 2


def test_unspent_types_move_structures_not_scripts(spark, stored):
    df, _ = stored
    got = scriptstats.unspent_script_types(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = (utxo.unspent_outputs(df).select(S.script_structure(F.col("script")).alias("s"))
            .groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    assert rows(got) == rows(want)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 1
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "partial_max" in x]
    assert not any("script#" in x for x in moved), moved
