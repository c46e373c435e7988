"""Session helpers: checkpoint folder, materialise, package shipping."""

import os

from utxolens import session


def test_checkpoint_dir_comes_from_the_session(spark):
    path = session.checkpoint_dir(spark)
    # a local session without the setting keeps one scratch folder
    assert path and path == spark.conf.get("spark.checkpoint.dir", session.checkpoint_dir(spark))


def test_materialize_writes_under_checkpoint_dir(spark):
    df = spark.range(0, 1000, numPartitions=4).selectExpr("id", "id * 2 AS v")
    back = session.materialize(spark, df, "unit")
    assert back.count() == 1000 and back.agg({"v": "sum"}).first()[0] == 999000
    files = back.inputFiles()
    base = session.checkpoint_dir(spark).replace("file:", "").rstrip("/")
    assert files and all(base in f.replace("file:", "") for f in files)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()


def test_ship_package_is_idempotent(spark):
    before = spark.sparkContext._jsc.sc().listFiles().size()
    session.ship_package(spark)
    session.ship_package(spark)
    assert spark.sparkContext._jsc.sc().listFiles().size() == before
    assert os.path.isdir(os.path.dirname(session.__file__))
