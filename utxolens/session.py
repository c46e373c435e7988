"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from spark-submit; library code never builds
one. Only ``checkpoint_dir`` is used by operators, and it reads the cluster
setting first.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "utxolens") -> SparkSession:
    """A local session configured like the cluster defaults we rely on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled",
                os.environ.get("UTXOLENS_COALESCE_PARTITIONS", "true"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("UTXOLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.codegen.hugeMethodLimit",
                os.environ.get("UTXOLENS_HUGE_METHOD_LIMIT", "65535"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster has to name a folder that the driver and all executors share;
    only a local session without the setting gets a fresh scratch folder.
    """
    path = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None))
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting itself cannot be changed in a running session
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="utxolens-ckpt-")
        path = _SCRATCH[app]
    spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: dict[str, str] = {}        # of local sessions without the setting


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``utxolens`` importable in Python workers (idempotent).

    UDFs defined here are pickled by reference, so executors must be able
    to import the package. This zips it and registers the zip with
    ``addPyFile`` — what ``spark-submit --py-files`` does — unless the
    session already ships it.
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:                # Spark Connect: ship with addArtifacts instead
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if "utxolens" in sc.getConf().get("spark.submit.pyFiles", ""):
        _SHIPPED.add(key)            # spark-submit --py-files already ships it
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="utxolens-pyfiles-")
    zpath = os.path.join(out_dir, "utxolens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        root = os.path.dirname(pkg_dir)
        for d, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def materialize(spark: SparkSession, df, name: str, fmt: str = "parquet"):
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the written files instead of
    recomputing the upstream stages) and lets later steps scan a columnar
    table with pruning. The folder comes from ``spark.checkpoint.dir``.
    """
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/utxolens/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
