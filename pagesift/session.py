"""Spark session helpers.

On a cluster the session is created by the platform; the library only reads
its settings.  ``local_session`` is for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SHIPPED: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagesift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Pages are small in bytes but heavy in CPU (regex, parsing): do not let
        # AQE merge post-shuffle partitions below a few hundred KB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Pages are large rows: keep Arrow batches to the Python parser small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.pagesift.parsePartitions", str(cores if str(cores).isdigit() else os.cpu_count()))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("PAGESIFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and we use it as given.  Only when
    the setting is absent (local tests) do we make a scratch folder of our own.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None
    )
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pagesift-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application.

    Workers start in folders of their own and need not see the checkout; Spark
    serves the archive to every executor, also to those that join later.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagesift-pkg-"), "pagesift_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED["app"] = sc.applicationId


def prepare(spark: SparkSession) -> str:
    """What every query needs before it plans: code on the workers, a shared folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
