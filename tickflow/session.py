"""Session helpers: the settings every job relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library needs on any session it is handed: UTC for timestamp text and
# for the date helpers, AQE for runtime re-planning (partition coalescing, skew joins,
# broadcast decisions made on measured sizes).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume. Idempotent."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tickflow") -> SparkSession:
    """Local session for tests and the bench. Clusters build their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Without that setting only a local session
    (tests) gets a fresh folder; on a cluster a guessed path would be another disk on each host.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="tickflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def per_session(fn):
    """Memoise a ``(spark, sf_dir, *args) -> DataFrame`` builder per Spark application.

    A DataFrame is an immutable plan: handing the same object to several queries skips only the
    Python-side construction and analysis, every action still runs the whole plan."""
    cache: dict = {}

    def wrapper(spark, sf_dir, *args, **kwargs):
        prepare(spark)
        key = (spark.sparkContext.applicationId, sf_dir, args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = fn(spark, sf_dir, *args, **kwargs)
        return cache[key]

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    wrapper.__wrapped__ = fn
    return wrapper


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``tickflow`` importable in the Python workers (needed by the pandas-backed streaming
    operator): the driver zips the package and hands it out with ``addPyFile``, once per
    application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the file itself, so a folder of its own is the right place; kept until exit
    folder = tempfile.TemporaryDirectory(prefix="tickflow-py-")
    archive = shutil.make_archive(os.path.join(folder.name, "tickflow"), "zip", root_dir=os.path.dirname(pkg_dir), base_dir="tickflow")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED[app] = folder
