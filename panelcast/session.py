"""Spark session defaults for panel work.

Cluster settings win: anything already set on the session (for example
``spark.checkpoint.dir`` on a cluster) is read and kept; local defaults are
only filled in where a setting is missing, as in tests.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_LOCAL = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def get_spark(master: str | None = None, app: str = "panelcast",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with panel defaults (UTC, AQE, Arrow) where the
    cluster's configuration does not set them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        for k, v in _LOCAL.items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if not given.contains(k) and k not in (extra or {}):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Uses ``spark.checkpoint.dir`` when the cluster names one. Only a local
    session (tests) without it gets a fresh scratch folder; on a cluster the
    setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: a machine-local scratch "
                           "folder would not survive the loss of an executor")
    local = tempfile.mkdtemp(prefix="panelcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package.

    A worker unpickles functions of ``panelcast`` by import, and the driver's
    ``sys.path`` does not travel. The sources go as one zip through
    ``addPyFile`` (served by the driver), once per application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_panelcast_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="panelcast-src-")), "panelcast.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._panelcast_shipped = True


class Spool(list):
    """Intermediate Parquet tables in the session's shared folder.

    ``put`` writes a frame once and reads it back: later branches stop
    re-reading the raw tables, keep column pruning and size statistics, and
    the lineage is cut, so a lost executor replays only the read. ``drop``
    deletes tables that nothing reads any more; whatever is left goes when the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/panelcast-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def put(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = f"{self.base}/{len(self)}"
        self.append(path)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep_last: int = 0) -> None:
        """Delete all tables but the last ``keep_last`` ones."""
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        for path in [p for p in self[:len(self) - keep_last] if p]:
            try:
                hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
            except Exception:           # the session is already gone
                return
            self[self.index(path)] = ""


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the session's shared folder and read it back."""
    return Spool(df.sparkSession).put(df)
