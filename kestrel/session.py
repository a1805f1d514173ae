"""Session construction and the few session-level helpers operators need."""

from __future__ import annotations

import atexit
import pathlib
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every kestrel job wants; a cluster submit may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "kestrel", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per application): functions that
    run in Python workers are found there wherever the job was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(spark.sparkContext._temp_dir, f"{root.name}.zip")  # goes with the context
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Where nothing is configured it is a folder in the session's
    warehouse, which the driver and all executors share too.
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    path = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_kestrel_checkpoints"
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as a parquet table in the shared
    checkpoint folder and read it back.

    One job (``Dataset.checkpoint`` runs the final stage twice: once to count,
    once to write). The folder is the cluster's ``spark.checkpoint.dir``, so
    the table survives executor loss; ``localCheckpoint`` would not. All
    tables of an application share a folder that goes when the driver exits.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path beside the materialized tables; it goes with them."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-tables/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the left keys stay."""
    if not keys:
        return left.crossJoin(right)  # two ungrouped aggregates: one row each
    renamed = right.select(*[F.col(k).alias(f"_ns_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_ns_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_ns_{k}" for k in keys])


def bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1).

    This is the size check placed in front of every explicit broadcast.
    """
    return df.limit(max_rows + 1).count() <= max_rows

