"""Session settings and lineage cutting shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Row limits for groups that are allowed to sit in one task. Larger groups take a distributed path.
MAX_GROUP_ROWS = 4096


def tuned_builder(app_name: str = "seqloom") -> SparkSession.Builder:
    """A builder with the settings the operators are written for."""
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a new one in local mode if unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative operators write there")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_folder(spark: SparkSession) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors cost no replay."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to a table in the shared folder and read again: computed once, and lost executors cost no replay."""
    spark = df.sparkSession
    folder = new_folder(spark) if folder is None else folder
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder below the shared one, by the file system that holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_files_named(spark: SparkSession, staged: str, path: str, suffix: str) -> None:
    """Moves the one file of each ``<staged>/<column>=<name>`` to ``<path>/<name><suffix>`` and removes ``staged``."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = Path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(Path(f"{staged}/*=*/part-*")):
        source = found.getPath()
        target = Path(f"{path.rstrip('/')}/{source.getParent().getName().split('=', 1)[1]}{suffix}")
        if files.exists(target) or not files.rename(source, target):
            raise FileExistsError(f"cannot write {target.toString()}")
    files.delete(Path(staged), True)
