"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A temporary one only where nothing is set in local mode (tests);
    a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: computed once, safe when executors are lost.

    For small frames. The files go when the frame is no longer used, where spark.cleaner.referenceTracking.cleanCheckpoints
    is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared checkpoint folder; release() or the end of the program removes it."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_dir(spark).rstrip('/')}/corvane-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark, app)
    return _FOLDERS[app]


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table: far smaller than a checkpoint, and only the columns and row groups asked for are read."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, app: str | None = None) -> None:
    """Removes what stored() wrote for this application. Frames that read it can't be used any more."""
    folder = _FOLDERS.pop(app or spark.sparkContext.applicationId, None)
    if folder is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """Redistributes rows before CPU-heavy work only where the table arrives in fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
