"""Session and checkpoint helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once a session, so that workers find it wherever they run."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="hanweave-")  # of the driver, which serves the file
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is long for its bytes, as decoding texts is.

    A table of fewer splits than cores, as of one small file, is dealt out to all cores; a
    larger one keeps its splits, without a shuffle.
    """
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def local_session(cpus: int = 8, memory: str = "16g", **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, within the session's spark.checkpoint.dir.

    Only a local session that names none gets a temporary one; on a cluster that would not be
    shared, so it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="hanweave-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that it is computed once and survives lost executors."""
    ship_package(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As `checkpointed`, as a compressed table by columns: for many rows of which later steps need some columns."""
    ship_package(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all that this session has written to the shared folder; results that were not yet consumed are lost."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
        files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            files.delete(status.getPath(), True)


#: Bytes of stored input that one task of a shuffle with a fixed number of tasks gets; a partition held otherwise counts as half of that.
TASK_BYTES = 1 << 27
MOST_TASKS = 50_000


def task_count(df: DataFrame) -> int:
    """Tasks for a shuffle whose number adaptive execution cannot change: by the bytes of the tables read, at least spark.sql.shuffle.partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        name = leaf.getClass().getSimpleName()
        if name == "LogicalRelation":
            size += int(leaf.stats().sizeInBytes())
        elif name == "LogicalRDD":
            size += leaf.rdd().getNumPartitions() * TASK_BYTES // 2
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, size // TASK_BYTES))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` with this package sent to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
