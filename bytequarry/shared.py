"""Sessions, the folder that all executors share, Python workers' imports, and executors' heaps."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
REPO = str(Path(__file__).resolve().parents[1])
#: Python workers live on between stages. These settings of Arrow and the C library let them give freed memory back at
#: once, rather than hold the most that any stage took.
GIVE_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("bytequarry")
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    for k, v in (own | conf).items():
        build = build.config(k, v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout (installed packages don't need it), in batches
    of a few MB, and give freed memory back."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    for k, v in GIVE_BACK.items():
        env.setdefault(k, v)
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # as Spark comes: long texts would stand in a worker's memory several times over
        spark.conf.set(BATCH_BYTES, "8m")


def free_heaps(spark: SparkSession) -> None:
    """Executors' JVMs collect their garbage and give the heap that they don't need back to the system. A heap that one
    step has let grow otherwise keeps its size, beside the Python workers of all later steps.

    One task for each core, all of which start at once where cores are free, so every executor gets its own.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only on a single machine (a local master) and where nothing is set, a temporary folder is made and set; on a cluster
    executors would write to their own disks there, so that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = Path(tempfile.mkdtemp(prefix="bytequarry-")).as_uri()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores (small tables: one file, one row group) dealt out to all of them, each
    part in order; anything else as it is. So heavy work per row uses all cores, and large scans aren't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n).sortWithinPartitions(*df.columns)


def saved(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder, so that later steps neither recompute them nor need lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
