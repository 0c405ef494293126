"""Session builder and table loader."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer.

    ``master`` is set only when given, so that spark-submit decides on a
    cluster. Shuffle partitions are left to the cluster (adaptive execution
    coalesces them) unless SILTSTONE_SHUFFLE_PARTITIONS says otherwise.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if n := os.environ.get("SILTSTONE_SHUFFLE_PARTITIONS"):
        settings["spark.sql.shuffle.partitions"] = n
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """A table of fewer files than cores, dealt to as many tasks as it has ``least`` bytes.

    A file of one row group is one task, however large the cluster. Tables of
    more files are returned as they are, so nothing large is shuffled.
    """
    spark = df.sparkSession
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    tasks = min(cores, size // least)
    return df.repartition(tasks) if tasks > len(files) else df


_own: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, which readers beside Spark need: Spark takes that of fs.defaultFS."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session in one process (tests) may go without that setting; it gets
    a folder of its own, removed at exit.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return qualified(spark, root)
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siltstone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read again: what follows sees one and the same result."""
    path = f"{shared_root(df.sparkSession)}/siltstone/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
