"""Session helpers: configuration, shared folder, written tables, size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a side that `small` may hint for broadcast.
BROADCAST_ROWS = 500_000


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagemill")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, str] = {}
#: Folders of the tables that `written` gave.
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one set on the context.

    Only a local master may fall back to a temporary folder; a cluster without the setting
    is an error rather than data on one machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="pagemill-")
        sc.setCheckpointDir(_local[key])
        import atexit

        atexit.register(shutil.rmtree, _local[key], True)
    return _local[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files every executor reaches.

    Results may be read as long as the session lives, so the table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(gone)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = gone
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that neither a result nor a later step reads, so that they do not lie there till the end."""
    for t in tables:
        gone = _folders.pop(t)
        gone.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(gone, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if it holds at most `limit` rows (counted, early exit), else leave the join to shuffle.

    df should be a written table or a cheap plan: it is read once for the count.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def hash_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """About n rows of df, the same ones on every run: those whose hash of the columns is small; never more than 2 n.

    The share is set by a count, so a task passes on its part of the sample only, however many tasks there are.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int((1 << 40) * n / total)).limit(2 * n)
