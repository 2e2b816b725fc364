"""Session plumbing shared by the operators: worker import path, Arrow batch size, cut lineage, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ARROW_BYTES = 8 << 20
BROADCAST_BYTES = 8 << 20
#: Estimated bytes up to which a table's rows are dealt out over all cores before heavy work on each row.
SPREAD_BYTES = 24 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers find this package and bound the bytes of an Arrow batch, unless the session already does."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    return spark


_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session in one JVM (tests) gets one of our own where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.checkpoint.dir", folder)
        sc.setCheckpointDir(folder)
    folder = folder.rstrip("/")
    if sc.master.split("[")[0] == "local" and "://" not in folder:
        os.makedirs(folder, exist_ok=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def local_path(path: str) -> str:
    """A path of the shared folder as numpy opens it: the folder has to be mounted."""
    return path.removeprefix("file://")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ravelin_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def discard(*dfs: DataFrame) -> None:
    """Delete the tables behind materialized DataFrames that nothing reads any more."""
    for df in dfs:
        _delete(df.sparkSession, df._ravelin_path)


@atexit.register
def _clean() -> None:
    """Tables that results read lazily live until the driver ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_written):
            _delete(spark, path)


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the DataFrames has, in any case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, column_bytes: str, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the summed bytes of an expression over df stay within limit."""
    return (df.agg(F.sum(F.expr(column_bytes)).alias("n")).first()["n"] or 0) <= limit


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """df with its rows dealt out over all cores, if Spark estimates it at no more than limit: a small file may be a single row group, which one
    task would work on alone. A larger table has more row groups than cores and is returned as it is, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if size <= limit and n > 1 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
