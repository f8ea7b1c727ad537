"""Session helpers: durable checkpoints, table access, hot-key handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and all runs in one process (tests), a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="civlake-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed when the session's driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/civlake-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written, spark)
    _WRITTEN.add(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder; it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Remove a scratch table; a session that has ended has nothing left to remove it with."""
    if path in _WRITTEN and spark.sparkContext._jsc is not None:
        _WRITTEN.discard(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_written(spark: SparkSession) -> None:
    for path in list(_WRITTEN):
        try:
            release(spark, path)
        except Exception as e:  # the gateway may have ended before this process does
            print(f"scratch table {path} stays: {type(e).__name__}")
            return


def release_all(spark: SparkSession) -> None:
    """Remove all scratch tables; for long sessions, once the results made from them are written or no longer needed."""
    for path in list(_WRITTEN):
        release(spark, path)


def blank_to_null(c: Column) -> Column:
    t = F.btrim(c, F.lit(BLANKS))
    return F.when(t != "", t)


def pad_left(c: Column, width: int) -> Column:
    """Left-pad with zeros; a longer text stays whole (``lpad`` alone would cut it)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def hot_keys(df: DataFrame, key: str, least: int = 20_000) -> list:
    """Keys that hold more than a partition's fair share of the rows; there are fewer than twice as many as partitions."""
    n = partitions(df.sparkSession)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(2 * n).collect()
    fair = max(least, df.count() // (2 * n)) if top else least
    return [r[0] for r in top if r["count"] >= fair]


def salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` in which only hot keys of ``left`` are spread over ``salts`` tasks.

    ``right`` is repeated for the hot keys alone, so the extra rows are bounded by
    (hot keys) x (salts) x (rows of one key on the right).
    """
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    spread = F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")
    a = left.withColumn("__salt", F.when(is_hot, spread).otherwise(0))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], how).drop("__salt")
