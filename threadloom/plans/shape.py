"""Plan shaping shared by the operators."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder() -> str:
    """One temporary folder for this process, deleted at its end."""
    folder = tempfile.mkdtemp(prefix="threadloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


def cut(df: DataFrame, afresh: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder is taken, in local mode
    only: on a cluster a machine-local folder would lose data with its machine, so there the setting is required.

    A checkpoint keeps the size that the planner guessed, the product of the sizes joined. In a loop that joins a table to itself the guess
    gets twice as many digits a round; ``afresh`` forgets it (and how the rows are partitioned)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    held = df.checkpoint(eager=True)
    if not afresh:
        return held
    try:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False), spark)
    except Exception:  # another build of Spark: the plan is the same, planning takes longer
        return held


def hot_keys(df: DataFrame, on: list[str], share: float = 0.01, least: int = 10_000) -> DataFrame:
    """The keys that hold at least ``share`` of all rows and at least ``least`` rows.

    There can be no more than 1/share of them whatever the data, which is the size bound for broadcasting them."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.where(F.col("_n") >= least).join(F.broadcast(total), F.col("_n") >= F.col("_all") * share).select(*on)


def hot_of(counts: DataFrame, on: list[str], n: str = "n", share: float = 0.01, least: int = 10_000) -> DataFrame:
    """The hot keys from counts that a plan has anyway; as few as those of ``hot_keys``."""
    total = counts.agg(F.sum(n).alias("_all"))
    return counts.where(F.col(n) >= least).join(F.broadcast(total), F.col(n) >= F.col("_all") * share).select(*on)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 24, share: float = 0.01, least: int = 10_000, hot: DataFrame | None = None) -> DataFrame:
    """Join ``left``, in which single keys may hold a large part of all rows, to ``right``, which has few rows a key.

    Rows of hot keys are spread over ``salts`` sub-keys on the left and repeated as often on the right; all other keys are
    joined as usual. ``how`` is ``inner`` or ``left``; null keys match nothing. Columns of the right other than ``on``
    must not clash with the left's."""
    hot = hot_keys(left, on, share, least) if hot is None else hot
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[c for c in left.columns]), F.lit(salts)).cast("int")
    many = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    few = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return many.join(few, [*on, "_salt"], how).drop("_salt")


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast of ``df`` only where counting shows that it has no more than ``most_rows`` rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
