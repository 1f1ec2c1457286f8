"""Question tables: selection; the shared folder of checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def select_best(items: DataFrame, by: str, n: int) -> DataFrame:
    """The best item of each concept first, then others by score: n for each corpus."""
    first = F.row_number().over(Window.partitionBy(by, "concept").orderBy(F.desc("score"), "item_id"))
    ranked = items.withColumn("_first", (first == 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_first"), F.desc("score"), "item_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= n).drop("_first")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A session on one machine, as in tests, may name none and gets one; a cluster has to."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by the columns over ranges of about equal size, so that a frequent value of the first column lies in several."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
