"""Tables between the steps of long plans, in the folder that driver and executors share; numbers of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Without one: a temporary folder on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/pulsegrid/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage is cut, and lost executors take nothing with them."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a broadcast side may have; such sides are narrow.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise as it is, for a shuffled join. df should be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def clean_up(spark: SparkSession) -> None:
    """Removes all stored tables under the shared folder; no frame that was built on them can be read afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pulsegrid")
    path.getFileSystem(conf).delete(path, True)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Numbers all rows from 0 by order, without bringing them into one task: range partitions, a count of each, and the row's place in its own."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most n rows, one for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
