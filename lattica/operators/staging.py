"""Writing intermediate tables where all executors read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(df_or_spark) -> str:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lattica.shared.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
        spark.conf.set("spark.lattica.shared.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: an end of lineage that outlives any executor."""
    at = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows that a task sorts or aggregates: so many fit its memory many times over.
ROWS_OF_TASK = 500_000


def spread(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df by keys in as many partitions as its rows ask for, whatever the session's number is and however it joins small ones. Unknown or few rows stay as they are."""
    if (rows or 0) <= ROWS_OF_TASK:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_TASK)), *keys)


def numbered(df: DataFrame, order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """df with a number from 0 on in the given order, without one task that sorts all: ranges are written, counted, and numbered each from where the one before ends."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = counts.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_before")
