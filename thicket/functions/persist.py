"""Cutting lineage in loops, and numbering rows without a single-task sort."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); on one machine, where it is unset, one of our own."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (place or f"/tmp/checkpoints/{spark.sparkContext.applicationId}").rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: a short plan, and files that outlive any executor. No mark of success
    is written: on a plain local disk the driver would start a chmod for it, which for a moment shares its memory."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_told(df: DataFrame, label: str, *aggregates: Column) -> tuple[DataFrame, dict]:
    """cut(), and these named aggregates over df's rows, taken in the same job as they are written."""
    told = Observation()
    out = cut(df.observe(told, *aggregates), label)
    return out, told.get


def sent(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df (as cut() gives it: counting it is cheap) with a hint to send it to all tasks if it has so few rows; else as it
    is, and Spark shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with name: 0, 1, 2, ... in the order given (which must tell all rows apart).

    Rows are dealt by ranges of the order; each range is numbered by itself and moved on by the rows in those before.
    Only the ranges' sizes, a row each, meet in one place.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")
