"""Sinks: partitioned exports, replaced partitions, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, by: list[str]) -> None:
    """Zstd Parquet under one folder for each value of ``by``."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Delete-and-reload of the partitions that ``df`` has rows for; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def manifest(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Rows, files and bytes of each partition of an export, from the files themselves."""
    rows = spark.read.parquet(path).select(*by, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
    return rows.groupBy(*by, "f", "b").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("b").alias("bytes"))


def lookup_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV map with a header, read by an explicit schema."""
    return spark.read.schema(columns).option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, by: list[str], out: str) -> None:
    """The manifest of an export as one JSON file: a row for each partition."""
    manifest(spark, path, by).coalesce(1).write.mode("overwrite").json(out)


def append_arrow(spark: SparkSession, rows, path: str) -> None:
    """Append an Arrow table to the Parquet table at ``path``; columns take the order of what is there."""
    spark.createDataFrame(rows).write.mode("append").parquet(path)
