"""Ingestion of an index that was written as JSON documents, one per commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orefield.schemas import INDEX, RECORDS, check_symbols


def read_index(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The seven record tables of all documents under ``path``, with an explicit schema. A document that
    is no JSON fails the read; missing arrays are empty."""
    index = spark.read.schema(INDEX).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    tables = {}
    for name, schema in RECORDS.items():
        own = [f for f in schema.fieldNames() if f != "commit_hash"]
        tables[name] = index.select("commit_hash", F.explode(name).alias("r")).select("commit_hash", *(F.col(f"r.{f}").alias(f) for f in own))
    return tables


def publish_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Write checked tables as Parquet, partitioned by commit; a commit's partitions are replaced."""
    check_symbols(tables["symbols"])
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_hash").parquet(f"{folder}/{name}")


def checked_manifest(items: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a frozen manifest (file, sha256) with what is wrong: missing, changed or unlisted."""
    have = files.select("file", F.sha2("content", 256).alias("now"))
    both = items.select("file", F.lower("sha256").alias("frozen")).join(have, "file", "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("frozen").isNull(), "unlisted").when(F.col("now") != F.col("frozen"), "changed")
    return both.withColumn("fault", fault).where("fault is not null").select("file", "fault")
