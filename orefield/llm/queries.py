"""Registered queries of the training-data operators on texts and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orefield.llm.encoding import encode_corpus
from orefield.llm.leakage import leaked_items
from orefield.llm.pairs import broken_pairs
from orefield.llm.splitting import split_texts
from orefield.llm.syntax import broken_files, broken_rates
from orefield.llm.truncation import cut_rates, cut_values
from orefield.llm.vectors import neighbour_pairs


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(_table(spark, folder, "semantic_entries"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_files(_table(spark, folder, "source_files")).select("repository", "commit_hash", "file")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return broken_rates(_table(spark, folder, "source_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_values(_table(spark, folder, "reviews")).select("review_id", "field")


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cut_rates(_table(spark, folder, "reviews"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs(_table(spark, folder, "reviews"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(_table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_pieces": p8_pieces}
SQL: dict[str, str] = {}
