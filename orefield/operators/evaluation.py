"""Evaluation: retrieval metrics, summaries with a global row, medians and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


#: Queries and rows of one block of the search.
QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 256, 4_096


def neighbour_ranks(vectors: DataFrame, every: int = 20, k: int = 10) -> DataFrame:
    """For the query set (ids divisible by ``every``) the k nearest of all others by cosine, with ranks.

    The query set is searched against all rows in blocks: both sides are cut into blocks of bounded size by
    their number, each pair of blocks keeps the best k of each query, and only those meet again.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    unit = vectors.where("embedding is not null").withColumn("v", x)
    unit = unit.withColumn("norm", F.sqrt(F.aggregate(F.transform("v", lambda a: a * a), F.lit(0.0), lambda s, a: s + a))).where("norm > 0")
    total = unit.count()
    blocks, parts = max(1, -(-total // ROWS_PER_BLOCK)), max(1, -(-total // (every * QUERIES_PER_BLOCK)))
    queries = unit.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("q"), F.col("norm").alias("q_norm"))
    queries = queries.withColumns({"part": F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    scanned = unit.withColumns({"block": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    scored = scanned.join(queries, ["block", "part"]).where("vec_id != query_id").select("query_id", "query_label", "vec_id", "label", "block", F.round(dot / (F.col("norm") * F.col("q_norm")), 5).alias("score"))
    order = [F.desc("score"), F.asc("vec_id")]
    near = scored.withColumn("r", F.row_number().over(Window.partitionBy("block", "query_id").orderBy(*order))).where(F.col("r") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("r", "block")


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Precision at k, reciprocal rank of the first hit, per query label and in all (null label)."""
    hit = F.col("label") == F.col("query_label")
    per = ranks.groupBy("query_id", "query_label").agg(F.avg(hit.cast("int")).alias("precision"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("reciprocal"))
    return per.rollup("query_label").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("reciprocal"), 6).alias("mrr"))


def grouped_and_total(rows: DataFrame, group: str, **aggregates) -> DataFrame:
    """Aggregates per group and over all rows (null group), in one pass."""
    return rows.rollup(group).agg(*[a.alias(n) for n, a in aggregates.items()])
