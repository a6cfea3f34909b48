"""Graph expansion over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.session import discard, stored


def reachable(edges: DataFrame, start: DataFrame, key: list[str], most_rounds: int = 1_000) -> DataFrame:
    """Everything reached from ``start`` along ``edges`` (key..., source, target), the start included,
    with the distance. Safe on cycles: only unseen nodes go on. The edges, each round's frontier and the nodes seen
    so far are written to the shared folder, which cuts the lineage and survives lost executors; what no later
    round reads is deleted."""
    edges = stored(edges.select(*key, "source", "target").where("source is not null and target is not null").distinct())
    seen = stored(start.select(*key, "node").where("node is not null").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for distance in range(1, most_rounds + 1):
        step = frontier.join(edges.withColumnRenamed("source", "node"), [*key, "node"]).select(*key, F.col("target").alias("node")).distinct()
        before, frontier = frontier, stored(step.join(seen, [*key, "node"], "left_anti").withColumn("distance", F.lit(distance)))
        if frontier.isEmpty():
            discard(edges, frontier, *([before] if before is not seen else []))
            return seen
        reached = stored(seen.unionByName(frontier))
        discard(seen, before)
        seen = reached
    raise ValueError(f"not finished after {most_rounds} rounds")


def neighbour_counts(edges: DataFrame, key: list[str]) -> DataFrame:
    """Distinct callers and callees of every node that has any."""
    used = edges.where("source is not null and target is not null")
    into = used.groupBy(*key, F.col("target").alias("node")).agg(F.countDistinct("source").alias("callers"), F.sum("n").alias("uses"))
    out = used.groupBy(*key, F.col("source").alias("node")).agg(F.countDistinct("target").alias("callees"))
    return into.join(out, [*key, "node"], "full").select(
        *key, "node", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("callers", "uses", "callees"))
    )
