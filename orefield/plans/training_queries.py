"""Registered query of the core training-data operator: changes between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orefield.operators.snapshots import snapshot_changes
from orefield.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(table(spark, folder, "symbols")).select(
        "source", "key", "from_snapshot", "to_snapshot", "change_type"
    ).toDF("repository", "id", "from_snapshot", "to_snapshot", "change_type")


P2_SQL = """
WITH ranked AS (
  SELECT repository, snapshot_no, id,
         regexp_replace(lower(regexp_replace(content_hash, '\\s', '', 'g')), '^sha-?256[:=]', '') AS h,
         active,
         row_number() OVER (PARTITION BY repository, snapshot_no, id
                            ORDER BY updated_at DESC NULLS LAST, (active IS NULL OR active = 1) DESC) AS rn
  FROM symbols
  WHERE repository IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL
), states AS (
  SELECT repository, snapshot_no, id, h FROM ranked WHERE rn = 1 AND (active IS NULL OR active = 1)
), snaps AS (
  SELECT repository, snapshot_no AS from_snapshot,
         lead(snapshot_no) OVER (PARTITION BY repository ORDER BY snapshot_no) AS to_snapshot
  FROM (SELECT DISTINCT repository, snapshot_no FROM symbols
        WHERE repository IS NOT NULL AND snapshot_no IS NOT NULL)
), pairs AS (
  SELECT * FROM snaps WHERE to_snapshot IS NOT NULL
), f AS (
  SELECT p.repository, p.from_snapshot, p.to_snapshot, s.id, s.h
  FROM pairs p JOIN states s ON s.repository = p.repository AND s.snapshot_no = p.from_snapshot
), t AS (
  SELECT p.repository, p.from_snapshot, p.to_snapshot, s.id, s.h
  FROM pairs p JOIN states s ON s.repository = p.repository AND s.snapshot_no = p.to_snapshot
)
SELECT coalesce(f.repository, t.repository) AS repository, coalesce(f.id, t.id) AS id,
       coalesce(f.from_snapshot, t.from_snapshot) AS from_snapshot,
       coalesce(f.to_snapshot, t.to_snapshot) AS to_snapshot,
       CASE WHEN f.id IS NULL THEN 'added' WHEN t.id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM f FULL JOIN t ON f.repository = t.repository AND f.from_snapshot = t.from_snapshot
  AND f.to_snapshot = t.to_snapshot AND f.id = t.id
WHERE f.id IS NULL OR t.id IS NULL OR f.h IS DISTINCT FROM t.h
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
