"""Tables from the text that Git prints (run where the repository is; here the text is a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from orefield.functions.text import unix_lines


def commits_from_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """(repository, position, commit, author_time, subject) of ``log --format=%H%x09%at%x09%s`` output,
    newest first; other lines are name-status lines of the commit above (see ``files_from_log``)."""
    lines = logs.select("repository", F.posexplode(unix_lines(F.col(text))).alias("position", "line"))
    head = lines.where(F.col("line").rlike(r"^[0-9a-f]{40}\t\d+\t"))
    parts = F.split("line", "\t", 3)
    return head.select("repository", "position", parts[0].alias("commit"), F.timestamp_seconds(parts[1].cast("bigint")).alias("author_time"), parts[2].alias("subject"))


def files_from_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """(repository, commit, status, path, old_path) of the same output with ``--name-status``: each file
    line belongs to the last commit line above it; renames and copies name both paths."""
    lines = logs.select("repository", F.posexplode(unix_lines(F.col(text))).alias("position", "line"))
    commit = F.when(F.col("line").rlike(r"^[0-9a-f]{40}\t\d+\t"), F.substring("line", 1, 40))
    above = Window.partitionBy("repository").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = lines.withColumn("commit", F.last(commit, ignorenulls=True).over(above)).where(F.col("line").rlike(r"^[MADTRC]\d*\t"))
    parts = F.split("line", "\t")
    moved = F.substring(parts[0], 1, 1).isin("R", "C")
    return owned.select("repository", "commit", F.substring(parts[0], 1, 1).alias("status"), F.when(moved, parts[2]).otherwise(parts[1]).alias("path"), F.when(moved, parts[1]).alias("old_path"))


def blame_lines(blames: DataFrame, text: str = "text") -> DataFrame:
    """(repository, file, line, commit, author_time) of porcelain blame output. A commit's details are
    printed once per file, at its first line, and serve all its lines."""
    lines = blames.select("repository", "file", F.posexplode(unix_lines(F.col(text))).alias("position", "row"))
    header = r"^([0-9a-f]{40}) \d+ (\d+)"
    above = Window.partitionBy("repository", "file").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    commit = F.last(F.nullif(F.regexp_extract("row", header, 1), F.lit("")), ignorenulls=True).over(above)
    told = lines.where(~F.startswith("row", F.lit("\t"))).withColumn("commit", commit)
    times = told.where(F.col("row").rlike(r"^author-time \d+")).groupBy("repository", "file", "commit").agg(F.max(F.regexp_extract("row", r"(\d+)", 1).cast("bigint")).alias("t"))
    heads = told.where(F.col("row").rlike(header)).select("repository", "file", F.regexp_extract("row", header, 2).cast("int").alias("line"), "commit")
    return heads.join(times, ["repository", "file", "commit"], "left").select("repository", "file", "line", "commit", F.timestamp_seconds("t").alias("author_time"))
