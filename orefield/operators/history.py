"""Commit history from logs: changed files, introductions, token search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.functions.text import terms_of, unix_lines


def commits(documents: DataFrame) -> DataFrame:
    """(doc_id, repository, created_at, subject, files) of commit logs; ``files`` are (status, path)."""
    lines = unix_lines(F.col("text"))
    changed = F.transform(
        F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^ ?[MADRC]\d* [^ ]+$"))),
        lambda x: F.struct(F.regexp_extract(x, r"^ ?([MADRC])", 1).alias("status"), F.regexp_extract(x, r" ([^ ]+)$", 1).alias("path")),
    )
    logs = documents.where("source = 'commit_log' and text is not null")
    return logs.select("doc_id", "repository", "created_at", F.trim(lines[0]).alias("subject"), changed.alias("files"))


def commit_files(log: DataFrame) -> DataFrame:
    return log.select("doc_id", "repository", "created_at", F.explode("files").alias("f")).select("doc_id", "repository", "created_at", "f.status", "f.path")


def introductions(log: DataFrame) -> DataFrame:
    """Of each path in a repository its first and last commit and their number."""
    order = F.struct("created_at", "doc_id")
    return commit_files(log).groupBy("repository", "path").agg(
        F.min_by("doc_id", order).alias("introduced"), F.max_by("doc_id", order).alias("latest"), F.countDistinct("doc_id").alias("commits")
    )


def token_search(log: DataFrame, terms: list[str], least: int = 4) -> DataFrame:
    """Commits by exact tokens: 6 for each in the subject, 1 for each in the paths."""
    wanted = F.array(*map(F.lit, terms))
    subject = F.size(F.array_intersect(terms_of(F.col("subject")), wanted))
    paths = F.size(F.array_intersect(terms_of(F.array_join(F.transform("files", lambda f: f["path"]), " ")), wanted))
    return log.withColumn("score", subject * 6 + paths).where(F.col("score") >= least)


def recent_changes(log: DataFrame, most: int = 20) -> DataFrame:
    """The newest commits of each repository, at most ``most``, which is the report's bound, with their files."""
    from pyspark.sql import Window

    newest = Window.partitionBy("repository").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return log.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= most).select("repository", "rank", "doc_id", "subject", F.size("files").alias("files"))


def symbol_history(log: DataFrame, records: DataFrame) -> DataFrame:
    """(repository, id, doc_id, rank): the commits that changed a declaration's file, newest first."""
    from pyspark.sql import Window

    changed = commit_files(log).select("repository", "doc_id", "created_at", F.col("path").alias("file")).distinct()
    named = records.select("repository", "id", "file").distinct()
    newest = Window.partitionBy("repository", "id").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return named.join(changed, ["repository", "file"]).select("repository", "id", "doc_id", F.row_number().over(newest).alias("rank"))
