"""Current rows of tables that are delivered repeatedly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.functions.text import language_or_path


def latest_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the largest in ``order``, then in ``columns``, so ties don't depend on the
    input's order. A partial aggregate runs before the shuffle; a hot key costs one row a task."""
    packed = F.struct(*dict.fromkeys([*order, *columns])).alias("row")
    return rows.select(*keys, packed).groupBy(*keys).agg(F.max("row").alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in columns))


def current_files(source_files: DataFrame) -> DataFrame:
    """(repository, commit_hash, file, language, content) of the latest capture of every file."""
    files = latest_by(source_files, ["repository", "commit_hash", "file"], ["captured_at", "loaded_at"], ["content", "language"])
    return files.withColumn("language", language_or_path(F.col("language"), F.col("file")))


def current_records(symbol_records: DataFrame) -> DataFrame:
    """Declarations by the latest index run, their ranges flattened to bytes and lines."""
    columns = ["file", "language", "kind", "name", "qualified_name", "parent_id", "signature", "sl", "el", "sb", "eb"]
    flat = symbol_records.withColumns(
        {"sl": F.col("range.start.line"), "el": F.col("range.end.line"), "sb": F.col("range.start.byte"), "eb": F.col("range.end.byte")}
    )
    return latest_by(flat, ["repository", "commit_hash", "id"], ["indexed_at"], columns).withColumn(
        "language", language_or_path(F.col("language"), F.col("file"))
    )


def current_reviews(reviews: DataFrame) -> DataFrame:
    columns = [c for c in reviews.columns if c not in ("id", "loaded_at")]
    return latest_by(reviews.where("id is not null"), ["id"], ["loaded_at"], columns)


def current_states(symbols: DataFrame) -> DataFrame:
    """The state of every (repository, snapshot, symbol) by its latest update."""
    keys = ["repository", "snapshot_no", "id"]
    return latest_by(symbols, keys, ["updated_at", "loaded_at"], [c for c in symbols.columns if c not in (*keys, "updated_at", "loaded_at")])
