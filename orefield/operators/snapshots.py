"""What changed between full snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A table of (source, snapshot) pairs up to this many rows is broadcast; a larger one is shuffled.
PAIRS_BROADCAST_ROWS = 200_000


def digest_bytes(value: Column) -> Column:
    """The bytes of a SHA-256 digest in any spelling (case, blanks, ``sha256:`` prefix) behind a one; any
    other text keeps its own UTF-8 bytes behind a zero byte, so it can't equal a digest."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"\s", ""))), r"^sha-?256[:=]", "")
    return F.when(plain.rlike(r"^[0-9a-f]{64}$"), F.unhex(F.concat(F.lit("01"), plain))).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(value, "UTF-8"))
    )


def _packed(value: Column) -> Column:
    """Ids that are 64 lower-case hex digits travel as 32 bytes behind a one; others as they are behind a zero byte."""
    return F.when(value.rlike(r"^[0-9a-f]{64}$"), F.unhex(F.concat(F.lit("01"), value))).otherwise(
        F.concat(F.unhex(F.lit("00")), F.encode(value, "UTF-8"))
    )


def _unpacked(value: Column) -> Column:
    rest = F.substring(value, 2, 2147483647)
    return F.when(F.substring(value, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def snapshot_states(
    rows: DataFrame,
    source: str = "repository",
    snapshot: str = "snapshot_no",
    key: str = "id",
    content: str = "content_hash",
    active: str = "active",
    version: str = "updated_at",
) -> DataFrame:
    """The one present state (source, snapshot, key, hash) per key and snapshot.

    Of several rows the latest ``version`` counts (null is oldest); rows that tie in it are ordered
    by activity and digest, so the result doesn't depend on the input's order. A key is present if
    ``active`` is 1 or null. Rows whose source, snapshot or key is null identify nothing and are
    left out. A null hash is a value of its own, equal only to null.
    """
    hashed = rows.select(
        F.col(source).alias("source"),
        F.col(snapshot).alias("snapshot"),
        _packed(F.col(key)).alias("key"),
        digest_bytes(F.col(content)).alias("hash"),
        F.coalesce(F.col(active).cast("int") == 1, F.lit(True)).alias("present"),
        F.col(version).alias("version"),
    ).where("source is not null and snapshot is not null and key is not null")
    latest = hashed.groupBy("source", "snapshot", "key").agg(
        F.max(F.struct("version", "present", "hash")).alias("state")
    )
    return latest.where("state.present").select("source", "snapshot", "key", F.col("state.hash").alias("hash"))


def snapshot_pairs(rows: DataFrame, source: str = "repository", snapshot: str = "snapshot_no") -> DataFrame:
    """(source, from_snapshot, to_snapshot) of each two consecutive snapshots of a source.

    A source's snapshots are those under which it has any row, present or not.
    """
    from pyspark.sql import Window

    known = rows.select(F.col(source).alias("source"), F.col(snapshot).alias("from_snapshot")).dropna().distinct()
    step = Window.partitionBy("source").orderBy("from_snapshot")
    return known.withColumn("to_snapshot", F.lead("from_snapshot").over(step)).where("to_snapshot is not null")


def of_last_snapshot(rows: DataFrame, known: DataFrame, back: int = 0, snapshot: str = "snapshot_no", source: str = "repository") -> DataFrame:
    """The rows of each source's own last snapshot, or of the one ``back`` places before it. ``known`` are the
    rows (repository, snapshot_no) that tell the snapshots of a repository."""
    from pyspark.sql import Window

    step = Window.partitionBy("_source").orderBy(F.desc("_snapshot"))
    numbers = known.select(F.col("repository").alias("_source"), F.col("snapshot_no").alias("_snapshot")).dropna().distinct()
    chosen = numbers.withColumn("_back", F.row_number().over(step) - 1).where(F.col("_back") == back)
    return rows.join(chosen, (rows[source] == chosen["_source"]) & (rows[snapshot] == chosen["_snapshot"])).drop("_source", "_snapshot", "_back")


def snapshot_changes(rows: DataFrame, **columns: str) -> DataFrame:
    """Every key added, removed or changed between consecutive snapshots of its source.

    ``EXCEPT ALL`` both ways takes out the identical rows; a full join of the residues by key labels
    what is left. Result: source, key, from_snapshot, to_snapshot, change_type. An empty table gives
    an empty result; extra columns are ignored.
    """
    names = {k: columns[k] for k in ("source", "snapshot") if k in columns}
    pairs = snapshot_pairs(rows, **names)
    states = snapshot_states(rows, **columns)
    # The pairs are few (sources x snapshots); their number is checked before they are broadcast.
    if pairs.limit(PAIRS_BROADCAST_ROWS + 1).count() <= PAIRS_BROADCAST_ROWS:
        pairs = F.broadcast(pairs)

    def side(number: str) -> DataFrame:
        return states.withColumnRenamed("snapshot", number).join(pairs, ["source", number]).select(
            "source", "from_snapshot", "to_snapshot", "key", "hash"
        )

    before, after = side("from_snapshot"), side("to_snapshot")
    key = ["source", "from_snapshot", "to_snapshot", "key"]
    gone = before.exceptAll(after).select(*key, F.lit(True).alias("was"))
    come = after.exceptAll(before).select(*key, F.lit(True).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return gone.join(come, key, "full").select(
        "source", _unpacked(F.col("key")).alias("key"), "from_snapshot", "to_snapshot", kind.alias("change_type")
    )
