"""Review queue, findings and state transitions over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orefield.operators.ranking import with_row_number
from orefield.operators.snapshots import digest_bytes

# States in queue order, most retries, delay of a retry, and the verdicts' scales.
STATES = ("pending", "stale", "reviewed", "failed", "inactive")
MOST_RETRIES, RETRY_DELAY_MS = 3, 60_000
SEVERITIES = ("none", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")


def is_active() -> Column:
    return F.coalesce(F.col("active").cast("int") == 1, F.lit(True))


def queue(states: DataFrame, now_ms: int) -> DataFrame:
    """Eligible symbols: active, pending or stale, or failed with retries left and the delay over.
    ``position`` orders them within a repository by state, file, name and id."""
    state = F.col("current_status")
    eligible = states.where(is_active()).where(
        state.isin("pending", "stale") | ((state == "failed") & (F.col("retries") < MOST_RETRIES) & (F.coalesce("retry_after", F.lit(0)) <= now_ms))
    )
    rank = F.when(state == "pending", 0).when(state == "stale", 1).when(state == "reviewed", 2).otherwise(3)
    eligible = eligible.select("repository", "id", "current_status", "file", "qualified_name")  # what is sorted is stored
    return with_row_number(eligible, [rank, F.col("file"), F.col("qualified_name"), F.col("id")], "position", ("repository",))


def status_counts(states: DataFrame) -> DataFrame:
    """Symbols per repository and state, with zeros for states without any."""
    state = F.when(is_active(), F.col("current_status")).otherwise("inactive")
    counted = states.groupBy("repository").agg(*[F.count_if(state == s).alias(s) for s in STATES])
    return counted.select("repository", F.explode(F.create_map(*[x for s in STATES for x in (F.lit(s), F.col(s))])).alias("state", "n"))


def findings(reviews: DataFrame, states: DataFrame, severity: str | None = None) -> DataFrame:
    """Findings with whether the symbol's code has changed since; several repositories may hold an id,
    so a finding is outdated if none of them still has the reviewed hash."""
    hashes = states.select(F.col("id").alias("symbol_id"), digest_bytes(F.col("content_hash")).alias("now")).distinct()
    found = reviews.where(F.col("verdict") == "finding").where(F.lit(severity is None) | (F.col("severity") == severity))
    found = found.withColumn("then", digest_bytes(F.col("reviewed_hash")))
    kept = found.join(hashes, (found["symbol_id"] == hashes["symbol_id"]) & (found["then"] == hashes["now"]), "left_semi").select("id", F.lit(0).alias("outdated"))
    known = hashes.select("symbol_id").distinct()
    return found.join(known, "symbol_id", "left_semi").join(kept, "id", "left").withColumn("outdated", F.coalesce("outdated", F.lit(1))).drop("then")


def report_sequence(reviews: DataFrame) -> DataFrame:
    """Number of each review among those of its symbol and model."""
    order = Window.partitionBy("symbol_id", "model").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reviews.withColumn("sequence", F.count("*").over(order))


def reconciled(before: DataFrame, scanned: DataFrame) -> DataFrame:
    """State after a scan: (repository, id) new symbols are pending; unchanged active ones keep state and
    retries; changed or returned ones become stale (pending if never reviewed); unseen ones inactive."""
    key = ["repository", "id"]
    a = before.select(*key, digest_bytes(F.col("content_hash")).alias("old_hash"), F.col("current_status").alias("old_status"), F.col("retries").alias("old_retries"), is_active().alias("was_active"), F.lit(True).alias("known"))
    b = scanned.where(is_active()).select(*key, digest_bytes(F.col("content_hash")).alias("new_hash"), F.lit(True).alias("seen"))
    both = a.join(b, key, "full")
    same = F.coalesce(F.col("was_active") & F.col("old_hash").eqNullSafe(F.col("new_hash")), F.lit(False))
    status = (
        F.when(F.col("seen").isNull(), F.col("old_status"))
        .when(F.col("known").isNull(), "pending")
        .when(same, F.col("old_status"))
        .otherwise(F.when(F.col("old_status") == "pending", "pending").otherwise("stale"))
    )
    kept = F.col("seen").isNull() | same
    return both.select(*key, status.alias("status"), F.when(kept, F.coalesce("old_retries", F.lit(0))).otherwise(0).alias("retries"), F.col("seen").isNotNull().cast("int").alias("active"))


def after_failure(states: DataFrame, reviewed: DataFrame, now_ms: int) -> DataFrame:
    """Failed attempts: one retry more, the delay, and the state by whether a review exists."""
    ids = reviewed.select(F.col("symbol_id").alias("id"), F.lit("reviewed").alias("had")).distinct()
    return states.join(ids, "id", "left").withColumns(
        {"retries": F.col("retries") + 1, "retry_after": F.lit(now_ms + RETRY_DELAY_MS).cast("bigint"), "current_status": F.coalesce("had", F.lit("failed"))}
    ).drop("had")


def normalized_reviews(reviews: DataFrame) -> DataFrame:
    """Fields of the JSON result with unknown words set right and a numeric confidence put in words."""
    def field(name: str) -> Column:
        return F.get_json_object("result_json", f"$.{name}")

    def word(name: str, known: tuple[str, ...], other: str) -> Column:
        low = F.lower(F.trim(field(name)))
        return F.when(low.isin(*known), low).otherwise(other)

    number = field("confidence").try_cast("double")
    confidence = F.when(number >= 0.8, "high").when(number >= 0.5, "medium").when(number.isNotNull(), "low").otherwise(word("confidence", CONFIDENCES, "low"))
    return reviews.where("result_json is not null").select(
        "id", "symbol_id", "model",
        word("verdict", ("finding", "skip"), "skip").alias("verdict"), word("severity", SEVERITIES, "none").alias("severity"), confidence.alias("confidence"),
        F.coalesce(F.trim(field("title")), F.lit("")).alias("title"), F.coalesce(F.json_array_length(field("issues")), F.lit(0)).alias("issues"),
        (field("needs_broader_context") == "true").cast("int").alias("broader"),
    )


def weakest_confidence(normalized: DataFrame) -> DataFrame:
    """Per symbol the least confidence of its reviews and how many there are."""
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    least = normalized.groupBy("symbol_id").agg(F.min(rank).alias("r"), F.count("*").alias("reviews"))
    return least.select("symbol_id", F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("r") + 1).alias("confidence"), "reviews")


def claim_freshness(reviews: DataFrame, changes: DataFrame, states: DataFrame) -> DataFrame:
    """Of each review whether its symbol changed (direct) or another symbol of the same file did (file).

    ``changes`` are (source, key, ...) of a snapshot step, ``states`` give each symbol's file; a symbol
    id held by several repositories is stale if it is in any of them.
    """
    moved = changes.select(F.col("source").alias("repository"), F.col("key").alias("id")).distinct()
    direct = moved.select("id", F.lit(1).alias("direct")).distinct()
    placed = states.select("repository", "id", "file").distinct()
    touched = placed.join(moved, ["repository", "id"], "left_semi").select("repository", "file").distinct()
    beside = placed.join(touched, ["repository", "file"], "left_semi").select("id", F.lit(1).alias("beside")).distinct()
    told = reviews.select(F.col("id").alias("review_id"), F.col("symbol_id").alias("id")).join(direct, "id", "left").join(beside, "id", "left")
    state = F.when(F.col("direct").isNotNull(), "stale").when(F.col("beside").isNotNull(), "file stale").otherwise("fresh")
    return told.select("review_id", state.alias("freshness"))


def newest_findings(found: DataFrame, severity: str | None = None, most: int = 100) -> DataFrame:
    """The newest findings, at most ``most``, which is the report's bound; of equal times the smaller id first."""
    chosen = found if severity is None else found.where(F.col("severity") == severity)
    return chosen.orderBy(F.desc("created_at"), "id").limit(most)


def after_review(states: DataFrame, reviews: DataFrame) -> DataFrame:
    """States of the symbols after their latest review: reviewed at its time under its hash, no retries and no error
    left; symbols without a review keep their state. Reviews that tie in their time are ordered by id."""
    last = reviews.groupBy(F.col("symbol_id").alias("id")).agg(F.max(F.struct("created_at", F.col("id").alias("review_id"), "reviewed_hash")).alias("r"))
    told = states.join(last, "id", "left")
    done = F.col("r").isNotNull()
    return told.select(
        "repository", "id", F.when(done, "reviewed").otherwise(F.col("current_status")).alias("current_status"),
        F.when(done, F.col("r.created_at")).otherwise(F.col("last_reviewed_at")).alias("last_reviewed_at"), F.when(done, F.col("r.reviewed_hash")).otherwise(F.col("last_reviewed_hash")).alias("last_reviewed_hash"),
        F.when(done, 0).otherwise(F.col("retries")).alias("retries"), F.when(done, 0).otherwise(F.col("retry_after")).cast("bigint").alias("retry_after"),
    )


def decided(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews with the human status of ``decisions`` (id, decision); a decision on no review or of another word
    is an error, and the last of repeated ones counts by ``at``."""
    from orefield.schemas import require_none

    require_none(decisions.where(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))), "unknown decision")
    require_none(decisions.join(reviews.select("id"), "id", "left_anti"), "no such review")
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("decision"))
    return reviews.join(last, "id", "left").withColumn("human_status", F.coalesce("decision", "human_status")).drop("decision")
