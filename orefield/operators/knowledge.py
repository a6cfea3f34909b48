"""Claims with evidence: validated appends, weakest quality, freshness after changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orefield.operators.graph import reachable
from orefield.schemas import EVIDENCE_KINDS, QUALITIES, VERDICTS, require_none


def quality_rank(quality: Column) -> Column:
    return F.coalesce(*[F.when(quality == q, i) for i, q in enumerate(QUALITIES)])


def weakest_quality(evidence: DataFrame, group: list[str]) -> DataFrame:
    """Per group the weakest resolution quality of its evidence."""
    least = evidence.groupBy(*group).agg(F.max(quality_rank(F.col("quality"))).alias("r"))
    return least.select(*group, F.element_at(F.array(*map(F.lit, QUALITIES)), F.col("r") + 1).alias("quality"))


def validated(claims: DataFrame, evidence: DataFrame, symbols: DataFrame) -> DataFrame:
    """The claims with their weakest quality, if all is in order: known states and kinds, text, evidence for
    each, existing symbols, and no SUPPORTED claim on unresolved evidence. Otherwise an error names a row."""
    require_none(claims.where(~F.col("status").isin(*VERDICTS)).select("claim_id", "status"), "unknown state")
    require_none(claims.where("text is null or trim(text) = ''").select("claim_id"), "empty claim")
    require_none(claims.groupBy("claim_id").count().where("count > 1"), "repeated claim")
    require_none(evidence.where(~F.col("kind").isin(*EVIDENCE_KINDS) | quality_rank(F.col("quality")).isNull()), "unknown evidence")
    require_none(claims.join(evidence, "claim_id", "left_anti").select("claim_id"), "claim without evidence")
    require_none(evidence.join(claims, "claim_id", "left_anti").select("claim_id"), "evidence without claim")
    known = symbols.select(F.col("id").alias("symbol_id")).distinct()
    require_none(evidence.where("symbol_id is not null").join(known, "symbol_id", "left_anti").select("claim_id", "symbol_id"), "unknown symbol")
    told = claims.join(weakest_quality(evidence, ["claim_id"]), "claim_id")
    require_none(told.where("status = 'SUPPORTED' and quality = 'unresolved'").select("claim_id"), "supported on unresolved evidence")
    return told


def state_difference(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that are in one state only or whose values differ (null equals null)."""
    a = before.select(*key, F.col(value).alias("old"), F.lit(True).alias("was"))
    b = after.select(*key, F.col(value).alias("new"), F.lit(True).alias("now"))
    both = a.join(b, key, "full").where(F.col("was").isNull() | F.col("now").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def refreshed(claims: DataFrame, evidence: DataFrame, changed_files: DataFrame, changed_symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with their freshness after a change: ``file`` if a cited file changed, else ``symbol`` if a cited
    symbol changed or uses a changed one over exact or static edges, else fresh. A stale claim stays stale."""
    firm = edges.where(F.col("resolution").isin("exact", "static")).select("repository", F.col("target_id").alias("source"), F.col("owner_id").alias("target"))
    reached = reachable(firm, changed_symbols.select("repository", F.col("id").alias("node")), ["repository"]).select(F.col("node").alias("symbol_id")).distinct()
    by_file = evidence.join(changed_files.select("file").distinct(), "file", "left_semi").select("claim_id", F.lit("file").alias("f")).distinct()
    by_symbol = evidence.join(reached, "symbol_id", "left_semi").select("claim_id", F.lit("symbol").alias("s")).distinct()
    cause = F.coalesce(F.col("f"), F.col("s"))
    return claims.join(by_file, "claim_id", "left").join(by_symbol, "claim_id", "left").withColumns(
        {"cause": F.when(F.col("fresh"), cause), "fresh": F.col("fresh") & cause.isNull()}
    ).drop("f", "s")
