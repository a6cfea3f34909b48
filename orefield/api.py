"""The lookups of a repository explorer as methods over one data folder."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from orefield.functions.text import question_terms
from orefield.operators import graph, history, ranking, reviews, snapshots, structure
from orefield.operators.latest import current_files, current_records, current_reviews, current_states, latest_by
from orefield.sources.tables import table


@dataclass
class Explorer:
    """All methods return DataFrames; nothing runs before an action."""

    spark: SparkSession
    folder: str

    @cached_property
    def files(self) -> DataFrame:
        return current_files(table(self.spark, self.folder, "source_files"))

    @cached_property
    def records(self) -> DataFrame:
        return current_records(table(self.spark, self.folder, "symbol_records"))

    @cached_property
    def references(self) -> DataFrame:
        return structure.reference_edges(self.files, self.records)

    @cached_property
    def documents(self) -> DataFrame:
        return table(self.spark, self.folder, "documents")

    @cached_property
    def review_rows(self) -> DataFrame:
        return current_reviews(table(self.spark, self.folder, "reviews"))

    @cached_property
    def states(self) -> DataFrame:
        return current_states(table(self.spark, self.folder, "symbols"))

    def find_symbol(self, query: str) -> DataFrame:
        if not query.strip():
            raise ValueError("a symbol query must not be blank")
        return structure.symbol_matches(self.records, query.strip()).orderBy("match", "file", "sb", "repository", "id")

    def outline_file(self, repository: str, file: str) -> DataFrame:
        return structure.outline(self.records.where((F.col("repository") == repository) & (F.col("file") == file))).orderBy("seq")

    def read_symbol(self, symbol_id: str, around: int = 1) -> DataFrame:
        """The symbol's lines and those around it."""
        chosen = self.records.where(F.col("id") == symbol_id).select(*structure.PLACE, "file", "sl", "el")
        lines = structure.numbered_lines(self.files.join(chosen.select(*structure.PLACE, "file").distinct(), [*structure.PLACE, "file"], "left_semi"))
        return lines.join(chosen, [*structure.PLACE, "file"]).where((F.col("line") >= F.col("sl") - around) & (F.col("line") <= F.col("el") + around)).drop("sl", "el").orderBy(*structure.PLACE, "line")

    def find_references(self, symbol_id: str) -> DataFrame:
        return self.references.where(F.col("target_id") == symbol_id)

    def find_callers(self, symbol_id: str) -> DataFrame:
        return self.find_references(symbol_id).where("is_call")

    def find_callees(self, symbol_id: str) -> DataFrame:
        return self.references.where((F.col("owner_id") == symbol_id) & F.col("is_call"))

    def find_tests(self, symbol_id: str) -> DataFrame:
        """Uses of a symbol in test files, with the framework."""
        tests = self.files.withColumn("framework", structure.test_framework(F.col("file"), F.col("content"))).where("framework is not null").select(*structure.PLACE, "file", "framework")
        return self.find_references(symbol_id).join(tests, [*structure.PLACE, "file"])

    def affected(self, symbol_ids: DataFrame) -> DataFrame:
        """Everything that uses the given symbols (repository, commit_hash, node), directly or not."""
        edges = self.references.select(*structure.PLACE, F.col("target_id").alias("source"), F.col("owner_id").alias("target"))
        return graph.reachable(edges, symbol_ids, structure.PLACE)

    def hybrid_retrieve(self, question: str, limit: int = 10, vector: list[float] | None = None) -> DataFrame:
        """(kind, key, score, sources) by the signals that the question's terms open; with a query vector
        also the semantic and history signals."""
        terms = question_terms(question)
        if not terms or not 1 <= limit <= ranking.MOST_RESULTS:
            raise ValueError("the question needs a term, the limit 1 to 100")
        key = F.concat_ws("/", "repository", "id").alias("key")
        order = [F.desc("score"), F.asc("key")]
        open_signals = ranking.signals(terms, vector is not None)
        lists = {}
        for name, scores in (("lexical", ranking.lexical_scores(self.records, self.files, terms)), ("structural", structure.structural_scores(self.files, self.records, terms))):
            lists[name] = scores.select(F.lit("symbol").alias("kind"), key, "score")
        if "conditional" in open_signals:
            guards = structure.guard_scores(self.files, self.records, terms)
            lists["conditional"] = guards.select(F.lit("symbol").alias("kind"), key, "score")
        if "configuration" in open_signals:
            found = ranking.script_scores(self.documents, terms)
            lists["configuration"] = found.select(F.lit("json").alias("kind"), F.concat_ws("#", F.col("doc_id").cast("string"), "pointer").alias("key"), "score")
        if "documentation" in open_signals:
            found = ranking.document_matches(self.documents.where("source = 'repo_docs'"), terms)
            lists["documentation"] = found.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), "score").orderBy(*order).limit(ranking.TOP_DOCUMENTS)
        if "history" in open_signals:
            found = history.token_search(history.commits(self.documents), terms)
            lists["history"] = found.select(F.lit("commit").alias("kind"), F.col("doc_id").cast("string").alias("key"), "score")
        if vector is not None:
            entries = latest_by(table(self.spark, self.folder, "semantic_entries"), ["symbol_id"], ["indexed_at"], ["embedding", "repository"])
            near = ranking.nearest_by_cosine(entries, vector)
            lists["semantic"] = near.select(F.lit("symbol").alias("kind"), F.concat_ws("/", "repository", "symbol_id").alias("key"), "score")
        # A symbol of several commits counts once per list, with its best score.
        lists = {n: df.groupBy("kind", "key").agg(F.max("score").alias("score")) for n, df in lists.items()}
        ranked = {n: ranking.with_row_number(df, order) for n, df in lists.items()}
        return ranking.fused(ranked, ["kind", "key"]).orderBy(F.desc("score"), "kind", "key").limit(limit)

    def changes(self) -> DataFrame:
        return snapshots.snapshot_changes(table(self.spark, self.folder, "symbols"))

    def next_reviews(self, snapshot_no: int, now_ms: int, count: int = 1) -> DataFrame:
        """The first of each repository's queue."""
        return reviews.queue(self.states.where(F.col("snapshot_no") == snapshot_no), now_ms).where(F.col("position") <= count)

    def findings(self, snapshot_no: int, severity: str | None = None) -> DataFrame:
        return reviews.findings(self.review_rows, self.states.where(F.col("snapshot_no") == snapshot_no), severity)
