"""Explicit schemas of the index's records and checks of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SCHEMA_VERSION, EMBEDDING_VERSION = 1, 2
# Resolution qualities from strongest to weakest, verification states, kinds of evidence.
QUALITIES = ("exact", "static", "heuristic", "unresolved")
VERDICTS = ("SUPPORTED", "CONTRADICTED", "UNCERTAIN")
EVIDENCE_KINDS = ("symbol", "file", "range", "commit", "document")

POSITION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("byte", T.LongType())])
RANGE = T.StructType([T.StructField("start", POSITION), T.StructField("end", POSITION)])


def _record(*fields: str, **nested: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(f, nested.get(f, T.StringType())) for f in fields])


RECORDS: dict[str, T.StructType] = {
    "symbols": _record("schema_version", "id", "repository_root", "commit_hash", "file", "language", "kind", "name", "qualified_name", "parent_id", "range", "selection_range", "signature", schema_version=T.IntegerType(), range=RANGE, selection_range=RANGE),
    "references": _record("file", "range", "name", "source_symbol_id", "target_symbol_id", "resolution", range=RANGE),
    "dependencies": _record("file", "range", "module_specifier", "target_file", "resolution", range=RANGE),
    "inheritance": _record("kind", "child_symbol_id", "parent_name", "parent_symbol_id", "file", "range", "resolution", range=RANGE),
    "calls": _record("caller_symbol_id", "callee_name", "callee_symbol_id", "file", "range", "resolution", "guard_condition", range=RANGE),
    "tests": _record("file", "range", "name", "kind", "framework", range=RANGE),
    "test_symbols": _record("test_file", "test_name", "test_range", "target_symbol_id", "resolution", test_range=RANGE),
}
INDEX = T.StructType([T.StructField("commit_hash", T.StringType()), *(T.StructField(n, T.ArrayType(s)) for n, s in RECORDS.items())])


class ContractError(ValueError):
    """A table breaks its contract."""


def require_none(bad: DataFrame, what: str) -> None:
    """Raise if there is any row, naming one of them."""
    row = bad.first()
    if row is not None:
        raise ContractError(f"{what}: {row.asDict()}")


def check_symbols(symbols: DataFrame) -> None:
    """Known schema version, and ids unique within a commit."""
    require_none(symbols.where(F.col("schema_version") != SCHEMA_VERSION).select("schema_version"), "other schema version")
    require_none(symbols.groupBy("commit_hash", "id").count().where("count > 1"), "repeated id")
