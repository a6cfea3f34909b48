import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orefield.operators import knowledge
from orefield.schemas import ContractError
from orefield.sources import git_text, index_json

A, B = "a" * 40, "b" * 40


def test_index_documents_become_tables(spark, tmp_path):
    place = {"start": {"line": 1, "column": 1, "byte": 0}, "end": {"line": 2, "column": 1, "byte": 9}}
    symbol = {"schema_version": 1, "id": "i", "repository_root": "/r", "commit_hash": A, "file": "é.py", "language": "python", "kind": "function", "name": "f", "qualified_name": "f", "range": place, "selection_range": place, "signature": "def f()"}
    for n, doc in enumerate(({"commit_hash": A, "symbols": [symbol], "calls": [{"callee_name": "g", "file": "é.py", "range": place, "resolution": "unresolved"}]}, {"commit_hash": B})):
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=1))
    tables = index_json.read_index(spark, str(tmp_path))
    assert rows(tables["symbols"].select("commit_hash", "file", "range.end.byte", "parent_id")) == [(A, "é.py", 9, None)]
    assert rows(tables["calls"].select("callee_name", "caller_symbol_id")) == [("g", None)] and tables["tests"].count() == 0
    index_json.publish_index(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "symbols")).where(F.col("commit_hash") == A).count() == 1
    with pytest.raises(ContractError):
        index_json.publish_index(tables | {"symbols": tables["symbols"].union(tables["symbols"])}, str(tmp_path / "bad"))
    with pytest.raises(ContractError):
        index_json.publish_index(tables | {"symbols": tables["symbols"].withColumn("schema_version", F.lit(2))}, str(tmp_path / "bad"))


def test_manifest(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    items = spark.createDataFrame([("a", digest.upper()), ("b", digest), ("c", digest)], "file string, sha256 string")
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z")], "file string, content string")
    assert rows(index_json.checked_manifest(items, files)) == [("b", "changed"), ("c", "missing"), ("d", "unlisted")]


def test_git_text(spark):
    log = f"{A}\t1700000000\tRename it\n\nR100\told.ts\tnew.ts\nM\tx.ts\n{B}\t1600000000\tAdd\n\nA\told.ts\n"
    logs = spark.createDataFrame([("r", log), ("empty", ""), ("none", None)], "repository string, text string")
    assert rows(git_text.commits_from_log(logs).select("commit", "subject")) == [(A, "Rename it"), (B, "Add")]
    assert rows(git_text.files_from_log(logs).select("commit", "status", "path", "old_path")) == [(A, "M", "x.ts", None), (A, "R", "new.ts", "old.ts"), (B, "A", "old.ts", None)]
    blame = f"{A} 1 1 2\nauthor X\nauthor-time 1700000000\n\tcode {B} 1 1\n{A} 2 2\n\tmore\n{B} 9 3 1\nauthor-time 1600000000\n\tend\n"
    found = git_text.blame_lines(spark.createDataFrame([("r", "f", blame)], "repository string, file string, text string"))
    assert rows(found.select("line", "commit", F.unix_timestamp("author_time"))) == [(1, A, 1700000000), (2, A, 1700000000), (3, B, 1600000000)]


CLAIM, EVIDENCE = "claim_id string, text string, status string, fresh boolean", "claim_id string, kind string, quality string, symbol_id string, file string"


def test_claims_are_validated(spark):
    claims = spark.createDataFrame([("c1", "t", "SUPPORTED", True), ("c2", "t", "UNCERTAIN", True)], CLAIM)
    good = [("c1", "symbol", "exact", "i", None), ("c1", "file", "heuristic", None, "f"), ("c2", "range", "unresolved", None, "f")]
    symbols = spark.createDataFrame([("i",)], "id string")
    assert rows(knowledge.validated(claims, spark.createDataFrame(good, EVIDENCE), symbols).select("claim_id", "quality")) == [("c1", "heuristic"), ("c2", "unresolved")]
    for bad in (good[:2], [*good, ("c9", "file", "exact", None, "f")], [*good, ("c2", "symbol", "exact", "none", None)], [*good, ("c1", "file", "unresolved", None, "f")], [*good, ("c2", "guess", "exact", None, None)]):
        with pytest.raises(ContractError):
            knowledge.validated(claims, spark.createDataFrame(bad, EVIDENCE), symbols)
    with pytest.raises(ContractError):
        knowledge.validated(claims.withColumn("text", F.lit(" ")), spark.createDataFrame(good, EVIDENCE), symbols)


def test_difference_and_freshness(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "file string, hash string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("n", "4")], "file string, hash string")
    assert rows(knowledge.state_difference(a, b, ["file"], "hash")) == [("n", "added"), ("x", "changed"), ("z", "removed")]
    claims = spark.createDataFrame([(f"c{n}", "t", "SUPPORTED", n != 5) for n in range(1, 6)], CLAIM)
    evidence = spark.createDataFrame([("c1", "file", "exact", None, "x"), ("c2", "symbol", "exact", "caller", "q"), ("c3", "symbol", "exact", "guess", "q"), ("c4", "symbol", "exact", "other", "q"), ("c5", "file", "exact", None, "q")], EVIDENCE)
    edges = spark.createDataFrame([("r", "caller", "mid", "static"), ("r", "mid", "changed", "exact"), ("r", "mid", "caller", "static"), ("r", "guess", "changed", "heuristic")], "repository string, owner_id string, target_id string, resolution string")
    got = knowledge.refreshed(claims, evidence, spark.createDataFrame([("x",)], "file string"), spark.createDataFrame([("r", "changed")], "repository string, id string"), edges)
    assert rows(got.select("claim_id", "fresh", "cause")) == [("c1", False, "file"), ("c2", False, "symbol"), ("c3", True, None), ("c4", True, None), ("c5", False, None)]
