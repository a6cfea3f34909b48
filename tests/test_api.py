from datetime import datetime

import pytest
from conftest import rows

from orefield.api import Explorer
from orefield.operators import structure

AT = datetime(2025, 1, 1)
CODE = 'import { helper } from "./helper.js";\nexport class Reader extends Base {\n  readToken(a) {\n    if (a.length > 1) {\n      return helper(a);\n    }\n  }\n}\n'


@pytest.fixture()
def explorer(spark, tmp_path):
    def save(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    pos = "struct<line: int, column: int, byte: bigint>"
    save("source_files", [("r", "c", "src/reader.ts", None, CODE, AT, AT), ("r", "c", "src/helper.ts", "typescript", "export function helper(x) {\n  return x;\n}\n", AT, AT), ("r", "c", "tests/reader.test.ts", "typescript", 'import { test } from "vitest";\nhelper(1);\n', AT, AT)], "repository string, commit_hash string, file string, language string, content string, captured_at timestamp, loaded_at timestamp")

    def record(i, file, name, kind, first, last, a, b):
        return ("r", "c", i, file, None, kind, name, name, None, ((first, 1, a), (last, 1, b)), f"{kind} {name}", AT)

    save("symbol_records", [record("i1", "src/reader.ts", "Reader", "class", 2, 8, 40, 190), record("i2", "src/reader.ts", "readToken", "method", 3, 7, 80, 180), record("i3", "src/helper.ts", "helper", "function", 1, 3, 0, 40)], f"repository string, commit_hash string, id string, file string, language string, kind string, name string, qualified_name string, parent_id string, range struct<start: {pos}, end: {pos}>, signature string, indexed_at timestamp")
    save("documents", [(1, "# Documentation\nThe readToken helper", "repo_docs", "r", "docs/a.md", AT), (2, "Change readToken history\n M src/reader.ts", "commit_log", "r", None, AT)], "doc_id long, text string, source string, repository string, path string, created_at timestamp")
    save("semantic_entries", [("i1", [1.0, 0.0], "r", AT), ("i2", [0.0, 1.0], "r", AT)], "symbol_id string, embedding array<float>, repository string, indexed_at timestamp")
    return Explorer(spark, str(tmp_path))


def test_lookups(explorer):
    assert [r.id for r in explorer.find_symbol("readtoken").collect()] == ["i2"]
    assert [r.id for r in explorer.outline_file("r", "src/reader.ts").collect()] == ["i1", "i2"]
    assert [r.line for r in explorer.read_symbol("i3").collect()] == [1, 2, 3, 4]
    assert rows(explorer.find_callers("i3").select("file", "line", "owner_id")) == [("src/reader.ts", 5, "i2"), ("tests/reader.test.ts", 2, None)]
    assert rows(explorer.find_callees("i2").select("target_id")) == [("i3",)]
    assert rows(explorer.find_tests("i3").select("file", "framework")) == [("tests/reader.test.ts", "vitest")]
    start = explorer.records.where("id = 'i3'").selectExpr("repository", "commit_hash", "id as node")
    assert {r.node for r in explorer.affected(start).collect()} == {"i3", "i2"}
    with pytest.raises(ValueError):
        explorer.find_symbol(" ")


def test_hybrid_retrieval_opens_its_gates(explorer):
    got = {(r.kind, r.key): [s.source for s in r.sources] for r in explorer.hybrid_retrieve("documentation of readToken length guard helper", 20).collect()}
    assert got["symbol", "r/i2"] == ["conditional", "lexical", "structural"] and got["document", "1"] == ["documentation"] and ("commit", "2") not in got
    got = {(r.kind, r.key): [s.source for s in r.sources] for r in explorer.hybrid_retrieve("history change of readToken", 20, vector=[0.0, 1.0]).collect()}
    assert got["commit", "2"] == ["history"] and "semantic" in got["symbol", "r/i2"]
    with pytest.raises(ValueError):
        explorer.hybrid_retrieve("?", 5)


def test_inheritance_and_imports(explorer):
    assert rows(structure.inheritance_edges(explorer.files, explorer.records).select("child", "parent", "kind", "parent_id")) == [("Reader", "Base", "extends", None)]
    assert rows(structure.import_uses(explorer.files).where("file = 'src/reader.ts'").select("line", "name", "import_line", "specifier")) == [(5, "helper", 1, "./helper.js")]
