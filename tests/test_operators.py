import random
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from orefield.functions.text import joined_path, question_terms, terms_of
from orefield.operators import evaluation, evidence, graph, history, ranking, reviews, structure
from orefield.operators.extraction import declared_names, python_index
from orefield.operators.latest import current_files, latest_by
from orefield.sources.search import glob_files, glob_pattern, grep_lines, json_entries


def test_terms_split_camel_case_and_are_distinct(spark):
    text = "readToken reads a TOKEN, x 12 readToken é"
    assert question_terms(text) == ["read", "token", "reads", "12"]
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(terms_of(F.col("t"))).collect()[0][0] == ["read", "token", "reads", "12"]


def test_gates():
    assert ranking.signals(["guard"]) == ["lexical", "structural", "conditional"]
    assert ranking.signals(["history", "script"]) == ["lexical", "structural", "configuration"]
    assert ranking.signals(["history"], hybrid=True) == ["lexical", "structural", "semantic", "history"]
    assert "configuration" in ranking.signals(["test", "command"]) and "configuration" not in ranking.signals(["test"])


def test_distributed_row_number_equals_a_sort(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(5)) for i in range(500)]
    got = ranking.with_row_number(spark.createDataFrame(data, "id int, score int").repartition(7), [F.desc("score"), F.asc("id")]).select("id", "rank").collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert {r.id: r["rank"] for r in got} == want


def test_row_numbers_within_a_hot_partition(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot", "hot", "a", None]), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "id int, repo string, score int").repartition(5)
    got = {r.id: r["rank"] for r in ranking.with_row_number(df, [F.asc("score"), F.asc("id")], partition=("repo",)).collect()}
    want = {}
    for repo in ("hot", "a", None):
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((s, i) for i, r, s in data if r == repo))}
    assert got == want


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([("x", 1), ("Y", 2)], "id string, rank int")
    b = spark.createDataFrame([("Y", 1)], "id string, rank int")
    got = {r.id: (r.score, [tuple(s) for s in r.sources]) for r in ranking.fused({"lexical": a, "history": b}, ["id"]).collect()}
    assert got == {"x": (round(1 / 61, 12), [("lexical", 1)]), "Y": (round(1 / 62 + 3 / 61, 12), [("history", 1), ("lexical", 2)])}


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("r", *e) for e in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None), (None, "z"), ("a", "b")]], "k string, source string, target string")
    start = spark.createDataFrame([("r", "a"), ("r", "a")], "k string, node string")
    assert rows(graph.reachable(edges, start, ["k"]).select("node", "distance")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reachable(edges.limit(0), start, ["k"]).select("node")) == [("a",)]


def test_paths_are_resolved(spark):
    data = [("src/a", "./b.js"), ("src/a", "../c"), ("", "./x"), ("a", "../../y")]
    got = [r[0] for r in spark.createDataFrame(data, "d string, r string").select(joined_path(F.col("d"), F.col("r"))).collect()]
    assert got == ["src/a/b.js", "src/c", "x", "y"]


FILES = [
    ("r", "c1", "src/a.ts", "typescript", 'import { b } from "./b.js";\nexport function one() {\n  return two(one);\n}\nfunction two() {\n  return b();\n}\n'),
    ("r", "c1", "src/b.ts", "typescript", "export function b() {\r\n  throw new Error('x');\r\n}"),
    ("r", "c1", "src/é.py", "python", "import os.path as p\nclass A(B):\n    def __init__(self):\n        self.run()\n    async def run(self):\n        pass\n\ndef f():\n    return A()\n"),
    ("r", "c1", "src/bad.py", "python", "def f(:\n"),
    ("r", "c1", "src/none.go", "go", None),
]
RECORDS = [
    ("r", "c1", "i1", "src/a.ts", "one", "one", None, 2, 4, 30, 80), ("r", "c1", "i2", "src/a.ts", "two", "two", None, 5, 7, 81, 120),
    ("r", "c1", "i3", "src/b.ts", "b", "b", None, 1, 3, 0, 50),
]


def files(spark):
    return spark.createDataFrame(FILES, "repository string, commit_hash string, file string, language string, content string")


def records(spark):
    return spark.createDataFrame(RECORDS, "repository string, commit_hash string, id string, file string, name string, qualified_name string, parent_id string, sl int, el int, sb long, eb long")


def test_references_follow_the_ladder(spark):
    got = rows(structure.reference_edges(files(spark), records(spark)).select("file", "line", "name", "owner_id", "target_id", "resolution"))
    assert got == [("src/a.ts", 1, "b", None, "i3", "static"), ("src/a.ts", 3, "one", "i1", "i1", "static"), ("src/a.ts", 3, "two", "i1", "i2", "static"), ("src/a.ts", 6, "b", "i2", "i3", "static")]


def test_imported_names_never_fall_back(spark):
    code = 'import whole, { shared as mine, gone, type T } from "./lib.js";\nimport { far } from "outside";\nmine(); gone(); far(); free(); twice(); whole();\n'
    texts = [("r", "c", "src/m.ts", "typescript", code), ("r", "c", "src/lib.ts", "typescript", "shared\n"), ("r", "c", "p/q.py", "python", "from .w import deep as d\nd()\n"), ("r", "c", "p/w.py", "python", "x\n")]
    names = [("lib-shared", "src/lib.ts", "shared"), ("own-mine", "src/x.ts", "mine"), ("own-gone", "src/x.ts", "gone"), ("own-far", "src/x.ts", "far"), ("free", "src/x.ts", "free"), ("t1", "src/x.ts", "twice"), ("t2", "src/y.ts", "twice"), ("deep", "p/w.py", "deep"), ("whole", "src/x.ts", "whole")]
    known = spark.createDataFrame([("r", "c", i, f, n, 90, 95, 0, 9) for i, f, n in names], "repository string, commit_hash string, id string, file string, name string, sl int, el int, sb long, eb long")
    df = spark.createDataFrame(texts, "repository string, commit_hash string, file string, language string, content string")
    bound = {(r.name, r.imported, r.target_file) for r in structure.import_bindings(df).collect()}
    assert bound == {("mine", "shared", "src/lib.ts"), ("gone", "gone", "src/lib.ts"), ("T", "T", "src/lib.ts"), ("whole", "default", "src/lib.ts"), ("far", "far", None), ("d", "deep", "p/w.py")}
    got = {(r.name, r.target_id, r.resolution) for r in structure.reference_edges(df, known).where("line > 1").collect()}
    assert got >= {("mine", "lib-shared", "static"), ("gone", None, "unresolved"), ("far", None, "unresolved"), ("free", "free", "heuristic"), ("twice", None, "unresolved"), ("whole", None, "unresolved"), ("d", "deep", "static")}


def test_modules_resolve_to_the_first_candidate(spark):
    assert rows(structure.module_edges(files(spark)).select("specifier", "target_file", "resolution")) == [("./b.js", "src/b.ts", "static"), ("os.path", None, "unresolved")]
    texts = {
        "a/x.ts": 'import y from "./y";\nconst z = require("../b/z");\nimport "./d";\nexport { q } from "./n.mjs";', "a/y.ts": "", "a/y.js": "", "b/z/index.js": "", "a/d.cjs": "", "a/n.py": "",
        "p/m.py": "from . import k\nfrom .s.t import u\nfrom ..top import v\nimport p.s\nimport nowhere", "p/__init__.py": "", "p/s/t.py": "", "p/s/__init__.py": "", "top.py": "",
        "w/i.php": "<?php\nrequire_once __DIR__ . '/lib/c.php';\ninclude('./d.php');\ninclude 'e.php';", "w/lib/c.php": "", "w/d.php": "",
    }
    language = {"ts": "typescript", "js": "javascript", "cjs": "javascript", "py": "python", "php": "php"}
    df = spark.createDataFrame([("r", "c", f, language[f.rsplit(".")[-1]], t) for f, t in texts.items()], "repository string, commit_hash string, file string, language string, content string")
    got = {(r.file, r.specifier): r.target_file for r in structure.module_edges(df).collect()}
    assert got == {
        ("a/x.ts", "./y"): "a/y.ts", ("a/x.ts", "../b/z"): "b/z/index.js", ("a/x.ts", "./d"): "a/d.cjs", ("a/x.ts", "./n.mjs"): "a/n.py", ("p/m.py", "."): "p/__init__.py", ("p/m.py", ".s.t"): "p/s/t.py", ("p/m.py", "..top"): "top.py",
        ("p/m.py", "p.s"): "p/s/__init__.py", ("p/m.py", "nowhere"): None, ("w/i.php", "/lib/c.php"): "w/lib/c.php", ("w/i.php", "./d.php"): "w/d.php", ("w/i.php", "e.php"): None,
    }


def test_structural_scores_count_uses_imports_and_tests(spark):
    texts = [("r", "c", "a.ts", "typescript", 'import { tokenOf } from "./token.js";\nfunction one() {\n  tokenOf(tokenOf);\n}\ntest("reads a token", () => {\n});'), ("r", "c", "token.ts", "typescript", "export function tokenOf() {\n}")]
    df = spark.createDataFrame(texts, "repository string, commit_hash string, file string, language string, content string")
    known = spark.createDataFrame([("r", "c", "one", "a.ts", "one", 2, 4, 40, 80), ("r", "c", "around", "a.ts", "around", 1, 6, 0, 120), ("r", "c", "tok", "token.ts", "tokenOf", 1, 2, 0, 40)], "repository string, commit_hash string, id string, file string, name string, sl int, el int, sb long, eb long")
    # the import line: target 3, owner 2; line 3: a call (6, 4) and a reference (3, 2); the module: 1 each; the test: 1
    assert rows(structure.structural_scores(df, known, ["token"]).select("id", "score")) == [("around", 2 + 1 + 1), ("one", 4 + 2 + 1), ("tok", 3 + 6 + 3 + 1)]


def test_smallest_and_latest_owner(spark):
    nested = spark.createDataFrame([("r", "c", "outer", "f", 1, 9, 0, 90), ("r", "c", "inner", "f", 3, 5, 20, 50)], "repository string, commit_hash string, id string, file string, sl int, el int, sb long, eb long")
    uses = spark.createDataFrame([("r", "c", "f", 4), ("r", "c", "f", 8), ("r", "c", "f", 12)], "repository string, commit_hash string, file string, line int")
    for smallest in (False, True):
        assert rows(structure.owned(uses, nested, smallest).select("line", "owner_id")) == [(12, None), (4, "inner"), (8, "outer")]


def test_python_lines(spark):
    got = rows(python_index(files(spark)).where("file != 'src/bad.py'").select("line", "kind", "name"))
    assert got == [(1, "import", "os.path"), (2, "class", "A"), (2, "extends", "B"), (3, "constructor", "__init__"), (5, "method", "run"), (8, "function", "f")]


def test_guards_production_and_missing_languages(spark):
    text = "if (b) {\n}\nif (a) {\n}\nif (b) {\n}"
    df = spark.createDataFrame([("r", "c", f, None, text) for f in ("x.ts", "tests/x.ts", "a.test.js", "b.rb", "c.RB")], "repository string, commit_hash string, file string, language string, content string")
    known = spark.createDataFrame([("r", "c", "i", "x.ts", "x", 1, 6, 0, 90)], "repository string, commit_hash string, id string, file string, name string, sl int, el int, sb long, eb long")
    assert rows(structure.guard_lists(df, known).select("id", "guards")) == [("i", ["b", "a"])]
    assert [r.file for r in structure.production_files(df).orderBy("file").collect()] == ["b.rb", "c.RB", "x.ts"]
    assert rows(structure.missing_languages(df)) == [(".rb", 2)]


def test_lexical_scores_and_scripts(spark):
    known = spark.createDataFrame([("r", "c", "i", "lib/token.ts", "readX", "A.readX", "function readX(token)", 2, 3, 0, 9), ("r", "c", "j", "q.ts", "n", "n", "n", None, None, 0, 9)], "repository string, commit_hash string, id string, file string, name string, qualified_name string, signature string, sl int, el int, sb long, eb long")
    df = spark.createDataFrame([("r", "c", "lib/token.ts", "typescript", "token\nx\ncursor")], "repository string, commit_hash string, file string, language string, content string")
    assert rows(ranking.lexical_scores(known, df, ["read", "token", "cursor"]).select("id", "score")) == [("i", 8 + 2 * 3 + 2 + 1)]
    docs = spark.createDataFrame([(1, '{"scripts": {"test": "run tests", "x": ["test"], "b": "build"}}', "package.json"), (2, "no", None), (3, None, None), (4, '{"scripts": 3}', "p")], "doc_id int, text string, path string")
    assert rows(ranking.script_scores(docs, ["test", "package", "run"])) == [(1, "/scripts/b", "build", 2), (1, "/scripts/test", "run tests", 6)]


def test_coverage_by_place(spark):
    need = [("a.ts", 2, "x  = 1"), ("a.ts", 9, "x = 1"), (None, None, "y"), ("b.ts", None, "y"), ("a.ts", 1, ""), (None, None, "gone"), (None, 2, "x = 1")]
    items = spark.createDataFrame([(1, "m", "ts", need)], "item_id long, manifest string, language string, required array<struct<file: string, line: int, text: string>>")
    lines = spark.createDataFrame([("a.ts", 1, " "), ("a.ts", 2, " x = 1 "), ("a.ts", 3, "y")], "file string, line int, text string")
    got = evidence.line_coverage(items, lines)
    assert rows(got) == [(1, "m", "ts", 7, 4, 2, 1)]
    assert rows(evidence.alternatives_covered(got)) == [("m", "ts", 1, 0, 0, 0)]


def test_fidelity_and_foreign_owners(spark):
    want = spark.createDataFrame([("q", 0, "a", 1, "x"), ("q", 1, "b", 2, None), ("p", 0, "a", 1, "x")], "k string, position int, file string, line int, text string")
    got = spark.createDataFrame([("q", 0, "a", 1, "x"), ("q", 1, "b", 2, "y"), ("q", 2, "c", 3, "z"), ("p", 0, "a", 1, "x")], "k string, position int, file string, line int, text string")
    assert rows(evidence.record_fidelity(want, got, ["k"], ["file", "line", "text"])) == [("p", 1, 1, True, 0), ("q", 2, 1, False, 1)]
    cited = spark.createDataFrame([("t", "a", 5, "a", 1, "a", 1), ("t", "b", 6, "b", 2, "a", 1), ("t", "b", 6, "b", 2, "a", 1), ("t", "c", 7, None, None, "a", 1), ("u", "c", 7, "c", 1, None, None)], "g string, file string, line int, owner_file string, owner_line int, target_file string, target_line int")
    assert rows(evidence.foreign_owners(cited, ["g"])) == [("t", "b", 6)]


def test_declared_names(spark):
    assert rows(declared_names(files(spark)).where("language = 'typescript'").select("file", "line", "name")) == [("src/a.ts", 2, "one"), ("src/a.ts", 5, "two"), ("src/b.ts", 1, "b")]


def test_outline_numbers_repeated_names(spark):
    data = [("r", "c", "a", "f", "x", None, 0, 90), ("r", "c", "b", "f", "x", "a", 10, 20), ("r", "c", "d", "f", "y", "a", 30, 40)]
    df = spark.createDataFrame(data, "repository string, commit_hash string, id string, file string, qualified_name string, parent_id string, sb long, eb long")
    assert rows(structure.outline(df).select("id", "depth", "seq", "unique_name")) == [("a", 0, 1, "x"), ("b", 1, 2, "x#2"), ("d", 1, 3, "y")]
    deep = spark.createDataFrame([("r", "c", "a", "f", "x", None, 0, 90), ("r", "c", "b", "f", "y", "a", 10, 50), ("r", "c", "d", "f", "z", "b", 20, 30), ("r", "c", "e", "g", "z", "a", 0, 5), ("r", "c", "m", "f", "m", "n", 60, 70), ("r", "c", "n", "f", "n", "m", 61, 65)], df.schema)
    assert rows(structure.outline(deep).select("id", "depth")) == [("a", 0), ("b", 1), ("d", 2), ("e", 0), ("m", 0), ("n", 0)]


@pytest.mark.parametrize("glob,path,hit", [("**/*.ts", "a/b.ts", 1), ("**/*.ts", "b.ts", 1), ("*.ts", "a/b.ts", 0), ("src/{a,b}/?.py", "src/b/x.py", 1), ("src/{a,b}/?.py", "src/c/x.py", 0), ("a+b.ts", "aab.ts", 0)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(glob_pattern(glob), path)) == bool(hit)


def test_search_over_files(spark):
    assert [r.line for r in grep_lines(files(spark), "throw new").collect()] == [2]
    assert glob_files(files(spark), "src/*.ts").count() == 2
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}'), (2, '{"a": 1}\n{"b": 2}'), (3, '{"a": '), (4, None), (5, "")], "doc_id int, text string")
    assert rows(json_entries(docs)) == [(1, "a"), (1, "b")]


def test_latest_row_ties_and_hot_keys(spark):
    data = [("k", 1, "b"), ("k", 1, "a"), ("k", 0, "z"), (None, 5, "n")] * 3
    assert rows(latest_by(spark.createDataFrame(data, "k string, at int, v string"), ["k"], ["at"], ["v"])) == [("k", "b"), (None, "n")]


def test_current_files_take_the_extension_where_language_is_missing(spark):
    at = datetime(2025, 1, 1)
    data = [("r", "c", "a.ts", None, "x", at, at), ("r", "c", "b.py", " PYTHON ", "y", at, at), ("r", "c", "b.py", "go", "z", datetime(2024, 1, 1), at)]
    df = spark.createDataFrame(data, "repository string, commit_hash string, file string, language string, content string, captured_at timestamp, loaded_at timestamp")
    assert rows(current_files(df).select("file", "language", "content")) == [("a.ts", "typescript", "x"), ("b.py", "python", "y")]


STATE = "repository string, id string, file string, qualified_name string, content_hash string, current_status string, retries int, retry_after long, active int"


def states(spark, data):
    return spark.createDataFrame(data, STATE)


def test_states_after_reviews_and_decisions(spark):
    df = spark.createDataFrame([("r", "1", "stale", None, None, 2, 9), ("r", "2", "failed", None, "h", 1, 5)], "repository string, id string, current_status string, last_reviewed_at timestamp, last_reviewed_hash string, retries int, retry_after long")
    told = spark.createDataFrame([("a", "1", datetime(2025, 1, 1), "old", "open"), ("b", "1", datetime(2025, 1, 2), "new", "open")], "id string, symbol_id string, created_at timestamp, reviewed_hash string, human_status string")
    assert rows(reviews.after_review(df, told)) == [("r", "1", "reviewed", datetime(2025, 1, 2), "new", 0, 0), ("r", "2", "failed", None, "h", 1, 5)]
    assert [r.id for r in reviews.newest_findings(told.withColumn("severity", F.lit("low")), most=1).collect()] == ["b"]
    choice = spark.createDataFrame([("a", "accepted", 1), ("a", "rejected", 2)], "id string, decision string, at int")
    assert rows(reviews.decided(told, choice).select("id", "human_status")) == [("a", "rejected"), ("b", "open")]
    for wrong in (("z", "accepted", 1), ("a", "maybe", 1)):
        with pytest.raises(ValueError):
            reviews.decided(told, spark.createDataFrame([wrong], "id string, decision string, at int"))


def test_queue_order_and_eligibility(spark):
    df = states(spark, [
        ("r", "1", "f", "a", "h", "stale", 0, 0, 1), ("r", "2", "f", "b", "h", "pending", 0, 0, None), ("r", "3", "f", "c", "h", "failed", 2, 50, 1),
        ("r", "4", "f", "d", "h", "failed", 3, 0, 1), ("r", "5", "f", "e", "h", "failed", 0, 200, 1), ("r", "6", "f", "f", "h", "pending", 0, 0, 0), ("r", "7", "f", "g", "h", "reviewed", 0, 0, 1),
    ])
    assert [r.id for r in reviews.queue(df, 100).orderBy("position").collect()] == ["2", "1", "3"]
    assert {(r.state, r.n) for r in reviews.status_counts(df).collect()} == {("pending", 1), ("stale", 1), ("reviewed", 1), ("failed", 3), ("inactive", 1)}
    assert reviews.queue(df.limit(0), 100).count() == 0


def test_reconciliation(spark):
    a, b = "a" * 64, "b" * 64
    before = states(spark, [("r", i, "f", "n", a, s, n, 0, act) for i, s, n, act in [("same", "reviewed", 2, 1), ("changed", "reviewed", 2, 1), ("new-pending", "pending", 1, 1), ("gone", "failed", 1, 1), ("back", "reviewed", 0, 0)]])
    after = states(spark, [("r", i, "f", "n", h, "x", 0, 0, 1) for i, h in [("same", a.upper()), ("changed", b), ("new-pending", b), ("added", a), ("back", a)]])
    got = {r.id: (r.status, r.retries, r.active) for r in reviews.reconciled(before, after).collect()}
    assert got == {"same": ("reviewed", 2, 1), "changed": ("stale", 0, 1), "new-pending": ("pending", 0, 1), "gone": ("failed", 1, 0), "back": ("stale", 0, 1), "added": ("pending", 0, 1)}


def test_normalized_reviews_set_unknown_words_right(spark):
    data = [("1", '{"verdict":"FINDING","severity":"awful","confidence":0.85,"issues":[1,2],"needs_broader_context":true}'), ("2", '{"confidence":"medium"}'), ("3", "no json"), ("4", None)]
    df = spark.createDataFrame([(i, "s", "m", j) for i, j in data], "id string, symbol_id string, model string, result_json string")
    got = {r.id: (r.verdict, r.severity, r.confidence, r.issues, r.broader) for r in reviews.normalized_reviews(df).collect()}
    assert got == {"1": ("finding", "none", "high", 2, 1), "2": ("skip", "none", "medium", 0, None), "3": ("skip", "none", "low", 0, None)}


def test_packing_keeps_the_bounds_and_counts_the_rest(spark):
    text = "\n".join(f"cursor {n} " + "x" * 300 for n in range(40))
    got = evidence.packed_windows(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), ["id"], "text", ["cursor"]).collect()
    assert len(got) == 7 and all(len(r.line_text) == 180 and r.left_out == 33 for r in got)


def test_history_of_logs(spark):
    at = datetime(2025, 1, 1)
    docs = spark.createDataFrame([(1, "Fix readToken cursor\n\nwhy\n M src/a.ts\n A src/cursor.ts", "commit_log", "r", at), (2, "Other\n M src/a.ts", "commit_log", "r", datetime(2025, 1, 2)), (3, None, "commit_log", "r", at), (4, "x", "issue", "r", at)], "doc_id int, text string, source string, repository string, created_at timestamp")
    log = history.commits(docs)
    assert rows(history.introductions(log).select("path", "introduced", "latest", "commits")) == [("src/a.ts", 1, 2, 2), ("src/cursor.ts", 1, 1, 1)]
    assert rows(history.recent_changes(log, 1).select("doc_id", "rank", "files")) == [(2, 1, 1)]
    names = spark.createDataFrame([("r", "i", "src/a.ts"), ("r", "j", "src/none.ts")], "repository string, id string, file string")
    assert rows(history.symbol_history(log, names)) == [("r", "i", 1, 2), ("r", "i", 2, 1)]
    assert rows(history.token_search(log, ["cursor", "token"]).select("doc_id", "score")) == [(1, 13)]


def test_metrics(spark):
    data = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.0, 1.0]), (3, 1, [0.8, 0.3]), (20, 2, [0.1, 0.9]), (21, 2, None), (22, 2, [0.0, 0.0])]
    ranks = evaluation.neighbour_ranks(spark.createDataFrame(data, "vec_id int, label int, embedding array<float>"), every=20, k=2)
    assert rows(ranks.select("query_id", "vec_id", "rank")) == [(0, 1, 1), (0, 3, 2), (20, 2, 1), (20, 3, 2)]
    got = {r.query_label: (r.queries, r.precision, r.mrr) for r in evaluation.retrieval_metrics(ranks).collect()}
    assert got == {1: (1, 1.0, 1.0), 2: (1, 0.5, 1.0), None: (2, 0.75, 1.0)}


def test_selection_is_checked_against_exact_quotes(spark):
    lines = spark.createDataFrame([("q", 1, "a  = b"), ("q", 4, "c()"), ("p", 2, "x")], "question string, line int, line_text string")
    refs = evidence.numbered(lines, ["question"], ["line"])
    assert rows(refs.select("question", "line", "ref")) == [("p", 2, "E1"), ("q", 1, "E1"), ("q", 4, "E2")]
    chosen = spark.createDataFrame([("q", "E1", "a = b"), ("q", "E1", "a = b"), ("q", "E2", "d()"), ("q", "E9", "x"), ("p", "E1", None)], "question string, ref string, quote string")
    assert rows(evidence.checked_selection(chosen, refs, ["question"]).select("question", "ref", "state")) == [("p", "E1", "empty quote"), ("q", "E1", "valid"), ("q", "E2", "quote not found"), ("q", "E9", "unknown reference")]
    gaps = evidence.missing_requirements(lines, ["question"], {"call": (r"\w+\(", 1), "assignment": ("=", 2)})
    assert rows(gaps.select("question", "requirement", "found", "missing")) == [("p", "assignment", 0, 1), ("p", "call", 0, 1), ("q", "assignment", 1, 1), ("q", "call", 1, 0)]
