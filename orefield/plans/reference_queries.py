"""Registered queries of the reference's operators over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orefield.functions.text import question_terms
from orefield.operators import evaluation, evidence, extraction, graph, history, ranking, reviews, snapshots, structure
from orefield.operators.latest import current_files, current_records, current_reviews, current_states, latest_by
from orefield.sources import search
from orefield.plans.training_queries import P2_SQL
from orefield.session import stored
from orefield.sources.tables import table

QUESTION = "Which documentation of the validator snapshot mentions readToken or the commit history of the cursor?"
TERMS = question_terms(QUESTION)
#: Epoch milliseconds at which the queue is looked at.
NOW_MS = 1_742_000_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


# Parts of the SQL: current rows of the tables.
EXT = "CASE regexp_extract(file, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'php' THEN 'php' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"
LANG = f"coalesce(nullif(lower(trim(language)), ''), {EXT})"
FILES = f"""files AS (SELECT repository, commit_hash, file, {LANG} AS language, content FROM (
  SELECT *, row_number() OVER (PARTITION BY repository, commit_hash, file ORDER BY captured_at DESC, loaded_at DESC, content DESC, language DESC NULLS LAST) AS rn
  FROM source_files) WHERE rn = 1)"""
LINES = """lines AS (SELECT repository, commit_hash, file, language, unnest(parts) AS text, generate_subscripts(parts, 1)::INT AS line FROM (
  SELECT *, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM files))"""
RECORDS = f"""records AS (SELECT repository, commit_hash, id, file, {LANG} AS language, kind, name, qualified_name, parent_id, signature,
    "range"."start"."line" AS sl, "range"."end"."line" AS el, "range"."start"."byte" AS sb, "range"."end"."byte" AS eb FROM (
  SELECT *, row_number() OVER (PARTITION BY repository, commit_hash, id ORDER BY indexed_at DESC) AS rn FROM symbol_records) WHERE rn = 1)"""
REVIEWS = "rv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS rn FROM reviews WHERE id IS NOT NULL) WHERE rn = 1)"
STATES = "st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repository, snapshot_no, id ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM symbols) WHERE rn = 1)"

LASTS = """lasts AS (SELECT repository, snapshot_no, row_number() OVER (PARTITION BY repository ORDER BY snapshot_no DESC) - 1 AS back FROM (
  SELECT DISTINCT repository, snapshot_no FROM symbols WHERE repository IS NOT NULL AND snapshot_no IS NOT NULL))"""


def own_last(back: int = 0, columns: str = "repository, snapshot_no") -> str:
    """Rows of each repository's own last snapshot, or of one before it."""
    return f"({columns}) IN (SELECT (repository, snapshot_no) FROM lasts WHERE back = {back})"


def digest(column: str) -> str:
    return f"regexp_replace(lower(regexp_replace({column}, '\\s', '', 'g')), '^sha-?256[:=]', '')"


def any_hits(column: str, terms: list[str], weight: int = 1) -> str:
    return " + ".join(f"(CASE WHEN contains(lower({column}), '{t}') THEN {weight} ELSE 0 END)" for t in terms)


def _files(spark, folder):
    return current_files(table(spark, folder, "source_files"))


def _records(spark, folder):
    return current_records(table(spark, folder, "symbol_records"))


def _reviews(spark, folder):
    return current_reviews(table(spark, folder, "reviews"))


def _states(spark, folder):
    return current_states(table(spark, folder, "symbols"))


def _last_states(spark, folder, back=0):
    """States of each repository's own last snapshot, or of one before it."""
    return snapshots.of_last_snapshot(_states(spark, folder), table(spark, folder, "symbols"), back)


# Retrieval

LEXICAL = f"""lexical AS (SELECT * FROM (SELECT repository, commit_hash, id, {" + ".join(any_hits(c, TERMS, w) for c, w in (("names", 8), ("signature", 3), ("file", 2), ("body", 1)))} AS score FROM (
  SELECT r.*, r.name || ' ' || r.qualified_name AS names, array_to_string(string_split(replace(replace(f.content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[r.sl:r.el], chr(10)) AS body
  FROM records r LEFT JOIN files f USING (repository, commit_hash, file))) WHERE score > 0)"""


@query(f"WITH {FILES}, {RECORDS}, {LEXICAL} SELECT repository, commit_hash, id, score FROM lexical")
def lexical_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted substring score of every declaration for a question's terms: in its names, signature, path and body."""
    return ranking.lexical_scores(_records(spark, folder), _files(spark, folder), TERMS)


@query(f"""SELECT doc_id, score, f.line AS line, trim(f.text, ' ') AS excerpt FROM (
  SELECT doc_id, ({any_hits('text', TERMS)}) AS score, list_filter(list_transform(p, lambda x, i: struct_pack(line := i::INT, text := x)), lambda s: ({any_hits('s.text', TERMS)}) > 0)[1] AS f
  FROM (SELECT doc_id, text, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents WHERE source = 'repo_docs')) WHERE score >= 2""")
def documentation_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation with at least two of the terms and its first matching line."""
    docs = table(spark, folder, "documents").where("source = 'repo_docs'")
    return ranking.document_matches(docs, TERMS).select("doc_id", "score", "line", "excerpt")


_RRF = f"""WITH base AS (SELECT doc_id, ({any_hits('text', TERMS)}) + 2 * ({any_hits('source', TERMS)}) AS lex, ({any_hits('path', TERMS)}) + ({any_hits('repository', TERMS)}) AS str FROM documents),
 l AS (SELECT doc_id, row_number() OVER (ORDER BY lex DESC, doc_id) AS rank FROM base WHERE lex > 0),
 s AS (SELECT doc_id, row_number() OVER (ORDER BY str DESC, doc_id) AS rank FROM base WHERE str > 0),
 u AS (SELECT doc_id, 'lexical' AS source, rank FROM l UNION ALL SELECT doc_id, 'structural', rank FROM s)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, string_agg(source || ':' || rank, ',' ORDER BY source) AS sources FROM u GROUP BY doc_id"""


@query(_RRF)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked lists over all documents, fused by reciprocal rank."""
    docs = table(spark, folder, "documents")
    base = docs.select("doc_id", ranking.term_score(TERMS, {"text": 1, "source": 2}).alias("lexical"), ranking.term_score(TERMS, {"path": 1, "repository": 1}).alias("structural"))
    base = stored(base)  # both lists read the scores; the texts are read once
    lists = {n: ranking.with_row_number(base.where(F.col(n) > 0).select("doc_id", n), [F.desc(n), F.asc("doc_id")]) for n in ("lexical", "structural")}
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["rank"])), ",")
    return ranking.fused(lists, ["doc_id"]).select("doc_id", "score", sources.alias("sources"))


@query("""WITH e AS (SELECT * FROM (SELECT symbol_id, embedding, row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC) AS rn FROM semantic_entries) WHERE rn = 1 AND embedding IS NOT NULL AND len(embedding) = 72),
 good AS (SELECT symbol_id, embedding::DOUBLE[] AS v FROM e WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 q AS (SELECT v FROM good ORDER BY symbol_id LIMIT 1)
 SELECT symbol_id, round(list_dot_product(good.v, q.v) / (sqrt(list_dot_product(good.v, good.v)) * sqrt(list_dot_product(q.v, q.v))), 5) AS score FROM good, q ORDER BY score DESC, symbol_id LIMIT 100""")
def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Exact cosine search with one query vector (the first symbol's); the top 100 is the operator's bound."""
    entries = latest_by(table(spark, folder, "semantic_entries"), ["symbol_id"], ["indexed_at"], ["embedding"]).where("embedding is not null and size(embedding) = 72")
    probe = entries.where(ranking.usable_vector("embedding", 72)).orderBy("symbol_id").limit(1).select("embedding").first()
    if probe is None:
        return entries.select("symbol_id", F.lit(None).cast("double").alias("score")).limit(0)
    return ranking.nearest_by_cosine(entries, probe["embedding"]).select("symbol_id", "score")


@query(f"""WITH w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g') AS t FROM documents),
 x AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(trim(t)), ' '), lambda a: length(a) > 1)) AS terms FROM w)
 SELECT term, count(*) AS documents FROM (SELECT doc_id, unnest(terms) AS term FROM x) GROUP BY term""")
def term_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each term occurs."""
    from orefield.functions.text import terms_of

    return table(spark, folder, "documents").select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


@query("SELECT doc_id, unnest(json_keys(text)) AS key FROM documents WHERE regexp_matches(text, '^\\s*\\{') AND json_valid(text)")
def config_json_keys(spark: SparkSession, folder: str) -> DataFrame:
    """First-level keys of JSON documents."""
    return search.json_entries(table(spark, folder, "documents"))


# Structure

@query(f"WITH {RECORDS} SELECT repository, id, name, CASE WHEN name = 'readToken' OR qualified_name = 'readToken' THEN 1 ELSE 2 END AS match FROM records WHERE name = 'readToken' OR qualified_name = 'readToken' OR contains(lower(qualified_name), 'readtoken')")
def symbol_match(spark: SparkSession, folder: str) -> DataFrame:
    return structure.symbol_matches(_records(spark, folder), "readToken").select("repository", "id", "name", "match")


@query(f"""WITH RECURSIVE {RECORDS}, e AS (SELECT c.repository, c.commit_hash, c.file, c.parent_id, c.id FROM records c JOIN records p ON p.repository = c.repository AND p.commit_hash = c.commit_hash AND p.file = c.file AND p.id = c.parent_id),
 walk AS (SELECT repository, commit_hash, file, id, 0 AS depth FROM records r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repository = r.repository AND e.commit_hash = r.commit_hash AND e.file = r.file AND e.id = r.id)
  UNION ALL SELECT e.repository, e.commit_hash, e.file, e.id, w.depth + 1 FROM walk w JOIN e ON e.repository = w.repository AND e.commit_hash = w.commit_hash AND e.file = w.file AND e.parent_id = w.id)
 SELECT r.repository, r.commit_hash, r.file, r.id, coalesce(w.depth, 0)::INT AS depth,
 row_number() OVER (PARTITION BY r.repository, r.commit_hash, r.file ORDER BY r.sb, r.eb DESC, r.id)::INT AS seq,
 row_number() OVER (PARTITION BY r.repository, r.commit_hash, r.file, r.qualified_name ORDER BY r.sb, r.eb DESC, r.id)::INT AS occurrence
 FROM records r LEFT JOIN walk w USING (repository, commit_hash, file, id)""")
def file_outline(spark: SparkSession, folder: str) -> DataFrame:
    return structure.outline(_records(spark, folder)).select("repository", "commit_hash", "file", "id", "depth", "seq", "occurrence")


def quoted(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_PLACED = "repository, commit_hash, file"
_NAME = "([A-Za-z_$][A-Za-z0-9_$]*)"
_CANDIDATES = ", ".join(["(0, 0, '')", *[f"({n + 1}, 1, '{e}')" for n, e in enumerate(structure.MODULE_EXTENSIONS)], *[f"({n + 10}, 2, '{e}')" for n, e in enumerate(structure.MODULE_EXTENSIONS)], "(0, 3, '.py')", "(1, 3, '/__init__.py')", "(0, 4, '')"])
#: Modules (the SQL follows ``./`` and one dot; no specifier of the tables goes up).
MODULES = f"""mods AS (SELECT * FROM (SELECT {_PLACED}, line, language, CASE WHEN language IN ('typescript', 'javascript') THEN regexp_extract(text, {quoted(structure.SCRIPT_MODULE)}, 1)
   WHEN language = 'python' THEN coalesce(nullif(regexp_extract(text, {quoted(structure.PYTHON_MODULE)}, 1), ''), regexp_extract(text, {quoted(structure.PYTHON_MODULE)}, 2)) WHEN language = 'php' THEN regexp_extract(text, {quoted(structure.PHP_MODULE)}, 1) END AS specifier FROM lines) WHERE specifier <> ''),
 based AS (SELECT *, regexp_replace(file, '/?[^/]*$', '') AS dir, CASE WHEN language = 'python' THEN replace(regexp_replace(specifier, '^\\.+', ''), '.', '/') ELSE regexp_replace(specifier, '^\\.?/', '') END AS rest FROM mods),
 cand AS (SELECT b.*, p.pr, ltrim(CASE p.how WHEN 0 THEN dir || '/' || rest WHEN 1 THEN regexp_replace(dir || '/' || rest, '\\.(ts|tsx|js|mjs|cjs|php|py|go|rs)$', '') || p.sx WHEN 2 THEN dir || '/' || rest || '/index' || p.sx
    WHEN 3 THEN CASE WHEN specifier LIKE '.%' THEN dir || '/' ELSE '' END || rest || p.sx ELSE dir || '/' || rest END, '/') AS target FROM based b, (VALUES {_CANDIDATES}) p(pr, how, sx) WHERE CASE language WHEN 'python' THEN p.how = 3 AND (rest <> '' OR p.pr = 1) WHEN 'php' THEN p.how = 4 ELSE p.how < 3 END),
 meant AS (SELECT c.repository, c.commit_hash, c.file, c.line, c.specifier, arg_min(c.target, c.pr) AS target_file FROM cand c JOIN files ON files.repository = c.repository AND files.commit_hash = c.commit_hash AND files.file = c.target GROUP BY ALL),
 modules AS (SELECT mods.repository, mods.commit_hash, mods.file, mods.line, mods.specifier, target_file FROM mods LEFT JOIN meant USING ({_PLACED}, line, specifier))"""
BINDINGS = f"""bnd0 AS (SELECT {_PLACED}, line, unnest(string_split(CASE WHEN language IN ('typescript', 'javascript') THEN regexp_extract(text, {quoted(structure.NAMED_IMPORT)}, 1) WHEN language = 'python' THEN regexp_extract(text, {quoted(structure.FROM_IMPORT)}, 1) END, ',')) AS c FROM lines WHERE contains(text, 'import ')),
 bnd1 AS (SELECT {_PLACED}, line, regexp_extract(c, '{_NAME}\\s*$', 1) AS name, regexp_extract(regexp_replace(c, '^\\s*type ', ''), '{_NAME}', 1) AS imported FROM bnd0 WHERE trim(c) <> ''
  UNION ALL SELECT {_PLACED}, line, regexp_extract(text, {quoted(structure.DEFAULT_IMPORT)}, 1), 'default' FROM lines WHERE language IN ('typescript', 'javascript')),
 bindings AS (SELECT {_PLACED}, name, arg_max(imported, row(line, imported)) AS imported, arg_max(coalesce(target_file, ''), row(line, imported)) AS target_file FROM bnd1 LEFT JOIN modules USING ({_PLACED}, line) WHERE name <> '' GROUP BY ALL)"""
EDGES = f"""{FILES}, {LINES}, {RECORDS}, {MODULES}, {BINDINGS},
 tok AS (SELECT repository, commit_hash, file, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*\\(?)', 1)) AS t FROM lines WHERE text <> ''),
 uses0 AS (SELECT repository, commit_hash, file, line, regexp_replace(t, '\\($', '') AS name, t LIKE '%(' AS is_call, count(*) AS n FROM tok GROUP BY ALL),
 uses AS (SELECT u.* FROM uses0 u WHERE (EXISTS (SELECT 1 FROM records r WHERE r.repository = u.repository AND r.commit_hash = u.commit_hash AND r.name = u.name)
    OR EXISTS (SELECT 1 FROM bindings b WHERE b.repository = u.repository AND b.commit_hash = u.commit_hash AND b.file = u.file AND b.name = u.name))
   AND NOT EXISTS (SELECT 1 FROM records r WHERE r.repository = u.repository AND r.commit_hash = u.commit_hash AND r.file = u.file AND r.sl = u.line AND r.name = u.name)),
 own AS (SELECT u.repository, u.commit_hash, u.file, u.line, u.name, u.is_call, r.id AS owner_id,
   row_number() OVER (PARTITION BY u.repository, u.commit_hash, u.file, u.line, u.name, u.is_call ORDER BY r.sb DESC, r.eb, r.id) AS rn
   FROM uses u JOIN records r ON r.repository = u.repository AND r.commit_hash = u.commit_hash AND r.file = u.file AND u.line BETWEEN r.sl AND r.el),
 loc AS (SELECT repository, commit_hash, file, name, min(id) AS id FROM records GROUP BY ALL HAVING count(*) = 1),
 wide AS (SELECT repository, commit_hash, name, min(id) AS id FROM records GROUP BY ALL HAVING count(*) = 1),
 bound AS (SELECT b.repository, b.commit_hash, b.file, b.name, l.id FROM bindings b LEFT JOIN loc l ON l.repository = b.repository AND l.commit_hash = b.commit_hash AND l.file = b.target_file AND l.name = b.imported),
 edges AS (SELECT u.*, o.owner_id, CASE WHEN b.name IS NOT NULL THEN b.id ELSE coalesce(l.id, w.id) END AS target_id,
   CASE WHEN b.name IS NOT NULL THEN CASE WHEN b.id IS NULL THEN 'unresolved' ELSE 'static' END WHEN l.id IS NOT NULL THEN 'static' WHEN w.id IS NOT NULL THEN 'heuristic' ELSE 'unresolved' END AS resolution
   FROM uses u LEFT JOIN (SELECT * FROM own WHERE rn = 1) o USING (repository, commit_hash, file, line, name, is_call)
   LEFT JOIN bound b ON b.repository = u.repository AND b.commit_hash = u.commit_hash AND b.file = u.file AND b.name = u.name
   LEFT JOIN loc l ON l.repository = u.repository AND l.commit_hash = u.commit_hash AND l.file = u.file AND l.name = u.name LEFT JOIN wide w ON w.repository = u.repository AND w.commit_hash = u.commit_hash AND w.name = u.name)"""


def _edges(spark, folder):
    return structure.reference_edges(_files(spark, folder), _records(spark, folder))


@query(f"WITH {EDGES} SELECT repository, commit_hash, file, line, name, is_call, n, owner_id, target_id, resolution FROM edges")
def references(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of declared names with their owner and target (the resolution ladder)."""
    return _edges(spark, folder).select("repository", "commit_hash", "file", "line", "name", "is_call", "n", "owner_id", "target_id", "resolution")


@query(f"""WITH {EDGES}, e AS (SELECT repository, commit_hash, owner_id AS source, target_id AS target, n FROM edges WHERE owner_id IS NOT NULL AND target_id IS NOT NULL),
 i AS (SELECT repository, commit_hash, target AS node, count(DISTINCT source) AS callers, sum(n)::BIGINT AS uses FROM e GROUP BY ALL), o AS (SELECT repository, commit_hash, source AS node, count(DISTINCT target) AS callees FROM e GROUP BY ALL)
 SELECT repository, commit_hash, node, coalesce(callers, 0) AS callers, coalesce(uses, 0) AS uses, coalesce(callees, 0) AS callees FROM i FULL JOIN o USING (repository, commit_hash, node)""")
def callers_and_callees(spark: SparkSession, folder: str) -> DataFrame:
    edges = _edges(spark, folder).select("repository", "commit_hash", F.col("owner_id").alias("source"), F.col("target_id").alias("target"), "n")
    return graph.neighbour_counts(edges, ["repository", "commit_hash"])


_HITS = any_hits("name", TERMS)
STRUCTURAL = f"""m AS (SELECT *, ({_HITS}) > 0 AS hit, CASE WHEN is_call THEN 2 ELSE 1 END AS twice FROM edges),
 dep AS (SELECT DISTINCT {_PLACED}, line, specifier, unnest(list_distinct([file, coalesce(target_file, file)])) AS touched FROM modules WHERE ({any_hits('specifier', TERMS)}) > 0),
 tst AS (SELECT t.repository, t.commit_hash, t.file, t.line, r.id, row_number() OVER (PARTITION BY t.repository, t.commit_hash, t.file, t.line ORDER BY r.eb - r.sb, r.sb, r.id) AS rn FROM (
   SELECT *, regexp_extract(text, {quoted(structure.TEST_TITLE)}, 1) AS title FROM lines) t JOIN records r ON r.repository = t.repository AND r.commit_hash = t.commit_hash AND r.file = t.file AND t.line BETWEEN r.sl AND r.el WHERE title <> '' AND ({any_hits('title', TERMS)}) > 0),
 parts AS (SELECT repository, commit_hash, target_id AS id, 3 * n * twice AS s FROM m WHERE hit AND target_id IS NOT NULL UNION ALL SELECT repository, commit_hash, owner_id, 2 * n * twice FROM m WHERE hit AND owner_id IS NOT NULL
  UNION ALL SELECT r.repository, r.commit_hash, r.id, 1 FROM dep JOIN records r ON r.repository = dep.repository AND r.commit_hash = dep.commit_hash AND r.file = dep.touched UNION ALL SELECT repository, commit_hash, id, 1 FROM tst WHERE rn = 1),
 structural AS (SELECT repository, commit_hash, id, sum(s)::BIGINT AS score FROM parts GROUP BY ALL)"""


@query(f"WITH {EDGES}, {STRUCTURAL} SELECT repository, commit_hash, id, score FROM structural")
def structural_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations by the uses, imports and tests around them whose names hold a question's term."""
    return structure.structural_scores(stored(_files(spark, folder)), stored(_records(spark, folder)), TERMS)  # both are read many times


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT repository, commit_hash, target_id AS source, owner_id AS target FROM edges WHERE owner_id IS NOT NULL AND target_id IS NOT NULL),
 walk AS (SELECT DISTINCT repository, commit_hash, id AS node FROM records WHERE name LIKE 'read%' UNION SELECT w.repository, w.commit_hash, e.target FROM walk w JOIN e ON e.repository = w.repository AND e.commit_hash = w.commit_hash AND e.source = w.node)
 SELECT repository, commit_hash, node FROM walk""")
def affected_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that uses a changed symbol, directly or not (changed: names starting with "read")."""
    key = ["repository", "commit_hash"]
    edges = _edges(spark, folder).select(*key, F.col("target_id").alias("source"), F.col("owner_id").alias("target"))
    start = _records(spark, folder).where("name like 'read%'").select(*key, F.col("id").alias("node"))
    return graph.reachable(edges, start, key).select(*key, "node")


@query(f"WITH {FILES}, {LINES}, {MODULES} SELECT {_PLACED}, line, specifier, target_file, CASE WHEN target_file IS NULL THEN 'unresolved' ELSE 'static' END AS resolution FROM modules")
def module_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return structure.module_edges(_files(spark, folder)).select("repository", "commit_hash", "file", "line", "specifier", "target_file", "resolution")


@query(f"""WITH {FILES}, {LINES}, {RECORDS} SELECT r.repository, r.commit_hash, r.id, b.text AS "before", f.text AS "first", a.text AS "after" FROM records r
 LEFT JOIN lines b ON b.repository = r.repository AND b.commit_hash = r.commit_hash AND b.file = r.file AND b.line = r.sl - 1
 LEFT JOIN lines f ON f.repository = r.repository AND f.commit_hash = r.commit_hash AND f.file = r.file AND f.line = r.sl
 LEFT JOIN lines a ON a.repository = r.repository AND a.commit_hash = r.commit_hash AND a.file = r.file AND a.line = r.el + 1
 WHERE b.text IS NOT NULL OR f.text IS NOT NULL OR a.text IS NOT NULL""")
def adjacent_lines(spark: SparkSession, folder: str) -> DataFrame:
    return structure.symbol_windows(_files(spark, folder), _records(spark, folder))


@query(f"""WITH {FILES}, {LINES}, t AS (SELECT repository, commit_hash, file, line FROM lines WHERE regexp_matches(text, 'throw new [A-Za-z]*Error')), {RECORDS},
 o AS (SELECT t.*, r.id AS owner_id, row_number() OVER (PARTITION BY t.repository, t.commit_hash, t.file, t.line ORDER BY r.eb - r.sb, r.sb, r.id) AS rn FROM t LEFT JOIN records r ON r.repository = t.repository AND r.commit_hash = t.commit_hash AND r.file = t.file AND t.line BETWEEN r.sl AND r.el)
 SELECT repository, commit_hash, file, line, owner_id FROM o WHERE rn = 1""")
def grep_smallest_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that match a regular expression and the smallest declaration that holds each."""
    hits = search.grep_lines(_files(spark, folder), "throw new [A-Za-z]*Error").select("repository", "commit_hash", "file", "line")
    return structure.owned(hits, _records(spark, folder), smallest=True)


@query(f"WITH {FILES} SELECT repository, language, count(*) AS files, sum(octet_length(encode(content)))::BIGINT AS bytes FROM files WHERE regexp_matches(file, '^(?:.*/)?cli/(?:.*/)?[^/]*\\.(?:ts|js)$') GROUP BY ALL")
def glob_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a glob per repository and language, with their bytes."""
    found = search.glob_files(_files(spark, folder), "**/cli/**/*.{ts,js}")
    return found.groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


def _declared_sql() -> str:
    cases = []
    for language, pattern in extraction.DECLARATIONS.items():
        p = pattern.replace("'", "''")
        names = ", ".join(f"nullif(regexp_extract(text, '{p}', {g}), '')" for g in range(1, pattern.count("([A-Za-z") + 1))
        cases.append(f"WHEN '{language}' THEN coalesce({names})" if "," in names else f"WHEN '{language}' THEN {names}")
    return f"WITH {FILES}, {LINES} SELECT * FROM (SELECT repository, commit_hash, file, line, CASE language {' '.join(cases)} END AS name FROM lines) WHERE name IS NOT NULL"


@query(_declared_sql())
def declared_names(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.declared_names(_files(spark, folder)).select("repository", "commit_hash", "file", "line", "name")


_PY = {kind: quoted(pattern) for kind, pattern in extraction.PYTHON_FACTS.items()}


@query(f"""WITH {FILES}, {LINES}, p AS (SELECT * FROM lines WHERE language = 'python')
 SELECT {_PLACED}, line, 'class' AS kind, regexp_extract(text, {_PY['class']}, 1) AS name FROM p WHERE regexp_matches(text, {_PY['class']})
 UNION ALL SELECT {_PLACED}, line, CASE WHEN regexp_extract(text, {_PY['def']}, 1) = '' THEN 'function' WHEN regexp_extract(text, {_PY['def']}, 2) = '__init__' THEN 'constructor' ELSE 'method' END, regexp_extract(text, {_PY['def']}, 2) FROM p WHERE regexp_matches(text, {_PY['def']})
 UNION ALL SELECT {_PLACED}, line, 'import', coalesce(nullif(regexp_extract(text, {_PY['import']}, 1), ''), regexp_extract(text, {_PY['import']}, 2)) FROM p WHERE regexp_matches(text, {_PY['import']})
 UNION ALL SELECT {_PLACED}, line, 'extends', trim(unnest(string_split(regexp_extract(text, {_PY['extends']}, 1), ','))) FROM p WHERE regexp_matches(text, {_PY['extends']})""")
def python_index(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations, imports and bases in Python files by their lines."""
    return extraction.python_index(_files(spark, folder)).select("repository", "commit_hash", "file", "line", "kind", "name")


@query(f"""WITH {RECORDS} SELECT r.repository, r.id, sha256('v1' || chr(0) || r.file || chr(0) || r.kind || chr(0) || r.qualified_name || chr(0) || coalesce(p.qualified_name, '') || chr(0) || r.signature) AS identity
 FROM records r LEFT JOIN records p ON p.repository = r.repository AND p.commit_hash = r.commit_hash AND p.id = r.parent_id""")
def symbol_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Stable identity of a declaration from its file, kind, names and signature."""
    records = _records(spark, folder)
    parent = records.select("repository", "commit_hash", F.col("id").alias("parent_id"), F.col("qualified_name").alias("parent_name"))
    text = F.concat_ws("\0", F.lit("v1"), "file", "kind", "qualified_name", F.coalesce("parent_name", F.lit("")), "signature")
    return records.join(parent, ["repository", "commit_hash", "parent_id"], "left").select("repository", "id", F.sha2(text, 256).alias("identity"))


@query(f"""WITH {FILES}, u AS (SELECT DISTINCT repository, file FROM files), m AS (SELECT doc_id, repository, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9_./-]+\\.(?:ts|js|py|php|go|rs))\\b', 1))) AS path FROM documents)
 SELECT m.doc_id, m.path, (u.file IS NOT NULL)::INT AS known FROM m LEFT JOIN u ON u.repository = m.repository AND u.file = m.path""")
def path_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Source paths that documents mention and whether their repository holds them."""
    known = _files(spark, folder).select("repository", F.col("file").alias("path"), F.lit(1).alias("known")).distinct()
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_./-]+\.(?:ts|js|py|php|go|rs))\b"), F.lit(1)))).alias("path")
    mentions = table(spark, folder, "documents").select("doc_id", "repository", found)
    return mentions.join(known, ["repository", "path"], "left").select("doc_id", "path", F.coalesce("known", F.lit(0)).alias("known"))


# History

LOG = """logs AS (SELECT doc_id, repository, created_at, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents WHERE source = 'commit_log' AND text IS NOT NULL),
 cf AS (SELECT doc_id, repository, created_at, regexp_extract(l, '^ ?([MADRC])', 1) AS status, regexp_extract(l, ' ([^ ]+)$', 1) AS path FROM (SELECT doc_id, repository, created_at, unnest(p) AS l FROM logs) WHERE regexp_matches(l, '^ ?[MADRC][0-9]* [^ ]+$'))"""


@query(f"WITH {LOG} SELECT repository, path, arg_min(doc_id, row(created_at, doc_id)) AS introduced, arg_max(doc_id, row(created_at, doc_id)) AS latest, count(DISTINCT doc_id) AS commits FROM cf GROUP BY ALL")
def file_introductions(spark: SparkSession, folder: str) -> DataFrame:
    return history.introductions(history.commits(table(spark, folder, "documents")))


_SUBJECT_TERMS = ["validator", "snapshot", "cursor", "session", "review"]


@query(f"""WITH {LOG}, s AS (SELECT l.doc_id, trim(l.p[1], ' ') AS subject, string_agg(cf.path, ' ') AS paths FROM logs l LEFT JOIN cf USING (doc_id) GROUP BY ALL),
 w AS (SELECT doc_id, string_split(lower(regexp_replace(regexp_replace(subject, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS a, string_split(lower(regexp_replace(regexp_replace(coalesce(paths, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS b FROM s)
 SELECT * FROM (SELECT doc_id, ({' + '.join(f"(CASE WHEN list_contains(a, '{t}') THEN 6 ELSE 0 END) + (CASE WHEN list_contains(b, '{t}') THEN 1 ELSE 0 END)" for t in _SUBJECT_TERMS)}) AS score FROM w) WHERE score >= 4""")
def history_token_search(spark: SparkSession, folder: str) -> DataFrame:
    return history.token_search(history.commits(table(spark, folder, "documents")), _SUBJECT_TERMS).select("doc_id", "score")


# Snapshots and reviews

@query("WITH c AS (" + P2_SQL + """) SELECT repository, to_snapshot, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'changed') AS changed FROM c GROUP BY ALL""")
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Additions, removals and changes per repository and snapshot."""
    found = snapshots.snapshot_changes(table(spark, folder, "symbols"))
    return found.groupBy(F.col("source").alias("repository"), "to_snapshot").agg(*[F.count_if(F.col("change_type") == k).alias(k) for k in ("added", "removed", "changed")])


ACTIVE = "(active IS NULL OR active = 1)"


@query(f"""WITH {STATES}, {LASTS} SELECT repository, id, current_status, row_number() OVER (PARTITION BY repository ORDER BY CASE current_status WHEN 'pending' THEN 0 WHEN 'stale' THEN 1 WHEN 'reviewed' THEN 2 ELSE 3 END, file, qualified_name, id)::INT AS position
 FROM st WHERE {own_last()} AND {ACTIVE} AND (current_status IN ('pending', 'stale') OR (current_status = 'failed' AND retries < 3 AND coalesce(retry_after, 0) <= {NOW_MS}))""")
def queue_order(spark: SparkSession, folder: str) -> DataFrame:
    """Eligible symbols of each repository's last snapshot in queue order."""
    return reviews.queue(_last_states(spark, folder), NOW_MS).select("repository", "id", "current_status", "position")


@query(f"""WITH {STATES}, {LASTS}, g AS (SELECT repository, CASE WHEN {ACTIVE} THEN current_status ELSE 'inactive' END AS s FROM st WHERE {own_last()}), d(state) AS (VALUES ('pending'), ('stale'), ('reviewed'), ('failed'), ('inactive'))
 SELECT r.repository, d.state, count(g.s) AS n FROM (SELECT DISTINCT repository FROM g) r CROSS JOIN d LEFT JOIN g ON g.repository = r.repository AND g.s = d.state GROUP BY ALL""")
def queue_status(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.status_counts(_last_states(spark, folder))


@query(f"""WITH {STATES}, {LASTS}, a AS (SELECT repository, id, {digest('content_hash')} AS h, current_status AS s, retries AS r, {ACTIVE} AS act FROM st WHERE {own_last(1)}),
 b AS (SELECT repository, id, {digest('content_hash')} AS h FROM st WHERE {own_last()} AND {ACTIVE})
 SELECT coalesce(a.repository, b.repository) AS repository, coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN a.s WHEN a.id IS NULL THEN 'pending' WHEN a.act AND a.h IS NOT DISTINCT FROM b.h THEN a.s WHEN a.s = 'pending' THEN 'pending' ELSE 'stale' END AS status,
  CASE WHEN b.id IS NULL OR (a.act AND a.h IS NOT DISTINCT FROM b.h) THEN coalesce(a.r, 0) ELSE 0 END AS retries, (b.id IS NOT NULL)::INT AS active
 FROM a FULL JOIN b ON a.repository = b.repository AND a.id = b.id""")
def scan_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """State of the queue after the last scan, from the state before it."""
    return reviews.reconciled(_last_states(spark, folder, 1), _last_states(spark, folder))


@query(f"""WITH {STATES}, {LASTS}, {REVIEWS}, f AS (SELECT *, {digest('reviewed_hash')} AS h FROM rv WHERE verdict = 'finding'), s AS (SELECT DISTINCT id, {digest('content_hash')} AS h FROM st WHERE {own_last()})
 SELECT id, symbol_id, severity, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.id = f.symbol_id AND s.h = f.h) THEN 0 ELSE 1 END AS outdated FROM f WHERE EXISTS (SELECT 1 FROM s WHERE s.id = f.symbol_id)""")
def finding_outdated(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.findings(_reviews(spark, folder), _last_states(spark, folder)).select("id", "symbol_id", "severity", "outdated")


@query(f"WITH {REVIEWS} SELECT id, symbol_id, model, count(*) OVER (PARTITION BY symbol_id, model ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sequence FROM rv")
def report_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.report_sequence(_reviews(spark, folder)).select("id", "symbol_id", "model", "sequence")


def _word(name: str, known: tuple, other: str) -> str:
    value = f"lower(trim(json_extract_string(result_json, '$.{name}')))"
    return f"CASE WHEN {value} IN ({', '.join(repr(k) for k in known)}) THEN {value} ELSE '{other}' END"


NORMALIZED = f"""{REVIEWS}, nr AS (SELECT id, symbol_id, model, {_word('verdict', ('finding', 'skip'), 'skip')} AS verdict, {_word('severity', reviews.SEVERITIES, 'none')} AS severity,
 CASE WHEN try_cast(json_extract_string(result_json, '$.confidence') AS DOUBLE) >= 0.8 THEN 'high' WHEN try_cast(json_extract_string(result_json, '$.confidence') AS DOUBLE) >= 0.5 THEN 'medium' WHEN try_cast(json_extract_string(result_json, '$.confidence') AS DOUBLE) IS NOT NULL THEN 'low' ELSE {_word('confidence', reviews.CONFIDENCES, 'low')} END AS confidence,
 coalesce(trim(json_extract_string(result_json, '$.title'), ' '), '') AS title, coalesce(json_array_length(result_json, '$.issues'), 0)::INT AS issues, (json_extract_string(result_json, '$.needs_broader_context') = 'true')::INT AS broader FROM rv WHERE result_json IS NOT NULL)"""


@query(f"WITH {NORMALIZED} SELECT * FROM nr")
def normalized_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.normalized_reviews(_reviews(spark, folder))


@query(f"WITH {NORMALIZED} SELECT symbol_id, CASE min(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, count(*) AS reviews FROM nr GROUP BY symbol_id")
def weakest_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.weakest_confidence(reviews.normalized_reviews(_reviews(spark, folder)))


@query(f"WITH {REVIEWS} SELECT model, severity, count(*) AS n FROM rv GROUP BY ALL")
def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).groupBy("model", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {STATES}, {LASTS}, {REVIEWS} SELECT s.repository, s.id, s.retries + 1 AS retries, {NOW_MS + 60000}::BIGINT AS retry_after, CASE WHEN EXISTS (SELECT 1 FROM rv WHERE rv.symbol_id = s.id) THEN 'reviewed' ELSE 'failed' END AS current_status
 FROM st s WHERE {own_last(0, 's.repository, s.snapshot_no')} AND s.current_status = 'failed'""")
def failure_transition(spark: SparkSession, folder: str) -> DataFrame:
    failed = _last_states(spark, folder).where(F.col("current_status") == "failed")
    return reviews.after_failure(failed, _reviews(spark, folder), NOW_MS).select("repository", "id", "retries", "retry_after", "current_status")


# Evidence and evaluation

COVER = f"""{FILES}, {LINES}, req AS (SELECT item_id, manifest, language, unnest(required) AS r FROM eval_items), rq AS (SELECT item_id, manifest, language, r.file AS file, r.line AS line, trim(regexp_replace(r.text, '\\s+', ' ', 'g')) AS quote FROM req),
 have AS (SELECT file, line, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS quote FROM lines), told AS (SELECT rq.*, EXISTS (SELECT 1 FROM have h WHERE h.quote = rq.quote AND (rq.file IS NULL OR h.file = rq.file) AND (rq.line IS NULL OR h.line = rq.line) AND (h.quote <> '' OR rq.file IS NOT NULL OR rq.line IS NOT NULL)) AS here,
  EXISTS (SELECT 1 FROM have h WHERE h.quote = rq.quote AND h.quote <> '') AS there FROM rq),
 cov AS (SELECT item_id, manifest, language, count(*) AS required, count(*) FILTER (here) AS covered, count(*) FILTER (NOT here AND there) AS elsewhere, count(*) FILTER (NOT here AND NOT there) AS missing FROM told GROUP BY ALL)"""


@query(f"WITH {COVER} SELECT * FROM cov")
def evidence_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Required lines of each evaluation item that stand at their place, elsewhere in the sources, and nowhere."""
    return evidence.line_coverage(table(spark, folder, "eval_items"), structure.numbered_lines(_files(spark, folder)))


@query(f"WITH {COVER} SELECT manifest, language, count(*) AS alternatives, count(*) FILTER (required = covered) AS complete, bool_or(required = covered)::INT AS covered, bool_or(missing = 0)::INT AS quoted FROM cov GROUP BY ALL")
def relationship_coverage(spark: SparkSession, folder: str) -> DataFrame:
    coverage = evidence.line_coverage(table(spark, folder, "eval_items"), structure.numbered_lines(_files(spark, folder)))
    return evidence.alternatives_covered(coverage)


_PACK = ["snapshot", "cursor"]


@query(f"""WITH l AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1)::INT AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents WHERE source = 'source_code')),
 n AS (SELECT doc_id, line, t, max(CASE WHEN contains(lower(t), 'snapshot') OR contains(lower(t), 'cursor') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l),
 c AS (SELECT doc_id, line, left(t, 180) AS line_text, count(*) OVER w AS place, sum(length(left(t, 180))) OVER w AS chars, count(*) OVER (PARTITION BY doc_id) AS al FROM n WHERE near = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT doc_id, line, line_text, al - count(*) OVER (PARTITION BY doc_id) AS left_out FROM c WHERE place <= 20 AND chars <= 1400""")
def candidate_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of lines around matches within the packing bounds."""
    docs = table(spark, folder, "documents").where("source = 'source_code'")
    return evidence.packed_windows(docs, ["doc_id"], "text", _PACK)


@query(f"""WITH {REVIEWS} SELECT symbol_id, coalesce(array_to_string(list_sort(list_distinct(list(report_path) FILTER (human_status = 'accepted' AND report_path IS NOT NULL))), '; '), '') AS citations, count(*) FILTER (human_status = 'accepted') AS supported, count(*) FILTER (human_status IS DISTINCT FROM 'accepted') AS omitted FROM rv GROUP BY symbol_id""")
def claim_synthesis(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct citations of accepted reviews per symbol, and how many others are left out."""
    return evidence.synthesis(_reviews(spark, folder), ["symbol_id"], F.col("human_status") == "accepted", F.col("report_path"))


@query(f"""WITH {FILES}, t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(content), '([a-z0-9]+)', 1))) AS term FROM files)
 SELECT term, count(*) AS files, round(length(term) / count(*)::DOUBLE, 9) AS weight FROM t WHERE term IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY term""")
def term_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Length over file frequency of a question's terms."""
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return evidence.term_rarity(_files(spark, folder), terms)


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS qi, q.label AS ql, v.vec_id, v.label, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 5) AS s FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY s DESC, vec_id) AS k FROM p), m AS (SELECT qi, ql, avg((label = ql)::INT) AS pr, coalesce(1.0 / min(k) FILTER (label = ql), 0) AS rr FROM r WHERE k <= 10 GROUP BY ALL)
 SELECT ql AS query_label, count(*) AS queries, round(avg(pr), 6) AS precision, round(avg(rr), 6) AS mrr FROM m GROUP BY ROLLUP (ql)""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Precision at 10 and mean reciprocal rank of exact vector search, the query set against all rows."""
    ranks = evaluation.neighbour_ranks(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))
    return evaluation.retrieval_metrics(ranks)


@query(f"""WITH {REVIEWS}, x AS (SELECT json_extract_string(input_json, '$.language') AS language, verdict, num_ctx, length(raw_response) AS chars FROM rv)
 SELECT language, count(*) AS reviews, count(*) FILTER (verdict = 'finding') AS findings, count(*) FILTER (verdict IS NULL) AS unread, median(chars)::DOUBLE AS median_chars, round(avg(num_ctx), 4) AS mean_context FROM x GROUP BY ROLLUP (language)""")
def language_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews per language and in all: counts, median answer length, mean context."""
    rows = _reviews(spark, folder).select(F.get_json_object("input_json", "$.language").alias("language"), "verdict", "num_ctx", F.length("raw_response").alias("chars"))
    return evaluation.grouped_and_total(
        rows, "language", reviews=F.count("*"), findings=F.count_if(F.col("verdict") == "finding"), unread=F.count_if(F.col("verdict").isNull()),
        median_chars=F.median("chars"), mean_context=F.round(F.avg("num_ctx"), 4),
    )


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: tumbling windows over the event table (the streaming form is in orefield.streaming)."""
    events = table(spark, folder, "events")
    counted = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


# More relations

_GUARD = r"^\s*if \((.+)\) ?\{?:?\s*$"
_GUARD_TERMS = ["length", "buffer", "done", "empty"]


@query(f"""WITH {FILES}, {LINES}, {RECORDS}, g AS (SELECT repository, commit_hash, file, line, regexp_extract(text, '{_GUARD}', 1) AS guard FROM lines),
 t AS (SELECT *, len(list_filter(list_distinct(string_split(lower(regexp_replace(regexp_replace(guard, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ')), lambda x: x IN ({', '.join(repr(t) for t in _GUARD_TERMS)}))) AS shared FROM g WHERE guard <> ''),
 o AS (SELECT t.*, r.id, row_number() OVER (PARTITION BY t.repository, t.commit_hash, t.file, t.line ORDER BY r.sb DESC, r.eb, r.id) AS rn FROM t JOIN records r ON r.repository = t.repository AND r.commit_hash = t.commit_hash AND r.file = t.file AND t.line BETWEEN r.sl AND r.el WHERE shared > 0)
 SELECT repository, commit_hash, id, max(shared * 2 + 1)::INT AS score FROM o WHERE rn = 1 GROUP BY ALL""")
def conditional_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations whose guards share terms with a question."""
    return structure.guard_scores(_files(spark, folder), _records(spark, folder), _GUARD_TERMS)


@query(f"""WITH {FILES}, {LINES}, {RECORDS}, e AS (
 SELECT repository, commit_hash, file, line, 'extends' AS kind, regexp_extract(text, 'class ([A-Za-z_$][A-Za-z0-9_$]*)(?:<[^>]*>)? extends ([A-Za-z_$][A-Za-z0-9_$.]*)', 1) AS child, regexp_extract(text, 'class ([A-Za-z_$][A-Za-z0-9_$]*)(?:<[^>]*>)? extends ([A-Za-z_$][A-Za-z0-9_$.]*)', 2) AS parent FROM lines
 UNION ALL SELECT repository, commit_hash, file, line, 'extends', regexp_extract(text, '^\\s*class ([A-Za-z_][A-Za-z0-9_]*)\\(([A-Za-z_][A-Za-z0-9_.]*)', 1), regexp_extract(text, '^\\s*class ([A-Za-z_][A-Za-z0-9_]*)\\(([A-Za-z_][A-Za-z0-9_.]*)', 2) FROM lines
 UNION ALL SELECT repository, commit_hash, file, line, 'implements', regexp_extract(text, '(?:class|struct) ([A-Za-z_$][A-Za-z0-9_$]*)[^{{]* implements ([A-Za-z_$][A-Za-z0-9_$.]*)', 1), regexp_extract(text, '(?:class|struct) ([A-Za-z_$][A-Za-z0-9_$]*)[^{{]* implements ([A-Za-z_$][A-Za-z0-9_$.]*)', 2) FROM lines
 UNION ALL SELECT repository, commit_hash, file, line, 'implements', regexp_extract(text, '^impl(?:<[^>]*>)? ([A-Za-z_][A-Za-z0-9_]*)(?:<[^>]*>)? for ([A-Za-z_][A-Za-z0-9_]*)', 2), regexp_extract(text, '^impl(?:<[^>]*>)? ([A-Za-z_][A-Za-z0-9_]*)(?:<[^>]*>)? for ([A-Za-z_][A-Za-z0-9_]*)', 1) FROM lines),
 w AS (SELECT repository, commit_hash, name AS parent, min(id) AS parent_id FROM records GROUP BY ALL HAVING count(*) = 1)
 SELECT e.repository, e.commit_hash, e.file, e.line, e.kind, e.child, e.parent, w.parent_id FROM e LEFT JOIN w USING (repository, commit_hash, parent) WHERE e.parent <> ''""")
def inheritance(spark: SparkSession, folder: str) -> DataFrame:
    return structure.inheritance_edges(_files(spark, folder), _records(spark, folder)).select("repository", "commit_hash", "file", "line", "kind", "child", "parent", "parent_id")


@query(f"""WITH {FILES}, {LINES}, sc AS (SELECT * FROM lines WHERE language IN ('typescript', 'javascript')),
 imp AS (SELECT repository, commit_hash, file, line AS import_line, unnest(string_split(regexp_extract(text, '^import \\{{([^}}]*)\\}} from ["'']([^"'']+)["'']', 1), ',')) AS part, regexp_extract(text, '^import \\{{([^}}]*)\\}} from ["'']([^"'']+)["'']', 2) AS specifier FROM sc WHERE regexp_matches(text, '^import \\{{([^}}]*)\\}} from ["'']([^"'']+)["'']')),
 b AS (SELECT repository, commit_hash, file, import_line, regexp_extract(part, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*$', 1) AS name, specifier FROM imp),
 tok AS (SELECT repository, commit_hash, file, line, regexp_replace(unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*\\(?)', 1)), '\\($', '') AS name FROM sc), u AS (SELECT *, count(*) AS n FROM tok GROUP BY ALL),
 j AS (SELECT u.*, b.import_line, b.specifier, row_number() OVER (PARTITION BY u.repository, u.commit_hash, u.file, u.line, u.name ORDER BY b.import_line DESC, b.specifier DESC) AS rn FROM u JOIN b ON b.repository = u.repository AND b.commit_hash = u.commit_hash AND b.file = u.file AND b.name = u.name AND b.import_line < u.line)
 SELECT repository, commit_hash, file, line, name, n, import_line, specifier FROM j WHERE rn = 1""")
def import_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of imported names with the latest import before them."""
    return structure.import_uses(_files(spark, folder))


@query(f"""WITH {RECORDS}, c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(answer, '`([A-Za-z_][A-Za-z0-9_]*)`', 1))) AS name FROM eval_items), k AS (SELECT DISTINCT name FROM records)
 SELECT c.item_id, count(*) AS cited, count(k.name) AS known FROM c LEFT JOIN k USING (name) GROUP BY c.item_id""")
def answer_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Code spans of the evaluation answers and how many are declared names."""
    return evidence.cited_names(table(spark, folder, "eval_items"), _records(spark, folder), "answer")


@query(SQL["candidate_packing"].replace(" SELECT doc_id, line, line_text, al", ", p AS (SELECT doc_id, line, line_text, al") + """), g AS (SELECT d.repository, count(DISTINCT p.doc_id) AS parts, count(*) AS lines, sum(length(p.line_text))::BIGINT AS chars FROM p JOIN documents d USING (doc_id) GROUP BY ALL)
 SELECT *, (parts > 6 OR chars > 24000)::INT AS overflow FROM g""")
def evidence_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Packed lines per repository, with explicit overflow of the bundle's bounds."""
    docs = table(spark, folder, "documents").where("source = 'source_code'")
    windows = evidence.packed_windows(docs, ["doc_id", "repository"], "text", _PACK)
    return evidence.bundles(windows, ["repository"])


@query("WITH c AS (" + P2_SQL + f"), {STATES}, {LASTS}, {REVIEWS}, m AS (SELECT DISTINCT repository, id FROM c WHERE {own_last(0, 'repository, to_snapshot')}), pl AS (SELECT DISTINCT repository, id, file FROM st WHERE {own_last()})," + """
 tf AS (SELECT DISTINCT pl.repository, pl.file FROM pl JOIN m USING (repository, id)), bs AS (SELECT DISTINCT pl.id FROM pl JOIN tf USING (repository, file))
 SELECT rv.id AS review_id, CASE WHEN rv.symbol_id IN (SELECT id FROM m) THEN 'stale' WHEN rv.symbol_id IN (SELECT id FROM bs) THEN 'file stale' ELSE 'fresh' END AS freshness FROM rv""")
def claim_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that the last snapshot's changes made stale, directly or through their file."""
    symbols = table(spark, folder, "symbols")
    changes = snapshots.of_last_snapshot(snapshots.snapshot_changes(symbols), symbols, snapshot="to_snapshot", source="source")
    return reviews.claim_freshness(_reviews(spark, folder), changes, _last_states(spark, folder))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC) AS rn FROM semantic_entries), a AS (SELECT model, CASE WHEN rn > 1 THEN 'superseded' WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 72 THEN 'other length'
  WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS state FROM e)
 SELECT model, state, count(*) AS n FROM a GROUP BY ALL""")
def semantic_index_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the vector index by model and whether they can be searched."""
    entries = table(spark, folder, "semantic_entries")
    newest = entries.groupBy("symbol_id").agg(F.max("indexed_at").alias("newest"))
    v = F.col("embedding")
    state = (
        F.when(F.col("indexed_at") < F.col("newest"), "superseded").when(v.isNull(), "missing").when(F.size(v) != 72, "other length")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "zero").otherwise("usable")
    )
    # Of rows repeated with the newest time one counts; the others are superseded.
    told = entries.join(newest, "symbol_id").withColumn("state", state)
    twice = told.where("state != 'superseded'").groupBy("symbol_id", "model", "state").agg((F.count("*") - 1).alias("more"))
    counted = told.groupBy("model", "state").agg(F.count("*").alias("n"))
    extra = twice.groupBy("model", "state").agg(F.sum("more").alias("more"))
    moved = counted.join(extra, ["model", "state"], "left").select("model", "state", (F.col("n") - F.coalesce("more", F.lit(0))).alias("n"))
    back = twice.groupBy("model").agg(F.sum("more").alias("n")).select("model", F.lit("superseded").alias("state"), "n")
    return moved.unionByName(back).groupBy("model", "state").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"""WITH {NORMALIZED} SELECT nr.model, count(*) AS reviews, round(avg(nr.issues), 6) AS mean_issues, median(nr.issues)::DOUBLE AS median_issues, round(avg((nr.verdict = 'finding')::INT), 6) AS finding_rate,
 round(avg((rv.human_status = 'accepted')::INT) FILTER (rv.human_status IN ('accepted', 'rejected')), 6) AS accepted_rate FROM nr JOIN rv ON rv.id = nr.id GROUP BY ROLLUP (nr.model)""")
def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Means, medians and conditional rates of each model and of all."""
    current = _reviews(spark, folder)
    normalized = reviews.normalized_reviews(current).join(current.select("id", "human_status"), "id")
    decided = F.when(F.col("human_status").isin("accepted", "rejected"), (F.col("human_status") == "accepted").cast("int"))
    return evaluation.grouped_and_total(
        normalized, "model", reviews=F.count("*"), mean_issues=F.round(F.avg("issues"), 6), median_issues=F.median("issues"),
        finding_rate=F.round(F.avg((F.col("verdict") == "finding").cast("int")), 6), accepted_rate=F.round(F.avg(decided), 6),
    )


_HISTORY = {t: " + ".join(f"(CASE WHEN list_contains(a, '{x}') THEN 6 ELSE 0 END) + (CASE WHEN list_contains(b, '{x}') THEN 1 ELSE 0 END)" for x in t) for t in (tuple(_SUBJECT_TERMS), tuple(TERMS))}


@query(f"""WITH {EDGES}, {LEXICAL}, {STRUCTURAL}, lx AS (SELECT 'symbol' AS kind, repository || '/' || id AS key, max(score) AS score FROM lexical GROUP BY ALL), sx AS (SELECT 'symbol' AS kind, repository || '/' || id AS key, max(score) AS score FROM structural GROUP BY ALL),
 dm AS (SELECT 'document' AS kind, doc_id::VARCHAR AS key, ({any_hits('text', TERMS)}) AS score, doc_id FROM documents WHERE source = 'repo_docs'), cm AS (SELECT 'commit' AS kind, doc_id::VARCHAR AS key, score FROM ({SQL['history_token_search'].replace(_HISTORY[tuple(_SUBJECT_TERMS)], _HISTORY[tuple(TERMS)])})),
 r AS (SELECT kind, key, 'lexical' AS source, 1 AS w, row_number() OVER (ORDER BY score DESC, key) AS rank FROM lx UNION ALL SELECT kind, key, 'structural', 1, row_number() OVER (ORDER BY score DESC, key) FROM sx
  UNION ALL SELECT kind, key, 'documentation', 3, rank FROM (SELECT kind, key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM dm WHERE score >= 2) WHERE rank <= 3
  UNION ALL SELECT kind, key, 'history', 3, row_number() OVER (ORDER BY score DESC, key) FROM cm)
 SELECT kind, key, round(sum(w::DOUBLE / (60 + rank)), 12) AS score FROM r GROUP BY kind, key ORDER BY score DESC, kind, key LIMIT 100""")
def hybrid_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The signals that the question's terms open, fused over declarations, documents and commits; the top 100 is the
    operator's bound. Without an embedding of the question the semantic list has no part (see ``Explorer``)."""
    docs, files, records = table(spark, folder, "documents"), stored(_files(spark, folder)), stored(_records(spark, folder))  # the last two are read many times

    def symbols(scores: DataFrame) -> DataFrame:
        key = F.concat_ws("/", "repository", "id").alias("key")
        return scores.select(F.lit("symbol").alias("kind"), key, "score").groupBy("kind", "key").agg(F.max("score").alias("score"))

    documentation = ranking.document_matches(docs.where("source = 'repo_docs'"), TERMS).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), "score")
    commits = history.token_search(history.commits(docs), TERMS).select(F.lit("commit").alias("kind"), F.col("doc_id").cast("string").alias("key"), "score")
    order = [F.desc("score"), F.asc("key")]
    lists = {
        "lexical": symbols(ranking.lexical_scores(records, files, TERMS)), "structural": symbols(structure.structural_scores(files, records, TERMS)),
        "documentation": documentation.orderBy(*order).limit(ranking.TOP_DOCUMENTS), "history": commits,
    }
    ranked = {n: ranking.with_row_number(df, order) for n, df in lists.items()}
    return ranking.fused(ranked, ["kind", "key"]).orderBy(F.desc("score"), "kind", "key").limit(ranking.MOST_RESULTS).select("kind", "key", "score")


# Smaller operators

_ENTRY_TERMS = ["snapshot", "cursor", "review", "strict", "path"]


@query(f"""WITH j AS (SELECT doc_id, path, text::JSON AS t FROM documents WHERE regexp_matches(text, '^\\s*\\{{') AND json_valid(text)), e AS (SELECT doc_id, path, k AS name, json_extract_string(t, '$."' || k || '"') AS value, json_type(t, '$."' || k || '"') AS kind FROM (SELECT *, unnest(json_keys(t)) AS k FROM j))
 SELECT * FROM (SELECT doc_id, '/' || name AS pointer, value, 2 * ({any_hits("(coalesce(path || ' ', '') || name || ' ' || value)", _ENTRY_TERMS)}) AS score FROM e WHERE kind NOT IN ('OBJECT', 'ARRAY', 'NULL')) WHERE score >= 2""")
def script_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of JSON documents by a question's terms (here of the whole object; no document has a ``scripts`` member)."""
    return ranking.script_scores(table(spark, folder, "documents"), _ENTRY_TERMS, member=None)


@query(f"WITH {REVIEWS} SELECT id, symbol_id, severity, created_at FROM rv WHERE verdict = 'finding' ORDER BY created_at DESC, id LIMIT 100")
def newest_findings(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.newest_findings(_reviews(spark, folder).where("verdict = 'finding'")).select("id", "symbol_id", "severity", "created_at")


@query(f"""WITH {STATES}, {LASTS}, {REVIEWS}, k AS (SELECT symbol_id, created_at, reviewed_hash FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY created_at DESC, id DESC) AS n FROM rv) WHERE n = 1)
 SELECT st.repository, st.id, CASE WHEN k.symbol_id IS NULL THEN current_status ELSE 'reviewed' END AS current_status, CASE WHEN k.symbol_id IS NULL THEN last_reviewed_at ELSE k.created_at END AS last_reviewed_at,
  CASE WHEN k.symbol_id IS NULL THEN last_reviewed_hash ELSE k.reviewed_hash END AS last_reviewed_hash, CASE WHEN k.symbol_id IS NULL THEN retries ELSE 0 END AS retries, CASE WHEN k.symbol_id IS NULL THEN retry_after ELSE 0 END AS retry_after
 FROM st LEFT JOIN k ON k.symbol_id = st.id WHERE {own_last(0, 'st.repository, st.snapshot_no')}""")
def states_after_review(spark: SparkSession, folder: str) -> DataFrame:
    return reviews.after_review(_last_states(spark, folder), _reviews(spark, folder))


@query(f"""WITH {LOG}, n AS (SELECT repository, doc_id, trim(p[1], ' ') AS subject, row_number() OVER (PARTITION BY repository ORDER BY created_at DESC, doc_id DESC)::INT AS rank FROM logs)
 SELECT n.repository, n.rank, n.doc_id, n.subject, (SELECT count(*) FROM cf WHERE cf.doc_id = n.doc_id)::INT AS files FROM n WHERE rank <= 20""")
def recent_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 20 commits of each repository, which is the report's bound."""
    return history.recent_changes(history.commits(table(spark, folder, "documents")))


@query(f"""WITH {LOG}, {RECORDS}, c AS (SELECT DISTINCT repository, doc_id, created_at, path FROM cf), r AS (SELECT DISTINCT repository, id, file FROM records)
 SELECT r.repository, r.id, c.doc_id, row_number() OVER (PARTITION BY r.repository, r.id ORDER BY c.created_at DESC, c.doc_id DESC)::INT AS rank FROM r JOIN c ON c.repository = r.repository AND c.path = r.file""")
def symbol_history(spark: SparkSession, folder: str) -> DataFrame:
    """Commits that changed the file of each declaration."""
    return history.symbol_history(history.commits(table(spark, folder, "documents")), _records(spark, folder))


@query(f"""WITH {FILES}, {LINES}, {RECORDS}, g AS (SELECT * FROM (SELECT repository, commit_hash, file, line, regexp_extract(text, '{_GUARD}', 1) AS guard FROM lines) WHERE guard <> ''),
 o AS (SELECT g.*, r.id, row_number() OVER (PARTITION BY g.repository, g.commit_hash, g.file, g.line ORDER BY r.sb DESC, r.eb, r.id) AS rn FROM g JOIN records r ON r.repository = g.repository AND r.commit_hash = g.commit_hash AND r.file = g.file AND g.line BETWEEN r.sl AND r.el),
 f AS (SELECT repository, commit_hash, id, guard, min(line) AS line FROM o WHERE rn = 1 GROUP BY ALL) SELECT repository, commit_hash, id, string_agg(guard, ' && ' ORDER BY line, guard) AS guards FROM f GROUP BY ALL""")
def guard_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct guards of each declaration in the order of their first lines."""
    return structure.guard_lists(_files(spark, folder), _records(spark, folder)).withColumn("guards", F.array_join("guards", " && "))


@query(f"WITH {FILES} SELECT repository, count(*) AS files, count(*) FILTER (NOT regexp_matches(file, {quoted(structure.NO_PRODUCTION)})) AS production FROM files GROUP BY ALL")
def production_files(spark: SparkSession, folder: str) -> DataFrame:
    files = _files(spark, folder)
    kept = structure.production_files(files).groupBy("repository").agg(F.count("*").alias("production"))
    return files.groupBy("repository").agg(F.count("*").alias("files")).join(kept, "repository", "left").select("repository", "files", F.coalesce("production", F.lit(0)).alias("production"))


@query("SELECT lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) AS extension, count(*) AS files FROM documents WHERE path IS NOT NULL AND NOT regexp_matches(path, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|php|go|rs)$') GROUP BY ALL")
def missing_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Extensions of the documents' paths that no language of the index claims."""
    return structure.missing_languages(table(spark, folder, "documents").where("path is not null").select(F.col("path").alias("file")))


@query("SELECT model, max(version) AS version, max(indexed_at) AS newest, count(DISTINCT commit_hash) AS commits FROM semantic_entries GROUP BY ALL")
def index_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version and run of the vector index of each model."""
    return table(spark, folder, "semantic_entries").groupBy("model").agg(F.max("version").alias("version"), F.max("indexed_at").alias("newest"), F.count_distinct("commit_hash").alias("commits"))


@query(f"WITH {RECORDS} SELECT repository, commit_hash, id, trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS signature, replace(name, '.', '\\.') AS escaped, 'file:' || file || ':' || sl || '-' || el AS citation FROM records")
def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures on one line, names escaped for qualified names, and citations of the declarations."""
    from orefield.functions.text import one_space

    citation = F.concat(F.lit("file:"), "file", F.lit(":"), F.col("sl").cast("string"), F.lit("-"), F.col("el").cast("string"))
    return _records(spark, folder).select("repository", "commit_hash", "id", one_space(F.col("signature")).alias("signature"), F.replace("name", F.lit("."), F.lit("\\.")).alias("escaped"), citation.alias("citation"))


@query(f"""WITH {EDGES}, c AS (SELECT e.repository, e.commit_hash, e.owner_id AS target, e.file, e.line, t.file AS of, t.sl AS ol, o.file AS tf, o.sl AS tl FROM edges e JOIN records o ON o.repository = e.repository AND o.commit_hash = e.commit_hash AND o.id = e.owner_id JOIN records t ON t.repository = e.repository AND t.commit_hash = e.commit_hash AND t.id = e.target_id)
 SELECT DISTINCT repository, commit_hash, target, file, line FROM c WHERE of <> tf OR ol <> tl""")
def foreign_owners(spark: SparkSession, folder: str) -> DataFrame:
    """Uses inside a declaration of what another declaration owns."""
    key = ["repository", "commit_hash"]
    records = _records(spark, folder)
    owner = records.select(*key, F.col("id").alias("owner_id"), F.col("file").alias("target_file"), F.col("sl").alias("target_line"))
    meant = records.select(*key, F.col("id").alias("target_id"), F.col("file").alias("owner_file"), F.col("sl").alias("owner_line"))
    cited = _edges(spark, folder).join(owner, [*key, "owner_id"]).join(meant, [*key, "target_id"]).withColumnRenamed("owner_id", "target")
    return evidence.foreign_owners(cited, [*key, "target"])
