"""Structural relations of declarations: outlines, owners, references, callers, modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from orefield.functions.text import directory_of, joined_path, unix_lines
from orefield.operators import graph
from orefield.session import stored

PLACE = ["repository", "commit_hash"]
# Extensions of source files in the order in which a module's candidates are tried.
MODULE_EXTENSIONS = (".ts", ".tsx", ".js", ".mjs", ".cjs", ".php", ".py", ".go", ".rs")


def symbol_matches(records: DataFrame, query: str) -> DataFrame:
    """Declarations by name: id before exact before case-folded part; ordered by class, file, byte."""
    kind = (
        F.when(F.col("id") == query, 0)
        .when((F.col("name") == query) | (F.col("qualified_name") == query), 1)
        .when(F.contains(F.lower("qualified_name"), F.lit(query.lower())), 2)
    )
    return records.withColumn("match", kind).where("match is not null")


def outline(records: DataFrame) -> DataFrame:
    """Declarations of each file in preorder: sequence, depth (how many declarations of the file are above it) and
    occurrence number of repeated qualified names. A parent that isn't in the file, or a cycle of parents, counts
    as none: such declarations are at depth 0."""
    place = [*PLACE, "file"]
    file = Window.partitionBy(*place).orderBy("sb", F.desc("eb"), "id")
    same = Window.partitionBy(*place, "qualified_name").orderBy("sb", F.desc("eb"), "id")
    own = records.select(*place, F.col("id").alias("node"))
    edges = records.where("parent_id is not null").select(*place, F.col("parent_id").alias("source"), F.col("id").alias("target"))
    edges = edges.join(own.withColumnRenamed("node", "source"), [*place, "source"], "left_semi")
    roots = own.join(edges.select(*place, F.col("target").alias("node")), [*place, "node"], "left_anti")
    depths = graph.reachable(edges, roots, place).select(*place, F.col("node").alias("id"), F.col("distance").alias("depth"))
    return (
        records.join(depths, [*place, "id"], "left")
        .withColumns({"depth": F.coalesce("depth", F.lit(0)), "seq": F.row_number().over(file), "occurrence": F.row_number().over(same)})
        .withColumn("unique_name", F.when(F.col("occurrence") > 1, F.concat("qualified_name", F.lit("#"), F.col("occurrence").cast("string"))).otherwise(F.col("qualified_name")))
    )


def numbered_lines(files: DataFrame) -> DataFrame:
    """(repository, commit_hash, file, language, line, text), lines from 1."""
    return files.select(*PLACE, "file", "language", F.posexplode(unix_lines(F.col("content"))).alias("pos", "text")).select(
        *PLACE, "file", "language", (F.col("pos") + 1).alias("line"), "text"
    )


def identifiers(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Names used in the files: (place, file, line, name, is_call, n) with how often on that line. With ``names``
    (place, name) all other words are dropped before anything is counted."""
    lines = numbered_lines(files).where("text != ''")
    found = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*\(?)"), F.lit(1))).alias("token")
    used = lines.select(*PLACE, "file", "line", found).select(*PLACE, "file", "line", F.regexp_replace("token", r"\($", "").alias("name"), F.endswith("token", F.lit("(")).alias("is_call"))
    if names is not None:
        used = used.join(names, [*PLACE, "name"], "left_semi")
    return used.groupBy(*PLACE, "file", "line", "name", "is_call").agg(F.count("*").alias("n"))


def line_owners(records: DataFrame, smallest: bool = False) -> DataFrame:
    """(place, file, line, owner_id): of every line the declaration that holds it, the latest-starting one or the
    one of smallest span. In proportion to the lines that declarations hold, however many a file has."""
    order = F.struct(F.col("eb") - F.col("sb"), "sb", "id") if smallest else F.struct(-F.col("sb"), "eb", "id")
    held = records.where("sl <= el").select(*PLACE, "file", "id", order.alias("rank"), F.explode(F.sequence("sl", "el")).alias("line"))
    return held.groupBy(*PLACE, "file", "line").agg(F.min_by("id", "rank").alias("owner_id"))


def owned(uses: DataFrame, records: DataFrame, smallest: bool = False) -> DataFrame:
    """Each use (place, file, line) with the declaration that holds it (see ``line_owners``)."""
    return uses.join(line_owners(records, smallest), [*PLACE, "file", "line"], "left")


def resolved(uses: DataFrame, records: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Target of each used name. An imported name (``bindings``: place, file, name, imported, target_file) means
    the one declaration of that name in the imported file (static) or nothing: it never falls back. Any
    other is the unique one of its file (static), else of its commit (heuristic), else unresolved."""
    local = records.groupBy(*PLACE, "file", "name").agg(F.count("*").alias("c"), F.min("id").alias("local_id")).where("c = 1").drop("c")
    wide = records.groupBy(*PLACE, "name").agg(F.count("*").alias("c"), F.min("id").alias("wide_id")).where("c = 1").drop("c")
    found = uses.join(local, [*PLACE, "file", "name"], "left").join(wide, [*PLACE, "name"], "left")
    if bindings is None:
        found = found.withColumns({"bound": F.lit(False), "bound_id": F.lit(None).cast("string")})
    else:
        meant = local.select(*PLACE, F.col("file").alias("target_file"), F.col("name").alias("imported"), F.col("local_id").alias("bound_id"))
        told = bindings.join(meant, [*PLACE, "target_file", "imported"], "left").select(*PLACE, "file", "name", F.lit(True).alias("bound"), "bound_id")
        found = found.join(told, [*PLACE, "file", "name"], "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    target = F.when(F.col("bound"), F.col("bound_id")).otherwise(F.coalesce("local_id", "wide_id"))
    quality = (
        F.when(F.col("bound"), F.when(F.col("bound_id").isNotNull(), "static").otherwise("unresolved"))
        .when(F.col("local_id").isNotNull(), "static").when(F.col("wide_id").isNotNull(), "heuristic").otherwise("unresolved")
    )
    return found.withColumns({"target_id": target, "resolution": quality}).drop("local_id", "wide_id", "bound", "bound_id")


def reference_edges(files: DataFrame, records: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(place, file, line, name, is_call, n, owner_id, target_id, resolution) of names that are declared
    anywhere in the same commit or imported in their file. A declaration's own line isn't a use of it. ``modules``:
    the files' ``module_edges``, where they are known."""
    bindings = stored(import_bindings(files, modules))  # few rows, read three times
    known = records.select(*PLACE, "name").unionByName(bindings.select(*PLACE, "name")).distinct()
    starts = records.select(*PLACE, "file", F.col("sl").alias("line"), "name").distinct()
    uses = identifiers(files, known).join(starts, [*PLACE, "file", "line", "name"], "left_anti")
    declared = records.select(*PLACE, "name").distinct().withColumn("declared", F.lit(True))
    uses = uses.join(declared, [*PLACE, "name"], "left").join(bindings.select(*PLACE, "file", "name", F.lit(True).alias("imports")), [*PLACE, "file", "name"], "left")
    return resolved(owned(uses.where("declared or imports").drop("declared", "imports"), records), records, bindings)


# Lines that name a module; the specifier is the first group that matched.
SCRIPT_MODULE = r"""(?:from|^import|require\() ?["'](\.[^"']*)["']"""
PYTHON_MODULE = r"^\s*(?:from (\.*[A-Za-z0-9_.]*) import |import ([A-Za-z0-9_.]+))"
PHP_MODULE = r"""(?:include|require)(?:_once)?[ (]+(?:__DIR__ ?\. ?)?["']([^"']+)["']"""


def module_edges(files: DataFrame) -> DataFrame:
    """Imports and the file each one means: (place, file, line, specifier, target_file, resolution); the first
    candidate that exists. Script paths are relative ones: the path itself, the path with its known extension
    exchanged for each of the others, and an index file below it. Python modules are a file or a package, from the
    root or relative to the file's package by their dots. PHP includes are relative to the file's folder."""
    def first(pattern: str, *groups: int):
        return F.coalesce(*[F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in groups])

    lines = numbered_lines(files)
    specifier = (
        F.when(F.col("language").isin("typescript", "javascript"), first(SCRIPT_MODULE, 1))
        .when(F.col("language") == "python", first(PYTHON_MODULE, 1, 2)).when(F.col("language") == "php", first(PHP_MODULE, 1))
    )
    found = lines.withColumn("specifier", specifier).where("specifier is not null")
    folder, dots = directory_of(F.col("file")), F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    base = joined_path(folder, F.col("specifier"))
    bare = F.regexp_replace(base, r"\.(ts|tsx|js|mjs|cjs|php|py|go|rs)$", "")
    scripts = F.array(base, *[F.concat(bare, F.lit(e)) for e in MODULE_EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in MODULE_EXTENSIONS])
    parts = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    stem = F.when(dots > 0, joined_path(folder, F.concat(F.repeat(F.lit("../"), dots - 1), parts))).otherwise(parts)
    modules = F.filter(F.array(F.when(parts != "", F.concat(stem, F.lit(".py"))), F.ltrim(F.concat(stem, F.lit("/__init__.py")), F.lit("/"))), lambda c: c.isNotNull())
    included = F.array(joined_path(folder, F.regexp_replace("specifier", r"^\.?/", "")))
    options = F.when(F.col("language") == "python", modules).when(F.col("language") == "php", included).otherwise(scripts)
    tried = found.select(*PLACE, "file", "line", "specifier", F.posexplode(options).alias("priority", "target_file"))
    there = files.select(*PLACE, F.col("file").alias("target_file"))
    hit = tried.join(there, [*PLACE, "target_file"]).groupBy(*PLACE, "file", "line", "specifier").agg(F.min_by("target_file", "priority").alias("target_file"))
    edges = found.select(*PLACE, "file", "line", "specifier").join(hit, [*PLACE, "file", "line", "specifier"], "left")
    return edges.withColumn("resolution", F.when(F.col("target_file").isNotNull(), "static").otherwise("unresolved"))


# A line that binds names of another module: named, whole or default imports, and Python's from-imports.
NAMED_IMPORT = r"""^import (?:type )?(?:[A-Za-z_$][A-Za-z0-9_$]* ?, ?)?\{([^}]*)\} from ["'][^"']+["']"""
DEFAULT_IMPORT = r"""^import ([A-Za-z_$][A-Za-z0-9_$]*)(?: ?, ?\{[^}]*\})? from ["'][^"']+["']"""
FROM_IMPORT = r"^\s*from \.*[A-Za-z0-9_.]* import \(?([A-Za-z0-9_, ]+)\)?"


def import_bindings(files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(place, file, name, imported, target_file): the names that a file binds by imports, what they are called where
    they come from, and the file that is meant (null where none is known). Of repeated bindings the last counts."""
    lines = numbered_lines(files)
    script, python = F.col("language").isin("typescript", "javascript"), F.col("language") == "python"
    clauses = F.when(script, F.regexp_extract("text", NAMED_IMPORT, 1)).when(python, F.regexp_extract("text", FROM_IMPORT, 1))
    default = F.when(script, F.nullif(F.regexp_extract("text", DEFAULT_IMPORT, 1), F.lit("")))
    named = F.transform(F.filter(F.split(clauses, ","), lambda c: F.trim(c) != ""), lambda c: F.struct(
        F.regexp_extract(c, r"([A-Za-z_$][A-Za-z0-9_$]*)\s*$", 1).alias("name"), F.regexp_extract(F.regexp_replace(c, r"^\s*type ", ""), r"([A-Za-z_$][A-Za-z0-9_$]*)", 1).alias("imported")))
    whole = F.filter(F.array(F.when(default.isNotNull(), F.struct(default.alias("name"), F.lit("default").alias("imported")))), lambda b: b.isNotNull())
    bound = lines.where(F.col("text").rlike("import ")).select(*PLACE, "file", "line", F.explode(F.concat(F.coalesce(named, F.expr("array()").cast("array<struct<name:string,imported:string>>")), whole)).alias("b"))
    bound = bound.select(*PLACE, "file", "line", "b.name", "b.imported").where("name != ''")
    targets = (module_edges(files) if modules is None else modules).select(*PLACE, "file", "line", "target_file")
    told = bound.join(targets, [*PLACE, "file", "line"], "left")
    return told.groupBy(*PLACE, "file", "name").agg(F.max_by(F.struct("imported", "target_file"), F.struct("line", "imported")).alias("b")).select(*PLACE, "file", "name", "b.imported", "b.target_file")


# A line that opens a test case or a group of them, with its title.
TEST_TITLE = r"""^\s*(?:it|test|describe)(?:\.[a-z]+)?\( ?["'`]([^"'`]*)"""


def structural_scores(files: DataFrame, records: DataFrame, terms: list[str]) -> DataFrame:
    """(place, id, score): 3 for the target and 2 for the owner of every use whose name holds a term, once as a
    reference and once more as a call; 1 for each declaration of the two files of an import whose specifier
    does; 1 for the smallest declaration around a test whose title does."""
    from orefield.operators.ranking import holds_a_term

    # Each part is written before the next is planned: as one plan, with the terms pushed to every side of every join,
    # its codes and descriptions outgrow a small driver.
    modules = stored(module_edges(files))
    hit = reference_edges(files, records, modules).where(holds_a_term(F.col("name"), terms)).withColumn("n", F.col("n") * F.when(F.col("is_call"), 2).otherwise(1))
    ends = F.explode(F.array(F.struct(F.col("target_id").alias("id"), (F.col("n") * 3).alias("s")), F.struct(F.col("owner_id").alias("id"), (F.col("n") * 2).alias("s")))).alias("x")
    uses = stored(hit.select(*PLACE, ends).where("x.id is not null").select(*PLACE, "x.id", "x.s"))
    named = modules.where(holds_a_term(F.col("specifier"), terms))
    both = named.select(*PLACE, F.explode(F.array_distinct(F.array("file", F.coalesce("target_file", "file")))).alias("file"))
    imports = both.groupBy(*PLACE, "file").agg(F.count("*").alias("s")).join(records.select(*PLACE, "file", "id"), [*PLACE, "file"]).select(*PLACE, "id", "s")
    titled = numbered_lines(files).withColumn("title", F.regexp_extract("text", TEST_TITLE, 1)).where("title != ''").where(holds_a_term(F.col("title"), terms))
    tests = owned(titled.select(*PLACE, "file", "line"), records, smallest=True).where("owner_id is not null").select(*PLACE, F.col("owner_id").alias("id"), F.lit(1).cast("bigint").alias("s"))
    return uses.unionByName(imports).unionByName(tests).groupBy(*PLACE, "id").agg(F.sum("s").alias("score"))


def symbol_windows(files: DataFrame, records: DataFrame) -> DataFrame:
    """Each declaration's first line and the line before and after it; declarations of which the file has none of
    these lines are left out. One join by file; the lines are taken from the file's array of lines."""
    def line(number):
        return F.when((number >= 1) & (number <= F.size("lines")), F.get("lines", number - 1))

    lines = files.select(*PLACE, "file", unix_lines(F.col("content")).alias("lines"))
    found = records.select(*PLACE, "file", "id", "sl", "el").join(lines, [*PLACE, "file"])
    found = found.select(*PLACE, "id", line(F.col("sl") - 1).alias("before"), line(F.col("sl")).alias("first"), line(F.col("el") + 1).alias("after"))
    return found.where("before is not null or first is not null or after is not null")


def inheritance_edges(files: DataFrame, records: DataFrame) -> DataFrame:
    """(place, file, line, child, parent, kind, parent_id): classes and what they extend or implement;
    the parent is resolved where its name is unique in the commit."""
    header = r"class ([A-Za-z_$][A-Za-z0-9_$]*)(?:<[^>]*>)? extends ([A-Za-z_$][A-Za-z0-9_$.]*)"
    python = r"^\s*class ([A-Za-z_][A-Za-z0-9_]*)\(([A-Za-z_][A-Za-z0-9_.]*)"
    implemented = r"(?:class|struct) ([A-Za-z_$][A-Za-z0-9_$]*)[^{]* implements ([A-Za-z_$][A-Za-z0-9_$.]*)"
    trait = r"^impl(?:<[^>]*>)? ([A-Za-z_][A-Za-z0-9_]*)(?:<[^>]*>)? for ([A-Za-z_][A-Za-z0-9_]*)"
    kinds = [("extends", header, 1, 2), ("extends", python, 1, 2), ("implements", implemented, 1, 2), ("implements", trait, 2, 1)]
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, c).alias("child"), F.regexp_extract("text", p, q).alias("parent")) for k, p, c, q in kinds])
    edges = numbered_lines(files).where(F.col("text").rlike("class |^impl|struct ")).select(*PLACE, "file", "line", F.explode(found).alias("e")).select(*PLACE, "file", "line", "e.*").where("parent != ''")
    wide = records.groupBy(*PLACE, F.col("name").alias("parent")).agg(F.count("*").alias("c"), F.min("id").alias("parent_id")).where("c = 1").drop("c")
    return edges.join(wide, [*PLACE, "parent"], "left")


def import_uses(files: DataFrame) -> DataFrame:
    """Uses of imported names with the latest import before them (as-of on the line within a file)."""
    scripts = files.where(F.col("language").isin("typescript", "javascript"))
    pattern = r"""^import \{([^}]*)\} from ["']([^"']+)["']"""
    lines = numbered_lines(scripts)
    clause = lines.where(F.col("text").rlike(pattern)).select(*PLACE, "file", "line", F.explode(F.split(F.regexp_extract("text", pattern, 1), ",")).alias("part"), F.regexp_extract("text", pattern, 2).alias("specifier"))
    bound = clause.select(*PLACE, "file", F.col("line").alias("import_line"), F.regexp_extract("part", r"([A-Za-z_$][A-Za-z0-9_$]*)\s*$", 1).alias("name"), "specifier").where("name != ''")
    uses = identifiers(scripts).groupBy(*PLACE, "file", "line", "name").agg(F.sum("n").alias("n"))
    later = uses.join(bound, [*PLACE, "file", "name"]).where("import_line < line")
    return later.groupBy(*PLACE, "file", "line", "name", "n").agg(F.max(F.struct("import_line", "specifier")).alias("b")).select(*PLACE, "file", "line", "name", "n", "b.import_line", "b.specifier")


def guard_scores(files: DataFrame, records: DataFrame, terms: list[str], pattern: str = r"^\s*if \((.+)\) ?\{?:?\s*$") -> DataFrame:
    """Declarations with guards that share terms with a question: 1 + 2 per shared term, the best guard."""
    from orefield.functions.text import terms_of

    guards = numbered_lines(files).withColumn("guard", F.regexp_extract("text", pattern, 1)).where("guard != ''").select(*PLACE, "file", "line", "guard")
    shared = F.size(F.array_intersect(terms_of(F.col("guard")), F.array(*map(F.lit, terms))))
    scored = owned(guards.withColumn("shared", shared).where("shared > 0").drop("guard"), records).where("owner_id is not null")
    return scored.groupBy(*PLACE, F.col("owner_id").alias("id")).agg(F.max(F.col("shared") * 2 + 1).alias("score"))


def test_framework(path, text):
    """Framework of a test file by its path and text; null if the path is no test's."""
    is_test = path.rlike(r"(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py)$")
    kind = F.when(text.rlike("from [\"']vitest"), "vitest").when(text.rlike(r"from [\"']mocha|require\([\"']mocha"), "mocha").when(text.rlike(r"@jest|jest\."), "jest").otherwise("unknown")
    return F.when(is_test, kind)


def guard_lists(files: DataFrame, records: DataFrame, pattern: str = r"^\s*if \((.+)\) ?\{?:?\s*$") -> DataFrame:
    """(place, id, guards): the distinct conditions inside each declaration in the order of their first lines."""
    guards = numbered_lines(files).withColumn("guard", F.regexp_extract("text", pattern, 1)).where("guard != ''").select(*PLACE, "file", "line", "guard")
    first = owned(guards, records).where("owner_id is not null").groupBy(*PLACE, F.col("owner_id").alias("id"), "guard").agg(F.min("line").alias("line"))
    return first.groupBy(*PLACE, "id").agg(F.array_sort(F.collect_list(F.struct("line", "guard"))).alias("g")).select(*PLACE, "id", F.col("g.guard").alias("guards"))


# Folders and file names that hold tests, fixtures or generated code.
NO_PRODUCTION = r"(^|/)(tests?|__tests__|spec|fixtures?|examples?|dist|build|vendor|node_modules)/|[._-](test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py)$|\.d\.ts$|\.min\.js$"


def production_files(files: DataFrame) -> DataFrame:
    """Files that are neither tests nor fixtures nor generated."""
    return files.where(~F.col("file").rlike(NO_PRODUCTION))


def missing_languages(files: DataFrame) -> DataFrame:
    """(extension, files): the extensions of files that no language of the index claims."""
    from orefield.functions.text import language_of_path

    odd = files.where(language_of_path(F.col("file")).isNull())
    return odd.groupBy(F.lower(F.regexp_extract("file", r"(\.[A-Za-z0-9]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"))
