"""Declarations and other facts from source text by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orefield.operators.structure import PLACE, numbered_lines

# Lines that declare a name, by language; the name is the last group.
DECLARATIONS = {
    "typescript": r"^\s*(?:export )?(?:default )?(?:abstract )?(?:async )?(?:function|class|interface|enum|namespace) ([A-Za-z_$][A-Za-z0-9_$]*)|^(?:export )?const ([A-Za-z_$][A-Za-z0-9_$]*) = (?:async )?\(",
    "javascript": r"^\s*(?:export )?(?:default )?(?:async )?(?:function|class) ([A-Za-z_$][A-Za-z0-9_$]*)|^(?:export )?const ([A-Za-z_$][A-Za-z0-9_$]*) = (?:async )?\(",
    "python": r"^\s*(?:async )?(?:def|class) ([A-Za-z_][A-Za-z0-9_]*)",
    "php": r"^\s*(?:abstract |final )?(?:(?:public|private|protected|static) )*(?:function|class|interface|trait) ([A-Za-z_][A-Za-z0-9_]*)",
    "go": r"^(?:func (?:\([^)]*\) )?|type )([A-Za-z_][A-Za-z0-9_]*)",
    "rust": r"^\s*(?:pub )?(?:async )?(?:fn|struct|enum|trait|mod) ([A-Za-z_][A-Za-z0-9_]*)",
}


def declared_names(files: DataFrame) -> DataFrame:
    """(place, file, language, line, name) of lines that look like declarations."""
    found = None
    for language, pattern in DECLARATIONS.items():
        groups = pattern.count("([A-Za-z")
        name = F.coalesce(*[F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in range(1, groups + 1)])
        found = F.when(F.col("language") == language, name) if found is None else found.when(F.col("language") == language, name)
    return numbered_lines(files).withColumn("name", found).where("name is not null").select(*PLACE, "file", "language", "line", "name")


# Lines of Python that declare, import or inherit.
PYTHON_FACTS = {
    "class": r"^\s*class ([A-Za-z_][A-Za-z0-9_]*)", "def": r"^(\s*)(?:async )?def ([A-Za-z_][A-Za-z0-9_]*)",
    "import": r"^\s*(?:from (\.*[A-Za-z0-9_.]*) import |import ([A-Za-z0-9_.]+))", "extends": r"^\s*class [A-Za-z_][A-Za-z0-9_]*\(([^()=]+)\)",
}


def python_index(files: DataFrame) -> DataFrame:
    """(place, file, line, kind, name) of the lines of Python files that declare a class, function, method or
    constructor, import a module, or name a base. An indented function counts as a method."""
    lines = numbered_lines(files.where("language = 'python'"))

    def group(kind: str, n: int):
        return F.regexp_extract("text", PYTHON_FACTS[kind], n)

    indented = F.when(group("def", 1) == "", "function").when(group("def", 2) == "__init__", "constructor").otherwise("method")
    imported = F.coalesce(F.nullif(group("import", 1), F.lit("")), group("import", 2))
    facts = F.array(
        *[F.when(F.col("text").rlike(PYTHON_FACTS[k]), F.struct(kind.alias("kind"), name.alias("name"))) for k, kind, name in (
            ("class", F.lit("class"), group("class", 1)), ("def", indented, group("def", 2)), ("import", F.lit("import"), imported))]
    )
    bases = F.transform(F.split(F.when(F.col("text").rlike(PYTHON_FACTS["extends"]), group("extends", 1)), ","), lambda b: F.struct(F.lit("extends").alias("kind"), F.trim(b).alias("name")))
    found = F.explode(F.concat(F.filter(facts, lambda f: f.isNotNull()), F.coalesce(bases, F.expr("array()").cast("array<struct<kind:string,name:string>>")))).alias("f")
    return lines.select(*PLACE, "file", "line", found).select(*PLACE, "file", "line", "f.kind", "f.name")
