"""Ranked retrieval: lexical and structural signals, ranks and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orefield.functions.text import unix_lines
from orefield.session import discard, stored

# Constant of reciprocal-rank fusion, weights of the signals, and words that open a gate.
RRF_K = 60
SIGNAL_WEIGHTS = {"lexical": 1, "semantic": 1, "structural": 1, "documentation": 3, "history": 3, "configuration": 3, "conditional": 3}
FIELD_WEIGHTS = {"name": 8, "signature": 3, "path": 2, "body": 1}
DOCUMENTATION_WORDS = ("confidence", "documentation", "document", "pilot", "benchmark")
CONFIGURATION_WORDS = ("package", "script")
GUARD_WORDS = ("gate", "gated", "gates", "gating", "guard", "guarded", "guards", "environment", "env", "enable", "enabled", "disable", "disabled", "flag", "conditional", "condition", "toggle")
HISTORY_WORDS = ("commit", "introduced", "history", "change")
TOP_DOCUMENTS, SEMANTIC_CANDIDATES, MOST_RESULTS = 3, 100, 100


def signals(terms: list[str], hybrid: bool = False) -> list[str]:
    """The signals that a question's terms open."""
    held, found = set(terms), ["lexical", "structural"]
    if held & set(DOCUMENTATION_WORDS):
        found.append("documentation")
    if held & set(GUARD_WORDS):
        found.append("conditional")
    if held & set(CONFIGURATION_WORDS) or {"test", "command"} <= held:
        found.append("configuration")
    if hybrid:
        found.append("semantic")
        if held & set(HISTORY_WORDS):
            found.append("history")
    return found


def contains_term(text: Column, term: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(term)), F.lit(False))


def term_score(terms: list[str], weights: dict[str, int]) -> Column:
    """Sum over distinct terms of the weights of the columns that contain them."""
    parts = [F.when(contains_term(F.col(c), t), w).otherwise(0) for t in terms for c, w in weights.items()]
    return reduce(Column.__add__, parts, F.lit(0))


def lexical_scores(records: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """(repository, commit_hash, id, score) of the declarations that hold a term: 8 for each in the names, 3 in
    the signature, 2 in the path, 1 in the body, which is the declaration's lines."""
    place = ["repository", "commit_hash", "file"]
    body = F.array_join(F.slice("lines", F.col("sl"), F.greatest(F.col("el") - F.col("sl") + 1, F.lit(0))), "\n")
    lines = files.select(*place, unix_lines(F.col("content")).alias("lines"))  # a file is split once, not for each declaration
    with_body = records.select(*place, "id", "sl", "el", "signature", F.concat_ws(" ", "name", "qualified_name").alias("names")).join(lines, place, "left")
    weights = {"names": FIELD_WEIGHTS["name"], "signature": FIELD_WEIGHTS["signature"], "file": FIELD_WEIGHTS["path"], "body": FIELD_WEIGHTS["body"]}
    # Every text is put in lower case once, not once for each term.
    low = with_body.withColumn("body", F.when(F.col("sl") > 0, body)).select("repository", "commit_hash", "id", *[F.lower(c).alias(c) for c in weights])
    parts = [F.when(F.contains(F.col(c), F.lit(t)), w).otherwise(0) for t in terms for c, w in weights.items()]
    return low.select("repository", "commit_hash", "id", reduce(Column.__add__, parts, F.lit(0)).alias("score")).where("score > 0")


def usable_vector(vector: str, width: int) -> Column:
    """Whether a vector has this many values, all finite and not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return F.coalesce((F.size(v) == width) & finite & F.exists(v, lambda a: a != 0), F.lit(False))


def term_hits(text: Column, terms: list[str]) -> Column:
    return reduce(Column.__add__, [contains_term(text, t).cast("int") for t in terms], F.lit(0))


def with_row_number(rows: DataFrame, order: list[Column], name: str = "rank", partition: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, over all rows or within each ``partition``.

    The rows are sorted by ranges and numbered within a range; the sizes of the ranges before are added.
    So neither the whole table nor a hot partition is ever in one task.
    """
    # Only the columns that are asked for further on should be given: the rows are stored, as a sort reads them twice.
    given = stored(rows)
    placed = stored(given.orderBy(*partition, *order).withColumn("_part", F.spark_partition_id()))
    discard(given)
    group = [F.col(c) for c in partition]
    sizes = placed.groupBy(*partition, "_part").agg(F.count("*").alias("_n"))  # a row per range and partition
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*partition, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    numbered = placed.withColumn("_inside", inside)
    match = F.lit(True)
    other = starts.select(*[F.col(c).alias(f"_{c}") for c in (*partition, "_part")], "_before")
    for c in (*partition, "_part"):
        match = match & numbered[c].eqNullSafe(other[f"_{c}"])
    joined = numbered.join(other, match)
    return joined.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int")).drop("_part", "_inside", "_before", "__part", *[f"_{c}" for c in partition])


def fused(lists: dict[str, DataFrame], key: list[str], weights: dict[str, int] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, rank): score and the sources with their ranks."""
    weights = weights or SIGNAL_WEIGHTS
    all_lists = [
        df.select(*key, F.lit(name).alias("source"), F.col("rank").cast("int").alias("rank"), (F.lit(float(weights[name])) / (F.lit(RRF_K) + F.col("rank"))).alias("part"))
        for name, df in lists.items()
    ]
    union = reduce(DataFrame.unionByName, all_lists)
    return union.groupBy(*key).agg(
        F.round(F.sum("part"), 12).alias("score"), F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("sources")
    )


def holds_a_term(text: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms: one expression however many there are, as a filter is copied to every
    side of the joins below it."""
    return F.coalesce(F.lower(text).rlike("|".join(rf"\Q{t}\E" for t in terms)), F.lit(False)) if terms else F.lit(False)


def document_matches(documents: DataFrame, terms: list[str], least: int = 2) -> DataFrame:
    """Documents with at least ``least`` of the terms: score, and the first line that holds one."""
    lines = unix_lines(F.col("text"))
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    first = F.filter(numbered, lambda x: term_hits(x["text"], terms) > 0)[0]
    scored = documents.withColumn("score", term_hits(F.col("text"), terms)).where(F.col("score") >= least)
    return scored.withColumn("first", first).select("doc_id", "score", F.col("first.line").alias("line"), F.trim("first.text").alias("excerpt"))


def script_scores(documents: DataFrame, terms: list[str], member: str | None = "scripts") -> DataFrame:
    """(doc_id, pointer, value, score) of the string entries of one member of JSON documents (of the whole object for
    null): 2 for each term that the path, the entry's name or its value holds. Texts that aren't one valid JSON
    object, and entries that aren't strings, have no score."""
    valid = documents.where(F.col("text").rlike(r"^\s*\{") & F.expr("try_parse_json(concat('[', text, ']'))").isNotNull())
    entries = F.from_json("text" if member is None else F.get_json_object("text", f"$.{member}"), "map<string,string>")
    texts = valid.select("doc_id", "path", F.explode(entries).alias("name", "value")).where(~F.col("value").rlike(r"^\s*[\[{]"))
    searched = F.concat_ws(" ", "path", "name", "value")
    pointer = F.concat(F.lit("/" if member is None else f"/{member}/"), F.col("name"))
    return texts.select("doc_id", pointer.alias("pointer"), "value", (term_hits(searched, terms) * 2).alias("score")).where("score >= 2")


def nearest_by_cosine(entries: DataFrame, query: list[float], vector: str = "embedding", top: int = SEMANTIC_CANDIDATES) -> DataFrame:
    """Exact cosine search: one scan, a partial top-k in every task. Unusable vectors don't take part."""
    width = len(query)
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fit = usable_vector(vector, width)
    literal = F.array(*[F.lit(float(q)) for q in query])
    dot = F.aggregate(F.zip_with(x, literal, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))
    length = sum(float(q) ** 2 for q in query) ** 0.5
    return entries.where(fit).withColumn("score", F.round(dot / (norm * F.lit(length)), 5)).orderBy(F.desc("score"), "symbol_id").limit(top)
