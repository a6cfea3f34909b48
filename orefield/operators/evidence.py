"""Evidence: lines as exact quotes, coverage of requirements, packed windows, synthesis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orefield.functions.text import one_space, unix_lines
from orefield.operators.ranking import contains_term
from orefield.session import stored

# Bounds of packed evidence (lines and characters per candidate, characters per line, files).
MOST_LINES, MOST_CHARS, LINE_CHARS, MOST_FILES = 20, 1_400, 180, 6


def required_lines(items: DataFrame) -> DataFrame:
    """(item_id, manifest, language, file, line, text) of every required location."""
    return items.select("item_id", "manifest", "language", F.explode("required").alias("r")).select("item_id", "manifest", "language", "r.file", "r.line", "r.text")


def line_coverage(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Per item the required lines, how many stand in their file at their line (a null file or line is any),
    how many of the others stand elsewhere in the sources, and how many nowhere. Texts are compared aside from white
    space; a blank line is covered by a blank line at its place, and stands nowhere else."""
    required = required_lines(items).withColumn("quote", one_space(F.col("text"))).withColumn("n", F.monotonically_increasing_id())
    required = stored(required)
    have = lines.select("file", "line", one_space(F.col("text")).alias("quote"))
    quotes = required.select("quote").distinct()
    have = stored(have.join(quotes, "quote", "left_semi").distinct())  # few of all lines are asked for
    placed = required.where("file is not null and line is not null").join(have, ["file", "line", "quote"], "left_semi")
    in_file = required.where("file is not null and line is null").join(have.select("file", "quote").distinct(), ["file", "quote"], "left_semi")
    at_line = required.where("file is null and line is not null").join(have.select("line", "quote").distinct(), ["line", "quote"], "left_semi")
    somewhere = required.join(have.where("quote != ''").select("quote").distinct(), "quote", "left_semi")
    free = somewhere.where("file is null and line is null")
    found = placed.select("n").unionByName(in_file.select("n")).unionByName(at_line.select("n")).unionByName(free.select("n")).withColumn("here", F.lit(1))
    told = required.join(found, "n", "left").join(somewhere.select("n", F.lit(1).alias("there")), "n", "left")
    return told.groupBy("item_id", "manifest", "language").agg(
        F.count("*").alias("required"), F.count("here").alias("covered"), F.count_if(F.col("here").isNull() & F.col("there").isNotNull()).alias("elsewhere"),
        F.count_if(F.col("here").isNull() & F.col("there").isNull()).alias("missing"),
    )


def alternatives_covered(coverage: DataFrame) -> DataFrame:
    """A manifest and language is covered if ANY of its items has ALL of its lines at their place, quoted if any has
    all of them at all."""
    whole = F.col("required") == F.col("covered")
    return coverage.groupBy("manifest", "language").agg(
        F.count("*").alias("alternatives"), F.count_if(whole).alias("complete"), F.bool_or(whole).cast("int").alias("covered"), F.bool_or(F.col("missing") == 0).cast("int").alias("quoted"),
    )


def packed_windows(texts: DataFrame, key: list[str], text: str, terms: list[str], around: int = 2) -> DataFrame:
    """Lines around matches, per text in order, within the bounds on lines and characters.

    The bounds are the feature: what exceeds them is counted in ``left_out`` of every kept line's text.
    """
    lines = texts.select(*key, F.posexplode(unix_lines(F.col(text))).alias("pos", "line_text"))
    match = reduce(Column.__or__, [contains_term(F.col("line_text"), t) for t in terms])
    by = Window.partitionBy(*key)
    near = by.orderBy("pos").rowsBetween(-around, around)
    chosen = lines.withColumn("near", F.max(match.cast("int")).over(near)).where("near = 1").withColumn("line_text", F.substring("line_text", 1, LINE_CHARS))
    running = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = chosen.withColumns({"place": F.count("*").over(running), "chars": F.sum(F.length("line_text")).over(running), "all": F.count("*").over(by)})
    kept = counted.where((F.col("place") <= MOST_LINES) & (F.col("chars") <= MOST_CHARS))
    return kept.select(*key, (F.col("pos") + 1).alias("line"), "line_text", (F.col("all") - F.count("*").over(by)).alias("left_out"))


def synthesis(claims: DataFrame, group: list[str], supported: Column, citation: Column) -> DataFrame:
    """Per group the distinct citations of supported claims in order, and the ids of the others."""
    return claims.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(supported, citation))), "; ").alias("citations"),
        F.count_if(supported).alias("supported"), F.count_if(~F.coalesce(supported, F.lit(False))).alias("omitted"),
    )


def term_rarity(files: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each term the files that hold it as a word and its weight, length over frequency."""
    held = files.select("repository", "commit_hash", "file", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("term"))
    return held.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("files")).withColumn("weight", F.round(F.length("term") / F.col("files"), 9))


def bundles(windows: DataFrame, group: list[str], most_parts: int = 6, most_chars: int = 24_000) -> DataFrame:
    """Packed lines per group: parts, distinct lines, characters, and whether a bound is exceeded."""
    return windows.groupBy(*group).agg(
        F.countDistinct("doc_id").alias("parts"), F.count("*").alias("lines"), F.sum(F.length("line_text")).alias("chars")
    ).withColumn("overflow", ((F.col("parts") > most_parts) | (F.col("chars") > most_chars)).cast("int"))


def cited_names(items: DataFrame, records: DataFrame, text: str) -> DataFrame:
    """Per item the distinct code spans of a text and how many are names of declarations."""
    spans = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_]*)`"), F.lit(1)))).alias("name"))
    known = records.select("name", F.lit(1).alias("known")).distinct()
    return spans.join(known, "name", "left").groupBy("item_id").agg(F.count("*").alias("cited"), F.count("known").alias("known"))


def numbered(windows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """References E1, E2, ... of the packed lines of each group, in order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return windows.withColumn("ref", F.concat(F.lit("E"), place.cast("string")))


def checked_selection(selections: DataFrame, references: DataFrame, group: list[str]) -> DataFrame:
    """Selected references with their exact-quote check: ``valid``, ``unknown reference``, ``quote not found``
    or ``empty quote``. A selection that repeats one counts once; earlier valid ones are kept by a union."""
    chosen = selections.select(*group, "ref", "quote").distinct()
    told = chosen.join(references.select(*group, "ref", "line_text"), [*group, "ref"], "left")
    state = (
        F.when(F.col("line_text").isNull(), "unknown reference").when(F.coalesce(F.trim("quote"), F.lit("")) == "", "empty quote")
        .when(F.contains(one_space(F.col("line_text")), one_space(F.col("quote"))), "valid").otherwise("quote not found")
    )
    return told.withColumn("state", state).drop("line_text")


def missing_requirements(lines: DataFrame, group: list[str], requirements: dict[str, tuple[str, int]]) -> DataFrame:
    """Per group and requirement (a pattern and how many distinct lines must match) what was found; one
    pass over the lines whatever the number of requirements."""
    counts = [F.count_distinct(F.when(F.col("line_text").rlike(p), F.col("line_text"))).alias(n) for n, (p, _) in requirements.items()]
    found = lines.groupBy(*group).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("requirement"), F.col(n).alias("found"), F.lit(least).alias("least")) for n, (_, least) in requirements.items()])
    return found.select(*group, F.explode(pairs).alias("r")).select(*group, "r.*").withColumn("missing", (F.col("found") < F.col("least")).cast("int"))


def foreign_owners(citations: DataFrame, group: list[str]) -> DataFrame:
    """Distinct citations (file, line) of each group whose owner (owner_file, owner_line) isn't the target's
    (target_file, target_line). A group without a target, and a citation without an owner, have none."""
    known = citations.where("target_file is not null and target_line is not null and owner_file is not null and owner_line is not null")
    return known.where("owner_file != target_file or owner_line != target_line").select(*group, "file", "line").distinct()


def record_fidelity(expected: DataFrame, actual: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Per group the expected records, how many the answer gives at the same ``position`` in every field (null equals
    null), whether file and line agree at all positions, and the records too many."""
    a = expected.select(*group, "position", *[F.col(f).alias(f"want_{f}") for f in fields], F.lit(1).alias("wanted"))
    b = actual.select(*group, "position", *[F.col(f).alias(f"got_{f}") for f in fields], F.lit(1).alias("given"))
    both = a.join(b, [*group, "position"], "full")
    equal = F.lit(True)
    for f in fields:
        equal = equal & F.col(f"want_{f}").eqNullSafe(F.col(f"got_{f}"))
    placed = F.col("want_file").eqNullSafe(F.col("got_file")) & F.col("want_line").eqNullSafe(F.col("got_line"))
    there = F.col("wanted").isNotNull() & F.col("given").isNotNull()
    return both.groupBy(*group).agg(F.count("wanted").alias("records"), F.count_if(there & equal).alias("exact"), F.bool_and(there & placed).alias("located"), F.count_if(F.col("wanted").isNull()).alias("extra"))
