"""Searches over file manifests and lines: globs and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from orefield.operators.structure import numbered_lines


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` don't, ``{a,b}`` is a choice."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def glob_files(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.col("file").rlike(glob_pattern(glob)))


def grep_lines(files: DataFrame, pattern: str) -> DataFrame:
    """Matching lines with their numbers; files without a match are dropped before they are split."""
    return numbered_lines(files.where(F.col("content").rlike(pattern))).where(F.col("text").rlike(pattern))


def json_entries(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key) of the first level of JSON objects; texts that aren't one valid JSON
    object have none (in brackets, so that a second value behind the first isn't overlooked)."""
    valid = documents.where(F.col(text).rlike(r"^\s*\{") & F.expr(f"try_parse_json(concat('[', {text}, ']'))").isNotNull())
    return valid.select("doc_id", F.explode(F.json_object_keys(text)).alias("key"))
