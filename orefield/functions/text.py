"""Text expressions: query terms, lines, paths, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Extension of a source file and its language.
EXTENSION_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "php": "php", "go": "go", "rs": "rust",
}


def question_terms(question: str) -> list[str]:
    """Distinct terms of a question in order: camel case split, lower case, longer than one character."""
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", question)
    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+", split.lower()) if len(t) > 1))


def terms_of(text: Column) -> Column:
    """The same terms as an array column."""
    split = F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.array_distinct(F.filter(F.regexp_extract_all(split, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1))


def unix_lines(text: Column) -> Column:
    """The text's lines, whatever ends them."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", -1)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language_of_path(path: Column) -> Column:
    """Language by extension (case-sensitive); null for others."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return table[F.regexp_extract(path, r"\.([a-z]+)$", 1)]


def language_or_path(language: Column, path: Column) -> Column:
    """The given language in lower case, or the extension's."""
    return F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), language_of_path(path))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative specifier below a folder, with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
