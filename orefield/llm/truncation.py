"""Text values cut off by field limits or in transfer.

Method: a structural completeness check. A stack automaton finds unclosed quotes, brackets, code
spans and markup, broken escapes and multibyte sequences, and signs of omission. Where a value lacks a
terminator, its last sentence is held against baselines counted over all values of its source, or over all
sources where it has too few: how often a sentence of the same shape ends there, with and without a
terminator; and over all whether its last word is a known word, ends sentences, and can end a phrase.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orefield.llm.syntax import LANGUAGES, SyntaxFault, balanced, usual_name
from orefield.session import stored

#: A last sentence counts as complete if its shape ends at least this share of the sentences that reach
#: it, or if its last clause does; a shape met in fewer sentences than ENOUGH needs half of them. Titles, which have no
#: terminators, and sentences that usually lack one need a larger share.
END_SHARE, CLAUSE_SHARE, BARE_SHARE, ENOUGH = 0.05, 0.15, 0.3, 12
#: A word is known from so many other uses; a word heads a phrase in at least this share of its uses there.
KNOWN_USES, HEAD_SHARE = 3, 0.08
#: A source's own baseline of a shape or clause serves from so many uses of it; below, that of all sources does.
SOURCE_ENOUGH = 60
#: A word of so many uses that ends a sentence, or a title, in less than this share of them leaves a phrase open.
OPEN_USES, OPEN_SHARE = 100, 0.01
#: Baselines up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000

# English words of closed classes, which give a sentence its shape.
DETERMINERS = frozenset("the a an its every each this these those their his her our no some any".split())
FUNCTION = DETERMINERS | frozenset(
    "of in on at by to from for with into over under above below after before during until unless when whenever while if because as "
    "so than then which that who whom whose what how why where and or but yet neither nor both either only not also otherwise instead "
    "one two it they them we you i he she is are was were be been being has have had do does did can could may might must shall should "
    "will would there here more most less least other another such same too very once twice again still never always just see".split()
)
CLAUSES = frozenset(", ; : unless when whenever while if because so which until before after and but yet otherwise as though although once".split())
OMISSION = re.compile(r"(?:…|\.\.\.|\[(?:cut|truncated|snip|snipped|continued|more|\.\.\.|…)\]|\((?:cut|truncated|continued)\)|<(?:cut|truncated)>)\s*$", re.IGNORECASE)
SO_ON = re.compile(r"\b(?:and so on|and so forth|etc)\s*(?:\.\.\.|…)\s*$", re.IGNORECASE)
TERMINATED = re.compile(r"[.!?。！？](?:[\"'”’)\]»`*_]*)\s*$")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|(?<=[。！？])\s*|\n+")
TOKEN = re.compile(r"`[^`]*`|\"[^\"]*\"|„[^“”]*[“”]|“[^”]*”|\d[\d.,]*(?:[a-z]{1,2}\b)?|[^\W\d_][\w'’]*|[^\w\s]")
CODE = re.compile(r"[;{}]\s*(?:\n|$)|=>|^\s*(?:[-+] )?(?:const|let|var|function|async|export|return|import|class|if|for|while)\b", re.MULTILINE)
CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def open_marks(text: str) -> str | None:
    """What a text leaves open: code span, quote, bracket, fence, escape or character."""
    if text.count("```") % 2:
        return "open fence"
    rest = re.sub(r"```.*?```", " ", text, flags=re.DOTALL)
    if rest.count("`") % 2:
        return "open code span"
    rest = re.sub(r"`[^`]*`", " ", rest)
    if rest.count('"') % 2:
        return "open quote"
    rest = re.sub(r'"[^"]*"', " ", rest)
    rest = re.sub(r"„[^„“”]*[“”]|“[^“”]*”", " ", rest)
    for a, b in ("«»", "「」", "『』", "（）"):
        if rest.count(a) > rest.count(b):
            return "open quote"
    if "„" in rest:
        return "open quote"
    stack = []
    for c in rest:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == {")": "(", "]": "[", "}": "{"}[c]:
            stack.pop()
    if stack:
        return "open bracket"
    if re.search(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&(?:[a-zA-Z]{1,7}|#\d*|#x[0-9a-fA-F]*)$|<[a-zA-Z/][^<>]{0,60}$|\ufffd$|[\ud800-\udbff]$", text):
        return "broken escape"
    return None


def code_fault(text: str, language: str | None = None) -> str | None:
    """Why a piece of code stops before its end: an open literal, delimiter, comment or statement. It is read by
    the lexer of its language; code of no known language isn't judged."""
    lexer = LANGUAGES.get(usual_name(language) if language else "typescript")
    if lexer is None:
        return None
    lines = text.rstrip().split("\n")
    if all(line[:1] in "+-@ " for line in lines) and any(line[:2] in ("+ ", "- ") for line in lines):
        last = lines[-1][1:].strip()
        ends = [line.rstrip()[-1:] for line in lines[:-1] if line[:1] in "+-" and line.rstrip()]
        if (fault := code_fault(last, language) if last else None) is not None:
            return fault
        return "cut statement" if ends and last and all(e in ";{},)" for e in ends) and last[-1] not in ";{},)" else None
    if len(lines) == 1 and "//" in text and lexer.comment.startswith("//"):
        # Comments in code that was put on one line have no end.
        return None if text.rstrip()[-1:] in "};)" else "cut statement"
    try:
        tokens = lexer.fragment(text)
        balanced(tokens)
    except SyntaxFault as fault:
        if str(fault).startswith("unbalanced"):
            return None
        return str(fault)
    last = tokens[-1] if tokens else None
    if last and last[0] == "op" and last[1] not in lexer.postfix | {";", ",", "..."} and not (last[1] == ":" and lexer is LANGUAGES["python"]):
        return "cut expression"
    if last and last[0] == "word" and last[1] in lexer.keywords - lexer.values - {"return", "break", "continue", "pass", "fallthrough", "raise"}:
        return "cut statement"
    return None


def shape(sentence: str) -> list[str]:
    """The sentence as a row of closed-class words and classes of the others, noun phrases as one."""
    out: list[str] = []
    for token in TOKEN.findall(sentence):
        low = token.lower()
        if token[0] == "`":
            out.append("ID")
        elif token[0] in "\"„“":
            out.append("QUOTE")
        elif token[0].isdigit():
            out.append("0")
        elif not token[0].isalpha():
            out.append(token)
        elif low in FUNCTION or "'" in low or "’" in low:
            out.append("DET" if low in DETERMINERS else low)
        else:
            before = out[-1] if out else ""
            kind = "ED" if low.endswith("ed") else "LY" if low.endswith("ly") else "XS" if re.search(r"(?<![su])s$", low) else "X"
            if before == "DET":
                out[-1] = "NP"  # whatever follows a determiner belongs to its phrase
            elif kind == "X" and before in ("NP", "X"):
                pass
            else:
                out.append(kind)
    return out


def last_clause(kinds: list[str]) -> str | None:
    """The shape from the last word that opens a clause; None if that is the whole sentence."""
    for i in range(len(kinds) - 1, 0, -1):
        if kinds[i] in CLAUSES:
            return " ".join(kinds[i:])
    return None


def final_key(sentence: str) -> str:
    """The last two words, or the last two characters of a script without spaces."""
    if CJK.search(sentence[-3:]):
        return sentence[-2:]
    return " ".join(t.lower() for t in TOKEN.findall(sentence)[-2:])


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in SENTENCE.split(text)) if s]


#: The counts of a baseline, by what their keys are; those of shapes and clauses are kept by source.
BASELINES = {"shape": ("pass", "end", "bare"), "clause": ("clause pass", "clause end"), "word": ("word", "head", "inner", "last", "title last"), "final": ("final",), "stem": ("stem",)}
WIDEST = max(map(len, BASELINES.values()))


def without_omission(text: str) -> str:
    """The text without the signs of omission at its end; itself where it has none."""
    value = text.rstrip()
    while (sign := OMISSION.search(value)) and not SO_ON.search(value):
        value = text = value[: sign.start()].rstrip()
    return text


def counted(values: list[tuple[str, str, str]]) -> Counter:
    """Baselines of a block of (source, field, text): shapes that pass or end, words in use, heads, final keys."""
    found: Counter = Counter()
    for source, field, text in values:
        if CODE.search(text):
            continue
        # A value that is known to be cut is no use of the word at which it stops, nor an end of its sentence.
        known = without_omission(text)
        cut = known != text or (field == "title" and open_marks(text.rstrip()) is not None)
        parts = sentences(known)
        for n, part in enumerate(parts):
            last = n == len(parts) - 1
            # The end of an unterminated last sentence is what is judged; in titles it is the rule.
            ended = bool(re.search(r"[.!?。！？][\"'”’)\]]*$", part)) or (field == "title" and last and not cut)
            body = re.sub(r"[.!?。！？]+([\"'”’)\]]*)$", r"\1", part)
            kinds = shape(body)
            scope = field if field == "title" else "prose"
            prefix = ""
            for i, kind in enumerate(kinds[:-1] if cut and last and not ended else kinds):
                prefix += " " + kind
                found[source, "pass" if i < len(kinds) - 1 else "end" if ended else "bare", scope + prefix] += 1
            if field != "title" and ended:
                starts = [i for i in range(1, len(kinds)) if kinds[i] in CLAUSES]
                for a, b in zip(starts, [*starts[1:], len(kinds)]):
                    for i in range(a + 1, b):
                        found[source, "clause pass", " ".join(kinds[a:i])] += 1
                    found[source, "clause end" if b == len(kinds) else "clause pass", " ".join(kinds[a:b])] += 1
            tokens = [t.lower() for t in TOKEN.findall(body)]
            for i, token in enumerate(tokens[:-1] if not (ended and field != "title") else tokens):
                if token[0].isalpha():
                    found["", "word", token] += 1
                    inside = i > 0 and tokens[i - 1][0].isalpha() and (tokens[i - 1] in DETERMINERS)
                    if inside and token not in FUNCTION:
                        after = tokens[i + 1] if i + 1 < len(tokens) else ""
                        plain = after[:1].isalpha() and after not in FUNCTION and "'" not in after
                        found["", "inner" if plain else "head", token] += 1
            if ended:
                if body != part:
                    found["", "final", final_key(body)] += 1  # not of titles without a terminator: cut ones among them grow with the table
                if tokens:
                    found["", "last" if field != "title" else "title last", tokens[-1]] += 1
    return found


def judged(field: str, text: str, language: str | None = None) -> tuple[str | None, ...]:
    """(reason, shape, clause, last word, final key): a structural reason, or the keys of the baselines; all null
    if the value is complete by itself. ``language`` is that of the code."""
    value = text.rstrip()
    if not value:
        return None, None, None, None, None
    if OMISSION.search(value) and not SO_ON.search(value):
        return "sign of omission", None, None, None, None
    if field == "suggested_code" or CODE.search(value):
        fault = code_fault(value, language)
        if fault is not None or field != "suggested_code":
            return fault, None, None, None, None
        return "cut expression" if re.fullmatch(r"[\w$]+(?:\.[\w$]*)+", value) else None, None, None, None, None
    opened = open_marks(value)
    if opened is not None:
        return opened, None, None, None, None
    if TERMINATED.search(value) and not re.search(r"\d\.$|\b(?:e\.g|i\.e|vs)\.$", value):
        return None, None, None, None, None
    parts = sentences(value)
    tail = re.sub(r"\.$", "", parts[-1]) if parts else value
    if re.match(r"(?:[-*•]|\d+[.)])\s", tail):
        tail = re.sub(r"^(?:[-*•]|\d+[.)])\s+", "- ", tail)
    tokens = TOKEN.findall(tail)
    last = tokens[-1] if tokens else ""
    if len(tokens) == 1 and re.fullmatch(r"[\w$.]*[a-z][A-Z][\w$.]*", tail):
        return None, None, None, None, None  # a name
    word = last.lower() if last[:1].isalpha() and (last.islower() or last[1:].islower()) and not CJK.search(last[-1]) else None
    kinds = shape(tail)
    scope = "title" if field == "title" else "prose"
    clause = last_clause(kinds)
    if not CJK.search(tail) and sum(t.lower() in FUNCTION for t in tokens) < 0.12 * len(tokens):
        # Perhaps no English sentence: its last word is judged, and a single phrase is whole.
        clause = "~ sentence" if sum(t[0].isalpha() for t in tokens) >= 4 else "~ phrase"
    return None, scope + "".join(" " + k for k in kinds), clause, word, final_key(tail)


def _values(reviews: DataFrame) -> DataFrame:
    """(id, model, field, text, language): the three fields of the latest row of every review."""
    row = F.struct("loaded_at", "model", "summary", "result_json", F.get_json_object("input_json", "$.language").alias("language")).alias("row")
    latest = reviews.where("id is not null").select("id", row).groupBy("id").agg(F.max("row").alias("row"))
    parsed = latest.select("id", "row.model", "row.language", "row.summary", F.from_json("row.result_json", "title string, suggested_code string").alias("j"))
    fields = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("summary", F.col("summary")), ("title", F.col("j.title")), ("suggested_code", F.col("j.suggested_code")))]
        )
    ).alias("v")
    return parsed.select("id", "model", "language", fields).select("id", "model", "v.field", "v.text", "language")


def _key(kind, value):
    return F.xxhash64(kind, value)


def text_baselines(texts: DataFrame) -> DataFrame:
    """(key, source, n0, n1, ...): how shapes, words and ends are used in all distinct texts (source, field,
    text) of each source. Keys are hashes of what is counted; see BASELINES for the columns."""

    def rows(total: Counter) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*total)] or [pa.array([], pa.string())] * 3
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.int64())], names=["source", "kind", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(counted(list(zip(*(c.to_pylist() for c in batch.columns)))))
            if len(total) > 200_000:
                yield rows(total)
                total = Counter()
        yield rows(total)

    distinct = texts.select(F.coalesce("source", F.lit("")).alias("source"), "field", "text").distinct()
    counts = distinct.mapInArrow(count, "source string, kind string, key string, n bigint")
    kinds = {k: (of, i) for of, names in BASELINES.items() for i, k in enumerate(names)}
    of = F.create_map(*[F.lit(x) for k, (t, _) in kinds.items() for x in (k, t)])[F.col("kind")]
    place = F.create_map(*[F.lit(x) for k, (_, i) in kinds.items() for x in (k, i)])[F.col("kind")]
    placed = counts.select("source", _key(of, F.col("key")).alias("hash"), place.alias("place"), "n", F.when((F.col("kind") == "word") & F.col("key").rlike(r"^\p{L}+$"), F.col("key")).alias("word"))
    sums = [F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(WIDEST)]
    return stored(placed.groupBy(F.col("hash").alias("key"), "source").agg(*sums, F.max("word").alias("word")))


def checked_values(reviews: DataFrame) -> DataFrame:
    """(review_id, model, field, reason) of every value; ``reason`` is null where the value is complete.

    Of repeated reviews the latest loaded_at counts. Null, empty and blank values are complete; a
    result that is no JSON object has no title and no code. Code is read by the lexer of the prompt's
    language; code of a language without one isn't judged. Baselines are counted over all distinct values of each
    model; a null model is a source like any other.
    """
    values = _values(reviews).where("text is not null")
    counts = text_baselines(values.where("field != 'suggested_code'").select(F.col("model").alias("source"), "field", "text"))
    return held_against(values, counts)


def held_against(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(review_id, model, field, reason) of values (id, model, field, text, language), given the baselines. Only
    values that aren't decided by themselves, a few, are joined with them: one row for each key they have."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(f, t, l) for f, t, l in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
            columns = [pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "model", "field", "reason", "shape", "clause", "word", "final"])

    told = values.select("id", "model", "field", "text", "language").mapInArrow(judge, "id string, model string, field string, reason string, shape string, clause string, word string, final string")
    told = stored(told)
    undecided = told.where("reason is null and shape is not null").drop("reason")
    keys = F.explode(F.array(*[F.struct(F.lit(of).alias("of"), F.col(c).alias("value")) for of, c in (("shape", "shape"), ("clause", "clause"), ("word", "word"), ("final", "final"), ("stem", "word"))])).alias("k")
    asked = undecided.select("id", "field", F.coalesce("model", F.lit("")).alias("source"), keys).where("k.value is not null").select("id", "field", "source", "k.of", _key(F.col("k.of"), F.col("k.value")).alias("key"))
    names = [f"n{i}" for i in range(WIDEST)]
    total = counts.groupBy("key").agg(*[F.sum(c).alias(f"all_{c}") for c in names])
    # Beginnings of known words: a last word that is none but begins one was cut.
    known = counts.where(F.col("word").isNotNull() & (F.col("n0") >= KNOWN_USES)).select("word", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1)))).alias("i")).where("i < length(word)")
    stems = known.select(_key(F.lit("stem"), F.expr("substring(word, 1, i)")).alias("key")).distinct().select("key", F.lit(1).cast("bigint").alias("all_n0"), *[F.lit(0).cast("bigint").alias(f"all_{c}") for c in names[1:]])
    total = total.unionByName(stems)
    own = counts.select("key", "source", *names)
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        total, own = F.broadcast(total), F.broadcast(own)
    found = asked.join(total, "key").join(own, ["key", "source"], "left")

    def of(kind: str, column: str, name: str):
        return F.coalesce(F.max(F.when(F.col("of") == kind, F.col(column))), F.lit(0)).alias(name)

    wanted = [of(kind, f"{side}n{i}", f"{side}{name}") for kind, counted in BASELINES.items() for i, name in enumerate(counted) for side in (("all_", "") if kind in ("shape", "clause") else ("all_",))]
    baselines = found.groupBy("id", "field").agg(*wanted)
    rows = undecided.join(baselines, ["id", "field"], "left").fillna(0)

    def best(kind: str):
        """Counts of the source where it has met the key often enough, of all sources otherwise."""
        enough = sum((F.col(c) for c in BASELINES[kind]), F.lit(0)) >= SOURCE_ENOUGH
        return {c: F.when(enough, F.col(c)).otherwise(F.col(f"all_{c}")) for c in BASELINES[kind]}

    n = best("shape") | best("clause") | {c: F.col(f"all_{c}") for kind in ("word", "final", "stem") for c in BASELINES[kind]}
    title = F.col("field") == "title"
    own = F.when(title, 1).otherwise(0)  # a title is counted among its own baselines
    end, reach = n["end"] - own, n["end"] - own + n["pass"]
    plain = F.col("word").rlike(r"^\p{L}+$")
    complete = (
        F.when((n["bare"] >= 5) & (n["bare"] >= BARE_SHARE * (n["bare"] + reach)), True)
        .when((n["clause end"] >= 3) & (n["clause end"] >= CLAUSE_SHARE * (n["clause end"] + n["clause pass"])), True)
        .when(reach >= ENOUGH, (end >= 2) & (end >= F.when(title, CLAUSE_SHARE).otherwise(END_SHARE) * reach))
        .otherwise(True)
    )
    clauses = n["clause end"] + n["clause pass"]
    complete = complete | (F.col("clause").isNotNull() & ~F.col("clause").startswith("~") & ((clauses < ENOUGH) | (n["clause end"] >= END_SHARE * clauses)))
    reason = (
        F.when(plain & (F.length("word") > 1) & (n["word"] < KNOWN_USES) & (n["stem"] > 0), F.lit("cut word"))
        .when(F.col("word").isNotNull() & (n["word"] >= OPEN_USES) & (n["last"] < OPEN_SHARE * n["word"]) & (n["title last"] - own < OPEN_SHARE * n["word"]), F.lit("open phrase"))
        .when(plain & (n["inner"] + n["head"] >= 5) & F.col("shape").endswith("NP") & (n["head"] < HEAD_SHARE * (n["head"] + n["inner"])), F.lit("cut phrase"))
        .when(complete, None)
        .when(F.col("clause") == "~ phrase", None)
        .when(F.col("clause") == "~ sentence", F.when(n["last"] < 2, F.lit("cut sentence")))
        .when(n["final"] >= 2, None)
        .otherwise(F.lit("cut sentence"))
    )
    judged_rows = rows.select(F.col("id").alias("review_id"), "model", "field", reason.alias("reason"))
    return told.where("reason is not null or shape is null").select(F.col("id").alias("review_id"), "model", "field", "reason").unionByName(judged_rows)


def cut_values(reviews: DataFrame) -> DataFrame:
    """(review_id, field, reason) of the values that stop before their end."""
    return checked_values(reviews).where("reason is not null").select("review_id", "field", "reason")


def cut_rates(reviews: DataFrame) -> DataFrame:
    """Values, cut values and rate of each model, per field and in all (null field)."""
    return (
        checked_values(reviews)
        .groupBy("model", "field")
        .agg(F.count("*").alias("values"), F.count("reason").alias("cut"))
        .rollup("model", "field")
        .agg(F.sum("values").alias("n_values"), F.sum("cut").alias("n_cut"))
        .where("model is not null")
        .withColumn("rate", F.round(F.col("n_cut") / F.col("n_values"), 6))
    )
