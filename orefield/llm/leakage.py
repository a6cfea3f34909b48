"""Evaluation passages inside training texts.

Method: distributed positional inverted index. Terms are runs of three words. One pass over the corpus
emits the postings (term, document, position) of the terms that test items hold; they are stored
clustered by term, the lists of hot terms split. A search intersects the offset-adjusted lists (document
position minus item position) of each item's rarest terms; for what survives, the complete lists
are read and matched as exact phrases with few words replaced, skipped or added.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orefield.llm.encoding import text_blocks
from orefield.session import stored

#: A passage: span in words, and a run may skip so many words and drift so far in offset.
MIN_WORDS, EDGE_SLACK, GAP, DRIFT = 25, 2, 5, 6
#: Least share of a run's terms that match.
DENSITY = 0.42
#: Shared sentences of at most so many words are no passage by themselves.
SHORT_WORDS = 12
#: Hits are counted in windows of twice this width, each overlapping half of the next: of offsets, and of the item's
#: blank-separated words.
UNIT, SPAN = 16, 24
#: Seeds of a text are chosen so that its shortest passages show so many of them, or half of the terms asked for if that is less.
SEED_HITS = 4
#: The filters of the corpus pass and of the second read are bitmaps of so many bits (8 MB and 524,288 rows), however many
#: terms and candidates there are.
FILTER_BITS, KEY_BITS = 26, 24
#: A table of items' terms or of candidates up to this many rows is broadcast; a longer one is shuffled.
SMALL = 200_000
#: A worker forgets the hashes of words beyond this number; they are then computed again.
KNOWN_WORDS = 1_000_000

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)|\n")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,120}>")
UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
ESCAPE = re.compile(r"\\[nrtbfv0\"'/\\]")
PERCENT = re.compile(r"%[0-9a-fA-F]{2}")


@lru_cache(maxsize=1)
def _marks():
    import regex

    return regex.compile(r"[\p{M}\p{Cf}\p{So}\p{Sk}\p{Co}\p{Cn}\p{Cs}]|[^\P{Cc}\s]")


def plain_text(text: str) -> str:
    """The text without case, escaping, markup, marks and invisible characters."""
    for _ in range(3):
        if "&" not in text or (freed := html.unescape(text)) == text:
            break
        text = freed
    if "\\" in text:
        text = UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = ESCAPE.sub(" ", text)
    if "%" in text and PERCENT.search(text):
        text = unquote(text, errors="replace")
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = _marks().sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def words_of(text: str) -> list[str]:
    return WORD.findall(plain_text(text))


def words_at(text: str) -> list[int]:
    """For each word the number of the blank-separated word of the text that it lies in."""
    flat = plain_text(text)
    starts = np.array([m.start() for m in re.finditer(r"\S+", flat)] or [0])
    return (np.searchsorted(starts, [m.start() for m in WORD.finditer(flat)], "right") - 1).tolist()


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(first word, end, words, number of blank-separated words) of each sentence."""
    flat = plain_text(text)
    words = list(WORD.finditer(flat))
    at = words_at(text)
    ends = [m.start() for m in SENTENCE_END.finditer(flat)]
    group = np.searchsorted(ends, [w.start() for w in words], "right")
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(words)] if words else []
    return [(a, b, " ".join(w[0] for w in words[a:b]), at[b - 1] - at[a] + 1) for a, b in zip(cuts, cuts[1:])]


class WordHashes(dict):
    """64-bit hashes of words, equal in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        return found


HASHES = WordHashes()


def term_codes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, code) of the runs of three words of the texts, in order."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(texts)), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(ids)) - (np.cumsum(counts) - counts)[owner]
    if len(ids) < 3:
        return owner[:0], position[:0], ids[:0].view(np.int64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    code = (ids[:-2] * odd + ids[1:-1]) * odd + ids[2:]
    code ^= code >> np.uint64(29)
    code *= odd
    whole = owner[:-2] == owner[2:]
    return owner[:-2][whole], position[:-2][whole], code[whole].view(np.int64)


def _checked(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its number of rows is proven small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


# The items' side


def item_texts(items: DataFrame, item_key: str, fields: list[str]) -> DataFrame:
    """(text, item, sentence number, words, at, size, sentence, before, after, whole): a row per sentence of
    each text of an item; ``text`` numbers the texts."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f).alias("value")) for n, f in enumerate(fields)])).alias("t")
    texts = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), *fields).distinct()
    texts = texts.select("item", each).where("t.value is not null").select(F.monotonically_increasing_id().alias("text"), "item", F.col("t.value").alias("value"))
    schema = f"text bigint, item {texts.schema['item'].dataType.simpleString()}, number int, words array<string>, at array<int>, size int, sentence string, before string, after string, whole string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for n, value in enumerate(batch.column(2).to_pylist()):
                found, at = sentences(value), words_at(value)
                whole = " ".join(x[2] for x in found)
                around = [f"^{whole}", *(x[2] for x in found), f"{whole}$"]
                for k, (a, b, sentence, size) in enumerate(found):
                    take.append(n)
                    rows.append((k, sentence.split(" "), at[a:b], size, sentence, around[k], around[k + 2], whole))
            kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), *[pa.string()] * 4]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            keys = [batch.column(c).take(pa.array(take, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=[c.split()[0] for c in schema.split(", ")])

    return stored(texts.mapInArrow(run, schema))


def shared_sentences(told: DataFrame) -> DataFrame:
    """The short sentences that stand in several distinct texts of the items, there between other
    sentences: what a copied passage holds inside keeps a neighbour and isn't shared."""
    short = told.where(F.col("size") <= SHORT_WORDS).select("sentence", *[F.xxhash64(c).alias(c) for c in ("whole", "before", "after")])
    varied = [(F.min(c) != F.max(c)).alias(c) for c in ("whole", "before", "after")]
    return short.groupBy("sentence").agg(*varied).where("whole and before and after").select("sentence", F.lit(True).alias("shared"))


def item_terms(told: DataFrame) -> DataFrame:
    """(term, text, i, own, before, first, last): postings of the items' texts. ``own``: a word of the term is
    outside of shared sentences; ``before``: the own terms before it; ``first`` and ``last``: the
    blank-separated words that it spans."""
    marked = told.select("text", "number", "words", "at", "sentence").join(shared_sentences(told), "sentence", "left")
    parts = marked.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("number", "words", "at", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("parts"))
    joined = parts.select("text", F.flatten("parts.words").alias("words"), F.flatten("parts.at").alias("at"), F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: ~p["shared"]))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, i, code = term_codes(batch.column(1).to_pylist())
            at, own = (batch.column(c).to_pylist() for c in (2, 3))
            held = np.array([any(own[t][k : k + 3]) for t, k in zip(owner.tolist(), i.tolist())], np.int64)
            before = np.cumsum(held) - held
            before -= np.repeat(before[i == 0], np.unique(owner, return_counts=True)[1])
            ends = [np.array([at[t][k + n] for t, k in zip(owner.tolist(), i.tolist())], np.int32) for n in (0, 2)]
            columns = [pa.array(x) for x in (i.astype(np.int32), held > 0, before.astype(np.int32), *ends)]
            yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(pa.array(owner)), *columns], names=["term", "text", "i", "own", "before", "first", "last"])

    return stored(joined.mapInArrow(run, "term bigint, text bigint, i int, own boolean, before int, first int, last int"))


def bit_words(values: Column, bits: int) -> tuple[Column, Column]:
    """(word, bit) of a value in a bitmap of 2 ** bits bits, in words of 32 bits."""
    slot = F.shiftrightunsigned(values, 64 - bits)
    return F.shiftright(slot, 5).cast("int"), (slot % 32).cast("int")


def bitmap(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bits) of the set bits: at most 2 ** (bits - 5) rows, whatever the number of values."""
    word, bit = bit_words(F.col(column), bits)
    return values.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


# The index


def inverted_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, pos): the postings of all documents, stored clustered by term. One pass over the texts,
    whatever the number of items; a term that no item holds may pass the filter and finds no partner
    later. ``rebalance`` cuts the lists of hot terms where a partition outgrows the advised size."""
    spark = docs.sparkSession
    held = bitmap(terms, "term", FILTER_BITS).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(docs[key].alias("doc"), docs[text].alias("text")).where("doc is not null and text is not null")
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            for start, block in text_blocks(batch.column(1).to_pylist()):
                owner, position, code = term_codes([words_of(t) for t in block])
                slot = code.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
                hit = np.flatnonzero(filled[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                keys = batch.column(0).take(pa.array(owner[hit] + start))
                yield pa.RecordBatch.from_arrays([pa.array(code[hit]), keys, pa.array(position[hit].astype(np.int32))], names=["term", "doc", "pos"])

    postings = rows.mapInArrow(run, f"term bigint, doc {kind}, pos int")
    return stored(postings.hint("rebalance", "term").sortWithinPartitions("term", "doc"))


# Search


def choose_seeds(first: np.ndarray, last: np.ndarray, own: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a term is a seed, hits needed beside it) of a text's terms in order.

    In each shortest passage (a window of terms) at least ``asked`` of its own terms match. The most frequent
    ones are left out while in every window SEED_HITS of those asked for remain, or half of them if that is
    less; so a passage shows at least ``asked`` minus the left out ones among the seeds.
    """
    ends = np.searchsorted(last, first + MIN_WORDS - EDGE_SLACK - 1, "left") + 1  # the window that starts at each term
    starts = np.flatnonzero(ends <= len(first))
    ends = ends[starts]
    asked = np.array([max(1, np.ceil(DENSITY * own[a:b].sum())) for a, b in zip(starts, ends)], np.int64)
    most = np.maximum(asked // 2, asked - SEED_HITS)
    seed, missing = (count > 0) & own, np.zeros(len(starts), np.int64)
    for i in np.argsort(-count, kind="stable"):
        if seed[i]:
            over = (starts <= i) & (ends > i)
            if over.any() and (missing[over] < most[over]).all():
                seed[i] = False
                missing[over] += 1
    need = np.zeros(len(first), np.int64)
    for i in np.flatnonzero(seed):
        over = (starts <= i) & (ends > i)
        # Hits are told apart by their number modulo 64, so more terms than that may hide one another.
        hidden = -(-max(np.sum((first // SPAN == p) | (first // SPAN == p + 1)) for p in (first[i] // SPAN - 1, first[i] // SPAN)) // 64)
        need[i] = max(1, -(-(asked - missing)[over].min() // hidden)) if over.any() else 0
    return seed & (need > 0), need


def seeds_of(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(term, text, i, first, need): the rarest terms of each text that suffice to find every passage."""
    counts = index.groupBy("term").agg(F.count("*").alias("count"))
    told = terms.join(counts, "term", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("i", "term", "own", "first", "last", F.coalesce("count", F.lit(0)).alias("count")))).alias("t"))
    told = told.select("text", *[F.col(f"t.{c}").alias(c) for c in ("i", "term", "own", "first", "last", "count")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                i, term, own, first, last, count = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in range(1, 7))
                seed, need = choose_seeds(first, last, own.astype(bool), count)
                text = pa.array(np.repeat(batch.column(0)[n].as_py(), int(seed.sum())), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(term[seed]), text, pa.array(i[seed]), pa.array(first[seed]), pa.array(need[seed].astype(np.int32))], names=["term", "text", "i", "first", "need"])

    return stored(told.mapInArrow(run, "term bigint, text bigint, i int, first int, need int"))


def packed(band: Column, part: Column) -> Column:
    """A cell or window, from band and part, as one number."""
    return F.call_function("shiftleft", band.cast("bigint"), F.lit(32)) + part


def unpacked(cell: Column) -> tuple[Column, Column]:
    # A part is -1 at least, so one more makes it no borrower from the band.
    band = F.shiftright(cell + 1, 32)
    return band.cast("int"), (cell - F.call_function("shiftleft", band, F.lit(32))).cast("int")


def candidates(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc, text, window): where enough seeds of one stretch of a text stand at nearly one offset in a
    document."""
    band, part = F.floor((F.col("pos") - F.col("i")) / UNIT).cast("int"), F.floor(F.col("first") / SPAN).cast("int")
    # One shuffle of narrow rows, read twice: all that follows keeps its partitioning. ``mark``: hits needed, and the bit.
    hits = index.join(_checked(seeds), "term").select("doc", "text", packed(band, part).alias("cell"), (F.col("need") * 64 + F.col("i") % 64).alias("mark"))
    hits = hits.repartition("doc", "text")
    own, need = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("mark") % 64), F.shiftright("mark", 6)
    # Most pairs have too few seeds in all their windows together. The cells' bounds keep both reads of the shuffle alike.
    met = [F.bit_count(F.bit_or(own)).alias("n"), F.min(need).alias("need"), F.min("cell").alias("low"), F.max("cell").alias("high")]
    able = hits.groupBy("doc", "text").agg(*met).where("n >= need and low <= high").select("doc", "text")
    cells = hits.join(able.hint("shuffle_hash"), ["doc", "text"]).groupBy("doc", "text", "cell").agg(F.bit_or(own).alias("own"), F.min(need).alias("need"))
    band, part = unpacked(F.col("cell"))
    windows = F.explode(F.array(*[packed(band - b, part - p) for b in (0, 1) for p in (0, 1)])).alias("window")
    summed = cells.select("doc", "text", windows, "own", "need").groupBy("doc", "text", "window").agg(F.bit_count(F.bit_or("own")).alias("n"), F.min("need").alias("need"))
    return summed.where("n >= need").select("doc", "text", "window")


def passage(hits: list) -> bool:
    """Whether the offset-adjusted hits (i, pos, own, before, first, last) hold a passage: a run in both texts
    with few skipped words, long enough, and dense enough both in all its terms and in its own, which
    are those outside of shared sentences."""
    chains: list[list] = []  # each: first hit, last hit, hits, own hits
    for hit in sorted(set(hits)):
        best = None
        for c in chains:
            step, move = hit[0] - c[1][0], hit[1] - c[1][1]
            if 0 < step <= GAP + 2 and move > 0 and abs(move - step) <= DRIFT:
                if best is None or (abs(move - step), step) < best[0]:
                    best = (abs(move - step), step), c
        if best is None:
            chains.append([hit, hit, 1, int(hit[2])])
        else:
            best[1][1:] = hit, best[1][2] + 1, best[1][3] + hit[2]
    return any(
        b[5] - a[4] + 1 >= MIN_WORDS - EDGE_SLACK and n >= DENSITY * (b[0] - a[0] + 1) and own >= max(1, DENSITY * (b[3] + b[2] - a[3]))
        for a, b, n, own in chains
    )


def matched(index: DataFrame, terms: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, text) of the candidates whose complete lists hold a passage.

    The lists of documents without a candidate are left out by a bitmap of the candidates' keys, then the
    lists are joined by document and term. A group holds the hits of one window: at most its length in the
    item times its width in offsets, however often a document repeats a passage.
    """
    word, bit = bit_words(F.xxhash64("doc"), KEY_BITS)
    held = F.broadcast(bitmap(found.select(F.xxhash64("doc").alias("h")), "h", KEY_BITS))
    lists = index.join(held, word == held["word"]).where(F.getbit("bits", bit) == 1).select("term", "doc", "pos")
    # Each term of a text is wanted once, with the windows that its stretch lies in.
    stretches = found.select("doc", "text", "window", F.explode(F.array(*[unpacked(F.col("window"))[1] + p for p in (0, 1)])).alias("part"))
    stretches = stretches.groupBy("doc", "text", "part").agg(F.collect_list("window").alias("windows"))
    wanted = stretches.join(_checked(terms.withColumn("part", F.floor(F.col("first") / SPAN).cast("int"))), ["text", "part"]).drop("part")
    band = F.floor((F.col("pos") - F.col("i")) / UNIT).cast("int")
    near = F.filter("windows", lambda w: (band - unpacked(w)[0]).isin(0, 1))
    hit = F.struct("i", "pos", "own", "before", "first", "last").alias("hit")
    # The hits are shuffled once each, not once a window; the groups keep their partitioning.
    hits = lists.join(wanted, ["doc", "term"]).select("doc", "text", near.alias("windows"), hit).where(F.size("windows") > 0).repartition("doc", "text")
    groups = hits.select("doc", "text", F.explode("windows").alias("window"), "hit").groupBy("doc", "text", "window").agg(F.collect_list("hit").alias("hits"))
    schema = groups.select("doc", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, parts = batch.column(2), batch.column(2).values
            starts = lists.offsets.to_numpy()
            first, last = (parts.field(c).to_numpy()[: starts[-1]] for c in (4, 5))
            # Hits that span too few words together are no passage in any order; most are a short common phrase.
            wide = (np.maximum.reduceat(last, starts[:-1]) - np.minimum.reduceat(first, starts[:-1]) + 1 >= MIN_WORDS - EDGE_SLACK) if len(lists) else []
            columns = [parts.field(c).to_numpy(zero_copy_only=False).tolist() for c in range(6)]
            good = [bool(w) and passage(list(zip(*(c[a:b] for c in columns)))) for w, a, b in zip(wide, starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in (0, 1)], names=["doc", "text"])

    return groups.select("doc", "text", "hits").mapInArrow(run, schema).distinct()


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    fields: tuple[str, ...] = ("query", "answer"),
) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item's fields.

    A passage is at least 25 consecutive blank-separated words, whatever case, layout, punctuation,
    markup or escaping, with scattered words replaced; a run whose ends were replaced may show 2 words
    fewer. A run wholly of short sentences that several items share is none, however many documents
    hold a passage. Null keys, texts and fields hold nothing; items shorter than a passage can't leak;
    repeated rows of a document or an item count once, and texts under one key are searched as one
    document. Empty tables give an empty result. The answer to an item doesn't depend on the other
    documents, and on the other items only by the sentences they share.
    """
    told = item_texts(items, item_key, list(fields))
    terms = item_terms(told)
    index = inverted_index(docs, terms, key, text)
    found = stored(candidates(index, seeds_of(terms, index)))
    pairs = matched(index, terms, found)
    names = told.select("text", "item").distinct()
    return pairs.join(names, "text").select("doc", "item").distinct().toDF(key, item_key)
