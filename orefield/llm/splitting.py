"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: dynamic programming over all boundary positions. The cost of a cut is the penalty of its
boundary class plus the squared deviation of the piece from the text's even piece size; the maximum
length, the overlap and a least advance from cut to cut are hard constraints. Where cuts at strong
boundaries alone cost less than one cut at a weaker boundary, no weaker one can be among the best, so
the programme over the strong ones, which are few, is the whole one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orefield.llm.encoding import BYTE_BPE_50K, CLAUSE, SENTENCE, WIDE_SENTENCE, PrefixEncoder, encoder, read_ranks, text_blocks

#: Penalty of a cut by boundary: paragraph, line, sentence, clause, between words, inside a word.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "clause": 6.0, "word": 10.0, "inside": 40.0}
IMBALANCE = 3.0
NAMES = list(PENALTY)
PRICES = np.array(list(PENALTY.values()))
#: Weakest boundary of the programmes that are tried before the one over all positions, and how many tokens
#: their positions must lie apart on average: of denser ones array operations are cheaper.
STRONG = (NAMES.index("paragraph"), NAMES.index("sentence"))
APART = 8
COLUMNS = "piece int, pieces int, start_char bigint, end_char bigint, tokens int, overlap int, boundary string, text string"


def word_boundaries(enc: PrefixEncoder, flat: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Index into NAMES of the boundary after each word of texts in a row, whose last words are at ``lasts``.

    A piece ends before the white space at its end, so its tokens are the text's own.
    """
    own, lines = enc.ending[flat], enc.lines[flat]
    after = np.append(lines[1:], -1)
    after[lasts] = -1
    second = np.append(after[1:], -1)
    opens = np.append(enc.blank[flat[1:]], True)
    opens[lasts] = True
    kind = np.full(len(flat), 5)
    kind[opens] = 4
    kind[(own == CLAUSE) & opens] = 3
    kind[((own == SENTENCE) & opens) | (own == WIDE_SENTENCE)] = 2
    kind[after > 0] = 1
    kind[(after > 1) | ((after > 0) & (second > 0))] = 0
    kind[lines >= 0] = 5  # white space itself
    return kind


def least_advance(limit: int, overlap: int) -> int:
    """Every piece but the last goes so many tokens beyond the one before: as many as it repeats, if that
    leaves room. Positions nearer to one another don't depend on one another."""
    return max(1, min(overlap, (limit - overlap) // 4))


def best_cuts(ends: np.ndarray, kind: np.ndarray, total: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(position, kind) of the cuts of least cost; ``ends`` are positions in tokens, the last is ``total``."""
    known = 0
    for weakest in STRONG:
        keep = kind <= weakest
        keep[-1] = True
        some = ends[keep]
        if len(some) * APART > total:
            break
        if len(some) > known and some[0] <= limit and np.diff(some, prepend=some[0]).max() <= limit - overlap:
            # Cuts with a weaker boundary cost its penalty at least.
            cuts = few_cuts(some, kind[keep], total, limit, overlap, PRICES[weakest + 1] - 1e-6)
            if cuts:
                return cuts
        known = len(some)
    return all_cuts(ends, kind, total, limit, overlap)


def terms(ends: np.ndarray, kind: np.ndarray, total: int, limit: int, overlap: int) -> tuple:
    """Even piece size; positions from 0 on; by position: penalty, terms of the deviation."""
    even = total / max(1, -(-(total - overlap) // (limit - overlap)))
    place = np.concatenate([[0], ends])
    at = place.astype(np.float64)
    penalty = np.concatenate([[0.0], PRICES[kind]])
    penalty[-1] = 0.0
    # The deviation (size / even - 1) squared, spread out so that a step costs few array operations:
    # the terms of the earlier position alone, of both, and of the later position alone.
    w = IMBALANCE / even
    own, both = w * at * (at / even + 2.0), 2.0 * w / even * at
    alone = w * at * (at / even - 2.0) + IMBALANCE
    return even, place, at, penalty, own, both, alone


def traced(back: list[int] | np.ndarray, place: list[int] | np.ndarray, kind: np.ndarray) -> list[tuple[int, int]]:
    cuts, j = [], len(place) - 1
    while j:
        cuts.append((int(place[j]), int(kind[j - 1])))
        j = int(back[j])
    return cuts[::-1]


def few_cuts(ends: np.ndarray, kind: np.ndarray, total: int, limit: int, overlap: int, below: float) -> list[tuple[int, int]]:
    """The cuts of the programme position by position, for positions that lie far apart; none where they
    don't cost less than ``below``."""
    place, at, penalty, own, both, alone = (x.tolist() for x in terms(ends, kind, total, limit, overlap)[1:])
    fresh, advance, last = limit - overlap, least_advance(limit, overlap), len(place) - 1
    inf, below = float("inf"), float(below)
    cost, back, spent, low, high, near = [inf], [0], inf, 1, 1, 0
    for j in range(1, last + 1):
        here, x = place[j], at[j]
        spent, choice = alone[j] if here <= limit and (here >= advance or j == last) else inf, 0
        while place[low] < here - fresh:
            low += 1
        while place[high] <= here - advance:
            high += 1
        end = high if j < last else last  # the last position has its own least advance
        if low < end:
            values = [c - b * x for c, b in zip(cost[low:end], both[low:end])]
            value = min(values)
            if value + alone[j] < spent:
                spent, choice = value + alone[j], low + values.index(value)
        spent += penalty[j]
        if spent < below:
            near = here
        elif here - near > limit:
            return []  # whatever follows costs as much
        cost.append(spent + own[j])  # serves the steps that start here
        back.append(choice)
    return traced(back, place, kind) if spent < below else []


def all_cuts(ends: np.ndarray, kind: np.ndarray, total: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The cuts of the programme over many positions, by array operations on groups of them."""
    even, place, at, penalty, own, both, alone = terms(ends, kind, total, limit, overlap)
    fresh = limit - overlap
    spent, cost, back = np.full(len(at), np.inf), np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    advance, last = least_advance(limit, overlap), len(at) - 1
    low = np.maximum(np.searchsorted(place, place - fresh), 1)
    high = np.searchsorted(place, place - advance, "right")
    high[-1] = last
    first = (place <= limit) & (place >= advance)
    first[-1] = place[-1] <= limit
    alone_first = np.where(first, alone, np.inf)
    # No deviation costs more than this, so an earlier position dearer by more than it is nowhere the best.
    most = IMBALANCE * max(1.0, (fresh / even - 1.0) ** 2)
    group = np.searchsorted(place, place + advance).tolist()
    lows, highs, j = low.tolist(), high.tolist(), 1
    while j <= last:
        k = min(group[j], last) if j < last else j + 1  # the last position has its own least advance
        best, choice = alone_first[j:k], np.zeros(k - j, np.int64)
        if (a := lows[j]) < (b := highs[k - 1]):
            rows = np.arange(a, b)
            if (c := lows[k - 1]) < (d := highs[j]):  # positions that all of j..k may follow
                rows = rows[spent[a:b] <= spent[c:d].min() + most + 1e-9]
            value = cost[rows] - both[rows] * at[j:k, None]
            value[(rows < low[j:k, None]) | (rows >= high[j:k, None])] = np.inf
            i = value.argmin(1)
            found = value[np.arange(k - j), i] + alone[j:k]
            better = found < best
            best, choice = np.where(better, found, best), np.where(better, rows[i], choice)
        spent[j:k], back[j:k] = best + penalty[j:k], choice
        cost[j:k] = spent[j:k] + own[j:k]  # serves the steps that start here
        j = k
    if not np.isfinite(cost[-1]):
        raise ValueError("no admissible cuts")
    return traced(back, place, kind)


class TextCutter:
    def __init__(self, enc: PrefixEncoder, limit: int, overlap: int) -> None:
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be below half the limit")
        self.enc, self.limit, self.overlap = enc, limit, overlap

    def char_at(self, token: int, token_end: np.ndarray, char_end: np.ndarray, flat: np.ndarray) -> tuple[int, int, int]:
        """(token, character, word or -1) of the last token boundary at or before ``token`` that splits no
        character; the word is the one it lies in."""
        w = int(np.searchsorted(token_end, token, "right"))
        first = int(token_end[w - 1]) if w else 0
        chars = int(char_end[w - 1]) if w else 0
        enc = self.enc
        while token > first:
            at = enc.starts[flat[w]]
            part = b"".join(enc.bytes_of[int(i)] for i in enc.ids[at : at + token - first])
            try:
                return token, chars + len(part.decode("utf-8")), w
            except UnicodeDecodeError:
                token -= 1
        return first, chars, -1

    def positions(self, flat, token_end, char_end, kind, fresh: int):
        """All boundary positions for the programme; inside words only where one is longer than half a piece."""
        keep = kind <= 4
        keep[-1] = True
        edge = np.concatenate([[0], token_end[keep]])
        wide = np.diff(edge) > fresh // 2
        if wide.any():
            keep |= wide[np.minimum(np.searchsorted(edge[1:], token_end, "left"), len(wide) - 1)]
        ends, kinds = token_end[keep], kind[keep]
        edge = np.concatenate([[0], ends])
        more: dict[int, int] = {}
        for i in np.flatnonzero(np.diff(edge) > fresh // 2):  # a word longer than half a piece
            step = max(1, fresh // 8)
            for token in range(int(edge[i]) + step, int(edge[i + 1]), step):
                token = self.char_at(token, token_end, char_end, flat)[0]
                if edge[i] < token < edge[i + 1]:
                    more[token] = 5
        if more:
            ends = np.concatenate([ends, list(more)]).astype(np.int64)
            kinds = np.concatenate([kinds, list(more.values())]).astype(np.int64)
            order = np.argsort(ends, kind="stable")
            ends, kinds = ends[order], kinds[order]
        return ends, kinds

    def pieces(self, texts: list[str], flat: np.ndarray, counts: np.ndarray) -> Iterator[list[tuple]]:
        """(start, end, tokens, overlap, boundary) of each piece, text by text; ``flat`` are the texts' words."""
        enc = self.enc
        tokens_to = np.concatenate([[0], np.cumsum(enc.sizes[flat])])
        totals = np.diff(tokens_to[np.concatenate([[0], np.cumsum(counts)])])
        long = totals > self.limit
        flat, ends = flat[np.repeat(long, counts)], np.cumsum(np.where(long, counts, 0))
        token_end, char_end = np.cumsum(enc.sizes[flat]), np.cumsum(enc.chars[flat])
        kind = word_boundaries(enc, flat, ends[long] - 1) if len(flat) else flat
        begin = tokens = chars = 0
        for text, total, end, is_long in zip(texts, totals.tolist(), ends.tolist(), long.tolist()):
            if not is_long:
                yield [(0, len(text), total, 0, "end")]
                continue
            of = slice(begin, end)
            yield self.cut(text, flat[of], token_end[of] - tokens, char_end[of] - chars, kind[of], self.limit)
            begin, tokens, chars = end, tokens + total, chars + len(text)

    def alone(self, text: str) -> int:
        """How many tokens a text has by itself."""
        number, sizes, merge = self.enc.number.get, self.enc.sizes, self.enc.merge
        known = [(number(w), w) for w in self.enc.split(text)]
        return int(sizes[[n for n, _ in known if n is not None]].sum()) + sum(len(merge(w.encode())) for n, w in known if n is None)

    def cut(self, text: str, flat, token_end, char_end, kind, limit: int) -> list[tuple]:
        """The pieces of a text of more than ``self.limit`` tokens, each aimed at ``limit`` of them."""
        enc, total = self.enc, int(token_end[-1])
        # Starts move back by up to 3 tokens where the overlap would begin inside a character.
        ends, kinds = self.positions(flat, token_end, char_end, kind, limit - self.overlap)
        cuts = best_cuts(ends, kinds, total, limit - 3, self.overlap)
        pieces, before = [], 0
        for n, (position, cut_kind) in enumerate(cuts):
            begin, start, word = self.char_at(before - self.overlap, token_end, char_end, flat) if n else (0, 0, -1)
            end = self.char_at(position, token_end, char_end, flat)[1]
            rest = text[start : int(char_end[word])] if word >= 0 else ""
            odd = rest and enc.split(text[start : start + len(rest) + 8])[:1] != [rest]
            if odd or (cut_kind == 5 and position < total):
                # An end inside a word may change how the piece alone is split into words.
                if self.alone(text[start:end]) > self.limit:
                    if limit <= self.limit // 2:
                        raise ValueError("a piece by itself has more tokens than the limit")
                    return self.cut(text, flat, token_end, char_end, kind, limit - 16)
            name = "end" if position == total else NAMES[cut_kind]
            pieces.append((start, end, position - begin, before - begin if n else 0, name))
            before = position
        return pieces


def split_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    overlap: int = 64,
    ranks_path: str = BYTE_BPE_50K,
) -> DataFrame:
    """Pieces of at most ``limit`` tokens, neighbours sharing ``overlap`` tokens, in order.

    Columns: key, piece (from 0), pieces, start_char, end_char (code points, half-open), tokens, overlap
    (tokens shared with the piece before), boundary (where the piece ends) and text. The pieces cover the
    text without loss: each starts at or before the end of the one before. A text up to the limit is one
    piece; a null text is one piece with null text and 0 tokens, an empty one a piece with empty text.
    An overlap grows by up to 3 tokens where it would begin inside a character. A piece that can't be kept
    under the limit raises an error. Repeated rows are cut
    each for itself; other columns are ignored. Narrow: no shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    key_type = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = TextCutter(encoder(ranks.value), limit, overlap)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, block in text_blocks(texts):
                flat, counts = cutter.enc.words(block)
                source, out = [], []
                for i, (value, found) in enumerate(zip(block, cutter.pieces(block, flat, counts))):
                    null = texts[start + i] is None
                    for p, (a, b, tokens, shared, name) in enumerate(found):
                        source.append(start + i)
                        out.append((p, len(found), a, b, tokens, shared, name, None if null else value[a:b]))
                columns = list(zip(*out))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                arrays = [keys.take(pa.array(source))] + [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", *(c.split()[0] for c in COLUMNS.split(", "))])

    return rows.mapInArrow(run, f"key {key_type.simpleString()}, {COLUMNS}").withColumnRenamed("key", key)
