"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal. The distinct words (pre-tokens) of a block of texts, in
sorted order, are the preorder of their trie. A depth-first walk keeps, for every prefix on the
current path, the last token of that prefix's encoding; the states of a shared prefix are computed
once. A prefix ends in the one vocabulary token t that is its suffix and may follow the last token of
the prefix before t. Following last tokens backwards gives a word's ids. The tokens that are a
prefix's suffixes are found by stepping an automaton over its bytes, whose states are the
beginnings of tokens.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Default vocabulary (a parameter of every operator): ranks of the public byte-level BPE of 50k tokens.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern of this vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are handled in blocks of about so many characters, which bounds a worker's memory.
BLOCK_CHARS = 1_000_000
#: A worker forgets its known words beyond this number; they are then computed again.
KNOWN_WORDS = 400_000

#: Class of an ASCII byte in that pattern: white space, letter, digit, other.
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3
ASCII_CLASS = np.full(128, OTHER, np.uint8)
ASCII_CLASS[list(b"\t\n\v\f\r ")] = BLANK
ASCII_CLASS[[c for c in range(128) if chr(c).isalpha()]] = LETTER
ASCII_CLASS[list(b"0123456789")] = DIGIT

#: Class of a word by its end: inside a phrase, clause end, sentence end, sentence end in wide script.
INSIDE, CLAUSE, SENTENCE, WIDE_SENTENCE = 0, 1, 2, 3


def read_ranks(path: str) -> bytes:
    """The vocabulary file's bytes; its size is fixed (0.8 MB), so it is broadcast to the executors."""
    with open(path, "rb") as file:
        return file.read()


def ascii_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of ASCII texts in a row, as WORD_PATTERN cuts them, and how many each text has."""
    data = "".join(texts).encode("ascii") + b"\0\0\0"  # so that two bytes after the last can be looked at
    byte, size = np.frombuffer(data, np.uint8), len(data) - 3
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    edge = np.zeros(len(data), bool)
    edge[begins] = True
    kind = ASCII_CLASS[byte]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[size:] = False
    at = np.flatnonzero(start)
    # The last blank before a word leaves the blanks before it; a space joins the word.
    word = at[(kind[at] != BLANK) & ~edge[at]]
    word = word[kind[word - 1] == BLANK]
    start[word - 1] = True
    start[word[byte[word - 1] == 32]] = False
    # Contractions, where an apostrophe begins a word.
    mark = at[byte[at] == 39]
    mark = mark[start[mark] & ~edge[mark + 1]]
    one, two = byte[mark + 1], byte[mark + 2]
    short = np.isin(one, list(b"stmd"))
    long = ~edge[mark + 2] & ((np.isin(one, list(b"rv")) & (two == 101)) | ((one == 108) & (two == 108)))
    start[mark[short | long] + 1] = False
    start[np.concatenate([mark[short] + 2, mark[long] + 3])] = True
    start[size:] = False
    at = np.flatnonzero(start)
    offsets = np.append(at, size).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(at, begins))


class PrefixEncoder:
    """Encodes sorted distinct words; knows every word it has met by a dense number.

    The tables over known words: token ids as one flat row with ``starts`` and ``sizes``, and the
    length in characters, the class of the end, whether white space leads, and how many line ends it
    holds (-1: not white space alone).
    """

    def __init__(self, ranks_file: bytes) -> None:
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(WORD_PATTERN).findall
        self._sorted = sorted(self.rank)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self._follows: dict[int, bool] = {}
        #: The automaton: each state's bytes, the tokens that are its suffixes, longest first, with their
        #: lengths, and the next state by state and byte.
        self._states: dict[bytes, int] = {b"": 0}
        self._suffixes: list[list[tuple[int, int]]] = [[]]
        self._bytes: list[bytes] = [b""]
        self._next: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.sizes = self.chars = self.ending = self.lines = np.zeros(0, np.int64)
        self.blank = np.zeros(0, bool)

    def merge(self, text: bytes, until: int = 1) -> list[bytes]:
        """Plain BPE of a short byte string: merge the pair of lowest rank until none or ``until`` parts are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > until:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a byte or a token that BPE never makes."""
        if token not in self._halves:
            text = self.bytes_of[token]
            parts = self.merge(text, 2) if len(text) > 1 else []
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The parts at one edge of a token over time, from the single byte to the token itself."""
        found = [token]
        while (halves := self._made_of(found[-1])) is not None:
            found.append(halves[side])
        return found[::-1]

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether the border between two neighbouring tokens stands: no merge across it comes before
        the merges that complete them. Of equal merges the left one comes first."""
        known = self._follows.get(before << 32 | token)
        if known is None:
            left, right = self._edge(before, 1), self._edge(token, 0)
            i = j = 0
            known = True
            while True:
                next_left = left[i + 1] if i + 1 < len(left) else 1 << 30
                next_right = right[j + 1] if j + 1 < len(right) else 1 << 30
                across = self.rank.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], 1 << 30)
                if across < next_left and across <= next_right and across < 1 << 30:
                    known = False
                    break
                if next_left == next_right == 1 << 30:
                    break
                if next_left <= next_right:
                    i += 1
                else:
                    j += 1
            self._follows[before << 32 | token] = known
        return known

    def _may_start(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._made_of(token) is not None

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest end of the bytes so far that begins a token."""
        text = self._bytes[state] + bytes([byte])
        while text:
            at = bisect_left(self._sorted, text)
            if at < len(self._sorted) and self._sorted[at].startswith(text):
                break
            text = text[1:]
        found = self._states.get(text)
        if found is None:
            found = self._states[text] = len(self._bytes)
            self._bytes.append(text)
            ends = (text[i:] for i in range(len(text)))
            self._suffixes.append([(self.rank[e], len(e)) for e in ends if e in self.rank])
        self._next[state << 8 | byte] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Encode unknown words by one depth-first walk over their trie."""
        bytes_of, follows, following, suffixes = self.bytes_of, self._follows.get, self._next.get, self._suffixes
        last: list[int] = [-1]  # last[d]: last token of the encoding of the path's first d bytes
        states = [0]  # the automaton's state after them
        before, flat, sizes, features = b"", [], [], []
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            top = min(len(before), len(data))
            while shared < top and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for end, byte in enumerate(data[shared:], shared + 1):
                after = following(state << 8 | byte)
                state = self._step(state, byte) if after is None else after
                states.append(state)
                for token, size in suffixes[state]:
                    if start := end - size:
                        fits = follows(last[start] << 32 | token)
                        if fits is None:
                            fits = self._may_follow(last[start], token)
                    else:
                        fits = self._may_start(token)
                    if fits:
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, end = [], len(data)
            while end:
                ids.append(last[end])
                end -= len(bytes_of[last[end]])
            before = data
            self.number[word] = len(self.number)
            flat.extend(reversed(ids))
            sizes.append(len(ids))
            lines = -1 if not word.isspace() else word.count("\n") or word.count("\r")
            features.append((len(word), ending_class(word), lines, word[0].isspace()))
        sizes, f = np.array(sizes, np.int64), np.array(features, np.int64).reshape(-1, 4)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.array(flat, np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.chars = np.concatenate([self.chars, f[:, 0]])
        self.ending = np.concatenate([self.ending, f[:, 1]])
        self.lines = np.concatenate([self.lines, f[:, 2]])
        self.blank = np.concatenate([self.blank, f[:, 3].astype(bool)])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in a row, and how many words each text has."""
        if len(self.number) > KNOWN_WORDS:
            self._reset()
        plain = [t.isascii() for t in texts]
        words, counts_plain = ascii_words([t for t, p in zip(texts, plain) if p])
        words = words.dictionary_encode()
        met = words.dictionary.to_pylist()
        split = [self.split(t) for t, p in zip(texts, plain) if not p]
        new = set(met).union(*split).difference(self.number)
        if new:
            self.learn(new)
        get = self.number.__getitem__
        counts = np.zeros(len(texts), np.int64)
        is_plain = np.array(plain, bool)
        counts[is_plain], counts[~is_plain] = counts_plain, np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(get, met), np.int64, len(met))[words.indices.to_numpy()]
        if not split:
            return numbers, counts
        flat, of_plain = np.empty(int(counts.sum()), np.int64), np.repeat(is_plain, counts)
        flat[of_plain] = numbers
        flat[~of_plain] = np.fromiter(map(get, chain.from_iterable(split)), np.int64, len(flat) - len(numbers))
        return flat, counts

    def tokens(self, flat: np.ndarray) -> np.ndarray:
        """The ids of a row of words."""
        size = self.sizes[flat]
        shift = self.starts[flat] - (np.cumsum(size) - size)
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))]


def ending_class(word: str) -> int:
    if word[-1] in "。！？":
        return WIDE_SENTENCE
    if word.rstrip("\"')]}»”’*_`")[-1:] in (".", "!", "?"):
        return SENTENCE
    return CLAUSE if word[-1] in ",;:，；：、)]}" else INSIDE


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes) -> PrefixEncoder:
    """One encoder per worker process and vocabulary; tasks of the same worker share its known words."""
    return PrefixEncoder(ranks_file)


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of consecutive blocks; null counts as empty."""
    start, block, size = 0, [], 0
    for at, text in enumerate(texts):
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield start, block
            start, block, size = at + 1, [], 0
    if block:
        yield start, block


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    A null and an empty text both give an empty list. Every row is kept, repeated ones too; strings of
    special tokens are ordinary text; other columns are ignored. No shuffle: each task encodes the
    distinct words of its rows once.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    key_type = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            keys = batch.column(0)
            for start, block in text_blocks(batch.column(1).to_pylist()):
                flat, counts = enc.words(block)
                values = enc.tokens(flat)
                ends = np.concatenate([[0], np.cumsum(enc.sizes[flat])])
                offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(block)), lists], names=["key", "ids"])

    return rows.mapInArrow(run, f"key {key_type.simpleString()}, ids array<int>").withColumnRenamed("key", key)
