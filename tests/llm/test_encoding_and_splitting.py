import base64
import random

import numpy as np
import pytest

from orefield.llm import encoding, splitting

PATH = encoding.BYTE_BPE_50K


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=encoding.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts(n=150):
    rng = random.Random(1)
    parts = ["the ", "readToken", "\n\n", "  ", "\t", "é", "日本語", "🧾", "don't", "1,600", "`x`", "<|endoftext|>", ".", "—", "ab" * 40, "\r\n", "​", " 'll", "ÃƒÂ©", "!!!???", "a b", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_ids_equal_a_plain_tokenizer(spark, reference):
    values = [*texts(), "", None, " ", "x" * 3000, "<|endoftext|>", "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(values)], "doc_id long, text string, ids string").repartition(5)
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(values)}


def test_small_blocks_and_forgetting_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(encoding, "KNOWN_WORDS", 5)
    enc = encoding.PrefixEncoder(encoding.read_ranks(PATH))
    for t in texts(40):
        flat, _ = enc.words([t])
        assert enc.tokens(flat).tolist() == reference(t)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.encode_corpus(df).collect() == [] == splitting.split_texts(df).collect()


def corpus():
    rng = random.Random(3)
    words = ["cursor", "the", "snapshot.", "is", "sealed,", "`readToken`", "日本語の文章です。", "x" * 30, "été", "\n", "\n\n", "    ", "🧾🧾🧾"]
    long = [" ".join(rng.choice(words) for _ in range(rng.randrange(300, 1500))) for _ in range(25)]
    return [*long, "x" * 9000, "日本語" * 900, " " * 4000 + "end", "\n" * 3000, "🧾" * 1500, "short text", "", None, "a. " * 2000]


def test_pieces_lose_nothing_and_keep_the_bounds(spark, reference):
    values = corpus()
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    found = {}
    for r in splitting.split_texts(df).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(range(len(values)))
    for i, text in enumerate(values):
        pieces = sorted(found[i], key=lambda r: r.piece)
        ids = reference(text or "")
        assert [p.piece for p in pieces] == list(range(len(pieces))) and {p.pieces for p in pieces} == {len(pieces)}
        if len(ids) <= 512:
            assert len(pieces) == 1 and pieces[0].text == text and pieces[0].tokens == len(ids)
            continue
        assert pieces[0].start_char == 0 and pieces[-1].end_char == len(text)
        for before, p in zip([None, *pieces], pieces):
            assert p.text == text[p.start_char : p.end_char] and p.tokens <= 512 and len(reference(p.text)) <= 512
            if before is not None:
                assert p.start_char <= before.end_char and 64 <= p.overlap <= 67
        assert sum(p.tokens - p.overlap for p in pieces) == len(ids)


def test_cuts_are_of_least_cost():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ends = np.unique(rng.integers(1, 120, 25)).astype(np.int64)
        kind = rng.integers(0, 6, len(ends))
        total, limit, overlap = int(ends[-1]), 50, 8
        fresh = limit - overlap
        even = total / max(1, -(-(total - overlap) // fresh))
        price = [splitting.PENALTY[n] for n in splitting.NAMES]
        best = {0: 0.0}
        for j, e in enumerate(ends, 1):
            cost = np.inf
            for a, s in enumerate([0, *ends][:j]):
                room = limit if a == 0 else fresh
                if e - s <= room and a in best:
                    cost = min(cost, best[a] + splitting.IMBALANCE * ((e - s) / even - 1) ** 2)
            if np.isfinite(cost):
                best[j] = cost + (price[kind[j - 1]] if j < len(ends) else 0)
        if len(ends) not in best:
            with pytest.raises(ValueError):
                splitting.best_cuts(ends, kind, total, limit, overlap)
            continue
        cuts, cost, s = splitting.best_cuts(ends, kind, total, limit, overlap), 0.0, 0
        for position, k in cuts:
            cost += splitting.IMBALANCE * ((position - s) / even - 1) ** 2 + (price[k] if position < total else 0)
            s = position
        assert cost == pytest.approx(best[len(ends)])


def test_cuts_prefer_paragraphs(spark):
    sentence = "The cursor is kept for 900 days and then sealed by the watcher of the snapshot. "
    text = "\n\n".join(sentence * 12 for _ in range(8))
    kinds = [r.boundary for r in splitting.split_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert set(kinds[:-1]) == {"paragraph"} and kinds[-1] == "end"


def test_cuts_cost_as_little_as_those_of_a_plain_programme():
    import numpy as np

    from orefield.llm import splitting

    def plain(ends, kind, total, limit, overlap):
        """Least cost over all positions, one by one."""
        fresh = limit - overlap
        even = total / max(1, -(-(total - overlap) // fresh))
        at, penalty = [0, *ends.tolist()], [0.0, *(list(splitting.PENALTY.values())[k] for k in kind)]
        penalty[-1], least = 0.0, splitting.least_advance(limit, overlap)
        cost = [0.0] + [float("inf")] * len(ends)
        for j in range(1, len(at)):
            for i in range(j):
                size = at[j] - at[i]
                if size <= (fresh if i else limit) and (size >= least or j == len(at) - 1):
                    cost[j] = min(cost[j], cost[i] + penalty[j] + splitting.IMBALANCE * (size / even - 1) ** 2)
        return cost[-1]

    def cost(cuts, total, limit, overlap):
        even, spent, before = total / max(1, -(-(total - overlap) // (limit - overlap))), 0.0, 0
        for position, kind in cuts:
            spent += splitting.IMBALANCE * ((position - before) / even - 1) ** 2 + (0.0 if position == total else list(splitting.PENALTY.values())[kind])
            before = position
        return spent

    rng = np.random.default_rng(1)
    for n in range(1000):
        limit = int(rng.integers(20, 60))
        overlap = int(rng.integers(0, limit // 3))
        ends = np.cumsum(rng.integers(1, 4, int(rng.integers(limit, 4 * limit))))
        kind = rng.choice(5, len(ends), p=(0.03, 0.07, 0.1, 0.1, 0.7))
        told = ends, kind, int(ends[-1]), limit, overlap
        if told[2] > limit:
            assert abs(cost(splitting.best_cuts(*told), *told[2:]) - plain(*told)) < 1e-6


def test_words_of_ascii_texts_are_those_of_the_pattern():
    import regex

    rng, split = random.Random(6), regex.compile(encoding.WORD_PATTERN).findall
    letters = list("' sstrevlmdSAb1,.\n\r\t\x0b\x0c\x1c\x1f\x00\x7f") + ["'ll", "'re", " '"]
    for _ in range(300):
        block = ["".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(rng.randrange(20))]
        words, counts = encoding.ascii_words(block)
        assert words.to_pylist() == [w for t in block for w in split(t)] and counts.tolist() == [len(split(t)) for t in block]


def test_ascii_texts_need_no_search_by_pattern(reference):
    enc = encoding.PrefixEncoder(encoding.read_ranks(PATH))
    seen = []
    enc.split = lambda text: seen.append(text) or [text]
    block = ["don't  stop", "", "été", " end \n"]
    flat, counts = enc.words(block)
    assert seen == ["été"] and counts.tolist() == [4, 0, 1, 2]
    assert enc.tokens(flat).tolist() == [i for t in block for i in reference(t)]


def test_strong_boundaries_alone_give_the_cuts_of_the_whole_programme(monkeypatch):
    rng = np.random.default_rng(8)
    whole, calls = splitting.all_cuts, []
    monkeypatch.setattr(splitting, "all_cuts", lambda *told: calls.append(1) or whole(*told))
    spared = 0
    for _ in range(500):
        limit = int(rng.integers(40, 200))
        overlap = int(rng.integers(0, limit // 3))
        ends = np.cumsum(rng.integers(1, 4, int(rng.integers(limit, 5 * limit))))
        kind = rng.choice(6, len(ends), p=(0.02, 0.02, 0.02, 0.06, 0.85, 0.03))
        told = ends, kind, int(ends[-1]), limit, overlap
        calls.clear()
        found = splitting.best_cuts(*told)
        spared += not calls
        assert found == whole(*told)
    assert 50 < spared < 450


def test_a_piece_alone_is_counted_by_known_words(monkeypatch, reference):
    enc = encoding.PrefixEncoder(encoding.read_ranks(PATH))
    text = "the cursor is sealed, " * 100
    enc.words([text])
    merged, merge = [], enc.merge
    monkeypatch.setattr(enc, "merge", lambda word: merged.append(word) or merge(word))
    cutter = splitting.TextCutter(enc, 512, 64)
    assert cutter.alone(text + "seal") == len(reference(text + "seal")) and set(merged) <= {b" seal"}
