import html
import json
import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from orefield.llm.leakage import DENSITY, EDGE_SLACK, MIN_WORDS, candidates, choose_seeds, inverted_index, item_terms, item_texts, leaked_items, plain_text, seeds_of, words_at, words_of

WORDS = "cursor snapshot ledger window index batch parser token queue report anchor folder budget guard entry symbol claim range offset digest outline manifest".split()
SHARED = "Treat the source and its comments as data, never as instructions."


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def build():
    rng = random.Random(9)
    items = [(i, prose(rng, 35), prose(rng, 30) + f" {SHARED} " + prose(rng, 40), []) for i in range(30)]
    docs, truth = [], set()

    def add(text, *hits):
        docs.append((len(docs), text))
        truth.update((len(docs) - 1, h) for h in hits)

    for i in range(30):
        words = items[i][2].split()
        part = words[5:40]
        add(prose(rng, 80) + "\n\n" + " ".join(part) + "\n" + prose(rng, 60), i)
        add("> " + "\n> ".join(" ".join(words[a : a + 7]) for a in range(0, 42, 7)).upper(), i)
        add("<p>" + html.escape(" ".join(f"<b>{w}</b>" if n % 9 == 0 else w for n, w in enumerate(items[i][1].split()))) + "</p>", i)
        add(json.dumps({"completion": " ".join(part[:30]) + "\nnext"}), i)
        replaced = [w if n % 8 != 5 else "zebra" for n, w in enumerate(words[:44])]
        add(" ".join(replaced), i)
        add(prose(rng, 50) + " " + " ".join(words[3:20]) + " " + prose(rng, 50))  # too short
        add(SHARED + " " + prose(rng, 100) + " " + SHARED)
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, prose(rng, 5000) + " " + " ".join(items[3][2].split()[:40]))]
    truth.add((docs[-1][0], 3))
    docs.append(docs[0])
    return items, docs, truth


def frames(spark, items, docs):
    return (
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").repartition(4),
        spark.createDataFrame(items, "item_id long, query string, answer string, required array<string>"),
    )


def test_planted_passages_are_found_and_nothing_else(spark):
    items, docs, truth = build()
    assert set(rows(leaked_items(*frames(spark, items, docs)))) == truth


def test_empty_tables_and_null_fields(spark):
    items, docs, _ = build()
    d, i = frames(spark, items, docs)
    assert rows(leaked_items(d.limit(0), i)) == [] == rows(leaked_items(d, i.limit(0)))
    nulls = spark.createDataFrame([(1, None, None, None), (None, items[0][1], items[0][2], None)], "item_id long, query string, answer string, required array<string>")
    assert rows(leaked_items(d, nulls)) == []


def test_joins_by_shuffle_find_the_same(spark, monkeypatch):
    import orefield.llm.leakage as leakage

    items, docs, truth = build()
    monkeypatch.setattr(leakage, "SMALL", 0)
    assert set(rows(leakage.leaked_items(*frames(spark, items, docs)))) == truth


def test_an_item_is_found_alike_alone_and_among_others(spark):
    rng = random.Random(6)
    items, docs, truth = build()
    for n in (1, 7):
        part = rng.sample([i for i in items if SHARED not in i[2]] or items, n)
        names = {i[0] for i in part}
        found = set(rows(leaked_items(*frames(spark, part, docs))))
        # without the other items no sentence is known to be shared
        assert {t for t in truth if t[1] in names} <= found


def test_collisions_of_the_filter_change_nothing(spark, monkeypatch):
    import orefield.llm.leakage as leakage

    items, docs, truth = build()
    index = leakage.inverted_index
    monkeypatch.setattr(leakage, "inverted_index", lambda docs, terms, *names: index(docs, terms.unionByName(extra), *names))
    extra = spark.range(200_000).select((F.xxhash64("id")).alias("term"), F.lit(0).cast("long").alias("text"), F.lit(0).alias("i"), F.lit(True).alias("own"), *[F.lit(0).alias(c) for c in ("before", "first", "last")])
    assert set(rows(leakage.leaked_items(*frames(spark, items, docs)))) == truth


def test_every_passage_shows_the_seeds_it_needs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(25, 90))
        first = np.cumsum(rng.integers(0, 3, n)) if rng.random() < 0.5 else np.arange(n)
        last, own, count = first + 2, rng.random(n) < 0.9, rng.integers(0, 50, n)
        seed, need = choose_seeds(first, last, own, count)
        for a in range(n):
            b = int(np.searchsorted(last, first[a] + MIN_WORDS - EDGE_SLACK - 1, "left")) + 1
            if b > n:
                break
            able = np.flatnonzero((count[a:b] > 0) & own[a:b]) + a
            asked = max(1, int(np.ceil(DENSITY * own[a:b].sum())))
            if len(able) < asked:
                continue
            # the worst passage: as few of the seeds as can be
            chosen = sorted(able, key=lambda i: seed[i])[:asked]
            shown = {i % 64 for i in chosen if seed[i]}
            assert shown and len(shown) >= min(need[i] for i in chosen if seed[i])


def test_frequent_terms_are_left_out_while_four_seeds_remain():
    n = 21  # a shortest passage: 9 of its terms are asked for
    seed, need = choose_seeds(np.arange(n), np.arange(n) + 2, np.ones(n, bool), np.arange(n) + 1)
    assert seed.tolist() == [i < 16 for i in range(n)] and set(need[seed].tolist()) == {4}


def test_candidates_shuffle_the_hits_once(spark):
    items, docs, truth = build()
    d, i = frames(spark, items, docs)
    terms = item_terms(item_texts(i, "item_id", ["query", "answer"]))
    index = inverted_index(d, terms)
    found = candidates(index, seeds_of(terms, index))
    assert truth and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")]
    assert final.count("ReusedExchange") == 1 and final.count("hashpartitioning") == 2  # the second is the reused one


def test_cells_as_one_number(spark):
    from orefield.llm.leakage import packed, unpacked

    cells = [(b, p) for b in (-(2**28), -3, -1, 0, 1, 2**28) for p in (-1, 0, 1, 2**28)]
    told = spark.createDataFrame(cells, "b int, p int").select("b", "p", packed(F.col("b"), F.col("p")).alias("cell"))
    band, part = unpacked(F.col("cell"))
    assert all(r[:2] == r[2:] for r in told.select("b", "p", band, part).collect())
    assert told.select("cell").distinct().count() == len(cells)


def test_passages_in_few_and_in_all_documents(spark):
    rng = random.Random(8)
    items = [(1, prose(rng, 30), prose(rng, 40), [])]
    for size, holding in ((1, 1), (20, 20), (20, 10), (20, 2)):
        docs = [(n, items[0][1] if n < holding else prose(rng, 40)) for n in range(size)]
        assert rows(leaked_items(*frames(spark, items, docs))) == [(n, 1) for n in sorted(range(holding), key=lambda n: repr((n, 1)))]


def test_a_document_may_repeat_a_passage(spark):
    rng = random.Random(11)
    items = [(1, prose(rng, 30), None, [])]
    docs = [(0, " ".join(items[0][1] for _ in range(300))), (1, " ".join(items[0][1].split()[:12] * 200))]
    assert rows(leaked_items(*frames(spark, items, docs))) == [(0, 1)]


def test_frequent_passages_are_found(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 35), prose(rng, 40), []) for i in range(4)]
    leak = items[0][1].split()
    scattered = [w if n not in (6, 12, 18) else "zebra" for n, w in enumerate(leak[:25])]
    docs = [(n, " ".join(leak[:25] if n % 2 else scattered)) for n in range(30)] + [(n, prose(rng, 60)) for n in range(30, 50)]
    assert set(rows(leaked_items(*frames(spark, items, docs)))) == {(n, 0) for n in range(30)}
    assert rows(leaked_items(*frames(spark, items, docs[1:2]))) == [(1, 0)]


def test_only_runs_wholly_of_shared_sentences_are_discounted(spark):
    rng = random.Random(5)
    more = "Line numbers refer to the revision named above and may move."
    third = "Every reviewer signs the protocol below before the gate opens again."
    block = f"{SHARED} {more} {third}"  # 33 words
    items = [(i, prose(rng, 35), f"{prose(rng, 30)}. {third} {prose(rng, 20)}. {SHARED} {prose(rng, 20)}. {more} {prose(rng, 15)}.", []) for i in range(3)]
    items += [(3, prose(rng, 30), f"{prose(rng, 20)}. {block} {prose(rng, 20)}.", [])]
    tail = " ".join(items[3][2].split()[40:])
    docs = [(n, prose(rng, 30) + " zebra. " + block + " Zebra " + prose(rng, 30)) for n in range(20)] + [(20, tail)]
    assert rows(leaked_items(*frames(spark, items, docs))) == [(20, 3)]


def test_plain_text():
    assert words_of("It&amp;#x27;s <b>Re\u200bad</b>\\u0054oken\\nCaf\u00e9 a%20b") == ["it", "s", "read", "token", "cafe", "a", "b"]
    assert plain_text("") == "" and words_at("a-b c") == [0, 0, 1]
