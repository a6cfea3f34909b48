from datetime import datetime

import numpy as np
import pytest
from conftest import rows

from orefield.llm import vectors

AT = datetime(2025, 1, 1)
SCHEMA = "symbol_id string, embedding array<float>, indexed_at timestamp, n int, id string, vector string, digest string"


def frame(spark, data):
    return spark.createDataFrame([(*r, 0, "", "", "") for r in data], SCHEMA)


def sid(n):
    return f"symbol:sha256:{n:064x}"


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = set()
    for i in range(len(x)):
        s = np.round(x @ x[i], 4)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]
        found |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return found


def test_recall_and_dirty_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 72))
    x = (centres[rng.integers(0, 40, 2500)] + 0.35 * rng.normal(size=(2500, 72))).astype(np.float32)
    x *= rng.uniform(0.2, 9, (2500, 1)).astype(np.float32)
    data = [(sid(i), v.tolist(), AT) for i, v in enumerate(x)]
    old = [(sid(i), x[0].tolist(), datetime(2024, 1, 1)) for i in range(0, 400, 3)]
    dirty = [("nul", None, AT), ("short", [1.0] * 48, AT), ("zero", [0.0] * 72, AT), ("nan", [float("nan")] + [1.0] * 71, AT), ("inf", [float("inf")] + [1.0] * 71, AT), (None, [1.0] * 72, AT), ("gap", [None] + [1.0] * 71, AT)]
    got = set(rows(vectors.neighbour_pairs(frame(spark, data + old + dirty + data[:20]).repartition(6))))
    want = brute([sid(i) for i in range(2500)], x.astype(np.float64))
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    assert all(a < b for a, b in got)


def test_copies_and_ties_go_to_the_smaller_id(spark):
    base = np.eye(72, dtype=np.float32)
    ids = [f"c{n:02d}" for n in range(20)]
    data = [(i, base[0].tolist(), AT) for i in ids] + [("x", base[1].tolist(), AT), ("y", (base[1] + 0.01 * base[2]).tolist(), AT)]
    got = set(rows(vectors.neighbour_pairs(frame(spark, data))))
    for n, i in enumerate(ids):
        first = [c for c in ids if c != i][:5]
        assert all((min(i, c), max(i, c)) in got for c in first)
    assert ("x", "y") in got
    assert not any((ids[a], ids[b]) in got for a in range(6, 20) for b in range(a + 1, 20))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    data = [(f"s{i}", [1.0, float(i)] + [0.5] * 70, AT) for i in range(n)]
    assert rows(vectors.neighbour_pairs(frame(spark, data))) == ([("s0", "s1")] if n == 2 else [])
    assert vectors.similar_vectors(frame(spark, data)).count() == (2 if n == 2 else 0)


def clustered(rng, n, centres=60):
    x = rng.normal(size=(centres, 72))[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, 72))
    return x.astype(np.float32)


def recall(spark, x):
    ids = [sid(i) for i in range(len(x))]
    got = set(rows(vectors.neighbour_pairs(frame(spark, [(i, v.tolist(), AT) for i, v in zip(ids, x)]))))
    want = brute(ids, x.astype(np.float64))
    return len(got & want) / len(want)


def test_regions_fitted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TOP", 4)
    monkeypatch.setattr(vectors, "REGION", 100)
    monkeypatch.setattr(vectors, "SAMPLED", 30)
    assert recall(spark, clustered(np.random.default_rng(5), 3000)) >= 0.98


def test_crowded_region_is_cut_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = (np.ones(72) + 0.2 * rng.normal(size=(600, 72))).astype(np.float32)
    assert recall(spark, x) > 0.9
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "VISITORS", 150)
    scan, sizes = vectors.scan, []

    def watched(books, base, base_key, query, *rest):
        sizes.append((len(base), len(query)))
        return scan(books, base, base_key, query, *rest)

    assert recall(spark, x) > 0.9
    index = vectors.VectorIndex(np.eye(72, dtype=np.float32)[:1], np.eye(72, dtype=np.float32)[:1], np.arange(2), None)
    assert index.nearest(x[:5])[0].tolist() == [[0]] * 5
    q, key, score = watched(vectors.fit_books(x), x[:100], np.arange(100), x[:150], np.arange(150), np.full(150, 8), 5)
    assert sizes == [(100, 150)] and (np.bincount(q, minlength=150) == 5).all() and (key != q).all()


def test_equal_directions_are_ties_whatever_their_lengths(spark):
    rng = np.random.default_rng(4)
    one, others = rng.normal(size=72), clustered(rng, 300)
    data = [(f"t{n:03d}", (one * (2.0 ** (n % 7))).tolist(), AT) for n in range(200)] + [(sid(n), v.tolist(), AT) for n, v in enumerate(others)]
    got = set(rows(vectors.neighbour_pairs(frame(spark, data))))
    first = {(f"t{a:03d}", f"t{b:03d}") for a in range(6) for b in range(a + 1, 200) if a < 5 or b < 6}
    assert {p for p in got if p[0][0] == "t" == p[1][0]} == first
