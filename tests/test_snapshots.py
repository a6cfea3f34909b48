import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from orefield.operators.snapshots import digest_bytes, snapshot_changes

SCHEMA = "repository string, snapshot_no int, id string, content_hash string, active int, updated_at timestamp, key string, source string"
T0 = datetime(2025, 1, 1)


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)


def brute(data):
    best, snaps = {}, {}
    for repo, snap, i, h, active, at in data:
        if repo is None or snap is None:
            continue
        snaps.setdefault(repo, set()).add(snap)
        if i is None:
            continue
        key = (repo, snap, i)
        if key not in best or at > best[key][2]:
            best[key] = (h, active, at)
    out = []
    for repo, numbers in snaps.items():
        numbers = sorted(numbers)
        for a, b in zip(numbers, numbers[1:]):
            for i in {k[2] for k in best if k[0] == repo and k[1] in (a, b)}:
                old, new = (best.get((repo, n, i)) for n in (a, b))
                old = old if old and old[1] in (1, None) else None
                new = new if new and new[1] in (1, None) else None
                norm = lambda x: x and x[0] and x[0].strip().lower().removeprefix("sha256:")
                if old and not new:
                    out.append((repo, i, a, b, "removed"))
                elif new and not old:
                    out.append((repo, i, a, b, "added"))
                elif old and new and norm(old) != norm(new):
                    out.append((repo, i, a, b, "changed"))
    return sorted(out, key=repr)


def test_random_tables_match_brute_force(spark):
    rng = random.Random(5)
    digests = [f"{n:064x}" for n in range(4)]
    data = []
    for _ in range(700):
        spelled = rng.choice((str, str.upper, lambda d: "sha256:" + d, lambda d: d + " "))(rng.choice(digests))
        repo = rng.choice(["hot", "hot", "a", "b", None])
        data.append((repo, rng.choice([1, 2, 4, 5, None]), rng.choice([f"s{n}" for n in range(30)] + [None, f"{7:064x}"]), rng.choice([spelled, spelled, None, "odd"]), rng.choice([1, 1, 1, 0, None]), T0 + timedelta(seconds=rng.randrange(10**9))))
    data += data[:50]
    assert rows(snapshot_changes(frame(spark, data))) == brute(data)


def test_empty_table(spark):
    assert rows(snapshot_changes(frame(spark, []))) == []


def test_ties_do_not_depend_on_order(spark):
    a = [("r", 1, "x", "a" * 64, 1, T0), ("r", 1, "x", "b" * 64, 1, T0), ("r", 2, "x", "b" * 64, 1, T0)]
    assert rows(snapshot_changes(frame(spark, a))) == rows(snapshot_changes(frame(spark, a[::-1])))


@pytest.mark.parametrize("text,same", [("A" * 64, True), ("sha256:" + "a" * 64, True), (" " + "a" * 64 + "\n", True), ("a" * 63, False), ("b" * 64, False)])
def test_spellings_of_a_digest(spark, text, same):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a" * 64, text)], "x string, y string").select((digest_bytes(F.col("x")) == digest_bytes(F.col("y"))).alias("s")).first().s
    assert got == same


def test_each_repository_has_its_own_last_snapshot(spark):
    from orefield.operators.snapshots import of_last_snapshot

    df = spark.createDataFrame([("a", 11, "x"), ("a", 13, "y"), ("b", 10, "x"), ("b", 11, "x"), ("c", 5, "z")], "repository string, snapshot_no int, id string")
    got = lambda back: rows(of_last_snapshot(df, df, back).select("repository", "snapshot_no"))
    assert got(0) == [("a", 13), ("b", 11), ("c", 5)] and got(1) == [("a", 11), ("b", 10)]


def test_queries_read_repositories_without_the_newest_delivery(spark, tmp_path):
    import datetime as dt

    from orefield.plans import reference_queries

    day = dt.datetime(2025, 1, 1)
    data = [(r, n, i, "f", i, "pending", day, day, 0, 0, 1, h) for r, n, i, h in [("late", 10, "s", "1"), ("late", 11, "s", "2"), ("new", 12, "t", "1"), ("new", 13, "t", "1"), ("new", 13, "u", "1")]]
    names = "repository string, snapshot_no int, id string, file string, qualified_name string, current_status string, updated_at timestamp, loaded_at timestamp, retries int, retry_after long, active int, content_hash string"
    spark.createDataFrame(data, names).write.parquet(str(tmp_path / "symbols.parquet"))
    got = lambda name: rows(reference_queries.QUERIES[name](spark, str(tmp_path)))
    assert got("queue_order") == [("late", "s", "pending", 1), ("new", "t", "pending", 1), ("new", "u", "pending", 2)]
    assert [r[:2] + r[-1:] for r in got("scan_reconciliation")] == [("late", "s", 1), ("new", "t", 1), ("new", "u", 1)]
    assert sum(r[2] for r in got("queue_status") if r[0] == "late") == 1
