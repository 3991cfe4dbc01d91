import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnworks.operators import snapshot_diff as D


def sides(rnd, tables, same, differing):
    """Entries of both sides of each table, and the differing ones."""
    rows, want = [], []
    for t in range(tables):
        for _ in range(same):
            e = [rnd.getrandbits(64) for _ in range(3)]
            rows += [(t, 1, *e), (t, -1, *e)]
        for _ in range(differing):
            x = (t, rnd.choice([1, -1]), *(rnd.getrandbits(64) for _ in range(3)))
            rows.append(x)
            want.append(x)
    rnd.shuffle(rows)
    cols = list(zip(*rows)) or [()] * 5
    return [np.array(c, k) for c, k in zip(cols, (np.int64, np.int64, np.uint64, np.uint64, np.uint64))], sorted(want)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 40), st.integers(0, 30), st.integers(1, 5), st.integers(0, 10**6))
def test_every_difference_is_recovered(same, differing, tables, seed):
    arrays, want = sides(random.Random(seed), tables, same, differing)
    got = D.recovered(*arrays, tables)
    assert sorted(zip(*(x.tolist() for x in got))) == want


def test_tables_that_do_not_peel_are_enlarged():
    arrays, want = sides(random.Random(1), 3, 10, 300)
    assert sorted(zip(*(x.tolist() for x in D.recovered(*arrays, 3, 0, np.full(3, D.LEAST_CELLS))))) == want


def test_the_estimate_follows_the_difference_not_the_size():
    for differing in (0, 2, 10, 20):
        (table, sign, kd, kd2, vd), _ = sides(random.Random(differing), 50, 500, differing)
        got = D.estimated_differences(table, D.entry_digests(kd, kd2, vd, 0), 50)
        assert abs(got.mean() - differing) <= 0.15 * differing + 1.2  # rounded up


def test_buckets_that_go_on_over_batches(monkeypatch):
    monkeypatch.setattr(D, "AT_ONCE", 7)
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(6), d, rnd.getrandbits(40), 0, rnd.getrandbits(40)) for d in (1, 2, 3) for _ in range(30))
    cols = [np.array(c, np.int64) for c in zip(*rows)]
    batch = lambda i: D.pa.RecordBatch.from_arrays([D.pa.array(c[i : i + 5]) for c in cols], names=["bucket", "delivery", "kd", "kd2", "vd"])
    got = [tuple(r) for b in D._bucket_batches([(2, 1), (3, 2)])(batch(i) for i in range(0, 90, 5)) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = [(p, k, 0, "added" if d == new else "removed") for p, new, old in ((2, 2, 1), (3, 3, 2)) for _, d, k, _, _ in rows if d in (new, old)]
    assert sorted(got) == sorted(want)


RUNS = "id long, started_at timestamp, finished_at timestamp, source string, status_message string"
SNAPS = "id long, offer_url string, content_hash string, fetched_at timestamp, run_id long, value string, key string"


def changes(spark, runs, snaps):
    from datetime import datetime as dt

    t = lambda n: None if n is None else dt(2026, 1, 1 + n)
    r = spark.createDataFrame([(i, t(s), t(f), src, m) for i, s, f, src, m in runs], RUNS)
    x = spark.createDataFrame([(i, u, h, t(at), run, "clash", "clash") for i, u, h, at, run in snaps], SNAPS)
    return sorted(tuple(y) for y in D.offer_changes(x, r).collect())


def test_changes_of_small_runs(spark):
    runs = [(2, 1, 2, "a", "ok"), (1, 3, 4, "a", " OK "), (3, 5, None, "a", "ok"), (4, 6, 7, "a", "partial"), (5, 8, 9, "a", "ok"), (9, 1, 2, "b", "ok")]
    snaps = [
        (1, "u1", "h1", 1, 2), (2, "u2", "h2", 1, 2), (3, "u3", None, 1, 2), (4, None, "h", 1, 2),
        (5, "u1", " SHA256:H1 ", 3, 1), (6, "u2", "x", 3, 1), (7, "u2", "h2b", 4, 1), (8, "u4", "h4", 3, 1), (8, "u4", "h4", 3, 1),
        (9, "u1", "zz", 5, 3), (10, "u1", "zz", 6, 4), (11, "u4", "h4", 8, 5), (12, "u2", "h2b", 8, None), (13, "u9", "h", 1, 9),
    ]
    assert changes(spark, runs, snaps) == [(1, "u2", "changed"), (1, "u3", "removed"), (1, "u4", "added"), (5, "u1", "removed"), (5, "u2", "removed")]


def test_empty_tables_give_no_rows(spark):
    assert changes(spark, [], []) == []


def test_equal_times_are_settled_by_the_greater_id(spark):
    runs = [(1, 1, 2, "a", "ok"), (2, 3, 4, "a", "ok")]
    assert changes(spark, runs, [(1, "u", "h", 1, 1), (2, "u", "h", 3, 2), (3, "u", "k", 3, 2)]) == [(2, "u", "changed")]


def test_many_differences_need_enlarged_buckets(spark, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_ROWS", 300)
    runs = [(1, 1, 2, "a", "ok"), (2, 3, 4, "a", "ok")]
    snaps = [(i, f"u{i}", "h", 1, 1) for i in range(400)] + [(1000 + i, f"u{i}", "k" if i % 2 else "h", 3, 2) for i in range(50, 450)]
    want = sorted([(2, f"u{i}", "removed") for i in range(50)] + [(2, f"u{i}", "added") for i in range(400, 450)] + [(2, f"u{i}", "changed") for i in range(50, 400) if i % 2])
    assert changes(spark, runs, snaps) == want


@pytest.mark.parametrize("raw,clean", [(" SHA256:AB ", "ab"), ("ab", "ab"), ("sha256:sha256:x", "sha256:x")])
def test_normalised_hash(spark, raw, clean):
    assert spark.range(1).select(D.normalised_hash(F.lit(raw)).alias("h")).first()["h"] == clean
