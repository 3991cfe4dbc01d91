import random

import pytest
from pyspark.sql import functions as F

from cairnworks.operators import history as H

SCHEMA = "id long, url string, h string, at long, key string, digest string"


def brute(rows):
    """Versions by walking each key's timeline."""
    out = []
    for url in {r[1] for r in rows if r[1] is not None and r[3] is not None}:
        line = sorted((r[3], r[0], r[2] or "") for r in rows if r[1] == url and r[3] is not None)
        starts = [(at, h) for i, (at, _, h) in enumerate(line) if i == 0 or line[i - 1][2] != h]
        out += [(url, n, at, starts[n][0] if n < len(starts) else -1) for n, (at, _) in enumerate(starts, 1)]
    return sorted(out)


def merged(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return H.scd2_merge(df, key="url", attributes=F.coalesce("h", F.lit("")), at_us=F.col("at"), tie=F.col("id"), **more)


def versions(df):
    return sorted((r["key"], r["version_no"], r["valid_from_us"], r["valid_to_us"]) for r in df.collect())


def random_rows(seed, n=300):
    rnd = random.Random(seed)
    return [(i, f"u{rnd.randrange(8)}", rnd.choice(["a", "b", None]), rnd.randrange(60)) for i in range(n)] + [(n, None, "a", 1), (n + 1, "u1", "a", None)]


def test_versions_equal_brute_force(spark):
    rows = random_rows(1)
    assert versions(merged(spark, rows + rows[:20])) == brute(rows)


def test_hot_keys_are_cut_into_blocks_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_ROWS", 5)
    for seed, width in ((2, 7), (3, 7), (4, 40), (5, 1000)):  # the last ones are cut again, as all rows of a key are within one or two blocks
        monkeypatch.setattr(H, "HOT_BLOCK_US", width)
        rows = random_rows(seed)
        assert versions(merged(spark, rows)) == brute(rows)


def test_a_later_batch_merges_into_kept_versions(spark):
    rows = sorted(random_rows(4), key=lambda r: (r[3] is None, r[3]))
    early, late = [r for r in rows if r[3] is not None and r[3] < 30], [r for r in rows if r[3] is None or r[3] >= 30]
    kept = merged(spark, early)
    assert versions(merged(spark, late, current=kept)) == brute(rows)


def test_entities_move_the_first_start_and_the_last_end(spark):
    entities = spark.createDataFrame([("u", 3, 99), ("v", 50, None)], "key string, opened_us long, closed_us long")
    got = versions(merged(spark, [(1, "u", "a", 10), (2, "u", "b", 20), (3, "v", "a", 10), (4, "w", "a", 5)], entities=entities))
    assert got == [("u", 1, 3, 20), ("u", 2, 20, 99), ("v", 1, 10, -1), ("w", 1, 5, -1)]


def test_empty_table(spark):
    assert versions(merged(spark, [(1, None, "a", 1)])) == []


def test_late_rows_behind_kept_versions_rebuild_their_keys(spark):
    early = [(1, "u", "a", 1), (2, "u", "a", 3), (3, "u", "a", 5), (4, "v", "a", 5)]
    late = [(5, "u", "b", 2), (6, "v", "b", 9), (7, "w", "a", 1)]
    log = spark.createDataFrame([(*r, "clash", "clash") for r in early], SCHEMA)
    kept = merged(spark, early)
    assert versions(merged(spark, late, current=kept, log=log)) == brute(early + late)
    with pytest.raises(ValueError):
        merged(spark, late, current=kept)
    rows = random_rows(5)
    one, two = rows[::2], rows[1::2]  # each over the whole time
    kept = merged(spark, one)
    assert versions(merged(spark, two, current=kept, log=spark.createDataFrame([(*r, "", "") for r in one], SCHEMA))) == brute(rows)
