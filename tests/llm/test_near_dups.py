import random

import numpy as np
from pyspark.sql import functions as F

from cairnworks.llm import near_dups as N


def made_up(seed, n):
    """Texts with edited copies, and the exact pairs at a similarity of a half over three words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.5:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randrange(6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randrange(25, 60))))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    pairs = {tuple(sorted((f"u{i}", f"u{j}"))) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    return texts, pairs


def test_pairs_against_brute_force(spark):
    texts, want = made_up(5, 260)
    df = spark.createDataFrame([(f"u{i}", t, "clash", "clash") for i, t in enumerate(texts)] + [("u0", texts[0], "x", "x"), (None, texts[1], "x", "x"), ("n", None, "x", "x")], "url string, t string, key string, text string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "url", F.col("t"), n=3, threshold=0.5).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 100


def test_classes_count_copies_and_links(spark):
    base = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", base), ("b", base), ("c", base + " more"), ("d", "short"), ("e", "SHORT"), ("f", "?!"), ("g", "")], "url string, t string")
    got = {r["key"]: (r["copies"], r["links"]) for r in N.near_duplicate_classes(df, "url", F.col("t")).collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 1), "d": (1, 1), "e": (1, 1)}
    assert N.near_duplicate_pairs(df.filter("false"), "url", F.col("t")).count() == 0


def test_min_hash_estimates_similarity():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2**63, 200, dtype=np.uint64)
    y = np.concatenate([x[:140], rnd.integers(0, 2**63, 60, dtype=np.uint64)])
    same = np.mean(N.min_hashes(x, 1000) == N.min_hashes(y, 1000))
    assert abs(same - 140 / 260) < 0.08


def test_every_level_has_the_target_chance_at_the_threshold():
    for threshold in (0.2, 0.5, 0.8, 0.95):
        steps = N.levels(threshold, N.TARGET_RECALL)
        assert all(N.chance(threshold, d, t) >= N.TARGET_RECALL for d, t in steps) and [d for d, _ in steps] == sorted({d for d, _ in steps})


def test_members_of_one_trie_node_stand_in_a_row():
    rnd = np.random.default_rng(2)
    hashes = rnd.integers(0, 1 << 32, (50, 6), dtype=np.uint32)
    hashes[10:20, [0, 2]] = hashes[0, [0, 2]]  # depth 3, two trees: the first two min-hashes of tree 0
    order = np.argsort(N.node_numbers(hashes, 3, 2)[:, 0])
    places = sorted(np.flatnonzero(np.isin(order, [0, *range(10, 20)])))
    assert places[-1] - places[0] == 10


def test_crowded_nodes_give_the_same_pairs(spark):
    """With small nodes most texts go on to longer prefixes, and the nodes of the last level are cut into blocks."""
    texts, want = made_up(6, 260)
    df = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)] + [(f"z{i}", f"{texts[0]} z{i}") for i in range(40)], "url string, t string")
    few = {tuple(r) for r in N.near_duplicate_pairs(df, "url", F.col("t"), n=3, threshold=0.5, crowd=4).collect()}
    all_ = {tuple(r) for r in N.near_duplicate_pairs(df, "url", F.col("t"), n=3, threshold=0.5).collect()}
    assert few == all_ and want <= few and len(few) > 40 * 39 // 2


def test_nodes_that_go_on_over_batches():
    rnd = np.random.default_rng(3)
    nodes = np.sort(rnd.integers(0, 12, 300))
    ids, sketch = rnd.permutation(300), np.zeros((300, N.NEAR // 32), np.int64)
    batch = lambda a, b: N.pa.RecordBatch.from_arrays([N.pa.array(x[a:b]) for x in (nodes, ids, *sketch.T)], names=[str(i) for i in range(2 + sketch.shape[1])])
    crowd = 27
    out = [r for b in N._node_batches(0.5, crowd)(iter([batch(i, i + 7) for i in range(0, 300, 7)])) for r in zip(*(c.to_pylist() for c in b.columns))]
    groups = [ids[nodes == v].tolist() for v in range(12)]
    assert {r for r in out if r[1] is not None} == {(min(x, y), max(x, y)) for g in groups if len(g) <= crowd for x in g for y in g if x != y}
    assert {r[0] for r in out if r[1] is None} == {x for g in groups if len(g) > crowd for x in g}


def test_groups_of_linked_texts(spark):
    chain = [[f"w{j}" for j in range(i * 6, i * 6 + 60)] for i in range(12)]  # neighbours share most words, the ends none
    df = spark.createDataFrame([(f"c{i:02}", " ".join(t)) for i, t in enumerate(chain)] + [("alone", "one two three four five six")], "url string, t string")
    got = {r["key"]: r["group_id"] for r in N.near_duplicate_classes(df, "url", F.col("t"), n=3, threshold=0.6).collect()}
    assert len({g for k, g in got.items() if k != "alone"}) == 1 and got["alone"] != got["c00"]


def test_pairs_near_the_threshold_are_found_beside_a_hot_group(spark):
    """Many near-equal texts must not shorten the search for the few pairs of barely enough similarity."""
    rnd = random.Random(8)
    fresh = (f"v{i}" for i in range(10**6))
    base = [next(fresh) for _ in range(80)]
    texts = {f"hot{i}": base + [next(fresh)] for i in range(200)}
    want = set()
    for i in range(40):
        left, same = [next(fresh) for _ in range(80)], 54  # 52 common sequences of 3 words, 26 others on each side: a half
        texts[f"x{i}"], texts[f"y{i}"] = left, left[:same] + [next(fresh) for _ in range(80 - same)]
        want.add((f"x{i}", f"y{i}"))
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    rnd.shuffle(rows)
    pairs = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, "url string, t string"), "url", F.col("t"), n=3, threshold=0.5).collect()}
    assert want <= pairs and len(pairs) == 40 + 200 * 199 // 2


def test_nodes_stay_whole_however_the_hot_ones_are_joined(spark):
    """A join planned by sorting that turns into a broadcast when it runs, or is split for skew, must not tear nodes apart."""
    rows = [(i, [0 if i < 60 else 1 + i % 90, 1000 + i], [0] * (N.NEAR // 32)) for i in range(600)]  # node 0 is hot
    reps = spark.createDataFrame(rows, "id long, nodes array<long>, near array<long>").repartition(6, "id")
    small = {(i, j) for i in range(60, 600) for j in range(i + 1, 600) if i % 90 == j % 90}
    hot = {(i, j) for i in range(60) for j in range(i + 1, 60)}
    sorting = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    skewed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.5",
    }
    for plan in (sorting, skewed):
        for name, value in plan.items():
            spark.conf.set(name, value)
        try:
            level = {tuple(r) for r in N._level_pairs(reps, 2, 0.5, 10).collect()}
            last = {tuple(r) for r in N._last_pairs(reps, 2, 0.5, 10).collect()}
        finally:
            for name in plan:
                spark.conf.unset(name)
        assert level == small | {(i, None) for i in range(60)} and last == small | hot
