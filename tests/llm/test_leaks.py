import random

import numpy as np

from cairnworks.llm import leaks as L
from cairnworks.llm.textforms import words


def edits(p, t):
    """The least edit distance of p to any stretch of t, by dynamic programming."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row = row, [i] + [0] * len(t)
        for j, b in enumerate(t, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (a != b))
    return min(row)


def test_bit_parallel_distance_equals_dynamic_programming():
    rnd = np.random.default_rng(2)
    p, t = rnd.integers(1, 6, (400, 13)), rnd.integers(1, 6, (400, 19))
    got = L.fewest_edits(p, t, 13)
    assert got.tolist() == [edits(a, b) for a, b in zip(p.tolist(), t.tolist())]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 12, 13, 40])))) for i in range(30)]
    docs = []
    for d in range(120):
        text = rnd.choices(vocabulary, k=rnd.randrange(60))
        if rnd.random() < 0.7:
            w = rnd.choice(items)[1].split()
            cut = w[rnd.randrange(max(1, len(w) - 13)) :][: rnd.choice([12, 13, 14, 20])]
            if rnd.random() < 0.5 and len(cut) > 5:
                cut[rnd.randrange(len(cut))] = "X"
            text[10:10] = cut
        docs.append((d, " ".join(text).replace(" ", rnd.choice([" ", "\n", ", "])).upper()))
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(docs[0][0], docs[0][1], 1), (500, None, 0), (501, "", 0), (None, items[3][1], 0)], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items + [(items[0][0], items[0][1]), (99, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in L.leaked_items(df, it, budget=2).collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            p = s.split()
            best = min((edits([x.lower() for x in p[k : k + 13]], words(t)) for k in range(len(p) - 12)), default=99)
            if best <= 2:
                want[d, i] = best
    assert got == want and any(v == 0 for v in want.values()) and any(v for v in want.values())
    assert L.leaked_items(df.filter("false"), it).count() == 0 and L.leaked_items(df, it.filter("false")).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "x " + text[:60])], "doc_id long, text string")
    items = spark.createDataFrame([(i, text[5 * i :]) for i in range(6)], "item_id long, text string")
    whole = sorted(map(tuple, L.leaked_items(docs, items).collect()))
    monkeypatch.setattr(L, "BLOCK_WORDS", 10)
    assert sorted(map(tuple, L.leaked_items(docs, items).collect())) == whole
