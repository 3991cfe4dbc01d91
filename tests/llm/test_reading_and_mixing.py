import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnworks.llm import mixing as M
from cairnworks.llm import reading as L

EASY = ["vous", "on", "le", "chat", "mange", "voit", "petit", "jour"]
WORK = ["poste", "contrat", "équipe", "projet", "données", "outil", "stage", "mission"]
HARD = ["épistémologie", "paramétrisation", "convergence", "axiomatique", "spectrale", "hétérogénéité", "commensurabilité", "estimateurs"]


def text(rnd, level, n=14):
    length = {1: 5, 2: 12, 3: 25}[level]
    return " ".join(" ".join(rnd.choices({1: EASY, 2: WORK, 3: HARD}[level], k=length)) + "." for _ in range(n))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 3)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    xs, ys = L.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and y.min() <= ys[0] and ys[-1] <= y.max()


def test_held_out_accuracy_with_wrong_labels():
    rnd = random.Random(1)
    levels = [rnd.choice((1, 2, 3)) for _ in range(200)]
    labels = [rnd.choice((1, 2, 3)) if rnd.random() < 0.1 else v for v in levels]
    grader = L.trained_grader([text(rnd, v) for v in levels], labels)
    held = [rnd.choice((1, 2, 3)) for _ in range(200)]
    odd = [text(rnd, v) + " " + text(rnd, rnd.choice((1, 2, 3)), 2) for v in held]
    assert np.mean(grader.levels([L.sentences(t) for t in odd]) == held) > 0.95


def test_reading_levels_of_a_table(spark):
    rnd = random.Random(2)
    docs = [(i, text(rnd, i % 3 + 1), "x") for i in range(90)] + [(200, "too short", "x"), (201, None, "x"), (None, text(rnd, 1), "x"), (5, text(rnd, 3), "x"), (300, text(rnd, 1, 3000), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, reading_level string")
    labels = spark.createDataFrame([(i, "r", i % 3 + 1) for i in range(60)] + [(1, "s", None), (2, "s", 3)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in L.reading_levels(df, labels).collect()}
    assert set(got) == {*range(90), 300} and np.mean([got[i] == i % 3 + 1 for i in range(90)]) > 0.95 and got[300] == 1
    assert {r["reading_level"] for r in L.reading_levels(df, labels.filter("false")).collect()} == {2}
    assert L.reading_levels(df.filter("false"), labels).count() == 0


def test_all_labelled_documents_are_fitted(spark):
    """More labelled documents and words than were once read: the words of all of them are known to the models."""
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, text(rnd, i % 3 + 1, 25 if i % 3 else 40) + f" Seul mot{chr(97 + i // 676 % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} ici.") for i in range(3300)], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 3 + 1) for i in range(3300)], "doc_id long, reading_level int")
    reader = L.fitted_grader(docs, labels).reader
    assert reader.size == 2 + len(EASY) + len(WORK) + len(HARD) + 2 + 3300
    whole = sum(len(s) for r in docs.collect() for s in L.sentences(r["text"]))
    assert reader.totals.sum() == whole > 600_000


@pytest.fixture
def mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 40)
    docs = [(i, "word " * (3 + i % 7), " Big " if i % 3 else "small", "x") for i in range(300)] + [(i, "word", "tiny", "x") for i in range(300, 310)] + [(400, "", "big", "x"), (401, None, "big", "x"), (None, "a", "big", "x"), (402, "a", None, "x"), (1, "word " * 4, "big", "x")]
    targets = [("m", "BIG", 1.0, 1), ("m", "small", 1.0, 3), ("m", "none", 1.0, 2), ("u", "tiny", 3.0, None), ("u", "small", 1.0, None), ("z", "tiny", 0.0, 1), ("c", "tiny", 9.0, 4), ("c", "big", 1.0, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string"), spark.createDataFrame(targets, "mix_name string, source string, target_weight double, max_repeats int")


def test_shares_are_reached_within_the_caps(mix):
    rows = {(r["mix_name"], r["source"]): r for r in M.reached_shares(*mix).collect()}
    assert abs(rows["m", "big"]["actual_share"] - 0.5) < 0.01 and abs(rows["m", "small"]["actual_share"] - 0.5) < 0.01
    assert rows["m", "none"]["uses"] == 0 and rows["z", "tiny"]["uses"] == 0 and rows["m", "big"]["most_uses"] == 1
    assert abs(rows["c", "tiny"]["actual_share"] - 0.9) < 0.05 and rows["c", "tiny"]["most_uses"] <= 4
    assert abs(rows["u", "tiny"]["actual_share"] - 0.75) < 0.02


def test_positions_follow_the_schedules(mix):
    rows = M.training_order(*mix).collect()
    m = [r for r in rows if r["mix_name"] == "m"]
    assert [r["position"] for r in m] == sorted(r["position"] for r in m) and all(0 < r["position"] <= 1 for r in rows)
    assert len({(r["mix_name"], r["doc_id"], r["use_no"]) for r in rows}) == len(rows)
    early = sum(r["tokens"] for r in m if r["position"] < 0.5)
    assert abs(early / sum(r["tokens"] for r in m) - 0.5) < 0.05


def test_empty_tables(mix):
    docs, targets = mix
    assert M.training_order(docs.filter("false"), targets).count() == 0 and M.reached_shares(docs, targets.filter("false")).count() == 0
