import random

import pytest
from pyspark.sql import functions as F

from cairnworks.llm import lookalikes
from cairnworks.llm import textforms as X


@pytest.mark.parametrize(
    "text,form",
    [
        ("Dοctoral cοntract", "Doctoral contract"), ("ｉｎｇéｎｉｅｕｒ", "ingénieur"), ("e⁠̀", "è"), ("a  b", "a b"), ("ﬁn", "fin"),
        ("α-stable", "α-stable"), ("Été", "Été"), ("x²", "x²"), ("THÈSE", "THÈSE"), ("it’s", "it’s"), ("", ""), (None, None), ("­​", ""), ("ꓝꓳꓑ Ⲏⲟ", "FOP Ho"),
    ],
)
def test_canonical(text, form):
    assert X.canonical(text) == form


def test_mapping_has_no_conflicts_and_is_idempotent():
    table, spaces, hidden = X.mapping()
    X.check(table, set(spaces) | set(hidden))
    with pytest.raises(ValueError):
        X.check({"a": "b", "b": "c"}, set())
    rnd = random.Random(3)
    pool = [*table, *spaces, *hidden, *"abcéÀ ,.-̧́"]
    for _ in range(300):
        once = X.canonical("".join(rnd.choices(pool, k=12)))
        assert X.canonical(once) == once


def test_words():
    assert X.words("Thèse (H/F) à l'été_2026") == ["these", "h", "f", "a", "l", "ete", "2026"] and X.words(None) == []


def test_same_looking_pairs(spark):
    rows = [
        ("a", "Thèse x", None, 1), ("b", "Thèse x", "", 1), ("c", "Thèse  x", "d", 1), ("d", "THÈSE x", "d", 1), ("e", "Thеse", "​", 1), ("f", "These", None, 1), ("b", "Thèse x", "", 1), (None, "Thѐse x", "d", 1),
    ]
    df = spark.createDataFrame(rows, "url string, title string, description string, key int")
    got = sorted(tuple(r) for r in lookalikes.same_looking_pairs(df, "url", ["title", "description"]).collect())
    assert got == [("a", "b", "title"), ("b", "c", "title"), ("e", "f", "title")]
    assert lookalikes.same_looking_pairs(df.filter(F.lit(False)), "url", ["title"]).count() == 0
