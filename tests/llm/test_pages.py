import random

import pytest

from cairnworks.llm import main_text, pages as P, residue as R

# Link text in no language, so that no wording can be known beforehand.
NOTICE = "Zorbl kanta vi " + "mirole tan dapo " * 20 + "Zu {} fi."
FURNITURE = ["Kanta | Dapo | Ruvi", "Zorbl {} vi pol", "Ruvi tanel", "Pol dapo ({})", "Mirole kanta !", NOTICE]
LIST_HEAD, TASKS = "Tanel ruvi", ("graph mining", "image analysis", "speech models", "data fusion")
MESSAGE = "Vira sol. " + "Denu pako limi tarro " * 15 + "Code {}."
LONG_TITLE = "Vira sol denu pako limi tarro vira sol denu pako limi tarro vira sol denu pako limi tarro"


def name(rnd):
    return "".join(rnd.choice("BDFGKLMNPRSTVZ") + rnd.choice("AEIOU") for _ in range(3))


def page(rnd, title):
    """(text, lines of the record): link text before the heading and at any place below it."""
    furniture = lambda: rnd.choice(FURNITURE).format(rnd.randrange(10**6))
    other = lambda: f"PhD position in {rnd.choice(TASKS)} - {name(rnd)}"
    skills = rnd.sample(["Git", "Rust", "Julia", "Slurm", "curiosity"], 3)
    record = [title, f"Place : {rnd.randrange(10**5)} Town", "Topic", f"We study {name(rnd)} and write it down, with care.", f"The {name(rnd)} group has people from many places.", "Skills", *skills, f"Rare {name(rnd)} and {name(rnd)}", "Contact", f"Call {rnd.randrange(10**8)}."]
    lines = [(f"{title} - Portal", False), *((furniture(), False) for _ in range(3))]
    for x in record:
        lines.append((x, True))
        if rnd.random() < 0.2:
            lines.append((furniture(), False))
        if rnd.random() < 0.15 and x != title:
            lines += [(LIST_HEAD, False), (other(), False), ("", False), (other(), False)]
    return "\n".join(x for x, _ in lines), [i + 1 for i, (_, own) in enumerate(lines) if own]


def messages(rnd, i):
    return "\n".join([FURNITURE[i % 5].format(i), "404", MESSAGE.format(rnd.randrange(10**6)), rnd.choice(FURNITURE).format(i)])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out, want = [], {}
    for i in range(150):
        title = f"PhD position in {rnd.choice(TASKS)} - {name(rnd)}"
        text, want[f"u{i}"] = page(rnd, title)
        out.append((f"u{i}", title, text, "ab"[i % 2], "x"))
    out += [(f"e{i}", LONG_TITLE, messages(rnd, i), "ab"[i % 2], "x") for i in range(12)]
    return out, want


@pytest.fixture
def corpus(spark, rows):
    odd = [("empty", "My job", "", "a", "x"), (None, "My job", rows[0][0][2], "a", "x"), ("null", None, None, "b", "x"), ("once", "Just a moment", "Just a moment\nChecking your browser", "a", "x")]
    return spark.createDataFrame(rows[0] + odd, "url string, title string, raw_text string, source string, key string")


def found_lines(df):
    got = {}
    for r in main_text.main_lines(df, "url", "title", "raw_text", "source").collect():
        got.setdefault(r["key"], []).append(r["line_no"])
    return {k: sorted(v) for k, v in got.items()}


def test_main_lines_with_no_known_wording(corpus, rows):
    got = found_lines(corpus)
    assert {k: v for k, v in got.items() if k[0] == "u"} == rows[1]
    assert not any(k in got for k in ("e0", "empty", "null", None))


def test_the_density_decides(rows):
    """Without it the unknown lines of lists of other records come in, and the window title does."""
    lexicon = P.Lexicon({P.line_digest(LIST_HEAD)}, pairs={d for r in rows[0][:150] for d, _ in P.word_pairs(r[1])})
    r = next(r for r in rows[0] if LIST_HEAD in r[2])
    read = P.read_page(r[1], r[2], lexicon)
    kept = P.body_lines(read, lexicon)
    others = [i for i, x in enumerate(read.lines) if x.startswith("PhD") and i != read.heading]
    assert others and not set(others) & set(kept)
    root, head, main = P.page_tree(read, lexicon)
    assert all(P.density(c, root) < P.density(main, root) for c in main.children if set(others) & set(c.lines))
    plain = P.Lexicon(lexicon.links)  # the same lines without link text: their density is that of prose
    assert set(others) & set(P.body_lines(P.read_page(r[1], r[2], plain), plain))


def test_a_very_long_page_is_read_whole(spark, rows):
    text = rows[0][0][2]
    df = spark.createDataFrame([*rows[0], ("long", rows[0][0][1], text + "\nword and more words here." * 20000, "a", "x")], "url string, title string, raw_text string, source string, key string")
    got = found_lines(df)["long"]
    assert len(got) == len(rows[1]["u0"]) + 20000


def test_residue_fields(corpus):
    """A widely recurring message of no known wording, of over 300 characters, is found, and a title of over 60; a phrase of messages that does not recur is none."""
    got = {tuple(r) for r in R.residue_fields(corpus, "url", "title", "raw_text", "source").collect()}
    assert got == {(f"e{i}", f) for i in range(12) for f in ("title", "raw_text")} and len(MESSAGE) > 300 and len(LONG_TITLE) > 60
    assert R.residue_fields(corpus.filter("false"), "url", "title", "raw_text", "source").count() == 0


def test_without_what_was_learned_no_message_is_known(rows):
    page_of = P.read_page(rows[0][-1][1], rows[0][-1][2], P.Lexicon())
    assert not R.holds_no_record(page_of, P.Lexicon())
    assert R.holds_no_record(page_of, P.Lexicon(messages={P.line_digest(MESSAGE.format(1)), P.line_digest("404"), *(P.line_digest(x) for x in page_of.lines)}))


def test_phrases_decide_on_groups_that_recur_less_clearly(spark):
    rows = [(f"e{i}", "503 Service Unavailable", "503 Service Unavailable\nRetry after 3 s.", "a") for i in range(2)] + [("x", "A job", "A job\nRetry and learn", "b")]
    df = spark.createDataFrame(rows, "url string, title string, raw_text string, source string")
    got = {tuple(r) for r in R.residue_fields(df, "url", "title", "raw_text", "source").collect()}
    assert got == {(f"e{i}", f) for i in range(2) for f in ("title", "raw_text")}


@pytest.mark.parametrize("text", ["{{nom_labo}}", "Offre ${x}", "<%= unit.name %>", "[[a]]", "Lieu : à renseigner", "Durée : NaN", "[À COMPLÉTER] x", "XXXX : y", "#REF!", "##DUREE##", "%LIEU_TRAVAIL%", "$date_debut : z", "__a.b__", "TBD : vision", "........ (compléter)"])
def test_placeholders(text):
    assert R.has_placeholder(text)


@pytest.mark.parametrize("text", ["poids notés {w}", "comité [H/F]", "x [2e appel]", "a [at] b [dot] c", "recall@10 et 5 %", "null hypothesis", "C# et F#", "5 < x > 3", "R$ 5", "Accueil > Offres"])
def test_no_placeholders(text):
    assert not R.has_placeholder(text)


def test_filler_and_messages():
    assert R.is_filler("Lorem ipsum dolor sit amet") and R.is_filler("test test test azerty") and not R.is_filler("La méthode d'apprentissage par lorem reste rare")
    known = P.Lexicon(titles={P.line_digest("Just a moment")})
    assert R.title_residue("Just a moment", known) and not R.title_residue("Just a moment", P.Lexicon()) and not R.title_residue("Thèse (H/F) fouille de graphes", known)
    assert R.has_placeholder("{{" + "a very long name of a field " * 5 + "}}")


def test_masked_line_digests_join_variants():
    assert P.line_digest("Version 12.3 - page générée en 3 ms") == P.line_digest("Version 99.41 - page générée en 41 ms")
    assert P.line_digest("a@b.fr écrit") == P.line_digest("x.y@c.org écrit")


STANDINS = ["undefined", "null", "NaN", "None", "TBD", "TBC", "TBA", "TODO", "N/C", "to be defined", "to be completed", "???", "____", "....", "à renseigner", "à compléter", "à préciser", "à définir"]
TO_FILL = [f"{a} {v}" for a in "àa" for v in ("compléter", "completer", "préciser", "preciser", "renseigner", "définir", "remplir")]
FIELDS = ["{{x}}", "${x}", "#{x}", "{% x %}", "<% x %>", "[[x]]", "##x##", "@@x@@", "{a_b}", "{AB}", "{abc}", "[a.b]", "[ABCD]", "<a_b>", "<ABCD>", "%a_b%", "%ABC%", "%abcd%", "__a__", "$a_b", "$ABC", "$abcd",
          "[object Object]", "#REF!", "#N/A", "#VALUE!", "#NAME?", "#DIV/0!", "XXXX", "..... (", "(compléter)", "(completer)", "(to be completed)", "(to complete)", "[insert x]", "[insérez x]", "<insert x>"]


def test_hints_agree_with_the_patterns_on_every_alternative():
    samples = [f"Poste {x} " for x in FIELDS] + [f"Lieu : {x}" for x in STANDINS] + [f"Poste {o}{b}{x}" for o in "(<[{%$#_" for b in ("", " ") for x in TO_FILL]
    for sample in samples:
        assert R.has_placeholder(sample), sample
        for x in (sample.upper(), sample.title(), sample.lower(), sample.replace("i", "ı").replace("s", "ſ")):
            assert R.has_placeholder(x) == any(p.search(x) is not None for p in (R.PLACEHOLDERS, R._WHOLE_VALUE, R._IN_PLACE)), x
