from cairnworks.llm import pii as P

SHAPES = [
    ("écrire à jean.dupont+these@lab.univ.example.", "email", "jean.dupont+these@lab.univ.example"), ("x [at] a-b [dot] example ou", "email", "x [at] a-b [dot] example"), ("j AT lab DOT test.", "email", "j AT lab DOT test"),
    ("joignable au +33 (0)5 36 49 20 65.", "phone", "+33 (0)5 36 49 20 65"), ("tél. 06-39-98-34-38", "phone", "06-39-98-34-38"), ("appeler le 0033353010929 ou", "phone", "0033353010929"), ("call +32 2 555 73 48", "phone", "+32 2 555 73 48"),
    ("numéro de sécurité sociale 1 63 42 09 656 804 88.", "identity_number", "1 63 42 09 656 804 88"), ("INE 8425395588E.", "identity_number", "8425395588E"), ("passport 23CM58037.", "identity_number", "23CM58037"),
    ("au 30 ter rue Hélène-Castavet - 32995 TOURVAUDON avant", "street_address", "30 ter rue Hélène-Castavet - 32995 TOURVAUDON"), ("97 bis, rue du Four-à-Chaux, bât. D, 61997 Saint-Elvire, +33", "street_address", "97 bis, rue du Four-à-Chaux, bât. D, 61997 Saint-Elvire"),
    ("at 45 Saltbridge Row, Port-Clairval; ask", "street_address", "45 Saltbridge Row, Port-Clairval"),
]


def found(text, patterns=None):
    return [(k, text[a:b]) for a, b, k in P.mentions(text, patterns or P.Patterns())]


def test_shapes():
    for text, kind, mention in SHAPES:
        assert (kind, mention) in found(text), text


def test_numbers_that_are_no_mentions():
    for text in ("du 01.10.2026 au 30.09.2029", "1 850 578 entrées", "doi 10.5555/378.2025.8493", "version 2.4.18.06 du", "06 39 k€", "UMR 6137 occupe 872 bureaux", "0,62 en recall@10", "Lieu : 35770 PONTARMELLE"):
        assert found(text) == [], text


def test_mentions_come_out_as_they_stand():
    text = "écrire à ａnna@ｌab.example​ ici"
    assert found(text) == [("email", "ａnna@ｌab.example")]
    assert P.masked(text, P.Patterns()) == "écrire à [EMAIL]​ ici"
    assert found("Mme Ine\u0300s LE\u0301ROT recevra") == [("person_name", "Ine\u0300s LE\u0301ROT")]
    assert P.masked(None, P.Patterns()) is None and P.masked("", P.Patterns()) == ""


def test_bootstrapping_finds_untitled_names(spark):
    names = [f"{g} {s}" for g in ("Anna", "Bruno", "Carla", "Denis") for s in ("Morel", "Petit", "Roux", "Simon")]
    rows = [(f"t{i}", f"Mme {n} recevra les dossiers.", None, "x") for i, n in enumerate(names)]
    rows += [(f"c{i}", f"Contact scientifique : {n} (a@b.example).", "", "x") for i, n in enumerate(names)]
    rows += [("new", "Contact scientifique : Zoé LEFORT (z@b.example).", None, "x"), ("lab", "Le centre Anna Morel est ouvert. La méthode de Petit suffit.", None, "x"), (None, "Mme Anna Morel", None, "x")]
    df = spark.createDataFrame(rows + rows[:3], "url string, description string, raw_text string, key string")
    got = {tuple(r) for r in P.personal_mentions(df, "url", ["description", "raw_text"]).collect()}
    people = {(k, m) for k, f, kind, m in got if kind == "person_name"}
    assert ("new", "Zoé LEFORT") in people and ("t0", "Anna Morel") in people and not any(k == "lab" for k, _ in people)
    assert P.personal_mentions(df.filter("false"), "url", ["description"]).count() == 0
    masked = {r["key"]: r["text"] for r in P.masked_fields(df, "url", ["description"]).collect()}
    assert masked["new"] == "Contact scientifique : [PERSON_NAME] ([EMAIL])."


def test_patterns_of_seeds_find_identifiers_of_unknown_shape(spark):
    """Numbers and addresses that no shape knows, and upper-case contexts, in the places of seeds of their kind."""
    rows = [(f"i{i}", f"Badge établi, document n° {i % 90 + 10}AB{10000 + i}. Tél. du bureau : 05 36 49 {i % 80 + 10} 65. Déposer au {i + 1} rue du Four, 35000 Rennes, merci.") for i in range(12)]
    rows += [(f"d{i}", f"Le jeu de données compte {i}50 578 entrées, doi 10.5555/378.2025.84{i:02}.") for i in range(12)]
    rows += [("new", "Badge établi, document n° 77 4410 22 918. Tél. du bureau : 536 49 77. Déposer au 4 villa des Lilas, 35000 Rennes, merci."), ("upper", "BADGE ÉTABLI, DOCUMENT N° 5512345678901.")]
    df = spark.createDataFrame(rows, "url string, description string")
    got = {(r["key"], r["pii_kind"], r["mention"]) for r in P.personal_mentions(df, "url", ["description"]).collect()}
    assert {("new", "identity_number", "77 4410 22 918"), ("new", "phone", "536 49 77"), ("new", "street_address", "4 villa des Lilas, 35000 Rennes"), ("upper", "identity_number", "5512345678901")} <= got
    assert not any(k.startswith("d") for k, _, _ in got) and len([k for k, _, _ in got if k.startswith("i")]) == 36


def test_names_in_few_texts(spark):
    """A dozen texts, of which two have courtesy titles: the words of email addresses are seeds as well."""
    people = ["Anna Morel", "Bruno Petit", "Carla Roux", "Denis Simon", "Emma Leroy", "Farid Nadal"]
    rows = [(f"c{i}", f"Contact scientifique : {n} ({n.lower().replace(' ', '.')}@b.example).") for i, n in enumerate(people)] + [("t", "Mme Anna Morel recevra."), ("z", "Contact scientifique : Zoé LEFORT (rh@b.example).")]
    df = spark.createDataFrame(rows, "url string, description string")
    got = {r["mention"] for r in P.personal_mentions(df, "url", ["description"]).collect() if r["pii_kind"] == "person_name"}
    assert got == {*people, "Zoé LEFORT"}


def test_contexts_reach_over_very_long_tokens():
    far = "x" * 5000
    assert P.context(f"a b {far} N", len(far) + 5, len(far) + 6)[0] == f"L b {far}" and P.context(f"N {far} c", 0, 1)[1] == f"R {far} c"
