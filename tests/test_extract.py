import json

import pytest
from pyspark.sql import functions as F

from cairnworks.functions.html import fragment_text, parse
from cairnworks.operators import extract as X

LIST = """<html><body><section class="section-grey"><p class="big"><strong>2 748 posts</strong></p></section>
<div class="card card-shadow"><h3><a href="/Offres/Doctorant/A1">First &amp; best</a></h3><div class="meta"><p><strong>Lab X</strong></p><p>71000 MARSENAC</p></div>
<ul><li class="label"><span>Fixed term</span><li class="label"><span>20 months</span></ul><div class="post-meta"><span class="maj">3 h ago</span></div></div>
<div class="card card-shadow"><h3><a href="/Offres/Recherche.aspx">Search</a></h3></div><div class="card"><h3>No link</h3></div>
<nav aria-label="Pagination"><a href="?Page=2">2</a><a href="?Page=9">9</a></nav></body></html>"""
DETAIL = """<article><h1> The <b>title</b></h1></article><!-- hidden --><script>var x = "page introuvable?"</script>
<div class="card-dark"><h3>Lieu</h3><p>MARSENAC</p><h3>Lieu</h3><p>VALMORIN</p></div><table><tr><th>Ref</th><td>R-8</td></tr></table>
<h2>Topic</h2><p>One.</p><ul><li>Two<li>Three</ul><h2>Empty</h2><h2>Topic</h2><p>Last.</p><dl><dt>Company</dt><dd>ACME</dd></dl><p>City : Lyon</p>"""


def test_cards_and_counts():
    rows = X.cards(LIST, "https://p.example/list")
    assert len(rows) == 1
    assert rows[0] == {"url": "https://p.example/Offres/Doctorant/A1", "position": 0, "title": "First & best", "lab": "Lab X", "location": "71000 MARSENAC", "labels": ["Fixed term", "20 months"], "updated": "3 h ago"}
    assert X.list_counts(LIST) == (2748, 9)
    assert X.list_counts("<p>none</p>") == (None, None)


def test_detail():
    d = X.detail(DETAIL.replace("page introuvable?", "x"), labels=("Company", "City", "Phone"))
    assert d["title"] == "The title" and d["facts"] == {"Lieu": "VALMORIN"} and d["table"] == {"Ref": "R-8"} and d["state"] == "record"
    assert {"heading": "Topic", "text": "Last. Company ACME City : Lyon"} in d["sections"] and "Empty" not in {x["heading"] for x in d["sections"]}
    assert d["fields"] == {"Company": "ACME", "City": "Lyon"}
    assert X.first_section([("Intro", "a"), ("Sujet de thèse", "b")], ("sujet", "topic")) == "b"


@pytest.mark.parametrize("html,state", [(None, "empty"), (" ", "empty"), ("<p>Veuillez vous connecter</p>", "logged_out"), ("<p>Merci de votre visite</p>", "logged_out"), ("<p>Bad Gateway</p>", "server_error"), ("Cette offre n’est plus disponible", "unavailable")])
def test_page_states(html, state):
    assert X.page_state(html) == state


def test_state_by_url_and_as_an_expression(spark):
    assert X.page_state("<p>x</p>", "https://p.example/Logout?x") == "logged_out"
    cases = [(None, None), (" ", ""), ("Bad Gateway", ""), ("x", "https://p/deconnexion"), ("Offre expirée", ""), ("x", "https://p/1"), ("session a expiré, offre expirée", None)]
    df = spark.createDataFrame(cases, "h string, u string")
    assert [r[0] for r in df.select(X.page_states(F.col("h"), F.col("u"))).collect()] == [X.page_state(h, u) for h, u in cases]


def test_result_count():
    assert X.result_count("<p>Aucune offre</p>") == 0 and X.result_count("<b>17</b> offres trouvées sur 3 résultats") == 17 and X.result_count("<p>8 résultats</p>") == 8 and X.result_count(None) is None


def test_pick_by_priority(spark):
    values = {"lieu": "A", "LIEU DE TRAVAIL": "B", "Ville": ""}
    assert X.picked(values, ("ville", "Lieu de travail", "lieu")) == "B" and X.picked(values, ("x",)) is None
    got = spark.createDataFrame([(values,), ({},), (None,)], "m map<string,string>").select(X.picked_from(F.col("m"), ("ville", "Lieu de travail", "lieu"))).collect()
    assert [r[0] for r in got] == ["B", None, None]


def test_sections_by_keyword():
    root = parse("<h1>T</h1><div data-section='profil'> P </div><h4>Le sujet de thèse</h4><p>a</p><p>b</p><h3>Suite</h3><p>c</p><h2>Vide</h2>")
    assert X.keyword_section(root, ("Profil",)) == "P" and X.keyword_section(root, ("Description", "Sujet")) == "a b" and X.keyword_section(root, ("vide", "nothing")) is None


MEMBER = """<h1>Graphs in space</h1><p>Entreprise : ORBITA</p><dl><dt>Laboratoire</dt><dd>LIX-9</dd></dl><p>Lieu : Valmorin</p><p>Référence : X-1</p>
<h2>Description du sujet</h2><p>We orbit.</p><h3>Profil</h3><p>Write to a@b.example</p>"""


def test_member_pages_and_rows(spark):
    d = X.member_detail(MEMBER, "https://m.example/offre/7/", "entreprise")
    assert (d["title"], d["lab"], d["location"], d["reference"], d["duration"], d["description"], d["state"]) == ("Graphs in space", "ORBITA", "Valmorin", "X-1", "36 mois", "We orbit.", "record")
    assert d["source_specific"] == {"anrt_kind": "entreprise", "company_name": "ORBITA", "laboratory_name": "LIX-9", "contact_visible": "true"} and X.member_detail(MEMBER, "u", "laboratoire")["lab"] == "LIX-9"
    row = {"row": {"id": 5, "titre": " T ", "these": "<p>Sub<b>ject</b></p>", "rs": "ACME", "entite": "LAB", "ville": "Lyon", "pays": None, "secteur": "IT", "statut": 1}}
    r = X.member_detail(json.dumps(row), "https://m.example/5", "entreprise")
    assert (r["title"], r["lab"], r["reference"], r["description"], r["raw_text"].split("\n")[0]) == ("T", "ACME", "5", "Sub ject", "T") and r["source_specific"]["status"] == "1" and r["source_specific"]["sector"] == "IT"
    assert X.member_detail(json.dumps(row["row"]), "u/9", "laboratoire")["source_specific"]["laboratory_name"] == "ACME"
    assert X.json_row("{bad") is None and X.json_row("[]") is None and X.json_row('{"x": 1}') is None and X.json_row(None) is None
    df = spark.createDataFrame([("u1", MEMBER, None), ("u2", "Offre introuvable", "laboratoire"), ("u3", None, "x"), ("u4", "<p>no heading</p>", "x"), (None, MEMBER, "x")], "url string, payload string, kind string")
    got = {r["url"]: r for r in X.member_rows(df).collect()}
    assert got["u1"]["lab"] == "ORBITA" and [got[u]["state"] for u in ("u2", "u3", "u4")] == ["unavailable", "empty", "no_title"] and len(got) == 4


def test_list_facts(spark):
    df = spark.createDataFrame([("https://p.example/l", LIST), ("https://p.example/logout", LIST), ("e", None)], "url string, html string")
    got = {r["page_url"]: r for r in X.list_facts(df).collect()}
    x = got["https://p.example/l"]
    assert (x["state"], x["total"], x["pages"], x["results"]) == ("record", 2748, 9, None) and x["next_links"] == ["https://p.example/l?Page=2", "https://p.example/l?Page=9"] and got["https://p.example/logout"]["state"] == "logged_out" and got["e"]["state"] == "empty"


def test_links():
    html = '<a href="/offre-detail/1">x</a><a href="/offre-detail/1">again</a><a href="/about">y</a><a class="next" href="/offres?page=2">suivant</a>'
    assert X.links(html, "https://p.example/") == ["https://p.example/offre-detail/1"]
    assert X.page_links(html, "https://p.example/") == ["https://p.example/offres?page=2"]


def test_fragment_text_and_selectors():
    assert fragment_text("<p>a<br>b</p><style>c</style>&nbsp;d") == "a b d"
    assert fragment_text("") is None and fragment_text(None) is None
    root = parse('<div id="m" class="x y"><p data-k="v1">t</p></div>')
    assert root.first("#m .none") is None and root.first("div.x.y p[data-k^=v]").text() == "t"


def test_rows_in_batches(spark):
    pages = spark.createDataFrame([("https://p.example/l", LIST, 1), ("https://p.example/e", None, 2)], "url string, html string, page_url int")
    assert X.list_rows(pages).count() == 1
    assert X.link_rows(pages).select("link").collect()[0][0].endswith("/A1")
    d = {r["page_url"]: r for r in X.detail_rows(spark.createDataFrame([("u", DETAIL), ("v", None)], "url string, html string")).collect()}
    assert d["u"]["facts"] == {"Lieu": "VALMORIN"} and d["v"]["state"] == "empty" and d["v"]["title"] is None
    assert X.text_rows(spark.createDataFrame([("u", "<b>a</b> c"), ("v", None)], "url string, html string")).orderBy("page_url").collect()[0]["text"] == "a c"


def test_sitemap(spark):
    xml = '﻿<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{u}</loc></url>" for u in ("//p.example/Offres/Doctorant/1", "p.example/Offres/CDD/2", "/Offres/CDD/2", "https://p.example/Other/3")) + "</urlset>"
    got = X.sitemap_urls(spark.createDataFrame([(xml,)], "x string"), "x", "p.example", ("/Offres/Doctorant/", "/Offres/CDD/")).collect()
    assert [r["url"] for r in got] == ["https://p.example/Offres/Doctorant/1", "https://p.example/Offres/CDD/2"]


def test_inventory(spark):
    row = {"id": 7, "crypt": "", "titre": " T ", "these": "<p>Subject</p>", "rs": "ACME", "entite": None, "ville": "Lyon", "pays": ""}
    payload = json.dumps({"recordsTotal": 2, "data": [row, {"id": 8, "titre": " ", "these": ""}]})
    df = spark.createDataFrame([(payload,), ("not json",), (None,)], "p string")
    got = X.inventory_rows(df, "p", "lab", "https://m.example/d/").collect()
    assert len(got) == 1 and got[0]["url"] == "https://m.example/d/7" and got[0]["lab"] == "ACME" and got[0]["raw_text"] == "T\nSubject\nACME\nLyon" and got[0]["total"] == 2


def test_response_text(spark):
    df = spark.createDataFrame([(json.dumps({"output": [{"content": [{"text": "a"}, {"x": 1}]}, {"content": None}, {"content": [{"text": "b"}]}]}),), ("{}",)], "p string")
    assert [r["answer"] for r in X.response_text(df, "p").collect()] == ["ab", None]
