from datetime import datetime as dt

import pytest

from cairnworks.operators.state import RunLog, VersionedTable
from cairnworks.sources import crawl as C
from cairnworks.sources.payloads import SourceDefinition

HOST = "https://m.example"


def listing(*links, more=(), text=""):
    return text + "".join(f"<a href='{x}'>x</a>" for x in links) + "".join(f"<a class='next' href='{x}'>suivant</a>" for x in more)


PAGES = {
    f"{HOST}/list/a": listing("/offre-detail/1", "/offre-detail/2", more=["/list/a?page=2"], text="<p>3 offres trouvées</p>"),
    f"{HOST}/list/a?page=2": listing("/offre-detail/3", "/offre-detail/1", more=["/list/a?page=3", "/list/a"]),
    f"{HOST}/list/a?page=3": "<p>Une authentification est nécessaire</p>",
    f"{HOST}/list/b": listing("/offre-detail/3", "/offre-detail/4"),
    f"{HOST}/list/c": "<p>Bienvenue</p>",
    **{f"{HOST}/offre-detail/{i}": f"<h1>Offer {i}</h1><p>Entreprise : E{i}</p>" for i in (1, 2, 4)},
    f"{HOST}/offre-detail/3": "<p>Offre introuvable</p>",
}


def fetcher():
    pages = dict(PAGES)  # a closure: workers cannot import this module

    def fetch(url):
        if url not in pages:
            raise OSError("no such page")
        return pages[url]

    return fetch


fetch = fetcher()


def inventory(start):
    rows = [{"id": i, "titre": f"Row {i}", "rs": "ACME"} for i in range(30)] + [{"id": 99, "titre": " "}]
    return {"recordsFiltered": "31", "data": rows[start : start + 25]}


def test_offset_pages_stop_and_tell_the_cap():
    rows, total, pages, capped = C.offset_pages(inventory, 25, 50)
    assert (len(rows), total, pages, capped) == (30, 31, 2, False)
    assert C.offset_pages(inventory, 25, 1)[1:] == (31, 1, True)
    assert C.offset_pages(lambda s: {"data": []}, 25, 9) == ([], None, 1, False) and C.offset_pages(lambda s: None, 25, 9) == ([], None, 1, False)
    body = C.offset_body("entreprise", 25, 25, 2)
    assert body["start"] == "25" and body["columns[2][data]"] == "secteur" and body["columns[0][search][value]"] == "" and len(body) == 11 + 36


def test_discovery_by_levels(spark):
    kinds = [C.Kind("entreprise", f"{HOST}/list/a"), C.Kind("laboratoire", f"{HOST}/list/b"), C.Kind("autre", f"{HOST}/list/c", inventory, f"{HOST}/row/")]
    d = C.discovered(spark, kinds, fetch)
    links = {r["url"].removeprefix(HOST): r["kind"] for r in d.links.collect()}
    assert {k: v for k, v in links.items() if "detail" in k} == {"/offre-detail/1": "entreprise", "/offre-detail/2": "entreprise", "/offre-detail/3": "entreprise", "/offre-detail/4": "laboratoire"} and len(links) == 34
    audit = {r["kind"]: (r["pages"], r["urls"], r["duplicates"], r["results"], r["capped"]) for r in d.audit.collect()}
    assert audit == {"entreprise": (3, 3, 0, 3, False), "laboratoire": (1, 2, 1, None, False), "autre": (3, 30, 0, 31, False)}
    assert [e.split(": ")[1] for e in d.errors] == ["logged_out"]
    capped = C.discovered(spark, kinds[:1], fetch, most_pages=1)
    assert capped.audit.first()["capped"] and capped.links.count() == 2


def test_runs_end_to_end(spark, tmp_path):
    table = lambda name: VersionedTable(spark, str(tmp_path / name))
    log, offers, snaps, pages = RunLog(table("runs")), table("offers"), table("snaps"), table("pages")
    definition = SourceDefinition("members", "Members", True)
    kinds = [C.Kind("entreprise", f"{HOST}/list/a?page=2"), C.Kind("laboratoire", f"{HOST}/list/b")]
    run, quality = C.ingested(spark, C.MemberAdapter(definition, kinds, fetch), log, offers, snaps, pages, dt(2026, 1, 1), complete=True)
    state = {r["url"].removeprefix(HOST): (r["lab"], r["last_seen_status"]) for r in offers.read().collect()}
    assert run == 1 and quality == "ok" and state == {"/offre-detail/1": ("E1", "seen"), "/offre-detail/2": ("E2", "seen"), "/offre-detail/4": ("E4", "seen")}
    kinds = [C.Kind("laboratoire", f"{HOST}/list/b")]
    run, quality = C.ingested(spark, C.MemberAdapter(definition, kinds, fetch), log, offers, snaps, pages, dt(2026, 1, 2), complete=True)
    state = {r["url"].removeprefix(HOST): (r["last_seen_status"], r["first_seen_at"]) for r in offers.read().collect()}
    assert state["/offre-detail/1"] == ("missing", dt(2026, 1, 1)) and state["/offre-detail/4"] == ("seen", dt(2026, 1, 1)) and run == 2
    assert snaps.read().count() == 4 and pages.read().filter("payload IS NULL").count() == 0
    rows = {r["id"]: r for r in log.rows().collect()}
    assert rows[2]["offers_discovered"] == 2 and rows[2]["errors_count"] == 1 and rows[2]["finished_at"] == dt(2026, 1, 2)
    with pytest.raises(ZeroDivisionError):
        class Broken(C.MemberAdapter):
            def urls(self, spark):
                return 1 / 0

        C.ingested(spark, Broken(definition, kinds, fetch), log, offers, snaps, pages, dt(2026, 1, 3))
    assert {r["id"]: r["status_message"] for r in log.rows().collect()}[3] == "error"


def test_public_portal(spark):
    card = "<div class='card card-shadow'><h3><a href='/Offres/Doctorant/{0}'>Offer {0}</a></h3></div>"
    lists = spark.createDataFrame([(f"{HOST}/l1", card.format(1) + card.format(2)), (f"{HOST}/l2", card.format(2) + card.format(3))], "url string, html string")

    def get(url):
        return f"<h1>Title of {url}</h1>"

    adapter = C.PortalAdapter(SourceDefinition("public", "Public", False), lists, get, most=2)
    rows = {r["url"]: r for r in adapter.run(spark).collect()}
    assert set(rows) == {f"{HOST}/Offres/Doctorant/1", f"{HOST}/Offres/Doctorant/2"} and rows[f"{HOST}/Offres/Doctorant/1"]["title"].endswith("/1?lang=FR")
    xml = spark.createDataFrame([("<urlset><url><loc>https://m.example/Offres/CDD/9</loc></url></urlset>",)], "payload string")
    assert [r["url"] for r in C.PortalAdapter(adapter.definition, lists, get, sitemap=xml, host="m.example").run(spark).collect()] == ["https://m.example/Offres/CDD/9"]
    asks = [tuple(r) for r in C.list_requests(spark, "https://p/s", 3).orderBy("position").collect()]
    assert asks == [(0, "GET", "https://p/s?lang=FR", None), (1, "POST", "https://p/s", "Page=2"), (2, "POST", "https://p/s", "Page=3")]
