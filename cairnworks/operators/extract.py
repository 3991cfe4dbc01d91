"""Extraction operators: payloads to rows. HTML trees in Arrow batches, XML and JSON natively.

Null and empty payloads give no list rows and a detail row of nulls with state `empty`. Pages that are not
records come out with their state instead of raising, so that they can be set aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.html import Element, clean, fragment_text, parse
from cairnworks.functions.rules import cascade
from cairnworks.functions.text import CONTACT, reference_in_url, text_or_null, with_scheme

CARD = "url string, position int, title string, lab string, location string, labels array<string>, updated string"
DETAIL = (
    "title string, labels array<string>, location string, facts map<string,string>, sections array<struct<heading:string,text:string>>, table map<string,string>, "
    "fields map<string,string>, state string"
)
_LINK = re.compile(r"offre|offer|detail", re.I)
# Phrases of the page states, in order of precedence, in lower case.
PAGE_STATES = (
    ("logged_out", ("merci de votre visite", "une authentification est nécessaire", "veuillez vous connecter", "session expirée", "session a expiré")),
    ("server_error", ("erreur serveur", "erreur interne", "erreur inattendue", "internal server error", "server error", "http 500", "500 internal", "service unavailable", "bad gateway", "sqlstate")),
    ("unavailable", ("offre indisponible", "offre expirée", "offre expiree", "offre introuvable", "page introuvable", "n'est plus disponible", "n’est plus disponible", "nest plus disponible", "n'est plus en ligne", "has expired", "no longer available", "no longer open", "a été pourvue")),
)
LOGOUT_URLS = ("/logout", "/deconnexion")


def page_state(html: str | None, final_url: str | None = "") -> str:
    """empty, logged_out, server_error, unavailable or record, by the url a fetch ended at and the phrases of the page."""
    if any(x in (final_url or "").lower() for x in LOGOUT_URLS):
        return "logged_out"
    if not html or not html.strip():
        return "empty"
    low = html.lower()
    return next((state for state, phrases in PAGE_STATES if any(p in low for p in phrases)), "record")


def page_states(html: Column, final_url: Column | None = None) -> Column:
    """page_state as an expression; the phrases of a state are one pattern, so that a page is lowered and read once per state."""
    holds = lambda text, parts: F.lower(text).rlike("|".join(f"\\Q{p}\\E" for p in parts))
    rules = [(F.coalesce(F.trim(html) == "", F.lit(True)), "empty"), *((holds(html, phrases), state) for state, phrases in PAGE_STATES)]
    return cascade(([(holds(final_url, LOGOUT_URLS), "logged_out")] if final_url is not None else []) + rules, "record")


def _text(e: Element | None) -> str | None:
    return (e.text() or None) if e is not None else None


def cards(html: str, base: str) -> list[dict]:
    """One row per card that links to a record, search pages left out."""
    out = []
    for card in parse(html).select("div.card"):
        link = card.first("h3 a[href]")
        if link is None or not _LINK.search(link.attrs["href"]) or "Recherche" in link.attrs["href"]:
            continue
        meta = card.select(".meta p")
        out.append({
            "url": urljoin(base, link.attrs["href"]), "position": len(out), "title": _text(link), "lab": _text(card.first(".meta strong")),
            "location": next((p.text() for p in meta if p.first("strong") is None and p.text()), None),
            "labels": [x.text() for x in card.select("li.label")], "updated": _text(card.first(".post-meta .maj")),
        })
    return out


def list_counts(html: str) -> tuple[int | None, int | None]:
    """(total, pages): the first whole number of the headline, the greatest page number of the navigation."""
    root = parse(html)
    head = next((e.text() for e in root.select("section p.big, p.big")), "")
    total = re.search(r"\d+", head.replace(" ", "").replace(" ", ""))
    pages = [int(n) for nav in root.select("nav[aria-label*=agination]") for n in re.findall(r"\d+", nav.text())]
    return (int(total.group()) if total else None), (max(pages) if pages else None)


def links(html: str, base: str) -> list[str]:
    """Links to records, absolute, each once, in order."""
    return list(dict.fromkeys(urljoin(base, a.attrs["href"]) for a in parse(html).select("a[href]") if _LINK.search(a.attrs["href"]) and "page=" not in a.attrs["href"]))


def page_links(html: str, base: str) -> list[str]:
    """Links to further list pages: rel, class, text or query say so."""
    out = []
    for a in parse(html).select("a[href]"):
        says = a.attrs.get("rel") == "next" or re.search(r"pag(?:e|ination)|next|suivant", " ".join((a.attrs.get("class", ""), a.attrs["href"])), re.I) or re.fullmatch(r"\d+|suivante?|next|»", a.text(), re.I)
        if says and not re.search(r"detail", a.attrs["href"], re.I):
            out.append(urljoin(base, a.attrs["href"]))
    return list(dict.fromkeys(out))


def sections_of(root: Element, heads: tuple[str, ...] = ("h2", "h3")) -> list[tuple[str, str]]:
    """(heading, text until the next heading); empty ones dropped, of a repeated heading the last text at the first place."""
    out: dict[str, str] = {}
    for h in root.select(",".join(heads)):
        parts = []
        for s in h.siblings_after():
            if s.tag in heads:
                break
            parts.append(s.text())
        if body := clean(" ".join(parts)):
            out[h.text()] = body
    return list(out.items())


def first_section(sections: list[tuple[str, str]], words: tuple[str, ...]) -> str | None:
    return next((t for h, t in sections if any(w in h.lower() for w in words)), None)


def near_label(root: Element, labels: tuple[str, ...]) -> str | None:
    """The value of the first label that has one: its data field, the text after the colon, else the next element."""
    for label in labels:
        field = root.first(f"[data-field={label.lower()}]")
        if field is not None and field.text():
            return field.text()
        for e in [root, *root.elements()]:
            if e.tag in ("script", "style"):
                continue
            for s in e.children:
                if isinstance(s, str) and label.lower() in s.lower():
                    before, colon, after = s.partition(":")
                    if colon and label.lower() in before.lower() and clean(after):
                        return clean(after)
                    nxt = next((x for x in e.siblings_after() if x.text()), None)
                    if nxt is not None:
                        return nxt.text()
    return None


def detail(html: str | None, base: str = "", labels: tuple[str, ...] = ()) -> dict:
    state = page_state(html)
    if state == "empty":
        return {"state": state}
    root = parse(html)
    facts = {h.text(): p.text() for h in root.select(".card-dark h3") if (p := next((s for s in h.siblings_after() if s.tag == "p"), None)) is not None}
    rows = {th.text(): td.text() for tr in root.select("tr") if (th := tr.first("th")) is not None and (td := tr.first("td")) is not None}
    title = next((t for s in ("article h1", "h1", "title") if (t := _text(root.first(s)))), None)
    return {
        "title": title, "labels": [x.text() for x in root.select("li.label, .post-header .label")], "location": next((p.text() for p in root.select(".meta p") if p.first("strong") is None and p.text()), None),
        "facts": facts, "sections": [{"heading": h, "text": t} for h, t in sections_of(root)], "table": rows,
        "fields": {n: v for n in labels if (v := near_label(root, (n,)))}, "state": state if title or state != "record" else "no_title",
    }


def _rows_of(f: Callable[[str | None, str | None], list[dict]], schema: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"page_url": url, **row} for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in f(html, url)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _arrow(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([("page_url", pa.string()), *ddl_fields])


_S, _L, _M = pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
_CARD = _arrow([("url", _S), ("position", pa.int32()), ("title", _S), ("lab", _S), ("location", _S), ("labels", _L), ("updated", _S)])
_DETAIL = _arrow([("title", _S), ("labels", _L), ("location", _S), ("facts", _M), ("sections", pa.list_(pa.struct([("heading", _S), ("text", _S)]))), ("table", _M), ("fields", _M), ("state", _S)])


def _mapped(row: dict) -> dict:
    return {k: list(v.items()) if isinstance(v, dict) else v for k, v in row.items()}


def list_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Cards of list pages: a table function over (page url, html)."""
    return pages.select(url, html).mapInArrow(_rows_of(lambda h, u: cards(h, u or "") if h else [], _CARD), f"page_url string, {CARD}")


def link_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    schema = _arrow([("link", _S), ("position", pa.int32())])
    f = lambda h, u: [{"link": x, "position": i} for i, x in enumerate(links(h, u or ""))] if h else []
    return pages.select(url, html).mapInArrow(_rows_of(f, schema), "page_url string, link string, position int")


def detail_rows(pages: DataFrame, url: str = "url", html: str = "html", labels: tuple[str, ...] = ()) -> DataFrame:
    return pages.select(url, html).mapInArrow(_rows_of(lambda h, u: [_mapped(detail(h, u or "", labels))], _DETAIL), f"page_url string, {DETAIL}")


def text_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    schema = _arrow([("text", _S)])
    return pages.select(url, html).mapInArrow(_rows_of(lambda h, u: [{"text": parse(h).text() or None if h else None}], schema), "page_url string, text string")


# --- member pages ------------------------------------------------------------------------------------------

_NO_RESULT = ("aucune offre", "aucun résultat", "aucun resultat")
_COUNTS = [re.compile(x) for x in (r"(\d+)\s+offres?\s+(?:trouvées?|disponibles?|publiées?|cifre)", r"(\d+)\s+résultats?", r"(\d+)\s+resultats?")]


def result_count(html: str | None) -> int | None:
    """The number of results a list page states; 0 where it says there is none, null where it says nothing."""
    text = parse(html).text().lower()
    if any(x in text for x in _NO_RESULT):
        return 0
    return next((int(m.group(1)) for c in _COUNTS if (m := c.search(text))), None)


def picked(values: dict[str, str | None], labels: tuple[str, ...]) -> str | None:
    """The value of the first label, without regard to case, that has one."""
    low = {k.lower(): v for k, v in values.items()}
    return next((v for x in labels if (v := low.get(x.lower()))), None)


def picked_from(values: Column, labels: tuple[str, ...]) -> Column:
    """picked as an expression on a map column."""
    entries = F.map_entries(values)
    return F.coalesce(*[F.get(F.filter(entries, lambda e: (F.lower(e["key"]) == x.lower()) & (e["value"] != "")), -1 + F.size(F.filter(entries, lambda e: (F.lower(e["key"]) == x.lower()) & (e["value"] != ""))))["value"] for x in labels])


def keyword_section(root: Element, words: tuple[str, ...]) -> str | None:
    """For the first word that leads to one: the element of that data-section, else the text below the first h2 to h4 that holds it."""
    heads = ("h2", "h3", "h4")
    for word in map(str.lower, words):
        own = root.first(f"[data-section={word}]")
        if own is not None and own.text():
            return own.text()
        heading = next((h for h in root.select(",".join(heads)) if word in h.text().lower()), None)
        if heading is not None:
            parts = []
            for e in heading.siblings_after():
                if e.tag in heads:
                    break
                parts.append(e.text())
            if body := clean(" ".join(parts)):
                return body
    return None


def json_row(payload: str | None) -> dict | None:
    """The row a JSON payload holds: its `row`, or itself where it has a title or a subject; null for other payloads."""
    if not payload or not payload.lstrip().startswith("{"):
        return None
    try:
        data = json.loads(payload)
    except ValueError:
        return None
    if isinstance(data.get("row"), dict):
        return data["row"]
    return data if "titre" in data or "these" in data else None


# The labels of member pages by field, in order; the keys of extra fields in JSON rows.
MEMBER_LABELS = {
    "company_name": ("Entreprise", "Société", "Structure", "Organisation"), "laboratory_name": ("Laboratoire", "Unité", "Equipe", "Équipe"), "sector": ("Secteur", "Domaine"),
    "discipline": ("Discipline", "Domaine scientifique"), "application_deadline": ("Date limite", "Clôture", "Deadline"), "doctoral_school": ("École doctorale", "Ecole doctorale", "Doctoral school"),
    "partner_expected": ("Partenaire recherché", "Partenaire recherche", "Partenaire attendu", "Partner expected"), "remote_or_hybrid": ("Télétravail", "Teletravail", "Remote", "Hybride", "Hybrid"),
    "funding_status": ("Financement", "Funding", "Statut financement"), "cifre_status": ("Statut CIFRE", "Convention CIFRE"), "location": ("Lieu", "Localisation", "Ville"),
    "published_at_text": ("Date de publication", "Publication", "Publié", "Publiée"), "reference": ("Référence", "Reference", "Identifiant", "ID"), "duration": ("Durée", "Duree"), "education_level": ("Niveau", "Diplôme", "Diplome"),
}
MEMBER_SECTIONS = {"description": ("Description", "Sujet", "Projet", "Contexte"), "skills": ("Profil", "Compétences", "Competences", "Candidat")}
MEMBER_DEFAULTS = {"contract_type": "CIFRE", "duration": "36 mois", "education_level": "BAC+5 / Master"}
ROW_EXTRAS = {"anrt_id": "id", "crypt": "crypt", "open": "ouverte", "status": "statut", "postal_code": "cp", "recruitment_date": "dtrecrutement", "recruitment_date_text": "recrutement", "created_at_text": "creation", "updated_at_text": "modification", "document": "doc"}
COMMON = ("location", "published_at_text", "reference", "duration", "education_level")
MEMBER = "url string, state string, reference string, title string, contract_type string, duration string, education_level string, location string, lab string, published_at_text string, description string, skills string, raw_text string, source_specific map<string,string>"


def _owned(company: str | None, laboratory: str | None, kind: str) -> str | None:
    return company if kind == "entreprise" and company else laboratory or company


def member_detail(payload: str | None, url: str, kind: str) -> dict:
    """A member page or a JSON row as one record; pages that are no record come out with their state."""
    if (row := json_row(payload)) is not None:
        return _member_row(row, url, kind)
    state = page_state(payload)
    if state != "record":
        return {"url": url, "state": state}
    root = parse(payload)
    title = next((t for x in ("[data-field=title]", ".offer-title", ".offre-title", "h1", "h2") if (t := _text(root.first(x)))), None)
    raw = "\n".join(t for x in root.strings() if (t := clean(x)))
    found = {name: near_label(root, labels) for name, labels in MEMBER_LABELS.items()}
    extra = {"anrt_kind": kind, **{k: v for k, v in found.items() if v and k not in COMMON}, "contact_visible": str(bool(re.search(CONTACT, raw))).lower()}
    return {
        "url": url, "state": "record" if title else "no_title", "title": title, "lab": _owned(found["company_name"], found["laboratory_name"], kind), "raw_text": raw, "source_specific": extra, "reference": found["reference"] or reference_in_url(url),
        **{k: keyword_section(root, words) for k, words in MEMBER_SECTIONS.items()}, "location": found["location"], "published_at_text": found["published_at_text"], **{k: found.get(k) or v for k, v in MEMBER_DEFAULTS.items()},
    }


def _member_row(row: dict, url: str, kind: str) -> dict:
    value = lambda k: clean(str(row[k])) or None if row.get(k) is not None else None
    owner, other, description = value("rs"), value("entite"), fragment_text(value("these"))
    place = ", ".join(x for x in (value("ville"), value("pays")) if x) or None
    names = {"company_name": owner, "laboratory_name": other, "sector": value("secteur")} if kind == "entreprise" else {"laboratory_name": owner, "laboratory_sigle": value("sigle")}
    extra = {"anrt_kind": kind, "contact_visible": str(bool(re.search(CONTACT, description or ""))).lower(), "discipline": value("discipline"), **names, **{k: value(c) for k, c in ROW_EXTRAS.items()}}
    parts = [value("titre"), owner, other, value("discipline"), value("secteur"), place, description]
    return {
        "url": url, "state": "record" if parts[0] else "no_title", "title": parts[0], "lab": owner, "location": place, "published_at_text": value("creation"), "description": description, "skills": None,
        "reference": value("id") or reference_in_url(url), "raw_text": "\n".join(x for x in parts if x), "source_specific": {k: v for k, v in extra.items() if v is not None}, **MEMBER_DEFAULTS,
    }


def member_rows(payloads: DataFrame, url: str = "url", payload: str = "payload", kind: str = "kind", default_kind: str = "entreprise") -> DataFrame:
    """One record per (url, payload, kind), in Arrow batches; an unknown kind is the default one."""
    names = [x.split()[0] for x in MEMBER.split(", ")]
    schema = pa.schema([(n, _M if n == "source_specific" else _S) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_mapped(member_detail(p, u, k or default_kind)) for u, p, k in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=schema)

    return payloads.select(url, payload, kind).filter(F.col(url).isNotNull()).mapInArrow(run, MEMBER)


def list_facts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, state, total, pages, results, next_links) of list pages: headline, navigation, stated results and links to further pages."""
    schema = _arrow([("state", _S), ("total", pa.int32()), ("pages", pa.int32()), ("results", pa.int32()), ("next_links", _L)])

    def facts(h: str | None, u: str | None) -> list[dict]:
        state = page_state(h, u)
        if state != "record":
            return [{"state": state, "next_links": []}]
        total, last = list_counts(h)
        return [{"state": state, "total": total, "pages": last, "results": result_count(h), "next_links": page_links(h, u or "")}]

    return pages.select(url, html).mapInArrow(_rows_of(facts, schema), "page_url string, state string, total int, pages int, results int, next_links array<string>")


# --- XML and JSON, native ----------------------------------------------------------------------------------


def sitemap_urls(payloads: DataFrame, xml: str, host: str, keep: tuple[str, ...]) -> DataFrame:
    """(url, position): locations with one of the path parts, each once at its first place."""
    locs = payloads.select(F.posexplode(F.xpath(F.regexp_replace(xml, "^﻿", ""), F.lit("//loc/text()"))).alias("position", "loc"))
    urls = locs.select(with_scheme(F.trim("loc"), host).alias("url"), "position")
    wanted = F.lit(False)
    for part in keep:
        wanted = wanted | F.contains("url", F.lit(part))
    return urls.filter(wanted).groupBy("url").agg(F.min("position").alias("position")).orderBy("position")


INVENTORY = (
    "recordsFiltered int, recordsTotal int, data array<struct<id:string,crypt:string,titre:string,these:string,rs:string,entite:string,sigle:string,discipline:string,secteur:string,"
    "ville:string,pays:string,cp:string,ouverte:string,statut:string,dtrecrutement:string,recrutement:string,creation:string,modification:string,doc:string>>"
)


def inventory_rows(payloads: DataFrame, column: str, kind: str, base: str) -> DataFrame:
    """Rows of paginated JSON inventories; rows without title and subject are left out; company and laboratory swap by kind."""
    x = payloads.select(F.from_json(column, INVENTORY).alias("p")).select(F.coalesce("p.recordsFiltered", "p.recordsTotal").alias("total"), F.explode("p.data").alias("r"))
    subject = text_or_null(F.regexp_replace("r.these", "<[^>]*>", " "))
    company, lab = text_or_null(F.col("r.rs")), text_or_null(F.col("r.entite"))
    place = F.nullif(F.array_join(F.filter(F.array(text_or_null(F.col("r.ville")), text_or_null(F.col("r.pays"))), lambda v: v.isNotNull()), ", "), F.lit(""))
    rows = x.select(
        "total", F.concat(F.lit(base), F.coalesce(F.nullif("r.crypt", F.lit("")), "r.id")).alias("url"), text_or_null(F.col("r.titre")).alias("title"), subject.alias("description"),
        (company if kind == "company" else F.coalesce(lab, company)).alias("lab"), (lab if kind == "company" else company).alias("partner"), place.alias("location"),
        text_or_null(F.col("r.discipline")).alias("discipline"), text_or_null(F.col("r.secteur")).alias("sector"),
    )
    raw = F.array_join(F.filter(F.array("title", "description", "lab", "location"), lambda v: v.isNotNull()), "\n")
    return rows.filter("title IS NOT NULL OR description IS NOT NULL").withColumn("raw_text", raw)


def response_text(payloads: DataFrame, column: str) -> DataFrame:
    """All strings of output[].content[].text joined; null where there are none."""
    parsed = F.from_json(column, "output array<struct<content:array<struct<text:string>>>>")
    texts = F.filter(F.flatten(F.transform(parsed["output"], lambda o: F.transform(F.coalesce(o["content"], F.expr("cast(array() AS array<struct<text:string>>)")), lambda c: c["text"]))), lambda t: t.isNotNull())
    return payloads.withColumn("answer", F.nullif(F.array_join(texts, ""), F.lit("")))
