"""Extraction queries: payloads are built from the offers in Spark and read back by the extraction operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.operators import extract as X
from cairnworks.runtime import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{000b}\x1c-\x1f]+"


def _clean(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '{_SPACES}', ' ', 'g')), '')"


def _pages(spark, d) -> DataFrame:
    html = joined(
        "<html><body><div class='card card-shadow'><h3><a href='", escaped("url"), "'>", escaped("title"), "</a></h3><div class='meta'><p><strong>", escaped("lab"), "</strong></p><p>", escaped("location"),
        "</p></div><ul><li class='label'>", escaped("contract_type"), "<li class='label'>", escaped("duration"), "</ul></div><article><h1>", escaped("title"), "</h1></article><div class='card-dark'><h3>Lieu</h3><p>",
        escaped("location"), "</p></div><table><tr><th>Ref</th><td>", escaped("reference"), "</td></tr></table><h2>Skills</h2><p>", escaped("skills"), "</p><h2>Empty</h2></body></html>",
    )
    return spread(table(spark, d, "offers")).select("url", html.alias("html"))


@query(f"SELECT url, {_clean('title')} AS title, {_clean('location')} AS place, {_clean('reference')} AS reference, {_clean('skills')} AS skills FROM offers")
def detail_struct(spark, d):
    rows = X.detail_rows(_pages(spark, d))
    skills = F.get(F.filter("sections", lambda s: s["heading"] == "Skills"), 0)["text"]
    empty = lambda c: F.nullif(c, F.lit(""))
    return rows.select(F.col("page_url").alias("url"), "title", empty(F.col("facts")["Lieu"]).alias("place"), empty(F.col("table")["Ref"]).alias("reference"), skills.alias("skills"))


@query(f"SELECT url, {_clean('title')} AS title, {_clean('lab')} AS lab, {_clean('location')} AS location FROM offers")
def list_cards(spark, d):
    return X.list_rows(_pages(spark, d)).select("url", "title", "lab", "location")


@query("SELECT url AS page_url, url AS link FROM offers")
def page_links(spark, d):
    return X.link_rows(_pages(spark, d)).select("page_url", "link")


@query(f"SELECT url, {_clean('title')} AS title, {_clean('description')} AS description, {_clean('lab')} AS lab, {_clean('location')} AS location FROM offers WHERE {_clean('title')} IS NOT NULL OR {_clean('description')} IS NOT NULL")
def inventory_fields(spark, d):
    """Rows of a paginated JSON inventory, one payload per offer."""
    row = F.struct(F.col("url").alias("crypt"), F.col("title").alias("titre"), F.replace(F.replace("description", F.lit("<"), F.lit("")), F.lit(">"), F.lit("")).alias("these"), F.col("lab").alias("entite"), F.col("location").alias("ville"))
    payload = F.to_json(F.struct(F.lit(1).alias("recordsTotal"), F.array(row).alias("data")))
    return X.inventory_rows(table(spark, d, "offers").select(payload.alias("p")), "p", "lab", "").select("url", "title", "description", "lab", "location")


@query("SELECT url FROM offers WHERE contains(url, '/Offres/Doctorant/') OR contains(url, '/Offres/CDD/')")
def sitemap_locations(spark, d):
    """Locations of one sitemap per offer, scheme and host removed before."""
    loc = F.regexp_replace("url", "^https:", "")
    xml = joined("﻿<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>", loc, "</loc></url><url><loc>", loc, "</loc></url></urlset>")
    return X.sitemap_urls(table(spark, d, "offers").select(xml.alias("x")), "x", "portal.example", ("/Offres/Doctorant/", "/Offres/CDD/")).select("url")


@query("SELECT source, count(*) AS pages, count(*) AS links, count(DISTINCT url) AS distinct_links FROM offers GROUP BY 1")
def discovery_audit(spark, d):
    links = X.link_rows(_pages(spark, d)).join(table(spark, d, "offers").select(F.col("url").alias("page_url"), "source"), "page_url")
    return links.groupBy("source").agg(F.countDistinct("page_url").alias("pages"), F.count("*").alias("links"), F.countDistinct("link").alias("distinct_links"))


@query(f"""SELECT url, {_clean("concat_ws(' ', title, lab, location, contract_type, duration, title, 'Lieu', location, 'Ref', reference, 'Skills', skills, 'Empty')")} AS text FROM offers""")
def page_texts(spark, d):
    return X.text_rows(_pages(spark, d)).withColumnRenamed("page_url", "url")


def _member_html() -> Column:
    field = lambda name, c: joined(f"<div data-field='{name}'>", F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "n/a").otherwise(escaped(c)), "</div>")
    return joined("<div data-field='title'>", escaped("title"), "</div>", field("entreprise", "lab"), field("lieu", "location"), field("durée", "duration"), "<div data-section='description'>", escaped("skills"), "</div>")


_STATED = " OR ".join("contains(lower(title), '{}')".format(p.replace("'", "''")) for _, phrases in X.PAGE_STATES for p in phrases)


@query(f"""SELECT url, {_clean('title')} AS title, coalesce({_clean('lab')}, 'n/a') AS lab, coalesce({_clean('location')}, 'n/a') AS location, coalesce({_clean('duration')}, 'n/a') AS duration, 'CIFRE' AS contract, {_clean('skills')} AS description,
list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS last_part FROM offers WHERE {_clean('skills')} IS NOT NULL AND NOT ({_STATED})""")
def member_details(spark, d):
    """Records of members' pages: fields by name, defaults, section by keyword."""
    pages = spread(table(spark, d, "offers")).filter(F.trim(F.coalesce("skills", F.lit(""))) != "").select("url", _member_html().alias("payload"), F.lit("entreprise").alias("kind"))
    rows = X.member_rows(pages).filter("state = 'record'")  # a page whose title is a message is none
    return rows.select("url", "title", "lab", "location", "duration", F.col("contract_type").alias("contract"), "description", F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1).alias("last_part"))


@query(f"""SELECT url, {_clean('title')} AS title, {_clean('lab')} AS lab, {_clean('location')} AS location, coalesce({_clean('reference')}, list_last(string_split(regexp_replace(url, '/+$', ''), '/'))) AS reference,
array_to_string(list_filter([{_clean('title')}, {_clean('lab')}, {_clean('location')}], lambda v: v IS NOT NULL), chr(10)) AS raw_text, CASE WHEN source = 'cnrs' THEN 'laboratoire' ELSE 'entreprise' END AS kind FROM offers""")
def member_json_rows(spark, d):
    """Records of JSON rows, dispatched by what the payload holds; company and laboratory by kind."""
    row = F.struct(F.col("title").alias("titre"), F.col("lab").alias("rs"), F.col("location").alias("ville"), F.col("reference").alias("id"))
    pages = table(spark, d, "offers").select("url", F.to_json(F.struct(row.alias("row"))).alias("payload"), F.when(F.col("source") == "cnrs", "laboratoire").otherwise("entreprise").alias("kind"))
    return X.member_rows(pages).select("url", "title", "lab", "location", "reference", "raw_text", F.col("source_specific")["anrt_kind"].alias("kind"))


@query("""SELECT url, 'record' AS state, length(url) AS total, 2 + length(title) % 7 AS pages, CASE WHEN length(title) % 3 = 0 THEN 0 ELSE length(title) END AS results, 1 AS next_links FROM offers""")
def list_page_facts(spark, d):
    """Headline, navigation, stated results and links to further pages of one list page per offer."""
    n = F.length("title")
    stated = F.when(n % 3 == 0, "Aucune offre ne correspond").otherwise(joined(n.cast("string"), " offres trouvées"))
    html = joined("<section><p class='big'>", F.length("url").cast("string"), " posts</p></section><p>", stated, "</p><nav aria-label='Pagination'><a href='?page=2'>", (2 + n % 7).cast("string"), "</a></nav>")
    facts = X.list_facts(table(spark, d, "offers").select("url", html.alias("html")))
    return facts.select(F.col("page_url").alias("url"), "state", F.col("total").cast("long").alias("total"), F.col("pages").cast("long").alias("pages"), F.col("results").cast("long").alias("results"), F.size("next_links").alias("next_links"))
