"""Crawls as dataflow: requests, list pages level by level, offset pages, details, records, audit.

The driver holds page addresses only, of which there are at most `most_pages` per kind; pages, links and records
stay in tables. List pages of one level are fetched together, in partitions, and read by the extraction operators.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from cairnworks.functions.text import with_language
from cairnworks.operators import extract as X
from cairnworks.operators.state import RunCounters, RunLog, VersionedTable, first_owner, mark_missing, merge_by_key, run_quality
from cairnworks.runtime import cut
from cairnworks.sources.payloads import Fetcher, SourceAdapter, SourceDefinition, fetch_missing

LINKS = "url string, kind string, kind_order int, page int, position int, row string"


def list_requests(spark: SparkSession, search_url: str, pages: int) -> DataFrame:
    """(position, method, url, body) of the list pages of a search: the first by GET with the language, later ones by POST of their number."""
    number = F.col("id") + 1
    return spark.range(pages).select(
        F.col("id").cast("int").alias("position"), F.when(number == 1, "GET").otherwise("POST").alias("method"),
        F.when(number == 1, F.lit(f"{search_url}?lang=FR")).otherwise(F.lit(search_url)).alias("url"), F.when(number > 1, F.concat(F.lit("Page="), number)).alias("body"),
    )


# Columns of the paginated inventories by kind.
INVENTORY_COLUMNS = {"entreprise": ("rs", "discipline", "secteur", "ville", "paysid", "dtrecrutement"), "laboratoire": ("rs", "discipline", "ville", "paysid", "dtrecrutement", "ouverte")}


def offset_body(kind: str, start: int, length: int, draw: int) -> dict[str, str]:
    """The form of one page of a paginated inventory."""
    body = {"draw": str(draw), "start": str(start), "length": str(length), "search[value]": "", "search[regex]": "false", "offreType": kind}
    body |= {f"filter_{x}": "" for x in ("ouverte", "enseigne", "secteur", "discipline", "categorie")}
    for i, name in enumerate(INVENTORY_COLUMNS[kind]):
        own = {"data": name, "name": "", "searchable": "true", "orderable": "true", "search][value": "", "search][regex": "false"}
        body |= {f"columns[{i}][{k}]": v for k, v in own.items()}
    return body


def offset_pages(fetch: Callable[[int], dict], length: int, most_pages: int) -> tuple[list[dict], int | None, int, bool]:
    """(rows, stated total, pages fetched, cap reached) of an inventory read page by page until it is empty or its total is reached."""
    rows: list[dict] = []
    total, pages = None, 0
    for pages in range(1, most_pages + 1):
        start = (pages - 1) * length
        payload = fetch(start)
        own = payload.get("data") if isinstance(payload, dict) else None
        if not isinstance(own, list):
            return rows, total, pages, False
        if total is None:
            stated = (payload.get("recordsFiltered"), payload.get("recordsTotal"))
            total = next((int(x) for x in stated if str(x or "").strip().isdigit() and int(x)), None)
        rows += [r for r in own if isinstance(r, dict) and any(str(r.get(k) or "").strip() for k in ("titre", "these"))]
        if not own or total is not None and start + len(own) >= total:
            return rows, total, pages, False
    return rows, total, pages, total is None or len(rows) < total


@dataclass
class Kind:
    """A list of one kind: its first page, and where its inventory is read if the pages link to no record."""

    name: str
    seed: str
    inventory: Callable[[int], dict] | None = None
    detail_base: str = ""


@dataclass
class Discovery:
    links: DataFrame  # LINKS, every url once, with the kind that owns it
    audit: DataFrame  # kind, pages, urls, duplicates, results, capped
    errors: list[str] = field(default_factory=list)


def discovered(spark: SparkSession, kinds: list[Kind], fetch: Fetcher, *, most_pages: int = 50, length: int = 25, delay: float = 0.0) -> Discovery:
    """Record urls of all kinds, breadth first; the first kind that lists a url owns it."""
    nothing = spark.createDataFrame([], "url string, payload string")
    found, audits, errors = [], [], []
    for order, kind in enumerate(kinds):
        level, seen, links, results, capped = [kind.seed], {kind.seed}, [], None, False
        fetched = 0
        while level:
            level, left = level[: most_pages - fetched], level[most_pages - fetched :]
            capped = capped or bool(left)
            if not level:
                break
            at = {u: fetched + i for i, u in enumerate(level)}
            pages = cut(fetch_missing(spark.createDataFrame([(u,) for u in level], "url string"), nothing, fetch, delay=delay))
            fetched += len(level)
            held = pages.filter("error IS NULL")
            errors += [f"{r['url']}: {r['error']}" for r in pages.filter("error IS NOT NULL").collect()]
            facts = sorted(X.list_facts(held, "url", "payload").collect(), key=lambda r: at[r["page_url"]])
            errors += [f"{r['page_url']}: {r['state']}" for r in facts if r["state"] != "record"]
            results = next((r["results"] for r in facts if results is None and r["results"] is not None), results)
            number = F.element_at(F.create_map(*[F.lit(x) for pair in at.items() for x in pair]), F.col("page_url"))
            good = held.join(X.list_facts(held, "url", "payload").filter("state = 'record'").select(F.col("page_url").alias("url")), "url", "left_semi")
            links.append(X.link_rows(good, "url", "payload").select(F.col("link").alias("url"), F.lit(kind.name).alias("kind"), F.lit(order).alias("kind_order"), number.alias("page"), "position", F.lit(None).cast("string").alias("row")))
            ahead = list(dict.fromkeys(u for r in facts if r["state"] == "record" for u in r["next_links"] if u not in seen))
            seen |= set(ahead)
            level = ahead
        own = spark.createDataFrame([], LINKS)
        for df in links:
            own = own.unionByName(df)
        own = cut(own)
        if kind.inventory is not None and own.isEmpty():
            rows, total, pages, cap = offset_pages(kind.inventory, length, most_pages)
            results, fetched, capped = total if results is None else results, fetched + pages, capped or cap
            own = spark.createDataFrame([(kind.detail_base + str(r.get("crypt") or r.get("id")), kind.name, order, 0, i, json.dumps({"row": r}, ensure_ascii=False)) for i, r in enumerate(rows)], LINKS)
        found.append(own)
        audits.append((kind.name, order, fetched, results, capped))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    owned = cut(first_owner(every))
    pages_of = spark.createDataFrame(audits, "kind string, kind_order int, pages int, results int, capped boolean")
    listed = every.groupBy("kind").agg(F.countDistinct("url").alias("urls"))
    kept = owned.groupBy("kind").agg(F.count("*").alias("own"))
    audit = pages_of.join(listed, "kind", "left").join(kept, "kind", "left").select("kind", "pages", F.coalesce("urls", F.lit(0)).alias("urls"), (F.coalesce("urls", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("duplicates"), "results", "capped")
    return Discovery(owned, audit, errors)


class PortalAdapter(SourceAdapter):
    """A public portal: cards of list pages or a sitemap, then details with the language asked for."""

    def __init__(self, definition: SourceDefinition, pages: DataFrame, fetch: Fetcher, *, sitemap: DataFrame | None = None, host: str = "", keep: tuple[str, ...] = ("/Offres/Doctorant/", "/Offres/CDD/"), most: int | None = None, delay: float = 0.0):
        self.definition, self.pages, self.fetch, self.sitemap, self.host, self.keep, self.most, self.delay = definition, pages, fetch, sitemap, host, keep, most, delay

    def urls(self, spark: SparkSession) -> DataFrame:
        """(url, position): of the sitemap if there is one, else of the cards of the list pages (url, html)."""
        if self.sitemap is not None:
            return X.sitemap_urls(self.sitemap, "payload", self.host, self.keep)
        cards = X.list_rows(self.pages)
        return cards.groupBy("url").agg(F.min(F.struct("page_url", "position")).alias("at")).select("url", F.row_number().over(_everything("at")).alias("position"))

    def payloads(self, urls: DataFrame) -> DataFrame:
        nothing = urls.sparkSession.createDataFrame([], "url string, payload string")
        asked = urls.select(with_language(F.col("url")).alias("url"), "position")
        return fetch_missing(asked, nothing, self.fetch, delay=self.delay, most=self.most)

    def records(self, payloads: DataFrame) -> DataFrame:
        rows = X.detail_rows(payloads.filter("error IS NULL"), "url", "payload")
        return rows.select(F.regexp_replace("page_url", r"[?]lang=FR$", "").alias("url"), *[c for c in rows.columns if c != "page_url"])


def _everything(*order: str) -> WindowSpec:
    return Window.orderBy(*order)  # over urls of list pages, of which there are few


class MemberAdapter(SourceAdapter):
    """A members' portal: lists of several kinds, inventories as a fallback, pages or JSON rows as details."""

    def __init__(self, definition: SourceDefinition, kinds: list[Kind], fetch: Fetcher, *, most_pages: int = 50, most: int | None = None, delay: float = 0.0):
        self.definition, self.kinds, self.fetch, self.most_pages, self.most, self.delay = definition, kinds, fetch, most_pages, most, delay
        self.discovery: Discovery | None = None

    def urls(self, spark: SparkSession) -> DataFrame:
        self.discovery = discovered(spark, self.kinds, self.fetch, most_pages=self.most_pages, delay=self.delay)
        return self.discovery.links

    def payloads(self, urls: DataFrame) -> DataFrame:
        held = urls.filter("row IS NOT NULL").select("url", F.col("row").alias("payload"))
        pages = fetch_missing(urls.select("url", "position"), held, self.fetch, delay=self.delay, most=self.most)
        return pages.join(urls.select("url", "kind"), "url", "left")

    def records(self, payloads: DataFrame) -> DataFrame:
        return X.member_rows(payloads.filter("error IS NULL"), default_kind=self.kinds[0].name)


def raw_pages(payloads: DataFrame, sink: VersionedTable, now: datetime) -> int:
    """Appends what was fetched to the table of raw pages."""
    return sink.append(payloads.filter("error IS NULL").select("url", "payload", F.lit(now).alias("fetched_at")))


def ingested(spark: SparkSession, adapter: SourceAdapter, log: RunLog, offers: VersionedTable, snapshots: VersionedTable, pages: VersionedTable, now: datetime, *, profile: str = "all", complete: bool = False) -> tuple[int, str]:
    """One run of a source: discover, fetch, keep the raw pages, read records, append snapshots, merge the state, mark what is gone.

    (run id, quality). The run is closed whatever happens. Only a complete inventory, without errors of list pages and not
    cut off at the cap, marks rows missing.
    """
    run, counters, status = log.start(profile, adapter.definition.name, "crawl", now), RunCounters(), "error"
    try:
        urls = cut(adapter.urls(spark))
        counters.offers_discovered = urls.select("url").distinct().count()
        payloads = cut(adapter.payloads(urls))
        raw_pages(payloads, pages, now)
        rows = adapter.records(payloads).withColumn("source", F.lit(adapter.definition.name))
        hashes = payloads.select(F.regexp_replace("url", r"[?]lang=FR$", "").alias("url"), F.sha2("payload", 256).alias("content_hash"))
        good = cut(rows.filter("state = 'record'").join(hashes, "url", "left"))
        counters.offers_fetched, total = good.count(), payloads.count()
        counters.errors_count = total - counters.offers_fetched
        snapshots.append(good.select("url", "content_hash", F.lit(now).alias("fetched_at"), F.lit(run).alias("run_id")))
        fresh = good.drop("state").withColumns({"first_seen_at": F.lit(now), "last_seen_at": F.lit(now), "last_seen_status": F.lit("seen")})
        held = offers.read()
        merged = fresh if held is None else merge_by_key(held, fresh, "url", keep=["first_seen_at"])
        discovery = getattr(adapter, "discovery", None)
        whole = complete and not (discovery is not None and (discovery.errors or discovery.audit.filter("capped").count()))
        within = (F.col("source") == adapter.definition.name) & (F.col("last_seen_status") == "seen")
        offers.write(mark_missing(merged, urls, "url", within=within, now=F.lit(now), complete=whole))
        counters.pages_fetched = total if discovery is None else total + (discovery.audit.agg(F.sum("pages")).first()[0] or 0)
        status = run_quality(counters, 0.5)
    finally:
        log.finish(run, counters, status, now)
    return run, status
