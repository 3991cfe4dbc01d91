"""Lines of a page, what the corpus says of each, and the body of the page by composite text density.

A page is text with one element per line. Two passes read every page whole:

1. `learned_lexicon` masks numbers, addresses and dates in every line and counts, by the digest of the masked
   line, the pages and sources that hold it and where it stands: before the heading of its page, among the
   facts, in sections of text, in sections of lists, on a page without facts and sections (a bare page). It
   counts the pairs of neighbouring words of all titles as well.
2. A recurring line that stands before headings, on bare pages beside others, or in several places of a record
   is link text: navigation, notices, banners, feet, heads of lists. One that keeps to one place is plain text of
   records. One that recurs on bare pages only is a message. A line that does not recur is link text as far as
   its words are pairs that recur in titles, as lists of other records consist of such. No wording is fixed.

`page_tree` builds the element tree of a page from this: the part before the heading and the record, each with
its runs of lines of one kind. The composite text density of a node is link-adjusted characters per element.
Of the two subtrees the one with the greater sum of child densities is the body; of its nodes those are kept whose
density reaches the least on the path to the root, or that of a line as short as the shortest label of a record.

What is kept of the first pass for the second is digests that at least MIN_SHARE of all pages hold, hence at most
lines-per-page / MIN_SHARE of them, whatever the size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.textforms import canonical
from cairnworks.runtime import spread

MIN_SHARE = 1e-4  # of all pages that a recurring line must be on, and at least MIN_PAGES
MIN_PAGES = 3
MIN_PHRASED = 2  # pages of a line or title with a phrase of messages
PAIR_SHARE = 2e-4  # of all titles that a recurring pair of words must be in
HEAD_SHARE = 0.1  # of its pages on which link text stands before the heading
SPREAD_SHARE = 0.1  # of its places in records that are not of the usual kind
BESIDE_SHARE = 0.02  # of its pages that are bare, for link text
BARE_SHARE = 0.8  # the same for a message, BARE_PHRASE if it has a phrase of messages
BARE_PHRASE = 0.2
PLAIN_SHARE = 0.9  # of its places that are within records, for plain text
BARE_TITLES, BARE_TITLE_SHARE = 5, 0.6
LINE, TITLE, PAIR = 0, 1, 2
PLACES = ("head", "facts", "text", "list", "bare")
STATISTICS = "kind int, digest long, s1 string, s2 string, pages long, head long, facts long, text long, list long, bare long, phrase long"

_EMAIL, _URL, _HEX = re.compile(r"\S+@\S+"), re.compile(r"\b(?:https?://|www\.)\S+"), re.compile(r"\b[0-9a-f]{8,}\b", re.I)
_MONTH = re.compile(r"\b(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|january|february|march|april|may|june|july|august|september|october|november|december)\b", re.I)
_NUMBER, _DIGIT = re.compile(r"\d+(?:[.,:/ -]\d+)*"), re.compile(r"\d")
# The format of a record: labels of its fact lines, headings of its sections of text and of lists, French and English.
LABELS = ("Lieu", "Unité", "Durée", "Niveau", "Type de contrat", "Contrat", "Salaire", "Référence", "Unit", "Length", "Degree", "Contract", "Place", "Salary", "Reference", "Location", "Duration")
TEXT_SECTIONS = {
    "présentation", "missions", "sujet de thèse", "description du sujet", "description", "contact", "activités", "contexte",
    "about the position", "topic", "duties", "context", "contacts", "contexte de travail", "informations complémentaires",
}
LIST_SECTIONS = {"compétences", "profil", "profil recherché", "skills", "profile", "requirements"}
_CONTACTS = {"contact", "contacts"}
SPARSEST = min(map(len, LABELS))
_FACT = re.compile(rf"^(?:{'|'.join(LABELS)}) ?: ?\S")
_BARS = re.compile(r"\s*[|/·•>]\s*|\s{2,}")
_BAR_SIGNS = ("|", "/", "·", "•", ">", "  ", "\t", "\xa0")  # one of them is in a row of parts
_SENTENCE = re.compile(r"[.!?…]$")
_WORD = re.compile(r"\w+|[^\w\s]")
_CAPITALS = re.compile(r"[^\W\d_a-zà-ÿ]{4,}$")
SHORT = 240  # characters up to which what is known of a line is kept in memory; longer ones are read anew, with the same result


def masked_line(line: str) -> str:
    """The line with addresses, dates and numbers masked, white space as one blank, in lower case."""
    if "@" in line:
        line = _EMAIL.sub("@", line)
    if "://" in line or "www." in line:
        line = _URL.sub("&", line)
    if _DIGIT.search(line):
        line = _NUMBER.sub("#", _MONTH.sub("#", _HEX.sub("#", line)))
    return " ".join(line.split()).casefold()


def _signed(d: int) -> int:
    return d - (1 << 64) if d >> 63 else d


def _digest(line: str) -> int:
    return _signed(xxhash.xxh64_intdigest(masked_line(line)))


_short_digest = lru_cache(maxsize=100_000)(_digest)


def line_digest(line: str) -> int:
    return _short_digest(line) if len(line) <= SHORT else _digest(line)


@lru_cache(maxsize=200_000)
def _pair_digest(before: str, word: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{before} {word}"))


def word_pairs(line: str) -> list[tuple[int, int]]:
    """(digest, characters of the second word) of neighbouring words; names in capitals are one word, the start is one too."""
    out, before = [], "^"
    for w in _WORD.findall(line):
        x = "¤" if _CAPITALS.match(w) else w.casefold()
        out.append((_pair_digest(before, x), len(w)))
        before = x
    return out


@dataclass
class Lexicon:
    """What the corpus statistics say; sizes are bounded by 1 / MIN_SHARE."""

    links: set[int] = field(default_factory=set)
    plain: set[int] = field(default_factory=set)
    messages: set[int] = field(default_factory=set)
    titles: set[int] = field(default_factory=set)  # that recur on bare pages
    pairs: set[int] = field(default_factory=set)  # of neighbouring words, that recur in titles


@dataclass
class Page:
    lines: list[str]
    kinds: list[str]  # blank, heading, fact, section, link, plain, open, sentence
    heading: int | None
    structured: bool


FACT, SECTION, CONTACT, LISTS, SENTENCE = 1, 2, 4, 8, 16
SURE = ("heading", "fact", "section", "plain")


def _traits(rough: str) -> tuple[str, int]:
    """A line in canonical form, and what its own form says."""
    line = canonical(rough)
    low = line.casefold()
    traits = (FACT if _FACT.match(line) else 0) | (SENTENCE if _SENTENCE.search(line) else 0)
    if low in TEXT_SECTIONS or low in LIST_SECTIONS:
        traits |= SECTION | (CONTACT if low in _CONTACTS else 0) | (LISTS if low in LIST_SECTIONS else 0)
    return line, traits


_short_traits = lru_cache(maxsize=200_000)(_traits)


def line_traits(rough: str) -> tuple[str, int]:
    return _short_traits(rough) if len(rough) <= SHORT else _traits(rough)


def _is_row_of_links(raw: str, lexicon: Lexicon) -> bool:
    """Whether most parts of a line between bars are known link text."""
    if not any(x in raw for x in _BAR_SIGNS):
        return False
    parts = [x for x in _BARS.split(raw.strip()) if x]
    return len(parts) > 1 and sum(line_digest(canonical(x)) in lexicon.links for x in parts) >= 0.7 * len(parts)


def _found_heading(lines: list[str], kinds: list[str], first: int) -> int:
    """The heading of a record whose title is not among its lines, above its first fact or section.

    It is what a line above repeats, as window titles and trails do; else the first line below link text or a trail, as
    lists of other records stand further down; else the last line above the record that is no link text.
    """
    trail = [" > " in x for x in lines[:first]]
    able = [i for i in range(first) if lines[i] and kinds[i] in ("open", "plain") and not trail[i]]
    repeated = (i for i in able if any(len(lines[j]) > len(lines[i]) and lines[i] in lines[j] for j in range(i)))
    below = (i for i in able if any(kinds[j] == "link" or trail[j] for j in range(i)))
    return next(repeated, next(below, able[-1] if able else first))


def read_page(title: str | None, raw: str, lexicon: Lexicon | None = None) -> Page:
    """The lines of a page with their kinds. Without a lexicon only the format of records is known."""
    rough = raw.split("\n")
    lines, traits = zip(*map(line_traits, rough))
    own = canonical(title or "")
    heading = next((i for i, x in enumerate(lines) if x and x == own), None)
    kinds = []
    for x, t, r in zip(lines, traits, rough):
        if not x:
            kinds.append("blank")
        elif t & FACT:
            kinds.append("fact")
        elif t & SECTION:
            kinds.append("section")
        elif lexicon is not None and ((d := line_digest(x)) in lexicon.links or _is_row_of_links(r, lexicon)):
            kinds.append("link")
        elif lexicon is not None and d in lexicon.plain:
            kinds.append("plain")
        else:
            kinds.append("sentence" if t & SENTENCE else "open")
    if heading is None:
        first = next((i for i, t in enumerate(traits) if t & FACT or t & (SECTION | CONTACT) == SECTION), None)
        heading = None if first is None else _found_heading(lines, kinds, first)
    for i, t in enumerate(traits):
        if kinds[i] == "section" and (heading is None and t & CONTACT or heading is not None and i < heading):
            kinds[i] = "link"  # an entry of a menu
    if heading is not None:
        kinds[heading] = "heading"
    return Page(list(lines), kinds, heading, any(k == "fact" or k == "section" and not t & CONTACT for k, t in zip(kinds, traits)))


# --- composite text density -------------------------------------------------------------------------------


@dataclass
class Node:
    """An element: its characters, those of link text, the elements in it, its lines, and the elements below it."""

    chars: int = 0
    links: float = 0.0
    tags: int = 0
    lines: list[int] = field(default_factory=list)
    kind: str = ""
    children: list["Node"] = field(default_factory=list)

    def add(self, child: "Node") -> None:
        self.children.append(child)
        self.chars, self.links, self.tags = self.chars + child.chars, self.links + child.links, self.tags + child.tags


def density(node: Node, body: Node) -> float:
    """Composite text density: characters per element, lowered by the share of link text."""
    if not node.tags or node.links >= node.chars:
        return 0.0
    plain = max(node.chars - node.links, 1)
    base = node.chars / plain * node.links + max(body.links, 1) / max(body.chars, 1) * node.chars + math.e
    return node.chars / node.tags * math.log(node.chars / max(node.links, 1)) / math.log(base) if node.chars > 1 else 1 / math.log(base)


def link_chars(line: str, kind: str, lexicon: Lexicon) -> float:
    """Characters of a line that are link text: all of known link text, of other lines those of words that recur in titles."""
    if kind == "link":
        return len(line)
    if kind != "open":
        return 0.0
    words = word_pairs(line)
    known = sum(n for d, n in words if d in lexicon.pairs)
    return len(line) * known / max(sum(n for _, n in words), 1)


def page_tree(page: Page, lexicon: Lexicon) -> tuple[Node, Node, Node]:
    """The root, the part before the heading, and the record; below these the runs of lines of one kind, those of mostly link text by themselves."""
    head, main = Node(), Node()
    at = [(i, link_chars(page.lines[i], k, lexicon)) for i, k in enumerate(page.kinds) if k != "blank"]

    def run_of(x: tuple[int, float]) -> tuple[bool, str, bool]:
        i, links = x
        return page.heading is not None and i < page.heading, "sure" if page.kinds[i] in SURE else page.kinds[i], links >= 0.5 * len(page.lines[i])

    for (part, kind, _), run in groupby(at, run_of):
        own = list(run)
        (head if part else main).add(Node(sum(len(page.lines[i]) for i, _ in own), sum(x for _, x in own), len(own), [i for i, _ in own], kind))
    root = Node()
    root.add(head)
    root.add(main)
    return root, head, main


def body_lines(page: Page, lexicon: Lexicon) -> list[int]:
    """Indices of the lines of the record itself."""
    root, head, main = page_tree(page, lexicon)
    best = max((main, head), key=lambda n: sum(density(c, root) for c in n.children))
    least = min(density(best, root), density(root, root), density(Node(SPARSEST, 0.0, 1), root))
    return sorted(i for c in best.children if c.kind == "sure" or c.kind != "link" and density(c, root) >= least for i in c.lines)


# --- corpus statistics ------------------------------------------------------------------------------------


def _places(page: Page, traits_of: list[int]) -> Iterator[tuple[int, str]]:
    """(line, place) of all lines but facts, section headings and the heading."""
    place = "bare" if not page.structured else "head" if page.heading is not None else ""
    for i, kind in enumerate(page.kinds):
        if kind == "heading":
            place = "facts" if page.structured else place
        elif kind == "section":
            place = "list" if traits_of[i] & LISTS else "text"
        elif kind not in ("blank", "fact"):
            yield i, place


def _statistics_batches(phrase):
    """Counts of one batch of pages, so that a line which many of them hold leaves the task once."""
    places = {n: i for i, n in enumerate(PLACES, 3)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, int], list] = {}  # least source, greatest source, pages, those of PLACES, phrase

            def count(kind: int, digest: int, source: str | None) -> list:
                row = counts.get((kind, digest))
                if row is None:
                    row = counts[kind, digest] = [source, source, 0, 0, 0, 0, 0, 0, 0]
                elif source is not None and source != row[0]:
                    row[0], row[1] = (source, source) if row[0] is None else (min(row[0], source), max(row[1], source))
                row[2] += 1
                return row

            for title, raw, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page, own = read_page(title, raw), canonical(title or "")
                known = own in page.lines if own else False
                if not known and page.heading is not None:  # a guessed heading says nothing of the lines above it
                    page.kinds = ["blank" if i < page.heading else k for i, k in enumerate(page.kinds)]
                seen: dict[int, tuple[set[str], str]] = {}
                for i, place in _places(page, [line_traits(x)[1] for x in page.lines]):
                    seen.setdefault(line_digest(page.lines[i]), (set(), page.lines[i]))[0].add(place)
                for d, (at, line) in seen.items():
                    row = count(LINE, d, source)
                    for place in at:
                        if place:
                            row[places[place]] += 1
                    row[8] = row[8] or int("bare" in at and phrase(line))
                if own:
                    row = count(TITLE, line_digest(own), source)
                    row[places["bare"]] += not page.structured
                    row[8] = row[8] or int(phrase(own))
                    if page.structured and known:  # the title stands above its record
                        for d in {d for d, _ in word_pairs(own)}:
                            count(PAIR, d, source)
            keys, rows = list(zip(*counts)) or [(), ()], list(zip(*counts.values())) or [()] * 9
            arrays = [pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int64()), *(pa.array(c, pa.string()) for c in rows[:2]), *(pa.array(c, pa.int64()) for c in rows[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "digest", "s1", "s2", "pages", *PLACES, "phrase"])

    return run


def learned_lexicon(pages: DataFrame, title: str, raw: str, source: str, phrase=lambda line: False) -> Lexicon:
    """Link text, plain text, messages, titles of bare pages and word pairs of titles, of the whole corpus.

    phrase: whether a line has a phrase of messages; it is asked for lines of bare pages and for titles, and decides on what recurs where the places alone do not.
    """
    texts = pages.select(F.col(title).alias("title"), F.col(raw).alias("raw"), F.col(source).alias("source")).filter("raw IS NOT NULL")
    texts = spread(texts)
    total = texts.count()
    share = math.ceil(MIN_SHARE * total)
    n, bare, line, phrased = F.col("pages"), F.col("bare"), F.col("kind") == LINE, F.col("phrase") > 0
    least = F.when(phrased & (F.col("kind") != PAIR), max(MIN_PHRASED, share)).when(F.col("kind") == PAIR, max(MIN_PAGES, math.ceil(PAIR_SHARE * total))).otherwise(max(MIN_PAGES, share))
    inside = F.col("facts") + F.col("text") + F.col("list")
    several = F.col("s1") != F.col("s2")
    scattered = (inside > 0) & (inside - F.greatest("facts", "text", "list") >= SPREAD_SHARE * inside)
    rows = (
        texts.mapInArrow(_statistics_batches(phrase), STATISTICS)
        .groupBy("kind", "digest")
        .agg(*[F.sum(c).alias(c) for c in ("pages", *PLACES)], F.max("phrase").alias("phrase"), F.min("s1").alias("s1"), F.max("s2").alias("s2"))
        .filter(n >= least)
        .withColumn("message", line & ((bare >= BARE_SHARE * n) & several | (bare >= BARE_PHRASE * n) & phrased))
        .withColumn("link", line & ~F.col("message") & ((F.col("head") >= HEAD_SHARE * n) | (bare >= BESIDE_SHARE * n) & (bare < BARE_SHARE * n) | scattered))
        .select(
            "digest", "message", "link", (line & ~F.col("message") & ~F.col("link") & (inside >= PLAIN_SHARE * n)).alias("plain"), (F.col("kind") == PAIR).alias("pair"),
            ((F.col("kind") == TITLE) & ((n >= BARE_TITLES) & (bare >= BARE_TITLE_SHARE * n) & several | phrased)).alias("title"),
        )
        .filter("message OR link OR plain OR pair OR title")
        .collect()
    )
    of = lambda name: {r["digest"] for r in rows if r[name]}
    return Lexicon(of("link"), of("plain"), of("message"), of("title"), of("pair"))
