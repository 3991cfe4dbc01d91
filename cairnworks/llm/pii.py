"""Personal data in free text: bootstrapped contextual extraction.

Entities of rigid shape (emails, also disguised ones; phones; identity numbers of persons; street addresses) are the
seeds of their kinds, spans after a courtesy title and the words of email addresses those of person names. Each seed,
and each span of loose shape that is no seed (numbers of any form, written-out addresses, name-like spans), gives the
pattern of the two tokens on its left and that of the two on its right. Spark holds the graph of patterns and
instances (of a number its shape in digits and letters, of a name its words) and scores both in turns, for every kind:
a pattern by the share of known instances in its places, an instance by the patterns it is met in. Words that the
corpus writes in lower case too are known to be no names; names of which nothing is known say nothing of a pattern,
so that patterns hold in small corpora as well. Patterns of high score and enough support then find identifiers of
every kind never seen before: a span in such a place is a mention of the pattern's kind.

A pattern or word must occur at least MIN_SHARE times as often as there are spans, which bounds what is sent to the
executors by 1 / MIN_SHARE of each, whatever the size of the corpus.

Shapes are matched on the canonical form of the text with every position tied to the original, so a mention
comes out as it stands, full-width or with invisible characters inside.

Defined cases: null keys and null or empty fields are left out; mentions are distinct by key, field, kind and
text; an empty table gives no rows; other columns are ignored; texts are read whole. A single name after
`M.` is taken with it, as an initial.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.textforms import folded, mapping
from cairnworks.runtime import cut, spread

ROUNDS = 4
HIGH = 0.7
MIN_SUPPORT, MIN_SHARE = 3, 1e-5
COMMON = 0.1  # of its places in which a word stands in lower case, from which it is no name
DOUBTFUL = 0.2  # score of a word or shape up to which a span with it is no mention
KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

_AT = r"(?:\s?@\s?|\s?[\[({](?i:at|arobase|chez)[\])}]\s?|\s(?:AT|(?i:arobase))\s)"
_DOT = r"(?:\.|\s?[\[({](?i:dot|point)[\])}]\s?|\s(?:DOT|POINT)\s)"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9À-ÿ][\w.+-]*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w@])")
IDENTITY = re.compile(
    r"(?:[1-478] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}|\d{10}[A-Z]|\d{9}[A-Z]{2}|\d{2}[A-Z]{2}\d{5})(?![\w/])(?!\.\d)"
)
PHONE = re.compile(
    r"(?:(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?\d{2}){4}|0[1-9](?:[ .-]?\d{2}){4}|(?:\+|00)(?!33)[1-9]\d{0,2}(?:[ .-]?(?:\(\d+\)|\d{1,4})){2,5})(?![\w]|[.,-]\d| \d{2}\b)"
)
_TOWN = r"(?:(?:Le|La|Les|Saint|Sainte) )?[A-ZÀ-Ý][A-Za-zÀ-ÿ'’]*(?:-[A-Za-zÀ-ÿ'’]+)*"
_NUMBER = r"\d{1,4}(?: ?(?:bis|ter|quater|[A-D](?=[ ,])))?"
_WAY_FR = r"(?:rue|avenue|av\.|boulevard|bd|bld|allée|impasse|chemin|cours|quai|place|passage|route|square|sentier|faubourg|esplanade|promenade|montée|ruelle|voie|traverse|venelle|cité|résidence|parvis|rond-point)"
_WAY_EN = r"(?:Street|Road|Lane|Row|Avenue|Drive|Square|Court|Close|Way|Place|Crescent|Terrace|Gardens|Hill|Walk|Mews|Boulevard|Grove|Park|Yard|Quay|Wharf|Alley|St|Rd|Ave)"
ADDRESS = re.compile(
    rf"{_NUMBER},? {_WAY_FR}\b[^\n,;():]+?(?:,? (?:b[âa]t(?:\.|iment)?|esc\.|étage|porte|bureau) ?\w{{1,4}})?(?:,| -| –)? ?\d{{5}} {_TOWN}"
    rf"|{_NUMBER},? (?:[A-ZÀ-Ý][\w'’-]* ){{1,3}}{_WAY_EN}\b(?:, (?:flat|apt|unit|floor) \w{{1,4}})?,? (?:\d{{5}} )?{_TOWN}"
)
_EMAIL_HINTS = ("@", "arobase", "(at)", "[at]", "{at}", "(chez", "[chez", "{chez")  # one of them, or " AT ", is in every match of EMAIL, in lower case
# spans of loose shape: numbers of at least five digits, and a house number, words, a postal code and a town
LOOSE_NUMBER = re.compile(r"\+?[A-Z\d](?:[ ./-]?[A-Z\d]){4,24}(?![\w/])(?!\.\d)")
LOOSE_ADDRESS = re.compile(rf"{_NUMBER},? (?:(?!\d)[\w'’-]+,? ){{1,10}}?(?:- |– )?\d{{5}} {_TOWN}")
_LOOSE_DIGIT = re.compile(r"\d(?:(?=[A-Z\d ./-]{4})|(?=\d{0,3}[ ,][^\n]*\d{5} ))")  # where a loose number or address can begin
_START = re.compile(r"\+?\d+")
_NUMBERED = (("street_address", ADDRESS, re.compile(r"[\w.,/-]$")), ("identity_number", IDENTITY, re.compile(r"[\w./+-]$")), ("phone", PHONE, re.compile(r"[\w.,/+-]$|\d $")))

TITLES = r"(?:M\.|MM\.|Mr\.?|Mrs\.?|Ms\.?|Mme|Mlle|Monsieur|Madame|Mademoiselle|Dr\.?|Docteure?|Doctor|Pr\.?|Prof\.?|Professeure?|Professor)"
_NOT = r"(?!(?:Mr|Mrs|Ms|Mme|Mlle|Monsieur|Madame|Mademoiselle|Dr|Docteur|Docteure|Doctor|Pr|Prof|Professeur|Professeure|Professor)\b)"
_GIVEN = rf"{_NOT}[A-ZÀ-Ý][a-zà-ÿ]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)*"
_CAPS = r"[A-ZÀ-Ý]{2,}(?:-[A-ZÀ-Ý]{2,})*"
_INITIAL = r"[A-ZÀ-Ý]\.(?:-?[A-ZÀ-Ý]\.)?"
NAME = re.compile(rf"(?:{_INITIAL} (?:{_CAPS}|{_GIVEN})|{_GIVEN} (?:{_CAPS}|{_GIVEN})|{_CAPS} {_GIVEN})(?![\w'’-])")
_CAPITAL = re.compile(r"(?<![\w.'’-])[A-ZÀ-Ý](?=[\w.'’-]* [A-ZÀ-Ý])")  # where NAME can begin
REACH = 40  # characters before a span that _NAMED_AFTER and _TITLED can cover at most
_TITLED = re.compile(rf"(?<!\w){TITLES} $")
_NAMED_AFTER = re.compile(
    r"(?:\b(?:rue|avenue|boulevard|place|cours|quai|laboratoire|labo|centre|center|institut|institute|école|school|lycée|université|university|fondation|foundation|prix|prize|award|salle|room|amphi(?:théâtre)?|bâtiment|building|"
    r"méthode|method|test|algorithme|algorithm|théorème|theorem|modèle|model|loi|law|équation|equation|transformée|noyau|kernel|indice|index|chaire|chair)(?: (?:de|du|d'|of|the))? ?)$",
    re.I,
)
_TOKEN = re.compile(r"<\w+>|\w+|[^\w\s]")


@lru_cache(maxsize=1)
def _plain() -> tuple[re.Pattern, dict[str, str], set[str], set[str]]:
    table, spaces, hidden = mapping()
    plain = "".join(c for c in map(chr, (*range(0x20, 0x7F), *range(0xC0, 0x180))) if c not in table)
    return re.compile(f"[^\n{re.escape(plain)}]"), table, set(spaces) - {"\n"}, set(hidden)


def aligned(text: str) -> tuple[str, tuple[list[int], list[int]] | None]:
    """The text with look-alike, wide, invisible and decomposed characters resolved, and where each character begins and ends in the original."""
    if text.isascii():
        return text, None
    odd, table, spaces, hidden = _plain()
    out, starts, ends, last, moved = [], [], [], 0, False
    for m in odd.finditer(text):
        i, c = m.start(), m.group()
        mark = unicodedata.combining(c)
        x = "" if c in hidden else " " if c in spaces else table.get(c, c)
        if x == c and not mark:
            continue
        if i > last:
            out.append(text[last:i])
            starts += range(last, i)
            ends += range(last + 1, i + 1)
        last = i + 1
        if mark and out and len(whole := unicodedata.normalize("NFC", out[-1][-1] + c)) == 1:
            out[-1] = out[-1][:-1] + whole
            ends[-1] = last
        elif x:
            out.append(x)
            starts += [i] * len(x)
            ends += [last] * len(x)
            continue
        moved = True
    if not out and not moved:
        return text, None
    plain = "".join([*out, text[last:]])
    starts += range(last, len(text))
    ends += range(last + 1, len(text) + 1)
    return plain, (starts, ends) if moved or len(plain) != len(text) else None


_NEVER = tuple("%:;!?<>=\n\"'&#*@[]{}|_")  # after fewer than nine digits, none of the shapes goes on


def _near_hints(plain: str) -> list[tuple[int, int]]:
    """The lines around every sign of an email, with the one before and the one after, apart from each other."""
    low = plain.lower()
    if len(low) != len(plain):  # some letters have a longer lower case
        return [(0, len(plain))]
    at = {i for x in _EMAIL_HINTS if x in low for i in _found(low, x)} | set(_found(plain, " AT "))
    out: list[tuple[int, int]] = []
    for i in sorted(at):
        lo = plain.rfind("\n", 0, max(plain.rfind("\n", 0, i), 0)) + 1
        hi = plain.find("\n", i)
        hi = plain.find("\n", hi + 1) if hi >= 0 else -1
        hi = hi if hi >= 0 else len(plain)
        if out and lo <= out[-1][1]:
            lo, hi = out[-1][0], max(hi, out[-1][1])
            out.pop()
        out.append((lo, hi))
    return out


def _found(text: str, part: str) -> Iterator[int]:
    i = text.find(part)
    while i >= 0:
        yield i
        i = text.find(part, i + 1)


def shaped_entities(plain: str) -> list[tuple[int, int, str]]:
    """Entities of rigid shape, without overlaps, in order."""
    taken: list[tuple[int, int, str]] = []

    def free(lo: int, hi: int) -> bool:
        return all(hi <= a or lo >= b for a, b, _ in taken)

    for lo, hi in _near_hints(plain):
        taken += [(*m.span(), "email") for m in EMAIL.finditer(plain, lo, hi)]
    end = 0
    for start in _START.finditer(plain):
        if (lo := start.start()) < end:
            continue
        after, digits = plain[start.end() : start.end() + 2], start.end() - lo
        if digits < 9 and (after[:1] in _NEVER or digits > 4 and after[:1] == " " and "a" <= after[1:] <= "z"):
            continue  # neither a house number nor the beginning of a long number
        before = plain[max(0, lo - 2) : lo]
        for kind, pattern, not_after in _NUMBERED:
            if (m := pattern.match(plain, lo)) and not not_after.search(before) and free(*m.span()):
                taken.append((*m.span(), kind))
                end = m.end()
                break
    return sorted(taken)


def typed_text(plain: str, found: list[tuple[int, int, str]]) -> str:
    """The text with entities as typed tokens."""
    out, last = [], 0
    for lo, hi, kind in found:
        out += [plain[last:lo], f"<{kind}>"]
        last = hi
    return "".join([*out, plain[last:]])


def context(typed: str, lo: int, hi: int) -> tuple[str, str]:
    """The patterns of the two tokens on the left and on the right of a span, within its line; numbers as #."""
    start, end = typed.rfind("\n", 0, lo) + 1, typed.find("\n", hi)
    end = end if end >= 0 else len(typed)
    width = 60
    while len(left := _TOKEN.findall(typed[max(start, lo - width) : lo].casefold())) < 3 and lo - width > start:
        width *= 4
    width = 60
    while len(right := _TOKEN.findall(typed[hi : min(end, hi + width)].casefold())) < 3 and hi + width < end:
        width *= 4
    mask = lambda tokens: " ".join("#" if t.isdigit() else t for t in tokens)
    return "L " + mask(["^", *left][-2:]), "R " + mask([*right, "$"][:2])


def name_spans(typed: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, after a courtesy title) of all name-like spans; spans may overlap."""
    for c in _CAPITAL.finditer(typed):
        if not (m := NAME.match(typed, lo := c.start())):
            continue
        before = typed[max(typed.rfind("\n", 0, lo) + 1, lo - REACH) : lo]
        if not _NAMED_AFTER.search(before):
            yield lo, m.end(), bool(_TITLED.search(before))


def loose_spans(typed: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, instance) of numbers and written-out addresses that are no entities of rigid shape."""
    end = 0
    for c in _LOOSE_DIGIT.finditer(typed):
        lo = c.start()
        if lo < end:
            continue
        while lo and "A" <= typed[lo - 1] <= "Z":
            lo -= 1
        if lo and typed[lo - 1] == "+":
            lo -= 1
        if lo and (typed[lo - 1].isalnum() or typed[lo - 1] in "_.,/+<-"):
            continue
        if m := LOOSE_ADDRESS.match(typed, lo):
            end = m.end()
            yield lo, end, "a"
        elif (m := LOOSE_NUMBER.match(typed, lo)) and sum(x.isdigit() for x in m.group()) >= 5:
            end = m.end()
            yield lo, end, "d " + shape_of(m.group())


def shape_of(number: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", number))


def name_words(span: str) -> list[str]:
    """The words of a name, without accents and initials."""
    return [w for w in re.split(r"[ -]", folded(span)) if w and not w.endswith(".")]


def typed_spans(found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, tuple[int, int, str]]]:
    """Where the typed token of each entity stands, with the entity."""
    moved = 0
    for lo, hi, kind in found:
        yield lo + moved, lo + moved + len(kind) + 2, (lo, hi, kind)
        moved += len(kind) + 2 - (hi - lo)


def plain_place(at: int, placed: list[tuple[int, int, tuple[int, int, str]]]) -> int:
    """The place in the plain text of one in the typed text that is outside all typed tokens. placed: typed_spans."""
    before = [(hi, b) for _, hi, (_, b, _) in placed if hi <= at]
    return at if not before else before[-1][1] + at - before[-1][0]


_LOWER = re.compile(r"[a-zà-ÿ]{3,}")
_PARTS = re.compile(r"[^\w@.]+|\.$")


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, instance, seed, n): seed is the kind a rigid shape or a title gives, `other` for words in lower case, else null."""
    for batch in batches:
        counts: dict[tuple[str, str, str | None], int] = {}
        common: Counter[str] = Counter()

        def add(pattern: str, instance: str, seed: str | None, n: int = 1) -> None:
            counts[pattern, instance, seed] = counts.get((pattern, instance, seed), 0) + n

        for text in batch.column(0).to_pylist():
            plain, _ = aligned(text)
            found = shaped_entities(plain)
            typed = typed_text(plain, found)
            for lo, hi, (a, b, kind) in typed_spans(found):
                instance = "a" if kind == "street_address" else "@" if kind == "email" else "d " + shape_of(plain[a:b])
                for pattern in context(typed, lo, hi):
                    add(pattern, instance, kind)
                if kind == "email":
                    for w in re.findall(r"[^\W\d_]{3,}", folded(re.split(_AT, plain[a:b])[0])):
                        add("@", "n " + w, "person_name")
            for lo, hi, instance in loose_spans(typed):
                for pattern in context(typed, lo, hi):
                    add(pattern, instance, None)
            for lo, hi, titled in name_spans(typed):
                for pattern in context(typed, lo, hi):
                    for w in name_words(typed[lo:hi]):
                        add(pattern, "n " + w, "person_name" if titled else None)
            common.update(typed.split())
        for token, n in common.items():
            for w in _PARTS.split(token):
                if _LOWER.fullmatch(w):
                    add("lower", "n " + folded(w), "other", n)
        cols = list(zip(*counts)) if counts else [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(counts.values()), pa.int64())], names=["pattern", "instance", "seed", "n"])


@dataclass
class Patterns:
    """Trust in each kind by pattern, and instances that are met elsewhere: words that are no names, shapes of other numbers; bounded by 1 / MIN_SHARE."""

    trust: dict[str, dict[str, float]] = field(default_factory=dict)
    doubtful: set[str] = field(default_factory=set)

    def of(self, kind: str, left: str, right: str) -> tuple[float, float]:
        a, b = (self.trust.get(p, {}).get(kind, 0.0) for p in (left, right))
        return max(a, b), a + b


def scored_patterns(texts: DataFrame) -> Patterns:
    """Patterns of high score. texts: one string column."""
    counts = texts.mapInArrow(_edge_batches, "pattern string, instance string, seed string, n long").groupBy("pattern", "instance").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).alias(f"s_{k}") for k in (*KINDS, "other")]
    )
    is_name, inner = F.col("instance").startswith("n "), ~F.col("pattern").isin("lower", "@")
    spans = F.sum(F.when(inner, F.col("n")).otherwise(0))
    edges = cut(counts)
    names = edges.filter(is_name).groupBy("instance").agg(spans.alias("m"), F.sum("s_person_name").alias("seeds"), F.sum("s_other").alias("low")).filter("m > 0")
    common = F.col("low") >= COMMON * (F.col("low") + F.col("m"))
    # a number is as good as the share of its seeds, a name is known or common or says nothing
    start = names.select("instance", *[F.lit(0.0).alias(k) for k in KINDS if k != "person_name"], F.when((F.col("seeds") > 0) & ~common, 1.0).otherwise(0.0).alias("person_name"), ((F.col("seeds") > 0) | common).alias("known"), common.alias("fixed")).unionByName(
        edges.filter(~is_name).groupBy("instance").agg(*[(F.sum(f"s_{k}") / F.sum("n")).alias(k) for k in KINDS]).select("*", F.lit(True).alias("known"), F.lit(False).alias("fixed"))
    )
    edges = cut(edges.filter(inner).join(start.select("instance"), "instance", "left_semi").select("pattern", "instance", "n"))
    total = edges.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_SUPPORT, MIN_SHARE * total)
    known = cut(start)

    def scored() -> DataFrame:
        weight = F.when(F.col("known"), F.col("n")).otherwise(0)
        return edges.join(known, "instance").groupBy("pattern").agg(F.sum(weight).alias("support"), *[(F.sum(weight * F.col(k)) / F.greatest(F.sum(weight), F.lit(1))).alias(k) for k in KINDS])

    for _ in range(ROUNDS):
        # weak patterns tell nothing; an instance is as good as the trusted places it is met in
        sure = scored().select("pattern", *[F.when((F.col(k) >= 0.5) & (F.col("support") >= least), F.col(k)).otherwise(0.0).alias(f"t_{k}") for k in KINDS])
        met = edges.join(sure, "pattern").groupBy("instance").agg(*[(F.sum(F.col("n") * F.col(f"t_{k}")) / F.sum("n")).alias(f"m_{k}") for k in KINDS])
        score = lambda k: F.when(F.col("fixed"), F.col(k)).otherwise(F.greatest(k, F.coalesce(f"m_{k}", F.lit(0.0)))).alias(k)
        known = cut(known.join(met, "instance", "left").select("instance", *[score(k) for k in KINDS], (F.col("known") | (F.col("m_person_name") >= 0.5)).alias("known"), "fixed"))
    high = F.greatest(*KINDS) >= HIGH
    trust = {r["pattern"]: {k: r[k] for k in KINDS if r[k] >= HIGH} for r in scored().filter(high & (F.col("support") >= least)).collect()}
    doubtful = edges.groupBy("instance").agg(F.sum("n").alias("m")).filter(F.col("m") >= least).join(known.filter(F.greatest(*KINDS) <= DOUBTFUL), "instance").select("instance").collect()
    return Patterns(trust, {r["instance"] for r in doubtful})


def mentions(text: str, patterns: Patterns) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the original text, in order, without overlaps."""
    plain, at = aligned(text)
    found = shaped_entities(plain)
    typed = typed_text(plain, found)
    spans = []
    for lo, hi, titled in name_spans(typed):
        best, both = patterns.of("person_name", *context(typed, lo, hi))
        if titled or best >= HIGH and not any("n " + w in patterns.doubtful for w in name_words(typed[lo:hi])):
            spans.append((-both - 2 * titled, lo, hi, "person_name"))
    for lo, hi, instance in loose_spans(typed):
        kinds = ("street_address",) if instance == "a" else ("phone", "identity_number")
        left, _ = context(typed, lo, hi)  # what follows a number says little of its kind
        trust, kind = max((patterns.trust.get(left, {}).get(k, 0.0), k) for k in kinds)
        if trust >= HIGH and instance not in patterns.doubtful:
            spans.append((-trust, lo, hi, kind))
    taken: list[tuple[int, int, str]] = []
    for _, lo, hi, kind in sorted(spans):
        if all(hi <= a or lo >= b for a, b, _ in taken):
            taken.append((lo, hi, kind))
    placed = list(typed_spans(found))
    whole = sorted([*found, *((plain_place(lo, placed), plain_place(hi, placed), kind) for lo, hi, kind in taken)])
    return whole if at is None else [(at[0][lo], at[1][hi - 1], kind) for lo, hi, kind in whole]


def masked(text: str | None, patterns: Patterns) -> str | None:
    """The text with a typed placeholder in the place of each mention."""
    if not text:
        return text
    out, last = [], 0
    for lo, hi, kind in mentions(text, patterns):
        out += [text[last:lo], f"[{kind.upper()}]"]
        last = hi
    return "".join([*out, text[last:]])


def _fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    cols = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return rows.select(F.col(key).alias("key"), F.explode(cols).alias("x")).select("key", "x.field_name", "x.text").filter("key IS NOT NULL AND text IS NOT NULL AND text <> ''")


def personal_mentions(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, pii_kind, mention), distinct."""
    texts = spread(_fields(rows, key, fields))
    patterns = scored_patterns(texts.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for k, f, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out |= {(k, f, kind, text[lo:hi]) for lo, hi, kind in mentions(text, patterns)}
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "field_name", "pii_kind", "mention"])

    return texts.mapInArrow(run, "key string, field_name string, pii_kind string, mention string").distinct()


def masked_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, text) with typed placeholders for all mentions."""
    texts = spread(_fields(rows, key, fields))
    patterns = scored_patterns(texts.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.array([masked(t, patterns) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), done], names=["key", "field_name", "text"])

    return texts.mapInArrow(run, "key string, field_name string, text string")
