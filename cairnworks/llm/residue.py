"""Template residue, filler and error-page text in place of real content.

Placeholder rules find unfilled template fields and stand-ins for values still to be entered. For messages, every
line and title is masked and grouped by its digest over all pages. A group is a message when it recurs widely, in
several sources, on pages without any record; a group that recurs less clearly is one when a phrase of messages
is in it. A phrase in a line that does not recur is no message. A page is a message or filler when, link text aside,
each of its lines is one, or is made of filler words.

Defined cases: null keys and fields are left out; empty fields are no case; repeated keys give one row; an
empty table gives no rows; other columns are ignored; fields are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.pages import Lexicon, Page, learned_lexicon, line_digest, read_page
from cairnworks.llm.textforms import canonical
from cairnworks.runtime import spread

_FIELD = r"[A-Za-zÀ-ÿ]\w*(?:[._-]\w+)+"  # a name of parts: nom_labo, offer.location
_CAPS = r"[A-ZÀ-Ý]{2,}(?:[_. ][A-ZÀ-Ý]+)*"
_TO_FILL = r"\s*(?i:[àa] (?:compléter|completer|préciser|preciser|renseigner|définir|remplir))\b"
PLACEHOLDERS = re.compile(
    rf"\{{\{{[^{{}}\n]+\}}\}}|\$\{{[^{{}}\n]+\}}|#\{{[^{{}}\n]+\}}|\{{%[^%\n]+%\}}|<%[^%\n]+%>|\[\[[^\[\]\n]+\]\]|##[^#\n]+##|@@[^@\n]+@@"
    rf"|\{{(?:{_FIELD}|{_CAPS}|[a-zà-ÿ]{{3,}})\}}|\[(?:{_FIELD}|[A-ZÀ-Ý]{{4,}}(?:[_ ][A-ZÀ-Ý]+)*|employeur|employer)\]|<(?:{_FIELD}|[A-ZÀ-Ý]{{4,}}(?:[_ ][A-ZÀ-Ý]+)*|employeur|employer)>"
    rf"|(?<![\w%])%(?:{_FIELD}|[A-ZÀ-Ý]{{3,}}(?:[_ ][A-ZÀ-Ý]+)*|[a-zà-ÿ]{{4,}})%|(?<!\w)__[A-Za-zÀ-ÿ][\w. À-ÿ]*?__(?!\w)|(?<![\w$])\$(?:{_FIELD}|[A-ZÀ-Ý]{{3,}}(?:[_ ][A-ZÀ-Ý]+)*|[a-z]{{4,}})\b"
    rf"|\[object Object\]|#REF!|#N/A|#VALUE!|#NAME\?|#DIV/0!|(?<!\w)X{{4,}}(?!\w)|\.{{5,}}\s*\(|[(<\[{{%$#_]{_TO_FILL}"
    r"|\((?:compléter|completer|to be completed|to complete)\)|\[(?:insert|insérer|insérez)[^\]\n]*\]|<(?:insert|insérer|insérez)[^>\n]*>"
)
# a stand-in as the whole value of a fact, or in the place of a name
STANDINS = r"(?:undefined|null|NaN|None|TBD|TBC|TBA|TODO|N/C|(?i:à (?:renseigner|compléter|préciser|définir))|to be (?:defined|completed|announced|confirmed)|\?{3,}|_{4,}|\.{4,})"
_WHOLE_VALUE = re.compile(rf"(?:^|: )\s*{STANDINS}\s*(?:$| - |\n| : )", re.M)
_IN_PLACE = re.compile(rf"(?m:(?:^| )(?:undefined|NaN|TBD|TBC|TODO|(?i:à renseigner))(?: - | : |$))|(?:l'équipe|the|du|de la|au|chez|at) {STANDINS} (?:dès que|team|soon|as soon)")
FILLER_WORDS = {
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor", "incididunt", "ut", "labore", "et", "dolore", "magna",
    "aliqua", "enim", "ad", "minim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "laboris", "nisi", "aliquip", "ex", "ea", "commodo", "consequat", "duis", "aute",
    "irure", "in", "reprehenderit", "voluptate", "velit", "esse", "cillum", "eu", "fugiat", "nulla", "pariatur", "test", "tests", "bla", "azerty", "qwerty", "asdf", "foo", "bar", "blah", "xxx", "essai",
}
_LATIN = {"lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "eiusmod", "nostrud", "ullamco", "laboris", "veniam", "aliquip", "commodo", "dolore", "magna", "bla", "blah", "test", "azerty", "qwerty", "asdf"}
FILLER_LINES = re.compile(
    r"sample (?:text|title)|texte? (?:de remplissage|d'exemple|factice)|paragraphe d'exemple|exemple de texte|\bà saisir\b|^insérez ici|^insert (?:your )?(?:text|title|content|description)|placeholder|ne pas publier|do not publish|"
    r"sans titre|^untitled|^new (?:page|post|document)|^nouve(?:au|lle) (?:poste|page|offre|document)\b.*(?:copie|sans titre|\(\d+\))|dummy text|texte à (?:venir|remplacer)|contenu à venir|coming soon|your text here",
    re.I,
)
MESSAGES = re.compile(
    r"\b(?:4\d\d|5\d\d)\b.{0,12}(?:page|not found|forbidden|unauthori|service|error|erreur|bad|gateway|introuvable|interdit|unavailable|timeout)|page (?:introuvable|non trouvée|not found)|page demandée n'existe|page (?:you|that).{0,30}(?:not exist|not be found|looking for)|adresse saisie|"
    r"service (?:temporarily )?unavailable|temporarily unable to handle|retry after|bad gateway|gateway time-?out|upstream (?:service|server)|internal server error|erreur (?:interne|inattendue|serveur|\d{3})|code incident|quelque chose n'a pas fonctionné|something went wrong|^oups\b|^oops\b|réessayez|try again|"
    r"(?:offre|annonce|position|vacancy|job|poste|page) (?:retirée?|archivée?|indisponible|expirée?|closed|removed|filled|no longer|supprimée?|clôturée?|expired|unavailable|withdrawn|pourvue?)|a expiré|has expired|n'est plus (?:en ligne|disponible|publiée|ouverte)|no longer (?:open|available|online|accept|publish)|has been (?:filled|removed|withdrawn)|"
    r"pu être pourvue|recrutement correspondant est clos|annonce a été supprimé|(?:accès|access) (?:refusé|denied|interdit|restreint)|droits nécessaires|not authori[sz]ed|permission|forbidden|identifiant de requête|session (?:a |has |est )?expiré|session (?:has )?expired|vous identifier à nouveau|log ?in again|please (?:sign|log) in|"
    r"(?:enable|activez|activer|active) (?:java)?scripts?|(?:activez|enable) (?:javascript|les cookies|cookies)|javascript (?:requis|required|désactivé|disabled|is (?:disabled|required))|nécessite javascript|requires javascript|need to enable|scripts? (?:désactivés|disabled)|en charge les scripts|"
    r"vérification (?:en cours|de votre navigateur)|just a moment|checking (?:that|your|the)|un instant|ray [0-9a-f]{6,}|maintenance|fermé pour|sqlstate|database (?:connection|error)|connexion à la base|could not connect|too many requests|trop de requêtes|captcha|are you (?:a )?human|êtes-vous un robot|^loading\b|^chargement",
    re.I,
)
# a word of each of the phrases above, so that most lines need no search
_MESSAGE_HINTS = (
    "4", "5", "page", "adresse", "unavailable", "unable", "retry", "gateway", "upstream", "error", "erreur", "incident", "quelque", "wrong", "oups", "oops", "réessay", "again", "retiré", "archivé", "indisponible", "expiré",
    "closed", "removed", "filled", "no longer", "supprimé", "clôturé", "expired", "withdrawn", "pourvu", "n'est plus", "clos", "accès", "access", "droits", "authori", "permission", "forbidden", "identifi", "session", "please",
    "script", "cookies", "enable", "vérification", "moment", "checking", "instant", "ray ", "maintenance", "fermé", "sqlstate", "database", "connexion", "connect", "requests", "requêtes", "captcha", "human", "robot", "loading", "chargement",
)
_WORDS = re.compile(r"[^\W\d_]+")


# every match of PLACEHOLDERS holds one of these, but for a single ( or _ before _TO_FILL, which has its own pattern
_OPENERS = ("{", "[", "<", "%", "$", "#", "__", "@@", "XXXX", ".....", "(compl", "(to ")
_BARE_TO_FILL = re.compile(rf"[(_]{_TO_FILL}")
# every match of _WHOLE_VALUE and _IN_PLACE holds one of these, the second ones in lower case; those end before a letter with a third case form (i, s)
_STANDIN_HINTS = ("undefined", "null", "NaN", "None", "TBD", "TBC", "TBA", "TODO", "N/C", "to be ", "???", "____", "....")
_LOW_STANDIN_HINTS = ("à ren", "à compl", "à préc", "à déf")


def has_placeholder(text: str) -> bool:
    if any(x in text for x in _OPENERS) and PLACEHOLDERS.search(text):
        return True
    if ("(" in text or "_" in text) and _BARE_TO_FILL.search(text):
        return True
    low = text.lower()
    return (any(x in text for x in _STANDIN_HINTS) or any(x in low for x in _LOW_STANDIN_HINTS)) and bool(_WHOLE_VALUE.search(text) or _IN_PLACE.search(text))


@lru_cache(maxsize=50_000)
def is_filler(line: str) -> bool:
    """Whether most words are of filler texts."""
    found = [w.casefold() for w in _WORDS.findall(line)]
    known = sum(w in FILLER_WORDS for w in found)
    return bool(found) and known >= 0.8 * len(found) and any(w in _LATIN for w in found)


@lru_cache(maxsize=50_000)
def has_message_phrase(line: str) -> bool:
    """Whether a line has a phrase of messages or of texts to be replaced; it is a message only if it recurs as one."""
    low = line.lower()
    return any(x in low for x in _MESSAGE_HINTS) and bool(MESSAGES.search(line)) or bool(FILLER_LINES.search(line))


def is_message(line: str, lexicon: Lexicon) -> bool:
    d = line_digest(line)
    return d in lexicon.messages or d in lexicon.titles


def holds_no_record(page: Page, lexicon: Lexicon) -> bool:
    """Whether the page has a message or filler where the record should stand."""
    own = [page.lines[i] for i, k in enumerate(page.kinds) if k in ("plain", "open", "sentence") and (page.heading is None or i > page.heading)]
    if not own:
        return not page.structured and page.heading is not None and (is_message(page.lines[page.heading], lexicon) or is_filler(page.lines[page.heading]))
    if page.structured:
        return "fact" not in page.kinds and all(is_filler(x) for x in own)
    wrong = sum(len(x) for x in own if is_filler(x) or is_message(x, lexicon))
    return wrong >= 0.5 * sum(map(len, own))


def title_residue(title: str, lexicon: Lexicon) -> bool:
    return has_placeholder(title.strip()) or is_filler(title.strip()) or is_message(canonical(title), lexicon)


def page_lexicon(pages: DataFrame, title: str, raw: str, source: str) -> Lexicon:
    return learned_lexicon(pages, title, raw, source, has_message_phrase)


def _residue_batches(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, title, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if title and title.strip() and title_residue(title, lexicon):
                    rows.append((key, "title"))
                if raw and raw.strip() and (has_placeholder(raw) or holds_no_record(read_page(title, raw, lexicon), lexicon)):
                    rows.append((key, "raw_text"))
            cols = list(zip(*rows)) if rows else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "field_name"])

    return run


def residue_fields(pages: DataFrame, key: str, title: str, raw: str, source: str) -> DataFrame:
    """(key, field_name) of the fields without real content."""
    lexicon = page_lexicon(pages, title, raw, source)
    texts = pages.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(raw).alias("raw")).filter("key IS NOT NULL")
    return spread(texts).mapInArrow(_residue_batches(lexicon), "key string, field_name string").distinct()
