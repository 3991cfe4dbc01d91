"""One consistent form for text that looks the same: a compiled longest-match transducer.

The mapping is computed once from rules of the Unicode database (widths, presentation forms, spaces,
invisible characters) and a fixed list of look-alike letters, checked for conflicts, and compiled to one
alternation. A pass over a text takes, at each place, the longest of: a run of spaces, a grapheme cluster
with combining marks (invisible characters inside it count as nothing), an invisible character, a mapped
character. Case, punctuation and accents are kept.

Defined cases: null stays null, the empty string stays empty; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts (Greek, Cyrillic, Armenian, Cherokee, Lisu, Coptic) that look like Latin ones, in alphabetical order of the Latin letter.
LOOKALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "Ԍꓖ", "H": "ΗНᎻꓧⲎ", "I": "ΙІӀꓲ", "J": "ЈᎫꓙ", "K": "ΚКᏦꓗⲔ",
    "L": "Ꮮꓡ", "M": "ΜМᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ΟОՕꓳⲞ", "P": "ΡРᏢꓑⲢ", "Q": "Ԛ", "R": "ꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ", "U": "ꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫⲬ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ",
    "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү",
    "ä": "ӓ", "ë": "ё", "ï": "ї", "ö": "ӧ", "è": "ѐ",
}
PRESENTATION = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
LIGATURES = range(0xFB00, 0xFB07)
IGNORED = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@lru_cache(maxsize=1)
def mapping() -> tuple[dict[str, str], str, str]:
    """(character to replacement, the space characters, the invisible characters)."""
    table = {c: latin for latin, others in LOOKALIKES.items() for c in others}
    spaces, hidden = [], []
    for cp in (*range(0x20, 0x3100), *range(0xA000, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Zs", "Zl", "Zp"):
            spaces.append(c)
        elif kind == "Cf" or cp in IGNORED:
            hidden.append(c)
        elif cp in LIGATURES or unicodedata.decomposition(c).split(" ")[0] in PRESENTATION:
            if c not in table:
                table[c] = unicodedata.normalize("NFKC", c)
        elif kind[0] == "L" and unicodedata.normalize("NFC", c) != c:
            table.setdefault(c, unicodedata.normalize("NFC", c))  # singletons such as the Kelvin and Angstrom signs
    table = {c: "".join(table.get(x, x) for x in out) for c, out in table.items()}
    check(table, set(spaces) | set(hidden))
    return table, "".join(spaces) + "\t\n\r\x0b\x0c\x85", "".join(hidden)


def check(table: dict[str, str], dropped: set[str]) -> None:
    """No character may be both mapped and dropped, and no replacement may need another pass."""
    for c, out in table.items():
        if c in dropped or any(x in table or x in dropped for x in out if x != " "):
            raise ValueError(f"conflicting mapping of U+{ord(c):04X}")


@lru_cache(maxsize=1)
def _transducer():
    table, spaces, hidden = mapping()
    marks = "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃰︠-︯"
    s, h = re.escape(spaces), re.escape(hidden)
    singles = re.escape("".join(c for c in table))
    pattern = re.compile(
        f"(?P<space>[{s}](?:[{s}{h}]*[{s}])?)|(?P<cluster>[^{s}{h}{marks}](?:[{h}]*[{marks}])+)|(?P<hidden>[{h}]+)|(?P<single>[{singles}])"
    )
    clusters: dict[str, str] = {}
    gone = re.compile(f"[{h}]+")

    def step(m: re.Match) -> str:
        kind, x = m.lastgroup, m.group()
        if kind == "space":
            return " "
        if kind == "hidden":
            return ""
        if kind == "single":
            return table[x]
        if (out := clusters.get(x)) is None:
            bare = gone.sub("", x)
            out = unicodedata.normalize("NFC", table.get(bare[0], bare[0]) + bare[1:])
            if len(clusters) < 65536:
                clusters[x] = out
        return out

    plain = "".join(c for c in map(chr, (*range(0x21, 0x7F), *range(0xC0, 0x180))) if c not in table)
    p = re.escape(plain)
    suspect = re.compile(f" *[{p}]?[^{p} ][^{p}]*| {{2,}}")
    odd = re.compile(f"[^{p} ]|  ")
    seen: dict[str, str] = {}

    def rewrite(m: re.Match) -> str:
        x = m.group()
        if (out := seen.get(x)) is None:
            out = pattern.sub(step, x)
            if len(seen) < 65536 and len(x) < 64:
                seen[x] = out
        return out

    return odd, suspect, rewrite


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like this one; plain stretches are passed over, the rest goes through the transducer."""
    if text is None:
        return None
    odd, suspect, rewrite = _transducer()
    return (suspect.sub(rewrite, text) if odd.search(text) else text).strip(" ")


_BLANK = re.compile("[ \t\r\n\x0b\x0c]+")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃰︠-︯]+")


def respaced(text: str) -> str:
    """The text with runs of ordinary spaces, tabs and line breaks as one space."""
    return _BLANK.sub(" ", text).strip(" ")


def folded(text: str) -> str:
    """Without case and accents."""
    text = text.lower()
    return text if text.isascii() else _MARK.sub("", unicodedata.normalize("NFD", text))


def words(text: str | None) -> list[str]:
    """Longest runs of letters or digits, without case and accents."""
    return _WORD.findall(folded(text)) if text else []
