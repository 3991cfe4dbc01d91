"""SQL of the text queries that SQL can express, for the comparison on small tables.

The canonical form is spelled out from the mapping of `textforms`, character by character; pairs are joined by brute
force, so these are for tables of some thousand rows.
"""

from __future__ import annotations

from cairnworks.llm.textforms import mapping


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    """The canonical form; only the letters that one character stands for, and ligatures of the Latin script, are mapped."""
    table, spaces, hidden = mapping()
    single = {c: x for c, x in table.items() if len(x) == 1}
    out = f"translate({column}, {_literal(hidden)}, '')"
    out = f"translate({out}, {_literal(''.join(single) + spaces)}, {_literal(''.join(single.values()) + ' ' * len(spaces))})"
    for c, x in table.items():
        if len(x) > 1 and x.isascii():
            out = f"replace({out}, {_literal(c)}, {_literal(x)})"
    return f"trim(regexp_replace(nfc_normalize({out}), ' +', ' ', 'g'))"


def _words(expression: str) -> str:
    return rf"regexp_extract_all(lower(strip_accents({expression})), '[\p{{L}}\p{{N}}]+')"


_BLANKS = r"trim(regexp_replace({}, '[ \t\r\n\x0b\x0c]+', ' ', 'g'))"
_FORMS = (
    "forms AS (SELECT url, field_name, " + _canonical("t") + " AS class, " + _BLANKS.format("t") + " AS variant FROM (SELECT url, 'title' AS field_name, title AS t FROM offers "
    "UNION ALL SELECT url, 'description', description FROM offers) WHERE t <> '')"
)
_SHINGLES = f"""texts AS (SELECT url, title || ' ' || description AS t FROM offers WHERE description <> ''),
worded AS (SELECT min(url) AS id, t, {_words(_canonical('t'))} AS w FROM texts GROUP BY t),
shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS (SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2
  HAVING 2 * count(*) >= (SELECT n FROM sizes WHERE id = a.id) + (SELECT n FROM sizes WHERE id = b.id) - count(*)),
members AS (SELECT x.url, w.id FROM texts x JOIN worded w ON w.t = x.t JOIN sizes USING (id))"""

SQL = {
    "p4_found": f"""WITH {_SHINGLES}
SELECT DISTINCT least(x.url, y.url) AS url_a, greatest(x.url, y.url) AS url_b FROM members x JOIN members y ON x.url <> y.url
WHERE x.id = y.id OR EXISTS (SELECT 1 FROM links WHERE a = least(x.id, y.id) AND b = greatest(x.id, y.id))""",
    "p4_classes": f"""WITH RECURSIVE {_SHINGLES},
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT id, id AS other FROM sizes UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
grouped AS (SELECT id, min(other) AS group_id FROM reached GROUP BY 1)
SELECT m.url, m.id AS class_id, g.group_id, (SELECT count(*) FROM members c WHERE c.id = m.id) AS copies, (SELECT count(*) FROM both_ways l WHERE l.a = m.id) AS links
FROM members m JOIN grouped g ON g.id = m.id""",
    "p6_found": f"""WITH {_FORMS}
SELECT DISTINCT a.url AS url_a, b.url AS url_b, a.field_name FROM forms a JOIN forms b ON a.field_name = b.field_name AND a.class = b.class AND a.variant <> b.variant AND a.url < b.url WHERE a.class <> ''""",
    "p6_classes": f"""WITH {_FORMS}, f AS (SELECT DISTINCT * FROM forms WHERE class <> ''),
c AS (SELECT field_name, class, count(DISTINCT variant) AS variants, count(DISTINCT url) AS records, min(url) AS class_id FROM f GROUP BY 1, 2 HAVING count(DISTINCT variant) > 1)
SELECT f.url, f.field_name, c.class_id, min(f.url) OVER (PARTITION BY f.field_name, f.class, f.variant) AS variant_id, c.variants, c.records FROM f JOIN c USING (field_name, class)""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text <> ''), e AS (SELECT item_id, {_words('text')} AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: hash(w[i:i + 12]))) AS h FROM d WHERE len(w) >= 13),
ew AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: hash(w[i:i + 12]))) AS h FROM e WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (h)""",
}
