"""DuckDB SQL for those queries that SQL can express.

Not expressed: sums over all segmentations (1), trained classifiers (2), differencing (3), XXH64 (5), searches over lattices (8), edit distances to
substrings (9), media files (10). Their tests hold them against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

from geolode.llm import licenses, substrings, suffixes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def passages(window: int = substrings.WINDOW) -> str:
    """Operator 4: each window's text is ranked among its equals by document and start; a word goes if a later one covers it."""
    return rf"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, ws FROM listed),
windows AS (SELECT doc_id, word, pos, CASE WHEN pos + {window - 1} <= len(ws) THEN array_to_string(ws[pos:pos + {window - 1}], ' ') END AS g FROM words),
ranked AS (SELECT doc_id, word, pos, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS again FROM windows),
marked AS (SELECT doc_id, word, pos, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM ranked),
cut AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)"""


def strings(window: int = suffixes.WINDOW) -> str:
    """Operator 6: each window's bytes are counted; a byte goes if a window covers it that is counted more than once."""
    return f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, octet_length(h))) AS pos FROM texts),
windows AS (SELECT doc_id, pos, hex(h[pos + 1:pos + 1]) AS b, CASE WHEN pos + {window} <= octet_length(h) THEN md5_number(h[pos + 1:pos + {window}]) END AS g FROM places),
counted AS (SELECT doc_id, pos, b, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM windows),
marked AS (SELECT doc_id, pos, b, max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM counted),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
cut AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)"""


def scans(base: dict[str, str] = licenses.BASE, templates: dict[str, str] = licenses.TEMPLATES) -> str:
    """Operator 7: base phrases by comparing runs of words; the other labels by votes of word grams for diagonals, and edit distances of spans."""
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in base.items())
    own = licenses.listed({}, templates)
    grams = ", ".join(f"({n}, {at}, {w[at : at + licenses.gram_of(len(w), False)]!r})" for n, (w, _, _) in enumerate(own) for at in range(len(w) - licenses.gram_of(len(w), False) + 1))
    facts = []
    for n, (w, label, _) in enumerate(own):
        known = list(dict.fromkeys(w))
        coded = "".join(licenses.LETTERS[known.index(x)] for x in w)
        marks = [licenses.LETTERS[i] for i, x in enumerate(known) if x in licenses.MARKS]
        facts.append(f"({n}, {known!r}, '{coded}', {marks!r}::VARCHAR[], {len(w)}, {licenses.edits(len(w))}, {licenses.votes_of(len(w), False)}, '{label}')")
    return rf"""
WITH phrases(words, label) AS (VALUES {phrases}),
grams(template, place, words) AS (VALUES {grams}),
facts(template, vocabulary, coded, marks, size, edits, least, label) AS (VALUES {", ".join(facts)}),
listed AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT doc_id, ws, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM listed),
own AS (
    SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels
    FROM words JOIN phrases p ON word = p.words[1] AND ws[pos + 1:pos + len(p.words)] = p.words GROUP BY doc_id
),
hits AS (SELECT DISTINCT doc_id, template, place, pos - place AS diagonal FROM words JOIN grams g ON word = g.words[1] AND ws[pos + 1:pos + len(g.words)] = g.words),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
likely AS (
    SELECT d.doc_id, d.template, d.diagonal FROM diagonals d JOIN hits h ON d.doc_id = h.doc_id AND d.template = h.template AND h.diagonal BETWEEN d.diagonal AND d.diagonal + {licenses.DRIFT}
    JOIN facts f ON d.template = f.template GROUP BY ALL HAVING count(DISTINCT h.place) >= any_value(f.least)
),
starts AS (SELECT doc_id, template, unnest(range(greatest(diagonal - edits, 0), greatest(diagonal + edits, greatest(diagonal - edits, 0)) + 1)) AS a, diagonal FROM likely JOIN facts USING (template)),
spans AS (SELECT DISTINCT doc_id, template, a, least(a + unnest(range(size - edits, size + edits + 1)), diagonal + size + 2 * edits) AS z FROM starts JOIN facts USING (template)),
coded AS (
    SELECT doc_id, template, array_to_string(list_transform(ws[a + 1:z], lambda w: CASE WHEN list_contains(vocabulary, w) THEN '{licenses.LETTERS}'[list_position(vocabulary, w)] WHEN list_contains({licenses.MARKS!r}, w) THEN '!' ELSE '?' END), '') AS t
    FROM spans JOIN facts USING (template) JOIN listed USING (doc_id)
),
close AS (
    SELECT doc_id, template, min(levenshtein(t, coded)) AS distance FROM coded JOIN facts USING (template)
    WHERE NOT contains(t, '!') AND len(list_filter(marks, lambda m: NOT contains(t, m))) = 0 GROUP BY doc_id, template
),
found AS (SELECT doc_id, max(1 - distance / size) AS score, list_distinct(list(label)) AS labels FROM close JOIN facts USING (template) WHERE distance <= edits GROUP BY doc_id)
SELECT l.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    array_to_string(list_sort(coalesce(own.labels, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(coalesce(own.labels, []) || coalesce(found.labels, []))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(found.score, 0.0)::DOUBLE END AS score
FROM listed l LEFT JOIN own USING (doc_id) LEFT JOIN found USING (doc_id)"""


SQL = {"op4_fm_substrings": passages(), "op6_suffix_arrays": strings(), "op7_diagonal_licenses": scans()}
