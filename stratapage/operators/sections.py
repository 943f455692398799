"""Nested sections of HTML pages: headings, their scores, and the tree.

A heading's parent is the nearest previous heading of a strictly greater score.
"""

from __future__ import annotations

from stratapage.functions import text as t
from stratapage.functions.dialect import Step

#: Scores a heading can have, greatest first; at most as many levels.
TIERS = (100, 65, 55, 50, 25)

#: pages (page_id, html) as units: the text of each block element, in order.
HTML: list[Step] = [
    ("pieces", "SELECT @dealt_by(page_id) page_id, i, piece, lower(@extract(piece, '^/?[A-Za-z0-9!]+')) AS tag FROM @explode(pages, @split(html, '<'), i, piece)"),
    ("opened", """
SELECT *, sum(CASE WHEN @like(tag, '^/?(h[1-6]|p|li|div|article|nav|body|footer|header|section|title|ul|ol|head|script|style|table|tr|td|th)$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS element FROM pieces"""),
    ("elements", """
SELECT page_id, element, min(i) AS i, @argmax(tag, -i) AS tag, @string_list(@replace(piece, '^[^>]*>', ' '), '', i) AS raw FROM opened WHERE tag <> '!' AND piece <> '' GROUP BY page_id, element"""),
    ("texts", f"SELECT page_id, i, tag, {t.collapse('raw')} AS text FROM elements WHERE NOT @like(tag, '^(script|style|head|title)$') AND {t.collapse('raw')} <> ''"),
    ("html_units", """
SELECT CAST(page_id AS STRING) AS document_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, tag, text, CASE WHEN @like(tag, '^h[1-6]$') THEN 'section-header' WHEN tag = 'li' THEN 'list-item' WHEN tag IN ('td', 'th') THEN 'table' ELSE 'text' END AS layout FROM texts"""),
]

_WORDS = "@size(@split(text, ' '))"

#: blocks (document_id, ord, text, layout, prominence, size_ratio, depth, repetition, n_blocks, n_prominent, n_body, record, width) as candidates for headings.
#: HTML units as such blocks: one source each; a table cell is a record of as many columns as its row has cells in a run.
PAGE_BLOCKS: list[Step] = [
    ("cell_runs", "SELECT *, sum(CASE WHEN layout = 'table' THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM html_units"),
    ("heading_blocks", """
SELECT document_id, ord, tag, text, layout, CAST(CASE WHEN layout = 'section-header' THEN 0.6 ELSE 0.1 END AS DOUBLE) AS prominence, CAST(CASE WHEN tag = 'h1' THEN 1.4 WHEN layout = 'section-header' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS size_ratio,
  CAST(0 AS BIGINT) AS depth, count(*) OVER (PARTITION BY document_id, tag, text) AS repetition, 1 AS n_blocks, CASE WHEN layout = 'section-header' THEN 1 ELSE 0 END AS n_prominent, CASE WHEN layout = 'section-header' THEN 0 ELSE 1 END AS n_body,
  layout = 'table' AS record, CASE WHEN layout = 'table' THEN count(*) OVER (PARTITION BY document_id, layout, run) ELSE 0 END AS width, @int(ord / 40) + 1 AS page
FROM cell_runs"""),
]

_NO_ITEM = f"NOT record AND layout <> 'list-item' AND NOT (layout = 'page-header' AND repetition >= 2) AND @like(text, '^[\\p{{L}}\\p{{N}}\"\\x27(\\[{{]') AND NOT @like(text, '^\\p{{Ll}}') AND NOT @like(text, '^\\p{{Nd}}+[.)](\\s|$)')"
_HEADER = "layout IN ('section-header', 'page-header')"
_SHORT = "length(text) <= 120 AND n_words <= 14"
_TITLE = f"({_SHORT} AND n_blocks <= 2 AND NOT @like(text, '[.?;!]$'))"
_COLUMN_HEADER = f"(length(text) <= 200 AND size_ratio < 1.12 AND prominence < least_prominence + 0.15 AND NOT {_HEADER} AND length(text) - length(@replace(text, '/', '')) >= 2 AND n_blocks <= 2)"
_CRUMB = f"(length(text) <= 12 AND n_words <= 2 AND size_ratio < 1.1 AND prominence < least_prominence AND NOT {_HEADER} AND NOT @like(text, '\\p{{Nd}}'))"
_PROMINENT = f"((prominence >= least_prominence OR size_ratio >= 1.15 OR depth >= 1 OR {_HEADER}) AND {_SHORT} AND (n_blocks <= 2 OR (n_prominent >= 1 AND n_body <= 1)))"

#: How far a table is looked for before and after a heading, in blocks; and the columns of a table that goes on around one.
REACH, COLUMNS = 8, 3


def _before(n: int) -> str:
    """The width of the nearest record of two columns or more within n blocks before, unless a heading stands between."""
    return "CASE " + " ".join(f"WHEN lag(flagged, {i}) OVER w THEN 0 WHEN lag(record AND width >= 2, {i}) OVER w THEN lag(width, {i}) OVER w" for i in range(1, n + 1)) + " ELSE 0 END"


def _after(n: int) -> str:
    return "CASE " + " ".join(f"WHEN lead(flagged, {i}) OVER w THEN 0 WHEN lead(record AND width >= 2, {i}) OVER w THEN lead(width, {i}) OVER w" for i in range(1, n + 1)) + " ELSE 0 END"


HEADINGS: list[Step] = [
    ("cutoffs", "SELECT document_id, @pct(prominence, 0.7) AS least_prominence FROM heading_blocks GROUP BY document_id"),
    ("judged", f"""
SELECT *, {_NO_ITEM} AND NOT {_COLUMN_HEADER} AND NOT {_CRUMB} AND NOT (@like(text, '[.?!]$') AND n_words >= 4) AND NOT (@like(text, ':$') AND n_words >= 4) AND ({_PROMINENT} OR {_TITLE}) AS first_flag
FROM (SELECT h.*, {_WORDS} AS n_words, least_prominence FROM heading_blocks h JOIN cutoffs c ON h.document_id = c.document_id) x"""),
    # a short label that recurs among the headings opens nothing
    ("headings_now", f"SELECT *, first_flag AND NOT (n_words <= 4 AND length(text) <= 24 AND sum(CASE WHEN first_flag THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, text) >= 2) AS flagged FROM judged"),
    # nor does one inside a table that goes on. Of two such that see the same table, the first is no heading any more when the second looks back, which only lets it see further: so what stops a look back is a heading that isn't inside a table itself
    ("looked", f"SELECT *, {_after(REACH)} AS width_after, lead(flagged) OVER w AS flagged_next FROM headings_now WINDOW w AS (PARTITION BY document_id ORDER BY ord)"),
    ("last_tables", "SELECT *, @last(CASE WHEN record AND width >= 2 THEN ord END) OVER w AS table_ord, @last(CASE WHEN record AND width >= 2 THEN width END) OVER w AS table_width FROM looked WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    ("inside", f"SELECT *, flagged AND width_after >= {COLUMNS} AND table_width = width_after AND ord - table_ord <= {REACH} AS may_be_inside FROM last_tables"),
    # a look back that meets a heading that stays ends there
    ("stops", "SELECT *, @last(CASE WHEN flagged AND NOT coalesce(may_be_inside, false) THEN ord END) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop_ord FROM inside"),
    ("settled", "SELECT *, flagged AND NOT (coalesce(may_be_inside, false) AND coalesce(stop_ord, -1) < table_ord) AS heading FROM stops"),
    ("followed", "SELECT *, coalesce(lead(heading) OVER w, false) AS heading_next, CASE WHEN lead(heading) OVER w THEN false WHEN lead(record AND width >= 2) OVER w THEN true WHEN lead(heading, 2) OVER w THEN false ELSE coalesce(lead(record AND width >= 2, 2) OVER w, false) END AS near_table FROM settled WINDOW w AS (PARTITION BY document_id ORDER BY ord)"),
    ("heads", """
SELECT document_id, ord, tag, text, layout, page, n_words, size_ratio, prominence, heading, CASE WHEN NOT heading THEN NULL WHEN layout = 'section-header' AND NOT near_table THEN 100 WHEN heading_next OR (layout = 'page-header' AND NOT near_table AND n_words >= 8) THEN CASE WHEN n_words >= 8 THEN 65 ELSE 55 END
  WHEN near_table OR n_words <= 8 THEN 25 ELSE 50 END AS score FROM followed"""),
]

_LAST = ", ".join(f"@last(CASE WHEN score = {s} THEN ord END) OVER w AS last_{s}" for s in TIERS)
_PARENT = "CASE " + " ".join(f"WHEN score = {s} THEN " + (f"greatest({', '.join(f'coalesce(last_{x}, -1)' for x in TIERS if x > s)})" if sum(x > s for x in TIERS) > 1 else f"coalesce(last_{TIERS[0]}, -1)" if s < TIERS[0] else "-1") for s in TIERS) + " END"

TREE: list[Step] = [
    # the nearest previous heading of each tier, and of these the latest of a greater score
    ("tiers", f"SELECT *, {_LAST} FROM heads WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    ("parents", f"SELECT document_id, ord, text, layout, page, size_ratio, score, nullif({_PARENT}, -1) AS parent, max(CASE WHEN score IS NOT NULL THEN ord END) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM tiers"),
    ("p1", "SELECT a.*, b.parent AS up1 FROM (SELECT * FROM parents WHERE score IS NOT NULL) a LEFT JOIN parents b ON a.document_id = b.document_id AND a.parent = b.ord"),
    ("p2", "SELECT a.*, b.parent AS up2 FROM p1 a LEFT JOIN parents b ON a.document_id = b.document_id AND a.up1 = b.ord"),
    ("p3", "SELECT a.*, b.parent AS up3 FROM p2 a LEFT JOIN parents b ON a.document_id = b.document_id AND a.up2 = b.ord"),
    ("items", "SELECT document_id, coalesce(section, -1) AS section, count(*) AS item_count, max(ord) AS last_ord, max(page) AS last_page FROM parents WHERE score IS NULL GROUP BY document_id, coalesce(section, -1)"),
    ("sections", """
SELECT p.document_id, p.ord AS section, p.text AS heading, p.score, p.parent, p.page, p.size_ratio, up1, up2, up3, CASE WHEN p.parent IS NULL THEN 0 WHEN up1 IS NULL THEN 1 WHEN up2 IS NULL THEN 2 WHEN up3 IS NULL THEN 3 ELSE 4 END AS depth, coalesce(i.item_count, 0) AS item_count, coalesce(i.last_ord, p.ord) AS last_ord,
  greatest(p.page, coalesce(i.last_page, p.page)) AS last_page
FROM p3 p LEFT JOIN items i ON p.document_id = i.document_id AND p.ord = i.section
UNION ALL SELECT document_id, section, '(preamble)' AS heading, 1000 AS score, CAST(NULL AS BIGINT) AS parent, 1 AS page, CAST(1 AS DOUBLE) AS size_ratio, CAST(NULL AS BIGINT) AS up1, CAST(NULL AS BIGINT) AS up2, CAST(NULL AS BIGINT) AS up3, 0 AS depth, item_count, last_ord, last_page FROM items WHERE section = -1"""),
    # five levels at most, so each section counts for itself and for up to four above it
    ("ends", "SELECT document_id, above AS section, max(last_page) AS end_page, max(last_ord) AS end_ord, count(*) - 1 AS below FROM @explode((SELECT document_id, last_page, last_ord, @list(section, parent, up1, up2, up3) AS line FROM sections), line, i, above) WHERE above IS NOT NULL GROUP BY document_id, above"),
    ("section_rows", "SELECT s.*, end_page, end_ord, below, end_page - page + 1 AS page_span, least(1.0, 0.45 + 0.15 * least(1.0, size_ratio - 1.0) + 0.05 * greatest(0, 3 - depth)) AS confidence FROM sections s JOIN ends e ON s.document_id = e.document_id AND s.section = e.section"),
]

#: Likeness of a heading to a label's words below which it has no label.
LABEL_LEAST = 0.12

TO_HEADS = HTML + PAGE_BLOCKS + HEADINGS
TO_SECTIONS = TO_HEADS + TREE
