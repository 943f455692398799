"""Typography of blocks from their spans, and other steps on single blocks."""

from __future__ import annotations

from stratapage.functions import text as t
from stratapage.functions.dialect import Step

#: Bits of a span's flags, and what a font's name says in their stead.
BOLD, ITALIC, MONO = 16, 2, 8
FONT_NAMES = {"bold": "bold|black", "italic": "italic|oblique", "mono": "mono|courier"}


def _style(kind: str, bit: int) -> str:
    return f"(@int(flags / {bit}) % 2 = 1 OR @like(lower(font), '{FONT_NAMES[kind]}'))"


#: pages (page_id, html) as spans: the pieces of text between tags, with the font and flags that open tags give.
SPANS: list[Step] = [
    ("span_pieces", "SELECT page_id, i, lower(@extract(piece, '^/?[A-Za-z0-9]+')) AS tag, @replace(piece, '^[^>]*>', '') AS text FROM @explode((SELECT page_id, html FROM pages WHERE html IS NOT NULL), @split(html, '<'), i, piece)"),
    ("span_places", "SELECT *, sum(CASE WHEN @like(tag, '^/?(h[1-6]|p|li|div|article|body|title|nav|footer)$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block FROM span_pieces"),
    ("spans", """
SELECT CAST(page_id AS STRING) AS document_id, block, i AS ord, text, CASE WHEN tag = 'h1' THEN 20.04 WHEN @like(tag, '^h[2-6]$') THEN 15.0 ELSE 11.0 END AS size, CASE WHEN tag IN ('a', 'code') THEN 'Courier' WHEN @like(tag, '^h') THEN 'Serif-Bold' ELSE 'Serif' END AS font,
  CASE WHEN tag IN ('b', 'strong') THEN 16 WHEN tag IN ('i', 'em') THEN 2 ELSE 0 END AS flags, CAST(0 AS BIGINT) AS color FROM span_places WHERE trim(text) <> ''"""),
]

#: Spans of a block as its formatting: what covers most letters wins, the first seen of equals.
FORMATTING: list[Step] = [
    ("styled", f"SELECT *, greatest(1, length(trim(text))) AS n, @round(size, 1) AS rounded, {_style('bold', BOLD)} AS bold, {_style('italic', ITALIC)} AS italic, {_style('mono', MONO)} AS mono FROM spans"),
    ("size_counts", "SELECT document_id, block, rounded, sum(n) AS n, min(ord) AS seen FROM styled GROUP BY document_id, block, rounded"),
    ("font_counts", "SELECT document_id, block, font, sum(n) AS n, min(ord) AS seen FROM styled GROUP BY document_id, block, font"),
    ("main_sizes", "SELECT document_id, block, @argmax(rounded, n, -seen) AS dominant_size, count(*) AS size_variety FROM size_counts GROUP BY document_id, block"),
    ("main_fonts", "SELECT document_id, block, @argmax(font, n, -seen) AS dominant_font FROM font_counts GROUP BY document_id, block"),
    ("style_shares", "SELECT document_id, block, sum(n) AS n, max(size) AS max_size, min(size) AS min_size, " + ", ".join(f"sum(CASE WHEN {k} THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS {k}_ratio" for k in ("bold", "italic", "mono")) + ", @argmax(color, -ord) AS color FROM styled GROUP BY document_id, block"),
    ("formatting", "SELECT s.*, dominant_size, size_variety, dominant_font FROM style_shares s JOIN main_sizes z ON s.document_id = z.document_id AND s.block = z.block JOIN main_fonts f ON s.document_id = f.document_id AND s.block = f.block"),
]

#: Rows of a grid as equal slices of its box (x0, y0, x1, y1), by place and number of rows.
ROW_BOXES: list[Step] = [
    ("grid_boxes", "SELECT grid_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM units WHERE grid_id IS NOT NULL GROUP BY grid_id"),
    ("row_boxes", "SELECT u.grid_id, u.ord, b.x0, b.x1, b.y0 + (r - 1) * (b.y1 - b.y0) / n AS y0, b.y0 + r * (b.y1 - b.y0) / n AS y1 FROM (SELECT grid_id, ord, row_number() OVER (PARTITION BY grid_id ORDER BY ord) AS r FROM units WHERE grid_id IS NOT NULL) u JOIN grid_boxes b ON u.grid_id = b.grid_id"),
]


def area(a: str) -> str:
    """Of a box whose columns have the prefix a."""
    return f"(greatest(0.0, {a}x1 - {a}x0) * greatest(0.0, {a}y1 - {a}y0))"


def intersection(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0.0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"


def iou(a: str, b: str) -> str:
    """Intersection of two boxes over their union; 0 where both are empty."""
    both = intersection(a, b)
    return f"({both} / greatest(1e-12, {area(a)} + {area(b)} - {both}))"


def contains(a: str, b: str, slack: float = 1.0) -> str:
    return f"({a}x0 - {slack} <= {b}x0 AND {a}y0 - {slack} <= {b}y0 AND {a}x1 + {slack} >= {b}x1 AND {a}y1 + {slack} >= {b}y1)"


#: Headings with what follows them, flat: kept where something of twelve letters or more follows.
CONTEXTS: list[Step] = [
    ("context_cuts", "SELECT document_id, @pct(prominence, 0.75) AS cut, max(depth) > 0 AS has_depth FROM content_units GROUP BY document_id"),
    ("context_heads", f"""
SELECT u.document_id, segment, page, page_end, text, chars, prominence, depth, block_type = 'content' AND NOT (@like(text, '[.?!]$') AND {{words}} >= 8) AND CASE WHEN has_depth THEN depth > 0 ELSE prominence >= cut AND chars <= 120 AND {{words}} <= 14 AND NOT {t.terminal('text')} END AS head
FROM content_units u JOIN context_cuts c ON u.document_id = c.document_id""".replace("{words}", "@size(@split(text, ' '))")),
    ("context_members", "SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS context FROM context_heads"),
    ("contexts", f"""
SELECT document_id, context, @argmax(text, CASE WHEN head THEN 1 ELSE 0 END, -segment) AS heading, min(page) AS page, count_if(NOT head AND chars >= 12) AS members, {t.clip01('0.4 + 0.6 * ' + t.clip01('count_if(NOT head AND chars >= 12) / 6.0'))} AS confidence,
  CASE WHEN count_if(NOT head AND chars >= 12) > 0 THEN 'CREATE_CONTEXT' ELSE 'NO_CONTEXT' END AS decision FROM context_members WHERE context > 0 GROUP BY document_id, context"""),
]
