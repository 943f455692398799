"""Structured segmentation: units to features, adjacent-pair evidence, adaptive cut, content units.

All operators are steps of one declarative statement (see functions.dialect);
every window and aggregate is partitioned by document.
"""

from __future__ import annotations

import re

from stratapage.functions import text as t
from stratapage.functions.dialect import Step
from stratapage.operators.embedding import TERMS

#: Weights of the relationship and the boundary signals.
RELATIONSHIP = {
    "semantic": 0.20, "spatial": 0.14, "typography": 0.14, "alignment": 0.12, "structural": 0.12, "spacing": 0.10, "container": 0.10, "reading": 0.08,
}
BOUNDARY = {
    "b_repetition": 0.14, "b_semantic": 0.12, "b_container": 0.12, "b_structural": 0.10, "b_hierarchy": 0.10, "b_spatial": 0.09,
    "b_formatting": 0.08, "b_layout": 0.08, "b_onset": 0.07, "b_alignment": 0.05, "b_reading": 0.05,
}
#: Signals of form, discounted where a template explains them.
FORM = ("spatial", "alignment", "typography", "spacing", "structural", "container")
BINS = 64
#: Share of a document's pages on which a short text recurs that is furniture.
FURNITURE_SHARE = 0.3

CLEAN = t.collapse("line")
_REAL = "@size(@keep(cells, c, trim(c) <> '' AND NOT @like(trim(c), '^[-:| ]*-[-:| ]*$'))) > 0"
_FILLED = "@size(@keep({x}, c, trim(c) <> ''))"

_RIGHT = "50.0 + least(500.0, 5.0 * length(text)) AS x1"

#: documents (doc_id, text) as lines with synthetic boxes: 40 lines a page, 18 points a line, 5 points a letter.
#: Grid rows that are drawn rules, or empty, go; a first row of labels that the second one continues is merged with it.
LINES: list[Step] = [
    ("split_lines", "SELECT @dealt_by(document_id) CAST(doc_id AS STRING) AS document_id, i AS line_index, line FROM @explode(documents, @split(text, '\\n'), i, line)"),
    ("clean_lines", f"SELECT document_id, line_index, {CLEAN} AS text FROM split_lines WHERE @like(line, '[^\\s\\x{{00A0}}]')"),
    ("marked_lines", f"SELECT *, CASE WHEN in_grid THEN {t.cells('text')} END AS cells FROM (SELECT *, @like(text, '^[^|]*[|].*[|]') AS in_grid FROM clean_lines) x"),
    ("placed_lines", f"SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_index) - 1 AS spot FROM marked_lines WHERE NOT in_grid OR {_REAL}"),
    ("lines", """
SELECT *, sum(grid_start) OVER (PARTITION BY document_id ORDER BY spot) AS grid_no FROM (
  SELECT *, CASE WHEN in_grid AND NOT coalesce(lag(in_grid) OVER (PARTITION BY document_id ORDER BY spot), false) THEN 1 ELSE 0 END AS grid_start FROM placed_lines) y"""),
    ("grid_rows", f"""
SELECT document_id, spot, grid_no, cells, width, r, lead(cells) OVER w AS below, lead(text) OVER w AS text_below, text, {_FILLED.format(x='cells')} AS filled, {_FILLED.format(x='lead(cells) OVER w')} AS filled_below FROM (
  SELECT document_id, spot, grid_no, cells, text, max(@size(cells)) OVER (PARTITION BY document_id, grid_no) AS width, row_number() OVER (PARTITION BY document_id, grid_no ORDER BY spot) AS r FROM lines WHERE in_grid) x
WINDOW w AS (PARTITION BY document_id, grid_no ORDER BY spot)"""),
    ("label_rows", """
SELECT *, lag(merges) OVER (PARTITION BY document_id, grid_no ORDER BY spot) AS merged_away FROM (
  SELECT *, r = 1 AND below IS NOT NULL AND filled > 0 AND filled < filled_below AND filled <= greatest(1, @int(width / 2)) AS merges FROM grid_rows) x"""),
    ("whole_rows", """
SELECT document_id, spot, CASE WHEN merges THEN @upto(width, i, trim(concat(trim(coalesce(@maybe_at(cells, i), '')), ' ', trim(coalesce(@maybe_at(below, i), ''))))) ELSE @upto(width, i, coalesce(@maybe_at(cells, i), '')) END AS cells,
  CASE WHEN merges THEN concat(text, ' ', text_below) ELSE text END AS text, coalesce(merged_away, false) AS merged_away, merges FROM label_rows"""),
    ("kept_lines", """
SELECT l.document_id, l.spot, l.line_index, l.in_grid, l.grid_no, coalesce(g.text, l.text) AS text, g.cells FROM lines l LEFT JOIN whole_rows g ON l.document_id = g.document_id AND l.spot = g.spot WHERE NOT coalesce(g.merged_away, false)"""),
    # heading marks and markup aren't text; a grid row's text is that of its cells
    ("spelled_lines", f"""
SELECT document_id, spot, line_index, in_grid, grid_no, cells, CAST({t.marker_depth('text')} AS BIGINT) AS depth, @like(text, '^[\\x{{2022}}*-] ') AS item,
  CASE WHEN in_grid THEN {t.collapse("@join(@keep(cells, c, trim(c) <> ''), ' ')")} WHEN @like(text, '[<*_#]') THEN {t.strip_markup("@replace(text, '^\\s*#{1,6}[ \\t]', '')")} ELSE text END AS text FROM kept_lines"""),
    ("units", f"""
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY spot) - 1 AS ord, @int(line_index / 40) + 1 AS page, text, CASE WHEN in_grid THEN 'table' WHEN depth > 0 THEN 'section-header' WHEN item THEN 'list-item' ELSE 'text' END AS layout,
  depth, CASE WHEN in_grid THEN concat(document_id, '_grid_', CAST(grid_no AS STRING)) END AS grid_id, cells,
  CAST(50 AS DOUBLE) AS x0, 40.0 + 18.0 * (line_index % 40) AS y0, {_RIGHT}, 52.0 + 18.0 * (line_index % 40) AS y1,
  CAST(612 AS DOUBLE) AS pw, CAST(792 AS DOUBLE) AS ph, CAST(1 AS BIGINT) AS line_count
FROM spelled_lines WHERE text <> ''"""),
]

#: raw_units (document_id, ord, text, grid_id and a box) as candidates: a text of several enumerated lines of like length gives one for each.
CANDIDATES: list[Step] = [
    ("raw_lines", "SELECT *, @keep(@split(text, '\\n'), q, trim(q) <> '') AS parts FROM raw_units"),
    ("raw_shapes", f"SELECT *, @size(parts) AS n, @size(@keep(parts, q, {t.first_class('q')} = 'D')) AS enumerated, @map(parts, q, CAST(length(q) AS DOUBLE)) AS sizes FROM raw_lines"),
    ("raw_splits", """
SELECT *, grid_id IS NULL AND n >= 2 AND enumerated >= 2 AND enumerated >= n * 0.6 AND @total(sizes) >= n AND (@peak(sizes) + @peak(@map(sizes, q, -q))) / (@total(sizes) / n) <= 2.5 AS splits FROM raw_shapes"""),
    ("candidates", """
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord, i) AS ord, ord AS raw_ord, i AS part, part AS text, splits, x0, x1,
  CASE WHEN splits THEN y0 + i * (y1 - y0) / n ELSE y0 END AS y0, CASE WHEN splits THEN y0 + (i + 1) * (y1 - y0) / n ELSE y1 END AS y1
FROM @explode((SELECT *, CASE WHEN splits THEN parts ELSE @list(text) END AS pieces FROM raw_splits), pieces, i, part)"""),
]

#: Per-document statistics of line heights and gaps.
STATS: list[Step] = [
    ("gaps", "SELECT *, CASE WHEN lag(page) OVER w = page THEN y0 - lag(y1) OVER w END AS gap FROM units WINDOW w AS (PARTITION BY document_id ORDER BY ord)"),
    ("doc_stats", """
SELECT document_id, count(*) AS n_units, max(page) AS pages, coalesce(nullif(@pct((y1 - y0) / line_count, 0.5), 0), 12.0) AS median_height,
  coalesce(@filtered(@pct(gap, 0.5), gap > 0), 1.0) AS median_gap, avg((y1 - y0) / line_count) AS mean_height, coalesce(nullif(stddev_pop((y1 - y0) / line_count), 0), 1.0) AS std_height,
  @pct(x0, 0.5) AS median_x0, @pct(x1 - x0, 0.5) AS median_width, coalesce(nullif(@filtered(@pct(gap, 0.5), gap >= 0), 0), 6.0) AS gap_median,
  coalesce(nullif(@filtered(stddev_pop(gap), gap >= 0), 0), 4.0) AS gap_std
FROM gaps GROUP BY document_id"""),
]

_SHAPE = """concat('L:', layout, '|C:', CAST(n_cells AS STRING), '|X:', CAST(@int(rel_x0 * 8) AS STRING), '|W:', CAST(@int(rel_width * 8) AS STRING),
  '|H:', CAST(least(5, @int(lhr * 2)) AS STRING), '|D:', CAST(depth AS STRING), '|R:', CAST(least(4, line_count) AS STRING))"""

FEATURES: list[Step] = [
    ("measured", f"""
SELECT g.*, {t.clip01('x0 / pw')} AS rel_x0, {t.clip01('(x1 - x0) / pw')} AS rel_width, {t.clip01('y0 / ph')} AS rel_y0, (y1 - y0) / line_count / median_height AS lhr, pages,
  CASE WHEN gap IS NULL THEN 1.0 ELSE greatest(0.0, gap) / median_gap END AS gap_ratio, length(text) AS chars, coalesce(@size(cells), 0) AS n_cells, page / CAST(pages AS DOUBLE) AS page_fraction,
  {t.share('text', t.DIGITS)} AS digit_ratio, {t.share('text', t.UPPER)} AS upper_ratio, {t.share('text', t.PUNCTUATION)} AS punct_ratio
FROM gaps g JOIN doc_stats s ON g.document_id = s.document_id"""),
    ("shaped", f"""
SELECT *, {_SHAPE} AS shape, {t.clip01(f"0.5 * {t.clip01('(lhr - 0.9) / 0.8')} + 0.3 * {t.clip01('depth / 3.0')} + 0.2 * (1 - {t.clip01('chars / 400.0')})")} AS prominence FROM measured"""),
    # running furniture: the same short text at the same height of many pages
    ("recurring", f"""
SELECT document_id, line, band, count(DISTINCT page) AS on_pages FROM (SELECT document_id, page, pages, ord, chars, @casefold(trim(text)) AS line, @int(rel_y0 * 12) AS band FROM shaped WHERE pages >= 3) x
GROUP BY document_id, line, band HAVING count(DISTINCT page) >= greatest(3, @int(max(pages) * {FURNITURE_SHARE})) AND @argmax(chars, -ord) <= 80"""),
    ("features", """
SELECT s.*, count(*) OVER (PARTITION BY s.document_id, shape) AS repetition, r.line IS NOT NULL AS furniture
FROM shaped s LEFT JOIN recurring r ON s.document_id = r.document_id AND @casefold(trim(s.text)) = r.line AND @int(rel_y0 * 12) = r.band"""),
]

#: First rows of grids of three rows or more that look unlike the rows below: shorter cells, fewer digits, other letters.
_DIMENSIONS = (1, 2, 3, 4)
HEADERS: list[Step] = [
    ("row_cells", "SELECT grid_id, ord, v FROM @explode((SELECT grid_id, ord, CASE WHEN @size(@keep(cells, c, trim(c) <> '')) = 0 THEN @list(text) ELSE @keep(cells, c, trim(c) <> '') END AS cs FROM shaped WHERE grid_id IS NOT NULL), cs, i, v)"),
    ("row_profiles", f"SELECT grid_id, ord, row_number() OVER (PARTITION BY grid_id ORDER BY ord) AS r, p1, p2, p3, p4 FROM (SELECT grid_id, ord, avg(length(v)) / 40.0 AS p1, avg({t.share('v', t.DIGITS)}) AS p2, avg({t.share('v', t.UPPER)}) AS p3, avg({t.share('v', t.PUNCTUATION)}) AS p4 FROM row_cells GROUP BY grid_id, ord) x"),
    ("row_baselines", f"SELECT grid_id, {', '.join(f'@pct(p{i}, 0.5) AS m{i}' for i in _DIMENSIONS)} FROM row_profiles WHERE r > 1 GROUP BY grid_id HAVING count(*) >= 2"),
    ("row_spreads", f"SELECT p.grid_id, {', '.join(f'greatest(0.05, @pct(abs(p{i} - m{i}), 0.5)) AS s{i}' for i in _DIMENSIONS)} FROM row_profiles p JOIN row_baselines b ON p.grid_id = b.grid_id WHERE r > 1 GROUP BY p.grid_id"),
    ("grid_headers", f"SELECT p.grid_id, p.ord, @round(({' + '.join(f'abs(p{i} - m{i}) / s{i}' for i in _DIMENSIONS)}) / 4.0, 6) AS deviation FROM row_profiles p JOIN row_baselines b ON p.grid_id = b.grid_id JOIN row_spreads s ON p.grid_id = s.grid_id WHERE r = 1"),
]

_PAIR_COLUMNS = ("page", "layout", "depth", "grid_id", "text", "shape", "repetition", "rel_x0", "rel_width", "lhr", "n_cells", "prominence", "header")
_SAME_GRID = "(grid_id IS NOT NULL AND a_grid_id = grid_id)"
_TEMPLATE = f"""greatest(CASE WHEN a_shape = shape AND a_repetition >= 3 AND repetition >= 3 THEN {t.clip01(f"0.55 + 0.45 * {t.clip01('(least(a_repetition, repetition) - 3) / 8.0')}")} ELSE 0.0 END,
  CASE WHEN {_SAME_GRID} THEN 0.45 + 0.55 * (CASE WHEN repeated_grid THEN 1.0 ELSE 0.0 END) ELSE 0.0 END,
  CASE WHEN a_header <> header THEN 0.8 ELSE 0.0 END)"""

PAIRS: list[Step] = [
    ("grid_kinds", """
SELECT grid_id, count(*) AS n_rows, max(same) / CAST(count(*) AS DOUBLE) AS consistency, count(DISTINCT shape) AS shapes,
  count(*) >= 2 AND max(same) / CAST(count(*) AS DOUBLE) >= 0.6 AND count(DISTINCT shape) <= greatest(2, @int(count(*) / 2)) AS repeated_grid
FROM (SELECT grid_id, shape, count(*) OVER (PARTITION BY grid_id, n_cells) AS same FROM features WHERE grid_id IS NOT NULL) g GROUP BY grid_id"""),
    ("headed", "SELECT f.*, coalesce(k.repeated_grid, false) AS repeated_grid, coalesce(h.deviation >= 3.0, false) AS header FROM features f LEFT JOIN grid_kinds k ON f.grid_id = k.grid_id LEFT JOIN grid_headers h ON f.grid_id = h.grid_id AND f.ord = h.ord WHERE NOT furniture"),
    ("adjacent", f"""
SELECT * FROM (SELECT f.document_id, f.ord, f.gap_ratio, repeated_grid, f.chars, {', '.join(f'f.{c}' for c in _PAIR_COLUMNS)},
  {', '.join(f'lag(f.{c}) OVER w AS a_{c}' for c in _PAIR_COLUMNS)}, lag(f.ord) OVER w AS a_ord
FROM headed f WINDOW w AS (PARTITION BY f.document_id ORDER BY f.ord)) p WHERE a_ord IS NOT NULL"""),
    ("related", f"""
SELECT p.*, CASE WHEN a_page = page THEN {t.clip01('1.0 / (1.0 + greatest(0.0, gap_ratio - 1.0))')} ELSE 0.0 END AS spatial, {t.clip01('1.0 - abs(a_rel_x0 - rel_x0) * 4.0')} AS alignment,
  {t.clip01(f"0.6 * ({t.ratio('a_lhr', 'lhr')}) + 0.2 * CASE WHEN a_layout = layout THEN 1 ELSE 0 END + 0.2 * CASE WHEN a_depth = depth THEN 1 ELSE 0 END")} AS typography,
  CASE WHEN a_page = page THEN {t.clip01(f"1.0 - {t.clip01('(gap_ratio - 1.0) / 3.0')}")} ELSE 0.0 END AS spacing, CASE WHEN a_page = page THEN 1.0 ELSE 0.0 END AS reading,
  {t.clip01(f"0.5 * CASE WHEN a_shape = shape THEN 1 ELSE 0 END + 0.3 * ({t.ratio('a_n_cells', 'n_cells')}) + 0.2 * ({t.ratio('a_rel_width', 'rel_width')})")} AS structural,
  CASE WHEN {_SAME_GRID} THEN 1.0 ELSE 0.0 END AS container, {t.clip01('coalesce(cosine, 0.0)')} AS semantic, {_TEMPLATE} AS template,
  CASE WHEN @same(a_grid_id, grid_id) THEN 0.0 ELSE 0.7 END AS container_change
FROM adjacent p LEFT JOIN neighbours n ON p.document_id = n.document_id AND p.ord = n.ord"""),
    ("pairs", f"""
SELECT *, greatest(template, container_change) AS discount, 1.0 - semantic AS b_semantic, CASE WHEN a_page = page THEN {t.clip01('(gap_ratio - 1.0) / 2.5')} ELSE 1.0 END AS b_spatial, 1.0 - typography AS b_formatting,
  1.0 - alignment AS b_alignment, 1.0 - structural AS b_structural, template AS b_repetition, CASE WHEN {_SAME_GRID} THEN 0.0 WHEN a_grid_id IS NOT NULL OR grid_id IS NOT NULL THEN 1.0 ELSE 0.3 END AS b_container,
  CASE WHEN a_page = page THEN 0.0 ELSE 1.0 END AS b_reading, {t.clip01('2.5 * greatest(0.0, prominence - a_prominence)')} AS b_onset,
  CASE WHEN depth > 0 AND (a_depth = 0 OR depth <= a_depth) THEN 1.0 ELSE 0.0 END AS b_hierarchy,
  greatest(CASE WHEN a_layout <> layout THEN 0.85 ELSE 0.0 END, CASE WHEN a_layout = 'list-item' OR layout = 'list-item' OR (a_layout = 'section-header' AND layout = 'section-header') THEN 0.95 ELSE 0.0 END,
    CASE WHEN (a_grid_id IS NULL) <> (grid_id IS NULL) THEN 0.90 ELSE 0.0 END) AS b_layout
FROM related"""),
]


def _discounted(k: str, discount: str = "discount") -> str:
    return f"{k} * (1.0 - {discount})" if k in FORM else k


_SIDES = (("r", RELATIONSHIP), ("b", BOUNDARY))
#: Each signal's weight by the square root of its spread, on the whole weights' budget. Peaks and totals are columns of steps of their own: inside each weight they would be one expression too large to compile.
WEIGHTS: list[Step] = [
    ("spreads", "SELECT document_id, count(*) AS n_pairs, " + ", ".join(f"stddev_pop({_discounted(k)}) AS s_{k}" for k in [*RELATIONSHIP, *BOUNDARY]) + " FROM pairs GROUP BY document_id"),
    ("peaks", "SELECT *, " + ", ".join(f"greatest({', '.join(f's_{k}' for k in side)}) AS peak_{x}" for x, side in _SIDES) + " FROM spreads"),
    ("shares", "SELECT document_id, n_pairs, peak_r, peak_b, " + ", ".join(f"{w} * sqrt(s_{k} / greatest(peak_{x}, 1e-12)) AS v_{k}" for x, side in _SIDES for k, w in side.items()) + " FROM peaks"),
    ("budgets", "SELECT *, " + ", ".join(f"{sum(side.values()):.4f} / nullif({' + '.join(f'v_{k}' for k in side)}, 0) AS scale_{x}" for x, side in _SIDES) + " FROM shares"),
    ("pair_weights", "SELECT document_id, n_pairs, " + ", ".join(f"CASE WHEN n_pairs < 3 OR peak_{x} < 1e-6 THEN {w} ELSE v_{k} * scale_{x} END AS w_{k}" for x, side in _SIDES for k, w in side.items()) + " FROM budgets"),
]

CUT: list[Step] = [
    ("scored", f"""
SELECT p.*, {' + '.join(f'{_discounted(k)} * w_{k}' for k in RELATIONSHIP)} AS relationship, {' + '.join(f'{k} * w_{k}' for k in BOUNDARY)} AS boundary,
  ({' + '.join(f'{_discounted(k)} * w_{k}' for k in RELATIONSHIP)}) - ({' + '.join(f'{k} * w_{k}' for k in BOUNDARY)}) AS net
FROM pairs p JOIN pair_weights w ON p.document_id = w.document_id"""),
    ("ranges", "SELECT document_id, count(*) AS n, CASE WHEN p95 - p5 > 1e-9 THEN p5 ELSE low END AS lo, CASE WHEN p95 - p5 > 1e-9 THEN p95 ELSE high END AS hi, mid FROM (SELECT document_id, net, "
     "@pct(net, 0.05) OVER w AS p5, @pct(net, 0.95) OVER w AS p95, min(net) OVER w AS low, max(net) OVER w AS high, @pct(net, 0.5) OVER w AS mid FROM scored WINDOW w AS (PARTITION BY document_id)) x GROUP BY document_id, p5, p95, low, high, mid"),
    ("binned", f"SELECT s.document_id, r.lo, r.hi, r.n, least({BINS - 1}, @int((greatest(r.lo, least(r.hi, net)) - r.lo) / (r.hi - r.lo) * {BINS})) AS bin, greatest(r.lo, least(r.hi, net)) AS v FROM scored s JOIN ranges r ON s.document_id = r.document_id WHERE r.n >= 4 AND r.hi - r.lo > 1e-9"),
    ("bins", f"SELECT document_id, lo, hi, n, bin, count(*) AS c, sum(lo + (bin + 0.5) * (hi - lo) / {BINS}) AS m FROM binned GROUP BY document_id, lo, hi, n, bin"),
    ("sums", "SELECT *, CAST(sum(c) OVER w AS DOUBLE) AS c0, sum(m) OVER w AS m0, CAST(sum(c) OVER (PARTITION BY document_id) AS DOUBLE) AS ct, sum(m) OVER (PARTITION BY document_id) AS mt FROM bins WINDOW w AS (PARTITION BY document_id ORDER BY bin ROWS UNBOUNDED PRECEDING)"),
    ("separations", f"SELECT document_id, lo + (bin + 1) * (hi - lo) / {BINS} AS cut, bin, @round(c0 * (ct - c0) / (ct * ct) * power(m0 / c0 - (mt - m0) / (ct - c0), 2), 12) AS variance FROM sums WHERE ct > c0"),
    ("best_cuts", "SELECT document_id, @argmax(cut, variance, -bin) AS cut FROM separations GROUP BY document_id"),
    ("cuts", "SELECT r.document_id, r.n AS n_pairs, coalesce(b.cut, r.mid) AS cut FROM ranges r LEFT JOIN best_cuts b ON r.document_id = b.document_id"),
]

_TITLE = "(length({x}) > 0 AND @size(@split({x}, ' ')) <= 14 AND length({x}) <= 120 AND NOT @like({x}, '[.?!;:]$') AND @like({x}, '^\\p{{Lu}}'))"
_PLAIN = "grid_id IS NULL AND a_grid_id IS NULL AND coalesce(a_layout, '') IN ('text', 'section-header', 'page-header', '') AND coalesce(layout, '') IN ('text', 'section-header', 'page-header', '')"
_ATOMIC = "('list-item', 'section-header', 'page-header')"

#: The rules that force a split, first match wins; the sixth may match and force nothing.
FORCED = f"""CASE WHEN b_hierarchy >= 0.95 THEN 'hierarchy' WHEN b_layout >= 0.90 THEN 'layout' WHEN b_repetition >= 0.70 AND {_SAME_GRID} THEN 'grid_row'
  WHEN a_layout <> layout AND (a_layout IN {_ATOMIC} OR layout IN {_ATOMIC}) THEN 'atomic_role'
  WHEN a_grid_id IS NULL AND @like(a_text, '[.?!]$') AND @like(text, '^\\p{{Lu}}') THEN 'finished_sentence'
  WHEN {_PLAIN} THEN CASE WHEN {_TITLE.format(x='a_text')} AND ({_TITLE.format(x='text')} OR (@size(@split(text, ' ')) <= 20 AND @like(text, '^\\p{{Lu}}'))) THEN 'titles' ELSE '' END
  WHEN a_grid_id IS NULL AND @like(a_text, ':$') AND (@like(text, '^\\p{{Lu}}') OR @like(text, '^```') OR layout <> a_layout) THEN 'intro'
  WHEN a_grid_id IS NULL AND (@like(a_text, '^```') OR @like(text, '^```')) THEN 'fence' ELSE '' END"""

DECIDE: list[Step] = [
    ("forced", f"SELECT s.*, c.cut, {FORCED} AS force FROM scored s JOIN cuts c ON s.document_id = c.document_id"),
    ("decisions", f"SELECT *, force <> '' OR net < cut - 1e-9 AS split, CASE WHEN force <> '' THEN greatest(0.85, {t.clip01('0.5 + 2.0 * abs(net - cut)')}) ELSE {t.clip01('0.5 + 2.0 * abs(net - cut)')} END AS confidence FROM forced"),
    ("segmented", """
SELECT f.*, coalesce(d.split, true) AS split, coalesce(d.discount, 0.0) AS discount, sum(CASE WHEN coalesce(d.split, true) THEN 1 ELSE 0 END) OVER (PARTITION BY f.document_id ORDER BY f.ord ROWS UNBOUNDED PRECEDING) AS segment, """
     + ", ".join(f"d.{k}" for k in RELATIONSHIP) + " FROM features f LEFT JOIN decisions d ON f.document_id = d.document_id AND f.ord = d.ord WHERE NOT f.furniture"),
]

_BASE = " + ".join(f"{'(1.0 - mean_discount) * ' if k in FORM else ''}{w} * m_{k}" for k, w in RELATIONSHIP.items())

CONTENT: list[Step] = [
    ("grouped", f"""
SELECT document_id, segment, min(ord) AS first_ord, count(*) AS n_blocks, min(page) AS page, max(page) AS page_end, @string_list(text, chr(10), ord) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  max(CASE WHEN grid_id IS NOT NULL THEN 1 ELSE 0 END) AS in_grid, max(prominence) AS top, avg(prominence) AS prominence, max(depth) AS depth, max(n_cells) AS max_cells, sum(chars) AS chars, max(repetition) AS repetition, avg(lhr) AS lhr, avg(rel_x0) AS rel_x0, avg(gap_ratio) AS gap_ratio,
  @filtered(avg(discount), NOT split) AS mean_discount, {', '.join(f'@filtered(avg({k}), NOT split) AS m_{k}' for k in RELATIONSHIP)}
FROM segmented GROUP BY document_id, segment"""),
    ("role_rows", "SELECT s.document_id, s.segment, s.ord, CASE WHEN s.prominence >= greatest(0.45, 0.85 * g.top) THEN 'PROMINENT' WHEN s.chars <= 40 THEN 'META' ELSE 'BODY' END AS role FROM segmented s JOIN grouped g ON s.document_id = g.document_id AND s.segment = g.segment"),
    ("roles", """
SELECT document_id, segment, @string_list(role, ',', ord) AS roles, concat('P', CAST(count_if(role = 'PROMINENT') AS STRING), 'B', CAST(count_if(role = 'BODY') AS STRING), 'M', CAST(count_if(role = 'META') AS STRING)) AS signature
FROM role_rows GROUP BY document_id, segment"""),
    ("totals", "SELECT document_id, count(*) AS total FROM features GROUP BY document_id"),
    ("content_units", f"""
SELECT g.document_id, g.segment, n_blocks, page, page_end, g.text, x0, y0, x1, y1, CASE WHEN in_grid = 1 THEN 'structured_record' ELSE 'content' END AS block_type, r.roles, r.signature, prominence, depth, chars, lhr, rel_x0, gap_ratio,
  (first_ord + 1) / CAST(t.total AS DOUBLE) AS doc_position, max_cells,
  CASE WHEN n_blocks = 1 THEN {t.clip01(f"0.45 + 0.35 * {t.clip01(f'0.4 + 0.3 * ' + t.clip01('max_cells / 4.0') + ' + 0.3 * ' + t.clip01('repetition / 8.0'))} + 0.2 * @round({t.clip01('chars / 400.0')}, 3)")}
    ELSE {t.clip01(f'0.35 + 0.65 * {t.clip01("(" + _BASE + ") / 1.0")}')} END AS confidence
FROM grouped g JOIN roles r ON g.document_id = r.document_id AND g.segment = r.segment JOIN totals t ON g.document_id = t.document_id"""),
]

#: The order of the dimensions of a fingerprint's vector. Of these the structured path has the ones in STRUCTURED_DIMENSIONS; others are 0.
FINGERPRINT = (
    "role_prominent", "role_body", "role_meta", "block_count", "alignment_signature", "spacing_signature", "typography_signature", "content_density", "column_diversity", "head_size_ratio",
    "mean_semantic", "boundary_mean", "char_count_log", "local_position", "cell_count", "mean_rel_x0", "mean_rel_width", "mean_lhr", "mean_digit_ratio", "mean_upper_ratio", "marker_depth", "in_grid", "repetition",
)
STRUCTURED_DIMENSIONS = (
    "role_prominent", "role_body", "block_count", "content_density", "local_position", "cell_count", "mean_rel_x0", "mean_rel_width", "mean_lhr", "mean_digit_ratio", "mean_upper_ratio", "marker_depth", "in_grid", "repetition",
)


def fingerprint_vector(has: tuple[str, ...]) -> str:
    """A fingerprint's dimensions as a list, counts as ln(1 + n); the length isn't taken out yet."""
    cells = (f"ln(1.0 + {k})" if k in ("block_count", "repetition") else f"CAST({k} AS DOUBLE)" if k in has else "CAST(0 AS DOUBLE)" for k in FINGERPRINT)
    return f"@list({', '.join(cells)})"


def unit_vector(x: str) -> str:
    """A list of numbers as a unit vector; zeros stay."""
    return f"@map({x}, q, q / greatest(sqrt(@dot({x}, {x})), 1e-300))"


FINGERPRINTS: list[Step] = [
    ("unit_fingerprints", """
SELECT document_id, segment, count(*) AS block_count, count_if(prominence >= 0.45) AS role_prominent, count_if(prominence < 0.45) AS role_body, max(n_cells) AS cell_count, @round(avg(rel_x0)) AS mean_rel_x0, @round(avg(rel_width)) AS mean_rel_width, @round(avg(lhr)) AS mean_lhr,
  @round(avg(digit_ratio)) AS mean_digit_ratio, @round(avg(upper_ratio)) AS mean_upper_ratio, @round(avg(chars) / 500.0) AS content_density, max(depth) AS marker_depth, max(CASE WHEN grid_id IS NOT NULL THEN 1 ELSE 0 END) AS in_grid, @round(avg(repetition), 3) AS repetition, @round(avg(page_fraction)) AS local_position
FROM segmented GROUP BY document_id, segment"""),
    ("raw_vectors", f"SELECT document_id, segment, {fingerprint_vector(STRUCTURED_DIMENSIONS)} AS raw FROM unit_fingerprints"),
    ("fingerprint_vectors", f"SELECT document_id, segment, {unit_vector('raw')} AS structure FROM raw_vectors"),
]

#: Cells of grid rows as fields: position, text, shape; a cell of several bullets gives a field for each.
FIELDS: list[Step] = [
    ("cell_values", "SELECT document_id, segment, grid_id, ord, i AS field_position, v FROM @explode((SELECT * FROM segmented WHERE grid_id IS NOT NULL), cells, i, v)"),
    ("cell_parts", f"SELECT *, {t.bullet_parts('v')} AS parts FROM cell_values"),
    ("field_values", "SELECT document_id, segment, ord, field_position, i AS part, v2 AS field_text, @size(parts) AS n_parts FROM @explode((SELECT document_id, segment, ord, field_position, parts FROM cell_parts), parts, i, v2)"),
    ("fields", f"""
SELECT document_id, segment, ord, field_position, CASE WHEN n_parts > 1 THEN part END AS field_part, field_text, concat('pos', CAST(field_position AS STRING), '|len', CAST(least(6, @int(ln(1 + length(field_text)) / 1.2)) AS STRING),
  '|d', CAST(@int({t.share('field_text', t.DIGITS)} * 4) AS STRING), '|u', CAST(@int({t.share('field_text', t.UPPER)} * 4) AS STRING)) AS column_signature
FROM field_values"""),
]



def _with_document(text: str) -> str:
    """A step by grids as one by documents and grids: a grid is of one document, and rows of no grid then don't meet in one task."""
    text = re.sub(r"(\w)\.grid_id = (\w)\.grid_id", r"\1.document_id = \2.document_id AND \1.grid_id = \2.grid_id", text)
    return re.sub(r"((?:SELECT|BY) )((?:\w\.)?)grid_id\b", r"\1\2document_id, \2grid_id", text)


#: Features with the key of running furniture as a column: a sort takes a key that is an expression anew at each comparison. Only documents of three pages have such lines, so others have no key.
_KEYED = """
SELECT /*+ SHUFFLE_HASH(r) */ s.*, count(*) OVER (PARTITION BY s.document_id, shape) AS repetition, r.line IS NOT NULL AS furniture
FROM (SELECT *, CASE WHEN pages >= 3 THEN @casefold(trim(text)) END AS own_line, @int(rel_y0 * 12) AS own_band FROM shaped) s LEFT JOIN recurring r ON s.document_id = r.document_id AND s.own_line = r.line AND s.own_band = r.band"""

#: Percentiles of a document as aggregates: over a window each of its rows would hold them.
_RANGES = """
SELECT document_id, n, CASE WHEN p95 - p5 > 1e-9 THEN p5 ELSE low END AS lo, CASE WHEN p95 - p5 > 1e-9 THEN p95 ELSE high END AS hi, mid FROM (SELECT document_id, count(*) AS n,
  @pct(net, 0.05) AS p5, @pct(net, 0.95) AS p95, min(net) AS low, max(net) AS high, @pct(net, 0.5) AS mid FROM scored GROUP BY document_id) x"""


def _with_doubles(text: str) -> str:
    """Numbers with a point as doubles, which are decimals in Spark: boxes are whole numbers, and what else stays a decimal is a single literal, so that values are the same."""
    return "".join(x if x.startswith("'") else re.sub(r"(?<![\w.])\d+\.\d+(?![\w.])", r"\g<0>D", x) for x in re.findall(r"'[^']*'|[^']+", text))


#: Other texts of steps for Spark alone. What is joined to all rows is hashed, a bucket's share at a time, so that they stay in order.
IN_SPARK: dict[Step, str] = {step: _with_document(step[1]) for step in [*HEADERS, *PAIRS[:2]]} | {FEATURES[3]: _KEYED, CUT[1]: _RANGES}
IN_SPARK[PAIRS[1]] = IN_SPARK[PAIRS[1]].replace("SELECT f.*", "SELECT /*+ SHUFFLE_HASH(k, h) */ f.*", 1)

#: The same: measures without decimals. One of them is a decimal still, since a query returns it as it is.
WITH_DOUBLES: dict[Step, str] = {step: _with_doubles(step[1]).replace(_with_doubles(_RIGHT), _RIGHT) for step in (LINES[-1], *FEATURES[:2], PAIRS[3])}

#: The same: pairs with what forces a split instead of both texts, which nothing else reads of them.
FORCED_EARLY: dict[Step, str] = {
    PAIRS[4]: f"SELECT * EXCEPT (text, a_text) FROM (SELECT *, {FORCED} AS forced_by FROM ({_with_doubles(PAIRS[4][1])}) x) y",
    DECIDE[0]: DECIDE[0][1].replace(FORCED, "forced_by"),
}

TO_UNITS = LINES
TO_FEATURES = LINES + STATS + FEATURES
TO_PAIRS = TO_FEATURES + HEADERS + TERMS + PAIRS
TO_CUTS = TO_PAIRS + WEIGHTS + CUT
TO_DECISIONS = TO_CUTS + DECIDE
TO_CONTENT = TO_DECISIONS + CONTENT
TO_FINGERPRINTS = TO_DECISIONS + FINGERPRINTS
