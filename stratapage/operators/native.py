"""Native path: weighted relationships, fixed thresholds, block split and merge.

Works on units with boxes and prominence (here HTML units with synthetic
boxes); every pair is judged from its two units and the document's statistics.
"""

from __future__ import annotations

from stratapage.functions import text as t
from stratapage.functions.dialect import Step
from stratapage.operators.embedding import TERMS
from stratapage.operators.sections import HTML

RELATIONSHIP = {"semantic": 0.24, "spatial": 0.22, "formatting": 0.16, "alignment": 0.14, "spacing": 0.10, "reading": 0.10, "containment": 0.04}
BOUNDARY = {"n_semantic": 0.26, "n_structural": 0.18, "n_formatting": 0.15, "n_spacing": 0.14, "n_table": 0.12, "n_alignment": 0.07, "n_reading": 0.05, "n_density": 0.03}
SCALE, DECAY = 0.33, 2.5
COHESION, SCORE, GATE = 0.45, 0.48, 0.22
#: Mean semantic coherence below which a unit is doubted; containment that explains a group; cohesion that merges blocks; what a unit of one block is worth.
DOUBT, CONTAINER, MERGE_COHESION, ALONE = 0.25, 0.55, 0.92, 0.45

UNITS: list[Step] = [
    # a heading's letters are 20 points high, others 11; items are set in; 90 letters a line, 40 units a page
    ("boxed", """
SELECT document_id, ord, tag, text, layout, length(text) AS chars, 1 + @int(length(text) / 90) AS lines, CAST(CASE WHEN tag = 'h1' THEN 20 WHEN layout = 'section-header' THEN 15 ELSE 11 END AS DOUBLE) AS size, CAST(CASE WHEN layout = 'section-header' THEN 1 ELSE 0 END AS DOUBLE) AS bold,
  CAST(CASE WHEN layout = 'list-item' THEN 70 ELSE 50 END AS DOUBLE) AS x0, @int(ord / 40) + 1 AS page FROM html_units"""),
    ("stacked", "SELECT *, coalesce(sum(lines * size * 1.2 + 6.0) OVER (PARTITION BY document_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) + 40.0 AS y0 FROM boxed"),
    ("units", "SELECT *, y0 + lines * size * 1.2 AS y1, x0 + least(500.0, chars * size * 0.5) AS x1 FROM stacked"),
]

FEATURES: list[Step] = [
    ("spaced", "SELECT *, CASE WHEN lag(page) OVER w = page THEN greatest(0.0, y0 - lag(y1) OVER w) END AS gap, CASE WHEN lead(page) OVER w = page THEN greatest(0.0, (lead(y0) OVER w) - y1) END AS gap_below FROM units WINDOW w AS (PARTITION BY document_id ORDER BY ord)"),
    ("native_stats", """
SELECT document_id, count(*) AS total, avg(size) AS mean_size, min(size) AS min_size, max(size) AS max_size, coalesce(nullif(stddev_pop(size), 0), 1.0) AS std_size, @pct(size, 0.5) AS median_size, @pct(y1 - y0, 0.5) AS median_block_height, @pct(x1 - x0, 0.5) AS median_block_width, @pct(x0, 0.5) AS median_x0,
  coalesce(nullif(@pct(gap, 0.5), 0), 6.0) AS gap_median, coalesce(nullif(stddev_pop(gap), 0), 4.0) AS gap_std, avg(bold) AS bold_ratio, CAST(612 AS DOUBLE) AS median_page_width, CAST(792 AS DOUBLE) AS median_page_height FROM spaced GROUP BY document_id"""),
    ("native_features", f"""
SELECT s.*, gap_median, gap_std, std_size, total, (size - mean_size) / std_size AS z, size / median_size AS size_ratio, chars <= 60 AS short, coalesce(gap, gap_median) / gap_median AS gap_above, chars / greatest(1.0, (x1 - x0) * (y1 - y0)) AS density, least(2, @int((x0 + x1) / 2 / 612 * 3)) AS col,
  (ord + 1) / CAST(total AS DOUBLE) AS page_fraction, coalesce(gap_below, gap_median) / gap_median AS gap_under, abs(x0 - median_x0) <= 3.0 AS left_aligned, (x1 - x0) * (y1 - y0) AS area, x0 / 612.0 AS rel_x, y0 / 792.0 AS rel_y, (x0 + x1) / 2 / 612.0 AS rel_cx,
  0.5 * greatest(0.0, (size - mean_size) / std_size) + 0.9 * bold + CASE WHEN chars <= 60 THEN 0.4 ELSE 0.0 END + 0.8 * greatest(0.0, size / median_size - 1) AS prominence
FROM spaced s JOIN native_stats d ON s.document_id = d.document_id"""),
    ("classed", """
SELECT *, (bold > 0.5 OR size_ratio > 1.08 OR z > 0.6) AND (short OR lines <= 2) AS is_head, short AND chars <= 100 AND lines <= 3 AND NOT @like(text, '[.?;,]$') AS is_title, chars >= 70 OR lines >= 3 OR (NOT short AND prominence < 0.6) AS is_body FROM native_features"""),
]

_COLUMNS = ("ord", "page", "size", "size_ratio", "bold", "prominence", "x0", "y0", "x1", "y1", "chars", "lines", "short", "col", "density", "is_head", "is_title", "is_body")
_OVERLAP = "(greatest(0.0, least(x1, p_x1) - greatest(x0, p_x0)) * greatest(0.0, least(y1, p_y1) - greatest(y0, p_y0)))"
_INSIDE = "({a}x0 - 1 <= {b}x0 AND {a}y0 - 1 <= {b}y0 AND {a}x1 + 1 >= {b}x1 AND {a}y1 + 1 >= {b}y1)"
_CONTAINED = f"CASE WHEN {_INSIDE.format(a='p_', b='')} OR {_INSIDE.format(a='', b='p_')} THEN 1.0 ELSE {_OVERLAP} / greatest(1e-9, (x1 - x0) * (y1 - y0) + (p_x1 - p_x0) * (p_y1 - p_y0) - {_OVERLAP}) END"
#: A bold block of several lines, or of names with slashes: the head of a table.
_TABLE_HEAD = "(bold >= 0.4 AND (length(text) - length(@replace(text, '/', '')) >= 2 OR @size(@keep(@split(text, '\\n'), q, trim(q) <> '')) >= 3) AND chars <= 200)"
_STRONG = f"(containment >= {CONTAINER} AND semantic < {GATE})"

PAIRS: list[Step] = [
    ("native_adjacent", f"SELECT * FROM (SELECT c.document_id, gap_median, gap_std, std_size, gap_above, text, {', '.join(_COLUMNS)}, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in _COLUMNS)} FROM classed c WINDOW w AS (PARTITION BY document_id ORDER BY ord)) x WHERE p_ord IS NOT NULL"),
    ("native_measured", f"""
SELECT a.*, greatest(0.0, y0 - p_y1) AS g, prominence - p_prominence AS jump, coalesce(cosine, 0.0) AS cosine,
  greatest({t.clip01('1.0 - abs(x0 - p_x0) / (0.08 * 612)')}, {t.clip01('1.0 - abs(x0 + x1 - p_x0 - p_x1) / 2 / (0.08 * 612)')}) AS alignment FROM native_adjacent a LEFT JOIN neighbours n ON a.document_id = n.document_id AND a.ord = n.ord"""),
    # blocks of two pages are never compared across the break in space; all of one page are
    ("native_signals", f"""
SELECT *, exp(-g / ({DECAY} * greatest(0.001, gap_median))) AS spatial, CASE WHEN jump > 0.4 THEN 0.35 * {t.clip01('1.0 - ' + t.clip01('abs(size - p_size) / (3.0 * std_size)'))} ELSE 0.55 + 0.45 * {t.clip01('1.0 - ' + t.clip01('abs(size - p_size) / (3.0 * std_size)'))} END AS formatting,
  exp(-abs(g - gap_median) / greatest(0.001, gap_std + gap_median)) AS spacing, CASE WHEN page = p_page THEN 0.5 * CASE WHEN ord = p_ord + 1 THEN 1.0 ELSE 0.5 END + 0.5 * CASE WHEN col = p_col THEN 1.0 ELSE 0.4 END ELSE 0.0 END AS reading,
  {t.clip01(f'cosine / {SCALE}')} AS semantic, {_CONTAINED} AS containment FROM native_measured"""),
    ("native_pairs", f"""
SELECT *, {t.clip01('(' + ' + '.join(f'{w} * {k}' for k, w in RELATIONSHIP.items()) + f') / {sum(RELATIONSHIP.values()):.4f}')} AS cohesion,
  greatest({t.clip01('greatest(0.0, jump) / 1.2')}, CASE WHEN is_head AND jump > 0.35 THEN 0.85 ELSE 0.0 END) AS n_formatting, greatest({t.clip01('(gap_above - 1) / 2.5')}, CASE WHEN gap_above >= 1.8 THEN 0.75 ELSE 0.0 END) AS n_spacing,
  greatest(1.0 - semantic, CASE WHEN semantic < {GATE} AND spatial >= 0.75 AND formatting >= 0.7 THEN 0.82 WHEN semantic < {GATE} * 0.7 THEN 0.65 ELSE 0.0 END) AS n_semantic,
  greatest(CASE WHEN p_is_body AND is_title THEN 0.88 ELSE 0.0 END, CASE WHEN is_title AND gap_above >= 1.3 THEN 0.72 ELSE 0.0 END, CASE WHEN is_title AND semantic < {GATE} AND p_chars >= 40 THEN 0.78 ELSE 0.0 END,
    CASE WHEN p_is_title AND p_chars <= 90 AND {_TABLE_HEAD} THEN 0.90 ELSE 0.0 END) AS n_structural,
  greatest(1.0 - alignment, CASE WHEN alignment < 0.25 AND (semantic < 0.25 OR gap_above >= 1.8 OR (gap_above - 1) / 2.5 > 0.4) THEN 0.55 ELSE 0.0 END) AS n_alignment,
  greatest(CASE WHEN ord - p_ord > 1 THEN {t.clip01('0.4 + 0.2 * (ord - p_ord - 1)')} ELSE 0.0 END, CASE WHEN col <> p_col AND semantic < 0.3 THEN 0.45 ELSE 0.0 END) AS n_reading,
  greatest({t.clip01('abs(density - p_density) / greatest(density, p_density, 1e-6) / 2')}, CASE WHEN abs(size_ratio - p_size_ratio) > 0.35 AND is_title THEN 0.55 ELSE 0.0 END) AS n_density,
  CASE WHEN short AND p_short AND alignment >= 0.7 AND semantic < {GATE} AND spatial >= 0.7 THEN 0.82 WHEN p_is_body AND is_title AND spatial >= 0.85 AND semantic < 0.35 THEN 0.75 ELSE 0.0 END AS n_table
FROM native_signals"""),
    ("native_boundaries", f"SELECT *, {t.clip01(' + '.join(f'{w} * {k}' for k, w in BOUNDARY.items()))} AS score, {_STRONG} AS held FROM native_pairs"),
    # a container that holds both keeps them together in spite of weak semantics, unless form says otherwise
    ("native_judged", f"SELECT *, (score >= {SCORE} OR cohesion < {COHESION} OR (containment < {CONTAINER} AND spatial >= 0.8 AND formatting >= 0.85 AND semantic < {GATE})) AND (NOT held OR n_formatting >= 0.7 OR n_structural >= 0.85 OR n_table >= 0.7 OR gap_above >= 2.2) AS split FROM native_boundaries"),
    ("native_decisions", f"SELECT *, CASE WHEN split THEN {t.clip01('0.55 * score + 0.45 * (1.0 - cohesion)')} ELSE {t.clip01('0.55 * cohesion + 0.45 * (1.0 - score)')} END AS confidence FROM native_judged"),
]

#: Reasons of a boundary, in order.
REASONS = (
    ("formatting_transition", "is_head AND jump > 0.35"), ("spacing_boundary", "gap_above >= 1.8"), ("semantic_transition", f"(semantic < {GATE} AND spatial >= 0.75 AND formatting >= 0.7) OR semantic < {GATE} * 0.7"),
    ("structural_transition", f"(p_is_body AND is_title) OR (is_title AND semantic < {GATE} AND p_chars >= 40)"), ("title_like_after_whitespace", "is_title AND gap_above >= 1.3 AND NOT p_is_body"),
    ("title_then_column_header", f"p_is_title AND p_chars <= 90 AND {_TABLE_HEAD}"), ("alignment_pattern_change", "alignment < 0.25 AND (semantic < 0.25 OR n_spacing > 0.4)"), ("reading_order_discontinuity", "ord - p_ord > 1"),
    ("table_or_list_row_boundary", "n_table > 0"), ("cohesion_below_threshold", f"cohesion < {COHESION}"), ("over_grouping_semantic_gate", f"containment < {CONTAINER} AND spatial >= 0.8 AND formatting >= 0.85 AND semantic < {GATE}"),
)

#: Contiguous runs, and within those of three or more the weakest joint.
SPLIT: list[Step] = [
    ("native_runs", "SELECT c.document_id, c.ord, c.page, c.chars, d.cohesion, d.score, d.semantic, sum(CASE WHEN coalesce(d.split, true) OR d.page <> d.p_page THEN 1 ELSE 0 END) OVER (PARTITION BY c.document_id ORDER BY c.ord ROWS UNBOUNDED PRECEDING) AS run, coalesce(d.split, true) OR d.page <> d.p_page AS starts FROM classed c LEFT JOIN native_decisions d ON c.document_id = d.document_id AND c.ord = d.ord"),
    ("run_sizes", "SELECT document_id, run, count(*) AS n, @filtered(avg(cohesion), NOT starts) AS mean_cohesion, @filtered(avg(semantic), NOT starts) AS mean_semantic FROM native_runs GROUP BY document_id, run"),
    ("joints", "SELECT r.document_id, r.run, n, mean_cohesion, mean_semantic, @argmax(ord, @round(-(cohesion - 0.6 * score + 0.4 * semantic), 9), -ord) AS valley FROM native_runs r JOIN run_sizes z ON r.document_id = z.document_id AND r.run = z.run WHERE n >= 3 AND NOT starts GROUP BY r.document_id, r.run, n, mean_cohesion, mean_semantic"),
    ("native_splits", f"SELECT j.document_id, j.run, j.n, valley, d.cohesion, d.cohesion < j.mean_cohesion - 0.22 OR (d.semantic < {GATE} AND j.mean_semantic < {DOUBT} AND d.score >= {SCORE} * 0.85) AS cut FROM joints j JOIN native_decisions d ON j.document_id = d.document_id AND j.valley = d.ord"),
]

#: Neighbouring blocks that belong together, pair by pair from the left: every other of a run of such joints.
MERGE: list[Step] = [
    ("mergeable", f"SELECT document_id, ord, NOT split AND page = p_page AND cohesion >= {MERGE_COHESION} AND score < {SCORE} * 0.7 AND semantic >= {DOUBT} AS ok FROM native_decisions"),
    ("joint_runs", "SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM mergeable"),
    ("native_merges", "SELECT document_id, ord FROM (SELECT document_id, ord, row_number() OVER (PARTITION BY document_id, run ORDER BY ord) AS place FROM joint_runs WHERE ok) x WHERE place % 2 = 1"),
]

#: Units of ``unit_rows`` (document_id, ord, unit): heads, roles, confidence, structural fingerprints.
FINISH: list[Step] = [
    ("unit_members", "SELECT u.unit, c.*, d.cohesion, d.semantic, d.spatial, d.containment, d.score, lag(c.ord) OVER w AS before, lag(c.y1) OVER w AS y1_before FROM unit_rows u JOIN classed c ON u.document_id = c.document_id AND u.ord = c.ord LEFT JOIN native_decisions d ON c.document_id = d.document_id AND c.ord = d.ord WINDOW w AS (PARTITION BY c.document_id, u.unit ORDER BY c.ord)"),
    ("unit_heads", "SELECT document_id, unit, @argmax(ord, prominence, -ord) AS head, max(prominence) AS top FROM unit_members GROUP BY document_id, unit"),
    ("unit_roles", "SELECT m.*, m.ord = h.head AS is_lead, CASE WHEN m.ord = h.head THEN 'PROMINENT' WHEN m.short AND m.prominence <= 0.25 * (h.top + 1e-6) AND m.chars <= 40 THEN 'META' ELSE 'BODY' END AS role FROM unit_members m JOIN unit_heads h ON m.document_id = h.document_id AND m.unit = h.unit"),
    ("unit_sums", """
SELECT document_id, unit, count(*) AS n_blocks, min(ord) AS first_ord, min(page) AS page, max(page) AS page_end, @string_list(text, chr(10), ord) AS text, @string_list(role, ',', ord) AS roles, sum(chars) AS chars, sum(lines) AS line_count,
  count_if(role = 'PROMINENT') AS role_prominent, count_if(role = 'BODY') AS role_body, count_if(role = 'META') AS role_meta, max(CASE WHEN is_lead THEN prominence END) AS head_prominence, avg(prominence) AS mean_prominence, max(CASE WHEN is_lead THEN size_ratio END) AS lead_size_ratio,
  @filtered(avg(cohesion), before IS NOT NULL) AS internal, @filtered(min(cohesion), before IS NOT NULL) AS weakest, @filtered(avg(semantic), before IS NOT NULL) AS mean_semantic, @filtered(avg(spatial), before IS NOT NULL) AS mean_spatial, @filtered(avg(containment), before IS NOT NULL) AS mean_containment,
  @filtered(avg(score), before IS NOT NULL) AS boundary_mean, @filtered(max(score), before IS NOT NULL) AS boundary_max, stddev_pop(rel_cx) AS cx_spread, stddev_pop(x0) AS left_spread, @filtered(avg(greatest(0.0, y0 - y1_before)), before IS NOT NULL) AS gap_mean, @filtered(stddev_pop(greatest(0.0, y0 - y1_before)), before IS NOT NULL) AS gap_spread,
  max(size_ratio) AS head_size_ratio, stddev_pop(size_ratio) AS size_spread, coalesce(@filtered(avg(size_ratio), role <> 'PROMINENT'), avg(size_ratio)) AS mean_body_size_ratio, avg(bold) AS mean_bold, avg(density) AS content_density, count(DISTINCT col) / 3.0 AS column_diversity, @argmax(page_fraction, -ord) AS local_position
FROM unit_roles GROUP BY document_id, unit"""),
    ("native_units", f"""
SELECT *, concat('P', CAST(role_prominent AS STRING), 'B', CAST(role_body AS STRING), 'M', CAST(role_meta AS STRING)) AS signature, CASE WHEN cx_spread < 0.04 THEN 1.0 WHEN cx_spread < 0.12 THEN 0.6 ELSE 0.2 END AS alignment_signature,
  CASE WHEN gap_mean IS NULL THEN 0.5 ELSE {t.clip01('1.0 - gap_spread / (gap_mean + 0.001) / 3.0')} END AS spacing_signature, {t.clip01('0.4 * least(2.0, head_size_ratio) / 2.0 + 0.3 * mean_bold + 0.3 * (1.0 - least(1.0, size_spread))')} AS typography_signature, ln(1.0 + chars) AS char_count_log, page / 100.0 AS page_number_norm,
  {t.clip01('cx_spread * 5.0')} AS alignment_spread, {t.clip01('left_spread / 80.0')} AS left_spread_norm, CASE WHEN weakest < {COHESION} THEN least(doubted, 0.5 * doubted + 0.5 * weakest) ELSE doubted END AS confidence
FROM (SELECT *, n_blocks AS block_count, CASE WHEN n_blocks = 1 THEN {ALONE} WHEN mean_semantic < {DOUBT} AND mean_containment < {CONTAINER} THEN greatest(0.15, internal * (1.0 - 0.55 * ({DOUBT} - mean_semantic) / {DOUBT})) ELSE internal END AS doubted FROM unit_sums) x"""),
]

#: Native dimensions of a fingerprint's vector.
NATIVE_DIMENSIONS = (
    "role_prominent", "role_body", "role_meta", "block_count", "alignment_signature", "spacing_signature", "typography_signature", "content_density", "column_diversity", "head_size_ratio", "mean_semantic", "boundary_mean", "char_count_log", "local_position",
)

#: Units as logical blocks: split at the weakest joint of three or more, then neighbours merged two by two.
BLOCKS: list[Step] = [
    ("unit_joints", "SELECT u.document_id, u.unit, u.ord, d.cohesion, d.score, d.semantic, d.split, lag(u.ord) OVER (PARTITION BY u.document_id, u.unit ORDER BY u.ord) AS before FROM unit_rows u LEFT JOIN native_decisions d ON u.document_id = d.document_id AND u.ord = d.ord"),
    ("unit_valleys", "SELECT document_id, unit, count(*) + 1 AS n, avg(cohesion) AS mean_cohesion, avg(semantic) AS mean_semantic, @argmax(ord, @round(-(cohesion - 0.6 * score + 0.4 * semantic), 9), -ord) AS valley FROM unit_joints WHERE before IS NOT NULL GROUP BY document_id, unit HAVING count(*) >= 2"),
    ("unit_cuts", f"SELECT v.document_id, v.unit, v.valley FROM unit_valleys v JOIN native_decisions d ON v.document_id = d.document_id AND v.valley = d.ord WHERE d.split OR d.cohesion < v.mean_cohesion - 0.22 OR (d.semantic < {GATE} AND v.mean_semantic < {DOUBT} AND d.score >= {SCORE} * 0.85)"),
    ("cut_rows", "SELECT u.document_id, u.ord, u.unit, CASE WHEN c.valley IS NULL THEN 'whole' WHEN u.ord < c.valley THEN 'a' ELSE 'b' END AS side, dense_rank() OVER (PARTITION BY u.document_id ORDER BY u.unit, CASE WHEN u.ord >= c.valley THEN 1 ELSE 0 END) AS block_no FROM unit_rows u LEFT JOIN unit_cuts c ON u.document_id = c.document_id AND u.unit = c.unit"),
    ("block_firsts", "SELECT document_id, block_no, min(ord) AS ord FROM cut_rows GROUP BY document_id, block_no"),
    ("block_joints", "SELECT f.document_id, f.block_no, coalesce(m.ok, false) AS ok FROM block_firsts f LEFT JOIN mergeable m ON f.document_id = m.document_id AND f.ord = m.ord"),
    ("block_runs", "SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM block_joints"),
    ("block_merges", "SELECT document_id, block_no, ok AND row_number() OVER (PARTITION BY document_id, run, ok ORDER BY block_no) % 2 = 1 AS merged FROM block_runs"),
    ("final_rows", "SELECT r.document_id, r.ord, r.unit, r.side, sum(CASE WHEN m.merged OR r.ord <> f.ord THEN 0 ELSE 1 END) OVER (PARTITION BY r.document_id ORDER BY r.ord ROWS UNBOUNDED PRECEDING) AS block FROM cut_rows r JOIN block_merges m ON r.document_id = m.document_id AND r.block_no = m.block_no JOIN block_firsts f ON r.document_id = f.document_id AND r.block_no = f.block_no"),
    ("side_joints", "SELECT r.document_id, r.block, r.unit, r.side, r.ord, d.cohesion, d.semantic, lag(r.ord) OVER (PARTITION BY r.document_id, r.unit, r.side ORDER BY r.ord) AS before FROM final_rows r LEFT JOIN native_decisions d ON r.document_id = d.document_id AND r.ord = d.ord"),
    ("side_sums", "SELECT document_id, block, unit, side, min(ord) AS first_ord, @filtered(avg(cohesion), before IS NOT NULL) AS mean_cohesion, @filtered(avg(semantic), before IS NOT NULL) AS mean_semantic FROM side_joints GROUP BY document_id, block, unit, side"),
    ("side_worth", f"SELECT s.*, CASE WHEN s.side = 'whole' THEN u.confidence WHEN s.mean_cohesion IS NULL THEN {ALONE} WHEN s.mean_semantic < {DOUBT} THEN greatest(0.15, s.mean_cohesion * 0.7) ELSE s.mean_cohesion END AS worth, coalesce(d.cohesion, 1.0) AS joint, row_number() OVER (PARTITION BY s.document_id, s.block ORDER BY s.first_ord) AS place FROM side_sums s JOIN native_units u ON s.document_id = u.document_id AND s.unit = u.unit LEFT JOIN native_decisions d ON s.document_id = d.document_id AND s.first_ord = d.ord"),
    ("native_blocks", "SELECT document_id, block, count(*) AS n_sides, min(first_ord) AS first_ord, CASE WHEN count(*) = 1 THEN max(worth) ELSE least(min(worth), @filtered(min(joint), place > 1)) END AS confidence, max(CASE WHEN side <> 'whole' THEN 1 ELSE 0 END) AS was_split, @string_list(concat(CAST(unit AS STRING), '/', side), ',', first_ord) AS sources FROM side_worth GROUP BY document_id, block"),
]

TO_PAIRS = HTML + UNITS + TERMS + FEATURES + PAIRS
TO_SPLITS = TO_PAIRS + SPLIT
TO_MERGES = TO_PAIRS + MERGE
#: Runs between splits and pages as units, as far as no run is long enough to be capped (see clustering.capped_units).
PLAIN_UNITS: list[Step] = [("unit_rows", "SELECT document_id, ord, run AS unit FROM native_runs")]
TO_UNITS = TO_SPLITS + PLAIN_UNITS + FINISH
TO_BLOCKS = TO_UNITS + MERGE + BLOCKS
