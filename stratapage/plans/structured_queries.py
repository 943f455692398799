"""Registered queries of the structured path: steps, and the last step of each query."""

from __future__ import annotations

from stratapage.functions import text as t
from stratapage.functions.dialect import Step
from stratapage.operators import formatting as f, structured as s
from stratapage.operators.embedding import TERMS

_R = s.RELATIONSHIP

QUERIES: dict[str, tuple[list[Step], str]] = {
    "scan_lines": (s.TO_UNITS, "SELECT document_id, count(*) AS n_lines, max(page) AS pages, sum(length(text)) AS chars, count_if(grid_id IS NOT NULL) AS grid_rows FROM units GROUP BY document_id"),
    "char_profile": (s.TO_UNITS, f"SELECT document_id, ord, @round({t.share('text', t.DIGITS)}) AS digit_ratio, @round({t.share('text', t.UPPER)}) AS upper_ratio, @round({t.share('text', t.PUNCTUATION)}) AS punct_ratio, @round({t.share('text', t.SPACE)}) AS space_ratio FROM units"),
    "text_classes": (s.TO_UNITS, f"SELECT {t.first_class('text')} AS first_class, {t.opener_class('text')} AS opener, {t.terminal('text')} AS terminal, {t.open_ended('text')} AS open_ended, count(*) AS n FROM units GROUP BY 1, 2, 3, 4"),
    "token_counts": (s.TO_UNITS, f"SELECT document_id, sum(@size({t.tokens('text')})) AS n_tokens, sum(@size(@extract_all(text, '[A-Za-z0-9]+'))) AS n_ascii_tokens, min({t.first_letter('text')}) AS first_letter FROM units GROUP BY document_id"),
    "grid_cells": (s.TO_UNITS, "SELECT grid_id, ord, @size(cells) AS n_cells, @join(cells, ' / ') AS joined, @size(@keep(cells, c, @like(c, '^[-:| ]*-[-:| ]*$') OR c = '')) AS rule_or_empty FROM units WHERE grid_id IS NOT NULL"),
    "document_slug": ([("named", "SELECT doc_id, concat(' ', source, '/', lang, ' ', substr(text, 1, 12), '.PDF') AS name FROM documents")], f"SELECT doc_id, {t.slug('name')} AS slug FROM named"),
    "strip_markup": ([], f"SELECT page_id, {t.strip_markup('html')} AS text FROM pages"),
    "page_stats": (s.TO_UNITS, "SELECT document_id, page, count(*) AS raw_units, count(DISTINCT grid_id) AS grids, count_if(layout = 'section-header') AS heading_like FROM units GROUP BY document_id, page"),
    "page_limit": (s.TO_UNITS, "SELECT document_id, count(*) AS n_units FROM units WHERE page <= 1 GROUP BY document_id"),
    "doc_stats": (s.LINES + s.STATS, "SELECT document_id, n_units, pages, " + ", ".join(f"@round({c}) AS {c}" for c in ("median_height", "median_gap", "mean_height", "std_height", "median_x0", "median_width", "gap_median", "gap_std")) + " FROM doc_stats"),
    "unit_features": (s.TO_FEATURES, "SELECT document_id, ord, @round(rel_x0) AS rel_x0, @round(rel_width) AS rel_width, @round(rel_y0) AS rel_y0, @round(lhr) AS lhr, @round(gap_ratio) AS gap_ratio, @round(prominence) AS prominence, @round(page_fraction) AS page_fraction, shape FROM features"),
    "shape_repetition": (s.TO_FEATURES, "SELECT document_id, shape, count(*) AS n, min(repetition) AS repetition, max(repetition) >= 3 AS repeated FROM features GROUP BY document_id, shape"),
    "running_furniture": (
        s.TO_UNITS + [
            ("keyed", "SELECT d.source, u.document_id, lower(trim(u.text)) AS line, @int(y0 / ph * 12) AS band, length(u.text) AS chars, -(d.doc_id * 100000 + u.ord) AS d_ord FROM units u JOIN documents d ON u.document_id = CAST(d.doc_id AS STRING)"),
            ("sizes", "SELECT source, count(DISTINCT document_id) AS pages FROM keyed GROUP BY source"),
            ("repeats", "SELECT source, line, band, count(DISTINCT document_id) AS on_pages, @argmax(chars, d_ord) AS chars, count(*) AS n FROM keyed GROUP BY source, line, band"),
        ],
        "SELECT r.source, line, band, on_pages, n FROM repeats r JOIN sizes z ON r.source = z.source WHERE pages >= 3 AND on_pages >= greatest(3, @int(pages * 0.06)) AND chars <= 80",
    ),
    "grid_schema": (
        s.TO_FEATURES + [
            ("cell_rows", "SELECT grid_id, ord, c AS col, v FROM @explode((SELECT grid_id, ord, cells FROM features WHERE grid_id IS NOT NULL), cells, c, v)"),
            ("columns", f"SELECT grid_id, col, avg(length(v)) AS mean_chars, stddev_pop(length(v)) AS std_chars, avg({t.share('v', t.DIGITS)}) AS digits, avg({t.share('v', t.UPPER)}) AS uppers, avg(CASE WHEN trim(v) <> '' THEN 1.0 ELSE 0.0 END) AS fill FROM cell_rows GROUP BY grid_id, col"),
        ],
        f"SELECT grid_id, col, @round(mean_chars, 2) AS mean_chars, @round(1.0 - {t.clip01('std_chars / greatest(1.0, mean_chars)')}, 3) AS stability, @round(digits, 3) AS digit_ratio, @round(uppers, 3) AS upper_ratio, @round(fill, 3) AS fill_ratio FROM columns",
    ),
    "grid_kind": (s.TO_FEATURES + s.PAIRS[:1], "SELECT grid_id, n_rows, @round(consistency) AS consistency, shapes, CASE WHEN repeated_grid THEN 'repeated_grid' WHEN n_rows >= 2 THEN 'grid' ELSE 'single_row_structure' END AS kind FROM grid_kinds"),
    "idf": (s.LINES + TERMS, "SELECT bucket, df, @round(idf, 6) AS idf FROM idf"),
    "hash_embedding": (s.LINES + TERMS, "SELECT document_id, ord, count(*) AS n_buckets, @round(sum(w), 4) AS total, @round(max(abs(w)), 4) AS largest FROM vectors GROUP BY document_id, ord"),
    "pair_signals": (s.TO_PAIRS, "SELECT document_id, ord, " + ", ".join(f"@round({k}) AS {k}" for k in [*s.RELATIONSHIP, *s.BOUNDARY, "discount"]) + " FROM pairs"),
    "informative_weights": (s.TO_PAIRS + s.WEIGHTS, "SELECT document_id, n_pairs, " + ", ".join(f"@round(w_{k}) AS w_{k}" for k in [*s.RELATIONSHIP, *s.BOUNDARY]) + " FROM pair_weights"),
    "adaptive_cut": (s.TO_CUTS, "SELECT document_id, n_pairs, @round(cut, 6) AS cut FROM cuts"),
    "forced_splits": (s.TO_DECISIONS, "SELECT force, count(*) AS n, count_if(split) AS splits FROM decisions GROUP BY force"),
    "boundaries": (s.TO_DECISIONS, "SELECT document_id, ord, @round(relationship) AS relationship, @round(boundary) AS boundary, @round(net) AS net, split, @round(confidence, 3) AS confidence FROM decisions"),
    "over_grouping": (s.TO_PAIRS, f"SELECT document_id, ord, @round(semantic) AS semantic FROM pairs WHERE ({' + '.join(s.FORM)}) / 6.0 >= 0.75 AND semantic < 0.25"),
    "record_boundaries": (s.TO_DECISIONS, "SELECT grid_id, ord, CASE WHEN split THEN 'START_NEW_RECORD' ELSE 'CONTINUE_RECORD' END AS decision FROM decisions WHERE grid_id IS NOT NULL AND a_grid_id = grid_id"),
    "segments": (s.TO_DECISIONS, "SELECT d.lang, count(DISTINCT concat(s.document_id, ':', CAST(segment AS STRING))) AS segments, count(*) AS n_units FROM segmented s JOIN documents d ON s.document_id = CAST(d.doc_id AS STRING) GROUP BY d.lang"),
    "content_units": (s.TO_CONTENT, "SELECT document_id, segment, n_blocks, page, page_end, block_type, length(text) AS chars, signature, @round(confidence, 3) AS confidence, @round(doc_position) AS doc_position FROM content_units"),
    "label_rows": (s.LINES, "SELECT document_id, spot, merges, merged_away, @join(cells, ' / ') AS cells FROM whole_rows"),
    "candidates": (
        [("raw_units", "SELECT CAST(doc_id AS STRING) AS document_id, i AS ord, part AS text, CAST(NULL AS STRING) AS grid_id, CAST(50 AS DOUBLE) AS x0, CAST(40 AS DOUBLE) AS y0, CAST(550 AS DOUBLE) AS x1, CAST(700 AS DOUBLE) AS y1 FROM @explode((SELECT doc_id, @list(text, @replace(text, '(^|\\n)', '\n1. ')) AS parts FROM documents WHERE text IS NOT NULL), parts, i, part)"), *s.CANDIDATES],
        "SELECT document_id, ord, raw_ord, part, splits, length(text) AS chars, @round(y0, 3) AS y0, @round(y1, 3) AS y1 FROM candidates",
    ),
    "grid_headers": (s.TO_FEATURES + s.HEADERS, "SELECT grid_id, ord, @round(deviation, 3) AS deviation, deviation >= 3.0 AS header_like FROM grid_headers"),
    "grid_geometry": (
        s.TO_FEATURES,
        f"""SELECT grid_id, count(*) AS n_rows, @round(1.0 - {t.clip01('stddev_pop(x0) / greatest(1.0, abs(avg(x0)))')}, 3) AS left_edge_stability, @round(1.0 - {t.clip01('stddev_pop(x1 - x0) / greatest(1.0, avg(x1 - x0))')}, 3) AS width_stability,
  @round(1.0 - {t.clip01('stddev_pop(y1 - y0) / greatest(1.0, avg(y1 - y0))')}, 3) AS row_height_stability, @round(avg(y1 - y0), 2) AS mean_row_height, @round(avg(repetition), 2) AS shape_repetition FROM features WHERE grid_id IS NOT NULL GROUP BY grid_id""",
    ),
    "page_furniture": (s.TO_FEATURES, "SELECT document_id, count_if(furniture) AS rejected, count(*) AS n_units FROM features GROUP BY document_id"),
    "unit_fingerprints": (s.TO_FINGERPRINTS, "SELECT document_id, segment, " + ", ".join(f"@round({k}) AS {k}" for k in s.STRUCTURED_DIMENSIONS) + " FROM unit_fingerprints"),
    "fingerprint_vectors": (s.TO_FINGERPRINTS, "SELECT document_id, segment, @join(@map(structure, q, CAST(@int(q * 1000000 + 0.5) AS STRING)), ' ') AS millionths FROM fingerprint_vectors"),
    "record_fields": (s.TO_DECISIONS + s.FIELDS, "SELECT document_id, segment, ord, field_position, field_part, field_text, column_signature FROM fields"),
    "refinements": (s.TO_CONTENT, "SELECT document_id, segment, CASE WHEN n_blocks = 1 THEN 'PRESERVE' ELSE 'MERGE' END AS decision, n_blocks FROM content_units"),
    "span_styles": (f.SPANS + f.FORMATTING, "SELECT document_id, block, ord, bold, italic, mono FROM styled"),
    "block_formatting": (f.SPANS + f.FORMATTING, "SELECT document_id, block, @round(dominant_size, 1) AS dominant_size, max_size, min_size, dominant_font, @round(bold_ratio) AS bold_ratio, @round(italic_ratio) AS italic_ratio, @round(mono_ratio) AS mono_ratio, color, size_variety FROM formatting"),
    "row_boxes": (s.TO_UNITS + f.ROW_BOXES, "SELECT grid_id, ord, x0, x1, @round(y0, 3) AS y0, @round(y1, 3) AS y1 FROM row_boxes"),
    "box_algebra": (
        s.TO_UNITS + [("boxed_pairs", "SELECT * FROM (SELECT document_id, ord, x0, y0, x1, y1, lag(x0) OVER w AS p_x0, lag(y0 + 9) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1 + 9) OVER w AS p_y1 FROM units WINDOW w AS (PARTITION BY document_id ORDER BY ord)) x WHERE p_x0 IS NOT NULL")],
        f"SELECT document_id, ord, @round({f.intersection('', 'p_')}, 3) AS intersection, @round({f.iou('', 'p_')}) AS iou, {f.contains('', 'p_')} AS contains, @round({f.area('')}, 3) AS area FROM boxed_pairs",
    ),
    "heading_contexts": (s.TO_CONTENT + f.CONTEXTS, "SELECT document_id, context, md5(heading) AS heading_md5, page, members, decision, @round(confidence) AS confidence FROM contexts"),
    "low_confidence_events": (s.TO_DECISIONS, "SELECT document_id, ord, 'boundary_evaluated' AS event, 'low_confidence_decision' AS companion, @round(confidence, 3) AS confidence FROM decisions WHERE @round(confidence, 3) < 0.5 OR @round(confidence, 3) BETWEEN 0.5 AND 0.52"),
    "run_stats": (s.TO_DECISIONS, "SELECT count(*) AS n_units, count_if(split) AS n_segments, count(DISTINCT document_id) AS n_documents, count_if(NOT split) AS continued FROM segmented"),
}
