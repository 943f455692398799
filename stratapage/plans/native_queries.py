"""Registered queries of the native path."""

from __future__ import annotations

from stratapage.functions.dialect import Step
from stratapage.operators import native as n

QUERIES: dict[str, tuple[list[Step], str]] = {
    "native_stats": (n.TO_PAIRS, "SELECT document_id, total, " + ", ".join(f"@round({k}) AS {k}" for k in ("min_size", "max_size", "median_block_height", "median_block_width", "median_x0", "bold_ratio", "median_page_width", "median_page_height")) + ", @round(mean_size) AS mean_size, @round(std_size) AS std_size, @round(median_size) AS median_size, @round(gap_median) AS gap_median, @round(gap_std) AS gap_std FROM native_stats"),
    "native_features": (n.TO_PAIRS, "SELECT document_id, ord, @round(z) AS z, @round(size_ratio) AS size_ratio, short, @round(gap_above) AS gap_above, @round(density) AS density, col, @round(prominence) AS prominence, @round(page_fraction) AS page_fraction, @round(gap_under) AS gap_under, left_aligned, @round(area) AS area, @round(rel_x) AS rel_x, @round(rel_y) AS rel_y, is_head, is_title, is_body FROM classed"),
    "native_relationship": (n.TO_PAIRS, "SELECT document_id, ord, " + ", ".join(f"@round({k}) AS {k}" for k in [*n.RELATIONSHIP, "cohesion"]) + " FROM native_pairs"),
    "native_boundary": (n.TO_PAIRS, "SELECT document_id, ord, " + ", ".join(f"@round({k}) AS {k}" for k in [*n.BOUNDARY, "score"]) + ", split, @round(confidence, 3) AS confidence FROM native_decisions"),
    "native_reasons": (n.TO_PAIRS, "SELECT document_id, ord, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in n.REASONS) + ") AS reasons FROM native_decisions"),
    "native_unit_rows": (n.TO_UNITS, "SELECT document_id, unit, n_blocks, page, page_end, roles, signature, chars, line_count, length(text) AS text_chars, @round(head_prominence, 3) AS head_prominence, @round(mean_prominence, 3) AS mean_prominence, @round(confidence) AS confidence FROM native_units"),
    "native_fingerprints": (n.TO_UNITS, "SELECT document_id, unit, " + ", ".join(f"@round({k}) AS {k}" for k in (*n.NATIVE_DIMENSIONS, "alignment_spread", "left_spread_norm", "mean_body_size_ratio", "page_number_norm", "boundary_max", "mean_spatial")) + " FROM native_units"),
    "fallback_structure": (n.TO_UNITS, "SELECT document_id, unit, role_prominent, role_body, role_meta, @round(ln(1.0 + block_count)) AS blocks_log, @round(least(3.0, head_size_ratio)) AS head_size FROM native_units"),
    "native_blocks": (n.TO_BLOCKS, "SELECT document_id, block, n_sides, first_ord, was_split, sources, @round(confidence) AS confidence FROM native_blocks"),
    "native_split": (n.TO_SPLITS, "SELECT document_id, run, n, valley, @round(cohesion) AS cohesion, cut FROM native_splits"),
    "native_merge": (n.TO_MERGES, "SELECT document_id, ord FROM native_merges"),
}
