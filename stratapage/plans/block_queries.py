"""Registered queries of consolidation, sections, search and grouping."""

from __future__ import annotations

import re

from stratapage.functions import text as t
from stratapage.functions.dialect import Step
from stratapage.operators import consolidate as c, sections as x, structured as s
from stratapage.operators.embedding import TERMS

TO_JUDGED = s.TO_CONTENT + c.BLOCKS + c.JUDGE
TO_MERGED = TO_JUDGED + c.CHAINS

#: conversations as blocks of one document each: turns in order, a page each ten turns.
TURNS: list[Step] = [
    ("blocks", """
SELECT CAST(conv_id AS STRING) AS document_id, turn AS seq, @int(turn / 10) + 1 AS page, coalesce(text, '') AS text, 'content' AS block_type, 'P0B1M0' AS signature, CAST(0.2 AS DOUBLE) AS prominence, 0 AS depth, CAST(1 AS DOUBLE) AS lhr,
  CAST(50 AS DOUBLE) AS x0, 40.0 + 20.0 * (turn % 10) AS y0, CAST(550 AS DOUBLE) AS x1, 52.0 + 20.0 * (turn % 10) AS y1, CAST(612 AS DOUBLE) AS pw, CAST(792 AS DOUBLE) AS ph, turn / 1000.0 AS doc_position, CAST(NULL AS STRING) AS table_id, CASE WHEN turn < 0 THEN @list('') END AS cells, false AS heading, 'BODY' AS role, CAST(0 AS DOUBLE) AS rel_x0, CAST(1 AS DOUBLE) AS gap_ratio, CAST(0.5 AS DOUBLE) AS confidence, 'BODY' AS roles
FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn) v"""),
]

#: dense vectors of the embeddings table, one row for each dimension.
DENSE: list[Step] = [
    ("dense", "SELECT vec_id, label, d, CAST(v AS DOUBLE) AS v FROM @explode(embeddings, embedding, d, v)"),
    ("unit", "SELECT vec_id, label, d, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 0) AS v FROM dense"),
    ("centroids", "SELECT label, d, avg(v) AS v FROM unit GROUP BY label, d"),
]

#: The first steps of TERMS over ``asked`` instead of ``units``, then each unit's cosine with it.
_ASKED = {"units": "asked"} | {name: f"asked_{name}" for name, _ in TERMS[:6]}
SEARCH: list[Step] = [
    *((_ASKED[name], re.sub(r"\b(" + "|".join(_ASKED) + r")\b", lambda m: _ASKED[m[0]], text)) for name, text in TERMS[:6]),
    ("asked_weights", "SELECT b.bucket, s * idf AS q FROM asked_bucket_sums b JOIN idf i ON b.bucket = i.bucket"),
    ("asked_length", "SELECT sqrt(sum(q * q)) AS asked_length FROM asked_weights"),
    ("found", "SELECT v.document_id, v.ord, @round(sum(w * q) / max(asked_length), 6) AS score FROM vectors v JOIN asked_weights a ON v.bucket = a.bucket CROSS JOIN asked_length GROUP BY v.document_id, v.ord"),
]
QUESTION = "the station and the thing over there"
SEARCHED = [*s.LINES, *TERMS, ("asked", f"SELECT '?' AS document_id, 0 AS ord, '{QUESTION}' AS text"), *SEARCH]
SEARCH_LAST = "SELECT document_id, ord, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, document_id, ord) AS place FROM found WHERE score >= 0) r WHERE place <= 10"

#: Content units as the units that patterns and groups are found in; for the checking engine the fused likeness of all pairs of a source.
UNITS_OF_CONTENT: list[Step] = [
    ("grouped_units", "SELECT d.source AS collection, CAST(c.document_id AS BIGINT) * 100000 + c.segment AS ord, c.document_id, c.segment, c.text, c.signature, c.roles, f.structure, c.doc_position FROM content_units c JOIN fingerprint_vectors f ON c.document_id = f.document_id AND c.segment = f.segment JOIN documents d ON c.document_id = CAST(d.doc_id AS STRING)"),
]
TO_GROUPED = s.TO_CONTENT + s.FINGERPRINTS + UNITS_OF_CONTENT
_UNIT_TERMS = {"units": "plain_units"} | {name: f"unit_{name}" for name, _ in TERMS[:6]}
FUSED: list[Step] = [
    ("plain_units", "SELECT collection AS document_id, ord, text FROM grouped_units"),
    *((_UNIT_TERMS[name], re.sub(r"\b(" + "|".join(_UNIT_TERMS) + r")\b", lambda m: _UNIT_TERMS[m[0]], text)) for name, text in TERMS[:6]),
    ("unit_vectors", "SELECT b.document_id AS collection, b.ord, b.bucket, s * idf / nullif(sqrt(sum(s * idf * s * idf) OVER (PARTITION BY b.document_id, b.ord)), 0) AS w FROM unit_bucket_sums b JOIN idf i ON b.bucket = i.bucket"),
    ("dense_vectors", "SELECT g.collection, g.ord, list(coalesce(w, 0.0) ORDER BY r.b) AS v FROM (SELECT collection, ord FROM grouped_units) g CROSS JOIN (SELECT unnest(range(0, 512)) AS b) r LEFT JOIN unit_vectors u ON u.collection = g.collection AND u.ord = g.ord AND u.bucket = r.b GROUP BY g.collection, g.ord"),
    ("full_units", f"""SELECT g.*, v, @list({', '.join(f"CAST(@extract(signature, '{k}([0-9]+)', 1) AS DOUBLE)" for k in 'PBM')}) AS counts FROM grouped_units g JOIN dense_vectors d ON g.collection = d.collection AND g.ord = d.ord"""),
    ("compared", f"""
SELECT a.collection, a.ord AS a, b.ord AS b, {t.clip01('@dot(a.v, b.v)')} AS meaning, greatest({t.clip01('@dot(a.structure, b.structure)')}, {t.clip01('@dot(a.counts, b.counts) / greatest(1e-12, sqrt(@dot(a.counts, a.counts) * @dot(b.counts, b.counts)))')}) AS structure, 1.0 - abs(a.doc_position - b.doc_position) AS near
FROM full_units a JOIN full_units b ON a.collection = b.collection AND a.ord < b.ord"""),
    ("fused", "SELECT collection, a, b, CASE WHEN meaning < 0.16 AND structure < 0.9 THEN 0.0 ELSE 0.70 * least(1.0, meaning / 0.33) + 0.18 * structure + 0.12 * near END AS fused FROM compared"),
]
FUSED_LAST = "SELECT collection, unit, count(*) AS partners, @round(avg(fused), 3) AS mean_fused FROM (SELECT collection, a AS unit, fused FROM fused WHERE fused >= 0.6 UNION ALL SELECT collection, b AS unit, fused FROM fused WHERE fused >= 0.6) x GROUP BY collection, unit"
TOP_K_SQL = """
SELECT query_id, row_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS place FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS row_id, floor(list_dot_product(q.v, r.v) / greatest(1e-300, sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v))) * 1e6 + 0.5000001) / 1e6 AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0) q CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) r) x WHERE score >= 0) y WHERE place <= 10"""

#: Consolidated blocks of documents as candidates for headings. This path measures no prominence of heads, so that bar is open.
DOCUMENT_BLOCKS: list[Step] = [
    ("first_units", "SELECT document_id, segment, @argmax(layout, -ord) AS layout, max(depth) AS depth, @argmax(repetition, -ord) AS repetition, max(n_cells) AS n_cells FROM segmented GROUP BY document_id, segment"),
    ("heading_blocks", """
SELECT m.document_id, m.block_no AS ord, '' AS tag, trim(m.text) AS text, f.layout, CAST(0 AS DOUBLE) AS prominence, CAST(1 AS DOUBLE) AS size_ratio, f.depth, f.repetition, m.n_sources AS n_blocks, CASE WHEN @starts(m.roles, 'PROMINENT') THEN 1 ELSE 0 END AS n_prominent,
  CASE WHEN @like(m.roles, 'BODY') THEN 1 ELSE 0 END AS n_body, m.block_type = 'structured_record' AS record, CASE WHEN m.block_type = 'structured_record' THEN f.n_cells ELSE 0 END AS width, m.page
FROM merged_blocks m JOIN first_units f ON m.document_id = f.document_id AND m.first_seq = f.segment"""),
]
TO_DOCUMENT_SECTIONS = TO_MERGED + DOCUMENT_BLOCKS + x.HEADINGS + x.TREE

QUERIES: dict[str, tuple[list[Step], str]] = {
    "document_sections": (TO_DOCUMENT_SECTIONS, "SELECT document_id, section, md5(heading) AS heading_md5, score, parent, depth, item_count, page, end_page, below FROM section_rows"),
    "consolidate_pairs": (TO_JUDGED, "SELECT document_id, seq, coalesce(veto, '') AS veto, merge, " + ", ".join(f"@round({k}, 3) AS {k}" for k in [*c.CONTINUATION, *c.NEW_BLOCK, "continuation", "separation", "confidence"]) + " FROM consolidation_decisions"),
    "merge_chains": (TO_MERGED, "SELECT document_id, block_no, block_id, page, page_end, n_sources, block_type, length(text) AS chars, md5(text) AS text_md5, sources, roles, @round(confidence, 3) AS confidence FROM merged_blocks"),
    "consolidate_turns": (TURNS + c.JUDGE, "SELECT document_id, seq, coalesce(veto, '') AS veto, merge, @round(continuation, 3) AS continuation, @round(separation, 3) AS separation FROM consolidation_decisions"),
    "html_units": (x.HTML, "SELECT document_id, ord, tag, layout, length(text) AS chars, md5(text) AS text_md5 FROM html_units"),
    "headings": (x.TO_HEADS, "SELECT document_id, ord, layout, n_words, heading, score FROM heads"),
    "section_tree": (x.TO_SECTIONS, "SELECT document_id, section, heading, score, parent, depth, item_count FROM sections"),
    "section_members": (x.TO_SECTIONS, "SELECT document_id, ord, coalesce(section, -1) AS section FROM parents WHERE score IS NULL"),
    "section_ends": (x.TO_SECTIONS, "SELECT document_id, section, page, end_page, end_ord AS last_ord, below AS descendants, page_span, @round(confidence) AS confidence FROM section_rows"),
    "section_cutoff": (x.TO_HEADS, "SELECT document_id, @round(least_prominence) AS least_prominence FROM cutoffs"),
    "mid_table_headings": (
        [("heading_blocks", "SELECT CAST(doc_id AS STRING) AS document_id, i AS ord, 'row' AS tag, CASE WHEN i % 5 = 2 THEN concat('Part ', CAST(i AS STRING), ' of ', CAST(doc_id AS STRING)) ELSE 'a cell and its text' END AS text, 'text' AS layout, CAST(0.1 AS DOUBLE) AS prominence, CAST(1 AS DOUBLE) AS size_ratio, CAST(0 AS BIGINT) AS depth, 1 AS repetition, 1 AS n_blocks, 0 AS n_prominent, 1 AS n_body, i % 5 <> 2 AS record, CASE WHEN i % 5 <> 2 THEN 2 + (doc_id + i / 10) % 3 ELSE 0 END AS width, 1 AS page FROM @series((SELECT doc_id FROM documents), 30, i)"), *x.HEADINGS],
        "SELECT document_id, ord, flagged, heading FROM settled WHERE flagged",
    ),
    "collection_tree": (x.TO_SECTIONS, "SELECT document_id, count(*) AS n_sections, @string_list(concat(CAST(depth AS STRING), ':', substr(@replace(heading, '\\s+', ' '), 1, 80)), ' > ', section) AS outline FROM sections GROUP BY document_id"),
    "pattern_centroids": (DENSE, "SELECT label, d, @round(v, 6) AS v FROM centroids"),
    "blocks_by_pattern": (s.TO_CONTENT, "SELECT signature, block_type, count(*) AS n_blocks, count(DISTINCT document_id) AS n_documents, @round(avg(confidence), 3) AS confidence FROM content_units GROUP BY signature, block_type"),
    "provenance": (
        TO_MERGED,
        "SELECT m.document_id, m.block_no, d.lang, d.source, m.page, m.n_sources, m.sources, substr(m.text, 1, 80) AS preview FROM merged_blocks m JOIN documents d ON m.document_id = CAST(d.doc_id AS STRING)",
    ),
    "block_signatures": (s.TO_CONTENT, "SELECT document_id, segment, signature, " + ", ".join(f"CAST(@extract(signature, '{k}([0-9]+)', 1) AS BIGINT) AS {n}" for k, n in (("P", "prominent"), ("B", "body"), ("M", "meta"))) + " FROM content_units"),
    "merged_fields": (TO_MERGED + c.MERGED_FIELDS, "SELECT document_id, block_no, field_position, field_text, n_parts FROM merged_fields"),
    "consolidation_reasons": (TO_JUDGED + c.EXPLAIN, "SELECT document_id, seq, merge, reasons FROM explained"),
    "turn_reasons": (TURNS + c.JUDGE + c.EXPLAIN, "SELECT document_id, seq, merge, reasons FROM explained"),
    "turn_chains": (TURNS + c.JUDGE + c.CHAINS, "SELECT document_id, block_no, block_id, n_sources, sources, roles, @round(confidence, 3) AS confidence, @round(continuation, 3) AS continuation, @round(separation, 3) AS separation, md5(text) AS text_md5 FROM merged_blocks"),
    "blocks_in_section": (x.TO_SECTIONS, "SELECT p.document_id, p.ord, p.section, s.heading FROM parents p JOIN sections s ON p.document_id = s.document_id AND coalesce(p.section, -1) = s.section WHERE p.score IS NULL AND s.depth >= 1"),
}
