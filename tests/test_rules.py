"""Outcomes stated by hand: markup, headings, native signals, embeddings, patterns, groups, comparisons in blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapage import audit
from stratapage.functions import text as t
from stratapage.functions.dialect import SPARK, render
from stratapage.operators import clustering, embedding, formatting, native, sections, vectors
from stratapage.plans.registry import plan

MARKUP = {
    "a<br>b<br />c": "a b c", "**bold** __x__": "bold x", "<b>x</b> <foo>y</foo>": "x <foo>y</foo>", "<foo a=1>y</foo>": "y</foo>", "<code>z</code>": "<code>z</code>", "<BR/>q": "q", "< p >s</ p >": "s",
    "<!-- c -->k<?x?>": "k", "<>e</>": "e", "1 < 2": "1 < 2", "<platform>/<version>": "<platform>/<version>", "<h1 class='x'>t</h1>": "<h1 class='x'>t</h1>", "<span/x>u": "u", "<new thing>v": "v", "<foo<b>w": "<foo<b>w", "<td >c</TD>": "c", "<a=>n": "n",
}


def test_markup(spark):
    frame = spark.createDataFrame(list(MARKUP.items()), "x string, expected string")
    found = frame.select("x", "expected", F.expr(render(t.strip_markup("x"), SPARK)).alias("found")).collect()
    assert {r.x: r.found for r in found} == MARKUP


def test_bullets(spark):
    frame = spark.createDataFrame([("• one  two • three",), ("none",), ("",)], "x string")
    assert [r[0] for r in frame.select(F.expr(render(t.bullet_parts("x"), SPARK))).collect()] == [["one two", "three"], ["none"], [""]]


#: text, layout, prominence, further columns, whether it is a heading
HEADINGS = [
    ("26.3 Release notes", "text", 0.1, {}, True), ("26. Release notes", "text", 0.1, {}, False), ("3) Steps", "text", 0.1, {}, False), ("Done.", "text", 0.1, {}, False), ("Is it done?", "section-header", 0.9, {}, True), ("Is it all done now?", "section-header", 0.9, {}, False),
    ("Home", "text", 0.1, {}, False), ("Home 2", "text", 0.1, {}, True), ("Home page of this", "text", 0.1, {}, True), ("do it", "text", 0.1, {}, False), ("- item", "text", 0.1, {}, False), ("(Notes)", "text", 0.9, {}, True), ("The following steps apply:", "text", 0.9, {}, False),
    ("Name/Size/Kind of it", "text", 0.1, {}, False), ("A title of many words that goes on and on beyond what a title has room for", "text", 0.1, {}, False), ("Item one here", "list-item", 0.9, {}, False), ("A record row", "text", 0.9, {"record": True, "width": 2}, False),
    ("Running head text", "page-header", 0.9, {"repetition": 3}, False), ("A page title of its own", "page-header", 0.9, {}, True),
]
BLOCK = "document_id string, ord long, tag string, text string, layout string, prominence double, size_ratio double, depth long, repetition long, n_blocks long, n_prominent long, n_body long, record boolean, width long, page long"


def _blocks(spark, rows):
    return spark.createDataFrame([(d, i, "", x, layout, p, more.get("size_ratio", 1.0), 0, more.get("repetition", 1), 1, 0, 1, more.get("record", False), more.get("width", 0), more.get("page", 1)) for d, i, x, layout, p, more in rows], BLOCK)


def test_headings(spark):
    # each in a document of its own, with eight blocks of more prominence that set the bar
    rows = []
    for i, (x, layout, p, more, _) in enumerate(HEADINGS):
        rows.append((str(i), 0, x, layout, p, more))
        rows += [(str(i), j, "a lowercase line that isn't a heading.", "text", 0.5, {}) for j in range(1, 9)]
    found = plan(sections.HEADINGS, "SELECT document_id, heading FROM heads WHERE ord = 0", heading_blocks=_blocks(spark, rows)).collect()
    assert {HEADINGS[int(r.document_id)][0]: r.heading for r in found} == {h[0]: h[4] for h in HEADINGS}


def test_section_tree(spark):
    body = "a lowercase line that isn't a heading."
    table = {"record": True, "width": 3}
    rows = [body, "Major part", body, "Umbrella of these", "Leaf table", ("row", table), ("row", table), "Part inside of the table", ("row", table), "Second major", body, "Twice", body, "Twice"]
    listed = [("d", i, *((x[0], "text", 0.1, x[1]) if isinstance(x, tuple) else (x, "section-header" if "ajor" in x else "text", 0.1, {"page": 1 + i // 6}))) for i, x in enumerate(rows)]
    found = plan([*sections.HEADINGS, *sections.TREE], "SELECT * FROM section_rows", heading_blocks=_blocks(spark, listed)).collect()
    tree = {r.heading: (r.score, r.parent, r.depth, r.item_count, r.below) for r in found}
    # the heading inside the table is an item of the leaf; the label that recurs opens nothing
    assert tree == {"(preamble)": (1000, None, 0, 1, 0), "Major part": (100, None, 0, 1, 2), "Umbrella of these": (55, 1, 1, 0, 1), "Leaf table": (25, 3, 2, 4, 0), "Second major": (100, None, 0, 4, 0)}
    assert {r.heading: r.end_page for r in found}["Umbrella of these"] == 2


def test_native_signals(spark):
    """Two blocks of a page, worked out by hand."""
    schema = "document_id string, ord long, tag string, text string, layout string, chars long, lines long, size double, bold double, x0 double, page long, y0 double, y1 double, x1 double"
    rows = [("d", 0, "p", "alpha beta gamma", "text", 16, 1, 10.0, 0.0, 50.0, 1, 40.0, 52.0, 150.0), ("d", 1, "p", "alpha beta delta", "text", 16, 1, 10.0, 0.0, 50.0, 1, 58.0, 70.0, 150.0), ("d", 2, "h1", "Entirely Other", "section-header", 14, 1, 20.0, 1.0, 50.0, 1, 110.0, 134.0, 150.0)]
    found = {r.ord: r for r in plan([*embedding.TERMS, *native.FEATURES, *native.PAIRS], "SELECT * FROM native_decisions", units=spark.createDataFrame(rows, schema)).collect()}
    near, far = found[1], found[2]
    gap, spread = 23.0, np.std([6.0, 40.0])  # gaps 6 and 40: median 23
    assert near.spatial == pytest.approx(math.exp(-6 / (2.5 * gap))) and near.spacing == pytest.approx(math.exp(-abs(6 - gap) / (spread + gap)))
    assert near.formatting == 1.0 and near.alignment == 1.0 and near.reading == 1.0 and near.containment == 0.0
    std = np.std([10.0, 10.0, 20.0])
    assert far.formatting == pytest.approx(0.35 * (1 - 10 / (3 * std))) and far.n_formatting >= 0.85
    assert far.n_density == 0.55  # sizes 1 and 2 times the median, and a title
    assert far.split and far.n_spacing == pytest.approx(max((40 / gap - 1) / 2.5, 0))
    weights = native.RELATIONSHIP
    assert near.cohesion == pytest.approx(sum(w * float(getattr(near, k)) for k, w in weights.items()))


def test_hashed_embedding_counts_terms():
    texts = ["The cat, the cat", "", None, "ab", "x" * 9]
    for kind in ("md5", "blake2b"):
        sums, seen = embedding.Hasher(kind)(texts)
        for text, row, has in zip(texts, sums, seen, strict=True):
            words = [w.lower() for w in "".join(c if c.isalnum() else " " for c in text or "").split()]
            joined = "".join(words)
            terms = [f"w:{w}" for w in words] + [f"b:{a}_{b}" for a, b in zip(words, words[1:])] + [f"c{n}:{joined[i : i + n]}" for n in (3, 4) for i in range(len(joined) - n + 1)]
            expected, buckets = np.zeros(512), set()
            for term in set(terms):
                bucket, sign = embedding.HASHES[kind](term)
                expected[bucket] += sign * (1 + math.log(terms.count(term)))
                buckets.add(bucket)
            assert row == pytest.approx(expected) and set(np.flatnonzero(has)) == buckets
    signs = [embedding.md5_hash(f"w:{i}")[1] for i in range(100)]
    assert 30 < sum(s > 0 for s in signs) < 70


def _units(spark, n=60):
    rng = np.random.default_rng(3)
    words = ["red", "green", "blue", "stone", "river", "cloud", "seven", "eight"]
    rows = [("ab"[i % 2], i, " ".join(rng.choice(words, rng.integers(1, 6))), f"P{i % 3}B1M0", rng.random(5).tolist(), i / n, None if i % 7 == 0 else int(i % 5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "collection string, ord long, text string, signature string, structure array<double>, doc_position double, pattern long")


def _cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def test_patterns_are_leaders(spark):
    rows, frame = _units(spark)
    found = {r.ord: r.cluster for r in clustering.leader_patterns(frame, threshold=0.8).collect()}
    for name in "ab":
        clusters = []
        for c, i, text, _, structure, _, _ in rows:
            if c != name:
                continue
            m, s = embedding.vectors([text])[0], np.array(structure) / np.linalg.norm(structure)
            scores = [0.28 * max(0, _cosine(x, m)) + 0.72 * max(0, _cosine(y, s)) for x, y, _ in clusters]
            best = int(np.argmax(scores)) if scores else -1
            if best >= 0 and scores[best] >= 0.8:
                x, y, k = clusters[best]
                clusters[best] = ((x * k + m) / (k + 1), (y * k + s) / (k + 1), k + 1)
            else:
                best = len(clusters)
                clusters.append((m, s, 1))
            assert found[i] == best
        assert 1 < len(clusters) < 30


def _fused(a, b):
    meaning = min(1, max(0, _cosine(*embedding.vectors([a[2], b[2]]))))
    counts = [np.array([float(x) for x in (r[3][1], r[3][3], r[3][5])]) for r in (a, b)]
    structure = max(0, _cosine(*counts), _cosine(np.array(a[4]), np.array(b[4])), float(a[6] is not None and a[6] == b[6]))
    return 0.0 if meaning < 0.16 and structure < 0.9 else 0.7 * min(1, meaning / 0.33) + 0.18 * structure + 0.12 * (1 - abs(a[5] - b[5]))


def test_groups_and_fused_pairs(spark, monkeypatch):
    rows, frame = _units(spark)
    pairs = {(r.a, r.b): r.fused for r in clustering.fused_pairs(frame).collect()}
    by = {r[1]: r for r in rows}
    expected = {(a, b): _fused(by[a], by[b]) for a in by for b in by if a < b and by[a][0] == by[b][0]}
    assert pairs == pytest.approx({k: v for k, v in expected.items() if v >= 0.6})
    found = {r.ord: (r.cluster, round(r.likeness, 6)) for r in clustering.leader_groups(frame, threshold=0.75).collect()}
    for name in "ab":
        members, of = [], {}
        for i in (r[1] for r in rows if r[0] == name):
            tried = dict.fromkeys(of[j] for j in of if expected[j, i] >= 0.75)
            means = [(np.mean([expected[j, i] for j in members[c]]), c) for c in tried]
            best = max(means, key=lambda x: x[0], default=(0, -1))
            of[i] = best[1] if best[0] >= 0.75 else len(members)
            if of[i] == len(members):
                members.append([])
            members[of[i]].append(i)
        like = [np.mean([expected[a, b] for a in m for b in m if a < b]) if len(m) > 1 else 1.0 for m in members]
        assert all(found[i] == (c, round(like[c], 6)) for i, c in of.items())


def test_top_k_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    x[7] = x[8]
    rows = spark.createDataFrame([(i, v.tolist() if i != 20 else None) for i, v in enumerate(x)], "row_id long, vector array<double>")
    found = vectors.top_k(rows.where("row_id % 10 = 7").withColumnRenamed("row_id", "query_id"), rows, 4, block=9).collect()
    x[20] = 0
    for q in range(7, 50, 10):
        scores = [(-round(_cosine(x[q], v), 6), i) for i, v in enumerate(x)]
        expected = [i for s, i in sorted(scores)[:4] if -s >= 0]
        assert [r.row_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.place)] == expected


def test_formatting(spark):
    rows = [("d", 1, 0, "Title", 20.04, "Sans-Bold", 0, 5), ("d", 1, 1, "of it", 20.0, "Sans", 2, 7), ("d", 1, 2, "   ", 9.0, "Mono", 0, 1), ("d", 2, 0, "x", 9.0, "A", 16, 3), ("d", 2, 1, "y", 8.0, "B", 8, 3)]
    found = {r.block: r for r in plan(formatting.FORMATTING, "SELECT * FROM formatting", spans=spark.createDataFrame(rows, "document_id string, block long, ord long, text string, size double, font string, flags long, color long")).collect()}
    one, two = found[1], found[2]
    assert (one.dominant_size, one.size_variety, one.dominant_font, one.color, one.max_size) == (20.0, 2, "Sans-Bold", 5, 20.04)
    assert (one.bold_ratio, one.italic_ratio, one.mono_ratio) == pytest.approx((5 / 11, 5 / 11, 1 / 11))
    assert (two.dominant_size, two.dominant_font, two.bold_ratio, two.mono_ratio) == (9.0, "A", 0.5, 0.5)


def test_audit(tmp_path):
    (tmp_path / "finder.py").write_text("import re\n\ndef f(block):\n    if block.y0 > 300 or block.page == 7 or block.size > 2:\n        return re.match('x', block.text)\n    return block.kind in {'warning'}\n")
    (tmp_path / "broken.py").write_text("def (")
    found = audit.audit(tmp_path, {"finder.py"}, {"warning"})
    assert [(f.line, f.kind) for f in found] == [(4, "fixed_coordinate_rule"), (4, "fixed_page_rule"), (5, "regex_structure_discovery"), (6, "hardcoded_semantic_category")]
    assert audit.report(audit.audit(tmp_path))["violations"] == 0
