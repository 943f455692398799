from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from stratapage.llm import suffixes

SCHEMA = "doc_id long, text string, low string, ranges string, n_chars long"


def _expected(rows, length):
    """Of rows in order; those of equal id and text are one document."""
    seen, out = set(), {}
    for doc, text in dict.fromkeys(rows):
        raw = (text or "").encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(window)
        left = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (not i or not hit[i - 1]))
        out[doc, text] = (len(raw), sum(hit), runs, hashlib.sha256(left).hexdigest())
    return out


def _corpus(seed=5):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abc é") for _ in range(rng.randint(90, 260))) for _ in range(5)]
    rows = []
    for doc in range(40):
        parts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passage))
        rows.append((doc, "".join(parts)))
    return rows + [(50, "a" * 400), (51, "ab" * 300), (52, "a" * 400), (53, ""), (54, None), (55, "x" * 99), (56, rows[3][1])]


@pytest.mark.parametrize("piece", [suffixes.PIECE, 2])
def test_same_as_windows(spark, monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "HOT", 3)
    rows = sorted(_corpus(), key=lambda r: r[0])
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digest(frame, 100).collect()}
    assert found == {d: v for (d, _), v in _expected(rows, 100).items()}


def test_pieces_read_intervals(monkeypatch):
    """The query's pieces go through the stack scan of common-prefix intervals."""
    called = []
    plain = suffixes.common_prefix_intervals
    monkeypatch.setattr(suffixes, "common_prefix_intervals", lambda *x: called.append(1) or plain(*x))
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abcdefgh") for _ in range(120))
    rows = [(7, 1, 0, 10, b"x" * 30 + shared + b"y"), (7, 2, 0, 0, b"q" + shared + b"zz"), (7, 2, 5, 40, shared)]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.binary()], strict=True)], ["anchor", "doc", "alt", "start", "bytes"])
    found = suffixes._piece([batch], 100).to_pylist()
    assert called and found == [{"doc": 2, "alt": 0, "low": 1, "high": 121}, {"doc": 2, "alt": 5, "low": 40, "high": 160}]


def test_null_and_repeated_ids_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(3))
    rows = [(1, a), (1, b + "!"), (2, c), (None, a + "?"), (None, "".join(rng.choice("xyzw") for _ in range(200))), (None, b + c), (5, b), (5, b)]
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    key = spark.createDataFrame(rows, "d long, t string").selectExpr("d", "t", "xxhash64(t) AS h").collect()
    ordered = [(r.d, r.t) for r in sorted(key, key=lambda r: (r.d is None, r.d or 0, r.h))]
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digest(frame, 100).collect())
    expected = _expected(ordered, 100)
    assert found == sorted((d or 0, *expected[d, t]) for d, t in rows)


def test_long_text(spark):
    rng = random.Random(10)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long), (2, "x" * 50 + long[700_000:701_000] + long[2_000_000:2_000_150])]
    frame = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.n_removed) for r in suffixes.removal_digest(frame, 100).collect()) == [(1, 0), (2, 1150)]


def test_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklm") for _ in range(150)) + "é" * 30  # holds no window twice
    frame = spark.createDataFrame([(1, text, "", "", 180), (1, text, "", "", 180), (2, text + "ü", "", "", 181), (None, text, "", "", 180), (3, " ", "", "", 1), (4, None, "", "", None)], SCHEMA)
    found = sorted((r.doc_id or 99, r.n_removed) for r in suffixes.removal_digest(frame).collect())
    assert found == [(1, 0), (1, 0), (2, len(text.encode())), (3, 0), (4, 0), (99, len(text.encode()))]
    kept = {(r.doc_id, r.text, r.n_chars) for r in suffixes.remove_repeats(frame).collect()}
    assert kept == {(1, text, 180), (2, "ü", 1), (3, " ", 1), (4, None, None)}
    assert suffixes.remove_repeats(frame).columns == frame.columns
    assert suffixes.removal_digest(frame.limit(0)).count() == 0


def _maximal(items, shortest):
    places = {}
    for i, item in enumerate(items):
        for a in range(len(item)):
            for b in range(a + shortest, len(item) + 1):
                places.setdefault(item[a:b], []).append((i, a))
    out = {}
    for s, where in places.items():
        if len(where) > 1:
            left = {items[i][a - 1] if a else (i, "start") for i, a in where}
            right = {items[i][a + len(s)] if a + len(s) < len(items[i]) else (i, "end") for i, a in where}
            if len(left) > 1 and len(right) > 1:
                out[s] = sorted(where)
    return out


def test_maximal_repeats():
    rng = random.Random(2)
    for _ in range(30):
        items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 4))]
        assert dict(suffixes.maximal_repeats(items, 2)) == _maximal(items, 2)
