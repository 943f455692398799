from __future__ import annotations

import random

import numpy as np
import pytest

from stratapage.llm import minhash
from stratapage.llm.components import components
from stratapage.llm.minhash import drop_duplicates, estimate, near_duplicates, sketch

SCHEMA = "doc_id long, text string, n string, digest string"


def _expected(rows, k):
    """(sizes, component of each id) over all pairs; an id may come with several texts."""
    sets = []
    for doc, text in rows:
        words = (text or "").lower().split()
        sets.append((doc, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted((d, len(x), find(d) if x else d) for d, x in sets)


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, doc = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc := doc + 1, " ".join(words)))
    return rows + [(doc + 1, ""), (doc + 2, None), (doc + 3, "Two words"), (doc + 4, "two WORDS"), (doc + 5, "  \t ")]


@pytest.mark.parametrize("k", [4, 5])
def test_same_components_as_all_pairs(spark, k):
    rows = _corpus()
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame, k).collect())
    assert found == _expected(rows, k)


@pytest.mark.parametrize("hot", [minhash.HOT, 1])
def test_repeated_ids_with_several_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "HUBS", 1)
    rng = random.Random(4)
    rows = [(d // 2 if rng.random() < 0.3 else d, t) for d, t in _corpus(11)]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame, 4).collect())
    assert found == _expected(rows, 4)


def test_null_ids_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (None, b), (5, a + " z"), (7, b + " z"), (7, b), (9, "a0 " + a)]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    found = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(frame, 4).collect())
    assert found == [(0, 0, True), (0, 0, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 5, False)]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    frame = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    found = sorted(near_duplicates(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.component_id, r.kept) for r in found] == [(1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True), (None, None, True)]
    assert near_duplicates(frame.limit(0)).count() == 0
    kept = drop_duplicates(frame).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 1), (False, 4), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "n", "digest"}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    for shared in (0.2, 0.5, 0.8, 1.0):
        n = int(len(values) * (1 + shared) / 2)
        a, b = values[:n], values[len(values) - n :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows = [sketch(np.sort(x))[None] for x in (a, b)]
        assert abs(estimate(*rows, np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
