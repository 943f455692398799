"""What keeps the core's queries in bounds on large tables: where rows are dealt, and kernels against plain forms."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratapage.functions.dialect import CHECK, SPARK, render
from stratapage.operators import consolidate, structured
from stratapage.operators.embedding import Hasher, idf, md5_hash
from stratapage.plans import registry
from stratapage.plans.materialize import materialize

SF = "/root/testdata/sf0.001"
concatenate = np.concatenate


@pytest.mark.parametrize("name", ["merge_chains", "pair_signals", "content_units"])
def test_rows_stay_where_their_document_is(spark, name):
    found = registry.QUERIES[name](spark, SF)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_no_grid_do_not_meet_in_one_task():
    for (name, _), text in structured.IN_SPARK.items():
        assert "grid_id = " not in text.replace("document_id = k.document_id AND f.grid_id = ", "").replace("document_id = h.document_id AND f.grid_id = ", "").replace("p.document_id = b.document_id AND p.grid_id = ", "").replace("p.document_id = s.document_id AND p.grid_id = ", ""), name
        assert "BY grid_id" not in text, name


def test_cuts_keep_only_named_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "B", "c"])
    assert registry._named(df, ["SELECT x.*, b FROM x", "SELECT A FROM y"]).columns == ["a", "B"]


def test_classes_are_taken_out_in_runs_for_spark_alone(spark):
    text = "length(@replace(x, '[^\\p{Nd}]', ''))"
    assert "]+'" in render(text, SPARK) and "]+'" not in render(text, CHECK)
    assert "]+'" not in render("@replace(x, '^[ab]', '')", SPARK) and "]+'" not in render("@replace(x, '[ab]', ' ')", SPARK)
    assert spark.createDataFrame([("a1b22 c",)], ["x"]).select(F.expr(render(text, SPARK))).first()[0] == 3


def test_texts_are_embedded_once_for_idf(spark):
    plan = idf(spark.createDataFrame([("a b",)], ["text"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def _plain(text: str) -> np.ndarray:
    words = [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]
    joined = "".join(words)
    terms = Counter([f"w:{w}" for w in words] + [f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [f"c{n}:{joined[i : i + n]}" for n in (3, 4) for i in range(len(joined) - n + 1)])
    out = np.zeros(512)
    for term, n in terms.items():
        bucket, sign = md5_hash(term)
        out[bucket] += sign * (1 + np.log(n))
    return out


def test_embeddings_against_a_plain_loop_when_memory_runs_out(monkeypatch):
    monkeypatch.setattr("stratapage.operators.embedding.MEMORY", 5)
    monkeypatch.setattr("stratapage.operators.embedding.PART", 2)
    texts = ["a b a b a", "b a", None, "", "one Two TWO three four", "Ünder 9 9 9 9", "a b", "x"] * 2
    assert np.allclose(Hasher()(texts)[0], [_plain(t or "") for t in texts])


@pytest.mark.parametrize("name", ["pattern_leader", "block_patterns"])
def test_shared_steps_run_once(spark, monkeypatch, name):
    read = []
    monkeypatch.setitem(registry.KERNELS, "idf", (("units",), lambda units: read.append(1) or idf(units)))
    registry.QUERIES[name](spark, SF)
    assert len(read) == 1


@pytest.mark.parametrize("size", [0, 1, 20, 55, 56, 80])
def test_terms_hashed_at_once_against_one_by_one(size):
    words = ["a", "Z9" * 3, "b" * size or "c", "d" * (size // 2 + 1)]
    own = Hasher()
    own._learn(words)
    code = lambda term: 2 * md5_hash(term)[0] + (md5_hash(term)[1] > 0)
    assert own.codes.tolist() == [code(f"w:{w}") for w in words]
    a, b = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    assert own._hashed("b:", a, b).tolist() == [code(f"b:{words[i]}_{words[j]}") for i, j in zip(a, b, strict=True)]


def test_buckets_seen_need_no_counts():
    texts = ["a b a b", None, "", "one two three " * 5, "x" * 60 + " " + "y" * 60] * 60
    assert np.array_equal(Hasher().seen(texts), Hasher()(texts)[1].sum(0))


def test_buckets_are_as_large_for_ten_times_the_input(monkeypatch):
    class Sized:
        def __init__(self, size):
            self.size, self.sparkSession = size, self
            self._jdf = self.sparkContext = self.conf = self
            self.defaultParallelism = 12

        def __getattr__(self, name):
            return lambda *_: self.size if name == "sizeInBytes" else self

    sizes = [n / registry._buckets({"documents": Sized(n)}) for n in (100 << 20, 1000 << 20, 6000 << 20)]
    assert max(sizes) <= 1.1 * min(sizes)


def test_cuts_are_read_in_order(spark):
    df = spark.range(200).selectExpr("CAST(id % 7 AS STRING) AS document_id", "id AS ord").repartition(3, "document_id")
    found = materialize(df, "document_id", 3)
    plan = found.selectExpr("document_id", "lag(ord) OVER (PARTITION BY document_id ORDER BY ord) AS p")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Exchange" not in plan


def test_texts_of_pairs_and_keys_of_furniture(spark, monkeypatch):
    written, write = [], registry.materialize
    monkeypatch.setattr(registry, "materialize", lambda df, *a: written.append(df) or write(df, *a))
    registry.QUERIES["boundaries"](spark, SF)
    assert all("a_text" not in df.columns for df in written)
    assert [df for df in written if "w_semantic" in df.columns] and [df for df in written if "median_gap" in df.columns]
    for df in written:
        sorts = re.findall(r"Sort \[[^\]]*\]", df._jdf.queryExecution().executedPlan().toString())
        assert not [s for s in sorts if "lower(" in s]


def test_texts_of_spark_alone_give_the_same(spark):
    texts = ["", "a", " a  b ", "x y\tz \n w", "one, two-three's!", "...", "é 9) ", "ab cd\n", " ", "a  b"]
    df = spark.createDataFrame([(x,) for x in texts], ["x"])
    letter = "[\\p{L}\\p{N}\\x27-]"
    both = df.select(
        F.expr("regexp_replace(x, r'[\\s\\x{00A0}]+', ' ')").alias("a"), F.expr(render("@replace(x, '[\\s\\x{00A0}]+', ' ')", SPARK)).alias("b"),
        F.expr(f"regexp_extract(x, r'({letter}+)[^{letter[1:]}*$', 1)").alias("c"), F.expr(f"regexp_extract(x, r'(?<!{letter})({letter}++)[^{letter[1:]}*+$', 1)").alias("d"),
    ).collect()
    assert [r.a for r in both] == [r.b for r in both] and [r.c for r in both] == [r.d for r in both]
    assert "{2,}" in render("@replace(x, '[\\s\\x{00A0}]+', ' ')", SPARK)
    assert "++)" in registry.IN_SPARK[consolidate.JUDGE[1]]


def test_boxes_and_signals_are_no_decimals_in_spark(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert {t for _, t in registry.plan(structured.LINES, "SELECT y0, y1, pw FROM units", documents=documents).dtypes} == {"double"}
    signals = registry.plan(structured.TO_PAIRS, "SELECT reading, container, container_change, discount, b_reading, b_container, b_hierarchy, b_layout FROM pairs", documents=documents)
    assert {t for _, t in signals.dtypes} == {"double"}
    assert structured._with_doubles("a >= 0.5 AND b = '0.5' AND c1.d2 = 1e-9 * 2") == "a >= 0.5D AND b = '0.5' AND c1.d2 = 1e-9 * 2"


def test_cosines_a_part_at_a_time_against_whole_vectors(monkeypatch):
    monkeypatch.setattr("stratapage.operators.embedding.PART", 3)
    now = ["a b", "b c a", "", "x", "x", "one two", "two one 5", "é", "a" * 9]
    before = [None, *now[:2], "a b", "x", None, "other b", "two one 5", "a" * 8]
    idf = np.linspace(0.5, 2, 512)
    rows = [[_plain(t or "") * idf for t in texts] for texts in (before, now)]
    expected = [np.nan if b is None else x @ y / max(np.sqrt(x @ x) * np.sqrt(y @ y), 1e-300) for b, x, y in zip(before, *rows, strict=True)]
    assert np.allclose(Hasher().cosines(before, now, idf), expected, equal_nan=True)


def test_learning_words_copies_seldom(monkeypatch):
    own, copied = Hasher(), []
    monkeypatch.setattr("stratapage.operators.embedding.np.concatenate", lambda x, *a, **k: copied.append(sum(map(len, x))) or concatenate(x, *a, **k))
    for i in range(200):
        own._learn([f"w{i}"])
    assert sum(copied) < 20 * sum(map(len, own.names)) and own.codes[:200].tolist() == [2 * md5_hash(f"w:{w}")[0] + (md5_hash(f"w:{w}")[1] > 0) for w in own.names]


def test_cuts_have_no_dictionaries(spark):
    df = spark.range(100).selectExpr("CAST(id % 3 AS STRING) AS document_id", "CAST(id % 5 AS DOUBLE) AS v")
    for path in materialize(df, "document_id", 1).inputFiles():
        group = pq.ParquetFile(path.removeprefix("file:")).metadata.row_group(0)
        assert not any(group.column(i).has_dictionary_page for i in range(group.num_columns))
