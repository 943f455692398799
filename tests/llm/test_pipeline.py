from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_minhash import _expected as near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline
from stratapage.llm import language


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(4000)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, item = prose(60), prose(30)
    clean = {i: prose(120) for i in range(60)}
    rows = dict(clean)
    rows[100] = rows[5] + " once"  # near copy
    rows[101] = f"{prose(40)} {passage} {prose(40)}"
    rows[102] = f"{prose(40)} {passage} {prose(40)}"
    rows[103] = f"{prose(60)} {item} {prose(60)}"
    rows[104] = "12345 !!!"
    rows[105] = None
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(clean) | {101, 102}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in clean.items():
        assert found[i].ids == library.encode(text, add_special_tokens=False).ids
    assert passage not in library.decode(found[102].ids) and len(found[102].ids) < len(found[101].ids)
    assert np.all([r.n_tokens == len(r.ids) for r in found.values()])


def test_stage_list():
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without_repeats(rows, length=100):
    """Whole characters covered by a string of bytes that also starts earlier go; texts of nothing else too."""
    seen, out = set(), {}
    for doc, text in sorted(rows.items()):
        raw = text.encode()
        hit = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(window)
        left, at = "", 0
        for c in text:
            n = len(c.encode())
            if not all(hit[at : at + n]):
                left += c
            at += n
        if left == text or left.strip():
            out[doc] = left
    return out


def _without_items(text, items, window=13):
    """The text without hit words and what stands between them; None if they are one in twenty."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() if text[a:b].isascii() else "".join(c.lower() if c.isascii() else c for c in text[a:b]) for a, b in spans]
    hit = [False] * len(words)
    for item in items:
        w = [m[0].lower() for m in _WORD.finditer(item)]
        for n in [window if len(w) >= window else len(w)]:
            for j in range(len(w) - n + 1):
                for i in range(len(words) - n + 1):
                    if n and words[i : i + n] == w[j : j + n]:
                        hit[i : i + n] = [True] * n
    if any(hit) and 20 * sum(hit) >= len(words):
        return None
    out, end, i = "", 0, 0
    while i < len(hit):
        if hit[i]:
            out += text[end : spans[i][0]]
            while i + 1 < len(hit) and hit[i + 1]:
                i += 1
            end = spans[i][1]
        i += 1
    return out + text[end:]


def test_same_as_brute_force(spark, tmp_path):
    rng = random.Random(21)
    spoken = {"en": "aeioulnrst", "fr": "eaiouxqvzp", None: "bcdgkm"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 9))) for _ in range(600)] for k, v in spoken.items()}
    rows = []
    for doc in range(90):
        lang = rng.choice(["en", "fr"])
        rows.append((doc, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 160))), lang))
    passage = " ".join(rng.choice(words["en"]) for _ in range(30)) + " é ü"
    items = [" ".join(rng.choice(words["en"]) for _ in range(n)) for n in (4, 13, 20)]
    for i in range(12):
        base = rows[i][1].split()
        base[len(base) // 2] = "altered"
        rows.append((200 + i, " ".join(base), "en"))
        rows.append((300 + i, f"{rows[50 + i][1][:150]} {passage} tail{i} {rows[70][1][: 40 * i]}", "en"))
    rows += [(400, f"{rows[20][1]} {items[1]}", "en"), (401, " ".join(rng.choice(words["en"]) for _ in range(150)) + f"; {items[0].upper()}; {words['en'][0]}", "en"), (402, items[2], "en")]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "12 34", "en"), (503, " ".join(rng.choice(words[None]) for _ in range(40)), None), (504, rows[3][1], "fr"), (505, rows[3][1], "fr")]
    frame = spark.createDataFrame([(d, t, l, "s", None if t is None else len(t), 1.5) for d, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = language.Classifier(language.train(frame.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 != 2")))
    assert sum(zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows) > 5
    kept = {d: t for d, t, _ in rows if t and not model(t)[2]}
    placed = {d: c for d, _, c in near_duplicates(list(kept.items()), 5)}
    kept = {d: t for d, t in kept.items() if placed[d] == d}
    kept = {d: _without_items(t, items) for d, t in _without_repeats(kept).items()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: library.encode(t, add_special_tokens=False).ids for d, t in kept.items() if t is not None}
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == expected and 60 < len(found) < len(rows)
    assert {400, 402, 504, 505}.isdisjoint(found) and 401 in found


@pytest.mark.parametrize("kind", ["empty", "ties"])
def test_unusual_tables(spark, tmp_path, kind):
    """Empty tables, and repeated rows with null ids and clashing names, pass all stages."""
    text = " ".join(f"word{i} other" for i in range(60))
    rows = [] if kind == "empty" else [(None, text, "en", None, 1, "x", "y"), (None, text, "en", None, 1, "x", "y"), (3, text + " end", None, "s", None, None, None), (3, text + " end", None, "s", None, None, None), (4, None, None, None, None, None, None)]
    rows += [] if kind == "empty" else [(10 + i, f"{text} {i} " * 2, "en", "s", 5, "x", "y") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ranges string, rejected string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.collect()
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not found if kind == "empty" else {r.doc_id for r in found} <= {None, 3, *range(10, 18)}
