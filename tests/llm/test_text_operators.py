from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratapage.llm import bpe, decontaminate, fingerprints, language, licenses, toxicity, urls, warc
from stratapage.llm.queries import RULES

PATH = public_tokenizers.path("word_bpe_49k.json")


def _docs(spark, rows):
    """With columns whose names clash with those that operators add."""
    return spark.createDataFrame([(d, t, "en", "s", 1, 0.5, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, hits string")


TEXTS = [None, "", " \n", "Hello  wörld's 12345 don't", "<|endoftext|>a<|startoftext|> b", "ΑΣ ΣΑΣ İ", "\x1c\x85 x", "a" * 3000, "漢字 é é ﬁ", "It's <|endoftext| not"]


def test_bpe_is_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeéß ,.'!1<|>\n") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    found = {r.doc_id: r for r in bpe.token_digest(_docs(spark, list(enumerate(texts))), PATH).collect()}
    ids = {r.doc_id: r.ids for r in bpe.tokenize(_docs(spark, list(enumerate(texts))), PATH).collect()}
    for i, text in enumerate(texts):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == expected
        assert found[i].n_tokens == len(expected)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digest(_docs(spark, []), PATH).count() == 0


def test_words_that_come_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 4)
    with open(PATH, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    encoded, word = [], codec.word
    monkeypatch.setattr(codec, "word", lambda w: encoded.append(w) or word(w))
    others = [f"new{chr(97 + i)}word" for i in range(12)]
    text = " ".join(f"again {w}" for w in others)
    found = codec.encode(text)
    assert encoded.count("again") == 1 and set(others) < set(encoded) and len(codec.words) <= 4
    assert list(np.frombuffer(found, "<u4")) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def _contaminated(text, items, window):
    def words(t):
        out, now = [], ""
        for c in (t or ""):
            c = c.lower() if c.isascii() else c
            if ord(c) > 127 or c.isdigit() or "a" <= c <= "z":
                now += c
            elif now:
                out, now = [*out, now], ""
        return [*out, now] if now else out

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        grams = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)} if len(w) >= window else {tuple(w)} if w else set()
        for g in grams:
            for i in range(len(own) - len(g) + 1):
                if tuple(own[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("limit", [decontaminate.ITEM_BYTES, 40])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", limit)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(12)] + [(90, None), (91, ""), (92, "a b c a b"), (93, "Ünï; CODE x")]
    texts = [None, "", "a B, c. d-a b c", "ünï code x", "Ünï code x"] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = _docs(spark, list(enumerate(texts)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, benchmark, 5).collect()}
    assert found == {i: _contaminated(t, items, 5) for i, t in enumerate(texts)}
    assert decontaminate.contamination(docs, benchmark.limit(0), 5).where("n_hit > 0").count() == 0


def test_decontaminate_cuts(spark):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    long = "w " * 100
    docs = _docs(spark, [(1, f"{long}- One, two three FOUR! end"), (2, "one two three four five"), (3, "clean"), (4, None)])
    found = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert found == {1: (f"{long}- ! end", 207), 3: ("clean", 1), 4: (None, 1)}


@pytest.mark.parametrize("limit", [decontaminate.ITEM_BYTES, 40])
def test_several_indexes_are_as_one(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", limit)
    items = ["one two three four", *(f"i{n}a i{n}b i{n}c i{n}d" for n in range(40)), "three four five six"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = "w " * 200
    three_each = " ".join(items[n] for n in (3, 17, 25, 38))  # 16 of 216 words, of several indexes; each alone is under 5 %
    rows = [(1, w + three_each), (2, f"{w}one two three four five six end"), (3, f"{w}one i5a i5b i5c i5d two three four"), (None, w + items[7]), (None, w.replace("w", "v") + "a b c d"), (None, "a b c d"), (None, None), (7, w + items[8]), (7, w + "a b c d")]
    docs = _docs(spark, rows)
    found = sorted((r.doc_id or 0, r.text or "") for r in decontaminate.decontaminate(docs, benchmark, 4).collect())
    expected = [(2, f"{w} end"), (3, f"{w}one  two three four"), (0, w), rows[4], rows[5], (0, ""), (7, w), rows[8]]
    assert found == sorted((i or 0, t) for i, t in expected)
    judged = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, benchmark, 4).collect())
    assert judged == sorted((i or 0, *(_contaminated(t, list(enumerate(items)), 4)[k] for k in (0, 1, 2, 4))) for i, t in rows)


def _chunks(raw):
    """Byte by byte: the gear hash of the last REACH bytes, and where it cuts."""
    out, start, gear = {}, 0, 0
    hashes = [int(x) for x in fingerprints.BYTE_HASH]
    for i, byte in enumerate(raw):
        gear = (gear << 1) + hashes[byte]
        if i >= fingerprints.REACH:
            gear -= hashes[raw[i - fingerprints.REACH]] << fingerprints.REACH
        gear %= 2**64
        size = i + 1 - start
        loose, strict = gear >> (64 - fingerprints.LOOSE) == 0, gear >> (64 - fingerprints.STRICT) == 0
        cut = size >= fingerprints.LEAST and (strict or (loose and size >= fingerprints.AIM))
        if cut or size == fingerprints.MOST or i + 1 == len(raw):
            piece = raw[start : i + 1]
            out[piece] = out.get(piece, 0) + size
            start = i + 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_fingerprints(spark, hot):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(rng.randint(0, 200))) for _ in range(50)] + [None, "", "x", "y" * 5000]
    rows = [(None if hot and i % 2 else 7 if hot and i % 3 else i * 3, t) for i, t in enumerate(texts)] + [(7, "again")] * 2
    docs = _docs(spark, rows)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    expected = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (_chunks(t.encode()) for t in (text, edited, following))

        def near(x, y):
            both = sum(min(n, y[k]) for k, n in x.items() if k in y)
            most = max(sum(x.values()), sum(y.values()))
            return round(both / most, 9) if most else 1.0, round(both / sum(x.values()), 9) if x else 1.0

        expected.append((doc or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near(a, b), *near(a, c), sorted(a.values()), sorted(b.values())))
    found = fingerprints.compare_with_next(docs, 5).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.in_edited, 9), round(r.near_next, 9), round(r.in_next, 9), *(sorted(int(x.split(":")[1]) for x in f.split()) for f in (r.fingerprint, r.edited_fingerprint))) for r in found) == sorted(expected)
    assert len({r.fingerprint for r in found if r.n_chars == 5}) == 1
    assert np.mean([r.near_edited for r in found]) > 0.35 > np.mean([r.near_next for r in found])
    assert fingerprints.compare_with_next(_docs(spark, [])).count() == 0


def test_an_insertion_moves_few_boundaries():
    rng = random.Random(3)
    raw = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    changed = raw[:9000] + b"inserted" + raw[9000:]
    a, b = fingerprints.chunks(raw), fingerprints.chunks(changed)
    assert sum(a.values()) == len(raw) and fingerprints.containment(a, b) > 0.95


def test_language(spark):
    rng = random.Random(5)
    words = {"xx": ["kalo", "mira", "tuno", "sela"], "yy": ["grunt", "blisk", "drask", "vlorn"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(30)), l, "s") for i in range(200) for l in [rng.choice(["xx", "yy"])]]
    rows += [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "123 !!", "yy", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language.predictions(docs).collect()}
    held = [r for r in rows if found[r[0]].held_out and r[0] < 1000]
    assert held and all(found[r[0]].lang_pred == r[2] for r in held)
    assert {found[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert {r.doc_id for r in language.keep_identified(docs).collect()} == set(range(200))
    assert language.predictions(docs.limit(0)).count() == 0


def test_language_learns_from_whole_texts(spark):
    rng = random.Random(7)
    words = {"xx": ["kalo", "mira", "tuno", "sela"], "yy": ["grunt", "blisk", "drask", "vlorn"]}
    blank = "12 34 -- " * 300  # letters start after character 2000
    rows = [(i, blank + " ".join(rng.choice(words[l]) for _ in range(40)), l, i, "q") for i in range(120) for l in ("xx", "yy")[i % 2 : i % 2 + 1]]
    rows += [rows[0], (None, rows[1][1], "yy", 0, "q"), (500, "x" * 300_000, "xx", 0, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, rejected string")
    found = language.predictions(docs).collect()
    expected = {(d, l) for d, _, l, _, _ in rows if d != 500}
    assert {(r.doc_id, r.lang_pred) for r in found if r.doc_id != 500} == expected and len(found) == len(rows)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r.rejected) for r in kept.collect()} >= {(d, "q") for d, _ in expected}
    raw = bytes(range(97, 123)) * 400
    assert len(language.share(raw)) == language.SHARE_BYTES and language.share(raw)[-26:] == raw[-26:] and language.share(b"short") == b"short"


def test_language_margin_is_independent_of_length():
    rng = random.Random(6)

    def speaker(letters):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(3000)]
        return lambda n: " ".join(rng.choice(words) for _ in range(n))

    spoken = {"xx": speaker("aeioulnrstmk"), "yy": speaker("aeioubdgpvz")}
    model = language.Classifier({k: language.normal(f(1000)) for k, f in spoken.items()})
    for name, say in spoken.items():
        for n in (200, 600_000):
            assert model(say(n))[::2] == (name, False)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(200)) for _ in range(30)]
    assert all(model(text)[2] for text in noise)
    raw = language.normal("é" * 5000 + " " + spoken["xx"](3000))
    assert b"".join(language.text_blocks(raw)) == raw and max(map(len, language.text_blocks(raw))) <= language.BLOCK_BYTES


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    bad = ["zzorg", "zzorgent", "qqarf", "idiot"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[3], words[7] = rng.choice(bad), rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = _docs(spark, [*rows, (900, None), (901, "")])
    marked = spark.createDataFrame([*labels, (5, 0, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.scores(docs, marked).collect()}
    held = [i for i, _, _ in labels if found[i].held_out]
    right = np.mean([found[i].predicted == labels[i][2] for i in held])
    assert held and right > 0.97 and found[900].score == found[901].score < 0.5
    words = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]  # the query against a loop over whole texts, by the same model
    described = [(np.unique(toxicity._features(w, np.array([0, len(w)]))[0]), w) for w in words]
    sample = [(found[i].held_out, labels[i][2], f.astype("<u4").tobytes(), bytes(toxicity._patterns(w, f))) for i, (f, w) in enumerate(described)]
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    table, bias = toxicity.fit([sample[i][1:] for i in sorted(range(600), key=order.get) if not sample[i][0]])
    for i, (f, _) in enumerate(described):
        assert found[i].score == pytest.approx(1 / (1 + np.exp(-(table[f].sum(dtype=float) + bias))), abs=1e-6)
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in found}
    assert toxicity.scores(docs, marked.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.scores(docs.limit(0), marked).count() == 0


def test_label_model_weighs_correlated_voters_less():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    copy = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.1)
    votes = np.stack([copy, copy, copy] + [np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.05) for _ in range(4)], 1).astype(float)
    q, rates, weights = toxicity.label_model(votes, 0.2)
    assert weights[:3].max() < weights[3:].min()
    assert ((q > 0.5) == y).mean() > 0.95 and abs(rates[1, 3] - 0.8) < 0.1


def test_url_rules_and_trees(spark):
    pages = [(1, "HTTP://Shop.COM/en/x?q"), (2, "https://example.com/en/71"), (3, "a://b.example.net/de/8#x"), (4, "a://xcom/en/1"), (5, None), (6, "nothing"), (None, ""), (7, "x://y://z/p")]
    pages += [(100 + i, f"http://h{i % 7}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}") for i in range(200)]
    frame = spark.createDataFrame([(p, u, "h", "r") for p, u in pages], "page_id long, url string, host string, rule string")
    found = {r.page_id: r for r in urls.judge(frame, RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in (1, 2, 3, 4, 5, 6, 7)] == [
        ("shop.com", "/en/x", "com/en/"), ("example.com", "/en/71", "example.com/en/7"), ("b.example.net", "/de/8", "example.net/de/8"),
        ("xcom", "/en/1", None), ("", "", None), ("", "", None), ("y:", "//z/p", None)]
    assert (found[1].verdict, found[2].verdict, found[3].verdict) == ("block", "allow", "block")
    assert {r.verdict for r in found.values()} <= {"allow", "block"} and len(found) == len(pages)
    assert urls.judge(frame.limit(0), RULES).count() == 0
    # every row against plain rules, and features counted letter by letter, by the same trees
    model = urls.fit(frame.join(spark.createDataFrame([(p, r.rule) for p, r in found.items() if p and r.rule], "p long, ruled string"), F.col("page_id") == F.col("p")).select("url", F.col("ruled").isin("com/en/", "org/es/", "example.net/de/8").alias("block")))
    described, names = urls._described(frame.select("page_id", "url"))
    described = {r.page_id: r for r in described.collect()}
    for page, url in pages:
        host, path = _split_url(url)
        lexical = [described[page][c] or 0.0 for c in names]
        assert lexical == pytest.approx(_lexical(url or "", host, path))
        fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict, rule = max(fits, key=lambda r: len(r[1]), default=(None, None))
        score = float(model([np.array([v], float) for v in lexical], [host.split(".")[-1]])[0])
        r = found[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.block_score == pytest.approx(score)
        assert r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))


def _split_url(url):
    rest = (url or "").partition("://")[2]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def _lexical(url, host, path):
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    counts = [url.count(c) for c in set(url)]
    entropy = sum(-c / len(url) * np.log2(c / len(url)) for c in counts)
    end = re.search(r"\.([A-Za-z0-9]{1,5})$", path)
    digits = sum(c in "0123456789" for c in url)
    return [len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits / max(1, len(url)), sum(c in "0123456789" for c in host), host.count("-"), entropy,
            query.count("&") + 1 if query else 0, len(query), int("#" in url), int(url.startswith("https://")), int(host.startswith("www.")), url.count("%"), len(end[1]) if end else 0]


def test_urls_from_given_labels(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{'ads' if bad else 'site'}{rng.randint(1, 99)}.{rng.choice(['info', 'org'])}/{'x/' * rng.randint(0, 3)}{'?a=1&b=2&c=' + str(rng.randint(1, 9)) if bad else 'page'}", bad) for i in range(400) for bad in [rng.random() < 0.4]]
    frame = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    labelled = frame.where("page_id < 200").select("url", "block").unionAll(spark.createDataFrame([(None, True), ("http://a/", None)], "url string, block boolean"))
    found = {r.page_id: r.verdict for r in urls.judge(frame, RULES, labelled).collect()}
    assert all(found[i] == ("block" if bad else "allow") for i, _, bad in rows if i >= 200)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = urls.Trees().fit(x[:1500], y[:1500])
    assert ((model(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def _record(spark, rows):
    return spark.createDataFrame(rows, "record_id long, warc_type string, target_uri string, captured timestamp, status int, headers map<string,string>, payload_digest string, url string")


def test_revisits(spark):
    from datetime import datetime, timedelta

    def at(s):
        return datetime(2020, 1, 1) + timedelta(seconds=s)

    rows = [
        (1, "response", "http://a.com/x?b=1&a=2#f", at(0), 200, {"etag": '"1"', "server": "s", "cache-control": "old"}, "d1", ""),
        (2, "revisit", "https://www.A.com/x/?a=2&b=1&utm_source=q", at(9000), 304, {"etag": 'W/"1"', "cache-control": "new", "server": "edge"}, None, ""),
        (3, "response", "http://a.com/x?a=2&b=1", at(9001), 200, {"etag": '"2"'}, "d3", ""),
        (4, "revisit", "http://a.com/x?a=2&b=1", at(9002), 304, {"etag": '"1"'}, None, ""),
        (5, "revisit", "http://a.com/x?a=2&b=1", at(9001), 304, None, None, ""),
        (6, "revisit", "http://other.com/", at(5), 304, {}, None, ""),
        (7, "revisit", None, at(5), 304, {}, None, ""),
        (8, "revisit", "http://a.com/x?a=2&b=1", None, 304, {}, None, ""),
        (9, "response", "http://a.com/x?a=2&b=1", at(9100), 404, {}, "d9", ""),
        (10, "response", "http://a.com/x?a=2&b=1", at(9200), 304, {"last-modified": "x"}, None, ""),
    ]
    for seconds in (1, 4096, 10**6):
        found = {r.record_id: r for r in warc.resolve_revisits(_record(spark, rows), seconds).collect()}
        assert {k: (r.source_id, r.outcome) for k, r in found.items()} == {
            2: (1, "resolved"), 4: (3, "mismatch"), 5: (1, "resolved"), 6: (None, "unmatched"), 7: (None, "unmatched"), 8: (None, "unmatched"), 10: (3, "mismatch")}
        assert found[2].headers == {"etag": 'W/"1"', "server": "s", "cache-control": "new"} and found[2].source_digest == "d1"
    assert warc.resolve_revisits(_record(spark, []), 1).count() == 0


def _warc(kind, number, uri, date, body, length=None, more=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <u:{number}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n{more}Content-Length: {len(body) if length is None else length}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_warc_files_to_revisits(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nX: a\r\nX: b\r\n\r\nhello"
    first = _warc("response", 1, "http://a/", "2020-01-01T00:00:00Z", page)
    (rows,) = warc.parse(first)
    digest = rows[6]
    assert digest == "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    same = _warc("revisit", 2, "http://a/", "2020-01-02T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\n", more=f"WARC-Payload-Digest: {digest}\r\n")
    other = _warc("revisit", 3, "http://a/", "2020-01-03T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\n", more="WARC-Payload-Digest: sha1:NONE\r\n")
    unchanged = _warc("revisit", 4, "https://www.a", "2020-01-04T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: W/\"1\"\r\n\r\n")
    broken = _warc("response", 9, "http://a/", "2020-01-01T12:00:00Z", page, length="x7") + _warc("response", 8, "http://a/", "2020-01-01T12:00:00Z", page, length="")
    undated = _warc("revisit", 5, "http://a/", "yesterday", b"")
    (tmp_path / "a.warc").write_bytes(first + broken + same + first[:-20])
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [other, unchanged, undated])) + gzip.compress(same * 50)[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no such file \xff\xfe")
    read = warc.read_warc(spark, str(tmp_path))
    found = {r.record_id: r for r in read.where("record_id != '<u:2>'").collect()}
    assert set(found) == {"<u:1>", "<u:3>", "<u:4>", "<u:5>"} and (found["<u:1>"].status, found["<u:1>"].headers["x"], bytes(found["<u:1>"].payload)) == (200, "a, b", b"hello")
    outcomes = {(r.record_id, r.outcome, r.source_id) for r in warc.resolve_revisits(read).collect()}
    assert outcomes == {("<u:2>", "resolved", "<u:1>"), ("<u:3>", "mismatch", "<u:1>"), ("<u:4>", "resolved", "<u:1>"), ("<u:5>", "unmatched", None)}
    repeated = _record(spark, [(r.record_id, r.warc_type, r.target_uri, r.captured, r.status, r.headers, r.payload_digest, "") for r in read.where("record_id IN ('<u:1>', '<u:4>')").withColumn("record_id", F.substring("record_id", 4, 1).cast("long")).collect() * 2])
    assert [r.outcome for r in warc.resolve_revisits(repeated).collect()] == ["resolved"] * 2


def test_licenses(spark):
    rng = random.Random(9)
    filler = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    isc = licenses.TEMPLATES["ISC"]
    changed = isc.replace("modify, and/or distribute", "modify and share").upper()
    docs = _docs(spark, [(1, f"{filler}\n{changed}\n{filler}"), (2, "Released under the MIT License."), (3, filler), (4, None), (5, ""), (6, "under the license of the software"), (6, "é " + licenses.TEMPLATES["GPL-3.0"])])
    found = {(r.doc_id, r.license): r for r in licenses.find_licenses(docs).collect()}
    assert set(found) == {(1, "ISC"), (2, "MIT-notice"), (6, "GPL-3.0")}
    assert found[2, "MIT-notice"].coverage == 1.0 and (found[2, "MIT-notice"].low, found[2, "MIT-notice"].high) == (0, 30)
    one = found[1, "ISC"]
    assert one.coverage > 0.85 and f"{filler}\n{changed}\n{filler}".encode()[one.low : one.high].startswith(b"PERMISSION TO USE")
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_licenses_tell_siblings_apart(spark):
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {
        header.format("General Public License", "2"): {"GPL-2.0"},
        header.format("Lesser General Public License", "2.1"): {"LGPL-2.1"},
        header.format("Affero General Public License", "3"): {"AGPL-3.0"},
        header.format("General Public License", "7"): set(),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0-notice"},
        "Released under an MIT License": {"MIT-notice"},
        "Released under the Frog License": set(),
        licenses.TEMPLATES["MIT"][:300]: set(),
        **{licenses.TEMPLATES[k]: {k} for k in ("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Unlicense", "Apache-2.0", "GPL-3.0-text", "LGPL-2.1-text")},
    }
    docs = _docs(spark, list(enumerate(cases)))
    found = [(r.doc_id, r.license) for r in licenses.find_licenses(docs).collect()]
    assert {i: {n for d, n in found if d == i} for i in range(len(cases))} == dict(enumerate(cases.values()))


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        template = [rng.randrange(5) for _ in range(rng.randint(1, 10))]
        text = [rng.randrange(5) for _ in range(rng.randint(0, 12))]
        best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
        for i, a in enumerate(template):
            for j, b in enumerate(text):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert licenses.align(text, template, 0)[0] == best[-1][-1]


def test_very_long_and_repeated_texts(spark):
    """One text of three million letters, twice, beside short ones: every row comes back, equal rows alike."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(430_000))
    item = " ".join(long.split()[400_000:400_020])
    rows = [(1, long), (1, long), (2, long[-3000:]), (3, "short"), (3, "short"), (None, None)]
    docs = _docs(spark, rows)
    found = decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in found) == [(0, 0), (1, 20), (1, 20), (2, 0), (3, 0), (3, 0)]
    marked = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    scored = toxicity.scores(docs, marked).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 1}) == 1
    assert licenses.find_licenses(_docs(spark, [(1, long + " Released under the MIT License."), (2, None)])).count() == 1
    near = fingerprints.compare_with_next(docs, 3).collect()
    assert sorted(r.n_chars for r in near) == sorted(len(t or "") for _, t in rows)
    own, total = [r.fingerprint for r in near if r.doc_id == 1], len(long)
    assert own[0] == own[1] and sum(int(x.split(":")[1]) for x in own[0].split()) == total
    predicted = language.predictions(docs).collect()
    assert len(predicted) == len(rows) and {r.lang_pred for r in predicted if r.doc_id is None} == {"und"}
