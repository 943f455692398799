"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton finds all vocabulary tokens in a word. From left to
right the longest is tried; two neighbours must be compatible, which means that
applying the merges to their texts side by side gives just these two. Where
none fits, the last token is taken back and a shorter one tried. Each place is
given up at most once, so the time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stratapage.llm.common import prepare

#: Words whose encodings a worker remembers before they are old; those that are not met again until then go.
MEMORY = 100_000
#: Pairs of tokens whose compatibility a worker remembers before it starts anew.
PAIRS = 300_000
_SPACE = "\t-\r \x85\xa0  -     　"
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|"
_ASCII = re.compile(_PARTS + r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_ANY = regex.compile(_PARTS + rf"\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(0x100 + extra)
            extra += 1
    return letters


class Codec:
    """Encoder and decoder of a word-level BPE file with word ends: NFC, lower case, white space dropped."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pair: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(size)]
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, new = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = new
            self.halves[new] = (a, b)
        self.sizes = [0] * size
        keys: dict[str, int] = {}
        self.tokens = ahocorasick.Automaton()
        letters = set(_byte_letters())
        for text, i in vocab.items():
            ended = text.endswith(self.suffix)
            body = text.removesuffix(self.suffix) if ended else text
            if not set(body) <= letters:
                continue
            key = body + "\n" if ended else body
            self.sizes[i] = len(key)
            self.tokens.add_word(key, i)
            keys[key] = i
        self.tokens.make_automaton()
        # of each token the longest other one that it starts with
        self.shorter = [-1] * size
        for key, i in keys.items():
            self.shorter[i] = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1)
        self.compatible: dict[int, bool] = {}
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))
        text = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            text[i] = t
        joined = [f"{t} ".encode() for t in text]
        self.length = np.array([len(x) for x in joined])
        self.offset = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(joined), np.uint8)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the texts of two tokens, side by side, as these two."""
        key = left * len(self.halves) + right
        if (known := self.compatible.get(key)) is not None:
            return known
        # undo merges from the latest: one that bridges the two must not come before what it would undo
        bound, answer = len(self.halves), True
        while True:
            bridge = self.pair.get((left, right))
            if bridge is not None and bridge < bound:
                answer = False
                break
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if left > right and inner_left != left:
                bound, left = left, inner_left
            elif inner_right != right:
                bound, right = right + 1, inner_right
            elif inner_left != left:
                bound, left = left, inner_left
            else:
                break
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def word(self, word: str) -> list[int]:
        """Ids of one word, given without its end."""
        if word.isascii() and word.isprintable():
            text = word + "\n"  # visible letters stand for themselves
        else:
            text = word.encode().decode("latin-1").translate(self.letters) + "\n"
        n, sizes, shorter, known, width = len(text), self.sizes, self.shorter, self.compatible, len(self.halves)
        longest = [-1] * (n + 1)  # tokens by start: ends ascend, so that the last one is the longest
        for end, token in self.tokens.iter(text):
            longest[end + 1 - sizes[token]] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if last < 0:
                        break
                    if (fit := known.get(last * width + token)) is None:
                        fit = self.fits(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
        return out

    def _remember(self, word: str) -> bytes:
        if len(self.words) >= MEMORY:
            self.words, self.old = {}, self.words
        if (ids := self.old.get(word)) is None:
            own = self.word(word)
            ids = struct.pack(f"<{len(own)}I", *own)
        self.words[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            found = _ASCII.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # lower case letter by letter: no final sigma
            found = _ANY.findall(text.replace("Σ", "σ").lower())
        return b"".join([self.words.get(w) or self._remember(w) for w in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: their tokens with a space between."""
        if not len(ids):
            return b""
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            size = self.length[part]
            end = np.cumsum(size)
            out.append(self.table[np.arange(end[-1]) + np.repeat(self.offset[part] - (end - size), size)].tobytes())
        return b"".join(out)[:-1]


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """A worker's codec of the file's content."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _shared(docs: DataFrame, path: str):
    """The vocabulary file's content, sent once to each executor. Its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


_used: dict[str, object] = {}


def _of(shared) -> Codec:
    if _used.get("spec") is not shared.value:
        _used.update(spec=shared.value, codec=codec(shared.value))
    return _used["codec"]


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text.

    A null or empty text has no tokens and decodes to the empty text. Repeated
    rows are encoded alike; ids may be null or repeat. Other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _of(shared)
            n, ids, decoded = [], [], []
            for text in batch["text"]:
                raw = c.encode(text.as_py() or "")
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(c.decode(np.frombuffer(raw, "<u4"))).hexdigest())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each row's whole text; ids is an array of integers. Nulls as in token_digest."""
    prepare(docs.sparkSession)
    shared = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _of(shared)
            encoded = [np.frombuffer(c.encode(t.as_py() or ""), "<u4") for t in batch["text"]]
            sizes = np.array([len(x) for x in encoded], np.int64)
            flat = np.concatenate([*encoded, np.zeros(0, "<u4")]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
            yield pa.record_batch([batch["doc_id"], batch["lang"], batch["source"], pa.array(sizes), lists], ["doc_id", "lang", "source", "n_tokens", "ids"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>")
