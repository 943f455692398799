"""Hashed embeddings: words, word pairs and letter 3- and 4-grams in signed buckets.

``TERMS`` states them as steps for the checking engine. Spark runs kernels
instead: a term is hashed once a worker, a text's terms never become rows, and
neighbours are compared where they stand, from the texts of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratapage.functions.dialect import Step

DIMENSION = 512
#: Words that a worker remembers before it starts anew, more than any number of them, and places for word pairs.
MEMORY, WORD_BITS = 400_000, 27
WORD = 1 << WORD_BITS
PAIR_BITS, GRAM_BITS = 20, 21
PAIRS = 1 << PAIR_BITS
#: Texts that are embedded at once.
PART = 256
#: Bytes as ASCII letters, lower case, and digits; all others as spaces.
_FOLDED = bytes(ord(c.lower()) if c.isascii() and c.isalnum() else 32 for c in map(chr, range(256)))

Hash = Callable[[str], tuple[int, int]]


def md5_hash(term: str) -> tuple[int, int]:
    """Bucket and sign, of the digest's first and ninth hex digits on; SQL has this hash too."""
    digest = hashlib.md5(term.encode()).digest()
    return (digest[2] << 8 | digest[3]) % DIMENSION, 1 - 2 * (digest[4] >> 4 & 1)


def blake2b_hash(term: str) -> tuple[int, int]:
    """Bucket and sign of the reference form."""
    bucket = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big") % DIMENSION
    return bucket, 1 if hashlib.blake2b(f"{term}#sign".encode(), digest_size=1).digest()[0] & 1 else -1


HASHES: dict[str, Hash] = {"md5": md5_hash, "blake2b": blake2b_hash}

#: MD5's shifts and constants; the bytes that one block of it holds, and terms that are hashed at once.
_SHIFTS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
BLOCK, AT_ONCE = 55, 4096


def _md5_start(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of padded messages, a row of sixteen words each."""
    m = np.ascontiguousarray(blocks.T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * i % 16
        f += a
        f += _SINES[i]
        f += m[at]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=g)
        f <<= np.uint32(_SHIFTS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + start[0], b + start[1]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def md5_codes(prefix: str, parts: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray) -> np.ndarray:
    """Codes (see Hasher) of the terms that parts make: starts and sizes in letters each, an underscore between them. Terms are of BLOCK bytes at most."""
    out = np.empty(len(parts[0][0]), np.int16)
    for i in range(0, len(out), AT_ONCE):
        own = [(start[i : i + AT_ONCE], size[i : i + AT_ONCE]) for start, size in parts]
        rows = np.arange(len(own[0][0]))
        blocks = np.zeros((len(rows), 64), np.uint8)
        flat, end = blocks.ravel(), rows * 64 + len(prefix)
        blocks[:, : len(prefix)] = np.frombuffer(prefix.encode(), np.uint8)
        for k, (start, size) in enumerate(own):
            if k:
                flat[end] = ord("_")
                end = end + 1
            flat[_places(end, size)] = letters[_places(start, size)]
            end = end + size
        flat[end] = 128
        blocks[:, 56:58] = (8 * (end - rows * 64)).astype("<u2").view(np.uint8).reshape(-1, 2)
        first, second = _md5_start(blocks.view("<u4"))
        bucket = (first >> np.uint32(16) & np.uint32(255)) << np.uint32(8) | first >> np.uint32(24)
        out[i : i + AT_ONCE] = 2 * (bucket % DIMENSION) + 1 - (second >> np.uint32(4) & np.uint32(1))
    return out


_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
_DIGIT = np.zeros(256, np.int32)
_DIGIT[list(_LETTERS.encode())] = np.arange(36)


#: 1 + ln tf of the counts that terms mostly have.
_WEIGHTS = np.r_[0.0, 1.0 + np.log(np.arange(1, 1024))]


class Vocabulary(dict):
    """Numbers of words in order of their first sight, and those that nobody has asked for yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _grown(x: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """x with more from place n on; twice as long where there is no room, so that a word is copied seldom."""
    if n + len(more) > len(x):
        x = np.concatenate([x, np.zeros(max(len(x), n + len(more) - len(x)), x.dtype)])
    x[n : n + len(more)] = more
    return x


class Hasher:
    """Vectors of texts, before idf: a bucket's signs times 1 + ln tf, summed over its terms.

    Words are numbers, and pairs of words and letter grams are numbers made of
    these, so that terms are counted without a loop. Letter grams are looked up
    in a table of what is hashed already, word pairs in one that keeps the last
    pair seen at each place. A code is a bucket and a sign as one number. MD5 is
    taken of many terms at once.
    """

    def __init__(self, kind: str = "md5") -> None:
        self.hash, self.at_once = HASHES[kind], kind == "md5"
        self.grams = {n: np.full(36**n, -1, np.int16) for n in (3, 4)}
        self._forget()

    def _forget(self) -> None:
        self.known, self.names, self.codes, self.n_letters = Vocabulary(), [], np.zeros(0, np.int16), 0
        self.letters, self.starts, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.pair_codes = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, np.int16)

    def _code(self, term: str) -> int:
        bucket, sign = self.hash(term)
        return 2 * bucket + (sign > 0)

    def _hashed(self, prefix: str, *words: np.ndarray) -> np.ndarray:
        """Codes of terms made of words, by their numbers."""
        short = np.full(len(words[0]), self.at_once)
        short &= sum(self.sizes[w] + 1 for w in words) + len(prefix) - 1 <= BLOCK
        codes = np.empty(len(short), np.int16)
        codes[short] = md5_codes(prefix, [(self.starts[w[short]], self.sizes[w[short]]) for w in words], self.letters)
        rest = np.flatnonzero(~short)
        codes[rest] = [self._code(prefix + "_".join(self.names[w[i]] for w in words)) for i in rest.tolist()]
        return codes

    def _learn(self, new: list[str]) -> None:
        """Words that are seen for the first time."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        first, n, letters = len(self.names), self.n_letters, np.frombuffer("".join(new).encode(), np.uint8)
        self.names += new
        self.letters, self.n_letters = _grown(self.letters, n, letters), n + len(letters)
        self.starts, self.sizes = _grown(self.starts, first, n + np.cumsum(sizes) - sizes), _grown(self.sizes, first, sizes)
        self.codes = _grown(self.codes, first, self._hashed("w:", np.arange(first, len(self.names))))

    def _of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Codes of pairs of words."""
        place = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        codes = self.pair_codes[place]
        new = np.flatnonzero(self.pairs[place] != pairs)
        if len(new):
            codes[new] = self._hashed("b:", pairs[new] >> WORD_BITS, pairs[new] & WORD - 1)
            self.pairs[place[new]], self.pair_codes[place[new]] = pairs[new], codes[new]
        return codes

    def _of_words(self, words: list[bytes], rows: np.ndarray, counted: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Rows, codes and counts of words, and of pairs of them."""
        if len(self.known) > MEMORY:
            self._forget()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn([w.decode() for w in self.known.new])
            self.known.new.clear()
        inside = rows[:-1] == rows[1:]
        pairs = (ids[:-1] << WORD_BITS | ids[1:])[inside]
        if not counted:
            return [(rows, self.codes[ids], None), (rows[:-1][inside], self._of_pairs(pairs), None)]
        key, tf = np.unique(rows << WORD_BITS | ids, return_counts=True)
        out = [(key >> WORD_BITS, self.codes[key & WORD - 1], tf)]
        # a part's rows and two words are 62 bits
        key, tf = np.unique(rows[:-1][inside] << 2 * WORD_BITS | pairs, return_counts=True)
        return [*out, (key >> 2 * WORD_BITS, self._of_pairs(key & WORD * WORD - 1), tf)]

    def _of_letters(self, digits: np.ndarray, rows: np.ndarray, n: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Rows, codes and counts of the runs of n letters."""
        size = len(digits) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64)
        gram = np.zeros(size, np.int32)
        for i in range(n):
            gram = gram * np.int32(36) + digits[i : i + size]
        inside = rows[:size] == rows[n - 1 :]
        row, gram, tf = rows[:size][inside], gram[inside], None
        if counted:
            # a part has 256 texts at most, a gram 21 bits
            key, tf = np.unique(row.astype(np.int32) << GRAM_BITS | gram, return_counts=True)
            row, gram = (key >> GRAM_BITS).astype(np.int64), key & (1 << GRAM_BITS) - 1
        table = self.grams[n]
        for g in np.unique(gram[table[gram] < 0]).tolist():
            text, rest = "", g
            for _ in range(n):
                rest, digit = divmod(rest, 36)
                text = _LETTERS[digit] + text
            table[g] = self._code(f"c{n}:{text}")
        return row, table[gram], tf

    def _terms(self, texts: list[str | None], counted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Rows and codes of the terms of texts; each term of a row once, with its count, where these are asked for."""
        own = [(t or "").encode() + b" " for t in texts]
        folded = b"".join(own).translate(_FOLDED)
        flat = np.frombuffer(folded, np.uint8)
        starts = np.cumsum([0, *map(len, own[:-1])])
        letter = flat != 32
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        of, rows = (np.repeat(np.arange(len(own)), np.add.reduceat(x, starts, dtype=np.int64)) for x in (first, letter))
        digits = _DIGIT[flat[letter]]
        yield from self._of_words(folded.split(), of, counted)
        yield self._of_letters(digits, rows, 3, counted)
        yield self._of_letters(digits, rows, 4, counted)

    def seen(self, texts: list[str | None]) -> np.ndarray:
        """How many of the texts have each bucket; terms needn't be counted for that."""
        out = np.zeros(DIMENSION, np.int64)
        for i in range(0, len(texts), PART):
            part = texts[i : i + PART]
            seen = np.zeros(len(part) * DIMENSION, bool)
            for row, code, _ in self._terms(part, False):
                seen[row * DIMENSION + (code >> 1)] = True
            out += seen.reshape(-1, DIMENSION).sum(0)
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row of sums for each text, and which buckets it has; in parts that fit a processor's cache."""
        if len(texts) <= PART:
            return self._part(texts)
        parts = [self._part(texts[i : i + PART]) for i in range(0, len(texts), PART)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _part(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros((0, DIMENSION)), np.zeros((0, DIMENSION), bool)
        row, code, tf = (np.concatenate(x) for x in zip(*self._terms(texts, True), strict=True))
        at = row * DIMENSION + (code >> 1)
        weight = _WEIGHTS[tf] if not len(tf) or tf.max() < len(_WEIGHTS) else 1.0 + np.log(tf)
        seen = np.zeros(len(texts) * DIMENSION, bool)
        seen[at] = True
        sums = np.bincount(at, np.where(code & 1, weight, -weight), len(seen))
        return sums.reshape(-1, DIMENSION), seen.reshape(-1, DIMENSION)

    def cosines(self, before: list[str | None], now: list[str | None], idf: np.ndarray | None) -> np.ndarray:
        """The cosine of each text with the one before it; nan where there is none. Rows of a part at a time: their vectors are not kept."""
        out = np.empty(len(now))
        for i in range(0, len(now), PART - 1):
            # rows come in order, so the text before is mostly the last row's; the others are embedded too
            own, last = now[i : i + PART - 1], before[i : i + PART - 1]
            at = np.arange(len(own)) - 1
            extra = [k for k, text in enumerate(last) if text is not None and (k == 0 or text != own[k - 1])]
            at[extra] = len(own) + np.arange(len(extra))
            x = self(own + [last[k] for k in extra])[0]
            if idf is not None:
                x *= idf
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            both = norm[: len(own)] * norm[at]
            found = np.divide(np.einsum("ij,ij->i", x[: len(own)], x[at]), both, out=np.zeros(len(own)), where=both > 0)
            found[[text is None for text in last]] = np.nan
            out[i : i + len(own)] = found
        return out


_hashers: dict[str, Hasher] = {}


def hasher(kind: str) -> Hasher:
    """A worker's hasher, which keeps what it knows from task to task."""
    return _hashers.setdefault(kind, Hasher(kind))


def unit_rows(sums: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    """Rows of sums as unit vectors, weighted by idf; rows of nothing stay zeros."""
    out = sums if idf is None else sums * idf
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def vectors(texts: list[str | None], idf: np.ndarray | None = None, kind: str = "md5") -> np.ndarray:
    """Unit vectors of texts, a row each."""
    return unit_rows(hasher(kind)(texts)[0], idf)


def idf(units: DataFrame, kind: str = "md5") -> DataFrame:
    """(bucket, idf, df) over units (text): a bucket counts once a text; ln((n + 1) / (df + 1)) + 1."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSION, np.int64), 0
        embed = hasher(kind)
        for batch in batches:
            total += embed.seen(batch["text"].to_pylist())
            n += batch.num_rows
        # one row for each bucket and task, and one, of bucket -1, for its texts
        yield pa.record_batch([pa.array(np.r_[-1, np.arange(DIMENSION)]), pa.array(np.r_[n, total])], ["bucket", "df"])

    counted = units.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    # 513 rows at most: one task puts the number of texts beside them, and texts are embedded once
    both = counted.withColumn("n", F.max(F.when(F.col("bucket") == -1, F.col("df"))).over(Window.partitionBy(F.lit(0)))).where("bucket >= 0 AND df > 0")
    return both.select("bucket", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"), "df")


def weights_of(idf_rows: DataFrame | None) -> np.ndarray | None:
    """The idf of all buckets; DIMENSION rows at most."""
    if idf_rows is None:
        return None
    out = np.zeros(DIMENSION)
    for r in idf_rows.select("bucket", "idf").collect():
        out[r["bucket"]] = r["idf"]
    return out


def embedder(weights: np.ndarray | None, kind: str = "md5"):
    """A column function: texts to unit vectors of DIMENSION floats."""
    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(list(vectors(part.tolist(), weights, kind).astype(np.float32)))

    return embed


def sparse_vectors(units: DataFrame, idf_rows: DataFrame, kind: str = "md5") -> DataFrame:
    """(document_id, ord, bucket, w): the buckets that each text of units has, as unit vectors."""
    weights = weights_of(idf_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(kind)
        for batch in batches:
            sums, seen = own(batch["text"].to_pylist())
            row, bucket = np.nonzero(seen)
            sums *= weights
            norm = np.sqrt((sums * sums).sum(1))
            norm[norm == 0] = np.nan
            w, row = pa.array(sums[row, bucket] / norm[row], from_pandas=True), pa.array(row)
            yield pa.record_batch([batch["document_id"].take(row), batch["ord"].take(row), pa.array(bucket), w], ["document_id", "ord", "bucket", "w"])

    return units.select("document_id", F.col("ord").cast("long").alias("ord"), "text").mapInArrow(run, "document_id string, ord long, bucket long, w double")


def neighbours(units: DataFrame, idf_rows: DataFrame, kind: str = "md5") -> DataFrame:
    """(document_id, ord, cosine) of each unit with the one before it; null where either has no terms."""
    weights = weights_of(idf_rows)

    @F.pandas_udf("double")
    def cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for before, now in batches:
            yield pd.Series(hasher(kind).cosines(before.tolist(), now.tolist(), weights))

    rows = units.selectExpr("document_id", "CAST(ord AS BIGINT) AS ord", "text", "lag(text) OVER (PARTITION BY document_id ORDER BY ord) AS before")
    return rows.select("document_id", "ord", F.nanvl(cosine("before", "text"), F.lit(None)).alias("cosine"))


def nearest(units: DataFrame, query: str, idf_rows: DataFrame | None, kind: str = "md5") -> DataFrame:
    """units (text and others) with ``score``, the cosine with a query."""
    weights = weights_of(idf_rows)
    asked = vectors([query], weights, kind)[0]

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(vectors(part.tolist(), weights, kind) @ asked)

    return units.withColumn("score", score("text"))


#: The same as steps; ``units`` has document_id, ord and text.
TERMS: list[Step] = [
    ("word_lists", "SELECT document_id, ord, @map(@extract_all(text, '[A-Za-z0-9]+'), w, lower(w)) AS ws FROM units"),
    ("joined_words", "SELECT document_id, ord, @join(ws, '') AS s, length(@join(ws, '')) AS n FROM word_lists"),
    ("tokens", "SELECT document_id, ord, i, w FROM @explode(word_lists, ws, i, w)"),
    ("terms", """
SELECT document_id, ord, concat('w:', w) AS term FROM tokens UNION ALL
SELECT document_id, ord, concat('b:', w, '_', f) AS term FROM (SELECT document_id, ord, w, lead(w) OVER (PARTITION BY document_id, ord ORDER BY i) AS f FROM tokens) x WHERE f IS NOT NULL UNION ALL
SELECT document_id, ord, concat('c3:', substr(s, CAST(i AS INT) + 1, 3)) AS term FROM @series((SELECT * FROM joined_words WHERE n >= 3), n - 2, i) UNION ALL
SELECT document_id, ord, concat('c4:', substr(s, CAST(i AS INT) + 1, 4)) AS term FROM @series((SELECT * FROM joined_words WHERE n >= 4), n - 3, i)"""),
    ("term_counts", "SELECT document_id, ord, term, @bucket(term, 512) AS bucket, 1 - 2 * @bit(term) AS sign, count(*) AS tf FROM terms GROUP BY document_id, ord, term"),
    ("bucket_sums", "SELECT document_id, ord, bucket, sum(sign * (1.0 + ln(tf))) AS s FROM term_counts GROUP BY document_id, ord, bucket"),
    ("idf", "SELECT bucket, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf, df FROM (SELECT bucket, count(*) AS df FROM bucket_sums GROUP BY bucket) b CROSS JOIN (SELECT count(*) AS n FROM units) c"),
    ("vectors", "SELECT document_id, ord, b.bucket, s * idf / nullif(sqrt(sum(s * idf * s * idf) OVER (PARTITION BY document_id, ord)), 0) AS w FROM bucket_sums b JOIN idf i ON b.bucket = i.bucket"),
    ("neighbours", "SELECT a.document_id, b.ord, sum(a.w * b.w) AS cosine FROM vectors a JOIN vectors b ON a.document_id = b.document_id AND a.bucket = b.bucket AND b.ord = a.ord + 1 GROUP BY a.document_id, b.ord"),
]

#: What the kernels read of units.
KERNEL_COLUMNS = "document_id ord text"
#: Steps that Spark runs by a kernel: what each reads, and the function of these.
KERNELS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "idf": (("units",), idf),
    "vectors": (("units", "idf"), sparse_vectors),
    "neighbours": (("units", "idf"), neighbours),
}
