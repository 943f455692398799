"""Document fingerprints by content-defined chunking.

A gear hash of the last bytes marks boundaries by content alone, so an
insertion moves only the boundaries near it. A fingerprint is the set of chunk
digests with their lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import NULL_ID, prepare
from stratapage.llm.kernels import BYTE_HASH, mix, prefix_hash, span_hash

#: Bytes of a chunk: at least, aimed at, at most. Before the aim a boundary needs more zero bits than after it.
LEAST, AIM, MOST = 24, 64, 256
STRICT, LOOSE = 7, 5
#: Bytes that the gear hash sees.
REACH = 32
_U = np.uint64


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if not n:
        return []
    gear = BYTE_HASH[data]
    have = 1
    while have < REACH:  # the sum of the last 2, 4, ... bytes' values, each shifted by its age
        gear[have:] += gear[:-have] << _U(have) if n > have else _U(0)
        have *= 2
    top = gear >> _U(64 - STRICT)
    marks = np.flatnonzero((top >> _U(STRICT - LOOSE)) == 0) + 1
    strict = (top[marks - 1] == 0).tolist()
    marks = marks.tolist()
    out, start, i, m = [], 0, 0, len(marks)
    while start < n:
        end = min(start + MOST, n)
        while i < m and marks[i] < start + LEAST:
            i += 1
        j = i
        while j < m and marks[j] < end:
            if strict[j] or marks[j] >= start + AIM:
                end = marks[j]
                break
            j += 1
        i = j
        out.append(end)
        start = end
    return out


def chunks(raw: bytes) -> dict[int, int]:
    """The distinct chunk digests of a text, with the bytes that each covers."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.array(boundaries(data), np.int64)
    if not len(ends):
        return {}
    starts = np.r_[0, ends[:-1]]
    digests = mix(span_hash(prefix_hash(data), starts, ends)) >> _U(16)
    found, at = np.unique(digests, return_inverse=True)
    return dict(zip(found.tolist(), np.bincount(at, weights=ends - starts).astype(np.int64).tolist(), strict=True))


def fingerprint(found: dict[int, int]) -> str:
    """The digests in order, each as 12 hex digits, a colon and its bytes."""
    return " ".join([f"{d:012x}:{n}" for d, n in found.items()])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of common chunks, of the larger text's bytes; two empty texts are alike."""
    total = max(sum(a.values()), sum(b.values()))
    if not total:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return min(1.0, sum(min(n, large[d]) for d, n in small.items() if d in large) / total)


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes of a's chunks that b has too, of a's bytes; an empty text is contained in all."""
    total = sum(a.values())
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """text with its last half of code points replaced by as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows in order of (part, halo, place, text's hash, text); a part's last document is followed by its halo's first."""
    held = None  # part, id, text and chunks of the row that waits for the next
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for part, halo, doc, text in zip(*(batch[c].to_pylist() for c in ("part", "halo", "doc", "text")), strict=True):
            if halo and (held is None or held[0] != part):
                continue  # only the first row of a halo is needed
            found = chunks(text.encode())
            if held is not None and held[0] == part:
                new = edited(held[2], text).encode()
                changed = chunks(new)
                own = held[3]
                out.append((held[1], len(held[2]), hashlib.sha256(new).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, found), containment(own, changed), containment(own, found)))
            held = None if halo else (part, doc, text, found)
        if out:
            yield pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


class Ranges:
    """Cuts in the order of (place, hash); a row's range is the number of cuts up to it."""

    def __init__(self, cuts: list[tuple[int, int]]) -> None:
        cuts = sorted(set(cuts))
        self.places = np.array([c[0] for c in cuts], np.int64)
        self.hashes = np.array([c[1] for c in cuts], np.int64)

    def __call__(self, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.places, place, "left")
        high = np.searchsorted(self.places, place, "right")
        tied = np.flatnonzero(high > out)
        for p in np.unique(place[tied]):
            own = tied[place[tied] == p]
            a, b = out[own[0]], high[own[0]]
            out[own] = a + np.searchsorted(self.hashes[a:b], hashes[own], "right")
        return out.astype(np.int32)


def _ranges(slim: DataFrame, n: int) -> Ranges:
    """About n ranges of like many rows; an id of more rows than one should hold, or none, is cut by the hashes of its texts."""
    shares = [i / n for i in range(1, n)]
    cuts = sorted(slim.select(F.percentile_approx("place", shares, 20 * n).alias("c")).first()["c"] or [])
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    out = [(c, -(2**63)) for c in cuts]
    if hot:
        found = slim.where(F.col("place").isin(hot)).groupBy("place").agg(F.percentile_approx("alt", shares, 20 * n).alias("c")).collect()
        out += [(r["place"], c) for r in found for c in r["c"]]
    return Ranges(out)


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """For each row its fingerprint, that of its text edited with the next one, and how near they are.

    near_ is the likeness, in_ the share of the row's text that the other
    contains, both by the bytes of common chunks. The next row is that of the
    next smaller doc_id; after the last comes the first. Rows are dealt to
    ranges of ids; each range also gets the first document of the next, so no
    row waits for a whole-table sort in one task.

    Nulls: a null text is empty; null ids come after all others. Rows that
    share an id, or have none, follow each other by a hash of their texts, and
    are cut into ranges by it where they are many; rows equal in both stay in
    one range. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    # ~id falls as the id rises, and null takes the place after all
    slim = docs.select(F.coalesce(F.bitwise_not(docs["doc_id"].cast("long")), F.lit(NULL_ID)).alias("place"), docs["doc_id"].cast("long").alias("doc"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("alt", F.xxhash64("text"))
    tasks = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(slim, 4 * tasks)  # hashing ranges to tasks is uneven; several to a task even it out

    @F.pandas_udf("int")
    def range_of(place: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series(ranges(place.to_numpy(), alt.to_numpy()))

    dealt = slim.withColumn("part", range_of("place", "alt"))
    # the first row of each range that has rows: as many values as ranges
    firsts = [tuple(r) for r in dealt.groupBy("part").agg(F.min(F.struct("place", "alt")).alias("f")).select("part", "f.*").orderBy("part").collect()]
    if not firsts:
        return spark.createDataFrame([], _FOUND)
    follows = spark.createDataFrame([(firsts[i][0], *firsts[(i + 1) % len(firsts)][1:]) for i in range(len(firsts))], "part int, place long, alt long")
    halo = slim.join(F.broadcast(follows), ["place", "alt"])
    rows = dealt.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)))
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", "halo", "place", "alt", "text").select("part", "halo", "doc", "text")
    return rows.mapInArrow(_compare, _FOUND)
