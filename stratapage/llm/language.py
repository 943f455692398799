"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text
is compressed with each, in blocks that know the dictionary alone; the language
whose dictionary makes it smallest wins, and a win by a narrow margin is
rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from stratapage.llm.common import prepare

#: Training sample: texts of each language at most, and bytes of each language's dictionary.
SAMPLE_TEXTS, DICTIONARY_BYTES = 400, 48_000
#: Bytes of a dictionary that one training text may give, so that a long one doesn't make it alone, and the pieces that these are taken in from all over the text.
SHARE_BYTES, SHARE_PIECES = 2_000, 4
#: Bytes of a text that are compressed at once: a longer run would learn from itself what the dictionary knows, and the saving would no longer grow with the text.
BLOCK_BYTES = 4096
#: Bytes that the best must save on the second best, for each hundred bytes of the best, and besides for any text, as a few bytes are chance: less is rejected.
MARGIN, CHANCE_BYTES = 2, 3
LEVEL = 6

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def fold(name: str, n: int):
    """crc32 of a document id's text, modulo n."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(n))


def train(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang`` of docs, of a bounded sample of its texts.

    The sample is the SAMPLE_TEXTS texts of smallest hash in each language, so
    it is the same whatever the partitions; equal texts count once. Texts
    without a letter are left out. Each text gives ``share`` of its whole
    length. One row for each language goes to the driver, of SAMPLE_TEXTS times
    SHARE_BYTES at most.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text").where(F.col("text").rlike(r"\p{L}"))
    return {row["lang"]: b"".join(map(bytes, row["shares"]))[:DICTIONARY_BYTES] for row in _smallest(rows).collect()}


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.array([share(normal(t.as_py())) for t in batch["text"]], pa.binary())
        yield pa.record_batch([batch["lang"], batch["h"], own], ["lang", "h", "share"])


def share(raw: bytes) -> bytes:
    """What a training text gives of its normal form: all of it, or SHARE_PIECES runs that lie evenly over the whole."""
    if len(raw) <= SHARE_BYTES:
        return raw
    size = SHARE_BYTES // SHARE_PIECES
    step = (len(raw) - size) // (SHARE_PIECES - 1)
    return b"".join(raw[i * step : i * step + size] for i in range(SHARE_PIECES))


def _smallest(rows: DataFrame) -> DataFrame:
    """(lang, shares): those of the SAMPLE_TEXTS texts of smallest hash of each language, by two bounded steps."""
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # a coarse cut first, by the share of hashes that holds about twice the sample; copies are met before any list is made
    part = F.lit(2.0 * SAMPLE_TEXTS + 64) / F.approx_count_distinct("h")
    # a row for each language, as the result has: so the texts needn't be dealt out to be cut
    cuts = [F.lit(x) for r in hashed.groupBy("lang").agg(part.alias("part")).collect() for x in (r["lang"], r["part"])]
    cut = F.try_element_at(F.create_map(*cuts), F.col("lang")) if cuts else F.lit(0.0)
    near = hashed.where(F.shiftrightunsigned("h", 1) / F.lit(float(2**63)) <= cut).mapInArrow(_shares, "lang string, h long, share binary")
    near = near.groupBy("lang", "h").agg(F.min("share").alias("share"))
    return near.groupBy("lang").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("h", "share"))), lambda x: x["share"]), 1, SAMPLE_TEXTS).alias("shares"))


def normal(text: str) -> bytes:
    """What is compressed of a text: its letters in lower case, all between two runs of letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode()


def text_blocks(raw: bytes) -> Iterator[bytes]:
    """The whole text in runs of BLOCK_BYTES at most, cut behind a space where there is one."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        end = raw.rfind(b" ", at, at + BLOCK_BYTES) + 1 or at + BLOCK_BYTES
        yield raw[at:end]
        at = end
    yield raw[at:]


class Classifier:
    """Compresses with the dictionaries of all languages, in order of their names."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 and whether the margin is too narrow."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        parts = list(text_blocks(normal(text)))
        sizes = sorted((sum(len(c.compress(part)) for part in parts), i) for i, c in enumerate(self.compressors))
        best, at = sizes[0]
        if len(sizes) == 1:
            return self.names[at], 1.0, False
        second = sizes[1][0]
        saved = (second - best) / max(1, second)
        # half of a text's bytes saved on the second best is as sure as it gets
        return self.names[at], min(1.0, 0.5 + saved), 100 * (second - best - CHANCE_BYTES) < MARGIN * best


_classifier: dict[str, object] = {}


def _of(shared) -> Classifier:
    if _classifier.get("raw") is not shared.value:
        _classifier.update(raw=shared.value, model=Classifier(shared.value))
    return _classifier["model"]


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score and rejected, judged by the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.
    Equal sizes go to the first name. Without dictionaries all are ``und``.
    Repeated rows are judged alike; all columns are kept, but for those of docs
    that have one of the three names: they are replaced. An empty table gives
    an empty one.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _of(shared)
            found = [model(t.as_py()) for t in batch["text"]]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    added = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return docs.mapInArrow(run, added)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected); learns from rows whose id's crc32 modulo 4 isn't 2, predicts for all.

    A null id is in no fold: it isn't learned from and not held out.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    dictionaries = train(slim.where(fold("doc_id", 4) != 2))
    found = identify(slim.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected; learns as ``predictions`` does.

    Null and letterless texts go, and ties: they can't be told. Null ids are
    judged like others; repeated rows stay or go alike. All columns come back
    as they were, whatever their names; an empty table gives an empty one.
    """
    typed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    dictionaries = train(typed.where(fold("doc_id", 4) != 2))
    names = docs.columns
    renamed = docs.select(*(F.col(c).alias(f"_{i}") if c != "text" else F.col(c).cast("string").alias("text") for i, c in enumerate(names)))
    kept = identify(renamed, dictionaries).where("NOT rejected")
    return kept.select(*(F.col(f"_{i}").alias(c) if c != "text" else F.col("text") for i, c in enumerate(names)))
