"""Training-data pipeline: language ID, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept. All but the last return the columns of documents; the last returns
(doc_id, lang, source, n_tokens, ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratapage.llm import bpe, decontaminate, language, minhash, suffixes
from stratapage.llm.common import discard, prepare, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, on five-word shingles from a similarity of 0.8, one document stays."""
    return minhash.drop_duplicates(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier text has go; a document that was nothing else goes with them."""
    return suffixes.remove_repeats(docs, length=100)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, and of others the words that benchmark items have."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", encode),
]

#: SQL has no zstandard and no BPE: tests/llm/test_pipeline.py holds run() against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's rows written before the next reads them; what is read goes then."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
