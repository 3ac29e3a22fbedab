"""Documents to training-ready token sequences: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, langid, mixing, neardup, tokens
from feedloom.llm.queries import read
from feedloom.llm.store import materialise

#: Bits a byte that the best language's tree may need; known languages take 2 to 4, bytes of no language up to 8.
MOST_BITS = 7.5


def _free(docs: DataFrame, name: str) -> str:
    """A column's name that docs does not use, in any case of letters."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, or that no tree can code, go."""
    lang, score, bits = (_free(docs, c) for c in ("_lang_pred", "_lang_score", "_lang_bits"))
    found = langid.identify(docs, names=(lang, score, bits))
    return found.where((F.col(lang) != langid.UND) & (F.col(bits) <= MOST_BITS)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.scrub(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """slot, shard, byte_offset, sequence, n_tokens, crc32 of every sequence in the shards written."""
    return tokens.write(docs)


STAGES = [
    ("language ID", language),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_mix),
    ("token ids", token_ids),
]

#: Code lengths, sketches and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
