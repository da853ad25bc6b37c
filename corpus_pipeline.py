"""From raw documents to packed sequences: quality, near duplicates, personal data, mixing, packing.

Each stage works on all rows that the stage before it kept, gets them as a written table and
returns the columns of ``documents``; the last one returns packed pieces. What a stage returns must be
written before the next one is called, which begins by deleting the intermediate tables of the stage before it.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leakscan.llm import mixture, near_dedup, packing, pseudonyms, quality
from leakscan.llm.queries import PSEUDONYM_KEY, vocabulary_path
from leakscan.scratch import discard, scratch_root, written_meanwhile

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that was called last.
_left: list[DataFrame] = []


def _deleting(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_left)
        with written_meanwhile() as tables:
            result = stage(spark, docs, sf_dir)
        _left[:] = tables
        return result

    return run_stage


@_deleting
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, quality.TailRules())


@_deleting
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


@_deleting
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and names of mailboxes become pseudonyms."""
    return pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)


@_deleting
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mix(docs)


@_deleting
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("source_mixture", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express MinHash links, Feistel networks or byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
