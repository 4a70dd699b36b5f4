"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing,
packing. Each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatlens.llm import line_dedup, mixing, packing, quality, simhash
from chatlens.llm.common import scratch_table
from chatlens.llm.queries import PACK_END, PACK_TOKENIZER
from chatlens.sources.tables import documents

#: Pieces a worker keeps while packing: fewer than by default, since the
#: executors' heaps have grown in the stages before.
CACHE_PIECES = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def near_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat earlier ones."""
    return line_dedup.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs)


def pack_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.piece_digests(packing.pack_mixture(
        docs, public_tokenizers.path(PACK_TOKENIZER), PACK_END, cache=CACHE_PIECES))


STAGES = [('quality_rules', quality_rules), ('line_dedup', near_line_dedup), ('simhash_dedup', simhash_dedup),
          ('mix_sources', mix_sources), ('pack_mixture', pack_mixture)]

#: Fitting, linking and drawing in turn are not SQL; tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared scratch folder and read
    by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f'pipeline-{name}')
    return docs
