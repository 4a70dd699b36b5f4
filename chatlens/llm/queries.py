"""The registered queries of the pipeline operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import documents, read_table
from . import (fill_middle, importance, jaccard, line_dedup, manifest, merkle, mixing, packing, pii, quality,
               secret_scan, simhash, token_orc)
from .oracle import ORACLE_SQL  # noqa: F401

PACK_TOKENIZER, PACK_END = 'byte_bpe_50k.json', 0
ORC_TOKENIZER, ORC_END = 'word_bpe_49k.json', 2


def _counts(spans: str, kinds) -> list:
    def count(kind):
        return F.size(F.filter(spans, lambda s: s['kind'] == kind)).cast('long').alias(f'n_{kind}')
    return [count(k) for k in kinds]


def op1_quality_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, d)).select(
        'doc_id', 'n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words', 'base_failed', 'kept',
        'distance')


def op2_mixture_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.piece_digests(packing.pack_mixture(
        documents(spark, d), public_tokenizers.path(PACK_TOKENIZER), PACK_END))


def op3_simhash_anchors(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, d))
    return found.select('doc_id', F.lpad(F.lower(F.hex('fp')), 16, '0').alias('fingerprint'), 'component_id')


def op4_token_orc(spark: SparkSession, d: str) -> DataFrame:
    return token_orc.token_digests(documents(spark, d), public_tokenizers.path(ORC_TOKENIZER), ORC_END)


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = line_dedup.dropped_lines(documents(spark, d))
    return found.select('doc_id', F.col('n_lines').alias('n_checked'), F.size('exact').cast('long').alias('n_exact'),
                        F.size('near').cast('long').alias('n_near'), F.array_join('exact', ',').alias('exact_lines'),
                        F.array_join('near', ',').alias('near_lines'))


def op6_credential_linking(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.secrets(documents(spark, d))
    return found.select('doc_id', *_counts('strong', ('assign', 'access', 'hex')), F.sha2(secret_scan.joined('strong'), 256).alias('base_sha256'),
                        secret_scan.joined('spans').alias('spans'))


def op7_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return importance.resample(documents(spark, d), read_table(spark, d, 'labels'))


def op8_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, d)).select(
        'doc_id', 'size', 'source_size', 'target', (F.col('size') * F.col('copies')).alias('taken'))


def op9_pii_weak_supervision(spark: SparkSession, d: str) -> DataFrame:
    found = pii.personal_data(documents(spark, d))
    return found.select('doc_id', *_counts('base', pii.KINDS), F.sha2(pii.joined('base'), 256).alias('base_sha256'),
                        pii.joined('spans').alias('spans'))


def op10_merkle(spark: SparkSession, d: str) -> DataFrame:
    return merkle.edited_pairs(documents(spark, d))


def op11_fill_middle(spark: SparkSession, d: str) -> DataFrame:
    return fill_middle.fim_digests(documents(spark, d))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.Manifest(documents(spark, d)).verdicts()


def op13_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, d)).select('doc_id', 'n_shingles', 'component_id')


QUERIES = {f.__name__: f for f in (
    op1_quality_outliers, op2_mixture_packing, op3_simhash_anchors, op4_token_orc, op5_line_dedup,
    op6_credential_linking, op7_importance_resampling, op8_source_mixing, op9_pii_weak_supervision, op10_merkle,
    op11_fill_middle, op12_merkle_manifest, op13_jaccard_join)}
