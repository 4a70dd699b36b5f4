"""Parquet tables: the flat message table and the text/event tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
          'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f'{name}.parquet')


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id bigint, turn bigint, role string, text string)."""
    return read_table(spark, sf_dir, 'conversations')


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id bigint, text string, lang string, source string, n_chars bigint)."""
    return read_table(spark, sf_dir, 'documents')


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, ...)."""
    return read_table(spark, sf_dir, 'events')
