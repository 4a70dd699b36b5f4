"""Export of classified messages (A3)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ('frage', 'rolle', 'kategorie', 'sentiment', 'datetime')


def write_classification_json(classified: DataFrame, path: str, mode: str = 'errorifexists') -> None:
    """JSON lines, one object per message, non-ASCII kept as is; written by
    the executors in parallel (the distributed form of the download)."""
    cols = [c for c in EXPORT_COLUMNS if c in classified.columns]
    (classified.select(*cols).write.mode(mode)
     .option('timestampNTZFormat', "yyyy-MM-dd HH:mm:ss").json(path))


def read_classification_json(spark, path: str) -> DataFrame:
    """Read an export written by `write_classification_json` back, with its
    declared schema."""
    return (spark.read.schema('frage string, rolle string, kategorie string, sentiment string, '
                              'datetime timestamp_ntz')
            .option('timestampNTZFormat', "yyyy-MM-dd HH:mm:ss").json(path))


def classification_json_column(classified: DataFrame) -> DataFrame:
    """Each message as a JSON text column (`to_json`)."""
    cols = [c for c in EXPORT_COLUMNS if c in classified.columns]
    return classified.select(F.to_json(F.struct(*cols)).alias('json'))


def classification_document(classified_latest: DataFrame, limit: int = 20) -> str:
    """The original's single pretty-printed document: the `limit` newest
    messages, the size of the latest-messages cut that it shows (larger sets
    are `write_classification_json`'s). Newest first, by the cut's `nr` where it is there (a question and its
    answer have one time), else by time, then by the other columns."""
    order = [F.col('datetime').desc_nulls_last()] if 'datetime' in classified_latest.columns else []
    order += [F.col(c).asc_nulls_last() for c in EXPORT_COLUMNS[:-1] if c in classified_latest.columns]
    if 'nr' in classified_latest.columns:
        order = [F.col('nr').asc(), *order]
    rows = classified_latest.orderBy(*order).limit(limit).collect()
    cols = [c for c in EXPORT_COLUMNS if c in classified_latest.columns]
    return json.dumps([{c: r[c] for c in cols} for r in rows], indent=2, default=str,
                      ensure_ascii=False)
