"""Topic analyses over the QA table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import topic_array, topic_label
from .temporal import dense_counts


def topic_labels(df: DataFrame, text_col: str = 'Frage', id_col: str = 'id',
                 topics=D.TOPIC_KEYWORDS) -> DataFrame:
    """(id, Kategorie) with the ', '-joined labels."""
    return df.select(id_col, topic_label(topic_array(text_col, topics)).alias('Kategorie'))


def topic_counts(qa: DataFrame, col: str = 'Themen') -> DataFrame:
    """(Kategorie, Anzahl) over exploded labels (E10); multi-label rows count
    once per label."""
    return (qa.select(F.explode(col).alias('Kategorie'))
            .groupBy('Kategorie').agg(F.count(F.lit(1)).alias('Anzahl')))


def topic_daily_trend(qa: DataFrame, main=D.MAIN_TOPICS, col: str = 'Themen') -> DataFrame:
    """(Datum, Kategorie, Anzahl) for each observed day x main topic, zeros kept
    (E9). One grouped aggregate with a `count_if` per topic replaces the
    original's day x topic loop."""
    return dense_counts(qa, lambda t: F.array_contains(col, t), main, 'Kategorie',
                        by=['Datum'], share_name=None).drop('pos')


def topic_mean_length(qa: DataFrame, top: int = 10, col: str = 'Themen',
                      length: str = 'Fragenlänge_Zeichen') -> DataFrame:
    """Mean question length for the `top` most frequent topics (E11), one pass:
    explode, then count and mean per topic."""
    e = qa.select(F.explode(col).alias('Kategorie'), F.col(length).alias('_len'))
    g = e.groupBy('Kategorie').agg(F.count(F.lit(1)).alias('Anzahl'), F.sum('_len').alias('_s'),
                                   F.count('_len').alias('_n'))
    return (g.orderBy(F.col('Anzahl').desc(), F.col('Kategorie').asc()).limit(top)
            .select('Kategorie', 'Anzahl',
                    F.try_divide(F.col('_s').cast('double'), F.col('_n')).alias('Durchschnittslänge')))
