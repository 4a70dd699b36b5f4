"""Overview metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview_metrics(qa: DataFrame) -> DataFrame:
    """One row: total questions, first/last date, questions per day, mean
    question length, most active hour.

    Questions per day divides by (last - first) in days, not +1, as the
    original does; single-day data gives NULL instead of an error. The most
    active hour is the mode, smallest hour on ties. One aggregate pass.
    """
    length = F.col('Fragenlänge_Zeichen')
    g = qa.agg(
        F.count(F.lit(1)).alias('gesamt_fragen'),
        F.min('Datum').alias('erster_tag'),
        F.max('Datum').alias('letzter_tag'),
        F.sum(length).alias('_sum'),
        F.count(length).alias('_n'),
        F.mode('Stunde', deterministic=True).alias('aktivste_stunde'),
    )
    return g.select(
        'gesamt_fragen', 'erster_tag', 'letzter_tag',
        F.try_divide(F.col('gesamt_fragen').cast('double'),
                     F.datediff('letzter_tag', 'erster_tag')).alias('fragen_pro_tag'),
        F.try_divide(F.col('_sum').cast('double'), F.col('_n')).alias('mittlere_laenge'),
        F.col('aktivste_stunde').cast('int').alias('aktivste_stunde'),
    )
