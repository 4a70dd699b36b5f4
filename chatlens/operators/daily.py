"""Summaries kept up to date by day.

`refresh_days` reduces the QA rows of the days that a load has changed to
mergeable counts (Datum, Art, Wert, Anzahl, erst): per day one row for each
hour, topic, question length and keyword. The summaries add up these rows, so
they never read the questions of other days again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as D
from ..functions import german_weekday, tokens
from ..sources.days import DAY, overwrite_days, read_days
from .keywords import top_keywords

HOUR, TOPIC, LENGTH, WORD = 'Stunde', 'Thema', 'Länge', 'Wort'

SCHEMA = T.StructType([T.StructField('Art', T.StringType()), T.StructField('Wert', T.StringType()),
                       T.StructField('Anzahl', T.LongType()), T.StructField('erst', T.TimestampNTZType()),
                       T.StructField(DAY, T.DateType())])


def daily_parts(qa: DataFrame, dicts: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """(Art, Wert, Anzahl, erst, Datum) of QA rows; `erst` is the least time.
    One pass: each row gives its hour, length, topics and words, and count and
    least time are added up in a hash aggregate, map-side first."""
    def part(art, value):
        return F.struct(F.lit(art).alias('Art'), value.cast('string').alias('Wert'))

    parts = F.concat(F.array(part(HOUR, F.col('Stunde')), part(LENGTH, F.col('Fragenlänge_Zeichen'))),
                     F.transform('Themen', lambda t: part(TOPIC, t)),
                     F.transform(F.coalesce(tokens('Frage', 3), F.array().cast('array<string>')), lambda w: part(WORD, w)))
    rows = qa.select(DAY, 'Datetime', F.inline(parts))
    rows = rows.filter((F.col('Art') != WORD) | ~F.col('Wert').isin(*dicts.stopwords))
    return (rows.groupBy(DAY, 'Art', 'Wert').agg(F.count(F.lit(1)).alias('Anzahl'), F.min('Datetime').alias('erst'))
            .select(*SCHEMA.fieldNames()))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return read_days(spark, path, SCHEMA)


def refresh_days(qa: DataFrame, path: str, days: list[dt.date], dicts: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Rebuild the counts of `days` (`load_days` returns them) from the QA
    table partitioned by day, and return all counts. Run again it writes the
    same."""
    spark = qa.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode('ignore').partitionBy(DAY).parquet(path)
    if days:
        overwrite_days(daily_parts(qa.filter(F.col(DAY).isin(days)), dicts), path)
    return read_parts(spark, path)


def questions_per_day(parts: DataFrame) -> DataFrame:
    """(Datum, Anzahl) over observed days (E6): every question has one length."""
    return parts.filter(F.col('Art') == LENGTH).groupBy(DAY).agg(F.sum('Anzahl').alias('Anzahl'))


def weekday_hour_heatmap(parts: DataFrame) -> DataFrame:
    """(Stunde, pos, Wochentag, Anzahl) as `temporal.weekday_hour_heatmap`."""
    day = german_weekday(DAY)
    hours = parts.filter(F.col('Art') == HOUR).groupBy(F.col('Wert').cast('int').alias('Stunde')).agg(*[
        F.sum(F.when(day == w, F.col('Anzahl')).otherwise(0)).alias(f'_{i}') for i, w in enumerate(D.WEEKDAYS)])
    return hours.select('Stunde', F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias('pos'), F.lit(w).alias('Wochentag'), F.col(f'_{i}').alias('Anzahl'))
        for i, w in enumerate(D.WEEKDAYS)])))


def topic_daily_trend(parts: DataFrame, main=D.MAIN_TOPICS) -> DataFrame:
    """(Datum, Kategorie, Anzahl) for each observed day x main topic."""
    days = parts.filter(F.col('Art').isin(TOPIC, LENGTH)).groupBy(DAY).agg(*[
        F.sum(F.when((F.col('Art') == TOPIC) & (F.col('Wert') == t), F.col('Anzahl')).otherwise(0)).alias(f'_{i}')
        for i, t in enumerate(main)])
    return days.select(DAY, F.inline(F.array(*[
        F.struct(F.lit(t).alias('Kategorie'), F.col(f'_{i}').alias('Anzahl')) for i, t in enumerate(main)])))


def length_stats(parts: DataFrame) -> DataFrame:
    """Least, greatest, mean and exact median question length (E3, E4), the
    counts being the frequencies."""
    x, n = F.col('Wert').cast('int'), F.col('Anzahl')
    return parts.filter(F.col('Art') == LENGTH).agg(
        F.min(x).alias('min_laenge'), F.max(x).alias('max_laenge'),
        F.try_divide(F.sum(x.cast('bigint') * n).cast('double'), F.sum(F.when(x.isNotNull(), n))).alias('mittlere_laenge'),
        F.percentile(x, 0.5, n).alias('median_laenge'))


def keywords(parts: DataFrame, qa: DataFrame, n: int = 25, dicts: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """`keywords.top_keywords` from the daily counts (E8). Only words level in
    count and first time are looked up in `qa`, in the rows of that time."""
    counts = parts.filter(F.col('Art') == WORD).groupBy(F.col('Wert').alias('Keyword')).agg(
        F.sum('Anzahl').alias('Anzahl'), F.min('erst').alias('first'))
    return top_keywords(qa, n, dicts=dicts, counts=counts)
