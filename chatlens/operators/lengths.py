"""Question-length analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import truncate
from .temporal import dense_counts

# Bin widths tried for the histograms: 1, 2, 5 times a power of ten.
NICE_WIDTHS = tuple(m * 10 ** k for k in range(13) for m in (1, 2, 5))


def length_stats(qa: DataFrame, col: str = 'Fragenlänge_Zeichen') -> DataFrame:
    """min, max, mean and exact median (interpolated) in one aggregate.

    `median` keeps a value -> count map, so its state grows with the number of
    distinct lengths, not with the number of rows.
    """
    x = F.col(col)
    return qa.agg(F.min(x).alias('min_laenge'), F.max(x).alias('max_laenge'),
                  F.sum(x).alias('_s'), F.count(x).alias('_n'),
                  F.median(x).alias('median_laenge')).select(
        'min_laenge', 'max_laenge',
        F.try_divide(F.col('_s').cast('double'), F.col('_n')).alias('mittlere_laenge'),
        F.col('median_laenge').cast('double').alias('median_laenge'))


def length_bands(qa: DataFrame, col: str = 'Längenkategorie') -> DataFrame:
    """(pos, Längenkategorie, Anzahl, Anteil) for observed bands."""
    return dense_counts(qa, col, D.LENGTH_BAND_ORDER, 'Längenkategorie', drop_zero=True)


def length_histogram(qa: DataFrame, col: str = 'Fragenlänge_Zeichen', max_bins: int = 30) -> DataFrame:
    """Fixed-width histogram (E14): width = smallest of 1/2/5 x 10^k giving at
    most `max_bins` bins over [min, max]; bins start at multiples of the width.

    Rows are first reduced to (value, count) - one row per distinct length,
    combined map-side. The width is a scalar subquery over that frame (its
    min and max): one value computed once and handed to every task, with no
    window that would pull all distinct lengths into one partition.
    """
    vc = qa.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias('x')).agg(
        F.count(F.lit(1)).alias('n'))
    widths = F.array(*[F.lit(w).cast('bigint') for w in NICE_WIDTHS])
    rng = vc.agg(F.min('x').alias('mn'), F.max('x').alias('mx'))
    width = rng.select(F.array_min(F.filter(
        widths, lambda w: F.floor(F.col('mx') / w) - F.floor(F.col('mn') / w) + 1 <= max_bins)).alias('w'))
    binned = vc.select('x', 'n', width.scalar().alias('w')).select(
        'n', 'w', (F.floor(F.col('x') / F.col('w')) * F.col('w')).cast('bigint').alias('bin_start'))
    return binned.groupBy('bin_start', 'w').agg(F.sum('n').alias('Anzahl')).select(
        'bin_start', (F.col('bin_start') + F.col('w')).alias('bin_end'), 'Anzahl')


def shortest_questions(qa: DataFrame, k: int = 5, col: str = 'Fragenlänge_Zeichen') -> DataFrame:
    """k shortest questions; ties go to the earlier question (H2).

    `orderBy(...).limit(k)` plans as TakeOrderedAndProject: each partition
    keeps its own k best, only those reach the final merge.
    """
    return (qa.orderBy(F.col(col).asc(), F.col('Datetime').asc(), F.col('id').asc()).limit(k)
            .select('id', 'Datetime', 'Frage', col))


def longest_questions(qa: DataFrame, k: int = 5, col: str = 'Fragenlänge_Zeichen',
                      preview: int = 100) -> DataFrame:
    """k longest questions with a 100-character preview ending in '...' (H2, C13)."""
    return (qa.orderBy(F.col(col).desc(), F.col('Datetime').asc(), F.col('id').asc()).limit(k)
            .select('id', 'Datetime', 'Frage', col,
                    truncate('Frage', preview, always_ellipsis=True).alias('Vorschau')))
