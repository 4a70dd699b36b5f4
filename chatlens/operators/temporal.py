"""Counts over time features.

Dense counts over a fixed domain (7 weekdays, 5 dayparts) are computed as one
aggregate of `count_if` columns, then turned into rows with `inline`: one pass,
partial aggregation map-side, no join against a dimension table and no
all-pairs product. Zeros are kept because every domain value is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D


def dense_counts(df: DataFrame, value, domain, label: str,
                 by: list[str] | None = None, count_name: str = 'Anzahl',
                 share_name: str | None = 'Anteil', where: Column | None = None,
                 drop_zero: bool = False) -> DataFrame:
    """Count rows per domain value (in domain order, `pos` 1..n), zeros kept.

    `value` is a column (counted where equal to the domain value) or a
    function domain value -> boolean column. `by` adds grouping keys (e.g. hour
    for the heat map); `where` restricts which rows count; the share is each
    count over the domain total.
    """
    if callable(value):
        match = value
    else:
        v = F.col(value) if isinstance(value, str) else value
        match = lambda x: v == x
    cond = match if where is None else (lambda x: match(x) & where)
    aggs = [F.count_if(cond(x)).alias(f'_c{i}') for i, x in enumerate(domain)]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    total = None
    for i in range(len(domain)):
        total = F.col(f'_c{i}') if total is None else total + F.col(f'_c{i}')
    rows = F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias('pos'), F.lit(x).alias(label), F.col(f'_c{i}').alias(count_name))
        for i, x in enumerate(domain)]))
    out = g.select(*(by or []), total.alias('_total'), rows)
    if drop_zero:
        out = out.filter(F.col(count_name) > 0)
    cols = [*(by or []), 'pos', label, count_name]
    if share_name:
        cols.append(F.try_divide(F.col(count_name), F.col('_total')).alias(share_name))
    return out.select(*cols)


def questions_per_day(qa: DataFrame) -> DataFrame:
    """(Datum, Anzahl) over observed days."""
    return qa.groupBy('Datum').agg(F.count(F.lit(1)).alias('Anzahl'))


def weekday_counts(qa: DataFrame, col: str = 'Wochentag') -> DataFrame:
    """(pos, Wochentag, Anzahl, Anteil) for all 7 days, Monday first."""
    return dense_counts(qa, col, D.WEEKDAYS, 'Wochentag')


def daypart_counts(qa: DataFrame, col: str = 'Tageszeit') -> DataFrame:
    """(pos, Tageszeit, Anzahl, Anteil) for all 5 dayparts."""
    return dense_counts(qa, col, D.DAYPART_ORDER, 'Tageszeit')


def hour_counts(qa: DataFrame, col: str = 'Stunde') -> DataFrame:
    """(Stunde, Anzahl) over observed hours."""
    return qa.groupBy(F.col(col).alias('Stunde')).agg(F.count(F.lit(1)).alias('Anzahl'))


def weekday_hour_heatmap(qa: DataFrame, weekday: str = 'Wochentag', hour: str = 'Stunde',
                         counted: str | None = 'Frage') -> DataFrame:
    """Long form of the weekday x hour table (E12): every weekday for every
    observed hour, count of non-null `counted`, zeros kept.

    Grouped by hour (at most 24 groups) with one `count_if` per weekday, so
    the 7 x hours grid comes out of a single aggregate.
    """
    where = F.col(counted).isNotNull() if counted else None
    return dense_counts(qa.withColumnRenamed(hour, 'Stunde'), weekday, D.WEEKDAYS, 'Wochentag',
                        by=['Stunde'], share_name=None, where=where)


def weekday_hour_matrix(qa: DataFrame, weekday: str = 'Wochentag', hour: str = 'Stunde',
                        counted: str | None = 'Frage') -> DataFrame:
    """Wide form (E12): one row per weekday (all 7, `pos` 1..7, in order), one
    column per hour named '0'..'23', zeros kept. The hours are fixed, so the
    schema does not follow the data and planning runs no job; the final sort
    sees 7 rows."""
    long = weekday_hour_heatmap(qa, weekday, hour, counted)
    return long.groupBy('pos', 'Wochentag').agg(*[
        F.sum(F.when(F.col('Stunde') == h, F.col('Anzahl')).otherwise(0)).alias(str(h))
        for h in range(24)]).orderBy('pos')
