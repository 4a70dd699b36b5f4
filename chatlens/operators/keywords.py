"""Keyword frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import tokens


def keyword_tokens(df: DataFrame, text_col: str = 'Frage', order_cols=('Datetime', 'id'),
                   dicts: D.Dictionaries = D.DEFAULT, min_len: int = 3) -> DataFrame:
    """One row per kept token: (*order_cols, pos, w).

    Tokens are a-z/ü/ä/ö words bounded by non-word characters (F1); words
    shorter than `min_len` are skipped by the token pattern, stop words are
    dropped after `posexplode` (F2), outside any lambda, so in generated code;
    the stop-word test is an `IN` over literals, which Spark turns into a hash
    set. `pos` orders the kept tokens within a row.
    """
    t = df.select(*order_cols, F.posexplode(tokens(text_col, min_len)).alias('pos', 'w'))
    return t.filter(~F.col('w').isin(*dicts.stopwords))


def keyword_counts(df: DataFrame, text_col: str = 'Frage', order_cols=('Datetime', 'id'),
                   dicts: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """(Keyword, Anzahl, first) for every kept word.

    `first` is the least value of the first order column among the word's
    rows. Count and minimum are plain values that a hash aggregate updates in
    place, map-side first: a word that makes up a third of all tokens is
    still one row per task.
    """
    t = keyword_tokens(df, text_col, order_cols, dicts)
    return t.groupBy(F.col('w').alias('Keyword')).agg(
        F.count(F.lit(1)).alias('Anzahl'), F.min(order_cols[0]).alias('first'))


def top_keywords(df: DataFrame, n: int = 20, text_col: str = 'Frage',
                 order_cols=('Datetime', 'id'), dicts: D.Dictionaries = D.DEFAULT,
                 counts: DataFrame | None = None) -> DataFrame:
    """(Keyword, Anzahl, first, at): the n most frequent keywords, ties by
    first appearance in (order_cols, position) order, the tie-break of the
    original's counter (F3). The dashboard asks for 25.

    Words are cut by (count, `first`), all words level with the n-th staying
    in. Only words that share both with another one need their exact place:
    `at`, the least (other order columns, position) in the rows of that
    `first`, NULL for the rest. The rows looked up are those of at most n
    values of the first order column, which are broadcast; without ties the
    second pass over the texts falls away at run time. `counts` are
    `keyword_counts` that the caller has already.
    """
    counts = counts if counts is not None else keyword_counts(df, text_col, order_cols, dicts)
    last = (counts.orderBy(F.col('Anzahl').desc(), F.col('first').asc_nulls_first()).limit(n)
            .orderBy(F.col('Anzahl').asc(), F.col('first').desc_nulls_last()).limit(1)
            .select(F.struct(F.col('Anzahl').alias('n'), F.col('first').alias('f'))).scalar())
    near = counts.withColumn('_last', last).filter(
        (F.col('Anzahl') > F.col('_last.n')) | ((F.col('Anzahl') == F.col('_last.n')) & (
            F.col('first').isNull() | (F.col('first') <= F.col('_last.f'))))).drop('_last')
    tied = (near.groupBy('Anzahl', 'first').agg(F.count(F.lit(1)).alias('words')).filter('words > 1')
            .select(F.col('first').alias('_f')).distinct())
    rows = df.select(*order_cols, text_col).join(F.broadcast(tied), F.col(order_cols[0]).eqNullSafe(F.col('_f')),
                                                 'left_semi')
    rest = [*order_cols[1:], 'pos']
    places = keyword_tokens(rows, text_col, order_cols, dicts).groupBy(
        F.col('w').alias('_w'), F.col(order_cols[0]).alias('_at_first')).agg(
        F.min(F.struct(*rest) if len(rest) > 1 else F.col('pos')).alias('at'))
    found = near.join(places, (F.col('Keyword') == F.col('_w'))
                      & F.col('first').eqNullSafe(F.col('_at_first')), 'left')
    return (found.orderBy(*keyword_order()).limit(n).select('Keyword', 'Anzahl', 'first', 'at'))


def keyword_order() -> list[Column]:
    """The order of `top_keywords`' rows, most frequent and earliest first."""
    return [F.col('Anzahl').desc(), F.col('first').asc_nulls_first(), F.col('at').asc()]


def keyword_weights(df: DataFrame, n: int = 25, **kw) -> DataFrame:
    """Word-cloud weights (E17): top n with count / max count. The window
    runs over the n-row result only."""
    top = top_keywords(df, n, **kw)
    return top.select('Keyword', 'Anzahl', (F.col('Anzahl') / F.max('Anzahl').over(
        Window.partitionBy())).alias('Gewicht'))
