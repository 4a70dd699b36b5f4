"""Message classification and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import fmt_datetime, sentiment_score, truncate
from ..functions.classify import category_from_hits, sentiment_from_hits
from ..functions.matcher import list_hits


def classify_rule_based(df: DataFrame, text_col: str = 'text', role_col: str = 'role',
                        keep: tuple[str, ...] = (), dicts: D.Dictionaries = D.DEFAULT,
                        matcher: str = 'aho') -> DataFrame:
    """(*keep, frage, rolle, kategorie, sentiment) per row.

    A row-local projection at any scale: lower(text) is projected once, the
    four keyword lists are counted in one pass (`matcher`, see
    chatlens.functions.matcher), and the rules are Spark `when` chains over
    those counts. NULL text -> ''.
    """
    staged = df.select(*keep, F.col(text_col).alias('_t'), F.col(role_col).alias('rolle'),
                       F.lower(F.col(text_col)).alias('_low'))
    lists = (dicts.food, dicts.aggressive, dicts.positive, dicts.negative)
    hits = staged.select(*keep, '_t', '_low', 'rolle', list_hits('_low', lists, matcher).alias('_h'))
    kat = hits.select(*keep, '_t', 'rolle', '_h', category_from_hits(
        '_t', '_low', F.col('_h')[0], F.col('_h')[1]).alias('kategorie'))
    return kat.select(
        *keep, F.coalesce(F.col('_t'), F.lit('')).alias('frage'), 'rolle', 'kategorie',
        sentiment_from_hits('_t', F.col('_h')[2], F.col('_h')[3], 'kategorie').alias('sentiment'))


def classification_summary(classified: DataFrame) -> DataFrame:
    """One row: analysed messages and the food / positive / aggressive counts
    with their shares in percent (E13), in a single aggregate."""
    g = classified.agg(
        F.count(F.lit(1)).alias('analysiert'),
        F.count_if(F.col('kategorie') == D.CATEGORY_FOOD).alias('essen_fleisch'),
        F.count_if(F.col('sentiment') == D.SENTIMENT_POSITIVE).alias('positiv'),
        F.count_if(F.col('kategorie') == D.CATEGORY_AGGRESSIVE).alias('aggressiv'))

    def pct(c):
        return F.try_divide(F.col(c).cast('double') * 100, F.col('analysiert')).alias(f'{c}_pct')

    return g.select('analysiert', 'essen_fleisch', pct('essen_fleisch'), 'positiv', pct('positiv'),
                    'aggressiv', pct('aggressiv'))


def category_counts(classified: DataFrame) -> DataFrame:
    """(kategorie, Anzahl)."""
    return classified.groupBy('kategorie').agg(F.count(F.lit(1)).alias('Anzahl'))


def sentiment_counts(classified: DataFrame) -> DataFrame:
    """(sentiment, Anzahl)."""
    return classified.groupBy('sentiment').agg(F.count(F.lit(1)).alias('Anzahl'))


def classification_filtered(classified: DataFrame, category: str = D.ALL_FILTER,
                            sentiment: str = D.ALL_FILTER, time_col: str = 'datetime',
                            preview: int = 200) -> DataFrame:
    """Detail rows after the category/sentiment pickers ('Alle' = no filter),
    with formatted time and a 200-character preview (D4, A4, C13, C14)."""
    out = classified
    if category != D.ALL_FILTER:
        out = out.filter(F.col('kategorie') == category)
    if sentiment != D.ALL_FILTER:
        out = out.filter(F.col('sentiment') == sentiment)
    keep = [c for c in ('id', 'conv_id', 'turn') if c in classified.columns]
    return out.select(*keep, fmt_datetime(time_col).alias('Zeit'), F.col('rolle').alias('Rolle'),
                      F.col('kategorie').alias('Kategorie'), F.col('sentiment').alias('Sentiment'),
                      truncate('frage', preview).alias('Nachricht'))


def filter_choices(classified: DataFrame) -> DataFrame:
    """(feld, wert): distinct categories and sentiments for the pickers."""
    return (classified.select(F.inline(F.array(
        F.struct(F.lit('kategorie').alias('feld'), F.col('kategorie').alias('wert')),
        F.struct(F.lit('sentiment').alias('feld'), F.col('sentiment').alias('wert')))))
        .distinct())


def sentiment_timeline(classified_latest: DataFrame, order_col: str = 'nr',
                       min_messages: int = 0) -> DataFrame:
    """(Nachricht, Sentiment_Score, Sentiment, Zeit) counting down n..1 in
    newest-first order (H5, H6). Meant for the latest-messages frame, whose
    size is the caller's limit, so the unpartitioned window is bounded.

    With `min_messages` the timeline is empty when there are fewer messages
    (the original draws it only for more than 5: pass 6)."""
    w = Window.orderBy(F.col(order_col).asc())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = classified_latest.select(
        n.alias('_n'), (n + 1 - F.row_number().over(w)).alias('Nachricht'),
        sentiment_score('sentiment').alias('Sentiment_Score'),
        F.col('sentiment').alias('Sentiment'), F.col('datetime').alias('Zeit'))
    if min_messages > 0:
        out = out.filter(F.col('_n') >= min_messages)
    return out.drop('_n')
