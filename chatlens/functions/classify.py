"""Rule-based category and sentiment (I1, I2) and the sentiment score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .text import _col, is_all_digits, strip_ws


def category_from_hits(text, lowered, food_hits, aggressive_hits) -> Column:
    """aggressive > food > (short or all digits -> other) > neutral; NULL or
    empty text -> other. The keyword hits are counted beforehand (`matcher`)."""
    t, low = _col(text), _col(lowered)
    return (F.when(t.isNull() | (t == ''), D.CATEGORY_OTHER)
            .when(_col(aggressive_hits) > 0, D.CATEGORY_AGGRESSIVE)
            .when(_col(food_hits) > 0, D.CATEGORY_FOOD)
            .when((F.char_length(strip_ws(low)) < 5) | is_all_digits(low), D.CATEGORY_OTHER)
            .otherwise(D.CATEGORY_NEUTRAL))


def sentiment_from_hits(text, positive_hits, negative_hits, category) -> Column:
    """More positive than negative keyword hits -> positive, the reverse ->
    negative, else neutral; an aggressive message that came out neutral is
    negative."""
    t, pos, neg = _col(text), _col(positive_hits), _col(negative_hits)
    return (F.when(t.isNull() | (t == ''), D.SENTIMENT_NEUTRAL)
            .when(pos > neg, D.SENTIMENT_POSITIVE)
            .when(neg > pos, D.SENTIMENT_NEGATIVE)
            .when(_col(category) == D.CATEGORY_AGGRESSIVE, D.SENTIMENT_NEGATIVE)
            .otherwise(D.SENTIMENT_NEUTRAL))


def sentiment_score(label) -> Column:
    lab = _col(label)
    return (F.when(lab == D.SENTIMENT_POSITIVE, 1)
            .when(lab == D.SENTIMENT_NEGATIVE, -1).otherwise(0))
