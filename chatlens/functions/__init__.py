"""Column-level functions (built-in Spark expressions only)."""

from .classify import category_from_hits, sentiment_from_hits, sentiment_score
from .text import (char_len, contains_any, count_hits, is_all_digits, strip_ws, tokens,
                   truncate, word_count)
from .timefeat import (daypart, fmt_date, fmt_datetime, fmt_time, german_weekday,
                       length_band, parse_created, weekday_pos)
from .topics import topic_array, topic_label

__all__ = [
    'category_from_hits', 'char_len', 'contains_any', 'count_hits', 'daypart', 'fmt_date', 'fmt_datetime',
    'fmt_time', 'german_weekday', 'is_all_digits', 'length_band', 'parse_created', 'sentiment_from_hits',
    'sentiment_score', 'strip_ws', 'tokens', 'topic_array', 'topic_label',
    'truncate', 'weekday_pos', 'word_count',
]
