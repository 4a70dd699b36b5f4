"""Multi-label topics of a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .matcher import list_hits
from .text import _col, contains_any


def topic_array(text, topics=D.TOPIC_KEYWORDS, other: str = D.OTHER_TOPIC, lowered=None) -> Column:
    """array<string> of matching topic labels in fixed order; [other] if none."""
    low = F.lower(_col(text)) if lowered is None else _col(lowered)
    hits = F.array(*[F.when(contains_any(low, words), F.lit(label)) for label, words in topics])
    labels = F.array_compact(hits)
    return F.when(F.size(labels) == 0, F.array(F.lit(other))).otherwise(labels)


def topic_label(arr) -> Column:
    """The ', '-joined form shown to users."""
    return F.array_join(_col(arr), ', ')


def topic_array_matched(lowered, topics=D.TOPIC_KEYWORDS, other: str = D.OTHER_TOPIC,
                        matcher: str = 'aho') -> Column:
    """topic_array over an already lower-cased column, all topic lists counted
    in one pass (for long texts; see chatlens.functions.matcher)."""
    h = list_hits(lowered, [words for _, words in topics], matcher)
    labels = F.array_compact(F.array(*[F.when(h[i] > 0, F.lit(label)) for i, (label, _) in enumerate(topics)]))
    return F.when(F.size(labels) == 0, F.array(F.lit(other))).otherwise(labels)
