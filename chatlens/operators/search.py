"""Question search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fmt_time, truncate
from .extract import fetch_answers


def search_filter(qa: DataFrame, term: str = '', start: dt.date | str | None = None,
                  end: dt.date | str | None = None, literal: bool = False) -> DataFrame:
    """Rows with start <= Datum <= end (both inclusive, open when None) whose
    question matches `term` (D1, D2).

    The term is a case-insensitive regular expression, as in the original
    (Java dialect); `literal=True` matches it as plain text. An empty term
    filters nothing. The date bounds are plain comparisons, so on a table
    partitioned or sorted by date they prune files/row groups.
    """
    out = qa
    if start is not None:
        out = out.filter(F.col('Datum') >= F.lit(start).cast('date'))
    if end is not None:
        out = out.filter(F.col('Datum') <= F.lit(end).cast('date'))
    if term:
        if literal:
            out = out.filter(F.lower('Frage').contains(term.lower()))
        else:
            out = out.filter(F.col('Frage').rlike('(?iu)' + term))
    return out


def search_count(qa: DataFrame, term: str = '', start=None, end=None, literal: bool = False) -> DataFrame:
    """(Gefunden) - number of matching questions (D3)."""
    return search_filter(qa, term, start, end, literal).agg(F.count(F.lit(1)).alias('Gefunden'))


def search_questions(qa: DataFrame, term: str = '', start=None, end=None, literal: bool = False,
                     page: int = 50, messages: DataFrame | None = None) -> DataFrame:
    """The first `page` matches in time order, shaped for display (D3).

    The page cap is the feature (the original shows 50); it plans as a
    distributed top-k, never a full sort on one task. With `messages`, `qa` is
    the question-only table (`qa_table(messages, answers=False)`), and only
    the page's answers are looked up there.
    """
    hits = search_filter(qa, term, start, end, literal).orderBy('Datetime', 'id').limit(page)
    if messages is not None:
        # the page is found and stored by this call; in order again behind the join
        hits = fetch_answers(hits, messages).orderBy('Datetime', 'id').limit(page)
    return (hits
            .select('id', 'Datum', fmt_time('Datetime').alias('Uhrzeit'), 'Wochentag',
                    'Fragenlänge_Zeichen', 'Kategorie',
                    truncate('Frage', 100, always_ellipsis=True).alias('Titel'),
                    'Frage', truncate('Antwort', 1000).alias('Antwort')))
