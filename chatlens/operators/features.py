"""The QA table: extraction result + derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import (char_len, daypart, german_weekday, length_band, topic_array,
                         topic_label, word_count)
from .extract import extract_qa_flat

QA_COLUMNS = ('id', 'Datum', 'Datetime', 'Wochentag', 'Stunde', 'Frage', 'Antwort',
              'Fragenlänge_Zeichen', 'Fragenlänge_Wörter', 'Tageszeit', 'Längenkategorie',
              'Themen', 'Kategorie')


def add_features(qa: DataFrame, dicts: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """(id, Datetime, Frage, Antwort) -> the full QA table.

    One projection, no shuffle. `Themen` is the topic array; `Kategorie` its
    ', '-joined text as users see it. Rows without a date are dropped (B13).
    A question-only table's `q_turn` is carried through.
    """
    turn = [c for c in qa.columns if c == 'q_turn']
    base = qa.select('id', 'Datetime', 'Frage', 'Antwort', *turn, F.lower('Frage').alias('_low')).select(
        'id', 'Datetime', 'Frage', 'Antwort', *turn,
        F.to_date('Datetime').alias('Datum'),
        german_weekday('Datetime').alias('Wochentag'),
        F.hour('Datetime').alias('Stunde'),
        char_len('Frage').alias('Fragenlänge_Zeichen'),
        word_count('Frage').alias('Fragenlänge_Wörter'),
        topic_array('Frage', dicts.topics, lowered='_low').alias('Themen'),
    )
    return base.select(
        'id', 'Datum', 'Datetime', 'Wochentag', 'Stunde', 'Frage', 'Antwort',
        'Fragenlänge_Zeichen', 'Fragenlänge_Wörter',
        daypart('Stunde').alias('Tageszeit'),
        length_band('Fragenlänge_Zeichen').alias('Längenkategorie'),
        'Themen', topic_label('Themen').alias('Kategorie'), *turn,
    ).dropna(subset=['Datum'])


def qa_table(messages: DataFrame, dicts: D.Dictionaries = D.DEFAULT, **kw) -> DataFrame:
    """Flat messages -> QA table."""
    return add_features(extract_qa_flat(messages, **kw), dicts)
