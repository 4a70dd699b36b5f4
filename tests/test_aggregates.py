"""Aggregates, top-k and message operators: hand cases, properties, brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens import dictionaries as D
from chatlens.operators import keywords as K
from chatlens.operators import lengths as L
from chatlens.operators import temporal as T
from chatlens.operators import topics as TP
from chatlens.operators.features import add_features
from chatlens.operators.messages import latest_messages
from chatlens.operators.overview import overview_metrics
from chatlens.plans.catalog import qa as fixture_qa

from conftest import SF0001, SF001


def qa_rows(spark, rows):
    """rows: (id, datetime, question, answer)."""
    df = spark.createDataFrame(rows, 'id long, Datetime timestamp_ntz, Frage string, Antwort string')
    return add_features(df)


def at(day, hour, minute=0):
    return dt.datetime(2025, 7, day, hour, minute)


def test_overview_single_day_and_mode(spark):
    hours = [9, 3, 9, 3, 7]
    qa = qa_rows(spark, [(i, at(21, h), 'Frage', 'A') for i, h in enumerate(hours)])
    r = overview_metrics(qa).first()
    assert r['gesamt_fragen'] == 5 and r['fragen_pro_tag'] is None and r['aktivste_stunde'] == 3


def test_median_interpolates(spark):
    qa = qa_rows(spark, [(i, at(21 + i, 8), 'x' * n, 'A') for i, n in enumerate([1, 2, 10, 4])])
    r = L.length_stats(qa).first()
    assert (r['min_laenge'], r['max_laenge'], r['median_laenge'], r['mittlere_laenge']) == (1, 10, 3.0, 4.25)


def test_overview_days_divisor_excludes_one_day(spark):
    qa = qa_rows(spark, [(1, at(21, 8), 'a', 'b'), (2, at(23, 8), 'a', 'b'), (3, at(23, 9), 'a', 'b')])
    assert overview_metrics(qa).first()['fragen_pro_tag'] == 1.5


@pytest.fixture(scope='module')
def qa01(spark):
    df = fixture_qa(spark, SF001).cache()
    yield df
    df.unpersist()


def test_distributions_sum_to_row_count(qa01):
    n = qa01.count()
    wd = T.weekday_counts(qa01).collect()
    dp = T.daypart_counts(qa01).collect()
    assert [r['Wochentag'] for r in wd] == list(D.WEEKDAYS) or len(wd) == 7
    assert len(wd) == 7 and sum(r['Anzahl'] for r in wd) == n
    assert len(dp) == 5 and sum(r['Anzahl'] for r in dp) == n
    assert abs(sum(r['Anteil'] for r in wd) - 1) < 1e-9
    assert sum(r['Anzahl'] for r in T.hour_counts(qa01).collect()) == n
    assert sum(r['Anzahl'] for r in L.length_bands(qa01).collect()) == n
    for col, bins in (('Fragenlänge_Zeichen', 30), ('Fragenlänge_Wörter', 20)):
        h = L.length_histogram(qa01, col, bins).collect()
        assert len(h) <= bins and sum(r['Anzahl'] for r in h) == n
        widths = {r['bin_end'] - r['bin_start'] for r in h}
        assert len(widths) == 1
    heat = T.weekday_hour_heatmap(qa01).collect()
    hours = {r['Stunde'] for r in heat}
    assert len(heat) == 7 * len(hours) and sum(r['Anzahl'] for r in heat) == n
    days = qa01.select('Datum').distinct().count()
    assert TP.topic_daily_trend(qa01).count() == days * len(D.MAIN_TOPICS)


def test_fixture_topic_counts(qa01):
    got = {r['Kategorie']: r['Anzahl'] for r in TP.topic_counts(qa01).collect()}
    assert {k: got[k] for k in ('Rezepte', 'Poulet', 'Rind', 'Schwein', 'Grillen', 'Braten', 'Schmoren')} == \
        {'Rezepte': 24, 'Poulet': 10, 'Rind': 19, 'Schwein': 5, 'Grillen': 11, 'Braten': 13, 'Schmoren': 8}


def test_top_k_equals_sorted_prefix(qa01):
    short = [r['id'] for r in L.shortest_questions(qa01).collect()]
    full = [r['id'] for r in qa01.orderBy('Fragenlänge_Zeichen', 'Datetime', 'id').collect()[:5]]
    assert short == full
    longest = [r['id'] for r in L.longest_questions(qa01).collect()]
    full = [r['id'] for r in qa01.orderBy(F.desc('Fragenlänge_Zeichen'), 'Datetime', 'id').collect()[:5]]
    assert longest == full


def runs_of_word_characters(text):
    """Maximal runs of letters, digits and underscores, character by character."""
    run = ''
    for c in text + ' ':
        if c.isalnum() or c == '_':
            run += c
        elif run:
            yield run
            run = ''


def test_keywords_against_python_counter(spark):
    """Brute force from the rule: a word is a run wholly in the alphabet, longer
    than two letters and no stop word; ties keep the first seen in time order."""
    qa = fixture_qa(spark, SF0001)
    alphabet, stop = set('abcdefghijklmnopqrstuvwxyzüäö'), set(D.GERMAN_STOPWORDS)
    seen = {}
    for r in qa.orderBy('Datetime', 'id').collect():
        for run in runs_of_word_characters(r['Frage'].lower()):
            if set(run) <= alphabet and len(run) >= 3 and run not in stop:
                n, first = seen.get(run, (0, len(seen)))
                seen[run] = n + 1, first
    want = sorted(((w, n) for w, (n, _) in seen.items()), key=lambda x: (-x[1], seen[x[0]][1]))[:25]
    got = [(r['Keyword'], r['Anzahl']) for r in K.top_keywords(qa, 25).orderBy(*K.keyword_order()).collect()]
    assert got == want


def test_latest_messages(spark):
    qa = qa_rows(spark, [
        (1, at(21, 8), 'alt', 'Antwort alt'),
        (2, at(22, 8), 'mitte', D.NO_ANSWER),
        (3, at(23, 8), 'neu', 'Antwort neu'),
    ])
    got = [(r['nr'], r['text'], r['role']) for r in latest_messages(qa, 3).orderBy('nr').collect()]
    assert got == [(1, 'neu', 'user'), (2, 'Antwort neu', 'assistant'), (3, 'mitte', 'user')]


def test_weekday_hour_matrix_wide_form(qa01):
    wide = T.weekday_hour_matrix(qa01).collect()
    long = T.weekday_hour_heatmap(qa01).collect()
    assert [r['Wochentag'] for r in wide] == list(D.WEEKDAYS)
    cells = {(r['Wochentag'], r['Stunde']): r['Anzahl'] for r in long}
    for r in wide:
        for h in {k[1] for k in cells}:
            assert r[str(h)] == cells[(r['Wochentag'], h)]


def test_sentiment_timeline_needs_six_messages(spark):
    from chatlens.operators.classification import sentiment_timeline

    def frame(n):
        return spark.createDataFrame([(i + 1, 'positiv', None) for i in range(n)],
                                     'nr int, sentiment string, datetime timestamp_ntz')
    assert sentiment_timeline(frame(5), min_messages=6).count() == 0
    got = sentiment_timeline(frame(6), min_messages=6).orderBy('Nachricht').collect()
    assert [r['Nachricht'] for r in got] == [1, 2, 3, 4, 5, 6]
    assert sentiment_timeline(frame(3)).count() == 3
