"""Column functions on hand-written values (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlens import dictionaries as D
from chatlens.functions import (char_len, daypart, german_weekday, is_all_digits, length_band,
                                parse_created, strip_ws, tokens,
                                topic_array, topic_label, truncate, word_count)
from chatlens.functions.classify import category_from_hits, sentiment_from_hits
from chatlens.functions.matcher import list_hits


def one(spark, expr, value, schema='v string'):
    return spark.createDataFrame([(value,)], schema).select(expr.alias('r')).first()['r']


def test_word_count_python_whitespace(spark):
    assert one(spark, word_count('v'), 'a  b c d\u001ce ') == 5
    assert one(spark, word_count('v'), '  ') == 0
    assert one(spark, word_count('v'), 'x y z　') == 3


def test_char_length_code_points(spark):
    assert one(spark, char_len('v'), 'a😀ö') == 3


def test_strip_and_digits(spark):
    assert one(spark, strip_ws('v'), '  ab \n') == 'ab'
    assert one(spark, is_all_digits('v'), '123') is True
    assert one(spark, is_all_digits('v'), '123\n') is False
    assert one(spark, is_all_digits('v'), '') is False


def test_tokens_keep_only_plain_german_words(spark):
    got = one(spark, tokens('v'), 'Straße 2kg rib-eye Café FÜR Öl foo_bar naïve das')
    assert got == ['rib', 'eye', 'für', 'öl', 'das']


def test_length_band(spark):
    cases = [(49, 'Kurz (<50)'), (50, 'Mittel (50-150)'), (149, 'Mittel (50-150)'), (150, 'Lang (>150)')]
    df = spark.createDataFrame([(n,) for n, _ in cases], 'v int').select(length_band('v').alias('b'))
    assert [r['b'] for r in df.collect()] == [b for _, b in cases]


def test_daypart_boundaries(spark):
    hours = [4, 5, 9, 10, 13, 14, 17, 18, 21, 22]
    want = ['Nacht (22-5)', 'Morgen (5-10)', 'Morgen (5-10)', 'Mittag (10-14)', 'Mittag (10-14)',
            'Nachmittag (14-18)', 'Nachmittag (14-18)', 'Abend (18-22)', 'Abend (18-22)', 'Nacht (22-5)']
    df = spark.createDataFrame([(h,) for h in hours], 'h int').select(daypart('h').alias('d'))
    assert [r['d'] for r in df.collect()] == want


def test_weekday_names(spark):
    # 2025-07-21 is a Monday
    days = [(dt.datetime(2025, 7, 21 + i, 12),) for i in range(7)]
    df = spark.createDataFrame(days, 'ts timestamp_ntz').select(german_weekday('ts').alias('w'))
    assert [r['w'] for r in df.collect()] == list(D.WEEKDAYS)


CREATED_CASES = [
    ('2025-07-21 08:09:10', dt.datetime(2025, 7, 21, 8, 9, 10)),
    ('2025-7-1 9:5:3', dt.datetime(2025, 7, 1, 9, 5, 3)),
    ('2025-07- 1 09:05:03', dt.datetime(2025, 7, 1, 9, 5, 3)),
    ('2025-07-21   08:09:10', dt.datetime(2025, 7, 21, 8, 9, 10)),
    ('2025-07-21', None), ('2025-07-21T08:09:10', None), ('2025-07-21 08:09:10.5', None),
    ('2025-07-21 08:09:60', None), ('2025-02-30 00:00:00', None), ('0000-01-01 00:00:00', None),
    ('25-07-21 08:09:10', None), (' 2025-07-21 08:09:10', None), ('2025-07-21 08:09:10 ', None),
]


def test_parse_created_like_strptime(spark):
    df = spark.createDataFrame([(t,) for t, _ in CREATED_CASES], 'v string')
    got = {r['v']: r['t'] for r in df.select('v', parse_created('v').alias('t')).collect()}
    assert got == dict(CREATED_CASES)


def test_truncate(spark):
    assert one(spark, truncate('v', 3, always_ellipsis=True), 'ab') == 'ab...'
    assert one(spark, truncate('v', 3), 'abcd') == 'abc...'
    assert one(spark, truncate('v', 3), 'abc') == 'abc'


def test_topics(spark):
    lab = topic_label(topic_array('v'))
    assert one(spark, lab, 'Schmorbraten') == 'Braten, Schmoren'
    assert one(spark, lab, 'Hallo') == 'Sonstiges'
    assert one(spark, lab, 'Rezept für Poulet vom Grill') == 'Rezepte, Poulet, Grillen'


CLASS_CASES = [
    ('top', 'anderes', 'positiv'),
    ('übel', 'anderes', 'negativ'),
    ('nicht gut', 'neutral', 'neutral'),
    ('interessen', 'essen/fleisch', 'neutral'),
    ('verdammt, aber super', 'aggressiv', 'positiv'),
    ('Mist', 'aggressiv', 'negativ'),
    ('12345678', 'anderes', 'neutral'),
    ('   abc   ', 'anderes', 'neutral'),
    ('Wie lange muss das Steak ruhen?', 'essen/fleisch', 'neutral'),
    ('Das ist sehr gut, danke', 'neutral', 'positiv'),
    ('', 'anderes', 'neutral'),
    (None, 'anderes', 'neutral'),
]


@pytest.mark.parametrize('matcher', ['aho', 'jvm'])
def test_matchers_agree(spark, matcher):
    df = spark.createDataFrame([(t,) for t, _, _ in CLASS_CASES], 'v string')
    lists = (D.DEFAULT.food, D.DEFAULT.aggressive, D.DEFAULT.positive, D.DEFAULT.negative)
    h = df.select('v', F.lower('v').alias('low')).select('v', 'low', list_hits('low', lists, matcher).alias('h'))
    c = h.select('v', 'h', category_from_hits('v', 'low', F.col('h')[0], F.col('h')[1]).alias('c'))
    s = c.select('v', 'c', sentiment_from_hits('v', F.col('h')[2], F.col('h')[3], 'c').alias('s'))
    got = {r['v']: (r['c'], r['s']) for r in s.collect()}
    assert got == {t: (k, se) for t, k, se in CLASS_CASES}


def test_hit_counts_count_distinct_overlapping_keywords(spark):
    df = spark.createDataFrame([('sehr gut gut gut',)], 'v string')
    for m in ('aho', 'jvm'):
        assert df.select(list_hits('v', [('gut', 'sehr gut', 'top')], m).alias('h')).first()['h'] == [2]


def test_time_formats_ignore_session_time_zone(spark):
    """A naive time inside a daylight-saving gap of the session zone keeps its
    wall clock in every format (date_format would move it by an hour)."""
    from chatlens.functions.timefeat import fmt_created, fmt_date, fmt_datetime, fmt_time

    old = spark.conf.get('spark.sql.session.timeZone')
    try:
        spark.conf.set('spark.sql.session.timeZone', 'America/New_York')
        df = spark.createDataFrame([('2025-03-09 02:30:05',)], 'c string').select(
            F.col('c').cast('timestamp_ntz').alias('n'))
        r = df.select(fmt_date('n'), fmt_time('n'), fmt_datetime('n'), fmt_created('n')).first()
    finally:
        spark.conf.set('spark.sql.session.timeZone', old)
    assert tuple(r) == ('09.03.2025', '02:30', '09.03.2025 02:30', '2025-03-09 02:30:05')


def test_trim_set_equals_regex_class(spark):
    """`strip_ws` (trim with a character set) and `word_count` (a regex class)
    agree on what whitespace is."""
    from chatlens.functions.text import WS_CHARS, WS_CLASS

    probe = [chr(c) for c in range(0x3100)] + ['᠎', '﻿', '\U0001f600']
    df = spark.createDataFrame([(ch,) for ch in probe], 'c string')
    in_class = {r['c'] for r in df.filter(F.col('c').rlike(f'^[{WS_CLASS}]$')).collect()}
    assert in_class == set(WS_CHARS)
