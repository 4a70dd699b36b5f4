"""The JVM-side text functions against Python's own behaviour on generated
strings (the original is Python): split/strip whitespace, code-point length,
the keyword word rule and strptime."""

import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chatlens.functions import char_len, parse_created, strip_ws, tokens, word_count

WS = ' \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       　'
ALPHABET = st.sampled_from(list('abzüäöß2_-. ,éÉÜXyİ😀') + list(WS) + ['́', '​', '²'])
TEXT = st.text(alphabet=ALPHABET, max_size=30)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(TEXT, min_size=50, max_size=50))
def test_text_functions_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], 'i int, v string')
    got = df.select('i', word_count('v').alias('w'), char_len('v').alias('n'),
                    strip_ws('v').alias('s'), tokens('v').alias('t')).collect()
    for r in got:
        t = texts[r['i']]
        assert r['w'] == len(t.split()), repr(t)
        assert r['n'] == len(t), repr(t)
        assert r['s'] == t.strip(), repr(t)
        assert r['t'] == re.findall(r'\b[a-züäö]+\b', t.lower()), repr(t)


DIGIT = st.sampled_from(list('0123456789'))
PART = st.text(alphabet=DIGIT, min_size=1, max_size=3)
SEP = st.sampled_from([' ', '  ', '\t', 'T', ''])
STAMP = st.builds(lambda y, m, d, s, hh, mm, ss: f'{y}-{m}-{d}{s}{hh}:{mm}:{ss}',
                  st.text(alphabet=DIGIT, min_size=3, max_size=5), PART,
                  st.one_of(PART, st.builds(lambda x: ' ' + x, DIGIT)), SEP, PART, PART, PART)


def strptime_or_none(s):
    try:
        return dt.datetime.strptime(s, '%Y-%m-%d %H:%M:%S')
    except ValueError:
        return None


@SETTINGS
@given(st.lists(STAMP, min_size=80, max_size=80))
def test_parse_created_matches_strptime(spark, stamps):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], 'i int, v string')
    for r in df.select('i', parse_created('v').alias('t')).collect():
        s = stamps[r['i']]
        assert r['t'] == strptime_or_none(s), repr(s)
