"""Search by the trigram index against the scan."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chatlens.operators.features import qa_table
from chatlens.operators.search import search_filter
from chatlens.operators.search_index import add_to_index, read_index, required_words, search_indexed
from chatlens.session import stored
from chatlens.sources.days import load_days, read_days
from chatlens.sources.fixture import fixture_messages

from conftest import SF001

WORDS = ['rind', 'RIND', 'poulet', 'Grill', 'grill ', 'rib-eye', 'café', 'Filet z', 'köstlich', 'KÖSTLICH', 'was soll ich',
         'fehlt ganz', 'ei', 'a', 'Straße']
PATTERNS = ['rind|poulet', 'rind|ei', 'rind.*grill', 'r.nd', 'gri+ll', '^rind', 'rind$', '(rind|poulet) vom', 'ri[nm]d', 'fehlt|rind',
            'Rezept.+Poulet', 'super. danke', 'zäh und.*trocken|bbq', '.*', 'steak.?grill', 'kochen|backen|braten', r'\bgrill\b']


@pytest.fixture(scope='module')
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp('index'))
    qa = stored(qa_table(fixture_messages(spark, SF001)), 'test-index')
    table, index = os.path.join(base, 'qa'), os.path.join(base, 'index')
    for part in ('id % 2 = 0', 'id % 2 = 1', 'id % 10 = 1'):  # the last load repeats rows
        load_days(qa.filter(part), table)
        add_to_index(qa.filter(part), index)
    return read_days(spark, table, qa.schema), read_index(spark, index)


def ids(df):
    return sorted(r[0] for r in df.select('id').collect())


@pytest.mark.parametrize('literal', [True, False])
def test_equals_the_scan(tables, literal):
    """32 patterns, with the index and without, and with bounds of date."""
    qa, index = tables
    for term in WORDS + PATTERNS:
        assert ids(search_indexed(qa, index, term, literal=literal)) == ids(search_filter(qa, term, literal=literal)), term
    for term in ('rind', 'grill|poulet', ''):
        days = ('2025-08-01', '2025-08-15')
        assert ids(search_indexed(qa, index, term, *days, literal)) == ids(search_filter(qa, term, *days, literal)), term


def test_words_that_every_match_holds():
    assert required_words('rind|Poulet') == [['rind'], ['poulet']]
    assert required_words('Filet.*zäh und.trocken') == [['filet', 'zäh und', 'trocken']]
    for term in ('rind|ei', 'gri+ll', 'a.b.c', '', '(rind)', r'rind\d', 'rind|', 'straße', 'x{2}abc', 'rind?'):
        assert required_words(term) is None


def test_folded_characters_and_odd_texts(spark, tmp_path):
    """Characters that a case-insensitive pattern takes for a letter; short,
    empty, null and repeated texts; a long pattern over two longs of bits."""
    long = 'abcdefghijklmnopqrstuvwxyz0123456789 the quick brown fox jumps over lazy dogs and more words'
    texts = ['ſteak', 'STEAK', 'RİND', 'rınd', 'RIND', 'Kotelett', 'kotelett', 'ab', '', None, 'steak', 'ς σ Σ rind', 'İİİ rind',
             long, long.upper(), long[:-1], 'ss straße STRASSE', '😀 rind 😀']
    rows = [(i, dt.date(2025, 8, 1 + i % 3), t) for i, t in enumerate(texts)]
    qa = spark.createDataFrame(rows + rows[:2], 'id bigint, Datum date, Frage string')
    path = os.path.join(tmp_path, 'index')
    add_to_index(qa.filter('false'), path)
    add_to_index(qa, path)
    index = read_index(spark, path)
    for term in ('steak', 'rind', 'kotelett', 'stras', long, 'steak|rind', long + '|rind'):
        assert ids(search_indexed(qa, index, term)) == ids(search_filter(qa, term)), term


def test_reads_postings_and_days_of_the_word_only(spark, tables):
    """The postings' scan is cut by folder and gram, the table's by the days
    of the candidates."""
    qa, index = tables
    plan = search_indexed(qa, index, 'köstlich')._jdf.queryExecution().executedPlan().toString()
    assert 'In(gram' in plan and 'bucket' in plan.split('PartitionFilters: ', 1)[1]
    assert 'dynamicpruning' in plan.lower()
    got = search_indexed(qa, index, 'köstlich')
    assert ids(got)
    # candidates of a word are its matches here: no other row's text is tested
    from chatlens.operators.search_index import candidates
    assert candidates(index, [['köstlich']]).count() == got.count() < qa.count() / 2
    assert candidates(index.filter(F.lit(True)), [['fehlt ganz']]).count() == 0
