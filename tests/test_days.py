"""The QA table by day and the daily counts."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from chatlens.operators import daily as DY
from chatlens.operators import keywords, lengths, temporal, topics
from chatlens.operators.extract import extract_qa_flat
from chatlens.operators.features import add_features, qa_table
from chatlens.operators.search import search_questions
from chatlens.sources.days import load_days, read_days
from chatlens.sources.fixture import fixture_messages
from chatlens.session import stored

from conftest import SF001, rows

LOADS = ("Datum < DATE '2025-08-05' AND id % 2 = 0", "Datum < DATE '2025-08-05'", "Datum >= DATE '2025-08-04'")


@pytest.fixture(scope='module')
def table(spark, tmp_path_factory):
    """(QA rows, path of the table, path of the counts) after three loads."""
    base = str(tmp_path_factory.mktemp('days'))
    qa = stored(qa_table(fixture_messages(spark, SF001)), 'test-days')
    path, counts = os.path.join(base, 'qa'), os.path.join(base, 'counts')
    for part in LOADS:
        days = load_days(qa.filter(part), path)
        DY.refresh_days(read_days(spark, path, qa.schema), counts, days)
    return qa, path, counts


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path)
            for f in names if f.endswith('.parquet')}


def same(a, b):
    return sorted(map(str, rows(a, *a.columns))) == sorted(map(str, rows(b, *a.columns)))


def test_table_holds_each_row_once(spark, table):
    qa, path, _ = table
    assert same(read_days(spark, path, qa.schema), qa)


def test_summaries_equal_the_full_queries(spark, table):
    qa, path, counts = table
    parts, by_day = DY.read_parts(spark, counts), read_days(spark, path, qa.schema)
    assert same(DY.questions_per_day(parts), temporal.questions_per_day(qa))
    assert same(DY.weekday_hour_heatmap(parts), temporal.weekday_hour_heatmap(qa))
    assert same(DY.topic_daily_trend(parts), topics.topic_daily_trend(qa))
    assert same(DY.length_stats(parts), lengths.length_stats(qa))
    for n in (5, 25, 200):
        assert same(DY.keywords(parts, by_day, n), keywords.top_keywords(qa, n))


def spoil(path, keep):
    """Makes every file of other days than `keep` unreadable."""
    for f in files(path):
        if not any(f'Datum={day}' in f for day in keep):
            with open(f, 'wb') as out:
                out.write(b'not a table')
            check = os.path.join(os.path.dirname(f), f'.{os.path.basename(f)}.crc')
            if os.path.exists(check):
                os.remove(check)


def test_only_the_days_asked_for_are_opened(spark, table, tmp_path):
    """With all other days' files unreadable, a search, a load and a refresh
    of three days work, and a full read does not."""
    qa, path, counts = table
    days = [dt.date(2025, 8, d) for d in (1, 2, 3)]
    mine, theirs = os.path.join(tmp_path, 'qa'), os.path.join(tmp_path, 'counts')
    shutil.copytree(path, mine)
    shutil.copytree(counts, theirs)
    spoil(mine, days)
    spoil(theirs, days)
    by_day = read_days(spark, mine, qa.schema)
    page = search_questions(by_day, '', '2025-08-01', '2025-08-03')
    assert 'PartitionFilters: [isnotnull(Datum' in page._jdf.queryExecution().executedPlan().toString()
    want = search_questions(qa, '', '2025-08-01', '2025-08-03')
    assert same(page, want) and page.count() > 0
    assert load_days(qa.filter(F.col('Datum') == days[0]), mine) == days[:1]
    assert same(search_questions(read_days(spark, mine, qa.schema), '', '2025-08-01', '2025-08-03'), want)
    parts = DY.refresh_days(read_days(spark, mine, qa.schema), theirs, days)
    assert same(DY.questions_per_day(parts.filter(F.col('Datum').isin(days))),
                temporal.questions_per_day(qa.filter(F.col('Datum').isin(days))))
    with pytest.raises(Exception):
        read_days(spark, mine, qa.schema).collect()


def test_a_load_leaves_other_days_alone(spark, table, tmp_path):
    """A load of one day: only its folders change, in the table and the
    counts; loaded again the rows are the same."""
    qa, _, _ = table
    path, counts = os.path.join(tmp_path, 'qa'), os.path.join(tmp_path, 'counts')
    day = dt.date(2025, 8, 2)
    days = load_days(qa.filter(F.col('Datum') != day), path)
    DY.refresh_days(read_days(spark, path, qa.schema), counts, days)
    before = {**files(path), **files(counts)}
    for _ in range(2):
        assert load_days(qa.filter(F.col('Datum') == day), path) == [day]
        DY.refresh_days(read_days(spark, path, qa.schema), counts, [day])
        after = {**files(path), **files(counts)}
        assert {f for f in after if f not in before} == {f for f in after if f'Datum={day}' in f}
        assert all(after[f] == t for f, t in before.items())
        assert same(read_days(spark, path, qa.schema), qa)
        assert same(DY.topic_daily_trend(DY.read_parts(spark, counts)), topics.topic_daily_trend(qa))


def test_changed_rows_and_empty_loads(spark, tmp_path):
    def qa(*msgs):
        m = spark.createDataFrame(msgs, 'conv_id bigint, turn bigint, role string, text string, created timestamp_ntz')
        return add_features(extract_qa_flat(m))

    t, path, counts = dt.datetime(2025, 8, 1, 9), os.path.join(tmp_path, 'qa'), os.path.join(tmp_path, 'counts')
    empty = qa()
    assert load_days(empty, path) == [] and read_days(spark, path, empty.schema).count() == 0
    assert DY.refresh_days(read_days(spark, path, empty.schema), counts, []).count() == 0
    old = qa((1, 0, 'user', 'Rind vom Grill', t), (2, 0, 'user', 'Guten Tag', t), (3, 0, 'user', 'ohne Zeit', None))
    load_days(old, path)
    days = load_days(qa((1, 0, 'user', 'Poulet', t), (1, 1, 'assistant', 'gern', t)), path)
    assert load_days(empty, path) == []
    parts = DY.refresh_days(read_days(spark, path, old.schema), counts, days)
    got = sorted(rows(read_days(spark, path, old.schema), 'id', 'Frage', 'Antwort'))
    assert got == [(1, 'Poulet', 'gern'), (2, 'Guten Tag', got[1][2])]
    assert rows(DY.questions_per_day(parts)) == [(t.date(), 2)]
    stats = DY.length_stats(parts).first()
    assert (stats['min_laenge'], stats['max_laenge'], stats['mittlere_laenge'], stats['median_laenge']) == (6, 9, 7.5, 7.5)
