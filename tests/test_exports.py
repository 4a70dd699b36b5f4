"""Export files: header discovery, arriving and overlapping exports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chatlens.plans.catalog import QUERIES
from chatlens.sources.chat_csv import CREATED, RAW, file_headers, qa_from_export, read_chat_csv
from chatlens.streaming import ingest

from conftest import SF0001


def chat(q, a='ja'):
    return json.dumps({'messages': [{'role': r, 'parts': [{'type': 'text', 'text': t}]} for r, t in (('user', q), ('assistant', a))]})


def field(s, quote='"'):
    return quote + s.replace(quote, quote * 2) + quote


def put(path, text):
    with open(path, 'w', encoding='utf-8', newline='') as f:
        f.write(text)


def test_last_of_equal_names_counts(spark, tmp_path):
    put(tmp_path / 'a.csv', f'Erstellt,{RAW},Erstellt\n2020-01-01 00:00:00,{field(chat("q"))},2025-07-21 08:00:00\n')
    os.makedirs(tmp_path / 'state')
    want = [('2025-07-21 08:00:00', chat('q'))]
    src = str(tmp_path / 'a.csv')
    assert [(r[CREATED], r[RAW]) for r in read_chat_csv(spark, src).collect()] == want
    got = ingest.ingest_exports(spark, str(tmp_path / '*.csv'), str(tmp_path / 'state'))
    assert [(r[CREATED], r[RAW]) for r in got.collect()] == want


def test_options_hold_for_the_header(spark, tmp_path):
    """Another separator and quote, and names over two lines."""
    put(tmp_path / 'a.csv', f"'Nr\n(Zahl)';Erstellt;{RAW}\n7;2025-07-21 08:00:00;{field(chat('ein; zwei'), chr(39))}\n")
    rows = read_chat_csv(spark, str(tmp_path), keep=('Nr\n(Zahl)',), sep=';', quote="'", escape="'")
    assert [tuple(r)[1:] for r in rows.collect()] == [('2025-07-21 08:00:00', chat('ein; zwei'), '7')]


def test_versions_in_one_folder(spark, tmp_path):
    """Byte-order mark, other order, missing columns, a header alone, nothing."""
    put(tmp_path / 'a.csv', f'﻿Erstellt,{RAW},x\n2025-07-21 08:00:00,{field(chat("a"))},1\n')
    put(tmp_path / 'b.csv', f'x,{RAW},Erstellt\r\n2,{field(chat("b"))},2025-07-21 09:00:00\r\n')
    put(tmp_path / 'c.csv', f'Erstellt,{RAW},x\n2025-07-21 10:00:00,{field(chat("c"))},3\n')
    put(tmp_path / 'd.csv', 'Erstellt\n2025-07-21 11:00:00\n')
    put(tmp_path / 'e.csv', f'Erstellt,{RAW},y\n')
    put(tmp_path / 'f.csv', '')
    found = file_headers(spark, str(tmp_path))
    assert {k: len(v) for k, v in found.items()} == {
        (CREATED, RAW, 'x'): 2, ('x', RAW, CREATED): 1, (CREATED,): 1, (CREATED, RAW, 'y'): 1}
    rows = read_chat_csv(spark, str(tmp_path), keep=('x',))
    assert sorted((r[CREATED][11:13], r.x) for r in rows.collect()) == [('08', '1'), ('09', '2'), ('10', '3'), ('11', None)]
    assert sorted(r.Frage for r in qa_from_export(rows).collect()) == ['a', 'b', 'c']
    assert read_chat_csv(spark, str(tmp_path / 'f.csv'), modified=True).collect() == []


def test_files_are_read_once(spark, tmp_path):
    """One scan per header version in the plan, and no Python."""
    put(tmp_path / 'a.csv', f'Erstellt,{RAW}\n2025-07-21 08:00:00,{field(chat("a"))}\n')
    put(tmp_path / 'b.csv', f'Erstellt,{RAW}\n2025-07-21 08:00:00,{field(chat("b"))}\n')
    plan = qa_from_export(read_chat_csv(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count('FileScan csv') == 1 and 'Python' not in plan and 'Arrow' not in plan
    same = read_chat_csv(spark, str(tmp_path), same_header=True)
    assert same.count() == 2


def drop(folder, name, rows):
    put(os.path.join(folder, name), f'Nr,Erstellt,{RAW}\n' + ''.join(
        f'{n},2025-07-{day:02d} 08:00:00,{field(chat(q))}\n' for n, day, q in rows))


@pytest.fixture
def folders(tmp_path):
    src, base = os.path.join(tmp_path, 'in'), os.path.join(tmp_path, 'base')
    os.makedirs(src)
    return src, base


def test_arriving_files_are_not_opened(spark, folders):
    drop(folders[0], 'a.csv', [(1, 1, 'a')])
    stream = ingest.arriving_files(spark, folders[0])
    assert 'content' not in stream.columns
    assert stream.isStreaming


def test_ingest_goes_on_where_it_ended(spark, folders):
    src, base = folders
    for k in range(3):
        drop(src, f'{k}.csv', [(k, 1, f'frage {k}')])
        got = ingest.ingest_exports(spark, src, base, ('Nr',), max_files_per_trigger=1)
        assert sorted(r.Nr for r in got.collect()) == [str(i) for i in range(k + 1)]


def test_overlapping_exports_keep_each_row_once(spark, folders):
    """Repeats inside a file, between files of one run, from an earlier run,
    and of rows older than the state holds; a changed row replaces its old
    form; rows that differ only in NULL and empty stay apart."""
    src, base = folders
    first = [(1, 1, 'eins'), (2, 2, 'zwei'), (2, 2, 'zwei')]

    def run(within='0 seconds'):
        rows = ingest.ingest_overlapping_exports(spark, src, base, ('Nr',), within)
        assert rows.count() == rows.select('row').distinct().count()
        return sorted((int(r.Nr), r.Frage) for r in qa_from_export(ingest.current_rows(rows, ('Nr',)), keep=('Nr',)).collect())

    drop(src, 'a.csv', first)
    assert run() == [(1, 'eins'), (2, 'zwei')]
    drop(src, 'b.csv', first + [(3, 3, 'drei')])
    drop(src, 'c.csv', first[:1] + [(3, 3, 'drei'), (4, 1, 'vier')])
    assert run() == [(1, 'eins'), (2, 'zwei'), (3, 'drei'), (4, 'vier')]
    assert run() == [(1, 'eins'), (2, 'zwei'), (3, 'drei'), (4, 'vier')]
    drop(src, 'd.csv', [(1, 1, 'eins'), (2, 2, 'zwei, weiter'), (3, 3, 'drei')])
    assert run('1 day') == [(1, 'eins'), (2, 'zwei, weiter'), (3, 'drei'), (4, 'vier')]


def test_a_failed_batch_is_written_again(spark, folders, monkeypatch):
    """A run that dies after its rows are written and before the stream has
    noted the batch: the next one writes the same batch again."""
    src, base = folders
    drop(src, 'a.csv', [(1, 1, 'eins')])
    ingest.ingest_overlapping_exports(spark, src, base, ('Nr',))
    drop(src, 'b.csv', [(1, 1, 'eins'), (2, 2, 'zwei')])
    real = ingest._run

    def dying(stream, where, write):
        def once(batch, epoch):
            write(batch, epoch)
            raise RuntimeError('lost the driver')
        real(stream, where, once if where == base else write)

    monkeypatch.setattr(ingest, '_run', dying)
    with pytest.raises(Exception, match='lost the driver'):
        ingest.ingest_overlapping_exports(spark, src, base, ('Nr',))
    monkeypatch.setattr(ingest, '_run', real)
    rows = ingest.ingest_overlapping_exports(spark, src, base, ('Nr',))
    assert sorted(r.Nr for r in rows.collect()) == ['1', '2']


def test_row_key_tells_null_from_empty(spark):
    rows = spark.createDataFrame([('a', None), ('a', ''), (None, 'a'), ('', 'a'), ('a\x1f=b', 'c'), ('a', 'b\x1f=c')],
                                 f'Erstellt string, `{RAW}` string')
    assert rows.select(ingest.row_key().alias('k')).distinct().count() == 6


def test_registered_query_equals_the_batch(spark):
    got = QUERIES['stream_qa_dedup'](spark, SF0001)
    want = QUERIES['qa_pairs'](spark, SF0001)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter(F.col('Frage').isNull()).count() == 0
