"""`python -m chatlens`: exports in, every dashboard table out."""

import os

from chatlens.__main__ import parse_args, run

from test_sources import write_export


def test_cli_writes_every_result(spark, tmp_path):
    src = os.path.join(tmp_path, 'exports')
    os.makedirs(src)
    write_export(os.path.join(src, 'export.csv'))
    out = os.path.join(tmp_path, 'out')
    written = run(spark, parse_args([src, out, '--latest', '5', '--search', 'rind']))
    assert {'overview', 'top_keywords', 'weekday_hour_heatmap', 'classified', 'classified_json'} <= set(written)
    overview = spark.read.parquet(written['overview']).first()
    assert overview['gesamt_fragen'] == 3
    assert spark.read.parquet(written['search_count']).first()['Gefunden'] == 1
    assert spark.read.json(written['classified_json']).count() == 5


def test_cli_csv_format(spark, tmp_path):
    src = os.path.join(tmp_path, 'exports')
    os.makedirs(src)
    write_export(os.path.join(src, 'export.csv'))
    out = os.path.join(tmp_path, 'out')
    written = run(spark, parse_args([src, out, '--format', 'csv']))
    rows = spark.read.option('header', 'true').csv(written['search_questions']).collect()
    assert len(rows) == 3 and all(isinstance(r['Kategorie'], str) for r in rows)


def test_cli_json_format(spark, tmp_path):
    src = os.path.join(tmp_path, 'exports')
    os.makedirs(src)
    write_export(os.path.join(src, 'export.csv'))
    out = os.path.join(tmp_path, 'out')
    written = run(spark, parse_args([src, out, '--format', 'json', '--mode', 'robust']))
    days = spark.read.json(written['weekday_counts']).collect()
    assert len(days) == 7 and sum(r['Anzahl'] for r in days) == 3
