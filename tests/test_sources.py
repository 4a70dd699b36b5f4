"""CSV export source (A1, A2, B1-B3, B12) and JSON export sink (A3)."""

import json
import os

from pyspark.sql import functions as F

from chatlens import dictionaries as D
from chatlens.sources.chat_csv import qa_from_export, read_chat_csv, rejects
from chatlens.sources.export import classification_document, write_classification_json


def chat(q, a):
    return json.dumps({'messages': [
        {'role': 'user', 'parts': [{'type': 'text', 'text': q}]},
        {'role': 'assistant', 'parts': [{'type': 'text', 'text': a}]}]}, ensure_ascii=False)


def field(s):
    return '"' + s.replace('"', '""') + '"'


def write_export(path):
    good = chat('Wie grilliere ich Rind?', 'Langsam.')
    crlf = chat('Zweite Frage', 'Zweite Antwort').replace('[{', '[\r\n{')
    bad_byte = field(chat('Kaputt@@Byte', 'ok')).encode().replace(b'@@', b'\xff')
    lines = [
        b'ID,Erstellt,Raw Chat Data,Extra',
        b'1,2025-07-21 08:00:00,' + field(good).encode() + b',x',
        b'ID,Erstellt,Raw Chat Data,Extra',                      # repeated header
        b'',                                                      # blank line
        b'3,2025-07-21 09:00:00',                                 # short row
        b'4,2025-07-22 10:00:00,' + field(crlf).encode() + b',x,extra',  # extra field
        b'5,2025-07-23 11:00:00,' + bad_byte + b',x',             # undecodable byte
        b'6,2025-07-21T12:00:00,' + field(good).encode() + b',x',  # bad timestamp
        b'7,,' + field(good).encode() + b',x',                    # empty Erstellt
        b'8,2025-07-24 13:00:00,' + field('{"other": 1}').encode() + b',x',  # no question
    ]
    with open(path, 'wb') as f:
        f.write(b'\r\n'.join(lines) + b'\r\n')


def test_export_rows_and_rejects(spark, tmp_path):
    p = os.path.join(tmp_path, 'export.csv')
    write_export(p)
    rows = read_chat_csv(spark, p)
    qa = {r['Frage']: (r['Antwort'], r['Datetime'].day) for r in qa_from_export(rows).collect()}
    assert qa == {'Wie grilliere ich Rind?': ('Langsam.', 21), 'Zweite Frage': ('Zweite Antwort', 22),
                  'KaputtByte': ('ok', 23)}
    reasons = sorted(r['reason'] for r in rejects(rows).collect())
    assert reasons == ['bad_timestamp', 'empty_chat', 'empty_created', 'header_row', 'no_question']


def test_missing_column_reads_as_null(spark, tmp_path):
    p = os.path.join(tmp_path, 'no_chat.csv')
    with open(p, 'w') as f:
        f.write('Erstellt,Other\n2025-07-21 08:00:00,x\n')
    rows = read_chat_csv(spark, p)
    assert rows.filter(F.col('`Raw Chat Data`').isNull()).count() == 1
    assert qa_from_export(rows).count() == 0


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame(
        [('Wie würzt man Rind?', 'user', 'essen/fleisch', 'neutral', None)],
        'frage string, rolle string, kategorie string, sentiment string, datetime timestamp_ntz')
    df = df.withColumn('datetime', F.lit('2025-07-21 08:09:10').cast('timestamp_ntz'))
    out = os.path.join(tmp_path, 'json')
    write_classification_json(df, out)
    text = ''.join(open(os.path.join(out, f), encoding='utf-8').read()
                   for f in os.listdir(out) if f.endswith('.json'))
    rec = json.loads(text)
    assert rec['frage'] == 'Wie würzt man Rind?' and 'ü' in text
    assert rec['datetime'] == '2025-07-21 08:09:10'
    doc = json.loads(classification_document(df))
    assert doc[0]['kategorie'] == 'essen/fleisch'


def test_export_csv_round_trip_keeps_line_breaks_and_quotes(spark, tmp_path):
    from chatlens.sources.chat_csv import write_export_csv

    docs = [json.dumps({'messages': [{'role': 'user', 'parts': [{'type': 'text', 'text': t}]}]},
                       ensure_ascii=False) for t in ('a\nb', 'c\r\nd, "zitiert"', 'schlicht ü')]
    df = spark.createDataFrame([(i, 0, '2025-07-21 08:00:00', d) for i, d in enumerate(docs)],
                               'conv_id long, segment long, Erstellt string, `Raw Chat Data` string')
    out = os.path.join(tmp_path, 'csv')
    write_export_csv(df, out)
    back = {int(r['conv_id']): r['Raw Chat Data'] for r in read_chat_csv(spark, out, keep=('conv_id',)).collect()}
    assert back == dict(enumerate(docs))


def test_segmented_export_with_text_ids(spark, tmp_path):
    """Conversation ids that are not numbers stay apart."""
    from chatlens.sources.chat_csv import qa_from_segmented_export, write_export_csv

    def doc(role, text):
        return json.dumps({'messages': [{'role': role, 'parts': [{'type': 'text', 'text': text}]}]})
    rows = [('a-1', 0, doc('user', 'Frage A')), ('a-1', 1, doc('assistant', 'Antwort A')),
            ('b-2', 0, doc('user', 'Frage B'))]
    df = spark.createDataFrame([(c, s, '2025-07-21 08:00:00', r) for c, s, r in rows],
                               'conv_id string, segment long, Erstellt string, `Raw Chat Data` string')
    out = os.path.join(tmp_path, 'csv')
    write_export_csv(df, out)
    got = {r['id']: (r['Frage'], r['Antwort'])
           for r in qa_from_segmented_export(read_chat_csv(spark, out, keep=('conv_id', 'segment'))).collect()}
    assert got == {'a-1': ('Frage A', 'Antwort A'), 'b-2': ('Frage B', D.NO_ANSWER)}
