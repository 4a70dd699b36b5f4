"""Named queries over the supplied tables: `QUERIES[name](spark, sf_dir)`.

The chat queries run on the deterministic fixture over the whole
`conversations` table (see `chatlens.sources.fixture`); the `document_*` and
`event_*` queries run the same operators over the whole `documents` and
`events` tables, which carry the text and time volume.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import char_len, daypart, german_weekday, parse_created
from ..functions.topics import topic_array_matched
from ..operators import classification as C
from ..operators import daily as DY
from ..operators import keywords as K
from ..operators import lengths as L
from ..operators import temporal as T
from ..operators import topics as TP
from ..operators.extract import extract_qa_flat, extract_qa_segments
from ..operators.features import add_features, qa_table
from ..operators.messages import latest_messages as _latest
from ..operators.overview import overview_metrics as _overview
from ..operators.scoring import FixtureBatchScorer, fixture_scorer, score_messages, score_with_store
from ..operators.search import search_count as _search_count
from ..operators.search import search_questions as _search_questions
from ..operators.search_index import add_to_index, read_index, search_indexed
from ..session import checkpoint_root
from ..sources.chat_csv import (qa_from_export, qa_from_segmented_export, read_chat_csv, rejects,
                                write_export_csv)
from ..sources.days import load_days, read_days
from ..sources.export import read_classification_json, write_classification_json
from ..sources.fixture import SPAN_SECONDS, STEP, chat_fixture, dirty_export_rows, export_rows, fixture_messages
from ..sources.tables import conversations, documents, events, table_path
from ..streaming.conversations import qa_pairs_run
from ..streaming.ingest import (current_rows, event_time, ingest_exports, ingest_overlapping_exports, naive_time,
                                read_message_stream, run_to_table, stream_location, window_run)

# Parameters of the registered queries (the dashboard's own defaults where it
# has them).
TOP_KEYWORDS = 25
LATEST = 20
SEARCH_COUNT_TERM = 'rind|poulet'
SEARCH_PAGE_TERM = 'grill'
SEARCH_FROM, SEARCH_TO = '2025-08-01', '2025-08-15'
FILTER_CATEGORY, FILTER_SENTIMENT = D.CATEGORY_FOOD, D.SENTIMENT_POSITIVE
# Messages per export segment in the JSON-path queries: small, so that most
# conversations of the given table span several segments and the segment
# merge is part of what the oracle checks.
EXPORT_SEGMENT_MESSAGES = 4
# Topics of the given documents, with words that occur in them.
DOCUMENT_TOPICS = (('Fragen', ('nicht', 'what', 'que ')), ('Dinge', ('thing', 'ción')), ('Wandel', ('tion', 'mente')),
                   ('Zeichen', ('&&&', '%%%')), ('Ersch', ('ersch', 'belich')))
# Days that a late message may lag behind the newest in the stream of late counts.
LATE_DAYS = 7
# Arrivals of the message stream, each holding the conversations of a third of
# the fixture's time, and how long it waits for what belongs to them.
ARRIVALS, ARRIVAL_LATENESS = 3, 15
# The loads of the table by day: some conversations of the first days, all of
# them, then the rest of the days.
DAY_LOADS = ("Datum < DATE '2025-08-10' AND id % 2 = 0", "Datum < DATE '2025-08-10'", "Datum >= DATE '2025-08-09'")

QA_OUT = ('id', 'Datum', 'Datetime', 'Wochentag', 'Stunde', 'Frage', 'Antwort',
          'Fragenlänge_Zeichen', 'Fragenlänge_Wörter', 'Tageszeit', 'Längenkategorie', 'Kategorie')


# ----------------------------------------------------------------- base frames

def qa(spark: SparkSession, d: str) -> DataFrame:
    return qa_table(fixture_messages(spark, d))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The QA table without its answers, for the analyses of questions."""
    return qa_table(fixture_messages(spark, d), answers=False)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Fixture messages as (conv_id, turn, text, role, datetime)."""
    return fixture_messages(spark, d).withColumnRenamed('created', 'datetime')


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_rule_based(messages(spark, d), keep=('conv_id', 'turn', 'datetime'))


def classified_latest(spark: SparkSession, d: str) -> DataFrame:
    return C.classify_rule_based(q_latest_messages(spark, d), keep=('nr', 'id', 'datetime'))


def event_times(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col('ts')
    return events(spark, d).select(
        F.col('event_id').alias('id'), ts.alias('Datetime'), german_weekday(ts).alias('Wochentag'),
        F.hour(ts).alias('Stunde'), daypart(F.hour(ts)).alias('Tageszeit'))


# ----------------------------------------------------------------- queries

def q_qa_pairs(spark, d):
    return extract_qa_flat(fixture_messages(spark, d))


def q_qa_from_json(spark, d):
    rows = export_rows(fixture_messages(spark, d), EXPORT_SEGMENT_MESSAGES)
    rows = rows.withColumn('Datetime', parse_created(F.col('Erstellt')))
    return extract_qa_segments(rows, raw_col='Raw Chat Data', id_col='conv_id', segment_col='segment')


def q_qa_from_csv(spark, d):
    """A1-A2, B1-B3 on files: the segmented export written by Spark as CSV
    export files under the shared checkpoint folder, read back with the
    export reader, checked and extracted."""
    path = os.path.join(checkpoint_root(spark), 'exports', uuid.uuid4().hex)
    write_export_csv(export_rows(fixture_messages(spark, d), EXPORT_SEGMENT_MESSAGES), path)
    rows = read_chat_csv(spark, path, keep=('conv_id', 'segment'))
    return qa_from_segmented_export(rows).select(F.col('id').cast('bigint').alias('id'), 'Datetime',
                                                 'Frage', 'Antwort')


def _dirty_export(spark, d):
    path = os.path.join(checkpoint_root(spark), 'exports', uuid.uuid4().hex)
    write_export_csv(dirty_export_rows(fixture_messages(spark, d), EXPORT_SEGMENT_MESSAGES), path)
    rows = read_chat_csv(spark, path, keep=('conv_id', 'segment'))
    return rows.withColumns({c: F.col(c).cast('bigint') for c in ('conv_id', 'segment')})


def q_qa_from_dirty_csv(spark, d):
    """A1-A2, B1-B4, B8-B11 on CSV exports with the faults of real ones, each
    row a chat of its own, in the original's reading."""
    return qa_from_export(_dirty_export(spark, d), keep=('conv_id', 'segment')).drop('id')


def q_qa_from_dirty_csv_robust(spark, d):
    """The same in robust mode: answers come from assistants only."""
    return qa_from_export(_dirty_export(spark, d), 'robust', keep=('conv_id', 'segment')).drop('id')


def q_export_rejects(spark, d):
    """The rows of those exports that give no question, by reason."""
    return rejects(_dirty_export(spark, d), keep=('conv_id', 'segment')).select('conv_id', 'segment', 'reason')


def q_qa_features(spark, d):
    return qa(spark, d).select(*QA_OUT)


def q_qa_json_features(spark, d):
    return add_features(q_qa_from_json(spark, d)).select(*QA_OUT)


def q_overview_metrics(spark, d):
    return _overview(questions(spark, d))


def q_questions_per_day(spark, d):
    return T.questions_per_day(questions(spark, d))


def q_weekday_counts(spark, d):
    return T.weekday_counts(questions(spark, d))


def q_daypart_counts(spark, d):
    return T.daypart_counts(questions(spark, d))


def q_hour_counts(spark, d):
    return T.hour_counts(questions(spark, d))


def q_weekday_hour_heatmap(spark, d):
    return T.weekday_hour_heatmap(questions(spark, d))


def q_weekday_hour_matrix(spark, d):
    return T.weekday_hour_matrix(questions(spark, d))


def q_length_stats(spark, d):
    return L.length_stats(questions(spark, d))


def q_length_bands(spark, d):
    return L.length_bands(questions(spark, d))


def q_length_histogram_chars(spark, d):
    return L.length_histogram(questions(spark, d), 'Fragenlänge_Zeichen', 30)


def q_length_histogram_words(spark, d):
    return L.length_histogram(questions(spark, d), 'Fragenlänge_Wörter', 20)


def q_shortest_questions(spark, d):
    return L.shortest_questions(questions(spark, d))


def q_longest_questions(spark, d):
    return L.longest_questions(questions(spark, d))


def _ranked(top: DataFrame) -> DataFrame:
    w = Window.orderBy(*K.keyword_order())
    return top.select(F.row_number().over(w).alias('Rang'), 'Keyword', 'Anzahl')


def q_top_keywords(spark, d):
    return _ranked(K.top_keywords(questions(spark, d), TOP_KEYWORDS))


def q_keyword_weights(spark, d):
    return K.keyword_weights(questions(spark, d), TOP_KEYWORDS)


def q_topic_labels(spark, d):
    return questions(spark, d).select('id', 'Kategorie')


def q_topic_counts(spark, d):
    return TP.topic_counts(questions(spark, d))


def q_topic_daily_trend(spark, d):
    return TP.topic_daily_trend(questions(spark, d))


def q_topic_mean_length(spark, d):
    return TP.topic_mean_length(questions(spark, d))


def q_search_count(spark, d):
    return _search_count(questions(spark, d), SEARCH_COUNT_TERM)


def q_search_questions(spark, d):
    return _search_questions(questions(spark, d), SEARCH_PAGE_TERM, messages=fixture_messages(spark, d))


def q_search_by_date(spark, d):
    return _search_questions(questions(spark, d), '', SEARCH_FROM, SEARCH_TO, messages=fixture_messages(spark, d))


def _by_day(spark, d):
    """The QA table by day and its daily counts after three loads, of which
    the later ones repeat rows of the earlier."""
    base, rows = os.path.join(checkpoint_root(spark), 'days', uuid.uuid4().hex), qa(spark, d)
    table, counts = os.path.join(base, 'qa'), os.path.join(base, 'counts')
    for part in DAY_LOADS:
        days = load_days(rows.filter(part), table)
        parts = DY.refresh_days(read_days(spark, table, rows.schema), counts, days)
    return read_days(spark, table, rows.schema), parts


def q_search_index(spark, d):
    """D2, D3 by the trigram index over the table partitioned by day."""
    table, _ = _by_day(spark, d)
    path = os.path.join(checkpoint_root(spark), 'days', f'index-{uuid.uuid4().hex}')
    add_to_index(table, path)
    return _search_questions(search_indexed(table, read_index(spark, path), SEARCH_PAGE_TERM))


def q_search_day_table(spark, d):
    """D1, D3 on the table partitioned by day."""
    return _search_questions(_by_day(spark, d)[0], '', SEARCH_FROM, SEARCH_TO)


def q_daily_keywords(spark, d):
    """E8 from daily counts."""
    table, parts = _by_day(spark, d)
    return _ranked(DY.keywords(parts, table, TOP_KEYWORDS))


def q_daily_topic_trend(spark, d):
    """E9 from daily counts."""
    return DY.topic_daily_trend(_by_day(spark, d)[1])


def q_daily_length_stats(spark, d):
    """E3, E4 from daily counts."""
    return DY.length_stats(_by_day(spark, d)[1])


def q_latest_messages(spark, d):
    return _latest(questions(spark, d), LATEST, messages=fixture_messages(spark, d))


def q_classify_messages(spark, d):
    return classified(spark, d)


def q_classify_latest(spark, d):
    return classified_latest(spark, d)


def q_classification_export(spark, d):
    """A3: the classified messages written as JSON lines to the shared
    checkpoint folder by the executors, and read back."""
    path = os.path.join(checkpoint_root(spark), 'exports', uuid.uuid4().hex)
    write_classification_json(classified(spark, d), path)
    return read_classification_json(spark, path)


def q_classification_summary(spark, d):
    return C.classification_summary(classified(spark, d))


def q_category_counts(spark, d):
    return C.category_counts(classified(spark, d))


def q_sentiment_counts(spark, d):
    return C.sentiment_counts(classified(spark, d))


def q_classification_filtered(spark, d):
    return C.classification_filtered(classified(spark, d), FILTER_CATEGORY, FILTER_SENTIMENT)


def q_filter_choices(spark, d):
    return C.filter_choices(classified(spark, d))


def q_sentiment_timeline(spark, d):
    return C.sentiment_timeline(classified_latest(spark, d))


def q_scored_messages(spark, d):
    return score_messages(messages(spark, d), scorer=fixture_scorer, keep=('conv_id', 'turn'),
                          sleep=None)


def q_scored_batches(spark, d):
    """I3-I7 in batches with kept replies: the users' messages are scored
    first, then all, by the same store."""
    store = os.path.join(checkpoint_root(spark), 'scores', uuid.uuid4().hex)
    msgs = messages(spark, d)
    for part in (msgs.filter("role = 'user'"), msgs):
        out = score_with_store(part, FixtureBatchScorer, store, keep=('conv_id', 'turn'), sleep=None)
    return out


def q_classify_dirty_messages(spark, d):
    """NULL, empty, blank, all-digit and short texts among the messages."""
    k = F.pmod(F.col('conv_id') + F.col('turn'), F.lit(6))
    text = (F.when(k == 0, F.lit(None).cast('string')).when(k == 1, '').when(k == 2, ' \t ').when(k == 3, '4711001')
            .when(k == 4, ' top ').otherwise(F.col('text')))
    return C.classify_rule_based(messages(spark, d).withColumn('text', text), keep=('conv_id', 'turn', 'datetime'))


def q_document_keywords(spark, d):
    docs = documents(spark, d)
    return _ranked(K.top_keywords(docs, TOP_KEYWORDS, text_col='text', order_cols=('doc_id',)))


def q_document_classification(spark, d):
    c = C.classify_rule_based(documents(spark, d), text_col='text', role_col='lang')
    return c.groupBy('kategorie', 'sentiment').agg(F.count(F.lit(1)).alias('Anzahl'))


def q_document_topic_counts(spark, d):
    low = documents(spark, d).select(F.lower('text').alias('low'))
    return TP.topic_counts(low.select(topic_array_matched('low', DOCUMENT_TOPICS).alias('Themen')))


def q_document_length_stats(spark, d):
    docs = documents(spark, d).select(char_len('text').alias('Fragenlänge_Zeichen'))
    return L.length_stats(docs)


def q_event_weekday_hour(spark, d):
    return T.weekday_hour_heatmap(event_times(spark, d), counted=None)


def q_event_daypart_counts(spark, d):
    return T.daypart_counts(event_times(spark, d))


def q_event_hour_counts(spark, d):
    return T.hour_counts(event_times(spark, d))


def _message_stream(spark, d):
    # a file source watches a folder or a glob; the given table is one file
    return chat_fixture(read_message_stream(spark, table_path(d, 'conversations').replace(
        'conversations.parquet', 'conversation[s].parquet')))


def q_stream_daily_counts(spark, d):
    """J1 + J2: messages arriving as a stream, counted per day in append mode
    with a watermark, to the end of the input."""
    msgs = _message_stream(spark, d).withColumn('event_time', event_time('created'))
    return _days(window_run(msgs, stream_location(spark, f'daily_counts-{uuid.uuid4().hex}'), last=True))


def _days(counts):
    return counts.select(naive_time('window_start').alias('window_start'),
                         naive_time('window_end').alias('window_end'), 'Anzahl')


def q_stream_late_counts(spark, d):
    """The users' messages arrive first, all others in a second run of the
    same stream; of those, the ones in days that the watermark has passed by
    then are late and not counted."""
    base = stream_location(spark, f'late_counts-{uuid.uuid4().hex}')
    arrived = os.path.join(base, 'in')
    given = conversations(spark, d).select('conv_id', 'turn', 'role', 'text')

    def run(rows, last):
        rows.write.mode('append').parquet(arrived)
        msgs = chat_fixture(read_message_stream(spark, arrived)).withColumn('event_time', event_time('created'))
        return window_run(msgs, base, '1 day', f'{LATE_DAYS} days', last=last)

    run(given.filter("role = 'user'"), False)
    return _days(run(given.filter("role IS DISTINCT FROM 'user'"), True))


def q_stream_qa_from_csv(spark, d):
    """J1 on CSV exports of two versions (other column order, a further
    column): streamed into a table of export rows, then extracted."""
    base = stream_location(spark, f'qa_from_csv-{uuid.uuid4().hex}')
    rows = export_rows(fixture_messages(spark, d), EXPORT_SEGMENT_MESSAGES)
    write_export_csv(rows.filter('segment = 0'), os.path.join(base, 'in'))
    write_export_csv(rows.filter('segment <> 0').select(
        'segment', 'Raw Chat Data', F.lit('x').alias('Nr'), 'Erstellt', 'conv_id'), os.path.join(base, 'in'), 'append')
    rows = ingest_exports(spark, os.path.join(base, 'in'), base, keep=('conv_id', 'segment'))
    return qa_from_segmented_export(rows).select(F.col('id').cast('bigint').alias('id'), 'Datetime', 'Frage', 'Antwort')


def q_stream_qa_dedup(spark, d):
    """J1 on overlapping exports: three fuller and fuller ones, each repeating
    the rows of the one before, the first with conversations that go on
    later; taken in by a run of the same stream each."""
    base = stream_location(spark, f'qa_dedup-{uuid.uuid4().hex}')
    arrived, msgs = os.path.join(base, 'in'), fixture_messages(spark, d)
    for part in ('conv_id % 3 = 0 AND (conv_id % 2 = 0 OR turn < 2)', 'conv_id % 3 <> 1', 'true'):
        write_export_csv(export_rows(msgs.filter(part), EXPORT_SEGMENT_MESSAGES), arrived, 'append')
        rows = ingest_overlapping_exports(spark, arrived, base, keep=('conv_id', 'segment'))
    return qa_from_segmented_export(current_rows(rows, ('conv_id', 'segment'))).select(
        F.col('id').cast('bigint').alias('id'), 'Datetime', 'Frage', 'Antwort')


def q_stream_qa_pairs(spark, d):
    """B5-B7 on a stream of messages: a run of the same stream for each third
    of the time; every fifth conversation's answers come one run later."""
    base = stream_location(spark, f'qa_pairs-{uuid.uuid4().hex}')
    arrived = os.path.join(base, 'in')
    third = F.floor((F.col('conv_id') * STEP) % SPAN_SECONDS / (SPAN_SECONDS // ARRIVALS))
    late = (F.col('conv_id') % 5 == 0) & (F.col('role') == 'assistant')
    given = conversations(spark, d).select('conv_id', 'turn', 'role', 'text').withColumn(
        'run', third + F.when(late, 1).otherwise(0))
    for i in range(ARRIVALS + 1):
        given.filter(F.col('run') == i).drop('run').write.mode('append').parquet(arrived)
        pairs = qa_pairs_run(chat_fixture(read_message_stream(spark, arrived)), base, f'{ARRIVAL_LATENESS} days',
                             dt.timedelta(days=ARRIVAL_LATENESS))
    return pairs


def q_stream_classification_counts(spark, d):
    """J1 + J3: rule classification of a message stream, counts per label."""
    c = C.classify_rule_based(_message_stream(spark, d), keep=('conv_id',))
    return run_to_table(c.groupBy('kategorie', 'sentiment').agg(F.count(F.lit(1)).alias('Anzahl')),
                        'classification_counts')


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    'qa_pairs': q_qa_pairs,
    'qa_from_json': q_qa_from_json,
    'qa_from_csv': q_qa_from_csv,
    'qa_from_dirty_csv': q_qa_from_dirty_csv,
    'qa_from_dirty_csv_robust': q_qa_from_dirty_csv_robust,
    'export_rejects': q_export_rejects,
    'qa_features': q_qa_features,
    'qa_json_features': q_qa_json_features,
    'overview_metrics': q_overview_metrics,
    'questions_per_day': q_questions_per_day,
    'weekday_counts': q_weekday_counts,
    'daypart_counts': q_daypart_counts,
    'hour_counts': q_hour_counts,
    'weekday_hour_heatmap': q_weekday_hour_heatmap,
    'weekday_hour_matrix': q_weekday_hour_matrix,
    'length_stats': q_length_stats,
    'length_bands': q_length_bands,
    'length_histogram_chars': q_length_histogram_chars,
    'length_histogram_words': q_length_histogram_words,
    'shortest_questions': q_shortest_questions,
    'longest_questions': q_longest_questions,
    'top_keywords': q_top_keywords,
    'keyword_weights': q_keyword_weights,
    'topic_labels': q_topic_labels,
    'topic_counts': q_topic_counts,
    'topic_daily_trend': q_topic_daily_trend,
    'topic_mean_length': q_topic_mean_length,
    'search_count': q_search_count,
    'search_questions': q_search_questions,
    'search_by_date': q_search_by_date,
    'search_day_table': q_search_day_table,
    'search_index': q_search_index,
    'daily_keywords': q_daily_keywords,
    'daily_topic_trend': q_daily_topic_trend,
    'daily_length_stats': q_daily_length_stats,
    'latest_messages': q_latest_messages,
    'classify_messages': q_classify_messages,
    'classify_latest': q_classify_latest,
    'classification_export': q_classification_export,
    'classification_summary': q_classification_summary,
    'category_counts': q_category_counts,
    'sentiment_counts': q_sentiment_counts,
    'classification_filtered': q_classification_filtered,
    'filter_choices': q_filter_choices,
    'sentiment_timeline': q_sentiment_timeline,
    'scored_messages': q_scored_messages,
    'scored_batches': q_scored_batches,
    'classify_dirty_messages': q_classify_dirty_messages,
    'document_keywords': q_document_keywords,
    'document_classification': q_document_classification,
    'document_topic_counts': q_document_topic_counts,
    'document_length_stats': q_document_length_stats,
    'event_weekday_hour': q_event_weekday_hour,
    'event_daypart_counts': q_event_daypart_counts,
    'event_hour_counts': q_event_hour_counts,
    'stream_qa_from_csv': q_stream_qa_from_csv,
    'stream_qa_dedup': q_stream_qa_dedup,
    'stream_qa_pairs': q_stream_qa_pairs,
    'stream_daily_counts': q_stream_daily_counts,
    'stream_late_counts': q_stream_late_counts,
    'stream_classification_counts': q_stream_classification_counts,
}
