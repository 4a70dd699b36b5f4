"""What a plan uses twice is computed once: pages, segment candidates; and the
copies of questions follow the conversations."""

from pyspark.sql import functions as F

from chatlens.operators.extract import SALT_BUCKETS, _salt, extract_qa_flat, extract_qa_segments
from chatlens.operators.search import search_questions
from chatlens.plans.catalog import QUERIES, questions
from chatlens.session import clear_stored, stored
from chatlens.sources.fixture import export_rows, fixture_messages
from chatlens.functions import parse_created

from conftest import SF0001


def final_plan(df):
    """The plan as it ran, broadcasts off."""
    spark = df.sparkSession
    old = spark.conf.get('spark.sql.autoBroadcastJoinThreshold')
    spark.conf.set('spark.sql.autoBroadcastJoinThreshold', -1)
    try:
        df = df.select('*')
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split('== Initial Plan ==')[0]
    finally:
        spark.conf.set('spark.sql.autoBroadcastJoinThreshold', old)


def test_page_is_found_once(spark):
    page = search_questions(questions(spark, SF0001), 'grill', messages=fixture_messages(spark, SF0001))
    p = final_plan(page)
    assert p.count('conversations.parquet') == 1 and 'role#' in p  # the answers only
    rows = page.collect()
    whole = QUERIES['qa_features'](spark, SF0001).filter(F.col('Frage').rlike('(?iu)grill')).orderBy('Datetime', 'id').limit(50)
    assert [(r.id, r.Frage) for r in rows] == [(r.id, r.Frage) for r in whole.collect()]


def test_segments_are_decoded_once(spark):
    """Both sides of the merge scan one persisted frame; behind it the input is
    read once."""
    rows = export_rows(fixture_messages(spark, SF0001), 4).withColumn('Datetime', parse_created(F.col('Erstellt')))
    read = spark.sparkContext.accumulator(0)

    @F.udf('string')
    def seen(x):
        read.add(1)
        return x

    n = rows.count()
    out = extract_qa_segments(rows.withColumn('Raw Chat Data', seen('Raw Chat Data')), id_col='conv_id')
    p = final_plan(out)
    assert 'InMemoryTableScan' in p and read.value == n
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, QUERIES['qa_pairs'](spark, SF0001).collect()))


def test_salts_follow_the_conversations(spark):
    """A short conversation has one salt; one with a third of all rows has no
    salt with over twice the median of its rows."""
    short = spark.range(400).select(F.lit(4).alias('c'), F.col('id').alias('turn'))
    assert short.filter('turn < 256').select(_salt(F.col('turn'), 256, SALT_BUCKETS)).distinct().count() == 1
    hot = spark.range(2_000_000).select(_salt(F.col('id'), 256, SALT_BUCKETS).alias('s')).groupBy('s').count()
    n = sorted(r['count'] for r in hot.collect())
    assert len(n) == SALT_BUCKETS and n[-1] <= 2 * n[len(n) // 2]


def test_hot_conversation_in_both_forms(spark):
    """Answers far behind the question, over many spans."""
    rows = [(1, t, 'system', 'x') for t in range(3000)] + [(1, 3000, 'user', 'q'), (1, 9000, 'assistant', 'a'), (1, 9001, 'assistant', 'b')]
    rows += [(2, 5, 'assistant', 'hello'), (2, 600, 'user', 'q2'), (3, 1, 'assistant', 'alone'), (4, 1, 'user', 'q4')]
    df = spark.createDataFrame(rows, 'conv_id long, turn long, role string, text string')
    for span in (1, 256):
        for buckets in (1, 7, 64, 256):
            got = extract_qa_flat(df, created_col=None, salt_buckets=buckets, span=span).collect()
            assert sorted((r.id, r.Frage, r.Antwort) for r in got) == [
                (1, 'q', 'a'), (2, 'q2', 'Keine Antwort gefunden'), (4, 'q4', 'Keine Antwort gefunden')]


def test_stored_tables_can_be_deleted(spark):
    """Run last in this file: frames that read stored tables end with them."""
    assert stored(spark.range(3), 'three').count() == 3
    assert clear_stored(spark) and not clear_stored(spark)
