"""Question/answer pairs from messages that arrive in many micro-batches."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatlens import dictionaries as D
from chatlens.streaming import conversations as S
from chatlens.streaming.ingest import run_to_table

SCHEMA = 'conv_id bigint, turn bigint, role string, text string, created timestamp_ntz'
T0 = dt.datetime(2025, 3, 30, 2, 15)  # a time that a daylight-saving change skips in some zones


def pair(messages):
    """First question and first answer behind it, by walking in turn order."""
    question = None
    for turn, role, text, at in sorted(messages, key=lambda m: m[0]):
        if question is None:
            if role == 'user' and text:
                question = (at, text)
        elif role == 'assistant':
            return (*question, text or D.NO_ANSWER)
    return (*question, D.NO_ANSWER) if question else None


def conversation(rng, size):
    turns = rng.sample(range(size * 3), size)
    return [(t, rng.choice(['user', 'assistant', 'assistant', 'system']), rng.choice(['', None, f'text {t}', 'ä 😀']),
             T0 + dt.timedelta(minutes=t)) for t in turns]


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode('append').parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def pairs(df):
    return {r['id']: (r['Datetime'], r['Frage'], r['Antwort']) for r in df.collect()}


@pytest.mark.parametrize('zone', ['UTC', 'America/New_York'])
def test_pairs_over_random_batches(spark, tmp_path, zone):
    """Messages in random order over five runs of one stream: after each run
    the pairs of what has arrived so far, in any session time zone."""
    before = spark.conf.get('spark.sql.session.timeZone')
    spark.conf.set('spark.sql.session.timeZone', zone)
    try:
        rng = random.Random(5)
        talks = {i: conversation(rng, rng.randint(1, 12)) for i in range(40)}
        talks[99] = conversation(rng, 400)
        rows = [(i, *m) for i, ms in talks.items() for m in ms]
        rng.shuffle(rows)
        src, base, step = os.path.join(tmp_path, 'in'), os.path.join(tmp_path, 'run'), len(rows) // 5 + 1
        for at in range(0, len(rows), step):
            stream = arrive(spark, src, rows[at:at + step])
            got = pairs(S.qa_pairs_run(stream, base, '30 days', dt.timedelta(days=30)))
            want = {i: pair([r[1:] for r in rows[:at + step] if r[0] == i]) for i in talks}
            assert got == {i: p for i, p in want.items() if p}
    finally:
        spark.conf.set('spark.sql.session.timeZone', before)


def test_closed_conversations_leave_no_state(spark, tmp_path):
    """An answer within the wait is taken; one behind the close is not, and a
    further question changes nothing."""
    src, base = os.path.join(tmp_path, 'in'), os.path.join(tmp_path, 'run')

    def run(*rows):
        return pairs(S.qa_pairs_run(arrive(spark, src, rows), base, '1 hour', dt.timedelta(days=1)))

    day = dt.timedelta(days=1)
    assert run((1, 0, 'user', 'eins', T0), (2, 0, 'user', 'zwei', T0)) == {
        1: (T0, 'eins', D.NO_ANSWER), 2: (T0, 'zwei', D.NO_ANSWER)}
    assert run((1, 1, 'assistant', 'A', T0))[1] == (T0, 'eins', 'A')
    run((3, 0, 'user', 'später', T0 + 5 * day))
    got = run((2, 1, 'assistant', 'B', T0 + 6 * day), (1, 2, 'user', 'noch eine', T0 + 6 * day))
    assert got[2] == (T0, 'zwei', D.NO_ANSWER) and got[1] == (T0, 'eins', 'A')
    assert got[3] == (T0 + 5 * day, 'später', D.NO_ANSWER)


def test_rows_without_key_and_no_rows(spark, tmp_path):
    src, base = os.path.join(tmp_path, 'in'), os.path.join(tmp_path, 'run')
    assert pairs(S.qa_pairs_run(arrive(spark, src, []), base)) == {}
    rows = [(None, 0, 'user', 'x', T0), (4, None, 'user', 'x', T0), (5, 0, 'user', 'x', None), (6, 0, None, 'x', T0),
            (7, 0, 'user', '', T0), (8, 3, 'user', 'b', T0), (8, 3, 'user', 'a', T0), (8, 3, 'user', 'a', T0)]
    assert pairs(S.qa_pairs_run(arrive(spark, src, rows), base)) == {8: (T0, 'a', D.NO_ANSWER)}


def test_a_hot_conversation_is_cut_before_the_shuffle(spark):
    """30,000 messages of one conversation, its rows dealt over 6 partitions in
    turn order: each batch of rows leaves its first question and one answer."""
    n = 30000
    msgs = spark.range(0, n, 1, 6).select(
        F.lit(1).cast('bigint').alias('id'), F.col('id').alias('turn'),
        F.when(F.col('id') % 2 == 0, 'user').otherwise('assistant').alias('role'), F.lit('x').alias('text'),
        F.col('id').alias('at'))
    got = S.candidate_messages(msgs).collect()
    assert len(got) <= 2 * 6 * (n // 6 // 10000 + 1)
    assert {(r['turn'], r['role']) for r in got} >= {(0, 'user'), (1, 'assistant')}


def test_the_cut_loses_no_pair():
    """State merged from cut shares equals state merged from all rows."""
    rng = random.Random(11)
    for _ in range(200):
        talk = conversation(rng, rng.randint(1, 15))
        state = None
        rng.shuffle(talk)
        for i in range(0, len(talk), 4):
            frame = pd.DataFrame(talk[i:i + 4], columns=['turn', 'role', 'text', 'when'])
            frame['at'] = [int((w - dt.datetime(1970, 1, 1)).total_seconds()) for w in frame['when']]
            frame = frame[frame['role'] != 'system']
            state = S._merge(state, frame[(frame['role'] == 'assistant') | (frame['text'].str.len() > 0)])
        q_turn, frage, reply = (S._pair(state)[i] for i in (0, 1, 3))
        want = pair(talk)
        assert (frage, reply) == want[1:] if want else q_turn is None


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    src, base = os.path.join(tmp_path, 'in'), os.path.join(tmp_path, 'run')
    first = pairs(S.qa_pairs_run(arrive(spark, src, [(1, 0, 'user', 'q', T0)]), base))
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    # the commit of the batch is lost, as when the driver dies behind the write
    commits = os.path.join(base, 'pairs', 'state', 'commits')
    for f in os.listdir(commits):
        if f.lstrip('.').split('.')[0].isdigit():
            os.remove(os.path.join(commits, f))
    again = run_to_table(S.qa_pair_versions(stream), 'qa_pairs', 'update', os.path.join(base, 'pairs'))
    assert pairs(S.current_pairs(again)) == first == {1: (T0, 'q', D.NO_ANSWER)}
