"""Question/answer pairs of conversations that arrive as a stream of messages.

The batch extraction sees a whole conversation; here its messages come in over
many micro-batches, in any order. State per conversation holds what may still
matter: the first question, the first answer behind it, and the assistant's
messages in front of it, one of which becomes the answer if an earlier question
arrives late. It is let go of when the watermark has passed the conversation's
newest message by `idle`.
"""

from __future__ import annotations

import datetime as dt
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import dictionaries as D
from .ingest import naive_time, run_to_table

# times are whole seconds of the naive time, which no time zone moves
_STATE = 'q_turn bigint, frage string, asked bigint, version bigint, a_turns array<bigint>, a_texts array<string>'


def candidate_messages(messages: DataFrame) -> DataFrame:
    """The messages (id, turn, role, text, at) that can be a question
    or an answer, cut down before they are shuffled: of each conversation in a
    batch of rows the first question, the first assistant message behind it,
    and all in front of it. Applied to any share of a conversation it loses
    nothing, so a conversation with a third of all rows reaches its one task
    as a few rows per batch.

    Messages without an id, a turn or a time belong to no conversation; empty
    or missing user texts are no questions.
    """
    def cut(frames):
        for m in frames:
            asks = (m['role'] == 'user') & (m['text'].str.len() > 0)
            answers = m['role'] == 'assistant'
            first = m['turn'].where(asks).groupby(m['id']).transform('min')
            behind = answers & (m['turn'] > first)
            reply = m['turn'].where(behind).groupby(m['id']).transform('min')
            yield m[(asks & (m['turn'] == first)) | (answers & ~behind) | (behind & (m['turn'] == reply))]

    rows = messages.dropna(subset=['id', 'turn', 'at']).filter(F.col('role').isin('user', 'assistant'))
    return rows.mapInPandas(cut, rows.schema)


def _merge(state: tuple | None, rows: pd.DataFrame) -> tuple:
    """State and new rows -> state. Of messages with one turn the lesser text
    counts."""
    q_turn, frage, asked, version, a_turns, a_texts = state or (None, None, None, 0, [], [])
    asks = rows[rows['role'] == 'user'].sort_values(['turn', 'text']).head(1)
    for turn, text, at in zip(asks['turn'], asks['text'], asks['at']):
        if q_turn is None or (turn, text) < (q_turn, frage):
            q_turn, frage, asked = int(turn), text, int(at)
    said = dict(zip(a_turns, a_texts))
    answers = rows[rows['role'] == 'assistant']
    for turn, text in zip(answers['turn'], answers['text']):
        text = text if isinstance(text, str) else ''
        said[int(turn)] = min(said.get(int(turn), text), text)
    behind = [t for t in said if q_turn is not None and t > q_turn]
    keep = sorted(t for t in said if t not in behind) + ([min(behind)] if behind else [])
    return q_turn, frage, asked, version, keep, [said[t] for t in keep]


def _pair(state: tuple) -> tuple:
    q_turn, frage, asked, _, a_turns, a_texts = state
    reply = a_texts[-1] if a_turns and q_turn is not None and a_turns[-1] > q_turn else ''
    return q_turn, frage, asked, reply or D.NO_ANSWER


def qa_pair_versions(messages: DataFrame, lateness: str = '1 day', idle: dt.timedelta = dt.timedelta(days=1),
                     id_col: str = 'conv_id', turn_col: str = 'turn', time_col: str = 'created') -> DataFrame:
    """Streaming messages (id, turn, role, text, naive time) -> (id, q_turn,
    version, asked, Frage, Antwort) in update mode: a row whenever a
    conversation's pair has changed. `current_pairs` takes the one that counts.

    A message older than the watermark (the newest time less `lateness`) is
    late and dropped. A conversation is closed when the watermark is `idle`
    behind its newest message; an answer that comes after that is not looked
    at, a further question changes nothing.
    """
    rows = messages.select(F.col(id_col).alias('id'), F.col(turn_col).cast('bigint').alias('turn'), 'role', 'text',
                           F.unix_timestamp(time_col).alias('at'))
    wait = int(idle.total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        before, newest = _pair(held) if held else None, 0
        for m in frames:
            held = _merge(held, m)
            newest = max(newest, int(m['at'].max()) * 1000)
        pair = _pair(held)
        changed = pair[0] is not None and pair != before
        held = (*held[:3], held[3] + changed, *held[4:])
        state.update(held)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + wait + 1)
        if changed:
            q_turn, frage, asked, reply = pair
            yield pd.DataFrame({'id': [key[0]], 'q_turn': [q_turn], 'version': [held[3]], 'asked': [asked],
                                'Frage': [frage], 'Antwort': [reply]})

    out = T.StructType([T.StructField('id', rows.schema['id'].dataType), T.StructField('q_turn', T.LongType()),
                        T.StructField('version', T.LongType()), T.StructField('asked', T.LongType()),
                        T.StructField('Frage', T.StringType()), T.StructField('Antwort', T.StringType())])
    timed = candidate_messages(rows).withColumn('event_time', F.timestamp_seconds('at'))
    return (timed.withWatermark('event_time', lateness).groupBy('id')
            .applyInPandasWithState(step, out, _STATE, 'update', GroupStateTimeout.EventTimeTimeout))


def current_pairs(versions: DataFrame) -> DataFrame:
    """(id, Datetime, Frage, Antwort): of each conversation the newest version
    of its earliest question."""
    newest = versions.groupBy('id').agg(F.min_by(
        F.struct('asked', 'Frage', 'Antwort'), F.struct(F.col('q_turn'), -F.col('version'))).alias('p'))
    return newest.select('id', naive_time(F.timestamp_seconds('p.asked')).alias('Datetime'), 'p.Frage', 'p.Antwort')


def qa_pairs_run(messages: DataFrame, base: str, lateness: str = '1 day',
                 idle: dt.timedelta = dt.timedelta(days=1), **columns) -> DataFrame:
    """One incremental run over what has arrived: the pairs of all
    conversations so far. Runs with the same `base` go on where the last one
    ended; its checkpoint holds the state of the conversations still open."""
    versions = qa_pair_versions(messages, lateness, idle, **columns)
    return current_pairs(run_to_table(versions, 'qa_pairs', 'update', os.path.join(base, 'pairs')))
