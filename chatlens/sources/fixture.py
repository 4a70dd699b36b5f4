"""Deterministic chat fixture over the `conversations` table.

The raw table has no timestamps and almost no dictionary hits, so the fixture
adds both by integer arithmetic that SQL engines share (the oracle SQL in
`chatlens.plans.oracle` states the same rule):

- i = (conv_id*7 + turn) % 16, P = PHRASES[i]
- text' = text || ' ' || P
- created = 2025-07-21 00:00:00 + (conv_id * 104729) % 3628800 seconds (42 days)

Every row of the input is kept and each text stays whole. The work grows with
the table: it is one row-local projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefeat import fmt_created
from .tables import conversations

# Test phrases, appended to the given texts; index 15 adds none.
PHRASES = (
    'Rezept für Poulet bitte',
    'Rind vom Grill',
    'Schweinskotelett in der Pfanne',
    'Schmorbraten kochen',
    'das ist super, danke',
    'nicht gut, zäh und trocken',
    'so ein Mist',
    'verdammt, aber super',
    'Guten Abend',
    'Filet zäh und versalzen',
    'Straße 2kg rib-eye Café',
    'hilfe, klappt nicht',
    'lecker und köstlich',
    'was soll ich machen',
    'Steak grillieren bbq',
    '',
)
START = '2025-07-21 00:00:00'
SPAN_SECONDS = 3628800
STEP = 104729


def chat_fixture(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> same columns with fixture text + created."""
    i = (F.col('conv_id') * 7 + F.col('turn')) % 16
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (i + 1).cast('int'))
    text = F.concat(F.col('text'), F.lit(' '), phrase)
    secs = ((F.col('conv_id') * STEP) % SPAN_SECONDS).cast('int')
    created = F.lit(START).cast('timestamp_ntz') + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)
    return messages.select('conv_id', 'turn', 'role', text.alias('text'), created.alias('created'))


def fixture_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_fixture(conversations(spark, sf_dir))


# What is wrong with the row of `dirty_export_rows` at place i of this list.
DIRT = ('clean', 'header_row', 'empty_created', 'bad_timestamp', 'empty_chat', 'cut', 'cut_doubled', 'no_user_text')


def dirty_export_rows(messages: DataFrame, segment_messages: int = 256) -> DataFrame:
    """Export rows as `export_rows` makes them, each block of messages a chat
    of its own with the parts spelled before the role, and with the faults of
    real exports. Row (conv_id, segment) has fault DIRT[(conv_id + segment) %
    8]: none; the header again; no time; no readable time; no chat; JSON whose
    closing brackets are cut off, in plain spelling or with every quote
    doubled; user messages without a text."""
    k = int(segment_messages)
    segment = F.expr(f'(turn - pmod(turn, {k})) div {k}')
    dirt = F.element_at(F.array(*[F.lit(x) for x in DIRT]),
                        (F.pmod(F.col('conv_id') + segment, F.lit(len(DIRT))) + 1).cast('int'))
    text = F.when((F.col('dirt') != 'no_user_text') | (F.col('role') != 'user'), F.col('text'))
    rows = messages.withColumns({'segment': segment, 'dirt': dirt}).withColumn('text', text)
    doc = F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct('turn', 'role', 'text'))),
        lambda m: F.struct(F.array(F.struct(F.lit('text').alias('type'), m['text'].alias('text'))).alias('parts'),
                           m['role'].alias('role'))).alias('messages')))
    rows = rows.groupBy('conv_id', 'segment', 'dirt').agg(F.min('created').alias('created'), doc.alias('raw'))
    cut = F.expr('left(raw, length(raw) - 2)')
    created = (F.when(F.col('dirt') == 'header_row', 'Erstellt').when(F.col('dirt') == 'empty_created', '')
               .when(F.col('dirt') == 'bad_timestamp', 'gestern').otherwise(fmt_created(F.col('created'))))
    raw = (F.when(F.col('dirt') == 'header_row', 'Raw Chat Data').when(F.col('dirt') == 'empty_chat', '')
           .when(F.col('dirt') == 'cut', cut).when(F.col('dirt') == 'cut_doubled', F.replace(cut, F.lit('"'), F.lit('""')))
           .otherwise(F.col('raw')))
    return rows.select('conv_id', 'segment', created.alias('Erstellt'), raw.alias('Raw Chat Data'))


def export_rows(messages: DataFrame, segment_messages: int = 256) -> DataFrame:
    """The CSV-export shape of a flat message table, in bounded segments:
    `(conv_id, segment, Erstellt, Raw Chat Data)`, one row per conversation
    and block of `segment_messages` consecutive turn numbers, holding those
    messages as one export JSON document (used to test the JSON path on the
    given tables; read it with `extract_qa_segments`).

    A group is (conversation, turn block), so it holds at most
    `segment_messages` rows however large the conversation is, and the blocks
    of one conversation hash to different tasks. `Erstellt` is the earliest
    message time of the segment.
    """
    k = int(segment_messages)
    if k < 1:
        raise ValueError('segment_messages must be at least 1')
    segment = F.expr(f'(turn - pmod(turn, {k})) div {k}')  # floor(turn / k), exact
    msg = F.struct(F.col('turn'), F.col('role'), F.col('text'))
    doc = F.to_json(F.struct(F.transform(
        F.array_sort(F.collect_list(msg)),
        lambda m: F.struct(m['role'].alias('role'), F.array(F.struct(
            F.lit('text').alias('type'), m['text'].alias('text'))).alias('parts')),
    ).alias('messages')))
    return (messages.groupBy('conv_id', segment.alias('segment'))
            .agg(F.min('created').alias('created'), doc.alias('raw'))
            .select(F.col('conv_id'), 'segment',
                    fmt_created(F.col('created')).alias('Erstellt'),
                    F.col('raw').alias('Raw Chat Data')))
