"""First question / first answer of each conversation.

Three entry points, one result shape `(id, Datetime, Frage, Antwort)`:

* `extract_qa_flat` - a flat message table `(id, turn, role, text[, created])`.
  Map-side-combined aggregates and a salted outer join, so no conversation,
  however large, lands in one task.
* `extract_qa_json` - the export shape: one row per conversation holding the
  chat as JSON text. Entirely row-local (no shuffle): `from_json` plus
  higher-order array functions, with the regex fallback for rows whose JSON
  does not decode.
* `extract_qa_segments` - the same JSON, cut into bounded segments of one
  conversation (at most a fixed number of messages per row). Each segment is
  reduced row-locally to at most three candidate messages, which the flat
  plan then merges; no conversation is ever gathered into one row or task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as D
from ..session import stored

CHAT_SCHEMA = T.StructType([T.StructField('messages', T.ArrayType(T.StructType([
    T.StructField('role', T.StringType()),
    T.StructField('parts', T.ArrayType(T.StructType([
        T.StructField('type', T.StringType()),
        T.StructField('text', T.StringType()),
    ]))),
])))])

# Of the flat form: how many keys one conversation is spread over at most (in
# words of 64 bits), and how many turn numbers in a row share a key.
SALT_WORDS = 4
SALT_BUCKETS = 64 * SALT_WORDS
SALT_SPAN = 256

# The fallback patterns for exports whose JSON does not decode,
# in both spellings (quotes doubled as inside a CSV field, and plain). `(?d)`
# makes `.` stop at \n only, as in Python.
FALLBACK_QUESTION_DOUBLED = r'""text"":""([^"]+)""[^}]*\}[^}]*""role"":""user""'
FALLBACK_QUESTION_PLAIN = r'"text":"([^"]+)"[^}]*\}[^}]*"role":"user"'
FALLBACK_ANSWER_DOUBLED = r'(?d)""role"":""assistant"".*?""text"":""([^"]+)""'
FALLBACK_ANSWER_PLAIN = r'(?d)"role":"assistant".*?"text":"([^"]+)"'

# Robust mode's answer, own pattern: behind the question, the first assistant
# message with a text part of its own, its parts before its role (group 1) or
# behind it (group 2). No brace may lie between a text and its role but those
# of further parts, so a text of another message never fits.
_OTHER_PARTS = r'(?:\s*,\s*\{[^{}]*\})*'
ROBUST_ANSWER = (r'(?s)"text":"[^"]+"[^}]*\}[^}]*"role":"user".*?(?:'
                 r'"text":"([^"]*)"[^{}]*\}' + _OTHER_PARTS + r'\s*\][^{}]*"role":"assistant"'
                 r'|"role":"assistant"[^{}]*(?:\{[^{}]*\}\s*,\s*)*\{[^{}]*"text":"([^"]*)")')


def _answer_or_sentinel(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit('')), F.lit(D.NO_ANSWER))


# --------------------------------------------------------------------------- flat


def _salt(turn: Column, span: int, buckets: int) -> Column:
    """The bucket of a turn: `span` turn numbers in a row share one, and the
    buckets follow each other in hashed order."""
    return F.pmod(F.xxhash64(F.floor(turn / span)), F.lit(buckets)).cast('int')


def extract_qa_flat(messages: DataFrame, id_col: str = 'conv_id', turn_col: str = 'turn',
                    role_col: str = 'role', text_col: str = 'text',
                    created_col: str | None = 'created', salt_buckets: int = SALT_BUCKETS,
                    answers: bool = True, span: int = SALT_SPAN) -> DataFrame:
    """Flat form of the extraction.

    question = lowest-turn user message with non-empty text;
    answer   = lowest-turn assistant message after it (its text, or the
               sentinel when it is empty or missing).

    Plan: (1) one aggregate per conversation, combined map-side: `min(turn)`
    and `min_by` of text/time over valid user rows, and a bit set of the salts
    that its assistant rows have; (2) the question row, once per salt in that
    set, meets the assistant rows on (id, salt) with `turn > q_turn` in the
    join condition; (3) one aggregate per conversation takes the question
    (carried by one copy only) and `min_by(text, turn)` over the matched
    assistant rows, combined map-side. The input is read twice and there is
    no final join.

    `span` turn numbers in a row share a salt, so a conversation of ordinary
    length has one copy, and one that holds a third of all rows is spread over
    `salt_buckets` (at most 256) keys; nothing is copied to salts that a
    conversation does not have. `turn` may be any orderable numeric type (the
    segment merge uses a decimal key).

    Without `answers` only the question part of step (1) runs and `Antwort` is
    NULL: enough for every analysis of the questions, and it never touches
    assistant text. `q_turn` comes along, from which `fetch_answers` finds the
    answers of a page of questions later.
    """
    created = F.col(created_col) if created_col else F.lit(None).cast('timestamp_ntz')
    m = messages.select(F.col(id_col).alias('id'), F.col(turn_col).alias('turn'),
                        F.col(role_col).alias('role'), F.col(text_col).alias('text'),
                        created.alias('Datetime'))
    asks = (F.col('role') == 'user') & (F.length('text') > 0)
    if not answers:
        q = m.filter(asks).groupBy('id').agg(F.min('turn').alias('q_turn'), F.min_by('text', 'turn').alias('Frage'),
                                             F.min_by('Datetime', 'turn').alias('Datetime'))
        return q.select('id', 'Datetime', 'Frage', F.lit(None).cast('string').alias('Antwort'), 'q_turn')
    buckets = min(max(salt_buckets, 1), 64 * SALT_WORDS)
    words = -(-buckets // 64)
    answer = F.col('role') == 'assistant'
    salt = _salt(F.col('turn'), span, buckets)
    rows = m.filter((F.col('role') == 'user') | answer).select(
        'id', F.when(asks, F.col('turn')).alias('q_turn'), F.when(asks, F.col('text')).alias('Frage'),
        F.when(asks, F.col('Datetime')).alias('Datetime'), F.when(answer, salt).alias('salt'))
    held = [F.expr(f'bit_or(CASE WHEN salt div 64 = {w} THEN shiftleft(1L, salt % 64) END)').alias(f'salts{w}')
            for w in range(words)]
    q = rows.groupBy('id').agg(F.min('q_turn').alias('q_turn'), F.min_by('Frage', 'q_turn').alias('Frage'),
                               F.min_by('Datetime', 'q_turn').alias('Datetime'),
                               F.min('salt').alias('lo'), F.max('salt').alias('hi'), *held)
    sets = ', '.join(f'coalesce(salts{w}, 0L)' for w in range(words))
    # most conversations have one salt
    salts = F.expr(f'CASE WHEN lo = hi THEN array(lo) WHEN lo < hi THEN filter(sequence(0, {buckets - 1}), '
                   f's -> getbit(array({sets})[s div 64], s % 64) = 1) END')
    first_copy = F.col('pos') == 0
    qs = (q.filter(F.col('q_turn').isNotNull()).select('id', 'q_turn', 'Frage', 'Datetime', F.posexplode_outer(salts).alias('pos', 'salt'))
          .withColumn('pos', F.coalesce('pos', F.lit(0)))
          .select('id', 'q_turn', 'salt', F.when(first_copy, F.col('Frage')).alias('Frage'),
                  F.when(first_copy, F.col('Datetime')).alias('Datetime')))
    asst = m.filter(answer).select(F.col('id').alias('a_id'), F.col('turn').alias('a_turn'), F.col('text').alias('a_text'),
                                   salt.alias('a_salt'))
    on = (qs['id'] == asst['a_id']) & (qs['salt'] == asst['a_salt']) & (asst['a_turn'] > qs['q_turn'])
    pairs = qs.join(asst, on, 'left').groupBy('id').agg(
        F.any_value('Frage', True).alias('Frage'), F.any_value('Datetime', True).alias('Datetime'),
        F.min_by('a_text', 'a_turn').alias('a_text'))
    return pairs.select('id', 'Datetime', 'Frage', _answer_or_sentinel(F.col('a_text')).alias('Antwort'))


def fetch_answers(cut: DataFrame, messages: DataFrame, id_col: str = 'conv_id', turn_col: str = 'turn',
                  role_col: str = 'role', text_col: str = 'text') -> DataFrame:
    """`cut` with `Antwort` filled in and without `q_turn`.

    `cut` is a page of questions (`extract_qa_flat(..., answers=False)`, cut
    by a limit). It is found once and stored, at most as many rows as the
    limit; its ids and turns are broadcast to the assistant rows, so only
    those conversations' answers are shuffled, one per conversation and task.
    """
    cut = stored(cut, 'page')
    page = F.broadcast(cut.select(F.col('id').alias('_id'), F.col('q_turn').alias('_q')))
    asst = messages.filter(F.col(role_col) == 'assistant').select(
        F.col(id_col).alias('_a_id'), F.col(turn_col).alias('_a_turn'), F.col(text_col).alias('_a_text'))
    found = (asst.join(page, (F.col('_a_id') == F.col('_id')) & (F.col('_a_turn') > F.col('_q')))
             .groupBy('_a_id').agg(F.min_by('_a_text', '_a_turn').alias('_a_text')))
    out = cut.join(found, F.col('id') == F.col('_a_id'), 'left')
    return out.select(*[_answer_or_sentinel(F.col('_a_text')).alias(c) if c == 'Antwort' else F.col(f'`{c}`')
                        for c in cut.columns if c != 'q_turn'])


# --------------------------------------------------------------------------- JSON


def _decode(js: Column):
    """(messages, ok): ok is false where the original would have raised and
    fallen back to the regex - not JSON, not an object, `messages` present but
    null or holding a non-object."""
    doc = F.from_json(js, CHAT_SCHEMA)
    keys = F.json_object_keys(js)
    msgs = doc['messages']
    has_key = F.array_contains(keys, 'messages')
    ok = keys.isNotNull() & (~has_key | (msgs.isNotNull() & ~F.exists(msgs, lambda x: x.isNull())))
    return F.coalesce(msgs, F.array().cast(CHAT_SCHEMA['messages'].dataType)), ok


def _decode_mode(raw: Column, mode: str):
    """(messages, ok) for `mode`: 'compat' decodes the text after the
    `""` -> `"` rewrite only; 'robust' tries the text as it is first."""
    if mode not in ('compat', 'robust'):
        raise ValueError("mode must be 'compat' or 'robust'")
    msgs_r, ok_r = _decode(F.replace(raw, F.lit('""'), F.lit('"')))
    if mode == 'compat':
        return msgs_r, ok_r
    msgs_p, ok_p = _decode(raw)
    return F.when(ok_p, msgs_p).otherwise(msgs_r), ok_p | ok_r


_KEYS_SCHEMA = T.StructType([T.StructField('messages', T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def _null_parts(raw: Column) -> Column:
    """array<boolean>, per message: `parts` is there and null, where the
    original's loop fails (a missing key is an empty list). Decoded a second
    time as key maps, but only for rows that hold the spelling at all."""
    js = F.replace(raw, F.lit('""'), F.lit('"'))
    keyed = F.transform(F.from_json(js, _KEYS_SCHEMA)['messages'],
                        lambda m: F.map_contains_key(m, 'parts') & m['parts'].isNull())
    return F.when(js.rlike(r'"parts"\s*:\s*null'), keyed)


def _with_positions(df: DataFrame, mode: str = 'robust') -> DataFrame:
    """Adds `_cand` (role and first text part of each message), `_qi` (first
    question: a user message with non-empty text), `_ai` (first assistant
    message after it) and `_fi` (first assistant message) (B5, B6).

    In compat mode `_ok` turns false where the original's loop fails on its
    way to the answer: `parts` null, or a null before its first text part, in
    a user message up to the question or in the first assistant message after.

    Separate projections: each value is computed once per row and referenced
    by name, instead of the array expression being inlined into every use.
    """
    compat = mode == 'compat'
    if compat:
        df = df.select('*', _null_parts(F.col('_raw')).alias('_np'))

    def first_part(x):
        return F.get(F.filter(x['parts'], lambda p: p.isNull() | (p['type'] == 'text')), 0)

    def fails(x, i):
        return (F.coalesce(F.get(F.col('_np'), i), F.lit(False))
                | (F.exists(x['parts'], lambda p: p.isNull()) & first_part(x).isNull()))

    cand = F.transform(F.col('_msgs'), lambda x, i: F.struct(
        x['role'].alias('role'),
        F.get(F.filter(x['parts'], lambda p: p['type'] == 'text'), 0)['text'].alias('text'),
        (F.coalesce(fails(x, i), F.lit(False)) if compat else F.lit(False)).alias('fails')))
    staged = df.select('*', cand.alias('_cand'))
    c = F.col('_cand')
    staged = staged.select('*', F.array_min(F.transform(
        c, lambda m, i: F.when((m['role'] == 'user') & (F.length(m['text']) > 0), i))).alias('_qi'))
    ai = F.array_min(F.transform(c, lambda m, i: F.when((m['role'] == 'assistant') & (i > F.col('_qi')), i)))
    fi = F.array_min(F.transform(c, lambda m, i: F.when(m['role'] == 'assistant', i)))
    staged = staged.select('*', ai.alias('_ai'), fi.alias('_fi'))
    if not compat:
        return staged
    broken = F.exists(F.transform(F.col('_cand'), lambda m, i: m['fails'] & (
        ((m['role'] == 'user') & (i <= F.coalesce('_qi', F.size('_cand')))) | F.coalesce(i == F.col('_ai'), F.lit(False)))),
        lambda x: x)
    return staged.withColumn('_ok', F.col('_ok') & ~F.coalesce(broken, F.lit(False)))


def _text_at(i: str) -> Column:
    return F.get(F.col('_cand'), F.col(i))['text']


def _fallback(raw: Column, mode: str):
    """Regex fallback (B8, B9): question needs text-before-role. The answer is
    in compat mode the first text after the first assistant role, as in the
    original, which may be the next user's; in robust mode only the text of
    an assistant message itself (`ROBUST_ANSWER`)."""
    q = (F.when(raw.contains('""text""'),
                F.nullif(F.regexp_extract(raw, FALLBACK_QUESTION_DOUBLED, 1), F.lit('')))
         .when(raw.contains('"text"'),
               F.nullif(F.regexp_extract(raw, FALLBACK_QUESTION_PLAIN, 1), F.lit(''))))
    if mode == 'robust':
        plain = F.when(raw.contains('""text""'), F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(raw)
        return q, F.coalesce(*[F.nullif(F.regexp_extract(plain, ROBUST_ANSWER, g), F.lit('')) for g in (1, 2)])
    a = (F.when(raw.contains('""role"":""assistant""'),
                F.nullif(F.regexp_extract(raw, FALLBACK_ANSWER_DOUBLED, 1), F.lit('')))
         .when(raw.contains('"role":"assistant"'),
               F.nullif(F.regexp_extract(raw, FALLBACK_ANSWER_PLAIN, 1), F.lit(''))))
    return q, a


def extract_qa_json(rows: DataFrame, raw_col: str = 'Raw Chat Data', id_col: str = 'id',
                    datetime_col: str = 'Datetime', mode: str = 'compat',
                    keep_rejects: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Question/answer from chat JSON, one row in, at most one row out.

    mode='compat' decodes the text after replacing every `""` by `"`, exactly
    as the original (so valid JSON holding `""` goes to the regex path);
    mode='robust' first tries the text as it is, then the replaced text, then
    the regex. With `keep_rejects` the rows without a question are kept with
    NULL `Frage` and a `path` of 'none'. `keep` names input columns to carry
    through unchanged.
    """
    raw = F.col(raw_col)
    kept = [F.col(f'`{c}`') for c in keep]
    msgs, ok = _decode_mode(raw, mode)
    staged = _with_positions(rows.select(F.col(id_col).alias('id'), F.col(datetime_col).alias('Datetime'),
                                         *kept, raw.alias('_raw'), msgs.alias('_msgs'),
                                         ok.alias('_ok')), mode)
    jq, ja = _text_at('_qi'), _text_at('_ai')
    rq, ra = _fallback(F.col('_raw'), mode)
    staged = staged.select(
        'id', 'Datetime', *kept,
        F.when(F.col('_ok'), jq).otherwise(rq).alias('Frage'),
        F.when(F.col('_ok'), ja).otherwise(ra).alias('_a'),
        F.when(F.col('_ok'), F.lit('json')).otherwise(F.lit('regex')).alias('path'))
    has_q = F.length('Frage') > 0
    out = staged.select('id', 'Datetime', *kept, F.when(has_q, F.col('Frage')).alias('Frage'),
                        _answer_or_sentinel(F.col('_a')).alias('Antwort'),
                        F.when(has_q, F.col('path')).otherwise(F.lit('none')).alias('path'))
    if keep_rejects:
        return out
    return out.filter(F.col('Frage').isNotNull()).drop('path')


# --------------------------------------------------------------------------- segments

# Order key of a message in a segmented conversation: segment * 2^31 + index
# in the segment (an array index is below 2^31), exact in decimal for any
# bigint segment number.
_SEGMENT_SHIFT = 2 ** 31


def _segment_candidates(rq: Column, ra: Column) -> Column:
    """array<struct<pos, role, text>> of the messages that can matter outside
    the segment: its first question, the first assistant message after it and
    its first assistant message overall (JSON path, over `_with_positions`),
    or the regex question and answer at positions 0 and 1 (fallback path)."""
    def at(i, role):
        return F.struct(F.col(i).alias('pos'), F.lit(role).alias('role'), _text_at(i).alias('text'))

    def lit_at(pos, role, text):
        return F.struct(pos.cast('int').alias('pos'), F.lit(role).alias('role'), text.alias('text'))

    from_json = F.array(at('_qi', 'user'), at('_ai', 'assistant'), at('_fi', 'assistant'))
    from_regex = F.array(lit_at(F.lit(0), 'user', rq),
                         lit_at(F.when(ra.isNotNull(), F.lit(1)), 'assistant', ra))
    return F.filter(F.when(F.col('_ok'), from_json).otherwise(from_regex), lambda c: c['pos'].isNotNull())


def extract_qa_segments(rows: DataFrame, raw_col: str = 'Raw Chat Data', id_col: str = 'id',
                        segment_col: str = 'segment', datetime_col: str = 'Datetime',
                        mode: str = 'compat', salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Question/answer from a conversation cut into JSON segments.

    Each row holds one segment (`segment_col` orders the segments of a
    conversation) with the same JSON shape as a whole export row. A segment is
    reduced row-locally to at most three candidate messages; the flat plan
    (`extract_qa_flat`) then picks the first question over all segments and
    the first assistant message after it. That is exact: the first assistant
    after the question is either in the question's own segment, after it, or
    the first assistant of a later segment, and both are candidates.

    With one segment per conversation the result equals `extract_qa_json`,
    the regex fallback included. With several, the fallback applies to each
    segment whose JSON does not decode, its question at the segment's start.
    `Datetime` comes from the question's segment.

    Both inputs of the merge need the candidates (at most three per segment),
    so they are persisted when the result is first asked for: the rows are
    scanned and decoded once, and a lost executor's share is decoded again.
    `spark.catalog.clearCache()` lets go of them.
    """
    msgs, ok = _decode_mode(F.col(raw_col), mode)
    staged = _with_positions(rows.select(
        F.col(id_col).alias('id'), F.col(segment_col).alias('_seg'), F.col(datetime_col).alias('Datetime'),
        F.col(raw_col).alias('_raw'), msgs.alias('_msgs'), ok.alias('_ok')), mode)
    rq, ra = _fallback(F.col('_raw'), mode)
    cands = staged.select('id', '_seg', 'Datetime', F.inline(_segment_candidates(rq, ra)))
    key = (F.col('_seg').cast('decimal(20,0)') * F.lit(_SEGMENT_SHIFT).cast('decimal(11,0)')
           + F.col('pos')).cast('decimal(38,0)')
    # both inputs of the merge read the candidates, decoded once
    flat = cands.select('id', key.alias('turn'), 'role', 'text', 'Datetime').persist(StorageLevel.MEMORY_AND_DISK)
    return extract_qa_flat(flat, id_col='id', created_col='Datetime', salt_buckets=salt_buckets,
                           span=SALT_SPAN * _SEGMENT_SHIFT)
