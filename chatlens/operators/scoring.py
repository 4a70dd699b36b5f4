"""Batch scoring with a caller-supplied model.

The original asks a chat model, one message at a time, for a JSON verdict and
falls back to the rules on any failure. Here the call runs inside
`mapInPandas`: Spark partitions the messages, each task builds the scorer once
and walks its Arrow batches; only the network call itself is per message. The
reply is parsed back in Spark columns, and failures take the rule-based result.

Scores should be kept (`checkpoint=True`, the default) so that a later action
or a re-run task does not call the model again.
"""

from __future__ import annotations

import sys
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as D
from ..functions.classify import category_from_hits, sentiment_from_hits
from ..functions.matcher import list_hits
from ..session import materialize, stored

# The first flat {...} in the reply is the verdict.
VERDICT = r'\{[^{}]*\}'
VERDICT_SCHEMA = 'kategorie string, sentiment string, _bad string'
STRICT_JSON = {'allowSingleQuotes': 'false', 'columnNameOfCorruptRecord': '_bad'}


# The per-partition code below travels to the Python workers by value, so the
# workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RateLimitError(Exception):
    """Raised by a scorer when the model refuses for rate reasons (HTTP 429)."""


def is_rate_limit(err: BaseException) -> bool:
    text = str(err)
    return isinstance(err, RateLimitError) or '429' in text or 'rate limit' in text.lower()


def call_with_retry(scorer, prompt, text, role, max_retries: int = 3, sleep=time.sleep):
    """(reply, error). Rate limits are retried after 1 s, 2 s, ...; the last
    attempt and every other error give up at once (I4)."""
    for attempt in range(max_retries):
        try:
            return scorer(prompt, text, role), None
        except Exception as e:  # noqa: BLE001 - any failure falls back to rules
            if is_rate_limit(e) and attempt < max_retries - 1:
                if sleep is not None:
                    sleep(2 ** attempt)
                continue
            return None, f'{type(e).__name__}: {e}'
    return None, 'no attempt'


def _score_batches(batches, make_scorer, max_retries, sleep):
    scorer = make_scorer()
    for pdf in batches:
        out = [call_with_retry(scorer, p, t, r, max_retries, sleep)
               for p, t, r in zip(pdf['_prompt'], pdf['_text'], pdf['_role'])]
        pdf = pdf.drop(columns=['_prompt'])
        pdf['reply'] = [o[0] for o in out]
        pdf['error'] = [o[1] for o in out]
        yield pdf


def _constant(scorer):
    return lambda: scorer


def score_messages(df: DataFrame, scorer=None, scorer_factory=None, text_col: str = 'text',
                   role_col: str = 'role', keep: tuple[str, ...] = (), max_retries: int = 3,
                   sleep=time.sleep, partitions: int | None = None, checkpoint: bool = True,
                   dicts: D.Dictionaries = D.DEFAULT, matcher: str = 'aho') -> DataFrame:
    """(*keep, frage, rolle, kategorie, sentiment, quelle) per message.

    `scorer(prompt, text, role) -> reply text` is called per message;
    `scorer_factory() -> scorer` instead builds one per task (for clients that
    should not be pickled). `partitions` hash-repartitions on `keep` first,
    which caps how many tasks call the model at once. `quelle` is 'modell' or
    'regel' (fallback).
    """
    if (scorer is None) == (scorer_factory is None):
        raise ValueError('pass exactly one of scorer / scorer_factory')
    make = scorer_factory or _constant(scorer)
    staged = df.select(*keep, F.col(text_col).alias('_text'), F.col(role_col).alias('_role'),
                       F.format_string(D.PROMPT_TEMPLATE, F.coalesce(text_col, F.lit('')),
                                       F.coalesce(role_col, F.lit(''))).alias('_prompt'))
    if partitions:
        staged = staged.repartition(partitions, *keep) if keep else staged.repartition(partitions)
    schema = T.StructType([f for f in staged.schema.fields if f.name != '_prompt'] + [
        T.StructField('reply', T.StringType()), T.StructField('error', T.StringType())])
    scored = staged.mapInPandas(lambda it: _score_batches(it, make, max_retries, sleep), schema)
    if checkpoint:
        scored = materialize(scored)
    return parse_verdicts(scored, keep, dicts, matcher)


def _retry_alone(score, rows, max_retries: int, sleep):
    """[(reply, error)] for (text, role, prompt) rows, called together. Rows
    that the model refuses for rate reasons are tried again, without the
    others; any other failure of a row is final. A call that fails as a whole
    fails each of its rows in that way."""
    out: list = [(None, 'no attempt')] * len(rows)
    left = list(range(len(rows)))
    for attempt in range(max_retries):
        try:
            replies = list(score(*(list(c) for c in zip(*(rows[i] for i in left)))))
            if len(replies) != len(left):
                raise ValueError(f'{len(replies)} replies to {len(left)} messages')
        except Exception as e:  # noqa: BLE001 - any failure falls back to rules
            replies = [e] * len(left)
        again = []
        for i, r in zip(left, replies):
            if isinstance(r, BaseException):
                out[i] = None, f'{type(r).__name__}: {r}'
                again += [i] if is_rate_limit(r) else []
            else:
                out[i] = r, None
        left = again
        if not left or attempt == max_retries - 1:
            break
        if sleep is not None:
            sleep(2 ** attempt)
    return out


def _score_in_batches(batches, make, size, max_retries, sleep):
    score = make()
    for pdf in batches:
        rows = list(zip(pdf['_text'], pdf['_role'], pdf['_prompt']))
        out = []
        for i in range(0, len(rows), size):
            out += _retry_alone(score, rows[i:i + size], max_retries, sleep)
        pdf = pdf[['_key']].copy()
        pdf['reply'] = [o[0] for o in out]
        pdf['error'] = [o[1] for o in out]
        yield pdf


def message_key(text: str, role: str) -> Column:
    """Identity of what the model is asked: text and role, NULL as empty."""
    t, r = (F.coalesce(F.col(c), F.lit('')) for c in (text, role))
    return F.md5(F.concat(F.char_length(r).cast('string'), F.lit(':'), r, t).cast('binary'))


def score_with_store(df: DataFrame, score_factory, store: str, text_col: str = 'text', role_col: str = 'role',
                     keep: tuple[str, ...] = (), batch_size: int = 32, max_retries: int = 3, sleep=time.sleep,
                     partitions: int | None = None, dicts: D.Dictionaries = D.DEFAULT, matcher: str = 'aho') -> DataFrame:
    """As `score_messages`, with the messages in batches and the replies kept.

    `score_factory()` builds, once per task, a callable
    `score(texts, roles, prompts) -> replies`: a reply text, or an exception in
    its place, for each message. Only distinct messages (text and role) that
    the table `store` has no reply to are sent, at most `batch_size` at a
    time; a refusal for rate reasons is retried for the refused messages
    alone. Replies are added to `store` by this call, failures are not, so the
    next call with the same store asks for those only, and a call whose
    messages are all known asks for nothing. NULL and empty texts are answered
    by the rules.
    """
    spark = df.sparkSession
    kept_schema = '_key string, reply string, error string'
    spark.createDataFrame([], kept_schema).write.mode('ignore').parquet(f'{store}/run=0')
    staged = df.select(*keep, F.col(text_col).alias('_text'), F.col(role_col).alias('_role'),
                       message_key(text_col, role_col).alias('_key'))
    known = spark.read.schema(kept_schema).parquet(store).select('_key', 'reply', 'error')
    open_ = (staged.filter(F.length('_text') > 0).dropDuplicates(['_key']).join(known, '_key', 'left_anti')
             .select('_key', '_text', '_role', F.format_string(
                 D.PROMPT_TEMPLATE, '_text', F.coalesce('_role', F.lit(''))).alias('_prompt')))
    if partitions:
        open_ = open_.repartition(partitions, '_key')
    run = uuid.uuid4().hex
    asked = stored(open_.mapInPandas(
        lambda it: _score_in_batches(it, score_factory, batch_size, max_retries, sleep), kept_schema), 'replies')
    asked.filter('error IS NULL AND reply IS NOT NULL').write.parquet(f'{store}/run={run}')
    replies = (spark.read.schema(kept_schema).parquet(store).select('_key', 'reply', 'error').dropDuplicates(['_key'])
               .unionByName(asked.filter('error IS NOT NULL OR reply IS NULL')))
    scored = staged.join(replies, '_key', 'left').drop('_key')
    return parse_verdicts(scored, keep, dicts, matcher)


def parse_verdicts(scored: DataFrame, keep=(), dicts: D.Dictionaries = D.DEFAULT,
                   matcher: str = 'aho') -> DataFrame:
    """Reply -> labels (I5, I6), in Spark columns.

    No {...} in the reply -> other/neutral; a {...} that is not strict JSON, a
    missing reply or an error -> rule-based result; a missing key -> its
    default. Labels are taken as given.
    """
    reply = F.col('reply')
    found = F.regexp_extract(reply, VERDICT, 0)
    obj = F.from_json(found, VERDICT_SCHEMA, STRICT_JSON)
    no_verdict = reply.isNotNull() & (found == '')
    model_ok = F.col('error').isNull() & reply.isNotNull() & (
        no_verdict | (obj['_bad'].isNull() & F.json_object_keys(found).isNotNull()))
    kat_model = F.when(no_verdict, D.CATEGORY_OTHER).otherwise(F.coalesce(obj['kategorie'], F.lit(D.CATEGORY_OTHER)))
    sen_model = F.when(no_verdict, D.SENTIMENT_NEUTRAL).otherwise(
        F.coalesce(obj['sentiment'], F.lit(D.SENTIMENT_NEUTRAL)))
    staged = scored.select(*keep, '_text', '_role', F.lower('_text').alias('_low'), model_ok.alias('_ok'),
                           kat_model.alias('_km'), sen_model.alias('_sm'))
    lists = (dicts.food, dicts.aggressive, dicts.positive, dicts.negative)
    staged = staged.select('*', list_hits('_low', lists, matcher).alias('_h'))
    staged = staged.select('*', category_from_hits('_text', '_low', F.col('_h')[0], F.col('_h')[1]).alias('_kr'))
    return staged.select(
        *keep, F.coalesce(F.col('_text'), F.lit('')).alias('frage'), F.col('_role').alias('rolle'),
        F.when(F.col('_ok'), F.col('_km')).otherwise(F.col('_kr')).alias('kategorie'),
        F.when(F.col('_ok'), F.col('_sm')).otherwise(
            sentiment_from_hits('_text', F.col('_h')[2], F.col('_h')[3], '_kr')).alias('sentiment'),
        F.when(F.col('_ok'), F.lit('modell')).otherwise(F.lit('regel')).alias('quelle'))


def fixture_scorer(prompt, text, role):
    """Stand-in model for tests and the oracle check: the reply depends only
    on the message length, and covers every reply kind the parser handles."""
    k = len(text or '') % 6
    if k == 0:
        return '{"kategorie": "neutral", "sentiment": "positiv"}'
    if k == 1:
        return 'Ergebnis: {"kategorie": "essen/fleisch"} fertig'
    if k == 2:
        return 'Keine Einordnung möglich.'
    if k == 3:
        raise RateLimitError('429 Too Many Requests')
    if k == 4:
        return '{bad}'
    raise RuntimeError('connection reset')


class FixtureBatchScorer:
    """Stand-in batch model: reads message and sender out of the prompt, and
    replies by the message's length, one kind of reply or failure for each
    remainder. Messages of remainder 3 are refused once and then answered."""

    def __init__(self):
        self.refused = set()

    def _one(self, prompt):
        text = prompt.split('<<', 1)[1].rsplit('>>', 1)[0]
        role = prompt.split('Absender: ', 1)[1].split('\n', 1)[0]
        k = len(text) % 6
        if k == 0:
            return f'{{"kategorie": "neutral", "sentiment": "{"positiv" if role == "user" else "negativ"}"}}'
        if k == 1:
            return 'Ergebnis: {"kategorie": "essen/fleisch"} fertig'
        if k == 2:
            return 'Keine Einordnung möglich.'
        if k == 3 and prompt not in self.refused:
            self.refused.add(prompt)
            return RateLimitError('429 Too Many Requests')
        if k == 3:
            return '{"kategorie": "aggressiv", "sentiment": "positiv"}'
        return '{bad}' if k == 4 else RuntimeError('connection reset')

    def __call__(self, texts, roles, prompts):
        return [self._one(p) for p in prompts]
