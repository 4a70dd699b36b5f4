"""Model scoring with stand-in scorers."""

import os

from chatlens import dictionaries as D
from chatlens.operators.scoring import RateLimitError, call_with_retry, score_messages


def test_retry_waits_one_then_two_seconds():
    waits, calls = [], []

    def limited(prompt, text, role):
        calls.append(1)
        raise RuntimeError('Error code: 429 - rate limit')

    assert call_with_retry(limited, 'p', 't', 'user', sleep=waits.append)[0] is None
    assert waits == [1, 2] and len(calls) == 3


def test_retry_then_success_and_other_error():
    state = {'n': 0}

    def flaky(prompt, text, role):
        state['n'] += 1
        if state['n'] < 3:
            raise RateLimitError('429')
        return 'ok'

    assert call_with_retry(flaky, 'p', 't', 'user', sleep=lambda s: None) == ('ok', None)

    def broken(prompt, text, role):
        raise ValueError('boom')

    reply, err = call_with_retry(broken, 'p', 't', 'user', sleep=None)
    assert reply is None and 'boom' in err


class Scripted:
    """Reply chosen by the message text; 'flaky' fails twice with 429 first."""

    def __init__(self):
        self.seen = {}

    def __call__(self, prompt, text, role):
        assert text in prompt and role in prompt
        n = self.seen[text] = self.seen.get(text, 0) + 1
        if text == 'ok':
            return 'Ergebnis {"kategorie": "neutral", "sentiment": "positiv"} Ende'
        if text == 'flaky':
            if n < 3:
                raise RateLimitError('429 Too Many Requests')
            return '{"kategorie": "aggressiv", "sentiment": "negativ"}'
        if text == 'nojson':
            return 'weiss nicht'
        if text == 'missing key':
            return '{"kategorie": "essen/fleisch"}'
        if text == 'bad json Mist':
            return '{kategorie: essen}'
        if text == 'always 429 Steak':
            raise RateLimitError('429')
        if text == 'error lecker':
            raise ConnectionError('reset')
        return None


def test_score_messages(spark):
    texts = ['ok', 'flaky', 'nojson', 'missing key', 'bad json Mist', 'always 429 Steak',
             'error lecker', 'none reply']
    df = spark.createDataFrame([(i, t, 'user') for i, t in enumerate(texts)],
                               'id long, text string, role string').coalesce(1)
    out = score_messages(df, scorer_factory=Scripted, keep=('id',), sleep=None)
    got = {r['frage']: (r['kategorie'], r['sentiment'], r['quelle']) for r in out.collect()}
    assert got == {
        'ok': ('neutral', 'positiv', 'modell'),
        'flaky': ('aggressiv', 'negativ', 'modell'),
        'nojson': (D.CATEGORY_OTHER, 'neutral', 'modell'),
        'missing key': ('essen/fleisch', 'neutral', 'modell'),
        'bad json Mist': ('aggressiv', 'negativ', 'regel'),
        'always 429 Steak': ('essen/fleisch', 'neutral', 'regel'),
        'error lecker': ('neutral', 'positiv', 'regel'),
        'none reply': ('neutral', 'neutral', 'regel'),
    }


def test_model_called_once_per_message(spark, tmp_path):
    """The scores are checkpointed: building, counting and collecting call
    the model once per message, not once per action."""
    log = os.path.join(tmp_path, 'calls.log')

    def scorer(prompt, text, role):
        with open(log, 'a') as f:
            f.write('x\n')
        return '{"kategorie": "neutral", "sentiment": "neutral"}'

    df = spark.createDataFrame([(i, f'text {i}', 'user') for i in range(120)],
                               'id long, text string, role string').repartition(4)
    out = score_messages(df, scorer=scorer, keep=('id',), sleep=None)
    assert out.count() == 120
    out.collect()
    with open(log) as f:
        assert sum(1 for _ in f) == 120


class Counting:
    """Batch scorer that notes each call in a folder (workers are processes)."""

    def __init__(self, folder, fail=()):
        self.folder, self.fail, self.tries = folder, fail, {}

    def __call__(self, texts, roles, prompts):
        import uuid
        with open(os.path.join(self.folder, uuid.uuid4().hex), 'w') as f:
            f.write('\n'.join(texts))
        out = []
        for t, p in zip(texts, prompts):
            assert f'<<{t}>>' in p
            n = self.tries[t] = self.tries.get(t, 0) + 1
            if t == 'langsam' and n < 3:
                out.append(RateLimitError('429'))
            elif t in self.fail:
                out.append(RuntimeError('kaputt'))
            else:
                out.append('{"kategorie": "neutral", "sentiment": "negativ"}')
        return out


def calls(folder):
    got = [open(os.path.join(folder, f)).read().split('\n') for f in os.listdir(folder)]
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    return sorted(map(tuple, got))


def test_store_asks_once_and_retries_alone(spark, tmp_path):
    """Repeated messages are asked once, refused ones again by themselves, a
    failed one in the next run only, and known ones never."""
    from chatlens.operators.scoring import score_with_store

    folder, store = str(tmp_path / 'calls'), str(tmp_path / 'store')
    os.makedirs(folder)
    rows = [(i, t, r) for i, (t, r) in enumerate([
        ('gut so', 'user'), ('gut so', 'user'), ('gut so', 'assistant'), ('langsam', 'user'), ('schlecht', 'user'),
        ('', 'user'), (None, 'user'), ('ohne Rolle', None)])]
    df = spark.createDataFrame(rows, 'i int, text string, role string').coalesce(1)

    def run(fail=()):
        out = score_with_store(df, lambda: Counting(folder, fail), store, keep=('i',), sleep=None, partitions=1)
        return {r.i: (r.frage, r.kategorie, r.sentiment, r.quelle) for r in out.collect()}

    model = ('neutral', 'negativ', 'modell')
    first = run(('schlecht',))
    assert first[0] == first[1] == ('gut so', *model) and first[2] == first[0] and first[3] == ('langsam', *model)
    assert first[4][::3] == ('schlecht', 'regel') and first[7] == ('ohne Rolle', *model)
    assert first[5] == ('', 'anderes', 'neutral', 'regel') == first[6]
    asked = calls(folder)
    assert sorted(len(c) for c in asked) == [1, 1, 5] and [c for c in asked if len(c) == 1] == [('langsam',)] * 2
    assert run()[4] == ('schlecht', *model) and calls(folder) == [('schlecht',)]
    assert run()[0] == first[0] and calls(folder) == []


def test_batches_are_bounded_and_a_failing_call_fails_its_rows():
    from chatlens.operators.scoring import _retry_alone

    rows = [(str(i), 'user', 'p') for i in range(3)]

    def broken(texts, roles, prompts):
        raise ValueError('boom')

    assert [e for _, e in _retry_alone(broken, rows, 3, None)] == ['ValueError: boom'] * 3
    assert [e for _, e in _retry_alone(lambda t, r, p: ['x'], rows, 3, None)] == ['ValueError: 1 replies to 3 messages'] * 3
    waits = []

    def limited(texts, roles, prompts):
        raise RateLimitError('429')

    assert all('429' in e for _, e in _retry_alone(limited, rows, 3, waits.append)) and waits == [1, 2]
