"""PII by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base findings (email, ip, card, phone) are patterns with checks. Around them,
candidate spans (also digit groups and written-out addresses that the
patterns miss) are voted on by regex, gazetteer and context labelers, each
+1, -1 or silent. Expectation-maximisation over the vote patterns estimates
every labeler's reliability and a posterior per pattern, without any label.
The posteriors then train a logistic span classifier on span features (shape,
number of digits, cue words, surroundings, check), and candidates it puts
above `ACCEPT` become findings of kind `other`. Base findings always stay.

All work is DataFrame operations on whole texts. Positions come from the
pieces between matches, so one split gives all of a text's spans. Vote and
feature patterns are combinations of a few small values, at most `3**5 * 54`
rows whatever the corpus; only these counts reach the driver.

Patterns start at the previous match's end or at a run's first character and
do not give characters back, which finds the same matches in linear time.
Places are running sums and overlaps running maxima over the sorted spans, so
the work on a text's n spans grows as n log n.

Edge cases: a null or empty text has no findings; repeated rows and equal ids
are reported row by row; an empty table gives no rows; other columns are not
read. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, scratch_table

KINDS = ('email', 'ip', 'card', 'phone')
#: The base patterns, leftmost and non-overlapping.
EMAIL = (r'(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++')
IP = r'(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++'
CARD = r'[0-9](?:[\x20-]?+[0-9])++'
PHONE = r'\+[0-9][\x20().0-9-]+[0-9]'
OCTETS = r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$'
#: Candidates beyond the base patterns: written-out addresses, digit groups.
LOOSE = (r'(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+'
         r'(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}+){1,4}+)'
         r'|(?:(?<![\p{L}\p{N}_+])[A-Z]{2}|(?<![0-9+]))\(?[0-9]{2,5}\)?(?:[\x20./-]\(?[0-9]{2,6}\)?){2,5}+(?![0-9])')
#: Cue words in front of personal data, and in front of other numbers.
CUES = (r'(?iu)\b(?:e-?mail|mail|correo|courriel|tel|phone|call|fax|mobile|telefon|teléfono|téléphone|contact|kontakt|'
        r'ssn|passport|iban|account|konto|cuenta|compte|card|visa|karte|tarjeta|carte)\W{0,4}$')
DECOYS = (r'(?iu)\b(?:version|v|release|isbn|issn|doi|page|seite|página|fig|table|chapter|section|no|nr|item|sku|'
          r'order|licen[sc]e|rfc|iso)\W{0,3}$')
WINDOW = 32
#: Binary logarithm of the length of the blocks that surroundings are read from.
BLOCK_BITS = 10
ACCEPT = 0.95
EM_ROUNDS = 25
#: Right and wrong votes that every labeler starts with.
BELIEF = (49.0, 1.0)
RIDGE = 0.01
LABELERS = ('regex', 'cue', 'decoy', 'border', 'variety')


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """(start, end, match) of every match, in order; `guard` skips texts that
    cannot have one."""
    pieces = let(F.split(text, pattern, -1), lambda x: F.transform(x, lambda y: F.char_length(y)))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(pieces, lambda gap: F.transform(
        m, lambda y, i: F.struct(y.alias('m'), F.char_length(y).alias('n'), F.get(gap, i).alias('gap')))))
    none = F.array().cast('array<struct<start:int,end:int,m:string>>')
    # the end of a match is the sum of all gaps and matches up to it
    return F.when(guard, let(found, lambda all: let(
        running(F.transform(all, lambda y: F.coalesce(y['gap'], F.lit(0)) + y['n']), lambda x, y: x + y),
        lambda ends: F.transform(all, lambda y, i: F.struct(
            (F.get(ends, i) - y['n']).alias('start'), F.get(ends, i).alias('end'), y['m'].alias('m')))))).otherwise(none)


def running(values: Column, join) -> Column:
    """Each element joined with all in front of it. Array functions have no
    running sum; carrying a growing array from element to element would copy it
    for each of them, so the reach is doubled instead: about log2(n) passes."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast('int')),
                        lambda k: F.pow(F.lit(2), k).cast('int'))
    return F.aggregate(reach, values, lambda acc, far: F.transform(
        acc, lambda x, i: F.when(i < far, x).otherwise(join(x, F.get(acc, i - far)))))


def marked(spans: Column, others: Column) -> Column:
    """(s, met) for each of the spans: whether one of the others overlaps it.
    In the order of places, a span's end looks back at the others that began
    in front of it: the furthest of their ends tells."""
    places = F.sort_array(F.concat(
        F.transform(spans, lambda s, i: F.struct(s['end'].alias('place'), F.lit(0).alias('other'), i.alias('at'),
                                                 s['start'].alias('start'), F.lit(-1).alias('reach'))),
        F.transform(others, lambda o: F.struct(o['start'].alias('place'), F.lit(1).alias('other'), F.lit(-1).alias('at'),
                                               F.lit(-1).alias('start'), o['end'].alias('reach')))))
    found = let(places, lambda p: let(running(F.transform(p, lambda x: x['reach']), F.greatest), lambda r: F.filter(
        F.transform(p, lambda x, i: F.struct(x['at'].alias('at'), (F.get(r, i) > x['start']).alias('met'))),
        lambda x: x['at'] >= 0)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(found, lambda x: F.struct(
        F.get(spans, x['at']).alias('s'), x['met'].alias('met')))).otherwise(
            F.transform(spans, lambda s: F.struct(s.alias('s'), F.lit(False).alias('met'))))


def outermost(free: Column, failed: Column) -> Column:
    """The spans that lie in no other one; of equal ones the free span stands,
    then the kind that is first by name. Whatever holds a span comes in front
    of it by (start, -end)."""
    def keyed(spans, late):
        return F.transform(spans, lambda s: F.struct(
            s['start'].alias('start'), (-s['end']).alias('back'), F.lit(late).alias('late'), s['kind'].alias('kind'),
            s['end'].alias('end'), s['m'].alias('m'), s['valid'].alias('valid')))

    every = F.sort_array(F.concat(keyed(free, 0), keyed(failed, 1)))
    return F.when(F.size(free) + F.size(failed) > 0, let(every, lambda p: let(
        running(F.transform(p, lambda x: x['end']), F.greatest),
        lambda r: F.filter(p, lambda x, i: F.coalesce(F.get(r, i - 1), F.lit(-1)) < x['end'])))).otherwise(every)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, '[^0-9]', '')


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    return {'email': F.lit(True), 'ip': m.rlike(OCTETS), 'card': n.between(13, 19) & F.call_function('luhn_check', _digits(m)),
            'phone': n.between(9, 15)}[kind]


def found_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, cand): base findings by kind and start; candidates
    (kind, start, end, m, valid, left, right) for the labelers."""
    t = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('t'))
    has = {'email': F.col('t').contains('@'), 'ip': F.col('t').rlike(r'[0-9]\.[0-9]++\.[0-9]'),
           'card': F.col('t').rlike(r'(?:[0-9][\x20-]?){13}'), 'phone': F.col('t').rlike(r'\+[0-9]'),
           'loose': F.col('t').rlike(r'[(\[]at[)\]]|[0-9]{2,5}\)?[\x20./-]\(?[0-9]{2}')}
    t = t.select('doc_id', 't', *[matches(F.col('t'), p, has[k]).alias(k) for k, p in (
        ('email', EMAIL), ('ip', IP), ('card', CARD), ('phone', PHONE), ('loose', LOOSE))])

    def tagged(kind, spans):
        return F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias('kind'), s['start'].alias('start'), s['end'].alias('end'), s['m'].alias('m'),
            (_valid(kind, s['m']) if kind in KINDS else F.lit(False)).alias('valid')))

    every = F.concat(*[tagged(k, F.col(k)) for k in KINDS])
    t = t.select('doc_id', 't', every.alias('every'), tagged('loose', F.col('loose')).alias('loose'))
    t = t.select('doc_id', 't', 'loose', F.filter('every', lambda s: s['valid']).alias('base'),
                 # short digit runs are no candidates for a card
                 F.filter('every', lambda s: s['valid'] | (s['kind'] != 'card')
                          | (F.char_length(_digits(s['m'])) >= 12)).alias('seen'))
    free = F.transform(F.filter(marked(F.col('loose'), F.col('base')), lambda x: ~x['met']), lambda x: x['s'])
    t = t.select('doc_id', 't', 'base', F.filter('seen', lambda s: ~s['valid']).alias('failed'), free.alias('free'))
    # a failed check speaks for its kind only, not against the digit group that it lies on
    failed = F.transform(marked(F.col('failed'), F.col('free')), lambda x: x['s'].withField(
        'kind', F.when(x['met'], 'loose').otherwise(x['s']['kind'])))
    t = t.select('doc_id', 't', 'base', 'free', failed.alias('failed'))
    # of two spans one inside the other the longer stands
    longest = F.transform(outermost(F.col('free'), F.col('failed')), lambda s: F.struct(
        *[s[f].alias(f) for f in ('kind', 'start', 'end', 'm', 'valid')]))
    t = t.select('doc_id', 't', 'base', F.concat('base', longest).alias('all'))
    # surroundings come from blocks of the text: a place in the whole text is found by counting from its start
    t = t.select('doc_id', 'base', 'all', F.when(F.size('all') > 0, F.regexp_extract_all(
        't', F.lit(f'(?s).{{1,{1 << BLOCK_BITS}}}'), F.lit(0))).alias('blocks'))

    def around(start, length):
        b = F.shiftright(start, BLOCK_BITS)
        two = F.concat(F.coalesce(F.get('blocks', b), F.lit('')), F.coalesce(F.get('blocks', b + 1), F.lit('')))
        return F.substring(two, start - F.shiftleft(b, BLOCK_BITS) + 1, length)

    cand = F.transform('all', lambda s: F.struct(
        s['kind'].alias('kind'), s['start'].alias('start'), s['end'].alias('end'), s['m'].alias('m'),
        s['valid'].alias('valid'),
        around(F.greatest(s['start'] - WINDOW, F.lit(0)), F.least(s['start'], F.lit(WINDOW))).alias('left'),
        around(s['end'], F.lit(1)).alias('right')))
    out = t.select('doc_id', F.transform('base', lambda s: F.struct(
        s['kind'].alias('kind'), s['start'].alias('start'), s['end'].alias('end'))).alias('base'), cand.alias('cand'))
    return scratch_table(out, 'pii-spans')


def votes(s: Column) -> list[Column]:
    """+1 personal data, -1 not, 0 silent, in the order of LABELERS."""
    digits = _digits(s['m'])
    distinct = F.size(F.array_distinct(F.split(digits, '')))
    inside = F.substring(s['left'], -1, 1).rlike(r'[\p{L}\p{N}_]') | s['right'].rlike(r'[\p{L}\p{N}_]')
    return [
        F.when(s['valid'], 1).when(s['kind'] == 'loose', 0).otherwise(-1),
        F.when(s['left'].rlike(CUES), 1).otherwise(0),
        F.when(s['left'].rlike(DECOYS), -1).otherwise(0),
        F.when(inside, -1).otherwise(0),
        F.when(digits == '', 0).when(distinct <= 2, -1).otherwise(0)]


def features(s: Column) -> list[Column]:
    """Small integers that the classifier sees: shape, digits, cue, decoy, border, check."""
    n = F.char_length(_digits(s['m']))
    shape = (F.when(s['m'].contains('@') | s['m'].rlike(r'[(\[]at[)\]]'), 0).when(s['m'].startswith('+'), 1)
             .when(s['m'].rlike(r'^[0-9]+$'), 2).when(s['m'].rlike(r'^[0-9.]+$'), 3).otherwise(4))
    v = votes(s)
    return [shape, F.when(n < 9, 0).when(n < 13, 1).otherwise(2), v[1], v[2], v[3] + v[4], v[0]]


def _patterns(spans: DataFrame) -> list:
    """Counts per vote and feature pattern: a bounded number of rows."""
    c = spans.select(F.explode('cand').alias('s'))
    v = [x.cast('int').alias(f'v{i}') for i, x in enumerate(votes(F.col('s')))]
    f = [x.cast('int').alias(f'f{i}') for i, x in enumerate(features(F.col('s')))]
    c = c.select(*v, *f)
    return c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias('n')).collect()


def expectation_maximisation(rows, rounds: int = EM_ROUNDS):
    """Posterior per vote pattern, the share of personal data, and per labeler
    the chance of its votes (-1, +1) on other and on personal spans, where it
    votes. Silence says nothing, so a cue that few checked spans have is not
    held against the others."""
    counts: dict[tuple, int] = {}
    for r in rows:
        key = tuple(r[f'v{i}'] for i in range(len(LABELERS)))
        counts[key] = counts.get(key, 0) + r['n']
    post = {k: 1 / (1 + math.exp(-2.0 * sum(k))) for k in counts}
    share, rate = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * post[k] for k, n in counts.items()) + 1) / (total + 2)
        rate, odds = [], []
        for i in range(len(LABELERS)):
            right, cast = BELIEF[0], sum(BELIEF)
            for k, n in counts.items():
                if k[i]:
                    right += n * (post[k] if k[i] > 0 else 1 - post[k])
                    cast += n
            # a labeler is never taken for the opposite of what it says
            a = min(max(right / cast, 0.5), 1 - 1e-6)
            rate.append(({-1: a, 1: 1 - a}, {-1: 1 - a, 1: a}))
            odds.append(math.log(a / (1 - a)))
        for k in counts:
            z = sum(v * x for v, x in zip(k, odds))
            post[k] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
    return post, share, rate


def train(rows, post, rounds: int = 50) -> tuple[float, list[dict[int, float]]]:
    """Logistic regression on the posteriors by Newton steps: the constant and
    the weight of each feature value. Spans that no labeler speaks on teach
    nothing."""
    n_features = sum(1 for c in (rows[0].asDict() if rows else {}) if c.startswith('f'))
    by: list[dict[int, float]] = [{} for _ in range(n_features)]
    heard = [r for r in rows if any(r[f'v{i}'] for i in range(len(LABELERS)))]
    names = sorted({(i, r[f'f{i}']) for r in heard for i in range(n_features)})
    if not names:
        return 0.0, by
    x = np.array([[1.0, *(float(r[f'f{i}'] == v) for i, v in names)] for r in heard])
    n = np.array([float(r['n']) for r in heard])
    p = np.array([post[tuple(r[f'v{i}'] for i in range(len(LABELERS)))] for r in heard])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - q)) - RIDGE * w
        step = np.linalg.solve((x.T * (n * q * (1 - q))) @ x + RIDGE * np.eye(len(w)), slope)
        w += step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    for (i, v), weight in zip(names, w[1:].tolist()):
        by[i][v] = weight
    return float(w[0]), by


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, spans) of every row: the base findings, and all findings,
    as (kind, start, end) by kind, then start."""
    spans = found_spans(docs)
    rows = _patterns(spans)
    post, _, _ = expectation_maximisation(rows)
    prior, weights = train(rows, post)

    def accepted(s):
        score = F.lit(prior)
        for f, w in zip(features(s), weights):
            chosen = F.lit(0.0)
            for value, x in w.items():
                chosen = F.when(f == value, F.lit(x)).otherwise(chosen)
            score = score + chosen
        return ~s['valid'] & (score >= math.log(accept / (1 - accept)))

    extra = F.transform(F.filter('cand', accepted), lambda s: F.struct(
        F.lit('other').alias('kind'), s['start'].alias('start'), s['end'].alias('end')))
    return spans.select('doc_id', 'base', F.concat('base', F.array_sort(extra)).alias('spans'))


def joined(spans) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ':', s['kind'], s['start'].cast('string'), s['end'].cast('string'))), ',')
