"""Quality rules: robust multivariate outliers per language and source.

Every text gets counts (words, characters, symbols, repeated lines, words in
repeated 5-word windows, capitals). Base rules reject very short and very
repetitive texts. The others' transformed counts form a vector, and for each
(language, source) a minimum-covariance-determinant estimate of its centre and
scatter is fitted: from a median/MAD start, concentration steps take the
mean and covariance of the `SHARE` of documents nearest to the last estimate,
which never raises the determinant, then one reweighting step uses all
documents within the 97.5 % ellipse. A document is rejected when its squared
Mahalanobis distance exceeds the `CUTOFF` quantile.

All work is DataFrame operations. Counts are computed row-locally; vectors are
kept as integers (1/1024), so sums and products are exact, reruns agree, and
one aggregation per step by (group, distance bin) gives both the distance
quantile and the moments below it. A source with a third of all rows is
aggregated before its rows meet. Sums of products fit 64 bits up to 3e10
documents per group.

`FLOORS` are the least standard deviations: they keep a statistic that is
constant in a group (no symbols at all) from rejecting the first document
that has any. Groups of fewer than `MIN_GROUP` documents share their
language's estimate, languages with fewer in such groups share one.

Edge cases: a null or empty text has no words and fails the base rules; null
language or source is a value of its own; identical rows get identical
verdicts; an empty table gives no rows; other columns are not read (and pass
through `kept_documents`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, scratch_table

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
RUN = 5
SYMBOLS = r'[#*$%&|<>]'
SHARE = 0.75
STEPS = 6
CUTOFF = 0.99999
MIN_GROUP = 50
SCALE = 1024
#: Least standard deviation of each statistic: log words, log mean word
#: length, symbols, repeated lines, repeated words, capitals (arcsine roots).
FLOORS = (1.0, 0.15, 0.05, 0.15, 0.1, 0.1)
P = len(FLOORS)
X = [f'x{j}' for j in range(P)]
PAIRS = [(j, k) for j in range(P) for k in range(j + 1)]


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function for an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_quantile(q: float, df: int = P) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < q else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """Factor from the covariance of the central share to the whole's."""
    return share / _chi2_cdf(_chi2_quantile(share), P + 2)


def _repeat_words(words: Column) -> Column:
    """Words in a window of RUN words that occurs twice or more in the text."""
    def windows(h):
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, RUN)])),
                       1, F.greatest(F.size(h) - (RUN - 1), F.lit(0)))

    def covered(keys):
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias('k'), i.alias('i'))))
        twice = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda p, i: (p['k'] == F.get(s, i - 1)['k']) | (p['k'] == F.get(s, i + 1)['k'])),
            lambda p: p['i'])))
        return let(twice, lambda at: F.aggregate(F.transform(
            at, lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get(at, i + 1) - p, F.lit(RUN)))),
            F.lit(0), lambda a, b: a + b))

    keys = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the counts of each whole text."""
    t = docs.select(*keep, F.coalesce('text', F.lit('')).alias('_t'))
    t = t.withColumn('_w', F.regexp_extract_all('_t', F.lit(WORD), F.lit(0)))
    lines = let(F.filter(F.split('_t', '\n', -1), lambda x: x.rlike(f'[^{SPACE[1:-1]}]')),
                lambda x: F.struct(F.size(x).alias('n'), F.size(F.array_distinct(x)).alias('d')))
    t = t.select(
        *keep, F.size('_w').cast('long').alias('n_words'),
        F.char_length(F.array_join('_w', '')).cast('long').alias('word_chars'),
        F.regexp_count('_t', F.lit(SYMBOLS)).cast('long').alias('n_symbols'),
        F.regexp_count('_t', F.lit(r'\p{Lu}')).cast('long').alias('n_capitals'),
        lines.alias('_l'), _repeat_words(F.col('_w')).cast('long').alias('n_repeat_words'))
    n = F.col('n_words')
    return t.select(
        *keep, 'n_words', 'word_chars', 'n_symbols', (F.col('_l.n') - F.col('_l.d')).cast('long').alias('n_dup_lines'),
        'n_repeat_words', 'n_capitals', F.col('_l.n').cast('long').alias('n_lines'),
        ((n < MIN_WORDS) | (100 * F.col('n_repeat_words') > MAX_REPEAT_PCT * n)).alias('base_failed'))


def _vector() -> list[Column]:
    def share(part, whole):
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))
    x = [F.log(F.col('n_words') + 1.0), F.log((F.col('word_chars') + 25.0) / (F.col('n_words') + 5.0)),
         share('n_symbols', 'word_chars'), share('n_dup_lines', 'n_lines'),
         share('n_repeat_words', 'n_words'), share('n_capitals', 'word_chars')]
    return [F.round(v * SCALE).cast('long') for v in x]


def _group(level: str) -> Column:
    part = {'source': F.to_json(F.struct('lang', 'source')), 'lang': F.to_json(F.struct('lang')), 'all': F.lit('')}
    return F.concat(F.lit(level + ':'), part[level])


def _groups(vectors: DataFrame) -> DataFrame:
    """(lang, source, g): the group whose estimate judges a language's source."""
    n = vectors.groupBy('lang', 'source').count()
    small = F.col('count') < MIN_GROUP
    in_lang = n.withColumn('rest', F.sum(F.when(small, F.col('count')).otherwise(0)).over(Window.partitionBy('lang')))
    level = (F.when(~small, _group('source')).when(F.col('rest') >= MIN_GROUP, _group('lang')).otherwise(_group('all')))
    return in_lang.select('lang', 'source', level.alias('g'))


def _cholesky(moments: DataFrame, factor: float) -> DataFrame:
    """(g, m_j, w_jk): centre and the inverse Cholesky factor of
    `factor * covariance + floors`, from n, s_j = sum x_j and q_jk = sum x_j x_k."""
    n = F.col('n').cast('double')

    def covariance(j, k):
        c = F.col(f'q{j}_{k}') / n - F.col(f's{j}') / n * (F.col(f's{k}') / n)
        return F.greatest(F.lit(0.0), c) * factor + (FLOORS[j] * SCALE) ** 2 if j == k else c * factor

    out = moments.select('g', *[(F.col(f's{j}') / n).alias(f'm{j}') for j in range(P)],
                         *[covariance(j, k).alias(f'c{j}_{k}') for j, k in PAIRS])

    def minus(value, a, b, over):
        for i in over:
            value = value - F.col(a.format(i)) * F.col(b.format(i))
        return value

    for k in range(P):  # the floors keep the diagonal positive
        rest = minus(F.col(f'c{k}_{k}'), f'l{k}_{{}}', f'l{k}_{{}}', range(k))
        out = out.withColumn(f'l{k}_{k}', F.sqrt(F.greatest(rest, F.lit(1e-9))))
        out = out.withColumns({f'l{j}_{k}': minus(F.col(f'c{j}_{k}'), f'l{j}_{{}}', f'l{k}_{{}}', range(k))
                               / F.col(f'l{k}_{k}') for j in range(k + 1, P)})
    out = out.withColumns({f'w{j}_{j}': 1 / F.col(f'l{j}_{j}') for j in range(P)})
    for off in range(1, P):
        out = out.withColumns({f'w{k + off}_{k}': minus(F.lit(0.0), f'l{k + off}_{{}}', f'w{{}}_{k}', range(k, k + off))
                               / F.col(f'l{k + off}_{k + off}') for k in range(P - off)})
    return out.select('g', *[f'm{j}' for j in range(P)], *[f'w{j}_{k}' for j, k in PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance of x to the joined estimate."""
    total = F.lit(0.0)
    for j in range(P):
        z = F.lit(0.0)
        for k in range(j + 1):
            z = z + F.col(f'w{j}_{k}') * (F.col(X[k]) - F.col(f'm{k}'))
        total = total + z * z
    return total


def _moment_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias('n'), *[F.sum(X[j]).alias(f's{j}') for j in range(P)],
            *[F.sum(F.col(X[j]) * F.col(X[k])).alias(f'q{j}_{k}') for j, k in PAIRS]]


def _moment_names() -> list[str]:
    return ['n', *[f's{j}' for j in range(P)], *[f'q{j}_{k}' for j, k in PAIRS]]


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and scaled median deviations as a diagonal first estimate, from
    the histogram of each statistic (its distinct values, in 1/64)."""
    long = vectors.select('g', F.posexplode(F.array(*[F.floor(F.col(x) / 16) for x in X])).alias('j', 'v'))
    hist = long.groupBy('g', 'j', 'v').agg(F.count(F.lit(1)).alias('n'))

    def middle(h, value):
        by = Window.partitionBy('g', 'j')
        upto = by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        half = h.select('g', 'j', F.col(value), F.sum('n').over(upto).alias('c'), F.sum('n').over(by).alias('t'))
        return half.filter('2 * c >= t').groupBy('g', 'j').agg(F.min(value).alias('mid'))

    med = middle(hist, 'v')
    dev = hist.join(med, ['g', 'j']).withColumn('d', F.abs(F.col('v') - F.col('mid')))
    dev = dev.groupBy('g', 'j', 'd').agg(F.sum('n').alias('n'))
    both = med.join(middle(dev, 'd').withColumnRenamed('mid', 'mad'), ['g', 'j'])
    at = both.groupBy('g').agg(*[F.max(F.when(F.col('j') == j, F.col(c))).alias(f'{c}{j}')
                                 for j in range(P) for c in ('mid', 'mad')])
    return at.select('g', *[(F.col(f'mid{j}') * 16 + 8.0).alias(f'm{j}') for j in range(P)], *[
        (1 / F.greatest(F.col(f'mad{j}') * (16 * 1.4826), F.lit(FLOORS[j] * SCALE)) if j == k
         else F.lit(0.0)).alias(f'w{j}_{k}') for j, k in PAIRS])


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, estimates) from the counts of all documents that pass the base
    rules: (lang, source, g) and (g, centre, inverse factor)."""
    vectors = stats.filter(~F.col('base_failed')).select(
        'lang', 'source', *[v.alias(x) for v, x in zip(_vector(), X)])
    groups = scratch_table(_groups(vectors), 'mcd-groups')
    same = [F.col('v.lang').eqNullSafe(F.col('g.lang')), F.col('v.source').eqNullSafe(F.col('g.source'))]
    vectors = scratch_table(vectors.alias('v').join(groups.alias('g'), same[0] & same[1]).select('g.g', *X),
                            'mcd-vectors')
    est = scratch_table(_start(vectors), 'mcd-start')
    names = _moment_names()
    for step in range(STEPS):
        # bins of the squared distance, 1/8 of a doubling each
        near = vectors.join(est, 'g').withColumn('bin', F.floor(F.log2(_distance() + 1e-6) * 8))
        bins = near.groupBy('g', 'bin').agg(*_moment_sums())
        by = Window.partitionBy('g')
        before = by.orderBy('bin').rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn('t', F.sum('n').over(by)).withColumn('b', F.coalesce(F.sum('n').over(before), F.lit(0)))
        inner = bins.filter(F.col('b') < F.ceil(F.col('t') * SHARE))
        est = scratch_table(_cholesky(inner.groupBy('g').agg(*[F.sum(c).alias(c) for c in names]),
                                      _consistency(SHARE)), f'mcd-step{step}')
    near = vectors.join(est, 'g').filter(_distance() <= _chi2_quantile(0.975))
    final = _cholesky(near.groupBy('g').agg(*_moment_sums()), _consistency(0.975))
    return groups, scratch_table(final, 'mcd-final')


def judge(stats: DataFrame, groups: DataFrame, estimates: DataFrame) -> DataFrame:
    """`stats` with `distance` (null where no estimate exists) and `kept`."""
    model = groups.join(estimates, 'g').select(
        F.col('lang').alias('_lang'), F.col('source').alias('_source'), *[c for c in estimates.columns if c != 'g'])
    at = stats.join(model, F.col('lang').eqNullSafe(F.col('_lang')) & F.col('source').eqNullSafe(F.col('_source')),
                    'left')
    at = at.withColumns(dict(zip(X, _vector()))).withColumn('distance', _distance())
    ok = ~F.col('base_failed') & F.coalesce(F.col('distance') <= _chi2_quantile(CUTOFF), F.lit(True))
    return at.select(*stats.columns, 'distance', ok.alias('kept'))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, distance and verdict of every document."""
    stats = scratch_table(statistics(docs, 'doc_id', 'lang', 'source'), 'quality-stats')
    return judge(stats, *fit(stats))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. The counts
    are computed again beside the rows, which spares a join of all texts."""
    fitted = fit(scratch_table(statistics(docs, 'lang', 'source'), 'quality-stats'))
    rows = docs.select(F.struct('*').alias('_row'), 'text', 'lang', 'source')
    return judge(statistics(rows, '_row', 'lang', 'source'), *fitted).filter('kept').select('_row.*')
