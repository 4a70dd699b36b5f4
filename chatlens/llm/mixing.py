"""Mixing sources to target weights by repetition rates.

Sizes (words) are summed per source, a target is derived for each source, and
a document is emitted `floor(rate)` times plus once more with probability
`rate - floor(rate)`, where rate = target / source size. The draw is a hash of
the document's id, its text and a seed, so reruns and recomputed partitions
agree, and a source whose ids are all null or equal still meets its target.

Targets: the sources in code point order (null last) weigh `weights` in turn
and share `budget` times all words; a target stops at `cap` times its
source's size, and the excess is shared again by weight until none is above.
That is a water level: with sources ordered by cap / weight, the first ones
stop at their caps and the others get `level * weight`.

Edge cases: a null text has size 0; a null source is a source of its own; a
source without words has target 0 and its documents are not emitted beyond
their rate of 0; rows equal in id and text draw alike, so identical rows stay
identical; an empty table gives no rows; further columns pass through `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, scratch_table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEED = 'mix-1'


def word_count(text):
    """Number of words, by the borders between words and white space."""
    pieces = F.split(F.concat(F.lit(' '), F.coalesce(text, F.lit('')), F.lit(' ')), f'{SPACE}+', -1)
    return (F.size(pieces) - 2).cast('long')


def source_rates(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); one row per
    source, so the unpartitioned windows hold the list of sources."""
    by_name = Window.orderBy(F.col('source').asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy('ratio', F.col('source').asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    since = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sizes.groupBy('source').agg(F.sum('size').alias('source_size'))
    s = s.withColumn('turn', (F.row_number().over(by_name) - 1) % len(weights))
    s = s.withColumn('weight', F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col('turn') + 1))
    s = s.withColumn('ratio', cap * F.col('source_size') / F.col('weight'))
    s = s.withColumn('left_over', budget * F.sum('source_size').over(everything)
                     - cap * F.coalesce(F.sum('source_size').over(before), F.lit(0)))
    # the level if this source and all after it stay below their caps
    s = s.withColumn('level', F.col('left_over') / F.sum('weight').over(since))
    s = s.withColumn('below', F.col('level') < F.col('ratio'))
    s = s.withColumn('water', F.min(F.when(F.col('below'), F.struct(
        'ratio', F.col('source').isNull().alias('none'), 'source', 'level'))).over(everything))
    target = F.when(F.col('water').isNull() | (F.col('ratio') <= F.col('water.level')),
                    (cap * F.col('source_size')).cast('double')).otherwise(F.col('water.level') * F.col('weight'))
    s = s.withColumn('target', target)
    rate = F.when(F.col('source_size') > 0, F.col('target') / F.col('source_size')).otherwise(F.lit(0.0))
    return s.select('source', 'source_size', 'target', rate.alias('rate'))


def draw(doc_id, text_hash, seed: str = SEED):
    """Uniform in [0, 1) from 52 bits of a hash of id and text."""
    digest = F.md5(F.concat(F.lit(seed + ':'), F.coalesce(doc_id.cast('string'), F.lit('null')), F.lit(':'),
                            text_hash.cast('string')))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast('double') / float(1 << 52)


def copies(rate, u):
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast('int')).cast('int')


def _stored_rates(sizes: DataFrame, weights, budget: float, cap: int) -> DataFrame:
    """`source_rates`, stored: a row per source, whose size the joins know
    before they move any document."""
    return scratch_table(source_rates(sizes, weights, budget, cap).withColumnRenamed('source', 'of'), 'mix-rates')


def mixed_sizes(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP,
                seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) per document."""
    sizes = docs.select('doc_id', 'source', word_count(F.col('text')).alias('size'), F.xxhash64('text').alias('hash'))
    rates = _stored_rates(sizes, weights, budget, cap)
    return (sizes.join(rates, F.col('source').eqNullSafe(F.col('of')))
            .select('doc_id', 'source', 'size', 'source_size', 'target', 'rate',
                    copies(F.col('rate'), draw(F.col('doc_id'), F.col('hash'), seed)).alias('copies')))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP,
                    seed: str = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    sizes = docs.select('source', word_count(F.col('text')).alias('size'))
    rates = _stored_rates(sizes, weights, budget, cap).select('of', 'rate')
    rows = docs.select(F.struct('*').alias('row'), F.col('source').alias('from'), F.col('doc_id').alias('key'),
                       F.xxhash64('text').alias('hash'))
    n = copies(F.col('rate'), draw(F.col('key'), F.col('hash'), seed))
    taken = rows.join(rates, F.col('from').eqNullSafe(F.col('of'))).select('row', n.alias('n')).filter('n > 0')
    return taken.select('row', F.explode(F.sequence(F.lit(1), F.col('n'))).alias('copy')).select('row.*')
