"""Quality classifier by importance resampling.

Two bag-of-n-gram models over hashed unigrams and bigrams are counted: the
target from documents labelled good, the raw one from all documents. A
document's log importance is the log ratio of its n-grams under the two
models; adding Gumbel noise from a hash of its id and taking the top k draws k
documents without replacement in proportion to their importance.

The importance is tempered: the mean log ratio per n-gram times
`TEMPERATURE`, so length does not decide, and shrunk by `PRIOR` n-grams. k is
the target share of the labelled documents times the number of documents, by
default. Raw counts cover all documents; the models are `BUCKETS`
numbers each, whatever the corpus. The target is fitted on at most
`MAX_LABELLED` good documents, the first by a hash of their id, so that their
ids can be broadcast and the texts need no shuffle.
Top k: the k-th largest key is found by histogram refinement, not by a sort
in one place; ties go to smaller ids by the noise, which is a function of the
id.

Edge cases: a null or empty text has no n-grams and log ratio 0; null ids draw
one common noise; identical rows have equal keys and stand or fall together at
the border (the sample may then exceed k by the ties); without labels the
target is the raw model and the sample uniform; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_table

BUCKETS = 1 << 16
TEMPERATURE = 60.0
PRIOR = 20.0
SMOOTH = 0.5
MAX_LABELLED = 100_000
SEED = 'dsir-1'
_TOKEN = re.compile(rb"[\x80-\xffa-z0-9]+|[^\x20\x09-\x0da-z0-9\x80-\xff]")


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a lower-cased text; words and
    punctuation marks are tokens."""
    words = _TOKEN.findall(text.lower().encode('utf-8', 'surrogatepass'))
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.int64)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((h * np.uint64(0x9E3779B97F4A7C15), two ^ (two >> np.uint64(31))))
    return ((both >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of those with
    `good`; a task sums up its documents first."""
    src = docs.select(F.coalesce('text', F.lit('')).alias('text'), F.coalesce('good', F.lit(False)).alias('good'))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ('bucket', 'raw', 'target')])

    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(ngram_buckets(text.as_py(), buckets), minlength=buckets)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=schema.fieldNames())

    part = src.mapInArrow(run, schema)
    return part.groupBy('bucket').agg(F.sum('raw').alias('raw'), F.sum('target').alias('target'))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw per bucket, smoothed; `buckets` numbers."""
    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for r in counts.collect():  # at most `buckets` rows
        raw[r['bucket']] += r['raw']
        target[r['bucket']] += r['target']
    if target.sum() <= SMOOTH * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_ngrams, log_ratio): the mean log ratio, shrunk."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    schema = T.StructType([src.schema['doc_id'], T.StructField('n_ngrams', T.LongType()),
                           T.StructField('log_ratio', T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        w = model.value
        for b in batches:
            grams = [ngram_buckets(x.as_py(), len(w)) for x in b.column(1)]
            yield pa.record_batch([
                b.column(0), pa.array([len(g) for g in grams], pa.int64()),
                pa.array([float(w[g].sum() / (len(g) + PRIOR)) for g in grams], pa.float64())],
                names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def gumbel(doc_id, seed: str = SEED):
    """Standard Gumbel noise from 52 bits of a hash of the id."""
    digest = F.md5(F.concat(F.lit(seed + ':'), F.coalesce(doc_id.cast('string'), F.lit('null'))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast('double') + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, cells: int = 4096) -> float | None:
    """The k-th largest value of `key`, by histograms of ever narrower ranges
    (`cells` rows each); null if there are fewer than k."""
    lo, hi, n = keys.agg(F.min('key'), F.max('key'), F.count('key')).first()
    if k <= 0 or not n or k > n:
        return None
    above = 0
    while True:
        width = (hi - lo) / cells
        inside = keys.filter((F.col('key') >= lo) & (F.col('key') <= hi))
        if width <= 0 or lo + width == lo:
            return hi
        cell = F.least(F.lit(cells - 1), F.floor((F.col('key') - lo) / width))
        rows = inside.groupBy(cell.alias('cell')).agg(
            F.count(F.lit(1)).alias('n'), F.min('key').alias('lo'), F.max('key').alias('hi')).collect()
        for r in sorted(rows, key=lambda r: -r['cell']):
            if above + r['n'] >= k:
                lo, hi = r['lo'], r['hi']
                break
            above += r['n']
        if lo == hi:
            return lo


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, key, kept) of every document; `labels`
    (doc_id, quality) names the target, `k` the sample size."""
    # a document with several labels is good if all of them are
    good = labels.groupBy(F.col('doc_id').alias('of')).agg((F.min('quality') == 1).alias('good'))
    chosen = good.filter('good').orderBy(F.xxhash64('of'), 'of').limit(MAX_LABELLED)
    marked = docs.select('doc_id', 'text').join(F.broadcast(chosen), F.col('doc_id') == F.col('of'), 'left')
    ratios = log_ratios(ngram_counts(marked))
    out = scratch_table(scored(docs, ratios).withColumn(
        'key', F.col('log_ratio') * TEMPERATURE + gumbel(F.col('doc_id'))), 'dsir-scores')
    if k is None:
        share = good.agg(F.avg(F.col('good').cast('int'))).first()[0]
        k = math.ceil(out.count() * (1.0 if share is None else share))
    border = kth_largest(out, k)
    kept = F.lit(k > 0) if border is None else F.col('key') >= border
    return out.withColumn('kept', kept)

