"""Line dedup by a deletion-neighbourhood join.

A line with a word, however short, is dropped if an earlier line (by document
id, then text hash, then line number) has the same words; one of at least
`MIN_WORDS` words also if an earlier one of that length differs by one word
inserted, deleted or replaced: one word in five is the most that may differ.

Every distinct line that can have such a neighbour emits the hash of each
variant with one word deleted, and its own hash. Two lines within one word
meet at a key: the same variant with the word deleted at the same place
(replaced), or the variant of one that is the other (inserted). Keys are
aggregated to their earliest line, never to pairs, so a template shared by a
million lines costs a million rows; each line then gets its candidates back
and the word edit distance to them is verified on the words themselves.

Only lines that share half of their words with another distinct line emit
variants: of two lines within one word, the first or the last halves are equal,
so a line whose half keys nobody shares has no neighbour. Word hashes are
combined as polynomials modulo 2**64, so each variant costs one step.

The verdict on a line travels back to its places. Lines with very many places
(over 1 / HOT_LINES of all lines each, so there are fewer than HOT_LINES of
them) are broadcast, and their places join nothing else; the others are joined
by their hash.

Edge cases: a null or empty text has no lines to drop; lines are split at
"\\n" and words at white space; a row that is listed twice (same id and text) is
one document and each listing gets the same result; null ids come first; an
empty table gives no rows; further columns pass through `deduplicated`.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, merged, scratch_table, text_groups

MIN_WORDS = 5
HOT_LINES, HOT_AT_LEAST = 20_000, 100
_WORD = re.compile(r'[^\x20\x09-\x0d]+')
_ODD = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POWERS[0]) <= n:
        m = 1 << (n + 1).bit_length()
        for k, b in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def _mix(h: np.ndarray, salt) -> np.ndarray:
    """Spread a sum of products, together with a salt, over 64 bits."""
    h = h ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordSums:
    """Hashes of runs of words, from prefix sums over a list of words."""

    def __init__(self, words):
        n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, n)
        self.up, down = _powers(n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * down[:n], dtype=np.uint64)))

    def run(self, a, b):
        return (self.sums[b] - self.sums[a]) * self.up[a]

    def line(self, a, b):
        return _mix(self.run(a, b), b - a)

    def without(self, a, b, i):
        """Hash of the run a..b without word i, equal to `line` of that run."""
        return _mix(self.run(a, i) + (self.sums[b] - self.sums[i + 1]) * self.up[a + 1], b - a - 1)


def _signed(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, half keys) of every line with a word;
    `line` is the hash of its words, and only lines of MIN_WORDS words have
    half keys. A document without such a line has one row with a null line."""
    src = docs.select('doc_id', F.xxhash64('text').alias('text_hash'), F.coalesce('text', F.lit('')).alias('text'))
    schema = T.StructType([src.schema['doc_id'], src.schema['text_hash'], T.StructField('line_no', T.IntegerType()),
                           T.StructField('line', T.LongType()), T.StructField('halves', T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            bare = []
            for lo, hi in text_groups(texts):
                words, doc, number, begin, end = [], [], [], [], []
                for i in range(lo, hi):
                    had = len(doc)
                    for k, line in enumerate(texts[i].split('\n')):
                        w = _WORD.findall(line)
                        if w:
                            doc.append(i)
                            number.append(k)
                            begin.append(len(words))
                            words += w
                            end.append(len(words))
                    if len(doc) == had:
                        bare.append(i)
                a, z, s = np.array(begin, np.int64), np.array(end, np.int64), WordSums(words)
                m = z - a
                # the halves as the shorter and as the longer of two lines
                halves = [_mix(s.run(a, a + n // 2), 4 * (n // 2) + 1) for n in (m, m - 1)]
                halves += [_mix(s.run(z - (n - n // 2), z), 4 * (n - n // 2) + 2) for n in (m, m - 1)]
                at, long = np.array(doc, np.int64), m >= MIN_WORDS
                yield pa.record_batch([
                    b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(number, pa.int32()),
                    _signed(s.line(a, z)), pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(4 * long))).astype(np.int32)),
                        _signed(np.stack(halves, axis=1)[long].reshape(-1)))], names=schema.fieldNames())
            at, n = pa.array(bare, pa.int64()), len(bare)
            yield pa.record_batch([
                b.column(0).take(at), b.column(1).take(at), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.list_(pa.int64()))], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def _candidates(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(line, rank, words) of the distinct lines that share a half key with
    another one, with their words fetched from their earliest place."""
    keys = first.select('line', F.explode(F.array_distinct('halves')).alias('key'))
    shared = keys.groupBy('key').agg(F.min('line').alias('a'), F.max('line').alias('b')).filter('a <> b').select('key')
    wanted = keys.join(merged(shared), 'key', 'left_semi').select('line').distinct()
    place = first.join(merged(wanted), 'line', 'left_semi').select('line', 'rank', 'rank.*')
    # one row per document that has some: its lines are at most its own
    per_doc = place.groupBy('doc_id', 'text_hash').agg(F.collect_list(F.struct('line_no', 'line')).alias('found'))
    texts = docs.select('doc_id', F.xxhash64('text').alias('text_hash'), 'text')
    both = texts.alias('t').join(merged(per_doc).alias('p'), F.col('t.doc_id').eqNullSafe(F.col('p.doc_id'))
                                 & (F.col('t.text_hash') == F.col('p.text_hash')))
    # the wanted lines are picked before they become rows of their own
    picked = let(F.split('t.text', '\n', -1), lambda x: F.transform('p.found', lambda f: F.struct(
        f['line_no'].alias('line_no'), f['line'].alias('line'), F.get(x, f['line_no']).alias('words'))))
    per_line = both.select('t.doc_id', 't.text_hash', F.explode(picked).alias('f')).select('doc_id', 'text_hash', 'f.*')
    # a document that is listed twice brings its lines twice
    return per_line.groupBy('line').agg(F.min(F.struct('doc_id', 'text_hash', 'line_no')).alias('rank'),
                                        F.min('words').alias('words'))


def _variants(candidates: DataFrame) -> DataFrame:
    """(line, key, place): the line itself at place -1, and each of its
    variants with one word deleted."""
    src = candidates.select('line', 'words')
    schema = T.StructType([T.StructField('line', T.LongType()), T.StructField('key', T.LongType()),
                           T.StructField('place', T.IntegerType())])

    def run(batches):
        for b in batches:
            for line, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = WordSums(_WORD.findall(text))
                n = len(s.sums) - 1
                i = np.arange(n)
                zero = np.zeros(n, np.int64)
                key = np.concatenate((s.line(zero[:1], zero[:1] + n), s.without(zero, zero + n, i)))
                yield pa.record_batch([pa.array(np.full(n + 1, line, np.int64)), _signed(key),
                                       pa.array(np.arange(-1, n, dtype=np.int32))], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def within_one_word(a: str, b: str) -> bool:
    """Whether the word edit distance of two lines is at most 1."""
    x, y = _WORD.findall(a), _WORD.findall(b)
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(line): distinct lines with an earlier line within one word."""
    found = scratch_table(_candidates(docs, first), 'line-candidates')
    every = scratch_table(_variants(found), 'line-variants')
    # most keys belong to one line only; the rest of the work is on the others
    shared = every.groupBy('key').agg(F.min('line').alias('a'), F.max('line').alias('b')).filter('a <> b')
    variants = scratch_table(every.join(merged(shared.select('key')), 'key', 'left_semi')
                             .join(merged(found.select('line', 'rank')), 'line'), 'line-meetings')
    own = F.struct('rank', 'line')
    replaced = variants.filter('place >= 0').groupBy('key', 'place').agg(F.min(own).alias('e'))
    met = variants.groupBy('key').agg(F.min(F.when(F.col('place') < 0, own)).alias('whole'),
                                      F.min(F.when(F.col('place') >= 0, own)).alias('longer'))
    a = variants.filter('place >= 0').join(merged(replaced), ['key', 'place']).select('line', 'rank', 'e')
    b = variants.join(merged(met), 'key').select('line', 'rank', F.when(F.col('place') < 0, F.col('longer'))
                                         .otherwise(F.col('whole')).alias('e'))
    pairs = a.union(b).filter(F.col('e.rank') < F.col('rank')).select('line', F.col('e.line').alias('other')).distinct()
    here = found.select('line', 'words')
    there = found.select(F.col('line').alias('other'), F.col('words').alias('other_words'))

    @F.pandas_udf(T.BooleanType())
    def close(x, y):
        import pandas as pd
        return pd.Series([within_one_word(p, q) for p, q in zip(x, y)], dtype=bool)

    return (pairs.join(merged(here), 'line').join(merged(there), 'other')
            .filter(close('words', 'other_words')).select('line').distinct())


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_lines, exact, near): per document the number of
    its lines with a word, and the line numbers dropped as repeats
    (`exact`) and as near repeats (`near`) of earlier lines."""
    every = scratch_table(lines(docs), 'lines')
    rank = F.struct('doc_id', 'text_hash', 'line_no')
    first = scratch_table(every.filter('line IS NOT NULL').groupBy('line').agg(F.min(rank).alias('rank'), F.first('halves').alias('halves'),
                                                    F.count(F.lit(1)).alias('n')), 'line-first')
    near = near_lines(docs, first).select(F.col('line').alias('close'))
    # only lines with something to say travel back to the places
    verdict = scratch_table(first.select('line', 'rank', 'n').join(merged(near), F.col('line') == F.col('close'), 'left').select(
        F.col('line').alias('of'), F.col('rank').alias('first'), F.col('close').isNotNull().alias('near'), 'n')
        .filter('near OR n > 1'), 'line-verdicts')
    many = max(HOT_AT_LEAST, every.count() // HOT_LINES)
    hot = verdict.filter(F.col('n') > many).select(F.col('of').alias('hot'), F.struct('first', 'near').alias('v'))
    at = every.join(F.broadcast(hot), F.col('line') == F.col('hot'), 'left')
    # places of hot lines have their verdict: any other key spreads them
    at = at.withColumn('key', F.when(F.col('hot').isNull(), F.col('line')).otherwise(F.xxhash64('doc_id', 'text_hash', 'line_no')))
    cold = verdict.filter(F.col('n') <= many).select('of', F.struct('first', 'near').alias('w'))
    at = at.join(merged(cold), (F.col('key') == F.col('of')) & F.col('hot').isNull(), 'left')
    at = at.select('doc_id', 'text_hash', 'line_no', F.coalesce('v', 'w').alias('v')).select(
        'doc_id', 'text_hash', 'line_no', 'v.first', 'v.near')
    exact = F.col('first').isNotNull() & (F.col('first') < rank)
    close = F.coalesce('near', F.lit(False)) & ~exact
    # a document that is listed twice has each line number twice
    return at.groupBy('doc_id', 'text_hash').agg(
        F.count_distinct('line_no').alias('n_lines'),
        F.array_sort(F.collect_set(F.when(exact, F.col('line_no')))).alias('exact'),
        F.array_sort(F.collect_set(F.when(close, F.col('line_no')))).alias('near'))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines (`n_chars` adjusted), with
    all their columns; no row is dropped."""
    gone = dropped_lines(docs).select(
        F.col('doc_id').alias('_d'), F.col('text_hash').alias('_h'),
        F.array_union('exact', 'near').alias('_gone')).filter(F.size('_gone') > 0)
    rows = docs.select(F.struct('*').alias('_row'), F.col('doc_id').alias('_id'), F.xxhash64('text').alias('_t'))
    at = rows.join(merged(gone), F.col('_id').eqNullSafe(F.col('_d')) & (F.col('_t') == F.col('_h')), 'left')
    kept = let(F.split('_row.text', '\n', -1), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col('_gone')), lambda i: F.get(x, i)), '\n'))
    text = F.when(F.col('_gone').isNull(), F.col('_row.text')).otherwise(kept)
    out = at.select('_row', text.alias('_new'))
    cols = [(F.col('_new') if c == 'text' else
             F.when(F.col('_row.text').isNull(), F.col('_row.n_chars'))
             .otherwise(F.char_length('_new')).cast(docs.schema['n_chars'].dataType)
             if c == 'n_chars' else F.col('_row')[c]).alias(c) for c in docs.columns]
    return out.select(*cols)
