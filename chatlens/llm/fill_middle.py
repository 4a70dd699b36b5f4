"""Fill-in-middle transformation by a wavelet matrix over character classes.

The UTF-8 bytes of a slice of texts are one sequence of character classes. A
wavelet matrix keeps it as one bit vector per bit of the class number, each
level stably partitioned by its bit, with running counts per word of 64 bits:
the rank of a class in front of a place costs one step per level, for all
documents of the slice at once. Units are counted at their borders, and a
border is a set of classes whose ranks are added up:

    char  every first byte of a code point
    word  the first byte of each run of non-space characters
    line  the first byte of the text and each byte behind a line feed

so the number of units in front of a byte is a sum of ranks, and the byte at
which the k-th unit begins is found by bisection on that sum. Both cuts of
each document are located in this way; the text is never split into units.

A document with n units is cut behind unit min(h1, h2) % (n + 1) and unit
max(...), where h1 to h4 are groups of the sha256 of seed and id. It stays
plain if it is empty, holds one of the marks, or is not drawn (h3); else it is
written suffix first (h4: spm) or prefix first (psm). The marks tell both
forms apart, so the text is rebuilt from output and form alone.

Row-local: no shuffle, and a lost task is computed again from its own rows.
Edge cases: a null text is an empty one (plain); a null id draws like an empty
one; equal ids draw alike; repeated rows come out as often; texts are sliced
into about a million characters at a time, one longer text by itself; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups

#: The marks, and the share (of 100) of transformed documents and
#: of those the share written suffix first.
PREFIX, SUFFIX, MIDDLE = '<P>', '<S>', '<M>'
FIM_SHARE, SPM_SHARE = 90, 20
SEED = '1:'

# Classes: bit 2 marks the first byte of a unit of its kind beyond characters.
INNER, SPACE, FEED, WORD, LINE_WORD, LINE_SPACE, LINE_FEED, TAIL = range(8)
LEVELS = 3
#: The classes whose bytes begin a unit.
BORDERS = {'char': (INNER, SPACE, FEED, WORD, LINE_WORD, LINE_SPACE, LINE_FEED), 'word': (WORD, LINE_WORD),
           'line': (LINE_WORD, LINE_SPACE, LINE_FEED)}


def classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; `starts` are the places where texts begin."""
    feed = raw == 10
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    line = np.zeros(len(raw), bool)
    line[1:] = feed[:-1]
    line[starts[starts < len(raw)]] = True
    behind = np.ones(len(raw), bool)
    behind[1:] = space[:-1]
    behind |= line
    out = np.where(feed, FEED, np.where(space, SPACE, np.where(behind, WORD, INNER))).astype(np.uint8)
    out[line] = np.where(feed[line], LINE_FEED, np.where(space[line], LINE_SPACE, LINE_WORD))
    out[(raw & 0xC0) == 0x80] = TAIL
    return out


class WaveletMatrix:
    """Rank queries on a sequence of small numbers, vectorised over queries."""

    def __init__(self, seq: np.ndarray, levels: int = LEVELS):
        self.n, self.levels = len(seq), levels
        self.bits, self.ahead, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder='little').view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.bits.append(words)
            self.ahead.append(np.concatenate(([0], np.cumsum(counts)))[:-1])
            self.zeros.append(self.n - int(counts.sum()))
            # zeros first, both in their order: the next level's sequence
            one = bit.astype(bool)
            seq = np.concatenate((seq[~one], seq[one]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level in front of each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.bits[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ahead[level][word] + np.bitwise_count(low)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often `value` occurs in front of each place."""
        lo, hi = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for i in range(self.levels):
            a, b = self._ones(i, lo), self._ones(i, hi)
            if (value >> (self.levels - 1 - i)) & 1:
                lo, hi = self.zeros[i] + a, self.zeros[i] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo


class Units:
    """Units of many texts: their numbers, and the bytes where they begin."""

    def __init__(self, raw: list[bytes], unit: str = 'char'):
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        data = np.frombuffer(b''.join(raw), np.uint8)
        self.matrix = WaveletMatrix(classes(data, self.start))
        self.border = BORDERS[unit]
        self.first = self.before(self.start)
        self.count = self.before(self.end) - self.first

    def before(self, at: np.ndarray) -> np.ndarray:
        """Unit borders in front of each place: ranks of the border classes,
        or of all others if those are fewer."""
        others = [c for c in range(1 << LEVELS) if c not in self.border]
        if len(others) < len(self.border):
            return at - sum(self.matrix.rank(c, at) for c in others)
        return sum(self.matrix.rank(c, at) for c in self.border)

    def byte_of(self, doc: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes of text `doc` in front of the border of its unit `k` (all of
        them for k = count): the last place with at most k borders in front
        of it, by bisection for all queries at once. For k = 0 the cut is at
        the very start."""
        lo, hi = self.start[doc].copy(), self.end[doc].copy()
        want = self.first[doc] + k
        # invariant: before(lo) <= want; the answer is the greatest such place
        steps = int((hi - lo).max(initial=0)).bit_length()
        for _ in range(steps):
            mid = (lo + hi + 1) >> 1
            low = self.before(mid) <= want
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid - 1)
        return np.where(k == 0, self.start[doc], lo) - self.start[doc]


def draws(doc_ids, seed: str = SEED) -> np.ndarray:
    """h1 to h4 per id: the first four 32-bit groups of the sha256 of seed and
    decimal id (a null id: seed alone)."""
    digests = [hashlib.sha256(f'{seed}{"" if i is None else i}'.encode()).digest()[:16] for i in doc_ids]
    return np.frombuffer(b''.join(digests), '>u4').reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, unit: str = 'char', share: int = FIM_SHARE, spm: int = SPM_SHARE,
                   seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) per document: the
    text cut at `unit` borders ('char', 'word' or 'line'), `share` of 100
    documents transformed, `spm` of 100 of those suffix first. A piece of
    several units keeps the white space between and behind them."""
    if unit not in BORDERS:
        raise ValueError(f'unit must be one of {sorted(BORDERS)}')
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    schema = T.StructType([
        src.schema['doc_id'], T.StructField('n', T.LongType()), T.StructField('form', T.StringType()),
        T.StructField('prefix_units', T.LongType()), T.StructField('middle_units', T.LongType()),
        T.StructField('output', T.StringType())])
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in text_groups(texts):
                raw, ids = texts[lo:hi], b.column(0).slice(lo, hi - lo)
                units, h = Units(raw, unit), draws(ids.to_pylist(), seed)
                n = units.count
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                moved = np.array([bool(x) and not any(k in x for k in marks) for x in raw], bool)
                moved &= h[:, 2] % 100 < share
                suffix_first = h[:, 3] % 100 < spm
                doc = np.flatnonzero(moved)
                at = np.stack([units.byte_of(doc, cuts[doc, 0]), units.byte_of(doc, cuts[doc, 1])], axis=1)
                out = list(raw)
                for i, (a, z) in zip(doc.tolist(), at.tolist()):
                    x = raw[i]
                    out[i] = (b''.join((s, x[z:], p, x[:a], m, x[a:z])) if suffix_first[i]
                              else b''.join((p, x[:a], s, x[z:], m, x[a:z])))
                form = np.where(moved, np.where(suffix_first, 'spm', 'psm'), 'plain')
                yield pa.record_batch([
                    ids, pa.array(n), pa.array(form.astype(object), pa.string()),
                    pa.array(cuts[:, 0], mask=~moved), pa.array(cuts[:, 1] - cuts[:, 0], mask=~moved),
                    pa.array(out, pa.binary()).view(pa.string())], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The text, from output and form alone: of the two pieces in front of the
    middle, each ends at the next mark."""
    def between(a, z):
        return F.substring_index(F.substring_index(output, z, 1), a, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == 'psm', F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == 'spm', F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))


def fim_digests(docs: DataFrame) -> DataFrame:
    """Cuts, forms and digests of the transformation by code points."""
    return fill_in_middle(docs).select(
        'doc_id', 'n', 'form', F.col('prefix_units').alias('prefix_chars'), F.col('middle_units').alias('middle_chars'),
        F.sha2('output', 256).alias('output_sha256'),
        F.sha2(restored(F.col('form'), F.col('output')), 256).alias('restored_sha256'))
