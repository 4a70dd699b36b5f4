"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits over word shingles. Anchors are the words of a
covering code, the direct sum of perfect codes: the binary Golay code
[23, 12, 7] on bits 0-22 and again on bits 23-45 (2**24 anchors, covering
radius 3 + 3), and from `WIDE_FROM` fingerprints on also the Hamming code
[15, 11, 3] on bits 46-60 (2**35 anchors, radius 3 + 3 + 1). Every fingerprint
has one home anchor within the radii; it is replicated to all anchors whose
distances exceed the radii by `threshold` in sum. If two fingerprints differ in
at most `threshold` bits, the home of one is among the other's anchors, so
comparing homes with replicas per anchor, on all 64 bits, finds every link, and
each pair at one anchor only.

For two bits the narrow code makes 61 replicas of n fingerprints on average and
61 n / 2**24 comparisons each (4 for a million, 3900 for 2**30), the wide one
153 replicas and 153 n / 2**35 comparisons each (5 for 2**30). Both find
the same links.

Equal fingerprints are one node, so exact copies never form pairs. Links are
joined to components by passing on the smallest label and jumping along
labels, in distributed rounds over the linked nodes only.

Edge cases: a null or empty text has no shingles and fingerprint zero, linked
like any other; a text with fewer words than a shingle is one shingle; null
ids are never the smallest unless the component has no other; an empty table
gives no rows; other columns are not read (and pass through
`one_of_each_group`).
"""

from __future__ import annotations

import re
from itertools import combinations, islice, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import merged, scratch_table

SHINGLE = 3
THRESHOLD = 2
SEED = 42
_WORD = re.compile(rb'[^\x20\x09-\x0d]+')
#: Perfect cyclic codes: length, generator polynomial, its degree, covering radius.
GOLAY = (23, 0b101011100011, 11, 3)
HAMMING = (15, 0b10011, 4, 1)
NARROW, WIDE = (GOLAY, GOLAY), (GOLAY, GOLAY, HAMMING)
#: Distinct fingerprints from which on the comparisons at the narrow code's
#: anchors cost more than the wide code's further replicas.
WIDE_FROM = 1 << 28


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64 bits that are set in more than half of the shingles' hashes."""
    words = _WORD.findall(text.encode('utf-8', 'surrogatepass').lower())  # bytes: A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = iter([b' '.join(words)]), 1
    else:
        n = len(words) - shingle + 1
        grams = map(b' '.join, zip(*(islice(words, k, None) for k in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for left in range(n, 0, -65535):
        h = np.fromiter(hashes, '<u8', min(left, 65535))
        # 255 rows fit a byte sum, the byte sums of a block fit 16 bits
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder='little')
        ones += np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder='little').view('<u8')[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed 64-bit integer."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'), F.xxhash64('text').alias('text_hash'))
    schema = T.StructType([src.schema['doc_id'], src.schema['text_hash'], T.StructField('fp', T.LongType())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(fp)], names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def _syndromes(x: np.ndarray, code) -> np.ndarray:
    """Remainders of a code's words by its generator."""
    bits, generator, degree, _ = code
    x = x.copy()
    for bit in range(bits - 1, degree - 1, -1):
        x ^= np.where((x >> bit) & 1, generator << (bit - degree), 0)
    return x


def _error_tables(code, extra: int):
    """Per excess e = 0..extra over the radius: the error patterns whose
    removal leads to a code word within the radius (e = 0) or e beyond it,
    ordered by syndrome, and the first pattern of each syndrome."""
    bits, _, degree, radius = code
    tables = []
    for e in range(extra + 1):
        weights = range(radius + 1) if e == 0 else [radius + e]
        errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(bits), w)], np.int64)
        s = _syndromes(errors, code)
        order = np.argsort(s, kind='stable')
        tables.append((errors[order], np.searchsorted(s[order], np.arange((1 << degree) + 1))))
    return tables


def _anchors(fp: np.ndarray, extra: int, codes, tables):
    """(row, anchor) for every anchor within the radii plus `extra`."""
    u, parts, shift = fp.view(np.uint64), [], 0
    for code, errors in zip(codes, tables):
        part = ((u >> np.uint64(shift)) & np.uint64((1 << code[0]) - 1)).astype(np.int64)
        parts.append((part, _syndromes(part, code), errors, shift))
        shift += code[0]
    rows, anchors = [], []
    for excess in product(range(extra + 1), repeat=len(codes)):
        if sum(excess) > extra:
            continue
        row, anchor = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for e, (part, synd, errors, at) in zip(excess, parts):
            patterns, first = errors[e]
            # each way so far goes on with every pattern of its part's syndrome
            s = synd[row]
            n = first[s + 1] - first[s]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, anchor, start = np.repeat(row, n), np.repeat(anchor, n), np.repeat(first[s], n)
            anchor = anchor | ((part[row] ^ patterns[start + k]) << at)
        rows.append(row)
        anchors.append(anchor)
    return np.concatenate(rows), np.concatenate(anchors)


def replicas(nodes: DataFrame, extra: int, codes=NARROW) -> DataFrame:
    """(anchor, fp): homes for extra = 0, all anchors in reach otherwise."""
    schema = T.StructType([T.StructField('anchor', T.LongType()), T.StructField('fp', T.LongType())])

    def run(batches):
        tables = [_error_tables(code, extra) for code in codes]
        for b in batches:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i:i + 4096]
                row, anchor = _anchors(part, extra, codes, tables)
                yield pa.record_batch([pa.array(anchor), pa.array(part[row])], names=schema.fieldNames())

    return nodes.select('fp').mapInArrow(run, schema)


def links(nodes: DataFrame, threshold: int = THRESHOLD, codes=None) -> DataFrame:
    """(u, v), u < v: all pairs of distinct fingerprints within `threshold`
    bits. Without `codes` the number of fingerprints chooses them."""
    codes = codes or (WIDE if nodes.count() >= WIDE_FROM else NARROW)
    home = replicas(nodes, 0, codes).withColumnRenamed('fp', 'u')
    near = replicas(nodes, threshold, codes).withColumnRenamed('fp', 'v')
    return (home.join(merged(near), 'anchor')
            .filter((F.col('u') < F.col('v'))
                    & (F.bit_count(F.col('u').bitwiseXOR(F.col('v'))) <= threshold)).select('u', 'v'))


def components(edges: DataFrame) -> DataFrame:
    """(fp, label): the smallest fingerprint reachable, for linked nodes."""
    both = scratch_table(edges.union(edges.select(F.col('v').alias('u'), F.col('u').alias('v'))), 'simhash-links')
    label = scratch_table(both.groupBy(F.col('u').alias('fp')).agg(F.min('v').alias('m'))
                          .select('fp', F.least('fp', 'm').alias('label')), 'simhash-labels')
    while True:
        seen = both.join(merged(label), F.col('v') == F.col('fp')).groupBy('u').agg(F.min('label').alias('m'))
        low = label.join(merged(seen), F.col('fp') == F.col('u')).select('fp', F.least('label', 'm').alias('to'),
                                                                 F.col('label').alias('was'))
        jump = label.select(F.col('fp').alias('at'), F.col('label').alias('next'))
        new = scratch_table(low.join(merged(jump), F.col('to') == F.col('at')).select(
            'fp', F.least('to', 'next').alias('label'), 'was'), 'simhash-labels')
        if new.filter('label <> was').isEmpty():
            return new.select('fp', 'label')
        label = new.select('fp', 'label')


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) of every document; `label`
    is the component's smallest fingerprint."""
    marks = scratch_table(fingerprints(docs, shingle), 'simhash-fp')
    nodes = scratch_table(marks.groupBy('fp').agg(F.min('doc_id').alias('first')), 'simhash-nodes')
    label = components(links(nodes, threshold))
    labelled = nodes.join(merged(label.withColumnRenamed('fp', 'of')), F.col('fp') == F.col('of'), 'left').select(
        'fp', 'first', F.coalesce('label', 'fp').alias('label'))
    smallest = labelled.groupBy('label').agg(F.min('first').alias('component_id'))
    root = labelled.join(merged(smallest), 'label').select('fp', 'label', 'component_id')
    return marks.join(merged(root), 'fp').select('doc_id', 'text_hash', 'fp', 'label', 'component_id')


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group: the one whose id names the component (of
    several with that id the smallest text hash; a row that is listed twice
    once)."""
    keep = near_duplicates(docs, shingle, threshold).filter(F.col('doc_id').eqNullSafe(F.col('component_id')))
    keep = keep.groupBy('label', 'component_id').agg(F.min('text_hash').alias('_h')).select(
        F.col('component_id').alias('_c'), '_h')
    rows = docs.select(F.struct('*').alias('_row'), F.col('doc_id').alias('_id'), F.xxhash64('text').alias('_t'))
    kept = rows.join(merged(keep), F.col('_id').eqNullSafe(F.col('_c')) & (F.col('_t') == F.col('_h')), 'left_semi')
    return kept.dropDuplicates(['_id', '_t']).select('_row.*')
