"""N-gram Jaccard join by signature trees.

A document's set are the hashes of its distinct word shingles. Two sets are
linked when 100 * intersection >= percent * union; exact copies are one set.

Which sets can meet. Linked sets of at most s tokens differ in at most
D = (100 - percent) * 2s // (100 + percent) tokens, so of D + 1 ranges of the
token hashes at least one holds the same tokens in both, and of D + 1 + S ranges
at least S + 1 do. So a set may leave out its emptiest ranges, S at most, all
with fewer tokens than those it keeps: of the S + 1 ranges that two sets have
alike the fullest is kept by both. Sizes fall into classes, a set emits one key
per kept range for its class and for the next ones that a partner could lie in,
and the sets that share keys form families. A key stands for a whole range of a
set, and not for an empty one, so neither a passage or a word that very many
documents share nor a range without tokens makes a family by itself. (With D + 1
ranges a set of 1000 tokens had an empty one in about one of ten cases; their
keys tied ever more sets that have nothing in common to one family.)

Signature trees. The sets of a family lie side by side, similar ones next to
each other (by their smallest token, then size), and are cut into blocks of
bounded size. Over the sets of a block, and over the blocks of a family that
spans several, nodes hold the OR of their sets' token bitmaps, the range of the
sizes, and how far a size exceeds its own bitmap at most (`slack`: tokens that
share bits). Two sets below nodes P and Q share at most

    min(max size of P and of Q, slack of P or Q + bits common to P and Q)

tokens. The dual traversal starts at pairs of roots and goes down while that
suffices for the smallest sizes below; pairs of sets that are left are compared
on their tokens. A pair of nodes that is already in one component is left out:
components need one way between two sets, not every link.

Within a block one task traverses; between blocks the traversal runs as joins
of node tables, level by level, and the surviving pairs of a few neighbouring
blocks are one task's work. A family of many blocks is first held against its middle block, which
joins most of a large group of near copies, then, ordered by component, against
itself.

Edge cases: shingles are compared by 64-bit hashes, sets by 128-bit digests; a
text with fewer words than a shingle has its whole sequence as its only one;
without words, or null, it has the empty set, linked with nothing (its own
component); null ids are never the smallest unless a component has no other; a
row that is listed twice is one set; very long texts have as many keys as their
size asks for and blocks of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, numbered, scratch_table

SHINGLE, PERCENT = 3, 90
SEED = 42
#: Bits of a signature, children of a tree node, and the weight of a block
#: (tokens and SET_WEIGHT for each set).
BITS, FAN, BLOCK_WEIGHT, SET_WEIGHT = 2048, 8, 1 << 16, 256
#: Size classes grow by this ratio.
CLASS_GROWTH = 1.25
#: Tokens by which linked sets may differ for each spare range.
SPARE = 4
#: Children of a node above the blocks, and neighbouring blocks that go to a
#: task together to meet others.
BLOCK_FAN, TILE = 16, 4
_WORD = re.compile(rb'[^\x20\x09-\x0d]+')


# ------------------------------------------------------------------ sets and keys

def tokens(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = _WORD.findall(text.encode('utf-8', 'surrogatepass').lower())  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b' '.join(words), SEED)], np.uint64)
    grams = map(b' '.join, zip(*(islice(words, k, None) for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def set_digest(t: np.ndarray) -> bytes:
    return hashlib.blake2b(t.tobytes(), digest_size=16).digest()


def differing(total: int, percent: int) -> int:
    """The most tokens in which two linked sets of `total` tokens together
    differ: of I common ones, (100 + percent) * I >= percent * total."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(maxsize=None)
def _class_starts() -> np.ndarray:
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * CLASS_GROWTH)))
    return np.array(starts)


@lru_cache(maxsize=None)
def _borders(ranges: int) -> np.ndarray:
    """The inner borders of equal ranges of the 64-bit hashes."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def keys(t: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set's fuller ranges, as signed numbers."""
    n, starts = len(t), _class_starts()
    own = int(np.searchsorted(starts, n, side='right')) - 1
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(t), dtype=np.uint64)))
    out = []
    # a partner is at least as large and in a class that begins within reach
    while own + 1 < len(starts) and 100 * n >= percent * int(starts[own]):
        # the widest difference of two sets of the class (both odd and even totals)
        top = 2 * (int(starts[own + 1]) - 1)
        most = max(differing(top, percent), differing(top - 1, percent))
        spare = -(-most // SPARE)
        ranges = most + 1 + spare
        at = np.concatenate(([0], np.searchsorted(t, _borders(ranges)), [n]))
        held = np.diff(at)
        mark = np.arange(ranges, dtype=np.uint64) + np.uint64(own << 40)
        key = _mix((upto[at[1:]] - upto[at[:-1]]) ^ (mark * np.uint64(0x9E3779B97F4A7C15)))
        # at most `spare` ranges hold less than this one
        out.append(key[held >= np.partition(held, spare)[spare]])
        own += 1
    return np.concatenate(out).view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, digest, h, n, low, keys) of every document: `h` is
    half of the digest, `low` the smallest token."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'), F.xxhash64('text').alias('text_hash'))
    schema = T.StructType([
        src.schema['doc_id'], src.schema['text_hash'], T.StructField('digest', T.BinaryType()),
        T.StructField('h', T.LongType()), T.StructField('n', T.LongType()), T.StructField('low', T.LongType()),
        T.StructField('keys', T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                dig, n, low, ks = [], [], [], []
                for text in part.column(1):
                    t = tokens(text.as_py(), shingle)
                    dig.append(set_digest(t))
                    n.append(len(t))
                    low.append(int(t[:1].view(np.int64)[0]) if len(t) else None)
                    ks.append(keys(t, percent) if len(t) else np.zeros(0, np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in ks]))).astype(np.int32)
                h = np.frombuffer(b''.join(d[:8] for d in dig), '<i8')
                yield pa.record_batch([
                    part.column(0), part.column(2), pa.array(dig, pa.binary()), pa.array(h), pa.array(n, pa.int64()),
                    pa.array(low, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ks)))],
                    names=schema.fieldNames())

    return src.mapInArrow(run, schema)


def families(marks: DataFrame) -> DataFrame:
    """(h, family): sets (by half digest) that share keys, directly or over
    others; a set that shares no key is in none."""
    every = marks.select('h', F.explode('keys').alias('key'))
    # stored, so that its size is known to the join: few keys are shared
    shared = scratch_table(every.groupBy('key').agg(F.min('h').alias('a'), F.max('h').alias('b')).filter('a <> b')
                           .select('key'), 'jaccard-shared')
    some = scratch_table(every.join(shared, 'key', 'left_semi').distinct().withColumn(
        'part', F.col('h').bitwiseAND(255).cast('int')), 'jaccard-keys')
    # stars in two steps, so that no set of a large family has all the others
    # as neighbours
    first = some.groupBy('key', 'part').agg(F.min('h').alias('lo'))
    whole = first.groupBy('key').agg(F.min('lo').alias('root'))
    edges = some.join(first, ['key', 'part']).select(F.col('h').alias('u'), F.col('lo').alias('v')).union(
        first.join(whole, 'key').select(F.col('lo').alias('u'), F.col('root').alias('v')))
    return connected(edges, 'jaccard-family').select(F.col('node').alias('h'), F.col('label').alias('family'))


# ------------------------------------------------------------------ trees

class Nodes:
    """One level of a signature tree: per node the range of sizes, the slack,
    the bitmap, the range of families and the component (-1: several)."""

    __slots__ = ('lo', 'hi', 'slack', 'bits', 'first', 'last', 'label')

    def __init__(self, lo, hi, slack, bits, first, last, label):
        self.lo, self.hi, self.slack, self.bits = lo, hi, slack, bits
        self.first, self.last, self.label = first, last, label

    def above(self, fan: int) -> Nodes:
        at = np.arange(0, len(self.lo), fan)
        low, high = np.minimum.reduceat(self.label, at), np.maximum.reduceat(self.label, at)
        return Nodes(np.minimum.reduceat(self.lo, at), np.maximum.reduceat(self.hi, at),
                     np.maximum.reduceat(self.slack, at), np.bitwise_or.reduceat(self.bits, at, axis=0),
                     np.minimum.reduceat(self.first, at), np.maximum.reduceat(self.last, at),
                     np.where(low == high, low, -1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap per set, as rows of 64-bit words."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flags = np.zeros((len(sets), BITS), np.uint8)
    flags[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) % BITS).astype(np.int64)] = 1
    return np.packbits(flags, axis=1).view(np.uint64)


def may_link(p: Nodes, q: Nodes, i, j, percent: int) -> np.ndarray:
    """Which pairs of nodes can have linked sets below them."""
    common = np.bitwise_count(p.bits[i] & q.bits[j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(p.hi[i], q.hi[j]), np.minimum(p.slack[i], q.slack[j]) + common)
    ok = (100 + percent) * most >= percent * (p.lo[i] + q.lo[j])
    ok &= (p.first[i] <= q.last[j]) & (q.first[j] <= p.last[i])
    return ok & ((p.label[i] < 0) | (p.label[i] != q.label[j]))


class SignatureTree:
    """The sets of a block: leaves in the given order, FAN nodes to a parent."""

    def __init__(self, sets: list[np.ndarray], family: np.ndarray, label: np.ndarray):
        self.sets = sets
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = signatures(sets)
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [Nodes(n, n, slack, bits, family, family, label)]
        while len(self.levels[-1].lo) > 1:
            self.levels.append(self.levels[-1].above(FAN))


def candidates(a: SignatureTree, b: SignatureTree | None, percent: int):
    """Pairs of sets (i, j) that survive the dual traversal of two trees, or
    of one with itself (i < j)."""
    other = b or a
    # the shallower tree waits at its root
    for depth in range(max(len(a.levels), len(other.levels)) - 1, -1, -1):
        p, q = (t.levels[min(depth, len(t.levels) - 1)] for t in (a, other))
        if depth == max(len(a.levels), len(other.levels)) - 1:
            i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        else:
            step = [FAN if depth + 1 < len(t.levels) else 1 for t in (a, other)]
            i = (i[:, None] * step[0] + np.repeat(np.arange(step[0]), step[1])[None, :]).ravel()
            j = (j[:, None] * step[1] + np.tile(np.arange(step[1]), step[0])[None, :]).ravel()
            keep = (i < len(p.lo)) & (j < len(q.lo))
            if b is None:
                keep &= (i <= j) if depth else (i < j)
            i, j = i[keep], j[keep]
        parts = [may_link(p, q, i[k:k + 8192], j[k:k + 8192], percent) for k in range(0, len(i), 8192)]
        keep = np.concatenate(parts) if parts else np.zeros(0, bool)
        i, j = i[keep], j[keep]
    return (i, j) if b is not None else (i[i < j], j[i < j])


def spanning_links(a: SignatureTree, b: SignatureTree | None, percent: int) -> list[tuple[int, int]]:
    """Verified links among the candidates; a pair that earlier links, or the
    given components, join already is not compared."""
    i, j = candidates(a, b, percent)
    shift = 0 if b is None else len(a.sets)
    label = a.levels[0].label if b is None else np.concatenate((a.levels[0].label, b.levels[0].label))
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    root = first[of].tolist()

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, right = [], (b or a).sets
    for x, y in zip(i.tolist(), j.tolist()):
        u, v = find(x), find(y + shift)
        if u == v:
            continue
        s, t = a.sets[x], right[y]
        if (100 + percent) * len(np.intersect1d(s, t, assume_unique=True)) >= percent * (len(s) + len(t)):
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


# ------------------------------------------------------------------ blocks

_LINK = T.StructType([T.StructField('u', T.BinaryType()), T.StructField('v', T.BinaryType())])
_PACKED = T.StructType([
    T.StructField('block', T.LongType()), T.StructField('digests', T.ArrayType(T.BinaryType())),
    T.StructField('family', T.ArrayType(T.LongType())), T.StructField('label', T.ArrayType(T.BinaryType())),
    T.StructField('sizes', T.ArrayType(T.LongType())), T.StructField('tokens', T.BinaryType())])


def _packed(key, table):
    """The sets of a block as one row, in their order, each set once."""
    rows = table.sort_by([('place', 'ascending')]).to_pylist()
    rows = list({r['digest']: r for r in reversed(rows)}.values())[::-1]
    row = {'block': key[0].as_py(), **{c: [r[of] for r in rows] for c, of in (
        ('digests', 'digest'), ('family', 'family'), ('label', 'label'))},
        'sizes': [len(r['tokens']) // 8 for r in rows], 'tokens': b''.join(r['tokens'] for r in rows)}
    return pa.Table.from_pylist([row], _arrow(_PACKED))


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _trees(*packed) -> list[SignatureTree]:
    """Trees of packed blocks, their components numbered together."""
    names = {}
    out = []
    for row in packed:
        label = np.array([names.setdefault(x, len(names)) for x in row['label']], np.int64)
        ends = np.cumsum(row['sizes'])[:-1]
        out.append(SignatureTree(np.split(np.frombuffer(row['tokens'], '<u8'), ends),
                                 np.array(row['family'], np.int64), label))
    return out


def place(sets: DataFrame, order: list, name: str) -> DataFrame:
    """`sets` with `place`, the weight of the sets in front, and `block`."""
    by = numbered(sets.withColumn('_all', F.lit(0)), '_all', order, name, F.col('n') + SET_WEIGHT)
    return by.drop('_all').withColumnRenamed('_no', 'place').withColumn(
        'block', F.floor(F.col('place') / BLOCK_WEIGHT))


def pack(sets: DataFrame) -> DataFrame:
    return sets.select('block', 'place', 'digest', 'family', 'label', 'tokens').groupBy('block').applyInArrow(
        _packed, _PACKED)


def with_tokens(docs: DataFrame, placed: DataFrame, shingle: int) -> DataFrame:
    """`placed` with the tokens of its sets, from one document of each."""
    texts = docs.select(F.col('doc_id').alias('_d'), F.xxhash64('text').alias('_h'), F.col('text').alias('_text'))
    both = texts.join(placed, F.col('_d').eqNullSafe(F.col('first.doc_id')) & (F.col('_h') == F.col('first.text_hash')))
    cols = ['block', 'place', 'digest', 'family', 'label']
    schema = T.StructType([placed.schema[c] for c in cols] + [T.StructField('tokens', T.BinaryType())])

    def run(batches):
        seen = set()  # a row that is listed again brings its text again
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                new = []
                for i, digest in enumerate(part.column(2).to_pylist()):
                    if digest not in seen:
                        seen.add(digest)
                        new.append(i)
                part = part.take(pa.array(new, pa.int64()))
                t = [tokens(x.as_py() or '', shingle) for x in part.column(5)]
                yield pa.record_batch([*part.columns[:5], pa.array([x.tobytes() for x in t], pa.binary())],
                                      names=schema.fieldNames())

    return both.select(*cols, '_text').mapInArrow(run, schema)


def unpacked(packed: DataFrame) -> DataFrame:
    """(digest, tokens) of the sets of packed blocks."""
    schema = T.StructType([T.StructField('digest', T.BinaryType()), T.StructField('tokens', T.BinaryType())])

    def run(batches):
        for b in batches:
            for row in b.select(['digests', 'sizes', 'tokens']).to_pylist():
                at = np.concatenate(([0], np.cumsum(row['sizes']))) * 8
                yield pa.record_batch([pa.array(row['digests'], pa.binary()), pa.array(
                    [row['tokens'][i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())],
                    names=schema.fieldNames())

    return packed.mapInArrow(run, schema)


def links_within(packed: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between sets of one block."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tree, = _trees(row)
                got = spanning_links(tree, None, percent)
                d = row['digests']
                yield pa.record_batch([pa.array([d[i] for i, _ in got], pa.binary()),
                                       pa.array([d[j] for _, j in got], pa.binary())], names=_LINK.fieldNames())

    return packed.mapInArrow(run, _LINK)


def links_between(packed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between the sets of two different blocks each. The pairs
    of two tiles of neighbouring blocks are one group, so a block moves once
    for each tile that it meets, not once for each block."""
    tiles = [F.floor(F.col(c) / TILE).alias(t) for c, t in (('a', 'x'), ('b', 'y'))]
    tiled = pairs.select('a', 'b', *tiles)
    left = tiled.groupBy('x', 'y', F.col('a').alias('block')).agg(F.collect_list('b').alias('meets'))
    right = tiled.select('x', 'y', F.col('b').alias('block'), F.array().cast('array<bigint>').alias('meets')).distinct()
    # stored, so that its size (a row per block and tile) is known to the join
    wanted = scratch_table(left.union(right), 'jaccard-tiles')

    def run(table):
        rows, met = {}, []
        for row in table.to_pylist():
            rows[row['block']] = row
            met += [(row['block'], b) for b in row['meets']]
        trees = dict(zip(rows, _trees(*rows.values())))
        u, v = [], []
        for a, b in sorted(met):
            got = spanning_links(trees[a], trees[b], percent)
            u += [rows[a]['digests'][x] for x, _ in got]
            v += [rows[b]['digests'][y] for _, y in got]
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=_LINK.fieldNames())

    return packed.join(wanted, 'block').groupBy('x', 'y').applyInArrow(run, _LINK)


# ------------------------------------------------------------------ nodes above blocks

_NODE = T.StructType([
    T.StructField('family', T.LongType()), T.StructField('node', T.LongType()), T.StructField('lo', T.LongType()),
    T.StructField('hi', T.LongType()), T.StructField('slack', T.LongType()), T.StructField('label', T.BinaryType()),
    T.StructField('bits', T.BinaryType())])


def block_nodes(packed: DataFrame) -> DataFrame:
    """A node for each family and block that has sets of it."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                tree, = _trees(row)
                n, fam = tree.levels[0], np.array(row['family'], np.int64)
                out = []
                for f in np.unique(fam).tolist():
                    at = np.flatnonzero(fam == f)
                    labels = {row['label'][k] for k in at}
                    out.append((f, row['block'], int(n.lo[at].min()), int(n.hi[at].max()), int(n.slack[at].max()),
                                labels.pop() if len(labels) == 1 else None,
                                np.bitwise_or.reduce(n.bits[at], axis=0).tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(_NODE.fieldNames(), r)) for r in out], _arrow(_NODE))

    return packed.mapInArrow(run, _NODE)


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes over up to BLOCK_FAN neighbouring nodes of a family."""
    def merge(key, table):
        labels = set(table.column('label').to_pylist())
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint64) for x in table.column('bits').to_pylist()], axis=0)
        row = (key[0].as_py(), key[1].as_py(), min(table.column('lo').to_pylist()), max(table.column('hi').to_pylist()),
               max(table.column('slack').to_pylist()), labels.pop() if len(labels) == 1 else None, bits.tobytes())
        return pa.Table.from_pylist([dict(zip(_NODE.fieldNames(), row))], _arrow(_NODE))

    up = nodes.withColumn('above', F.floor(F.col('node') / BLOCK_FAN)).select('above', *_NODE.fieldNames())
    return up.groupBy('family', 'above').applyInArrow(merge, _NODE)


@F.pandas_udf(T.LongType())
def _common_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b''.join(c), np.uint64).reshape(len(c), -1) for c in (a, b))
    return pd.Series(np.bitwise_count(x & y).sum(axis=1, dtype=np.int64))


def _surviving(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (family, a, b) of nodes that can have linked sets below."""
    def side(s):
        return nodes.select(F.col('family'), F.col('node').alias(s), *[
            F.col(c).alias(f'{s}_{c}') for c in ('lo', 'hi', 'slack', 'label', 'bits')])

    most = F.least('a_hi', 'b_hi', F.least('a_slack', 'b_slack') + _common_bits('a_bits', 'b_bits'))
    both = pairs.join(side('a'), ['family', 'a']).join(side('b'), ['family', 'b'])
    # sizes and components first: they need no bitmaps
    both = both.filter(((100 + percent) * F.least('a_hi', 'b_hi') >= percent * (F.col('a_lo') + F.col('b_lo')))
                       & ~F.coalesce(F.col('a_label') == F.col('b_label'), F.lit(False)))
    return both.filter((100 + percent) * most >= percent * (F.col('a_lo') + F.col('b_lo'))).select('family', 'a', 'b')


def block_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: blocks that the traversal above them leaves."""
    levels = [scratch_table(nodes, 'jaccard-nodes')]
    while levels[-1].groupBy('family').agg(F.count(F.lit(1)).alias('c')).filter(f'c > {BLOCK_FAN}').limit(1).count():
        levels.append(scratch_table(parents(levels[-1]), 'jaccard-nodes'))
    top = levels[-1].select('family', F.col('node').alias('a'))
    pairs = top.join(top.withColumnRenamed('a', 'b'), 'family').filter('a <= b')
    for depth in range(len(levels) - 1, -1, -1):
        # a node is not held against itself by its bounds: its children are
        pairs = scratch_table(_surviving(pairs.filter('a < b'), levels[depth], percent).unionByName(
            pairs.filter('a = b')), 'jaccard-pairs')
        if depth:
            child = levels[depth - 1].select('family', F.col('node').alias('x'),
                                             F.floor(F.col('node') / BLOCK_FAN).alias('above'))
            low = child.select('family', F.col('x').alias('a_'), F.col('above').alias('a'))
            high = child.select('family', F.col('x').alias('b_'), F.col('above').alias('b'))
            pairs = pairs.join(low, ['family', 'a']).join(high, ['family', 'b']).filter('a_ <= b_').select(
                'family', F.col('a_').alias('a'), F.col('b_').alias('b'))
    return pairs.filter('a < b').select('a', 'b').distinct()


# ------------------------------------------------------------------ the join

def set_links(docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): links between sets that join all linked sets; `sets` has the
    families' sets (digest, first, family, n, low). Sets are placed by their
    sizes alone; their tokens move once, to their blocks."""
    placed = scratch_table(place(sets.withColumn('label', F.col('digest')), ['family', 'low', 'n', 'digest'],
                                 'jaccard-places'), 'jaccard-placed')
    packed = scratch_table(pack(with_tokens(docs, placed, shingle)), 'jaccard-blocks')
    links = scratch_table(links_within(packed, percent), 'jaccard-found')
    spans = placed.groupBy('family').agg(F.min('block').alias('a'), F.max('block').alias('z')).filter('a < z')
    spans = scratch_table(spans, 'jaccard-spans')
    if spans.isEmpty():
        return links
    # the middle block of a family against its other blocks
    wide = placed.join(spans, 'family')
    middle = F.floor((F.col('a') + F.col('z')) / 2)
    blocks = scratch_table(wide.select('block', middle.alias('middle')).distinct(), 'jaccard-spans')
    hub = scratch_table(blocks.filter('block <> middle').select(
        F.least('block', 'middle').alias('a'), F.greatest('block', 'middle').alias('b')).distinct(), 'jaccard-pairs')
    links = scratch_table(links.union(links_between(packed, hub, percent)), 'jaccard-found')
    # then all blocks, ordered by what is joined by now
    known = connected(links, 'jaccard-label').select(F.col('node').alias('digest'), F.col('label').alias('found'))
    left = wide.select('digest', 'family', 'n', 'low').join(known, 'digest', 'left').withColumn(
        'label', F.coalesce('found', 'digest')).drop('found')
    again = scratch_table(place(left, ['family', 'label', 'low', 'n', 'digest'], 'jaccard-places'), 'jaccard-placed')
    held = packed.join(blocks.select('block').distinct(), 'block', 'left_semi')
    packed = scratch_table(pack(again.join(unpacked(held), 'digest')), 'jaccard-blocks')
    pairs = block_pairs(block_nodes(packed), percent)
    return links.union(links_within(packed, percent)).union(links_between(packed, pairs, percent))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, digest, n_shingles, component_id) of every document."""
    marks = scratch_table(shingle_sets(docs, shingle, percent), 'jaccard-marks')
    some = marks.filter('n > 0')
    sets = scratch_table(some.groupBy('h', 'digest').agg(
        F.min(F.struct('doc_id', 'text_hash')).alias('first'), F.min('doc_id').alias('least'),
        F.min('n').alias('n'), F.min('low').alias('low')), 'jaccard-distinct')
    in_family = scratch_table(sets.join(families(some), 'h'), 'jaccard-families')
    links = set_links(docs, in_family, shingle, percent)
    label = connected(links, 'jaccard-label').select(F.col('node').alias('of'), 'label')
    named = sets.join(label, F.col('digest') == F.col('of'), 'left').select(
        'digest', 'least', F.coalesce('label', 'digest').alias('label'))
    smallest = named.groupBy('label').agg(F.min('least').alias('component_id'))
    root = scratch_table(named.join(smallest, 'label').select(F.col('digest').alias('of'), 'component_id'), 'jaccard-roots')
    return marks.join(root, F.col('digest') == F.col('of'), 'left').select(
        'doc_id', 'text_hash', 'digest', F.col('n').alias('n_shingles'),
        F.when(F.col('n') == 0, F.col('doc_id')).otherwise(F.col('component_id')).alias('component_id'))
