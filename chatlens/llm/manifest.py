"""Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf, every lang a tree with eight children a node over its
leaves in the order of their ids; the trees' roots are the leaves of one more
tree, whose root stands for the dataset.

A tree is stored as blocks: aligned subtrees of at most HEIGHT levels above
their leaves (4096 leaves). The roots of one round's blocks are the leaves of
the next round's, until one node is left. Within a block the nodes lie in van
Emde Boas order: the subtree is split at half its height, the upper part comes
first, then the lower parts from left to right, each laid out in the same way.
`address` turns (depth, index) into a place by arithmetic alone; the block is
built through it, level by level from the leaves, and siblings are fetched
through it.

A proof is put together from the top: a block's task adds the siblings of each
of its leaves to what is known of its own root, so the way to the root is
handed down from round to round and every document meets one block and one way.

Rows are numbered within a lang by ranges of (lang, id), not in one window, and
a block is the largest thing that a task holds; texts are read once and never
shuffled. Rounds grow with the logarithm of the largest lang to base 4096.

Edge cases: a null or empty text, lang or source is a value of its own; null
ids come first and are not tampered with; equal ids are ordered by their leaf,
identical rows are leaves of their own with equal digests; a lone row's leaf is
its tree's root, a lone lang's root the dataset's; an empty table gives no
rows; columns beyond the five are not hashed.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, scratch_table

FAN = 8
#: Levels of a block above its leaves: 8 ** 4 leaves.
HEIGHT = 4
FIELDS = ('doc_id', 'source', 'lang', 'n_chars', 'text')
_WIDTH = 32


# ------------------------------------------------------------------ layout

def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index):
    """Place of node `index` (a number or an array) at `depth` in the van Emde
    Boas layout of a full tree of `levels` levels: split at half height, the
    upper subtree first, then the lower ones."""
    base = 0
    while depth:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = depth - upper
        tree = index // FAN ** below
        base = base + tree_size(upper) + tree * tree_size(levels - upper)
        index, depth, levels = index - tree * FAN ** below, below, levels - upper
    return base + index


@lru_cache(maxsize=None)
def _addresses(levels: int) -> tuple:
    return tuple(address(levels, d, np.arange(FAN ** d)) for d in range(levels))


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while FAN ** h < n:
        h += 1
    return h


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).digest()


class Block:
    """A subtree over at most FAN ** height leaves, in van Emde Boas layout."""

    def __init__(self, height: int, count: int, store: np.ndarray):
        self.levels, self.height, self.store = height + 1, height, store
        self.counts = [count]  # nodes there are, from the leaves up
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // FAN))
        self.counts.reverse()

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        at = _addresses(height + 1)
        store = np.zeros((tree_size(height + 1), _WIDTH), np.uint8)
        block = cls(height, len(leaves), store)
        row = np.frombuffer(b''.join(leaves), np.uint8).reshape(-1, _WIDTH)
        store[at[height][:len(row)]] = row
        for depth in range(height - 1, -1, -1):
            text = store[at[depth + 1][:block.counts[depth + 1]]].tobytes().hex().encode()
            step = FAN * 2 * _WIDTH
            up = [digest(text[i:i + step]) for i in range(0, len(text), step)]
            store[at[depth][:len(up)]] = np.frombuffer(b''.join(up), np.uint8).reshape(-1, _WIDTH)
        return block

    def root(self) -> bytes:
        return self.store[0].tobytes()

    def level(self, depth: int) -> str:
        """The nodes of a level in hexadecimal, in order."""
        return self.store[_addresses(self.levels)[depth][:self.counts[depth]]].tobytes().hex()

    def siblings(self, index: int) -> list[tuple[str, str]]:
        """From a leaf up: the digests left and right of the way, by level."""
        out = []
        for depth in range(self.height, 0, -1):
            first = index - index % FAN
            end = min(first + FAN, self.counts[depth])
            at = address(self.levels, depth, np.arange(first, end))
            run = self.store[at].tobytes().hex()
            here = (index - first) * 2 * _WIDTH
            out.append((run[:here], run[here + 2 * _WIDTH:]))
            index //= FAN
        return out


def fold(node: str, way) -> str:
    """The root above a node, from the siblings on its way."""
    for left, right in way:
        node = hashlib.sha256((left + node + right).encode()).hexdigest()
    return node


# ------------------------------------------------------------------ leaves

def field(c: Column) -> Column:
    """`-` for a null, else its UTF-8 length, a colon and the value."""
    s = c.cast('string')
    return F.coalesce(F.concat(F.octet_length(s).cast('string'), F.lit(':'), s), F.lit('-'))


def leaf(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(row[c]) for c in FIELDS]).cast('binary'), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The trial change of a verification: A-Z lower-cased where the crc32 of
    the decimal id is a multiple of three; null elsewhere."""
    hit = F.crc32(doc_id.cast('string').cast('binary')) % 3 == 0
    upper = 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'
    return F.when(hit, F.translate(text, upper, upper.lower()))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, claimed): the tree's name sorts as the lang does
    (null first), `claimed` is the leaf that a verification is shown."""
    rows = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    own = {c: F.col(c) for c in FIELDS}
    changed = tampered_text(F.col('doc_id'), F.col('text'))
    rows = rows.withColumn('changed', changed)
    claimed = F.when(F.col('changed').isNotNull(), leaf({**own, 'text': F.col('changed')}))
    return rows.select('doc_id', F.coalesce(F.concat(F.lit('='), 'lang'), F.lit('')).alias('tree'),
                       leaf(own).alias('leaf'), claimed.alias('claimed')).withColumn(
        'claimed', F.coalesce('claimed', 'leaf'))


# ------------------------------------------------------------------ building

_BLOCK = T.StructType([
    T.StructField('tree', T.StringType()), T.StructField('block', T.LongType()), T.StructField('height', T.IntegerType()),
    T.StructField('count', T.IntegerType()), T.StructField('total', T.LongType()),
    T.StructField('root', T.StringType()), T.StructField('layout', T.BinaryType())])


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks over (tree, index, digest, total); a tree that fits one block
    gets just the levels that its leaves need."""
    def build(key, table):
        order = table.column('index').to_numpy().argsort()
        got = [bytes.fromhex(x) for x in table.column('digest').take(pa.array(order)).to_pylist()]
        total = table.column('total')[0].as_py()
        b = Block.build(got, height if total > FAN ** height else height_of(total))
        return pa.table({'tree': [key[0].as_py()], 'block': [key[1].as_py()], 'height': pa.array([b.height], pa.int32()),
                         'count': pa.array([len(got)], pa.int32()), 'total': pa.array([total], pa.int64()),
                         'root': [b.root().hex()], 'layout': pa.array([b.store.tobytes()], pa.binary())})

    rows = nodes.withColumn('block', F.floor(F.col('index') / FAN ** height)).select(
        'tree', 'block', 'index', 'digest', 'total')
    return rows.groupBy('tree', 'block').applyInArrow(build, _BLOCK)


def build_trees(nodes: DataFrame, name: str, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all trees over (tree, index, digest), round by round, and
    (tree, digest) of their roots. Blocks are written to shared Parquet."""
    rounds, done = [], []
    # stored, so that its size (a row per tree) is known to the join
    total = scratch_table(nodes.groupBy(F.col('tree').alias('_t')).agg(F.count(F.lit(1)).alias('total')), name)
    nodes = nodes.join(total, F.col('tree') == F.col('_t')).drop('_t')
    while True:
        made = scratch_table(_blocks(nodes, height), name)
        rounds.append(made)
        whole = F.col('total') <= FAN ** height
        done.append(made.filter(whole).select('tree', F.col('root').alias('digest')))
        rest = made.filter(~whole)
        if rest.isEmpty():
            break
        nodes = rest.select('tree', F.col('block').alias('index'), F.col('root').alias('digest'),
                            F.ceil(F.col('total') / FAN ** height).alias('total'))
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return rounds, roots


# ------------------------------------------------------------------ retrieval

_WAY = T.ArrayType(T.StructType([T.StructField('left', T.StringType()), T.StructField('right', T.StringType())]))


def _load(row) -> Block:
    store = np.frombuffer(row['layout'], np.uint8).reshape(-1, _WIDTH)
    return Block(row['height'], row['count'], store)


def ways(rounds: list[DataFrame], top: DataFrame, name: str, height: int = HEIGHT) -> DataFrame:
    """(tree, block, way): for each block of the first round the siblings from
    its root to the very top; `top` gives (tree, way) above the trees' roots."""
    schema = T.StructType([T.StructField('tree', T.StringType()), T.StructField('block', T.LongType()),
                           T.StructField('way', _WAY)])

    def descend(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(_WAY)
        for b in batches:
            for row in b.to_pylist():
                block, n = _load(row), row['count']
                out = [[{'left': a, 'right': z} for a, z in block.siblings(i)] + row['way'] for i in range(n)]
                first = row['block'] * FAN ** height
                yield pa.record_batch([pa.array([row['tree']] * n, pa.string()),
                                       pa.array(range(first, first + n), pa.int64()), pa.array(out, kind)],
                                      names=schema.fieldNames())

    known = None
    for made in reversed(rounds):
        # a tree ends in the one round in which it fits a block
        ends = made.filter(F.col('total') <= FAN ** height).select('tree', 'block').join(top, 'tree')
        known = ends if known is None else known.unionByName(ends)
        known = scratch_table(known.select('tree', 'block', 'way'), name)
        if made is rounds[0]:
            return known
        both = made.join(known, ['tree', 'block']).select('tree', 'block', 'height', 'count', 'layout', 'way')
        known = both.mapInArrow(descend, schema)


def top_ways(rounds: list[DataFrame], name: str, height: int = HEIGHT) -> DataFrame:
    """(index, way): the way from each leaf of a lone tree to its root."""
    spark = rounds[0].sparkSession
    none = spark.createDataFrame([('', [])], T.StructType([T.StructField('tree', T.StringType()),
                                                           T.StructField('way', _WAY)]))
    blocks = rounds[0].join(ways(rounds, none, name, height), ['tree', 'block']).select(
        'block', 'height', 'count', 'layout', 'way')
    schema = T.StructType([T.StructField('index', T.LongType()), T.StructField('way', _WAY)])

    def leaf_ways(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(_WAY)
        for b in batches:
            for row in b.to_pylist():
                block, n, first = _load(row), row['count'], row['block'] * FAN ** height
                out = [[{'left': a, 'right': z} for a, z in block.siblings(i)] + row['way'] for i in range(n)]
                yield pa.record_batch([pa.array(range(first, first + n), pa.int64()), pa.array(out, kind)],
                                      names=schema.fieldNames())

    return blocks.mapInArrow(leaf_ways, schema)


class Manifest:
    """A dataset's manifest: numbered leaves, the langs' blocks and roots, the
    blocks above the langs, and the dataset's root."""

    def __init__(self, docs: DataFrame, height: int = HEIGHT):
        self.height = height
        rows = numbered(leaves(docs), 'tree', [F.col('doc_id').asc_nulls_first(), F.col('leaf')], 'manifest-leaves')
        self.rows = scratch_table(rows.withColumnRenamed('_no', 'index'), 'manifest-rows')
        self.rounds, roots = build_trees(self.rows.select('tree', 'index', F.col('leaf').alias('digest')),
                                         'manifest-blocks', height)
        langs = numbered(roots.withColumn('all', F.lit('')), 'all', [F.col('tree')], 'manifest-langs')
        self.langs = scratch_table(langs.select('tree', F.col('digest').alias('subroot'), F.col('_no').alias('index')),
                                   'manifest-langs')
        self.top, self.root = build_trees(self.langs.select(
            F.lit('').alias('tree'), 'index', F.col('subroot').alias('digest')), 'manifest-top', height)

    def proofs(self) -> DataFrame:
        """(doc_id, tree, leaf, claimed, proof, folded): per row the siblings
        from its leaf to the dataset's root, joined, and the root that they
        give with the claimed leaf."""
        height = self.height
        above = scratch_table(self.langs.join(top_ways(self.top, 'manifest-ways', height), 'index').select('tree', 'way'),
                              'manifest-ways')
        known = ways(self.rounds, above, 'manifest-ways', height)
        blocks = self.rounds[0].join(known, ['tree', 'block']).select('tree', 'block', 'height', 'count', 'layout', 'way')
        rows = self.rows.withColumn('block', F.floor(F.col('index') / FAN ** height))
        schema = T.StructType([
            self.rows.schema['doc_id'], T.StructField('tree', T.StringType()), T.StructField('leaf', T.StringType()),
            T.StructField('proof', T.StringType()), T.StructField('folded', T.StringType())])

        def walk(key, left, right):
            row = right.to_pylist()[0]
            block, above = _load(row), [(w['left'], w['right']) for w in row['way']]
            upper = ''.join(a + z for a, z in above)
            n = left.num_rows
            proof, folded = [], []
            first = row['block'] * FAN ** height
            for i, claimed in zip(left.column('index').to_pylist(), left.column('claimed').to_pylist()):
                way = block.siblings(i - first)
                proof.append(hashlib.sha256((''.join(a + z for a, z in way) + upper).encode()).hexdigest())
                folded.append(fold(fold(claimed, way), above))
            return pa.table([left.column('doc_id'), pa.array([row['tree']] * n, pa.string()), left.column('leaf'),
                             pa.array(proof, pa.string()), pa.array(folded, pa.string())], names=schema.fieldNames())

        return rows.groupBy('tree', 'block').cogroup(blocks.groupBy('tree', 'block')).applyInArrow(walk, schema)

    def verdicts(self) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
        top = self.root.first()  # one digest
        root = F.lit(top['digest'] if top else None).cast('string')
        return self.proofs().join(self.langs.select('tree', 'subroot'), 'tree').select(
            'doc_id', 'leaf', 'subroot', root.alias('root'), F.col('proof').alias('proof_sha256'),
            F.col('folded').alias('folded_root'), (F.col('folded') == root).alias('verified'))
