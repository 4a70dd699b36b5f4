"""Merkle fingerprints of documents: sections over paragraphs over phrases.

The leaves are phrases: runs of words with their white space that end behind a
word whose hash is a multiple of 8, and with their line. A paragraph is a line
with its line break. A section ends at a blank line, and after any paragraph
whose node's first byte is a multiple of 8, so flat texts have sections too and
an edit moves no border but its own. A leaf's node is the 128-bit BLAKE2b of
its bytes, every other node hashes its children's nodes: equal roots mean equal
texts, and walking down branches with different nodes finds the edits.

A fingerprint is the root in hexadecimal, the number of words (white space in
front of a line's first word counts as one), then the tree: sections joined by
`;`, their paragraphs by `,`, their leaves by `.`; a leaf is 8 digits of its
node and its number of words in hexadecimal. It is about a quarter as long as
the text. `likeness` needs nothing else: sections that both trees have are common,
the others are opened into paragraphs, and what then differs into leaves; it is
2 * common words / (words of both), and less than 1 unless the roots are equal.

Edge cases: a null text is an empty one (one empty paragraph); repeated rows
have equal trees; documents with one id follow each other by their text; null
ids come last in descending order; a lone document is its own next one; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ordered_block, scratch_table

#: A word with the white space behind it, at most up to its line's break; white
#: space in front of a line's first word is a piece of its own.
_PIECES = re.compile(rb'[^\x20\x09-\x0d]+[\x20\x09\x0b-\x0d]*\n?|[\x20\x09\x0b-\x0d]+\n?|\n')
#: A phrase ends behind a word whose hash has these bits zero.
PHRASE_BITS = 7


def _node(parts: bytes) -> bytes:
    return hashlib.blake2b(parts, digest_size=16).digest()


class Tree:
    """Root, sections (node, first paragraph, end), paragraph nodes, and each
    paragraph's leaves as written in a fingerprint."""

    __slots__ = ('root', 'sections', 'paragraphs', 'leaves', 'words')

    def __init__(self, text: str):
        raw = text.encode('utf-8', 'surrogatepass')
        pieces = _PIECES.findall(raw)
        n = self.words = len(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, n))
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, n)
        breaks = np.frombuffer(raw, np.uint8)[ends - 1] == 10
        last = (h & np.uint64(PHRASE_BITS) == 0) | breaks
        if n:
            last[-1] = True
        at = np.flatnonzero(last)
        words = np.diff(at, prepend=-1).tolist()
        self.sections, self.paragraphs, self.leaves = [], [], []
        nodes, shown, opened, blank, start = [], [], 0, True, 0
        for end, size, line_ends in zip(ends[at].tolist(), words, breaks[at].tolist()):
            phrase = raw[start:end]
            node = _node(phrase)
            nodes.append(node)
            shown.append(f'{node[:4].hex()}{size:x}')
            blank = blank and phrase.isspace()
            start = end
            if line_ends:
                opened = self._close(nodes, shown, blank, opened)
                nodes, shown, blank = [], [], True
        # the last line, empty behind a final line break, ends the last section
        self._close(nodes, shown, True, opened)
        self.root = _node(b''.join(x for x, _, _ in self.sections))

    def _close(self, nodes, shown, blank, opened) -> int:
        """Ends a paragraph, and its section if it is blank; the first
        paragraph of the section that is open now."""
        node = _node(b''.join(nodes))
        self.paragraphs.append(node)
        self.leaves.append('.'.join(shown))
        if blank or node[0] % 8 == 0:
            end = len(self.paragraphs)
            self.sections.append((_node(b''.join(self.paragraphs[opened:end])), opened, end))
            return end
        return opened

    def fingerprint(self) -> str:
        return f'{self.root.hex()}:{self.words}:' + ';'.join(','.join(self.leaves[a:b]) for _, a, b in self.sections)

    def edits(self, other: Tree) -> list[int]:
        """Paragraphs of this text below sections that the other lacks and
        that the other lacks themselves."""
        theirs, nodes = {x for x, _, _ in other.sections}, set(other.paragraphs)
        return [i for x, a, b in self.sections if x not in theirs
                for i in range(a, b) if self.paragraphs[i] not in nodes]


def _words(leaves: str) -> int:
    """Words of the leaves below a section or paragraph, or of one leaf."""
    return sum(int(x[8:], 16) for x in leaves.replace(',', '.').split('.') if x)


def likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints, from their common nodes alone."""
    root, m, a = one.split(':')
    other, n, b = two.split(':')
    if root == other:
        return 1.0
    total, common = int(m) + int(n), 0
    left, right = [a], [b]
    for border in (';', ',', '.'):
        left, right = ([y for x in side for y in x.split(border)] for side in (left, right))
        both = set(left).intersection(right)
        if both:
            mine, theirs = (Counter(x for x in side if x in both) for side in (left, right))
            common += sum(min(mine[node], theirs[node]) * _words(node) for node in both)
            left = [x for x in left if x not in both] + list((mine - theirs).elements())
            right = [x for x in right if x not in both] + list((theirs - mine).elements())
    # the same leaves in another order are not the same text
    return min(2 * common, total - 1) / total if total else 0.0


def merkle_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections, paragraphs): every node of each document's tree
    in hexadecimal, for equality tests and for locating edits by joins."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    schema = T.StructType([src.schema['doc_id'], T.StructField('root', T.StringType()),
                           T.StructField('sections', T.ArrayType(T.StringType())),
                           T.StructField('paragraphs', T.ArrayType(T.StringType()))])

    def nodes(batches):
        for b in batches:
            trees = [Tree(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([
                b.column(0), pa.array([t.root.hex() for t in trees], pa.string()),
                pa.array([[x.hex() for x, _, _ in t.sections] for t in trees], pa.list_(pa.string())),
                pa.array([[x.hex() for x in t.paragraphs] for t in trees], pa.list_(pa.string()))],
                names=schema.fieldNames())

    return src.mapInArrow(nodes, schema)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, edit_paragraphs (number of its
    paragraphs that the edited text lacks).

    Each block of ids is read in order by one task, which also gets the next
    block's first document; the texts are shuffled once.
    """
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    rows = src.withColumn('block', ordered_block(src, 'doc_id', descending=True)[0])
    # the first id of each block, and the block in front of it
    heads = rows.groupBy('block').agg(F.max('doc_id').alias('top'))
    in_order = Window.orderBy('block')
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col('block').alias('of'), 'top',
                         F.coalesce(F.lag('block').over(in_order), F.max('block').over(whole)).alias('for'))
    # stored, so that its size (a row per block) is known to the join
    heads = scratch_table(heads, 'merkle-heads')
    guests = (rows.join(heads, (F.col('block') == F.col('of')) & F.col('doc_id').eqNullSafe(F.col('top')))
              .select('doc_id', 'text', F.col('for').alias('block'), F.lit(True).alias('guest')))
    every = rows.withColumn('guest', F.lit(False)).unionByName(guests)
    ordered = every.repartition('block').sortWithinPartitions(
        'block', 'guest', F.col('doc_id').desc_nulls_last(), 'text')
    schema = T.StructType([
        src.schema['doc_id'], T.StructField('n_chars', T.LongType()), T.StructField('edited_sha256', T.StringType()),
        T.StructField('fingerprint', T.StringType()), T.StructField('edited_fingerprint', T.StringType()),
        T.StructField('near_edited', T.DoubleType()), T.StructField('near_next', T.DoubleType()),
        T.StructField('edit_paragraphs', T.IntegerType())])

    def compare(doc_id, text, tree, after, after_tree):
        h = len(text) // 2
        edited = text[:len(text) - h] + after[:h]
        t = Tree(edited)
        shown = t.fingerprint()
        return (doc_id, len(text), hashlib.sha256(edited.encode('utf-8', 'surrogatepass')).hexdigest(),
                tree[1], shown, likeness(tree[1], shown), likeness(tree[1], after_tree[1]), len(tree[0].edits(t)))

    def walk(batches):
        held = None  # the document that waits for its next one
        out, done = [], None
        for b in batches:
            for doc_id, text, block, guest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if guest and block == done:
                    continue
                tree = Tree(text)
                tree = tree, tree.fingerprint()
                if held is not None:
                    out.append(compare(*held, text, tree))
                held, done = (None, block) if guest else ((doc_id, text, tree), done)
                if len(out) >= 2000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return ordered.mapInArrow(walk, schema)


def _batch(rows, schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return pa.RecordBatch.from_pylist([dict(zip(schema.fieldNames(), r)) for r in rows], to_arrow_schema(schema))
