"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of packets: its documents' tokens, cut into at most
`packet` tokens. Every round (one per window) a queue earns
`share * window` tokens of credit, keeps what it could not spend, and sends its
head packet once the credit covers it. So the packet that ends at token c of
its queue is sent in round `ceil((c - phase) / (share * window)) - 1`: the
deficits need no serial loop, only the packet's place in its queue. `phase`
spreads the queues' first packets over a packet's length, so that queues of
like shares do not send in the same rounds. The rounds in a row are cut into
windows of `window` tokens; only the last one is shorter.

Places in queues and in the stream are two-level prefix sums (per scan task
and source; per block of rounds), so a source with a third of all rows is
spread like any other and no task holds more than a block.

Edge cases: a null text is an empty one, a null source is a queue of its own;
every document has at least its end id; repeated rows and equal ids are packed
as often as they occur; an empty table gives no rows; other columns are not
read. The order inside a queue is the order of the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of_ids, prefix_sums, scratch_table, text_slices
from .tokens import CACHE_PIECES, encoder, forget

WINDOW = 1024
PACKET = 256
#: Rounds whose packets are put in order in one task (256 windows of tokens).
BLOCK_ROUNDS = 256
#: Bytes of text a worker encodes at a time.
GROUP_BYTES = 1 << 19
GOLDEN = 0.6180339887498949


def cut_batches(batches, part: int, enc, end_id: int, packet: int):
    """Batches of packets from a task's batches (doc_id, source, text). Of a
    batch's texts only a slice at a time is taken out of Arrow and encoded, so
    a worker's memory follows `GROUP_BYTES` and not the batch."""
    w, queue = enc.width, {}
    end = int(end_id).to_bytes(w, 'little')
    for b in batches:
        doc, source = b.column(0), b.column(1).to_pylist()
        for lo, texts in text_slices(b.column(2), GROUP_BYTES):
            at, cols = [], [[], [], [], [], [], []]
            for i, ids in enumerate(enc.encode(texts), lo):
                ids += end
                n, until = len(ids) // w, queue.get(source[i], 0)
                for s in range(0, n, packet):
                    k = min(packet, n - s)
                    until += k
                    at.append(i)
                    for c, v in zip(cols, (source[i], n, s, k, until, ids[s * w:(s + k) * w])):
                        c.append(v)
                queue[source[i]] = until
            m = len(at)
            yield pa.record_batch([
                pa.array([part] * m, pa.int32()), pa.array(cols[0], pa.string()), doc.take(pa.array(at, pa.int64())),
                *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array([w] * m, pa.int32()),
                pa.array(cols[5], pa.binary())],
                names=['part', 'source', 'doc_id', 'doc_tokens', 'start', 'length', 'until', 'width', 'ids'])


def packets(docs: DataFrame, tokenizer: str, end_id: int, packet: int = PACKET,
            cache: int = CACHE_PIECES) -> DataFrame:
    """(part, source, doc_id, doc_tokens, start, length, until, width, ids): the
    documents' packets; `until` counts the source's tokens of this scan task
    up to the packet's end. Stored, since the place in the queue is read
    again and must not change."""
    src = docs.select(F.col('doc_id'), F.col('source').cast('string').alias('source'),
                      F.coalesce('text', F.lit('')).alias('text'))
    doc_type = src.schema['doc_id'].dataType
    schema = T.StructType([
        T.StructField('part', T.IntegerType()), T.StructField('source', T.StringType()),
        T.StructField('doc_id', doc_type), T.StructField('doc_tokens', T.LongType()),
        T.StructField('start', T.LongType()), T.StructField('length', T.LongType()),
        T.StructField('until', T.LongType()), T.StructField('width', T.IntegerType()),
        T.StructField('ids', T.BinaryType())])

    def cut(batches):
        return cut_batches(batches, TaskContext.get().partitionId(), encoder(tokenizer, cache), end_id, packet)

    return scratch_table(src.mapInArrow(cut, schema), 'packets')


def pack_mixture(docs: DataFrame, tokenizer: str, end_id: int, targets: dict | None = None,
                 window: int = WINDOW, packet: int = PACKET, cache: int = CACHE_PIECES) -> DataFrame:
    """Pieces (doc_id, source, doc_tokens, start, length, sequence_id, offset,
    width, ids) of all documents in windows of `window` tokens.

    `targets` maps sources to weights (others weigh 0 and follow at the end);
    by default each source's share of all tokens, with which all queues run dry
    in the last window. A queue that runs dry early leaves its credit to the
    others.
    """
    t = packets(docs, tokenizer, end_id, packet, cache)
    by_part = t.groupBy('part', 'source').agg(F.sum('length').alias('n'))
    queues = by_part.groupBy('source').agg(F.sum('n').alias('queue'))
    all_sources = Window.orderBy(F.col('source').asc_nulls_last())
    weight = F.col('queue').cast('double')
    if targets is not None:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]),
                                         F.col('source')).cast('double'), F.lit(0.0))
    total = queues.agg(F.sum(weight).alias('total'))
    queues = queues.select('source', 'queue', weight.alias('weight'), F.row_number().over(all_sources).alias('rank'))
    earlier = Window.partitionBy('source').orderBy('part').rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select('part', 'source', F.coalesce(F.sum('n').over(earlier), F.lit(0)).alias('base'))
    # one row per scan task and source; the one-row total is a scalar
    share = queues.join(F.broadcast(total)).select(
        'source', 'rank', F.coalesce(F.try_divide('weight', 'total') * window, F.lit(0.0)).alias('credit'))
    place = base.alias('b').join(share.alias('q'), F.col('b.source').eqNullSafe(F.col('q.source'))).select(
        'part', F.col('b.source').alias('source'), 'base', 'rank', 'credit')
    # stored, so that its size is known when the join with the packets is planned
    place = scratch_table(place, 'packet-places')
    late = F.lit(1 << 40)  # queues without a share send after all others
    end = F.col('base') + F.col('until')
    phase = (F.col('rank') * GOLDEN) % 1.0 * packet
    turn = (F.when(F.col('credit') > 0, F.greatest(F.lit(0), F.ceil((end - phase) / F.col('credit')) - 1))
            .otherwise(late + F.floor(end / window)))
    sent = (t.alias('t').join(place.alias('p'), (F.col('t.part') == F.col('p.part'))
                              & F.col('t.source').eqNullSafe(F.col('p.source')))
            .select('t.doc_id', 't.source', 'doc_tokens', 'start', 'length', 'width', 'ids', 'rank',
                    end.alias('until'), turn.cast('long').alias('turn'))
            .withColumn('block', F.floor(F.col('turn') / BLOCK_ROUNDS)))
    blocks = scratch_table(prefix_sums(sent.select('block', 'length'), 'block', 'length', 'block_base'), 'packet-blocks')
    order = Window.partitionBy('block').orderBy('turn', 'rank', 'until').rowsBetween(Window.unboundedPreceding, 0)
    stream = (sent.join(blocks, 'block')
              .withColumn('to', F.col('block_base') + F.sum('length').over(order))
              .withColumn('from', F.col('to') - F.col('length')))
    first, last = F.floor(F.col('from') / window), F.floor((F.col('to') - 1) / window)
    cut = stream.withColumn('sequence_id', F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col('from'), F.col('sequence_id') * window)
    hi = F.least(F.col('to'), (F.col('sequence_id') + 1) * window)
    skip = (lo - F.col('from')).cast('int')
    size = (hi - lo).cast('int')
    return cut.select('doc_id', 'source', 'doc_tokens', (F.col('start') + skip).alias('start'),
                      size.cast('long').alias('length'), 'sequence_id',
                      (lo - F.col('sequence_id') * window).alias('offset'), 'width',
                      F.substr('ids', skip * F.col('width') + 1, size * F.col('width')).alias('ids'))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    names = ['doc_id', 'start', 'length', 'ids_crc32', 'doc_tokens', 'sequence_id', 'offset', 'source']
    keep = pieces.select('doc_id', 'start', 'length', 'doc_tokens', 'sequence_id', 'offset', 'source', 'width', 'ids')
    schema = T.StructType([keep.schema[n] if n != 'ids_crc32' else T.StructField(n, T.LongType()) for n in names])

    def digest(batches):
        forget()
        for b in batches:
            crc = pa.array([crc32_of_ids(x, w) for x, w in zip(b.column('ids').to_pylist(),
                                                               b.column('width').to_pylist())], pa.int64())
            yield pa.record_batch([crc if n == 'ids_crc32' else b.column(n) for n in names], names=names)

    return keep.mapInArrow(digest, schema)
