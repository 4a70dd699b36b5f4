"""Token ids in ORC: ordered by document id, bloom-filtered, read back.

One row per document with its ids as integers, which ORC stores run-length
encoded in stripes; files and rows ascend by document id, row indexes and a
Bloom filter on `doc_id` let a reader skip stripes and row groups. `start` in
the file counts from the file's first id, so a lost task writes the same file
again; the number of ids in front of each file comes from the files' own
`n_tokens` column.

Edge cases: a null text is empty (its end id alone); null ids come first;
equal ids are ordered by their text, identical rows in any order; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_of_ids, ordered_block, prefix_sums, scratch_path, scratch_table, text_groups
from .tokens import encoder, forget

STRIPE_BYTES = 32 << 20
INDEX_STRIDE = 1000
FILE_DOCS = 8000
BLOOM_FPP = 0.01


def _schema(doc_type) -> T.StructType:
    return T.StructType([
        T.StructField('part', T.IntegerType()), T.StructField('doc_id', doc_type),
        T.StructField('start_in_part', T.LongType()), T.StructField('n_tokens', T.LongType()),
        T.StructField('ids', T.ArrayType(T.IntegerType()))])


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text, write the ids to `path`, return the files' rows."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    # a partition and so a file per block of ids, in order
    block, n = ordered_block(src, 'doc_id', block_rows=FILE_DOCS)
    ordered = (src.withColumn('block', block).repartitionById(n, 'block').drop('block')
               .sortWithinPartitions('doc_id', 'text'))
    schema = _schema(src.schema['doc_id'].dataType)

    def encode(batches):
        part, enc, at = TaskContext.get().partitionId(), encoder(tokenizer), 0
        end = int(end_id).to_bytes(enc.width, 'little')
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_groups(texts, 1 << 21):
                raw = [x + end for x in enc.encode(texts[lo:hi])]
                n = np.array([len(x) // enc.width for x in raw], np.int64)
                upto = np.cumsum(n)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], upto)).astype(np.int32)),
                    pa.array(np.frombuffer(b''.join(raw), enc.dtype).astype(np.int32)))
                yield pa.record_batch([
                    pa.array(np.full(hi - lo, part, np.int32)), b.column(0).slice(lo, hi - lo),
                    pa.array(at + upto - n), pa.array(n), ids], names=schema.fieldNames())
                at += int(upto[-1])

    (ordered.mapInArrow(encode, schema).write
     .option('compression', 'zstd').option('orc.stripe.size', STRIPE_BYTES)
     .option('orc.create.index', True).option('orc.row.index.stride', INDEX_STRIDE)
     .option('orc.bloom.filter.columns', 'doc_id').option('orc.bloom.filter.fpp', BLOOM_FPP)
     .orc(path))
    return docs.sparkSession.read.schema(schema).orc(path)


def read_token_orc(spark, path: str, doc_ids=None) -> DataFrame:
    """The files' rows; with `doc_ids` only those documents, by a filter that
    reaches the stripe statistics and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col('doc_id').isin(list(doc_ids)))


def token_index(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids before each document over all files."""
    # stored, so that its size (a row per file) is known to the join
    base = scratch_table(prefix_sums(rows.select('part', 'n_tokens'), 'part', 'n_tokens', 'base'), 'token-parts')
    return rows.join(base, 'part').select(
        'doc_id', (F.col('base') + F.col('start_in_part')).alias('start'), 'n_tokens', 'ids')


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write, read back, and digest each document's ids as read."""
    rows = write_token_orc(docs, scratch_path(docs.sparkSession, 'token-orc'), tokenizer, end_id)
    indexed = token_index(rows)
    schema = T.StructType([*indexed.schema.fields[:3], T.StructField('ids_crc32', T.LongType())])

    def digest(batches):
        forget()
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy().astype('<u4').tobytes()
            at = np.concatenate(([0], np.cumsum(b.column(2).to_numpy()))) * 4
            crc = [crc32_of_ids(flat[i:j], 4) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                                  names=schema.fieldNames())

    return indexed.mapInArrow(digest, schema)
