"""Shared helpers: the word pattern, scratch tables and row-local bindings."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

#: A word is a run of anything but space and the ASCII controls 9-13.
WORD = r'[^\x20\x09-\x0D]+'
SPACE = r'[\x20\x09-\x0D]'
#: Rows per block of `ordered_block`, and the most blocks (their borders are a
#: literal of that many numbers).
BLOCK_ROWS, MAX_BLOCKS = 2000, 16384


def scratch_path(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder, one parent folder per
    application, so that a finished application's leavings go in one delete."""
    app = spark.sparkContext.applicationId
    return f'{checkpoint_root(spark).rstrip("/")}/llm/{app}/{name}-{uuid.uuid4().hex}'


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written to shared Parquet and read back.

    Cuts the lineage: a lost executor re-reads files, and what is computed
    once (row numbers, model inputs, tokens) cannot come out differently on a
    second evaluation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option('compression', 'zstd').parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that sorts and merges and is never broadcast.

    Spark takes rows out of `mapInArrow` or `explode` for as many as went in,
    and structs and texts for as large as their compressed files: a table many
    times the broadcast threshold would be collected by the driver.
    """
    return df.hint('merge')


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row (a lambda variable
    keeps the optimizer from copying the expression into every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_groups(docs, limit: int = 1 << 20):
    """Slices of a list of texts with at most about `limit` characters each
    (one longer text makes a slice of its own), so that working memory follows
    the limit and not the Arrow batch."""
    start, size = 0, 0
    for i, t in enumerate(docs):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(docs):
        yield start, len(docs)


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, texts) of slices of an Arrow string column with at most
    about `limit` bytes each (one longer text makes a slice of its own): the
    rest of the column stays in Arrow while a slice is worked on."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(column):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + limit, side='right')))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def prefix_sums(rows: DataFrame, key: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """(key, out): for each distinct non-negative integer key the sum of
    `value` over all smaller keys. Two levels, so no task sees more than
    `fan` keys or the number of keys divided by `fan`."""
    sums = (rows.groupBy(key).agg(F.sum(value).alias('_v'))
            .withColumn('_g', F.floor(F.col(key) / fan)))
    coarse = sums.groupBy('_g').agg(F.sum('_v').alias('_gv'))
    w_all = Window.orderBy('_g').rowsBetween(Window.unboundedPreceding, -1)
    w_in = Window.partitionBy('_g').orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select('_g', F.coalesce(F.sum('_gv').over(w_all), F.lit(0)).alias('_base'))
    return (sums.withColumn('_in', F.coalesce(F.sum('_v').over(w_in), F.lit(0)))
            .join(coarse, '_g').select(key, (F.col('_base') + F.col('_in')).alias(out)))


def numbered(rows: DataFrame, group: str, order: list, name: str, weight=None) -> DataFrame:
    """`rows` with `_no`, each row's number from 0 within its group in the
    given order (with `weight`: the sum of the weights in front of it).

    Rows are dealt to tasks by ranges of (group, order, a running number), so
    neither a large group nor a value that many rows share lands in one task.
    Each task numbers its own rows; what lies in front of a group's part in a
    task is summed over one row per task and group.
    """
    kept = scratch_table(rows.withColumn('_tie', F.monotonically_increasing_id()), name)
    w = F.lit(1).cast('long') if weight is None else weight.cast('long')
    at = F.monotonically_increasing_id()
    dealt = (kept.withColumn('_w', w).repartitionByRange(F.col(group), *order, F.col('_tie'))
             .sortWithinPartitions(F.col(group), *order, F.col('_tie')).withColumn('_at', at)
             .withColumn('_task', F.shiftright('_at', 33).cast('int')).drop('_tie'))
    dealt = scratch_table(dealt, name)
    parts = dealt.groupBy(F.col(group).alias('_g'), F.col('_task').alias('_t')).agg(
        F.sum('_w').alias('_sum'), F.min('_at').alias('_from'))
    ahead = Window.partitionBy('_g').orderBy('_t').rowsBetween(Window.unboundedPreceding, -1)
    # stored, so that its size (a row per task and group) is known to the join
    parts = scratch_table(parts.select('_g', '_t', '_from', F.coalesce(F.sum('_sum').over(ahead), F.lit(0)).alias('_base')),
                          name)
    if weight is None:
        inside = F.col('_at') - F.col('_from')
    else:
        in_task = Window.partitionBy('_task', group).orderBy('_at').rowsBetween(Window.unboundedPreceding, -1)
        dealt, inside = dealt.withColumn('_in', F.coalesce(F.sum('_w').over(in_task), F.lit(0))), F.col('_in')
    return (dealt.join(parts, F.col(group).eqNullSafe(F.col('_g')) & (F.col('_task') == F.col('_t')))
            .select(*rows.columns, (F.col('_base') + inside).alias('_no')))


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of all nodes of the links (u, v): the smallest node that
    is reachable. Each round sends every node to its smallest neighbour's
    smallest neighbour and keeps only the links that still join different
    nodes, so the rounds work on ever fewer links; the ways are put together
    backwards at the end."""
    def links(e):
        return scratch_table(e.filter('u <> v').select(F.least('u', 'v').alias('u'), F.greatest('u', 'v').alias('v'))
                             .distinct(), name)

    left, steps = links(edges), []
    while not steps or not left.isEmpty():
        both = left.union(left.select(F.col('v').alias('u'), F.col('u').alias('v')))
        low = scratch_table(both.groupBy(F.col('u').alias('node')).agg(F.min('v').alias('m'))
                            .select('node', F.least('node', 'm').alias('to')), name)
        onward = low.select(F.col('node').alias('at'), F.col('to').alias('next'))
        step = scratch_table(low.join(onward, F.col('to') == F.col('at')).select('node', F.col('next').alias('to')), name)
        steps.append(step)
        ends = [step.select(F.col('node').alias(c), F.col('to').alias(f'{c}_to')) for c in ('u', 'v')]
        left = links(left.join(ends[0], 'u').join(ends[1], 'v').select(F.col('u_to').alias('u'), F.col('v_to').alias('v')))
    label = steps.pop().select('node', F.col('to').alias('label'))
    for step in reversed(steps):
        onward = scratch_table(label.select(F.col('node').alias('at'), F.col('label').alias('last')), name)
        label = step.join(onward, F.col('to') == F.col('at'), 'left').select(
            'node', F.coalesce('last', 'to').alias('label'))
    return scratch_table(label, name)


def crc32_of_ids(raw: bytes, width: int) -> int:
    """Unsigned crc32 of ids given with `width` bytes each, as 32-bit ids."""
    return zlib.crc32(raw if width == 4 else np.frombuffer(raw, '<u2').astype('<u4').tobytes())


def ordered_block(rows: DataFrame, by: str, descending: bool = False,
                  block_rows: int = BLOCK_ROWS) -> tuple[Column, int]:
    """The number of a row's block in the order of an integer column, and the
    number of blocks. Blocks are of like size; equal values share a block,
    nulls come first (descending: last). Borders are approximate quantiles of that column alone, so the
    texts are not read to find them; any borders give the same results."""
    blocks = max(1, min(MAX_BLOCKS, -(-rows.count() // block_rows)))
    found = rows.agg(F.percentile_approx(by, [i / blocks for i in range(1, blocks)] or [0.5],
                                         10 * blocks).alias('b')).first()['b']
    borders = np.unique(np.array(found, dtype=np.int64)) if blocks > 1 and found else np.array([], np.int64)

    @F.pandas_udf(T.IntegerType())
    def block(x: pd.Series) -> pd.Series:
        at = np.where(x.isna(), -1, np.searchsorted(borders, x.fillna(0).to_numpy().astype(np.int64), side='left'))
        return pd.Series(len(borders) - at if descending else at + 1)

    return block(F.col(by).cast('long')), len(borders) + 2
