"""Incremental ingest of chat exports.

The extraction and classification operators are row-local, so the same
functions run unchanged on a streaming DataFrame. New export files dropped
into a folder are picked up by the file source; counts per day/hour are
tumbling-window aggregates with a watermark that bounds late data and state.

Event time: `withWatermark` needs TIMESTAMP (not TIMESTAMP_NTZ). The naive
export time becomes the instant whose UTC wall clock it is (`event_time`), and
window bounds come back the same way (`naive_time`); neither depends on the
session time zone, so a one-day window is one naive calendar day everywhere.
"""

from __future__ import annotations

import os
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import dictionaries as D
from ..operators.classification import classify_rule_based
from ..operators.messages import qa_messages
from ..session import checkpoint_root
from ..sources.chat_csv import CREATED, RAW, qa_from_export, read_chat_csv


_EPOCH_NTZ = '1970-01-01 00:00:00'
#: Event time of the mark that ends a stream's input (see `window_run`).
END_OF_INPUT = '9999-01-01 00:00:00'
#: Landing files that one batch of the second stream of overlapping exports reads.
LANDING_FILES = 256


def event_time(c) -> Column:
    """Naive time -> TIMESTAMP for watermarks and windows, read as UTC whatever
    the session time zone. Whole seconds, as in the export format."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_seconds(F.unix_timestamp(c))


def naive_time(c) -> Column:
    """TIMESTAMP -> naive time (its UTC wall clock), the inverse of
    `event_time`, independent of the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    micros = F.unix_micros(c).cast('decimal(20,0)') / F.lit(1000000)
    return F.lit(_EPOCH_NTZ).cast('timestamp_ntz') + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), micros.cast('decimal(18,6)'))


#: The columns of Spark's file listing; `content` is never asked for.
_LISTING = 'path string, modificationTime timestamp, length bigint, content binary'


def arriving_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the paths of files arriving in `path`: (path,
    modificationTime, length). No file is opened."""
    r = spark.readStream.format('binaryFile').schema(_LISTING)
    if max_files_per_trigger:
        r = r.option('maxFilesPerTrigger', str(max_files_per_trigger))
    return r.load(path).select('path', 'modificationTime', 'length')


def _run(stream: DataFrame, base: str, write) -> None:
    q = (stream.writeStream.option('checkpointLocation', os.path.join(base, 'state'))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()


def export_schema(keep: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField('file', T.StringType()), T.StructField('modified', T.TimestampType())]
                        + [T.StructField(n, T.StringType()) for n in (CREATED, RAW, *keep)])


def ingest_exports(spark: SparkSession, path: str, base: str, keep: tuple[str, ...] = (),
                   max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Export rows (file, modified, Erstellt, Raw Chat Data, *keep) of all
    files that have arrived in `path`, as a table below `base` (J1).

    The stream carries paths only. Each micro-batch reads its files with the
    batch reader (`read_chat_csv`: Spark's CSV source, columns by each file's
    own header, `options` passed on), so a file is never one value and no row
    goes through Python. A batch overwrites its own folder: retried, it writes
    the same rows again. A later run with the same `base` takes up the files
    that came since.
    """
    out, schema = os.path.join(base, 'rows'), export_schema(keep)
    spark.createDataFrame([], schema).write.mode('ignore').parquet(os.path.join(out, 'batch=-1'))

    def write(batch: DataFrame, epoch: int) -> None:
        # at most maxFilesPerTrigger paths, which the driver has listed
        files = sorted(r['path'] for r in batch.select('path').collect())
        rows = read_chat_csv(batch.sparkSession, files, keep, modified=True, **options)
        rows.write.mode('overwrite').parquet(os.path.join(out, f'batch={epoch}'))

    _run(arriving_files(spark, path, max_files_per_trigger), base, write)
    return spark.read.schema(schema).parquet(out).select(*schema.fieldNames())


# ------------------------------------------------------------- overlapping exports

def row_key(keep: tuple[str, ...] = ()) -> Column:
    """Identity of an export row whatever file it comes from: a 128-bit hash
    of its columns, NULL and empty apart."""
    parts = [F.coalesce(F.concat(F.char_length(c).cast('string'), F.lit(':'), c), F.lit('-'))
             for c in (F.col(f'`{n}`').cast('string') for n in (CREATED, RAW, *keep))]
    return F.md5(F.concat(*parts).cast('binary'))


def first_arrivals(rows: DataFrame, arrival: str, within: str) -> DataFrame:
    """Streaming rows without those that repeat a row of the last `within` of
    arrival time (`dropDuplicatesWithinWatermark` on `row`): the state holds
    one key per row for that long."""
    return rows.withWatermark(arrival, within).dropDuplicatesWithinWatermark(['row'])


def ingest_overlapping_exports(spark: SparkSession, path: str, base: str, keep: tuple[str, ...] = (),
                               within: str = '1 day', max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Export rows of `path` where every new export repeats what earlier ones
    hold: each distinct row once, as (row, arrival, file, modified, Erstellt,
    Raw Chat Data, *keep, version) in a table below `base`.

    Two streams in turn. The first takes the files in (`ingest_exports`), into
    one folder per batch. The second reads those rows and drops repeats: the
    ones of the last `within` by keyed state, older ones by an anti join with
    the keys that the table already holds. The table itself is that durable
    key table, so rows and keys cannot fall apart, and since a retried batch
    overwrites its own folder and does not look into it, a restart after a
    failure at any point gives the same rows. Only keys are read back and
    shuffled, spread by their hash.

    A row that a later export has changed is a new row; `current_rows` picks
    the newest. One that is changed back counts as known: the table holds its
    first arrival.
    """
    landing = os.path.join(base, 'landing')
    ingest_exports(spark, path, landing, keep, max_files_per_trigger, **options)
    out = os.path.join(base, 'rows')
    body = [T.StructField('row', T.StringType()), T.StructField('arrival', T.TimestampType()), *export_schema(keep).fields]
    spark.createDataFrame([], T.StructType(body)).write.mode('ignore').parquet(os.path.join(out, 'version=-1'))
    stored = T.StructType([*body, T.StructField('version', T.LongType())])

    arrived = (spark.readStream.schema(export_schema(keep)).option('maxFilesPerTrigger', str(LANDING_FILES))
               .parquet(os.path.join(landing, 'rows', 'batch=*')))
    rows = arrived.select(row_key(keep).alias('row'), F.col('_metadata.file_modification_time').alias('arrival'), '*')

    def write(batch: DataFrame, epoch: int) -> None:
        held = (batch.sparkSession.read.schema(stored).parquet(out).filter(F.col('version') < epoch).select('row'))
        new = batch.join(held, 'row', 'left_anti')
        new.write.mode('overwrite').parquet(os.path.join(out, f'version={epoch}'))

    _run(first_arrivals(rows, 'arrival', within), base, write)
    return spark.read.schema(stored).parquet(out)


def current_rows(table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of rows with the same `key` the one from the newest export file: what a
    later export has changed replaces what it was. Found on narrow columns;
    the chats themselves only meet the row names that stay."""
    newest = table.groupBy(*key).agg(F.max(F.struct('modified', 'file', 'row')).alias('_newest'))
    return table.join(newest.select(F.col('_newest.row').alias('row')), 'row', 'left_semi')


def read_export_stream(spark: SparkSession, path: str, keep: tuple[str, ...] = (),
                       max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """Streaming export rows (file, Erstellt, Raw Chat Data, *keep) of the CSV
    files that have arrived in `path` (J1): they are taken in first
    (`ingest_exports`, into a folder named after path and columns, which a
    later call goes on with), and the stream reads the rows taken in."""
    name = zlib.crc32('\x1f'.join((path, *keep, *map(str, sorted(options.items())))).encode())
    base = stream_location(spark, f'landing-{name:08x}')
    ingest_exports(spark, path, base, keep, max_files_per_trigger, **options)
    rows = spark.readStream.schema(export_schema(keep)).parquet(os.path.join(base, 'rows', 'batch=*'))
    return rows.select('file', CREATED, f'`{RAW}`', *keep)


def qa_stream(rows: DataFrame, mode: str = 'compat') -> DataFrame:
    """Streaming QA rows (id, Datetime, Frage, Antwort, event_time)."""
    qa = qa_from_export(rows, mode=mode)
    return qa.withColumn('event_time', event_time('Datetime'))


def windowed_counts(qa: DataFrame, every: str = '1 day', lateness: str = '1 day',
                    time_col: str = 'event_time') -> DataFrame:
    """(window_start, window_end, Anzahl) per tumbling window (J2). The
    watermark lets Spark drop state for windows older than `lateness`."""
    return (qa.withWatermark(time_col, lateness)
            .groupBy(F.window(time_col, every).alias('w'))
            .agg(F.count(F.lit(1)).alias('Anzahl'))
            .select(F.col('w.start').alias('window_start'), F.col('w.end').alias('window_end'), 'Anzahl'))


def classified_stream(qa: DataFrame, dicts: D.Dictionaries = D.DEFAULT, matcher: str = 'aho') -> DataFrame:
    """Rule-based classification of every user/assistant message."""
    msgs = qa_messages(qa)
    return classify_rule_based(msgs, keep=('id', 'datetime'), dicts=dicts, matcher=matcher)


def stream_location(spark: SparkSession, name: str) -> str:
    """Checkpoint folder for a named stream under the shared checkpoint
    folder - the same path in every application, so a restarted stream
    resumes from its offsets and state."""
    return os.path.join(checkpoint_root(spark), 'streams', name)


def start(df: DataFrame, name: str, sink: str = 'parquet', path: str | None = None,
          output_mode: str = 'append', available_now: bool = True) -> StreamingQuery:
    """Start a stream with its checkpoint in the shared folder. With
    `available_now` it processes what has arrived and stops (batch-style
    incremental runs); restarts resume from the checkpoint."""
    w = (df.writeStream.outputMode(output_mode)
         .option('checkpointLocation', stream_location(df.sparkSession, name)))
    if sink == 'memory':
        w = w.format('memory').queryName(name)
    else:
        if path is None:
            raise ValueError('path is required for file sinks')
        w = w.format(sink).option('path', path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_message_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming flat messages (conv_id, turn, role, text) from Parquet files
    under `path` (J1 for message tables)."""
    schema = 'conv_id bigint, turn bigint, role string, text string'
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option('maxFilesPerTrigger', str(max_files_per_trigger))
    return r.parquet(path)


def run_to_table(df: DataFrame, name: str, output_mode: str = 'complete', base: str | None = None) -> DataFrame:
    """Run a stream over what has arrived (availableNow) and return its result
    table, read back from Parquet.

    Each micro-batch is written by the executors (`foreachBatch`). In
    complete mode every batch overwrites the table; in append mode each batch
    overwrites its own `batch=<id>` folder. Either way a retried batch is
    idempotent. State and result lie in `base`, which the caller may keep (a
    later run with it goes on where this one ended) or delete; by default it
    is a fresh folder below the shared checkpoint folder. The result starts
    out as an empty table, so whatever cannot be read later is an error.
    """
    spark = df.sparkSession
    base = base or stream_location(spark, f'{name}-{uuid.uuid4().hex}')
    out = os.path.join(base, 'result')
    seed = out if output_mode == 'complete' else os.path.join(out, 'batch=-1')
    spark.createDataFrame([], df.schema).write.mode('ignore').parquet(seed)

    def write(batch: DataFrame, epoch: int) -> None:
        # complete mode: each batch is the whole result; otherwise each batch
        # has its own folder. Both overwrite, so a retried batch is idempotent.
        if output_mode == 'complete':
            batch.write.mode('overwrite').parquet(out)
        else:
            batch.write.mode('overwrite').parquet(os.path.join(out, f'batch={epoch}'))

    q = (df.writeStream.outputMode(output_mode).option('checkpointLocation', os.path.join(base, 'state'))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def window_run(stream: DataFrame, base: str, every: str = '1 day', lateness: str = '1 day',
               time_col: str = 'event_time', last: bool = False) -> DataFrame:
    """One incremental run of `windowed_counts` in append mode (J2): all
    windows final so far, each counted once. State stays bounded by the
    watermark, and rows of windows that it has passed are dropped as late.
    Runs with the same `base` continue one another.

    The newest windows stay open, since the watermark follows the newest
    event. `last` ends the input: a mark far in the future is appended to a
    second source of the same stream and moves the watermark past every
    window (its own, never final, is not returned). Whatever arrives in a
    later run is late then.
    """
    spark = stream.sparkSession
    marks = os.path.join(base, 'end')
    schema = 'event_time timestamp'
    spark.createDataFrame([], schema).write.mode('ignore').parquet(marks)
    feed = stream.select(F.col(time_col).alias('event_time')).unionByName(
        spark.readStream.schema(schema).parquet(marks))
    counts = windowed_counts(feed, every, lateness)
    out = run_to_table(counts, 'windows', 'append', base)
    if not last:
        return out
    spark.range(1).select(F.lit(END_OF_INPUT).cast('timestamp').alias('event_time')).write.mode('append').parquet(marks)
    return run_to_table(counts, 'windows', 'append', base)
