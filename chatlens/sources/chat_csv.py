"""Chat-export CSV files -> QA rows.

A multi-line CSV file cannot be split, so each file is read by one task; a
directory of exports is read in parallel, one task per file. For repeated
analysis convert once with `to_bronze` and work from Parquet.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_created
from ..operators.extract import extract_qa_json, extract_qa_segments

CREATED = 'Erstellt'
RAW = 'Raw Chat Data'
CSV_OPTIONS = {'header': 'true', 'multiLine': 'true', 'quote': '"', 'escape': '"',
               'encoding': 'UTF-8', 'mode': 'PERMISSIVE', 'inferSchema': 'false'}
#: Header reads that run side by side.
HEADER_JOBS = 16


def read_chat_csv(spark: SparkSession, path, keep: tuple[str, ...] = (), same_header: bool = False,
                  modified: bool = False, **options) -> DataFrame:
    """Export rows as (file, Erstellt, Raw Chat Data, *keep), with `modified`
    also the time (`modified`) of the last change of the row's file; columns found by
    each file's own header name; a missing column reads as NULL, other columns
    are ignored unless named in `keep`, and of a name that occurs twice the
    last column counts. Files with the same header are read together, so
    exports of several versions can lie in one folder. `path` is a folder, a
    file, a glob or a list of those.

    Each file is read once: only its first record is fetched ahead, to find the
    columns (`same_header`: only that of the first file, for folders known to
    hold one version). `options` are Spark's CSV options (`sep`, `quote`,
    `encoding`, ...) and hold for both.

    Undecodable bytes come through as U+FFFD and are removed, as the original
    reads with errors='ignore'.
    """
    wanted = (CREATED, RAW, *keep)
    options = {**CSV_OPTIONS, **options}
    stamp = [F.col('_metadata.file_modification_time').alias('modified')] if modified else []

    def read(header: tuple[str, ...], files: list[str]) -> DataFrame:
        at = {n: i for i, n in enumerate(header)}  # the last of equal names stays
        raw = (spark.read.schema(T.StructType([T.StructField(f'c{i}', T.StringType()) for i in range(len(header))]))
               .options(**{**options, 'header': 'true', 'enforceSchema': 'true'}).csv(files))
        return raw.select(F.col('_metadata.file_path').alias('file'), *stamp, *[
            (F.translate(F.col(f'c{at[n]}'), '�', '') if n in at else F.lit(None).cast('string')).alias(n)
            for n in wanted])

    frames = [read(h, files) for h, files in sorted(file_headers(spark, path, same_header, **options).items())]
    if not frames:
        fields = [T.StructField(n, T.StringType()) for n in ('file', *wanted)]
        fields[1:1] = [T.StructField('modified', T.TimestampType())] if modified else []
        return spark.createDataFrame([], T.StructType(fields))
    return reduce(DataFrame.unionByName, frames)


def export_files(spark: SparkSession, path) -> list[str]:
    """The files below `path`, by Spark's own listing; none is opened."""
    found = spark.read.format('binaryFile').load(path).select('path')
    return sorted(r['path'] for r in found.collect())


def file_headers(spark: SparkSession, path, same_header: bool = False, **options) -> dict[tuple[str, ...], list[str]]:
    """The distinct headers below `path` and the files that have them.

    A file's header is its first record in Spark's own CSV reader under the
    given options, so any separator, quoting or line break in a quoted name
    is read as it will be. The reader stops behind that record; a few small
    jobs run side by side.
    """
    options = {**CSV_OPTIONS, **options, 'header': 'false'}

    def header(file: str) -> tuple[str, ...]:
        first = spark.read.options(**options).csv(file).first()
        return tuple((v or '').lstrip('\ufeff').replace('�', '') for v in first) if first else ()

    files = export_files(spark, path)
    found = defaultdict(list)
    if same_header and files:
        found[header(files[0])] = files
    else:
        with ThreadPoolExecutor(HEADER_JOBS) as pool:
            for file, names in zip(files, pool.map(header, files)):
                found[names].append(file)
    found.pop((), None)  # an empty file has no rows either
    return dict(found)


def write_export_csv(rows: DataFrame, path: str, mode: str = 'errorifexists') -> None:
    """Write export rows in the export's CSV form: header, comma, fields with
    commas, quotes or line breaks quoted, quotes doubled. Written by the
    executors, one file per partition."""
    (rows.write.mode(mode).option('header', 'true').option('quote', '"').option('escape', '"')
     .option('encoding', 'UTF-8').csv(path))


def with_reject_reason(rows: DataFrame) -> DataFrame:
    """Adds `Datetime` and `reason` (NULL for rows that go on to extraction):
    empty_created, header_row, bad_timestamp, empty_chat (B1-B3, B12)."""
    created, raw = F.col(f'`{CREATED}`'), F.col(f'`{RAW}`')
    ts = parse_created(created)
    reason = (F.when(created.isNull() | (created == ''), 'empty_created')
              .when(created == CREATED, 'header_row')
              .when(ts.isNull(), 'bad_timestamp')
              .when(raw.isNull() | (raw == ''), 'empty_chat'))
    return rows.select('*', ts.alias('Datetime'), reason.alias('reason'))


def row_id():
    """Stable id of an export row: hash of file, timestamp text and chat text
    (row numbers are not stable across runs)."""
    return F.xxhash64(F.col('file'), F.col(f'`{CREATED}`'), F.col(f'`{RAW}`'))


def qa_from_export(rows: DataFrame, mode: str = 'compat', keep: tuple[str, ...] = ()) -> DataFrame:
    """Export rows -> (id, Datetime, *keep, Frage, Antwort); every bad row is
    dropped silently, as in the original (`rejects` returns them)."""
    ok = with_reject_reason(rows).filter(F.col('reason').isNull())
    return extract_qa_json(ok.withColumn('id', row_id()), raw_col=RAW, mode=mode, keep=keep)


def qa_from_segmented_export(rows: DataFrame, id_col: str = 'conv_id', segment_col: str = 'segment',
                             mode: str = 'compat') -> DataFrame:
    """Export rows that hold bounded segments of a conversation (columns
    `id_col`, `segment_col` next to the export's two) -> (id, Datetime, Frage,
    Antwort). The same row checks as `qa_from_export`, then the segment merge
    (`extract_qa_segments`). The id keeps its type (CSV gives text, so any id
    works); the segment number must be integral, as it orders the segments."""
    ok = with_reject_reason(rows).filter(F.col('reason').isNull())
    ok = ok.select(F.col(id_col), F.col(segment_col).cast('bigint').alias(segment_col), 'Datetime',
                   F.col(f'`{RAW}`'))
    return extract_qa_segments(ok, raw_col=RAW, id_col=id_col, segment_col=segment_col, mode=mode)


def rejects(rows: DataFrame, mode: str = 'compat', keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows the original drops without a word, with the reason:
    (id, *keep, Erstellt, Raw Chat Data, reason); 'no_question' when extraction found
    nothing. One row-local pass: the extraction carries the raw columns, so
    no second read and no join."""
    tagged = with_reject_reason(rows).withColumn('id', row_id())
    checked = extract_qa_json(tagged, raw_col=RAW, mode=mode, keep_rejects=True,
                              keep=(*keep, CREATED, RAW, 'reason'))
    reason = F.coalesce(F.col('reason'), F.when(F.col('Frage').isNull(), F.lit('no_question')))
    return (checked.select('id', *keep, F.col(f'`{CREATED}`'), F.col(f'`{RAW}`'), reason.alias('reason'))
            .filter(F.col('reason').isNotNull()))


def to_bronze(spark: SparkSession, path: str, out: str, mode: str = 'overwrite') -> None:
    """One-off conversion of export CSVs to Parquet (splittable, prunable)."""
    read_chat_csv(spark, path).write.mode(mode).parquet(out)
