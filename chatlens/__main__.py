"""Run the whole dashboard over chat exports and write every result table.

    python -m chatlens EXPORTS OUT_DIR [--search TERM] [--from DATE] [--to DATE]
                       [--latest N] [--top N] [--category LABEL] [--sentiment LABEL]
                       [--mode compat|robust] [--format parquet|json|csv]

EXPORTS is a CSV export file or a folder (or glob) of them. Each result goes
to OUT_DIR/<name> in the chosen format, written by the executors; the
classified latest messages also go to OUT_DIR/classified_json as JSON lines,
the form of the original's download. Under spark-submit the submitted
session is used; plain `python -m chatlens` starts a local one.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dictionaries as D
from .operators.features import add_features
from .plans.dashboard import dashboard
from .session import local_session
from .sources.chat_csv import qa_from_export, read_chat_csv
from .sources.export import write_classification_json


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog='python -m chatlens', description=__doc__.splitlines()[0])
    p.add_argument('exports', help='CSV export file, folder or glob')
    p.add_argument('out', help='output folder (one sub-folder per result)')
    p.add_argument('--search', default='', help='question search term (regular expression)')
    p.add_argument('--from', dest='start', default=None, help='first date, yyyy-MM-dd')
    p.add_argument('--to', dest='end', default=None, help='last date, yyyy-MM-dd')
    p.add_argument('--latest', type=int, default=20, help='latest messages to classify (5-50 in the original)')
    p.add_argument('--top', type=int, default=25, help='number of top keywords')
    p.add_argument('--category', default=D.ALL_FILTER, help='category filter of the detail table')
    p.add_argument('--sentiment', default=D.ALL_FILTER, help='sentiment filter of the detail table')
    p.add_argument('--mode', choices=('compat', 'robust'), default='compat', help='JSON decoding mode')
    p.add_argument('--format', choices=('parquet', 'json', 'csv'), default='parquet')
    return p.parse_args(argv)


def _csv_column(field: T.StructField):
    """CSV holds flat values only: string lists (the topics) go out ', '-joined
    as users see them, other nested values as JSON text."""
    c = F.col(f'`{field.name}`')
    t = field.dataType
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        return F.array_join(c, ', ').alias(field.name)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c).alias(field.name)
    return c


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    """Compute and write every result; returns {name: path}."""
    qa = add_features(qa_from_export(read_chat_csv(spark, args.exports), mode=args.mode))
    results = dashboard(qa, latest=args.latest, top_keywords=args.top, search=args.search,
                        start=args.start, end=args.end, category=args.category, sentiment=args.sentiment)
    written = {}
    for name, df in results.items():
        path = os.path.join(args.out, name)
        if args.format == 'csv':
            df = df.select(*[_csv_column(f) for f in df.schema.fields])
        w = df.write.mode('overwrite')
        if args.format == 'csv':
            w = w.option('header', 'true')
        getattr(w, args.format)(path)
        written[name] = path
    path = os.path.join(args.out, 'classified_json')
    write_classification_json(results['classified'], path, mode='overwrite')
    written['classified_json'] = path
    return written


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    active = SparkSession.getActiveSession()
    spark = active or (SparkSession.builder.getOrCreate() if os.environ.get('SPARK_ENV_LOADED')
                       else local_session())
    for name, path in run(spark, args).items():
        print(f'{name}\t{path}')


if __name__ == '__main__':
    main()
