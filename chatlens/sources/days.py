"""QA rows in a table partitioned by day.

A search between two dates lists and reads the folders of those days only. A
load replaces the days that it touches and no others; it may repeat rows that
are there already.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

DAY = 'Datum'


def read_days(spark: SparkSession, path: str, schema: T.StructType, days: list[dt.date] | None = None) -> DataFrame:
    """The table, or the rows of some of its days. A filter on `Datum` is a
    partition filter: other days' files are not opened."""
    table = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    return table if days is None else table.filter(F.col(DAY).isin(days))


def overwrite_days(rows: DataFrame, path: str) -> None:
    """Replace the days that `rows` hold. `rebalance` lets adaptive execution
    bring a small day into one file and cut a large one into many."""
    (rows.hint('rebalance', DAY).write.mode('overwrite').option('partitionOverwriteMode', 'dynamic')
     .partitionBy(DAY).parquet(path))


def load_days(rows: DataFrame, path: str, key: tuple[str, ...] = ('id',)) -> list[dt.date]:
    """Bring `rows` into the table at `path` and return the days they touch.

    A row replaces the one of the same `key` on its day; other rows of that
    day stay, other days are neither read nor written. Of rows with one key
    and day in the load, all stay. Rows without a day belong to no partition
    (the QA table has none) and are left out. An empty load changes nothing.

    The merged days are stored before the table is touched: a load that is
    run again gives the same table. The driver puts the day folders in place
    one after the other, so readers should wait for the load's end.
    """
    spark = rows.sparkSession
    load = stored(rows.dropna(subset=[DAY]), 'days-load')
    spark.createDataFrame([], load.schema).write.mode('ignore').partitionBy(DAY).parquet(path)
    # as many values as calendar days
    days = sorted(r[0] for r in load.select(DAY).distinct().collect())
    if days:
        old = read_days(spark, path, load.schema, days)
        kept = old.join(load.select(DAY, *key), [DAY, *key], 'left_anti').select(*load.columns)
        overwrite_days(stored(kept.unionByName(load), 'days-merged'), path)
    return days
