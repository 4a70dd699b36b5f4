"""Session helpers: a sensible local session for tests and benchmarks, and the
shared checkpoint folder that lineage cuts are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = 'spark.checkpoint.dir'


def local_session(cores: int | str = '*', shuffle_partitions: int = 8,
                  app: str = 'chatlens', event_log_dir: str | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """A local session configured as the library expects: AQE (coalescing and
    skew-join splitting), UTC session time zone for naive timestamps, Arrow for
    the Python scorer, no web UI. `checkpoint_dir` is where intermediate tables
    and stream states go (`checkpoint_root`)."""
    b = (SparkSession.builder.master(f'local[{cores}]').appName(app)
         .config('spark.ui.enabled', 'false')
         .config('spark.sql.shuffle.partitions', str(shuffle_partitions))
         .config('spark.sql.adaptive.enabled', 'true')
         .config('spark.sql.adaptive.coalescePartitions.enabled', 'true')
         .config('spark.sql.adaptive.skewJoin.enabled', 'true')
         .config('spark.sql.session.timeZone', 'UTC')
         .config('spark.sql.execution.arrow.pyspark.enabled', 'true')
         .config('spark.driver.memory', os.environ.get('CHATLENS_DRIVER_MEMORY', '8g')))
    if checkpoint_dir:
        b = b.config(CHECKPOINT_CONF, checkpoint_dir)
    if event_log_dir:
        b = (b.config('spark.eventLog.enabled', 'true')
             .config('spark.eventLog.dir', event_log_dir))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel('ERROR')
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`, as configured.

    Stream checkpoints go here (under `streams/<name>`), so a stream started
    again by a later application finds its offsets and state and resumes.
    On a cluster the setting must name a folder every executor can reach;
    only a local-mode session without it gets a temporary folder (one per
    application, as in tests).
    """
    sc = spark.sparkContext
    d = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    if not sc.master.startswith('local'):
        raise RuntimeError(
            f'{CHECKPOINT_CONF} is not set; point it at a shared folder (HDFS/S3/ABFS) '
            'that every executor can reach')
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix='chatlens-ckpt-')
    return _LOCAL_ROOTS[sc.applicationId]


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder `DataFrame.checkpoint` writes to: Spark's own per-application
    subfolder of `checkpoint_root` (set from `spark.checkpoint.dir` at start,
    or here from the local fallback)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))
    return sc.getCheckpointDir()


def materialize(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where recomputation is expensive or must not repeat (model scoring):
    a lost executor re-reads the checkpoint instead of re-running the plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df, name: str):
    """`df` written once to shared Parquet and read back, for results that a
    plan uses more than once. The folders of one application lie together, and
    `clear_stored` deletes them."""
    spark = df.sparkSession
    path = os.path.join(_stored_root(spark), f'{name}-{uuid.uuid4().hex}')
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> bool:
    """Delete what this application has stored with `stored` and
    the training-data operators' tables; frames that read them end with it.
    Returns whether there was anything."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    app, found = spark.sparkContext.applicationId, False
    for folder in (_stored_root(spark), os.path.join(checkpoint_root(spark), 'llm', app)):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found |= path.getFileSystem(conf).delete(path, True)
    return found


def _stored_root(spark: SparkSession) -> str:
    return os.path.join(checkpoint_root(spark), 'stored', spark.sparkContext.applicationId)
