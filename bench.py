"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

One warm-up pass runs every query once (JIT and code caches reach steady
state, as in a long-running cluster session); then $BENCH_REPEAT timed passes
(default 3) run the queries round-robin, so no query is timed right after its
own previous run. The median wall time per query is reported; each timing
covers building the plan (reading the parquet footers included) and running
it. Queries run to completion through the `noop` sink, so every row is
computed but nothing is collected to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def run(df) -> None:
    df.write.format('noop').mode('overwrite').save()


def main() -> None:
    from chatlens.plans.catalog import QUERIES
    from chatlens.session import local_session

    sf_dir = os.environ.get('BENCH_SF_DIR', '/root/testdata/sf0.1')
    cpus = os.environ.get('BENCH_CPUS', '8')
    repeat = int(os.environ.get('BENCH_REPEAT', '3'))
    only = [q for q in os.environ.get('BENCH_QUERIES', '').split(',') if q]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get('BENCH_SHUFFLE_PARTITIONS', '8')),
                          event_log_dir=os.environ.get('BENCH_EVENT_LOG_DIR'))
    chosen = {n: b for n, b in QUERIES.items() if not only or n in only}
    for build in chosen.values():
        run(build(spark, sf_dir))  # warm-up pass
    samples: dict[str, list[float]] = {n: [] for n in chosen}
    for _ in range(repeat):
        for name, build in chosen.items():
            t0 = time.perf_counter()
            run(build(spark, sf_dir))
            samples[name].append(time.perf_counter() - t0)
    times = {n: round(statistics.median(v), 4) for n, v in samples.items()}
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix('sf')
    print(json.dumps({'metric': 'total_median_query_time', 'value': round(sum(times.values()), 3),
                      'unit': 'sec', 'queries': times, 'sf': sf, 'cpus': cpus, 'repeat': repeat}))
    spark.stop()


if __name__ == '__main__':
    main()
