"""Physical plan shape of the registered queries.

    python tools/plans.py [sf_dir] [--formatted] [query ...]

Without --formatted, prints one line per query: the number of shuffle
exchanges, broadcasts, windows, top-k nodes, Python (Arrow) nodes and hash /
sort aggregates in the plan Spark chose, and whether the scans push filters.
With --formatted, prints `explain('formatted')` for the named queries.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTED = (
    ('shuffle', r'Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)'),
    ('bcast', r'BroadcastExchange'),
    ('window', r'\bWindow \['),
    ('topk', r'TakeOrderedAndProject'),
    ('python', r'ArrowEvalPython|MapInPandas|BatchEvalPython|PythonMapInArrow'),
    ('hashagg', r'\bHashAggregate\('),
    ('sortagg', r'\bSortAggregate\('),
    ('objagg', r'ObjectHashAggregate\('),
)


def shape(df) -> dict[str, object]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out: dict[str, object] = {k: len(re.findall(p, plan)) for k, p in COUNTED}
    out['pushed'] = 'PushedFilters: [' in plan and 'PushedFilters: []' not in plan
    return out


def main(argv: list[str]) -> None:
    from chatlens.plans.catalog import QUERIES
    from chatlens.session import local_session

    formatted = '--formatted' in argv
    args = [a for a in argv if a != '--formatted']
    sf_dir = args[0] if args and os.path.isdir(args[0]) else '/root/testdata/sf0.01'
    names = [a for a in args if a in QUERIES] or list(QUERIES)
    spark = local_session('*', shuffle_partitions=8)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        if formatted:
            print(f'==== {name}')
            df.explain('formatted')
        else:
            s = shape(df)
            print(f'{name:30s} ' + ' '.join(f'{k}={v}' for k, v in s.items()))
    spark.stop()


if __name__ == '__main__':
    main(sys.argv[1:])
