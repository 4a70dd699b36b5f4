import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import test helpers by module name.
HERE = os.path.dirname(os.path.abspath(__file__))
os.environ['PYTHONPATH'] = os.pathsep.join(p for p in (ROOT, HERE, os.environ.get('PYTHONPATH')) if p)

SF0001 = '/root/testdata/sf0.001'
SF001 = '/root/testdata/sf0.01'


@pytest.fixture(scope='session')
def spark():
    from chatlens.session import local_session
    s = local_session('*', shuffle_partitions=8, app='chatlens-tests')
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (optionally a column subset), in order."""
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
