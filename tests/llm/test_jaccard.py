"""The Jaccard join against all pairs of sets."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import jaccard as jc
from chatlens.llm import queries
from test_llm_operators import case, edge_dir, empty_dir, many  # noqa: F401


def brute_set(text, shingle=3):
    words = re.findall(r'[^ \t-\r]+', ''.join(c.lower() if 'A' <= c <= 'Z' else c for c in text or ''))
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else frozenset([tuple(words)])


def brute(docs, percent=90, shingle=3):
    sets = [brute_set(t, shingle) for _, t in docs]
    distinct = [s for s in dict.fromkeys(sets) if s]
    root = {s: s for s in distinct}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(b)] = find(a)
    least = defaultdict(list)
    for (doc_id, _), s in zip(docs, sets):
        if s and doc_id is not None:
            least[find(s)].append(doc_id)
    return many((doc_id, len(s), (min(least[find(s)], default=None) if s else doc_id)) for (doc_id, _), s in zip(docs, sets))


def test_op13(spark, case):  # noqa: F811
    d, docs = case
    assert many(queries.op13_jaccard_join(spark, d).collect()) == brute([(i, t) for i, t, _ in docs])


def near_copies(rnd, n, size, edits, word):
    """`n` texts, each `edits` replaced, inserted or deleted words away from a
    base text or from the one before."""
    out = [[f'{word}{rnd.randrange(5000)}' for _ in range(size)]]
    for _ in range(n - 1):
        t = list(out[-1] if rnd.random() < 0.3 else out[0])
        for _ in range(rnd.randrange(edits + 1)):
            at = rnd.randrange(len(t))
            t[at:at + rnd.randrange(2)] = [f'e{rnd.randrange(10 ** 6)}'] * rnd.randrange(2)
        out.append(t)
    return [' '.join(t) for t in out]


@pytest.fixture(scope='module')
def families():
    """Near copies around the threshold, sizes from 8 to 400 words, and texts
    that share a long passage without being alike."""
    rnd = random.Random(11)
    texts = near_copies(rnd, 150, 120, 3, 'a') + near_copies(rnd, 60, 60, 2, 'b') + near_copies(rnd, 20, 400, 14, 'c')
    for k in range(12):
        texts += near_copies(rnd, 3, 8 + 2 * k, 1, f'd{k}x')
    passage = [f'p{i}' for i in range(60)]
    texts += [' '.join(passage + [f'q{rnd.randrange(10 ** 6)}' for _ in range(20 + i % 7)]) for i in range(40)]
    rnd.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize('weight,fan', [(1 << 16, 16), (3000, 2)])
def test_families_over_blocks(spark, families, monkeypatch, weight, fan):
    """One block for all, or blocks of a few sets with several levels of nodes
    above them."""
    monkeypatch.setattr(jc, 'BLOCK_WEIGHT', weight)
    monkeypatch.setattr(jc, 'BLOCK_FAN', fan)
    docs = spark.createDataFrame(families, 'doc_id long, text string').repartition(3)
    got = jc.jaccard_components(docs).select('doc_id', 'n_shingles', 'component_id').collect()
    assert many(got) == brute(families)
    assert len({r.component_id for r in got}) < len(got) - 150


def test_other_parameters(spark, families):
    docs = spark.createDataFrame(families, 'doc_id long, text string')
    got = jc.jaccard_components(docs, 2, 70).select('doc_id', 'n_shingles', 'component_id').collect()
    assert many(got) == brute(families, 70, 2)


def test_linked_sets_share_a_key():
    """Random sets at the very edge of the threshold, of every small size."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 100, 190, 399, 1000, 5000]:
        for percent in (90, 80):
            for gone in range(6 if n < 60 else 3):
                # the largest partner: all of x but `gone` tokens, and as many new ones as the threshold lets in
                common = n - gone
                if common < 1:
                    continue
                more = common * 100 // percent - n
                if more < 0:
                    continue
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                y = np.unique(np.concatenate((rng.permutation(x)[:common], rng.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2))))
                assert 100 * common >= percent * (n + len(y) - common)
                assert set(jc.keys(x, percent).tolist()) & set(jc.keys(y, percent).tolist())


def test_unrelated_sets_share_no_key():
    """Sets without a common token, large enough that many have a range
    without tokens: neither such a range nor another makes them a family."""
    rng = np.random.default_rng(5)
    every = np.concatenate([np.unique(jc.keys(np.unique(rng.integers(0, 1 << 64, 1000 + k, dtype=np.uint64))))
                            for k in range(300)])
    assert len(np.unique(every)) == len(every)


@pytest.mark.parametrize('n', [12, 30, 97, 400, 1000, 5000])
@pytest.mark.parametrize('fullest', [True, False])
def test_emptiest_ranges_are_alike(n, fullest):
    """As many tokens as the threshold lets in, one in each of the fullest (or
    the emptiest) ranges of the larger set's class: a key is still shared."""
    rng = np.random.default_rng(n)
    starts = jc._class_starts()
    for _ in range(20):
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        more = n * 100 // 90 - n
        top = 2 * (int(starts[np.searchsorted(starts, n + more, side='right')]) - 1)
        most = max(jc.differing(top, 90), jc.differing(top - 1, 90))
        borders = np.concatenate((np.zeros(1, np.uint64), jc._borders(most + 1 + -(-most // jc.SPARE))))
        held = np.diff(np.concatenate((np.searchsorted(x, borders), [n])))
        order = np.argsort(-held if fullest else held, kind='stable')
        y = np.unique(np.concatenate((x, borders[order[:more]] + np.uint64(1))))
        assert 100 * n >= 90 * len(y)
        assert set(jc.keys(x).tolist()) & set(jc.keys(y).tolist())


def test_traversal_keeps_every_link(families):
    """No linked pair of sets is pruned, whatever tree they lie in."""
    sets = [jc.tokens(t) for _, t in families]
    rnd = random.Random(1)
    for size in (1, 2, 9, 70, len(sets)):
        some = rnd.sample(sets, size)
        one = np.zeros(size, np.int64)
        trees = [jc.SignatureTree(some, one, np.arange(size)), jc.SignatureTree(sets[:77], np.zeros(77, np.int64), 1000 + np.arange(77))]

        def linked(a, b):
            return 190 * len(np.intersect1d(a, b, assume_unique=True)) >= 90 * (len(a) + len(b))

        i, j = jc.candidates(trees[0], None, 90)
        assert {(x, y) for x in range(size) for y in range(x + 1, size) if linked(some[x], some[y])} <= set(zip(i.tolist(), j.tolist()))
        i, j = jc.candidates(*trees, 90)
        assert {(x, y) for x in range(size) for y in range(77) if linked(some[x], sets[y])} <= set(zip(i.tolist(), j.tolist()))


def test_traversal_prunes(families):
    """Of all pairs few are left, and sets of one component are not compared."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64)) for _ in range(200)]
    tree = jc.SignatureTree(sets, np.zeros(200, np.int64), np.arange(200))
    assert len(jc.candidates(tree, None, 90)[0]) == 0
    same = jc.SignatureTree(sets[:1] * 50, np.zeros(50, np.int64), np.zeros(50, np.int64))
    assert len(jc.candidates(same, None, 90)[0]) == 0
