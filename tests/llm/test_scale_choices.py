"""Operators' choices for large inputs (wide anchors, draws), and EM span by span."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import line_dedup, mixing, pii, simhash


@pytest.mark.parametrize('threshold', [1, 2, 3])
def test_both_codes_find_every_link(spark, threshold):
    """Random fingerprints and their neighbours by flipped bits in all 64
    places, against every two compared."""
    rng = np.random.default_rng(threshold)
    fps = set()
    for _ in range(60):
        fp = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        fps.add(fp)
        for _ in range(6):
            near = fp
            for bit in rng.choice(64, int(rng.integers(1, threshold + 2)), replace=False):
                near ^= 1 << int(bit)
            fps.add(near)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= threshold}
    nodes = spark.createDataFrame([(f,) for f in signed], 'fp long')
    for codes in (simhash.NARROW, simhash.WIDE):
        got = [tuple(r) for r in simhash.links(nodes, threshold, codes).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_replicas_per_code():
    """One home each; 61 and 153 replicas on average for two bits."""
    fps = np.random.default_rng(3).integers(-1 << 63, 1 << 63, 3000, dtype=np.int64)
    for codes, mean in ((simhash.NARROW, 61), (simhash.WIDE, 153)):
        for extra, want in ((0, 1), (2, mean)):
            tables = [simhash._error_tables(c, extra) for c in codes]
            row, anchor = simhash._anchors(fps, extra, codes, tables)
            assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
            assert abs(len(row) / len(fps) - want) < 0.02 * want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicas_are_not_broadcast(spark):
    """61 rows for each that goes in, which Spark takes for one."""
    nodes = spark.range(1000).select(F.xxhash64('id').alias('fp'))
    plan = plan_of(simhash.links(nodes))
    assert 'SortMergeJoin' in plan and 'Broadcast' not in plan


def test_dedup_stages_broadcast_no_lines_or_documents(spark):
    """Tables that grow with the documents are sorted and merged, however
    small Spark takes them for; only the few hot lines are broadcast."""
    rows = [(i, f'one two three four five {i % 7}\nown line of document number {i}') for i in range(40)]
    docs = spark.createDataFrame(rows, 'doc_id long, text string').withColumn('n_chars', F.char_length('text'))
    first = line_dedup.lines(docs).filter('line IS NOT NULL').groupBy('line').agg(
        F.min(F.struct('doc_id', 'text_hash', 'line_no')).alias('rank'), F.first('halves').alias('halves'))
    for df in (line_dedup._candidates(docs, first), line_dedup.near_lines(docs, first),
               simhash.near_duplicates(docs), simhash.one_of_each_group(docs)):
        plan = plan_of(df)
        assert 'SortMergeJoin' in plan and 'Broadcast' not in plan
    assert plan_of(line_dedup.deduplicated(docs)).count('BroadcastHashJoin') == 1


@pytest.mark.parametrize('doc_id', [None, 7])
def test_mix_of_rows_with_one_id(spark, doc_id):
    """Sources whose rows all have a null or the same id come near their targets."""
    rows = [(doc_id, f'{"word " * (1 + i % 7)}{i}', s) for s, n in (('a', 3000), ('b', 1000), ('c', 2000)) for i in range(n)]
    docs = spark.createDataFrame(rows, 'doc_id long, text string, source string')
    got = mixing.mixed_sizes(docs).groupBy('source').agg(
        F.first('target').alias('target'), F.sum(F.col('copies') * F.col('size')).alias('taken')).collect()
    assert len(got) == 3
    for r in got:
        assert abs(r.taken - r.target) <= 0.05 * r.target
    assert mixing.mixed_documents(docs).count() == mixing.mixed_sizes(docs).agg(F.sum('copies')).first()[0]


def test_mix_moves_no_text(spark):
    """The rates are broadcast as planned; no document is shuffled."""
    docs = spark.read.parquet('/root/testdata/sf0.01/documents.parquet')
    for df in (mixing.mixed_documents(docs), mixing.mixed_sizes(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert 'BroadcastHashJoin' in plan and 'Exchange hashpartitioning' not in plan and 'SortMergeJoin' not in plan


def brute_em(votes, rounds):
    """Two-class model, span by span: equal-error labelers, silence skipped."""
    post = [1 / (1 + np.exp(-2.0 * sum(v))) for v in votes]
    m = len(votes[0])
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(post) + 2)
        acc = []
        for i in range(m):
            cast = [(v[i], p) for v, p in zip(votes, post) if v[i]]
            right = sum(p if x > 0 else 1 - p for x, p in cast)
            a = (right + pii.BELIEF[0]) / (len(cast) + sum(pii.BELIEF))
            acc.append(min(max(a, 0.5), 1 - 1e-6))
        post = []
        for v in votes:
            yes, no = 0.5, 0.5
            for x, a in zip(v, acc):
                yes, no = yes * (a if x > 0 else 1 - a if x < 0 else 1), no * (1 - a if x > 0 else a if x < 0 else 1)
            post.append(yes / (yes + no))
    return post, share


def test_em_equals_span_by_span_model():
    rng = np.random.default_rng(4)
    votes = []
    for _ in range(1500):
        y = 1 if rng.random() < 0.2 else -1
        v = [y if rng.random() < a else -y for a in (0.9, 0.8, 0.8, 0.7, 0.7)]
        votes.append(tuple(x if rng.random() < 0.5 else 0 for x in v))
    rows = [{f'v{i}': x for i, x in enumerate(v)} | {'n': 1} for v in votes]
    post, share, _ = pii.expectation_maximisation(rows)
    want, want_share = brute_em(votes, pii.EM_ROUNDS)
    assert abs(share - want_share) < 1e-6
    assert max(abs(post[v] - p) for v, p in zip(votes, want)) < 1e-5
    assert post[(0,) * 5] == 0.5
