"""The pipeline's stages: column contract, edge cases, and brute-force checks
of what each stage does to its own input."""

from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chatlens.llm import quality
from test_llm_operators import (SF0001, W, brute_components, brute_fingerprint, brute_lines, brute_targets,
                                edge_dir, empty_dir)  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)


def read(spark, d):
    return spark.read.parquet(d + '/documents.parquet')


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ['quality_rules', 'line_dedup', 'simhash_dedup', 'mix_sources',
                                                      'pack_mixture']


@pytest.mark.parametrize('name', list(STAGES)[:-1])
def test_stages_keep_the_schema(spark, edge_dir, empty_dir, name):  # noqa: F811
    for d in (edge_dir, empty_dir):
        docs = read(spark, d)
        out = STAGES[name](spark, docs, d)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert (out.count() == 0) == (d == empty_dir)


def test_quality_stage_matches_verdicts(spark):
    docs = read(spark, SF0001)
    kept = {r.doc_id for r in quality.quality_verdicts(docs).filter('kept').collect()}
    assert as_rows(STAGES['quality_rules'](spark, docs, SF0001)) == as_rows(docs.filter(F.col('doc_id').isin(kept)))


@pytest.mark.parametrize('given', [True, False])
def test_line_stage(spark, edge_dir, given):  # noqa: F811
    d = SF0001 if given else edge_dir
    docs = read(spark, d)
    rows = [(r.doc_id, r.text or '', r.source) for r in docs.collect()]
    places, out = brute_lines(rows)
    gone = defaultdict(set)
    for p in places:
        gone[p[:3]] |= set(out[p[:3]][0]) | set(out[p[:3]][1])
    want = Counter()
    for doc_id, t, _ in rows:
        k = (doc_id is not None, doc_id or 0, xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63))
        want[doc_id, '\n'.join(x for i, x in enumerate(t.split('\n')) if i not in gone[k])] += 1
    got = STAGES['line_dedup'](spark, docs, d)
    assert Counter((r.doc_id, r.text or '') for r in got.collect()) == want
    assert got.filter('text IS NOT NULL AND n_chars <> char_length(text)').isEmpty()


@pytest.mark.parametrize('given', [True, False])
def test_simhash_stage(spark, edge_dir, given):  # noqa: F811
    d = SF0001 if given else edge_dir
    docs = read(spark, d)
    marks = [(r.doc_id, brute_fingerprint(r.text or '')) for r in docs.collect()]
    _, groups = brute_components(marks)
    got = [r.doc_id for r in STAGES['simhash_dedup'](spark, docs, d).collect()]
    assert sorted(got, key=str) == sorted(groups, key=str)


def test_mix_stage(spark):
    docs = read(spark, '/root/testdata/sf0.01')
    sizes, before = Counter(), {}
    for r in docs.collect():
        before[r.doc_id] = r
        sizes[r.source] += len(W.findall(r.text))
    target = brute_targets(sizes)
    n = Counter()
    for r in STAGES['mix_sources'](spark, docs, '').collect():
        assert r == before[r.doc_id]
        n[r.doc_id] += 1
    for doc_id, r in before.items():
        rate = target[r.source] / sizes[r.source]
        assert int(rate) <= n[doc_id] <= int(rate) + (rate > int(rate))


def test_whole_run(spark):
    """run() is the stages in turn, and packs every token of the mix once."""
    got = corpus_pipeline.run(spark, SF0001)
    docs = read(spark, SF0001)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF0001)
    mixed = Counter(r.doc_id for r in docs.select('doc_id').collect())
    tokens = {r.doc_id: r.doc_tokens for r in got.select('doc_id', 'doc_tokens').distinct().collect()}
    packed = {r.doc_id: r.n for r in got.groupBy('doc_id').agg(F.sum('length').alias('n')).collect()}
    assert packed == {k: n * tokens[k] for k, n in mixed.items()}
