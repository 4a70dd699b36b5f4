"""Plan shape and driver contract."""

import __spark_entry__ as E
from chatlens.plans.catalog import QUERIES

from conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_keys():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ['Stunde', 'pos', 'Wochentag', 'Anzahl']
    assert df.count() > 0


def test_top_k_is_take_ordered(spark):
    for name in ('shortest_questions', 'longest_questions', 'top_keywords', 'search_questions'):
        assert 'TakeOrderedAndProject' in plan(QUERIES[name](spark, SF001)), name


def test_qa_pipeline_stays_in_jvm_and_pushes_filters(spark):
    p = plan(QUERIES['qa_features'](spark, SF001))
    assert 'ArrowEvalPython' not in p and 'BatchEvalPython' not in p
    assert 'EqualTo(role,user)' in p and 'EqualTo(role,assistant)' in p
    assert 'partial_min_by' in p  # question text combined map-side


def test_scans_prune_columns(spark):
    p = plan(QUERIES['event_hour_counts'](spark, SF001))
    assert 'ReadSchema: struct<ts:timestamp_ntz>' in p


def test_dense_counts_need_no_join(spark):
    for name in ('weekday_counts', 'weekday_hour_heatmap', 'topic_daily_trend'):
        p = plan(QUERIES[name](spark, SF001))
        assert 'CartesianProduct' not in p and 'NestedLoopJoin' not in p, name


def _nodes(node):
    """All nodes of a physical plan tree (through the JVM objects, not the
    printed text, which literals with line breaks would cut apart)."""
    yield node
    it = node.children().iterator()
    while it.hasNext():
        yield from _nodes(it.next())


def _physical(df):
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == 'AdaptiveSparkPlan':
        plan = plan.executedPlan()
    return plan


def test_windows_only_over_bounded_frames(spark):
    """Every Window operator in every registered query runs over the output
    of a top-k or limit, never over a whole table (an unpartitioned window
    would pull all rows into one task)."""
    bounded = {'TakeOrderedAndProject', 'GlobalLimit', 'CollectLimit', 'LocalLimit'}
    seen = 0
    for name, build in QUERIES.items():
        if name.startswith('stream_'):
            continue
        for node in _nodes(_physical(build(spark, SF001))):
            if node.nodeName() == 'Window':
                seen += 1
                assert any(d.nodeName() in bounded for d in _nodes(node)), name
    assert seen >= 4  # top_keywords, keyword_weights, latest_messages, sentiment_timeline...


def test_export_segments_group_by_conversation_and_block(spark):
    p = plan(QUERIES['qa_from_json'](spark, SF001))
    agg = [x for x in p.splitlines() if 'collect_list' in x]
    assert agg and all('_groupingexpression' in x or 'segment' in x for x in agg)


def test_python_runs_at_most_once_per_row(spark):
    """No registered query passes its texts through Python twice (a filter
    pushed below the keyword matcher would copy the call)."""
    for name, build in QUERIES.items():
        if name.startswith('stream_'):
            continue
        p = plan(build(spark, SF001))
        assert p.count('ArrowEvalPython') + p.count('MapInPandas') <= 1, name
