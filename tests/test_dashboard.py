"""All dashboard results from one checkpointed QA table."""

from chatlens.plans.catalog import qa
from chatlens.plans.dashboard import dashboard

from conftest import SF0001


def test_dashboard_results(spark):
    res = dashboard(qa(spark, SF0001))
    n = res['overview'].first()['gesamt_fragen']
    assert n == 20
    assert sum(r['Anzahl'] for r in res['weekday_counts'].collect()) == n
    assert res['latest_messages'].count() == 20
    assert res['classification_summary'].first()['analysiert'] == 20
    # built on the checkpoint, not on the raw messages
    plan = res['hour_counts']._jdf.queryExecution().executedPlan().toString()
    assert 'conversations.parquet' not in plan
