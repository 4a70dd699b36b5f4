"""All dashboard results from one extraction.

The QA table is built once and its lineage cut with a reliable checkpoint in
the shared checkpoint folder; every result below is a small plan over that
table, so asking for all of them re-reads one compact table instead of
re-running the extraction (and a lost executor re-reads the checkpoint rather
than the raw messages). Results stay lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import dictionaries as D
from ..operators import classification as C
from ..operators import keywords as K
from ..operators import lengths as L
from ..operators import temporal as T
from ..operators import topics as TP
from ..operators.messages import latest_messages
from ..operators.overview import overview_metrics
from ..operators.search import search_count, search_questions
from ..session import materialize

# The original draws the sentiment timeline only for more than 5 messages.
TIMELINE_MIN_MESSAGES = 6


def dashboard(qa: DataFrame, latest: int = 20, top_keywords: int = 25, search: str = '',
              start=None, end=None, category: str = D.ALL_FILTER, sentiment: str = D.ALL_FILTER,
              checkpoint: bool = True, scorer=None, dicts: D.Dictionaries = D.DEFAULT) -> dict[str, DataFrame]:
    """qa (from `qa_table` / `add_features`) -> {result name: DataFrame}.

    With `scorer` the latest messages are classified by the model (scores
    checkpointed), else by the rules.
    """
    if checkpoint:
        qa = materialize(qa)
    out = {
        'qa': qa,
        'overview': overview_metrics(qa),
        'questions_per_day': T.questions_per_day(qa),
        'top_keywords': K.top_keywords(qa, top_keywords, dicts=dicts),
        'keyword_weights': K.keyword_weights(qa, top_keywords, dicts=dicts),
        'weekday_counts': T.weekday_counts(qa),
        'daypart_counts': T.daypart_counts(qa),
        'hour_counts': T.hour_counts(qa),
        'weekday_hour_heatmap': T.weekday_hour_heatmap(qa),
        'weekday_hour_matrix': T.weekday_hour_matrix(qa),
        'length_stats': L.length_stats(qa),
        'length_histogram_chars': L.length_histogram(qa, 'Fragenlänge_Zeichen', 30),
        'length_histogram_words': L.length_histogram(qa, 'Fragenlänge_Wörter', 20),
        'length_bands': L.length_bands(qa),
        'shortest_questions': L.shortest_questions(qa),
        'longest_questions': L.longest_questions(qa),
        'topic_counts': TP.topic_counts(qa),
        'topic_daily_trend': TP.topic_daily_trend(qa, dicts.main_topics),
        'topic_mean_length': TP.topic_mean_length(qa),
        'search_count': search_count(qa, search, start, end),
        'search_questions': search_questions(qa, search, start, end),
    }
    msgs = latest_messages(qa, latest)
    if scorer is not None:
        from ..operators.scoring import score_messages
        classified = score_messages(msgs, scorer=scorer, keep=('nr', 'id', 'datetime'), dicts=dicts)
    else:
        classified = C.classify_rule_based(msgs, keep=('nr', 'id', 'datetime'), dicts=dicts)
    out.update({
        'latest_messages': msgs,
        'classified': classified,
        'classification_summary': C.classification_summary(classified),
        'category_counts': C.category_counts(classified),
        'sentiment_counts': C.sentiment_counts(classified),
        'sentiment_timeline': C.sentiment_timeline(classified, min_messages=TIMELINE_MIN_MESSAGES),
        'classification_filtered': C.classification_filtered(classified, category, sentiment),
        'filter_choices': C.filter_choices(classified),
    })
    return out
