"""chatlens - chat-log analytics as Spark DataFrame operators.

Read chat exports (CSV with a JSON chat per row) or flat message tables, pull
out the first question and answer of each conversation, and run the
dashboard analyses - overview, keywords, time patterns, lengths, topics,
search, latest messages, rule-based or model-based classification - as lazy
DataFrame plans.
"""

from . import dictionaries
from .dictionaries import DEFAULT, Dictionaries
from .operators.extract import extract_qa_flat, extract_qa_json, extract_qa_segments
from .operators.features import add_features, qa_table
from .session import checkpoint_dir, local_session, materialize

__all__ = ['DEFAULT', 'Dictionaries', 'add_features', 'checkpoint_dir', 'dictionaries',
           'extract_qa_flat', 'extract_qa_json', 'extract_qa_segments', 'local_session', 'materialize', 'qa_table']
