"""Latest messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from .extract import fetch_answers


def qa_messages(qa: DataFrame) -> DataFrame:
    """Each QA row -> its user message and, when there is a real answer, the
    assistant message (G4, D7). Columns (id, role_pos, text, role, datetime)."""
    both = F.array(
        F.struct(F.lit(0).alias('role_pos'), F.col('Frage').alias('text'), F.lit('user').alias('role')),
        F.struct(F.lit(1).alias('role_pos'), F.col('Antwort').alias('text'),
                 F.lit('assistant').alias('role')))
    m = qa.select('id', F.col('Datetime').alias('datetime'), F.inline(both))
    keep = (F.col('role') == 'user') | ((F.length('text') > 0) & (F.col('text') != D.NO_ANSWER))
    return m.filter(keep).select('id', 'role_pos', 'text', 'role', 'datetime')


def latest_messages(qa: DataFrame, limit: int = 20, messages: DataFrame | None = None) -> DataFrame:
    """Newest `limit` QA rows -> messages -> newest first, user before
    assistant -> first `limit` messages (H3). `nr` numbers them 1..n.

    Both cuts are distributed top-k operators; the numbering window sees at
    most 2 x limit rows. With `messages`, `qa` is the question-only table and
    only the newest rows' answers are looked up there.
    """
    newest = qa.orderBy(F.col('Datetime').desc(), F.col('id').asc()).limit(limit)
    if messages is not None:
        newest = fetch_answers(newest, messages)
    order = [F.col('datetime').desc(), F.col('id').asc(), F.col('role_pos').asc()]
    msgs = qa_messages(newest).orderBy(*order).limit(limit)
    return msgs.select(F.row_number().over(Window.orderBy(*order)).alias('nr'),
                       'id', 'text', 'role', 'datetime')
