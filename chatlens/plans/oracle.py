"""DuckDB SQL for every named query, for the side-by-side check.

Written independently of the Spark plans where the SQL allows it: `arg_min`
instead of key joins, a VALUES dimension with a LEFT JOIN instead of
`count_if` columns, a CROSS JOIN grid for the dense tables, RE2 word runs plus
a full-match filter instead of look-around tokens, a correlated subquery for
the per-topic mean. Only the word lists and labels are shared.
"""

from __future__ import annotations

from .. import dictionaries as D
from ..sources.fixture import DIRT, PHRASES, SPAN_SECONDS, START, STEP
from . import catalog as Q
from ..operators.lengths import NICE_WIDTHS

WS = r'\t\n\x0B\f\r\x1C-\x1F\x{85}\pZ'


def s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def lst(words) -> str:
    return '[' + ', '.join(s(w) for w in words) + ']'


def any_of(expr: str, words) -> str:
    return f'len(list_filter({lst(D.distinct(words))}, lambda k: contains({expr}, k))) > 0'


def hits(expr: str, words) -> str:
    return f'len(list_filter({lst(D.distinct(words))}, lambda k: contains({expr}, k)))'


def values(rows) -> str:
    return 'VALUES ' + ', '.join('(' + ', '.join(str(x) if isinstance(x, int) else s(x) for x in r) + ')'
                                 for r in rows)


def topics_sql(low: str, topics=D.TOPIC_KEYWORDS) -> str:
    parts = ', '.join(f"CASE WHEN {any_of(low, words)} THEN {s(label)} END" for label, words in topics)
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), {s(D.OTHER_TOPIC)})"


def category_sql(t: str) -> str:
    low = f'lower({t})'
    strip = f"regexp_replace({low}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN {s(D.CATEGORY_OTHER)} "
            f"WHEN {any_of(low, D.AGGRESSIVE_KEYWORDS)} THEN {s(D.CATEGORY_AGGRESSIVE)} "
            f"WHEN {any_of(low, D.FOOD_KEYWORDS)} THEN {s(D.CATEGORY_FOOD)} "
            f"WHEN length({strip}) < 5 OR regexp_full_match({low}, '\\p{{Nd}}+') THEN {s(D.CATEGORY_OTHER)} "
            f"ELSE {s(D.CATEGORY_NEUTRAL)} END")


def sentiment_sql(t: str, cat: str) -> str:
    low = f'lower({t})'
    p, n = hits(low, D.POSITIVE_KEYWORDS), hits(low, D.NEGATIVE_KEYWORDS)
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'neutral' WHEN {p} > {n} THEN 'positiv' "
            f"WHEN {n} > {p} THEN 'negativ' WHEN {cat} = 'aggressiv' THEN 'negativ' ELSE 'neutral' END")


def weekday_sql(ts: str) -> str:
    return f'{lst(D.WEEKDAYS)}[isodow({ts})]'


def daypart_sql(h: str) -> str:
    whens = ' '.join(f'WHEN {h} >= {lo} AND {h} < {hi} THEN {s(label)}' for label, lo, hi in D.DAYPARTS)
    return f'CASE {whens} ELSE {s(D.NIGHT)} END'


def band_sql(n: str) -> str:
    whens = ' '.join(f'WHEN {n} < {hi} THEN {s(label)}' for label, hi in D.LENGTH_BANDS)
    return f'CASE {whens} ELSE {s(D.LONG_BAND)} END'


FX = f"""fx AS (
  SELECT conv_id, turn, role,
    text || ' ' || {lst(PHRASES)}[(conv_id * 7 + turn) % 16 + 1] AS text,
    TIMESTAMP '{START}' + to_seconds(CAST((conv_id * {STEP}) % {SPAN_SECONDS} AS BIGINT)) AS created
  FROM conversations)"""

QA0 = f"""q AS (
  SELECT conv_id, min(turn) AS q_turn, arg_min(text, turn) AS frage, arg_min(created, turn) AS created
  FROM fx WHERE role = 'user' AND length(text) > 0 GROUP BY conv_id),
a AS (
  SELECT f.conv_id, arg_min(f.text, f.turn) AS antwort
  FROM fx f JOIN q ON f.conv_id = q.conv_id AND f.turn > q.q_turn
  WHERE f.role = 'assistant' GROUP BY f.conv_id),
qa0 AS (
  SELECT q.conv_id AS id, q.created AS "Datetime", q.frage AS "Frage",
         coalesce(nullif(a.antwort, ''), {s(D.NO_ANSWER)}) AS "Antwort"
  FROM q LEFT JOIN a USING (conv_id))"""

QA = f"""qa1 AS (
  SELECT id, CAST("Datetime" AS DATE) AS "Datum", "Datetime", {weekday_sql('"Datetime"')} AS "Wochentag",
         CAST(hour("Datetime") AS INTEGER) AS "Stunde", "Frage", "Antwort",
         CAST(length("Frage") AS INTEGER) AS "Fragenlänge_Zeichen",
         CAST(len(regexp_extract_all("Frage", '[^{WS}]+')) AS INTEGER) AS "Fragenlänge_Wörter",
         {topics_sql('lower("Frage")')} AS "Kategorie"
  FROM qa0),
qa AS (
  SELECT id, "Datum", "Datetime", "Wochentag", "Stunde", "Frage", "Antwort",
         "Fragenlänge_Zeichen", "Fragenlänge_Wörter", {daypart_sql('"Stunde"')} AS "Tageszeit",
         {band_sql('"Fragenlänge_Zeichen"')} AS "Längenkategorie", "Kategorie"
  FROM qa1)"""

# The rows of a dirty export: fault, question turn, the next assistant's text
# and the text behind the first assistant's message.
DIRTY = f"""seg AS (
  SELECT conv_id, turn // {Q.EXPORT_SEGMENT_MESSAGES} AS segment, turn, role, text, created FROM fx),
d0 AS (
  SELECT conv_id, segment, {lst(DIRT)}[(conv_id + segment) % {len(DIRT)} + 1] AS dirt, min(created) AS created,
         min(turn) FILTER (role = 'user') AS qt, min(turn) FILTER (role = 'assistant') AS ft
  FROM seg GROUP BY conv_id, segment),
dirty AS (
  SELECT d0.conv_id, d0.segment, any_value(dirt) AS dirt, any_value(d0.created) AS created, any_value(qt) AS qt,
         any_value(text) FILTER (turn = qt) AS q,
         arg_min(text, turn) FILTER (role = 'assistant' AND turn > qt) AS own,
         arg_min(text, turn) FILTER (turn > ft) AS behind
  FROM d0 JOIN seg USING (conv_id, segment) GROUP BY d0.conv_id, d0.segment)"""


def dirty_qa_sql(fallback_answer: str) -> str:
    def raw(c):  # as spelled in the JSON text
        return f"replace({c}, chr(10), '\\n')"
    return f"""WITH {FX},
{DIRTY}
SELECT conv_id, segment, created AS "Datetime", CASE WHEN dirt = 'clean' THEN q ELSE {raw('q')} END AS "Frage",
  coalesce(CASE WHEN dirt = 'clean' THEN own ELSE {raw(fallback_answer)} END, {s(D.NO_ANSWER)}) AS "Antwort"
FROM dirty WHERE dirt IN ('clean', 'cut', 'cut_doubled') AND qt IS NOT NULL"""


BASE = f'WITH {FX},\n{QA0},\n{QA}\n'
QA_COLS = ', '.join(f'"{c}"' for c in Q.QA_OUT)

MSG = """msg AS (SELECT conv_id, turn, text, role, created AS datetime FROM fx)"""
CLASSIFIED = f"""cls0 AS (SELECT conv_id, turn, datetime, coalesce(text, '') AS frage, role AS rolle,
                 {category_sql('text')} AS kategorie, text FROM msg),
cls AS (SELECT conv_id, turn, datetime, frage, rolle, kategorie,
               {sentiment_sql('text', 'kategorie')} AS sentiment FROM cls0)"""
BASE_CLS = f'WITH {FX},\n{MSG},\n{CLASSIFIED}\n'

LATEST = f"""top AS (SELECT * FROM qa ORDER BY "Datetime" DESC, id LIMIT {Q.LATEST}),
m AS (SELECT id, 0 AS role_pos, "Frage" AS text, 'user' AS role, "Datetime" AS datetime FROM top
      UNION ALL
      SELECT id, 1, "Antwort", 'assistant', "Datetime" FROM top
      WHERE length("Antwort") > 0 AND "Antwort" <> {s(D.NO_ANSWER)}),
latest AS (SELECT CAST(row_number() OVER (ORDER BY datetime DESC, id, role_pos) AS INTEGER) AS nr,
                  id, text, role, datetime
           FROM m ORDER BY datetime DESC, id, role_pos LIMIT {Q.LATEST}),
lcls0 AS (SELECT nr, id, datetime, coalesce(text, '') AS frage, role AS rolle,
                 {category_sql('text')} AS kategorie, text FROM latest),
lcls AS (SELECT nr, id, datetime, frage, rolle, kategorie, {sentiment_sql('text', 'kategorie')} AS sentiment
         FROM lcls0)"""


def dense(src: str, col: str, domain, label: str, share: bool = True, drop_zero: bool = False) -> str:
    dim = values([(i + 1, v) for i, v in enumerate(domain)])
    share_sql = (f', count(x.{col}) / nullif((SELECT count(*) FROM {src} WHERE {col} IN '
                 f'({", ".join(s(v) for v in domain)})), 0) AS "Anteil"') if share else ''
    having = 'HAVING count(x.' + col + ') > 0' if drop_zero else ''
    return (f'SELECT d.pos, d."{label}", count(x.{col}) AS "Anzahl"{share_sql} '
            f'FROM ({dim}) d(pos, "{label}") LEFT JOIN {src} x ON x.{col} = d."{label}" '
            f'GROUP BY d.pos, d."{label}" {having}')


def histogram(src: str, col: str, bins: int) -> str:
    widths = '[' + ', '.join(str(w) for w in NICE_WIDTHS) + ']'
    return f"""r AS (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}),
wd AS (SELECT min(w) AS w FROM (SELECT unnest({widths}) AS w) c, r
       WHERE floor(mx / w) - floor(mn / w) + 1 <= {bins})
SELECT CAST(floor({col} / w) * w AS BIGINT) AS bin_start, CAST(floor({col} / w) * w + w AS BIGINT) AS bin_end,
       count(*) AS "Anzahl"
FROM {src}, wd WHERE {col} IS NOT NULL GROUP BY 1, 2"""


def keywords(src: str, text: str, order: list[str], n: int) -> str:
    o = ', '.join(order)
    return f"""runs AS (SELECT {o}, unnest(l) AS w, unnest(range(len(l))) AS pos
        FROM (SELECT {o}, regexp_extract_all(lower({text}), '[\\pL\\pN_]+') AS l FROM {src})),
kept AS (SELECT * FROM runs
         WHERE regexp_full_match(w, '[a-züäö]+') AND length(w) > 2 AND w NOT IN ({', '.join(s(x) for x in D.distinct(D.GERMAN_STOPWORDS))})),
firsts AS (SELECT w, count(*) OVER (PARTITION BY w) AS n,
                  row_number() OVER (PARTITION BY w ORDER BY {o}, pos) AS rn, {o}, pos FROM kept),
top AS (SELECT w, n, {o}, pos FROM firsts WHERE rn = 1 ORDER BY n DESC, {o}, pos LIMIT {n})"""


def _sql() -> dict[str, str]:
    sql = {}
    sql['qa_pairs'] = f'WITH {FX},\n{QA0}\nSELECT id, "Datetime", "Frage", "Antwort" FROM qa0'
    sql['qa_from_json'] = sql['qa_pairs']
    sql['qa_from_csv'] = sql['qa_pairs']
    sql['stream_qa_from_csv'] = sql['qa_pairs']
    sql['stream_qa_dedup'] = sql['qa_pairs']
    sql['stream_qa_pairs'] = sql['qa_pairs']
    sql['qa_from_dirty_csv'] = dirty_qa_sql('behind')
    sql['qa_from_dirty_csv_robust'] = dirty_qa_sql('own')
    sql['export_rejects'] = f"""WITH {FX},
{DIRTY}
SELECT conv_id, segment, CASE WHEN dirt IN ('clean', 'cut', 'cut_doubled', 'no_user_text') THEN 'no_question'
  ELSE dirt END AS reason
FROM dirty WHERE dirt NOT IN ('clean', 'cut', 'cut_doubled') OR qt IS NULL"""
    sql['qa_features'] = BASE + f'SELECT {QA_COLS} FROM qa'
    sql['qa_json_features'] = sql['qa_features']
    sql['overview_metrics'] = BASE + """SELECT count(*) AS gesamt_fragen, min("Datum") AS erster_tag,
  max("Datum") AS letzter_tag,
  count(*) / nullif(date_diff('day', min("Datum"), max("Datum")), 0) AS fragen_pro_tag,
  CAST(sum("Fragenlänge_Zeichen") AS DOUBLE) / count("Fragenlänge_Zeichen") AS mittlere_laenge,
  (SELECT "Stunde" FROM qa GROUP BY "Stunde" ORDER BY count(*) DESC, "Stunde" LIMIT 1) AS aktivste_stunde
FROM qa"""
    sql['questions_per_day'] = BASE + 'SELECT "Datum", count(*) AS "Anzahl" FROM qa GROUP BY "Datum"'
    sql['weekday_counts'] = BASE + dense('qa', '"Wochentag"', D.WEEKDAYS, 'Wochentag')
    sql['daypart_counts'] = BASE + dense('qa', '"Tageszeit"', D.DAYPART_ORDER, 'Tageszeit')
    sql['hour_counts'] = BASE + 'SELECT "Stunde", count(*) AS "Anzahl" FROM qa GROUP BY "Stunde"'
    dim7 = values([(i + 1, v) for i, v in enumerate(D.WEEKDAYS)])
    heat = (f'SELECT h."Stunde", d.pos, d."Wochentag", count(x.{{counted}}) AS "Anzahl" '
            f'FROM (SELECT DISTINCT "Stunde" FROM {{src}}) h CROSS JOIN ({dim7}) d(pos, "Wochentag") '
            f'LEFT JOIN {{src}} x ON x."Stunde" = h."Stunde" AND x."Wochentag" = d."Wochentag" '
            f'GROUP BY h."Stunde", d.pos, d."Wochentag"')
    sql['weekday_hour_heatmap'] = BASE + heat.format(src='qa', counted='"Frage"')
    hours = ', '.join(f'CAST(coalesce(sum("Anzahl") FILTER ("Stunde" = {h}), 0) AS BIGINT) AS "{h}"' for h in range(24))
    sql['weekday_hour_matrix'] = (BASE + f'SELECT pos, "Wochentag", {hours} FROM ('
                                  + heat.format(src='qa', counted='"Frage"') + ') GROUP BY pos, "Wochentag"')
    sql['length_stats'] = BASE + """SELECT min("Fragenlänge_Zeichen") AS min_laenge, max("Fragenlänge_Zeichen") AS max_laenge,
  CAST(sum("Fragenlänge_Zeichen") AS DOUBLE) / count("Fragenlänge_Zeichen") AS mittlere_laenge,
  CAST(quantile_cont("Fragenlänge_Zeichen", 0.5) AS DOUBLE) AS median_laenge FROM qa"""
    sql['length_bands'] = BASE + dense('qa', '"Längenkategorie"', D.LENGTH_BAND_ORDER, 'Längenkategorie',
                                       drop_zero=True)
    sql['length_histogram_chars'] = BASE.rstrip() + ',\n' + histogram('qa', '"Fragenlänge_Zeichen"', 30)
    sql['length_histogram_words'] = BASE.rstrip() + ',\n' + histogram('qa', '"Fragenlänge_Wörter"', 20)
    sql['shortest_questions'] = BASE + """SELECT id, "Datetime", "Frage", "Fragenlänge_Zeichen" FROM qa
ORDER BY "Fragenlänge_Zeichen", "Datetime", id LIMIT 5"""
    sql['longest_questions'] = BASE + """SELECT id, "Datetime", "Frage", "Fragenlänge_Zeichen",
  left("Frage", 100) || '...' AS "Vorschau" FROM qa
ORDER BY "Fragenlänge_Zeichen" DESC, "Datetime", id LIMIT 5"""
    kw = keywords('qa', '"Frage"', ['"Datetime"', 'id'], Q.TOP_KEYWORDS)
    sql['top_keywords'] = BASE.rstrip() + ',\n' + kw + """
SELECT CAST(row_number() OVER (ORDER BY n DESC, "Datetime", id, pos) AS INTEGER) AS "Rang",
       w AS "Keyword", n AS "Anzahl" FROM top"""
    sql['keyword_weights'] = BASE.rstrip() + ',\n' + kw + """
SELECT w AS "Keyword", n AS "Anzahl", n / max(n) OVER () AS "Gewicht" FROM top"""
    sql['topic_labels'] = BASE + 'SELECT id, "Kategorie" FROM qa'
    sql['topic_counts'] = BASE + """SELECT k AS "Kategorie", count(*) AS "Anzahl"
FROM (SELECT unnest(string_split("Kategorie", ', ')) AS k FROM qa) GROUP BY k"""
    dim5 = values([(t,) for t in D.MAIN_TOPICS])
    sql['topic_daily_trend'] = BASE + f"""SELECT d."Datum", c."Kategorie", count(x.id) AS "Anzahl"
FROM (SELECT DISTINCT "Datum" FROM qa) d CROSS JOIN ({dim5}) c("Kategorie")
LEFT JOIN qa x ON x."Datum" = d."Datum" AND contains(x."Kategorie", c."Kategorie")
GROUP BY d."Datum", c."Kategorie\""""
    sql['topic_mean_length'] = BASE.rstrip() + """,
c AS (
  SELECT k AS "Kategorie", count(*) AS "Anzahl"
  FROM (SELECT unnest(string_split("Kategorie", ', ')) AS k FROM qa) GROUP BY k
  ORDER BY "Anzahl" DESC, "Kategorie" LIMIT 10)
SELECT c."Kategorie", c."Anzahl",
  (SELECT CAST(sum("Fragenlänge_Zeichen") AS DOUBLE) / count("Fragenlänge_Zeichen") FROM qa
   WHERE contains(qa."Kategorie", c."Kategorie")) AS "Durchschnittslänge"
FROM c"""
    page = """SELECT id, "Datum", strftime("Datetime", '%H:%M') AS "Uhrzeit", "Wochentag", "Fragenlänge_Zeichen",
  "Kategorie", left("Frage", 100) || '...' AS "Titel", "Frage",
  CASE WHEN length("Antwort") > 1000 THEN left("Antwort", 1000) || '...' ELSE "Antwort" END AS "Antwort"
FROM qa WHERE {where} ORDER BY "Datetime", id LIMIT 50"""
    sql['search_count'] = BASE + f"""SELECT count(*) AS "Gefunden" FROM qa
WHERE regexp_matches("Frage", {s(Q.SEARCH_COUNT_TERM)}, 'i')"""
    sql['search_questions'] = BASE + page.format(where=f'regexp_matches("Frage", {s(Q.SEARCH_PAGE_TERM)}, \'i\')')
    sql['search_by_date'] = BASE + page.format(
        where=f'"Datum" BETWEEN DATE {s(Q.SEARCH_FROM)} AND DATE {s(Q.SEARCH_TO)}')
    sql['search_day_table'] = sql['search_by_date']
    sql['search_index'] = sql['search_questions']
    sql['daily_keywords'] = sql['top_keywords']
    sql['daily_topic_trend'] = sql['topic_daily_trend']
    sql['daily_length_stats'] = sql['length_stats']
    base_latest = BASE.rstrip() + ',\n' + LATEST + '\n'
    sql['latest_messages'] = base_latest + 'SELECT nr, id, text, role, datetime FROM latest'
    sql['classify_messages'] = BASE_CLS + 'SELECT conv_id, turn, datetime, frage, rolle, kategorie, sentiment FROM cls'
    sql['classification_export'] = BASE_CLS + 'SELECT frage, rolle, kategorie, sentiment, datetime FROM cls'
    sql['classify_latest'] = base_latest + 'SELECT nr, id, datetime, frage, rolle, kategorie, sentiment FROM lcls'
    sql['classification_summary'] = BASE_CLS + """SELECT count(*) AS analysiert,
  CAST(count_if(kategorie = 'essen/fleisch') AS BIGINT) AS essen_fleisch,
  CAST(count_if(kategorie = 'essen/fleisch') AS DOUBLE) * 100 / count(*) AS essen_fleisch_pct,
  CAST(count_if(sentiment = 'positiv') AS BIGINT) AS positiv,
  CAST(count_if(sentiment = 'positiv') AS DOUBLE) * 100 / count(*) AS positiv_pct,
  CAST(count_if(kategorie = 'aggressiv') AS BIGINT) AS aggressiv,
  CAST(count_if(kategorie = 'aggressiv') AS DOUBLE) * 100 / count(*) AS aggressiv_pct
FROM cls"""
    sql['category_counts'] = BASE_CLS + 'SELECT kategorie, count(*) AS "Anzahl" FROM cls GROUP BY kategorie'
    sql['sentiment_counts'] = BASE_CLS + 'SELECT sentiment, count(*) AS "Anzahl" FROM cls GROUP BY sentiment'
    sql['classification_filtered'] = BASE_CLS + f"""SELECT conv_id, turn, strftime(datetime, '%d.%m.%Y %H:%M') AS "Zeit",
  rolle AS "Rolle", kategorie AS "Kategorie", sentiment AS "Sentiment",
  CASE WHEN length(frage) > 200 THEN left(frage, 200) || '...' ELSE frage END AS "Nachricht"
FROM cls WHERE kategorie = {s(Q.FILTER_CATEGORY)} AND sentiment = {s(Q.FILTER_SENTIMENT)}"""
    sql['filter_choices'] = BASE_CLS + """SELECT DISTINCT 'kategorie' AS feld, kategorie AS wert FROM cls
UNION SELECT DISTINCT 'sentiment', sentiment FROM cls"""
    sql['sentiment_timeline'] = base_latest + """SELECT CAST(count(*) OVER () + 1 - row_number() OVER (ORDER BY nr) AS BIGINT) AS "Nachricht",
  CASE sentiment WHEN 'positiv' THEN 1 WHEN 'negativ' THEN -1 ELSE 0 END AS "Sentiment_Score",
  sentiment AS "Sentiment", datetime AS "Zeit" FROM lcls"""
    sql['scored_messages'] = BASE_CLS + """SELECT conv_id, turn, frage, rolle,
  CASE length(frage) % 6 WHEN 0 THEN 'neutral' WHEN 1 THEN 'essen/fleisch' WHEN 2 THEN 'anderes'
       ELSE kategorie END AS kategorie,
  CASE length(frage) % 6 WHEN 0 THEN 'positiv' WHEN 1 THEN 'neutral' WHEN 2 THEN 'neutral'
       ELSE sentiment END AS sentiment,
  CASE WHEN length(frage) % 6 < 3 THEN 'modell' ELSE 'regel' END AS quelle
FROM cls"""
    sql['scored_batches'] = BASE_CLS + """SELECT conv_id, turn, frage, rolle,
  CASE length(frage) % 6 WHEN 0 THEN 'neutral' WHEN 1 THEN 'essen/fleisch' WHEN 2 THEN 'anderes'
       WHEN 3 THEN 'aggressiv' ELSE kategorie END AS kategorie,
  CASE length(frage) % 6 WHEN 0 THEN CASE WHEN rolle = 'user' THEN 'positiv' ELSE 'negativ' END WHEN 1 THEN 'neutral'
       WHEN 2 THEN 'neutral' WHEN 3 THEN 'positiv' ELSE sentiment END AS sentiment,
  CASE WHEN length(frage) % 6 < 4 THEN 'modell' ELSE 'regel' END AS quelle
FROM cls"""
    sql['classify_dirty_messages'] = f"""WITH {FX},
msg AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9) || ' '
               WHEN 3 THEN '4711001' WHEN 4 THEN ' top ' ELSE text END AS text, role, created AS datetime FROM fx),
{CLASSIFIED}
SELECT conv_id, turn, datetime, frage, rolle, kategorie, sentiment FROM cls"""
    dkw = keywords('documents', 'text', ['doc_id'], Q.TOP_KEYWORDS)
    sql['document_keywords'] = 'WITH ' + dkw + """
SELECT CAST(row_number() OVER (ORDER BY n DESC, doc_id, pos) AS INTEGER) AS "Rang",
       w AS "Keyword", n AS "Anzahl" FROM top"""
    sql['document_classification'] = f"""WITH c0 AS (SELECT text, {category_sql('text')} AS kategorie FROM documents),
c AS (SELECT kategorie, {sentiment_sql('text', 'kategorie')} AS sentiment FROM c0)
SELECT kategorie, sentiment, count(*) AS "Anzahl" FROM c GROUP BY kategorie, sentiment"""
    sql['document_topic_counts'] = f"""SELECT k AS "Kategorie", count(*) AS "Anzahl"
FROM (SELECT unnest(string_split({topics_sql('lower(text)', Q.DOCUMENT_TOPICS)}, ', ')) AS k FROM documents) GROUP BY k"""
    sql['document_length_stats'] = """SELECT CAST(min(length(text)) AS INTEGER) AS min_laenge,
  CAST(max(length(text)) AS INTEGER) AS max_laenge,
  CAST(sum(length(text)) AS DOUBLE) / count(length(text)) AS mittlere_laenge,
  CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_laenge FROM documents"""
    ev = f"""WITH ev AS (SELECT event_id AS id, ts AS "Datetime", {weekday_sql('ts')} AS "Wochentag",
  CAST(hour(ts) AS INTEGER) AS "Stunde", {daypart_sql('hour(ts)')} AS "Tageszeit" FROM events)
"""
    sql['event_weekday_hour'] = ev + heat.format(src='ev', counted='id')
    sql['event_daypart_counts'] = ev + dense('ev', '"Tageszeit"', D.DAYPART_ORDER, 'Tageszeit')
    sql['event_hour_counts'] = ev + 'SELECT "Stunde", count(*) AS "Anzahl" FROM ev GROUP BY "Stunde"'
    sql['stream_daily_counts'] = f"""WITH {FX}
SELECT date_trunc('day', created) AS window_start, date_trunc('day', created) + INTERVAL 1 DAY AS window_end,
       count(*) AS "Anzahl" FROM fx GROUP BY 1, 2"""
    sql['stream_late_counts'] = f"""WITH {FX},
wm AS (SELECT max(created) - INTERVAL {Q.LATE_DAYS} DAY AS passed FROM fx WHERE role = 'user'),
d AS (SELECT date_trunc('day', created) AS day, role, passed FROM fx, wm)
SELECT day AS window_start, day + INTERVAL 1 DAY AS window_end, count(*) AS "Anzahl"
FROM d WHERE role = 'user' OR day + INTERVAL 1 DAY > passed GROUP BY day"""
    sql['stream_classification_counts'] = BASE_CLS + """SELECT kategorie, sentiment, count(*) AS "Anzahl"
FROM cls GROUP BY kategorie, sentiment"""
    return sql


ORACLE_SQL = _sql()
