"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments to a password-like name, access key
ids, long hexadecimal strings. Weak parts do not: an identifier
(`client_id = ...`, `user: ...`, an upper-case key id), an opaque token (mixed
letters and digits, high character variety) and an endpoint (a URL or host
with a port). A weak part is reported only when complementary parts lie near
it in the same scope: a token needs an identifier or an access key, an
identifier needs a token or a strong secret, an endpoint needs both.

A scope is a paragraph (text between blank lines). Parts are rows; the linking
is an interval join on (text, scope, distance bin) with at most `GAP`
characters between two parts; a part is in every bin of its span, however
long. A part is at least 5 characters long and parts of one kind do not
overlap, so a part has at most (2 * GAP + its length) / 5 partners of a kind,
however long the text is.

Edge cases: a null or empty text has no findings; repeated rows and equal ids
are scanned and reported row by row; an empty table gives no rows; other
columns are not read. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_table

GAP = 200
#: Strong findings, in the order of their kinds.
ASSIGN = re.compile(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', re.I | re.A)
ACCESS = re.compile(r'AKIA[A-Z0-9]+')
HEX = re.compile(r'[0-9a-f]{24,}')  # a maximal run, as with [0-9a-f]+ and a check of its length
KINDS = ('assign', 'access', 'hex', 'identifier', 'opaque', 'endpoint')
#: Weak parts, as long as they run.
IDENTIFIER = re.compile(r'(?:client_?id|user_?name|user|login|account|key_?id)["\']?\x20*[:=]\x20*["\']?'
                        r'[A-Za-z0-9_.@-]{4,}+', re.I | re.A)
OPAQUE = re.compile(r'(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+')
ENDPOINT = re.compile(r'[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"\'<>]{4,}+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}'
                      r'(?:\.[A-Za-z0-9-]{1,63})++:[0-9]{2,5}(?![0-9])')
MIN_ENTROPY = 3.5
_BLANK = re.compile(r'\n[ \t]*\n')


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong findings by start, then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ('passw', 'secret', 'token', 'api')):
        found += [('assign', *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if 'AKIA' in text:
        found += [('access', *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [('hex', *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def weak_parts(text: str, strong) -> list[tuple[str, int, int]]:
    """Identifiers, opaque tokens and endpoints beside the strong findings
    (which are in order of their start)."""
    found = [('identifier', *m.span()) for m in IDENTIFIER.finditer(text)]
    if '.' in text or '://' in text:
        found += [('endpoint', *m.span()) for m in ENDPOINT.finditer(text)]
    found += [('opaque', *m.span()) for m in OPAQUE.finditer(text) if _entropy(m[0]) >= MIN_ENTROPY]
    if not found or not strong:
        return found
    # the furthest end of the strong spans that begin before a part's end
    starts, ends = [a for _, a, _ in strong], list(accumulate((b for _, _, b in strong), max))

    def beside(x):
        at = bisect_left(starts, x[2])
        return not at or ends[at - 1] <= x[1]

    return [x for x in found if beside(x)]


_SPAN = T.ArrayType(T.StructType([T.StructField('kind', T.StringType()), T.StructField('start', T.IntegerType()),
                                  T.StructField('end', T.IntegerType()), T.StructField('scope', T.IntegerType())]))


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, strong, weak): the spans of every row; weak parts only of
    texts that have two or more parts in all."""
    src = docs.select('doc_id', F.coalesce('text', F.lit('')).alias('text'))
    schema = T.StructType([src.schema['doc_id'], T.StructField('strong', _SPAN), T.StructField('weak', _SPAN)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = to_arrow_type(_SPAN)
        for b in batches:
            strong, weak = [], []
            for text in (x.as_py() for x in b.column(1)):
                s = strong_spans(text)
                w = weak_parts(text, s)
                if w and len(s) + len(w) > 1:
                    blanks = [m.start() for m in _BLANK.finditer(text)]
                else:
                    w, blanks = [], []
                rows = [[{'kind': k, 'start': a, 'end': e, 'scope': bisect_left(blanks, a)} for k, a, e in x]
                        for x in (s, w)]
                strong.append(rows[0])
                weak.append(rows[1])
            yield pa.record_batch([b.column(0), pa.array(strong, kind), pa.array(weak, kind)],
                                  names=schema.fieldNames())

    return scratch_table(src.mapInArrow(run, schema).withColumn('row', F.monotonically_increasing_id()), 'secrets')


def linked_parts(scanned: DataFrame, gap: int = GAP) -> DataFrame:
    """(row, kind, start, end): the weak parts with their complement near them."""
    some = scanned.filter(F.size('weak') > 0)
    parts = some.select('row', F.explode(F.concat('strong', 'weak')).alias('p')).select('row', 'p.*')
    # what a part counts as for others
    role = (F.when(F.col('kind').isin('identifier', 'access'), 'id')
            .when(F.col('kind').isin('assign', 'hex', 'opaque'), 'secret').otherwise('endpoint'))
    left = parts.filter(F.col('kind').isin('identifier', 'opaque', 'endpoint')).withColumn(
        'bin', F.explode(F.sequence(F.floor((F.col('start') - gap - 1) / gap), F.floor((F.col('end') + gap) / gap))))
    # a long part lies in every bin of its span
    right = parts.select(F.col('row').alias('r'), F.col('scope').alias('s'), F.col('start').alias('a'),
                         F.col('end').alias('e'), role.alias('role'),
                         F.explode(F.sequence(F.floor(F.col('start') / gap), F.floor((F.col('end') - 1) / gap))).alias('bin'))
    near = left.join(right, (F.col('row') == F.col('r')) & (F.col('scope') == F.col('s')) & (left.bin == right.bin)
                     & (F.col('a') <= F.col('end') + gap) & (F.col('start') <= F.col('e') + gap)
                     & ((F.col('a') != F.col('start')) | (F.col('e') != F.col('end'))))
    met = near.groupBy('row', 'kind', 'start', 'end').agg(F.max((F.col('role') == 'id').cast('int')).alias('has_id'),
                                                          F.max((F.col('role') == 'secret').cast('int')).alias('has_secret'))
    ok = (F.when(F.col('kind') == 'opaque', F.col('has_id') == 1)
          .when(F.col('kind') == 'identifier', F.col('has_secret') == 1)
          .otherwise((F.col('has_id') == 1) & (F.col('has_secret') == 1)))
    return met.filter(ok).select('row', 'kind', 'start', 'end')


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, strong, spans) of every row: the strong spans, and all reported
    spans, each by start, then kind."""
    scanned = scan(docs)
    extra = linked_parts(scanned).groupBy(F.col('row').alias('of')).agg(
        F.collect_list(F.struct('kind', 'start', 'end')).alias('linked'))

    def order(x):
        return F.transform(F.array_sort(F.transform(x, lambda s: F.struct(
            s['start'].alias('start'), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s['kind']).alias('o'),
            s['kind'].alias('kind'), s['end'].alias('end')))), lambda s: F.struct(
                s['kind'].alias('kind'), s['start'].alias('start'), s['end'].alias('end')))

    strong = F.transform('strong', lambda s: F.struct(s['kind'].alias('kind'), s['start'].alias('start'),
                                                      s['end'].alias('end')))
    return scanned.join(extra, F.col('row') == F.col('of'), 'left').select(
        'doc_id', strong.alias('strong'),
        F.when(F.col('linked').isNull(), strong).otherwise(order(F.concat(strong, 'linked'))).alias('spans'))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ':', s['kind'], s['start'].cast('string'), s['end'].cast('string'))), ',')
