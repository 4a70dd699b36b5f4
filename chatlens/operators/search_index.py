"""Trigram index for the question search.

Postings say which question holds which three characters. A search takes the
literal words that its pattern must match, keeps the rows that have all their
trigrams, opens only the days that hold such rows, and then tests the pattern
itself, so the result is that of the scan. Patterns without such a word are
scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import char_len
from ..sources.days import DAY
from .search import search_filter

#: Folders that the postings are spread over by their trigram.
BUCKETS = 64
# Characters whose case variants are single characters that fold() brings back.
_LITERAL = r'[A-Za-z0-9ÄÖÜäöü -]'
_GAP = r'\.[*+?]?'


def fold(text):
    """Lower case as a case-insensitive pattern sees it: the long s, the
    dotless and the dotted i and the Kelvin sign match s, i and k."""
    return F.lower(F.translate(text, 'ſıİK', 'siik'))


def required_words(term: str) -> list[list[str]] | None:
    """Per alternative of a pattern the folded words that every match holds,
    or None if the pattern is more than words, `.`, `.*`, `.+`, `.?` and `|`, or
    an alternative has no word of three characters."""
    if not re.fullmatch(f'({_LITERAL}|{_GAP}|\\|)*', term):
        return None
    words = [[w.lower() for w in re.split(_GAP, part) if len(w) >= 3] for part in term.split('|')]
    return words if all(words) else None


def trigrams(word: str) -> list[str]:
    return sorted({word[i:i + 3] for i in range(len(word) - 2)})


def add_to_index(qa: DataFrame, path: str, id_col: str = 'id') -> None:
    """Append the postings (gram, Datum, id) of new or changed rows. Each
    row's trigrams are distinct and found in the row, so nothing is
    aggregated. Postings of rows that were replaced, or written twice by a
    load that was run again, stay: they make candidates, never results."""
    low = fold(F.col('Frage'))
    rows = qa.select(DAY, F.col(id_col).alias('id'), low.alias('t')).filter(char_len('t') >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), char_len('t') - 2), lambda i: F.col('t').substr(i, F.lit(3))))
    post = rows.select(F.explode(grams).alias('gram'), DAY, 'id')
    post = post.withColumn('bucket', F.pmod(F.xxhash64('gram'), F.lit(BUCKETS)).cast('int'))
    # sorted by gram, so that a lookup reads the row groups of its trigrams only
    (post.hint('rebalance', 'bucket').sortWithinPartitions('bucket', 'gram')
     .write.mode('append').partitionBy('bucket').parquet(path))


def read_index(spark: SparkSession, path: str, id_type: str = 'bigint') -> DataFrame:
    schema = f'gram string, {DAY} date, id {id_type}, bucket int'
    return spark.read.schema(schema).parquet(path)


def candidates(index: DataFrame, words: list[list[str]]) -> DataFrame:
    """(Datum, id) of the rows that hold every trigram of an alternative's
    words. Postings are narrowed by folder and by gram in the scan; a row's
    grams are bits of a few longs, added up map-side."""
    spark = index.sparkSession
    grams = sorted({g for alt in words for w in alt for g in trigrams(w)})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], 'gram string').select(
        F.pmod(F.xxhash64('gram'), F.lit(BUCKETS)).cast('int')).distinct().collect()]
    found = index.filter(F.col('bucket').isin(buckets) & F.col('gram').isin(grams))
    place = {g: i for i, g in enumerate(grams)}
    n = -(-len(grams) // 63)

    def bits(of, k):
        return sum(1 << (place[g] % 63) for g in set(of) if place[g] // 63 == k)

    def has(k):
        return F.bit_or(F.coalesce(*[F.when(F.col('gram') == g, F.lit(1 << (i % 63)).cast('long'))
                                     for g, i in place.items() if i // 63 == k], F.lit(0).cast('long'))).alias(f'b{k}')

    rows = found.groupBy(DAY, 'id').agg(*[has(k) for k in range(n)])
    keep = F.lit(False)
    for alt in words:
        need, ok = [g for w in alt for g in trigrams(w)], F.lit(True)
        for k in range(n):
            mask = F.lit(bits(need, k)).cast('long')
            ok = ok & (F.col(f'b{k}').bitwiseAND(mask) == mask)
        keep = keep | ok
    return rows.filter(keep).select(DAY, 'id')


def search_indexed(qa: DataFrame, index: DataFrame, term: str, start=None, end=None,
                   literal: bool = False) -> DataFrame:
    """`search.search_filter` by the index. `qa` is best the table partitioned
    by day: the join's days prune its folders while the query runs."""
    plain = not literal or re.fullmatch(f'{_LITERAL}*', term)
    words = required_words(term) if plain else None
    if not term or words is None:
        return search_filter(qa, term, start, end, literal)
    rows = candidates(search_filter(index, '', start, end), words)
    near = rows.select(F.col(DAY).alias('_day'), F.col('id').alias('_id'))
    hits = qa.join(near, (F.col(DAY) == F.col('_day')) & (F.col('id') == F.col('_id')), 'left_semi')
    return search_filter(hits, term, start, end, literal)
