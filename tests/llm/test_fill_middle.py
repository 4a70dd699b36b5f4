"""Fill-in-middle against plain slicing, and its rank structure by counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import fill_middle as fm
from chatlens.llm import queries
from test_llm_operators import case, edge_dir, empty_dir, many  # noqa: F401


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(doc_id, text):
    n = len(text)
    h = hashlib.sha256(f'1:{"" if doc_id is None else doc_id}'.encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    if not text or any(x in text for x in ('<P>', '<S>', '<M>')) or h3 % 100 >= 90:
        return doc_id, n, 'plain', None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, 'spm', a, z - a, sha(f'<S>{s}<P>{p}<M>{m}'), sha(text)
    return doc_id, n, 'psm', a, z - a, sha(f'<P>{p}<S>{s}<M>{m}'), sha(text)


def test_op11(spark, case):  # noqa: F811
    d, docs = case
    assert many(queries.op11_fill_middle(spark, d).collect()) == many(brute(i, t) for i, t, _ in docs)


def test_marks_and_odd_texts(spark):
    """Marks in whole or in parts, texts of one character, every width of code
    point, and a text of over two million characters."""
    texts = ['<P>', 'a<S>b', '<M', '<<M', '>', '<P', 'P>', 'x<', '<', '\0', 'é', '中', '🙂', '🙂🙂', '\n\n', ' ',
             'á', '﻿', '🙂é中a\n' * 450000, 'no mark <p> here ' * 9]
    rows = [(i, t) for i in range(40) for t in texts[:18]] + [(40 + i, t) for i in range(4) for t in texts[18:]]
    docs = spark.createDataFrame(rows, 'doc_id long, text string').repartition(4)
    got = fm.fim_digests(docs).collect()
    assert many(got) == many(brute(i, t) for i, t in rows)
    assert {r.form for r in got} == {'plain', 'psm', 'spm'}


def test_ranks_and_selects_by_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        seq = rng.integers(0, 8, n).astype(np.uint8)
        w = fm.WaveletMatrix(seq)
        at = np.arange(n + 1)
        for c in range(8):
            assert w.rank(c, at).tolist() == [int((seq[:i] == c).sum()) for i in at]


def pieces(text, unit):
    if unit == 'char':
        return list(text)
    if unit == 'line':
        return re.findall(r'[^\n]*\n|[^\n]+', text)
    return re.findall(r'[^ \t-\r]+[ \t-\r]*', text)


@pytest.mark.parametrize('unit', ['char', 'word', 'line'])
def test_units(unit):
    texts = ['', 'one two  three\n\nfour', ' leading and trailing ', '\n', 'a', '中文 🙂🙂 é\t\x0bx\r\ny', 'z\n', '\n\n a\nb']
    u = fm.Units([t.encode() for t in texts], unit)
    assert u.count.tolist() == [len(pieces(t, unit)) for t in texts]
    for i, t in enumerate(texts):
        p = pieces(t, unit)
        ahead = len(t) - len(''.join(p))  # white space in front of the first word
        for k in range(len(p) + 1):
            want = len((t[:ahead] + ''.join(p[:k])).encode()) if k else 0
            assert u.byte_of(np.array([i]), np.array([k])).tolist() == [want]


@pytest.mark.parametrize('unit', ['word', 'line'])
def test_whole_units_stay_together(spark, unit):
    text = 'first line here\nsecond line, longer\n\nfourth\n'
    docs = spark.range(60).select(F.col('id').alias('doc_id'), F.lit(text).alias('text'))
    out = fm.fill_in_middle(docs, unit, share=100, spm=50)
    rows = out.select('*', fm.restored(F.col('form'), F.col('output')).alias('back')).collect()
    assert {r.back for r in rows} == {text} and {r.form for r in rows} == {'psm', 'spm'}
    p = pieces(text, unit)
    for r in rows:
        a, z = r.prefix_units, r.prefix_units + r.middle_units
        assert r.n == len(p) and r.output.split('<M>')[1] == ''.join(p[a:z])
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs, 'page')
