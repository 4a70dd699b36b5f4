"""Each operator's query against a brute-force version on the whole smallest
table, and on a hand-made table of edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatlens.llm import importance, line_dedup, merkle, packing, pii, quality, queries, secret_scan, simhash, token_orc, tokens
from chatlens.llm.common import scratch_path

from conftest import SF0001

W = re.compile(r'[^\x20\x09-\x0D]+')
EDGE = [
    (5, 'one two three four five six seven eight nine ten eleven', 'en', 'a', 1),
    (5, 'one two three four five six seven eight nine ten eleven', 'en', 'a', 1),
    (5, 'the same id with another text of more than ten words in all, yes', 'en', None, 1),
    (None, 'a null id and password = "hunter22" mail x@y.org 1.2.3.4 4111 1111 1111 1111 +1 (555) 555-0100', None, 'b', 1),
    (None, None, 'de', 'b', 1),
    (7, None, None, None, None),
    (8, '', 'en', 'b', 0),
    (9, '  \n\t \n', 'en', 'b', 0),
    (10, 'w' * 70000, 'en', 'b', 0),
    (11, ' '.join(f'w{i % 9000}' for i in range(30000)) + '\nAKIA' + 'Z9' * 10 + ' ' + '0af' * 10, 'fr', 'a', 0),
    (12, 'é à 中文 🙂 ß́\n' * 3 + 'a line of six words here\na line of seven words here now', 'de', '', 0),
    (-3, 'a line of six words here\na line of six words there\nshort\nshort', 'de', 'ü', 0),
    (1 << 60, 'The Cat sat on the mat. ' * 12, 'en', 'a', 3)]


@pytest.fixture(scope='module')
def edge_dir(spark, tmp_path_factory):
    """The edge cases as tables, with more columns, some of them named like
    the operators' own."""
    d = str(tmp_path_factory.mktemp('edge'))
    docs = spark.createDataFrame(EDGE, 'doc_id bigint, text string, lang string, source string, n_chars bigint')
    for c in ('start', 'size', 'block', 'row', 'rank', 'fp', 'kept', 'line', '_row', 'copies'):
        docs = docs.withColumn(c, F.lit('x'))
    docs.repartition(3).write.parquet(d + '/documents.parquet')
    spark.createDataFrame([(5, 1, 0), (8, 0, 1), (11, 1, 0), (None, 1, 0)],
                          'doc_id bigint, quality int, toxic int').write.parquet(d + '/labels.parquet')
    return d


@pytest.fixture(scope='module')
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp('empty'))
    spark.createDataFrame([], 'doc_id bigint, text string, lang string, source string, n_chars bigint'
                          ).write.parquet(d + '/documents.parquet')
    spark.createDataFrame([], 'doc_id bigint, quality int, toxic int').write.parquet(d + '/labels.parquet')
    return d


@pytest.fixture(scope='module', params=['given', 'edge'])
def case(request, spark, edge_dir):
    d = SF0001 if request.param == 'given' else edge_dir
    rows = spark.read.parquet(d + '/documents.parquet').select('doc_id', 'text', 'lang', 'source').collect()
    return d, [(r.doc_id, r.text or '', r.source) for r in rows]


def many(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize('name', sorted(queries.QUERIES))
def test_empty_table(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_op1_counts(spark, case):
    d, docs = case
    want = Counter()
    for doc_id, text, _ in docs:
        words = W.findall(text)
        lines = [x for x in text.split('\n') if W.search(x)]
        runs = Counter(zip(*(words[k:] for k in range(5))))
        hit = {i + k for i, r in enumerate(zip(*(words[k:] for k in range(5)))) if runs[r] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        want[(doc_id, len(words), sum(map(len, words)), len(re.findall(r'[#*$%&|<>]', text)),
              len(lines) - len(set(lines)), len(hit), failed)] += 1
    got = queries.op1_quality_outliers(spark, d).collect()
    assert many(r[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_op1_rejects_junk_and_keeps_clean(spark):
    """The labelled good documents stay, most of the labelled bad ones go."""
    d = '/root/testdata/sf0.01'
    got = queries.op1_quality_outliers(spark, d).join(spark.read.parquet(d + '/labels.parquet'), 'doc_id').collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * sum(not r.base_failed for r in good)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_op1_estimate_resists_contamination(spark):
    """A fifth of far-off vectors moves the mean of all, not the estimate."""
    rng = np.random.default_rng(1)
    clean = rng.normal(200, 30, 800).astype(int)
    rows = [('en', 's', int(n), int(n) * 5, 0, 0, 0, int(n) // 10, 10, False) for n in clean]
    rows += [('en', 's', 200, 1000, 900, 0, 0, 20, 10, False)] * 200
    stats = spark.createDataFrame(rows, 'lang string, source string, n_words long, word_chars long, n_symbols long, '
                                  'n_dup_lines long, n_repeat_words long, n_capitals long, n_lines long, '
                                  'base_failed boolean')
    got = quality.judge(stats, *quality.fit(stats)).collect()
    assert all(r.kept == (r.n_symbols == 0) for r in got)


def test_op2_packing(spark, case):
    d, docs = case
    tok = Tokenizer.from_file(public_tokenizers.path('byte_bpe_50k.json'))
    tok.encode_special_tokens = True
    ids = [tok.encode(t, add_special_tokens=False).ids + [0] for _, t, _ in docs]
    got = queries.op2_mixture_packing(spark, d).collect()
    assert sum(r.length for r in got) == sum(map(len, ids))
    # every slice of every document is a piece, as often as the document occurs
    by_doc = defaultdict(list)
    for (doc_id, _, source), x in zip(docs, ids):
        by_doc[doc_id, source, len(x)].append(x)
    cover = defaultdict(Counter)
    for r in got:
        match = [x for x in by_doc[r.doc_id, r.source, r.doc_tokens]
                 if zlib.crc32(np.array(x[r.start:r.start + r.length], '<u4').tobytes()) == r.ids_crc32]
        assert match and r.length > 0 and r.start + r.length <= r.doc_tokens
        cover[r.doc_id, r.source, r.doc_tokens].update(range(r.start, r.start + r.length))
    for k, x in by_doc.items():
        assert set(cover[k].values()) == {len(x)} and len(cover[k]) == k[2]
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    total = sum(map(len, ids))
    assert sorted(seqs) == list(range(-(-total // 1024)))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == (1024 if s < len(seqs) - 1 else total - 1024 * s)


def test_op2_keeps_proportions(spark):
    """After any number of windows every source is within two packets of its
    share of what has been packed."""
    got = queries.op2_mixture_packing(spark, '/root/testdata/sf0.01').collect()
    total, size = Counter(), sum(r.length for r in got)
    for r in got:
        total[r.source] += r.length
    seqs = defaultdict(Counter)
    for r in got:
        seqs[r.sequence_id][r.source] += r.length
    seen, done = Counter(), 0
    for s in sorted(seqs):
        seen.update(seqs[s])
        done += sum(seqs[s].values())
        assert all(abs(seen[x] - done * total[x] / size) <= 2 * packing.PACKET + 64 for x in total)


def brute_fingerprint(text):
    words = W.findall(re.sub('[A-Z]', lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [' '.join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    """Smallest id by fingerprint over links of 2 bits or fewer, and that of
    each component."""
    nodes = sorted({f for _, f in marks})
    label = {f: f for f in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    first = {}
    for doc_id, f in marks:
        r = root(f)
        if doc_id is not None and (first.get(r) is None or doc_id < first[r]):
            first[r] = doc_id
    return {f: first.get(root(f)) for f in nodes}, [first.get(r) for r in {root(f) for f in nodes}]


def test_op3_simhash(spark, case):
    d, docs = case
    marks = [(doc_id, brute_fingerprint(t)) for doc_id, t, _ in docs]
    comp, _ = brute_components(marks)
    want = many((doc_id, f'{f:016x}', comp[f]) for doc_id, f in marks)
    assert many(queries.op3_simhash_anchors(spark, d).collect()) == want


def test_op3_anchors_find_every_close_pair(spark):
    """Random fingerprints, and chains and balls of neighbours around some."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:40].tolist():
        for _ in range(12):
            a, b = rng.integers(0, 64, 2).tolist()
            fps.add(x ^ (1 << a) ^ (1 << b))
            x = x ^ (1 << a) if rng.random() < 0.5 else x
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], 'fp long')).collect()
    mask = (1 << 64) - 1
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_op4_token_orc(spark, case):
    d, docs = case
    tok = Tokenizer.from_file(public_tokenizers.path('word_bpe_49k.json'))
    tok.encode_special_tokens = True
    at, want = 0, Counter()
    for doc_id, text, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        want[doc_id, at, len(ids), zlib.crc32(np.array(ids, '<u4').tobytes())] += 1
        at += len(ids)
    assert many(queries.op4_token_orc(spark, d).collect()) == want


@pytest.mark.parametrize('name', ['byte_bpe_50k.json', 'word_bpe_49k.json'])
def test_op2_op4_ids_are_the_file_s_own(name):
    """Literal added tokens get the ids of the file's untouched tokenizer."""
    path = public_tokenizers.path(name)
    texts = ['x <|endoftext|> y', 'x <|startoftext|> y', 'a<|endoftext|>b and <|endoftext|>', '<|startoftext|><|endoftext|>',
             'X <|EndOfText|> Y', '<|endoftext |>', 'end\n<|endoftext|>\nof it', '<|endoftext|', 'no such token here', '']
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    want = [tok.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == want


class CountingTokenizer:
    """A tokenizer that counts the ids it is asked for."""

    def __init__(self, tok):
        self.tok, self.n = tok, 0

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, texts, **kw):
        got = self.tok.encode_batch_fast(texts, **kw)
        self.n += sum(len(e.ids) for e in got)
        return got


def test_op4_words_are_encoded_once_without_separators():
    """The library gives each new word's ids and no others, and a full table
    keeps the words that were just looked up."""
    path = public_tokenizers.path('word_bpe_49k.json')
    rng = np.random.default_rng(3)
    words = sorted({''.join(rng.choice(list('abenrtß'), int(n))) for n in rng.integers(1, 12, 5000)})
    tok, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    want = [tok.encode(x, add_special_tokens=False).ids for x in words]
    enc.tok = CountingTokenizer(enc.tok)
    got = enc.encode([' '.join(words), *words])
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [sum(want, []), *want]
    assert enc.tok.n == sum(map(len, want))
    enc = tokens.Encoder(path, keep=3)
    enc.tok = CountingTokenizer(enc.tok)
    for text, n in (('a b c', 3), ('a b d', 4), ('d b a', 4), ('c', 5), ('c d a', 7)):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids and enc.tok.n == n


@pytest.mark.parametrize('name', ['byte_bpe_50k.json', 'word_bpe_49k.json'])
def test_op2_op4_joined_words_that_are_several(name):
    """Words that the library cuts or rewrites among plain ones, with a table
    that holds all pieces and with one that is always full."""
    path = public_tokenizers.path(name)
    rng = np.random.default_rng(5)
    atoms = ['a', 'Be', 'İ', 'ß', 'é', 'e\u0301', 'ª', 'ǅ', '中', '한', '\u1112\u1161', 'ﬁ', 'Σ', 'हि', 'the', "'s", '</w>',
             '1', '.', ' ', ' ', ' ', '\n', '\u00a0', '😀', '<|endoftext|>']
    texts = [''.join(rng.choice(atoms, int(n))) for n in rng.integers(0, 12, 3000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for enc in (tokens.Encoder(path), tokens.Encoder(path, keep=50)):
        got = [x for i in range(0, len(texts), 500) for x in enc.encode(texts[i:i + 500])]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == want


def test_op4_reads_single_documents(spark):
    path = scratch_path(spark, 'orc-test')
    docs = spark.read.parquet(SF0001 + '/documents.parquet')
    rows = token_orc.write_token_orc(docs, path, public_tokenizers.path('word_bpe_49k.json'), 2)
    one = token_orc.read_token_orc(spark, path, [17, 99])
    assert 'PushedFilters: [In(doc_id' in one._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in one.collect()) == [17, 99] and rows.count() == docs.count()


def word_distance(a, b):
    """Edit distance of two word lists, cell by cell."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def may_be_near(a, b):
    """Two lists one edit apart have all but one word in common."""
    return sum((Counter(a) & Counter(b)).values()) >= max(len(a), len(b)) - 1


def brute_lines(docs):
    """{(doc_id, text): (checked, exact, near)} by comparing every two lines."""
    places = sorted({(doc_id is not None, doc_id or 0, xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63), k, x)
                     for doc_id, t, _ in docs for k, x in enumerate(t.split('\n')) if W.search(x)})
    words = [W.findall(p[4]) for p in places]
    seen, uniq, out = {}, [], defaultdict(lambda: ([], []))
    for p, w in zip(places, words):
        key = tuple(w)
        if key in seen:
            out[p[:3]][0].append(p[3])
            continue
        seen[key] = p
        if len(w) < 5:
            continue
        if any(word_distance(w, v) < 2 for v in uniq if abs(len(v) - len(w)) < 2 and may_be_near(v, w)):
            out[p[:3]][1].append(p[3])
        uniq.append(w)
    # a later copy of a near line is an exact repeat
    return places, out


def test_op5_line_dedup(spark, case):
    d, docs = case
    places, out = brute_lines(docs)
    n = Counter(p[:3] for p in places)
    want = Counter()
    for doc_id, text in {(a, b) for a, b, _ in docs}:
        k = (doc_id is not None, doc_id or 0, xxhash.xxh64_intdigest(text.encode(), 42) ^ (1 << 63))
        exact, near = out[k]
        want[doc_id, n[k], len(exact), len(near), ','.join(map(str, sorted(exact))),
             ','.join(map(str, sorted(near)))] += 1
    got = Counter(map(tuple, queries.op5_line_dedup(spark, d).collect()))
    # a null and an empty text of one id are two texts to the operator
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if k[1]}
    assert {k[0] for k in got} == {a for a, _, _ in docs}


def test_op5_edits_and_templates(spark):
    rng = np.random.default_rng(3)
    vocab = [f'v{i}' for i in range(12)]
    lines = []
    for _ in range(150):
        w = rng.choice(vocab, rng.integers(5, 9)).tolist()
        lines.append(' '.join(w))
        for _ in range(2):
            x, i = list(w), int(rng.integers(0, len(w)))
            kind = rng.integers(0, 3)
            x[i:i + (kind > 0)] = [] if kind == 2 else [str(rng.choice(vocab))]
            lines.append(' '.join(x))
    lines += [f'a template line with number {i} in it' for i in range(200)]
    docs = [(i, '\n'.join(lines[i::40]), 's') for i in range(40)]
    df = spark.createDataFrame(docs, 'doc_id long, text string, source string')
    _, out = brute_lines(docs)
    got = {r.doc_id: (r.exact, r.near) for r in line_dedup.dropped_lines(df).collect()}
    want = {i: ([], []) for i in range(40)} | {k[1]: v for k, v in out.items()}
    assert got == want


def test_op5_short_lines_and_hot_lines(spark, monkeypatch):
    """Exact repeats of one word, of three, and of a line without spaces go;
    lines that nearly every document holds are found like any other."""
    monkeypatch.setattr(line_dedup, 'HOT_AT_LEAST', 20)
    docs = [(i, f'Weiter\n这是一个没有空格的中文句子\nread it all\n- {i} -\nthis is line {i} of text', 's') for i in range(60)]
    docs += [(100, 'Weiter\nWeiter\n}\n}\na b c d\na b c e', 's')]
    df = spark.createDataFrame(docs, 'doc_id long, text string, source string')
    got = {r.doc_id: (r.n_lines, r.exact, r.near) for r in line_dedup.dropped_lines(df).collect()}
    assert got[0] == (5, [], []) and got[100] == (6, [0, 1, 3], [])
    assert all(got[i] == (5, [0, 1, 2], [4]) for i in range(1, 60))
    _, out = brute_lines(docs)
    assert {k: v[1:] for k, v in got.items()} == {i: ([], []) for i, _, _ in docs} | {k[1]: v for k, v in out.items()}


def brute_secrets(text):
    out = [(m.start(), 0, 'assign', m.end()) for m in re.finditer(
        r'([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|'
        r'[aA][pP][iI]_?[kK][eE][yY])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', text) if len(m[2]) >= 6]
    out += [(m.start(), 1, 'access', m.end()) for m in re.finditer(r'AKIA[A-Z0-9]+', text) if len(m[0]) >= 20]
    out += [(m.start(), 2, 'hex', m.end()) for m in re.finditer(r'[0-9a-f]+', text) if len(m[0]) >= 24]
    return sorted(out)


def test_op6_base_findings(spark, case):
    d, docs = case
    want = Counter()
    for doc_id, text, _ in docs:
        s = brute_secrets(text)
        n = Counter(x[2] for x in s)
        joined = ','.join(f'{k}:{a}:{e}' for a, _, k, e in s)
        want[doc_id, n['assign'], n['access'], n['hex'], hashlib.sha256(joined.encode()).hexdigest()] += 1
    got = queries.op6_credential_linking(spark, d).collect()
    assert many(r[:5] for r in got) == want


def test_op6_links_only_complementary_parts(spark):
    token = 'Zk3vPq81LmXw02TtBn7Rs4'
    texts = [
        f'client_id = acme-prod-7 and then {token} near https://api.example.org/v1',   # all three
        f'nothing but {token} here',                                                    # alone
        f'client_id = acme-prod-7\n\n{token}',                                          # two scopes
        f'client_id = acme-prod-7 {"x " * 200}{token}',                                 # too far
        'user: maria https://example.org/a',                                            # no secret
        'user: maria password = "hunter22"']                                            # id beside a strong one
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id long, text string')
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.secrets(df).collect()}
    assert got == {0: ['identifier', 'opaque', 'endpoint'], 1: [], 2: [], 3: [], 4: [], 5: ['identifier', 'assign']}


def test_op6_links_long_parts(spark):
    """Parts of any length at random offsets link as every two compared."""
    rng = np.random.default_rng(11)
    role = {'identifier': 'id', 'access': 'id', 'assign': 'secret', 'hex': 'secret', 'opaque': 'secret',
            'endpoint': 'endpoint'}
    needs = {'identifier': {'secret'}, 'opaque': {'id'}, 'endpoint': {'id', 'secret'}}
    rows = [[('hex', 790, 850, 0), ('identifier', 1000, 1020, 0)], [('assign', 0, 700, 0), ('identifier', 720, 740, 0)]]
    for _ in range(400):
        parts = set()
        for _ in range(rng.integers(2, 6)):
            a, n = int(rng.integers(0, 2500)), int(rng.choice([5, 24, 150, 270, 700, 1500]))
            parts.add((str(rng.choice(secret_scan.KINDS)), a, a + n, int(rng.integers(0, 8) == 0)))
        rows.append(sorted(parts))
    want = set()
    for i, parts in enumerate(rows):
        for k, a, e, s in parts:
            met = {role[p[0]] for p in parts if p[3] == s and (p[1], p[2]) != (a, e)
                   and p[1] - e <= secret_scan.GAP and a - p[2] <= secret_scan.GAP}
            if k in needs and needs[k] <= met:
                want.add((i, k, a, e))
    span = 'array<struct<kind:string,start:int,end:int,scope:int>>'
    df = spark.createDataFrame([(i, [p for p in x if p[0] not in needs], [p for p in x if p[0] in needs])
                                for i, x in enumerate(rows)], f'row long, strong {span}, weak {span}')
    got = [tuple(r) for r in secret_scan.linked_parts(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_op6_weak_parts_of_any_length(spark):
    token = 'Zk3vPq81LmXw02TtBn7Rs4'
    texts, want = [], []
    for n in (20, 128, 129, 300, 5000, 200000):
        long, name, host = (token * (n // 22 + 1))[:n], 'u' * n, '.'.join(['node'] * (n // 5))
        key = f'AKIA{"Z9" * 10}'
        texts += [f'{long} user: maria https://api.example.org/{name}', f'client_id = {name} {key} {long}',
                  f'user: maria password = "hunter22" at {host}:8443']
        want += [[long, 'user: maria', f'https://api.example.org/{name}'], [f'client_id = {name}', key, long],
                 ['user: maria', 'password = "hunter22', f'{host}:8443']]
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id long, text string')
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in secret_scan.secrets(df).collect()}
    assert got == dict(enumerate(want))


def test_op6_weak_parts_beside_strong_ones():
    """Weak parts that overlap no strong span, as every two compared; dense
    texts of a megabyte too."""
    rng = np.random.default_rng(4)
    parts = ['user: ', 'maria', 'password = ', 'hunter22', 'Zk3vPq81LmXw02TtBn7Rs4', ' ', 'https://a.b.org/', 'AKIA' + 'Z9' * 10,
             '0af1' * 8, 'x.y:8443', '\n', 'token:', '"']
    for _ in range(500):
        text = ''.join(rng.choice(parts, rng.integers(2, 30)))
        strong, every = secret_scan.strong_spans(text), secret_scan.weak_parts(text, [])
        assert secret_scan.weak_parts(text, strong) == [
            x for x in every if not any(a < x[2] and x[1] < b for _, a, b in strong)]
    unit = f'user: maria password = "hunter22" Zk3vPq81LmXw02TtBn7Rs4 {"0af1" * 8}\n'
    text = unit * (1_000_000 // len(unit))
    assert len(secret_scan.weak_parts(text, secret_scan.strong_spans(text))) == 2 * (1_000_000 // len(unit))


def test_op7_takes_the_top_k(spark):
    d = '/root/testdata/sf0.01'
    docs, labels = (spark.read.parquet(f'{d}/{t}.parquet') for t in ('documents', 'labels'))
    got = importance.resample(docs, labels, k=300).collect()
    border = sorted((r.key for r in got), reverse=True)[299]
    assert len(got) == 1000 and all(r.kept == (r.key >= border) for r in got)
    assert sum(r.kept for r in importance.resample(docs, labels, k=0).collect()) == 0


def test_op7_held_out_quality(spark):
    """Fitted on the even ids' labels, the ratio ranks the odd ids' labels."""
    d = '/root/testdata/sf0.01'
    docs, labels = (spark.read.parquet(f'{d}/{t}.parquet') for t in ('documents', 'labels'))
    got = importance.resample(docs, labels.filter('doc_id % 2 = 0')).join(
        labels.filter('doc_id % 2 = 1'), 'doc_id').collect()
    good = [r.log_ratio for r in got if r.quality == 1]
    bad = [r.log_ratio for r in got if r.quality == 0]
    wins = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.85


def test_op7_edge_cases(spark, edge_dir):
    got = queries.op7_importance_resampling(spark, edge_dir).collect()
    assert len(got) == len(EDGE) and all(r.log_ratio == 0 for r in got if r.n_ngrams == 0)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or '').encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        w = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in rest}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)


def test_op8_mixing(spark, case):
    d, docs = case
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(W.findall(t))
    target = brute_targets(sizes)
    source_of = defaultdict(set)
    for doc_id, t, s in docs:
        source_of[doc_id, len(W.findall(t))].add(s)
    got = queries.op8_source_mixing(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        assert any(sizes[s] == r.source_size and abs(target[s] - r.target) < 1e-6 * (1 + r.target)
                   for s in source_of[r.doc_id, r['size']])
        assert 0 <= r.taken <= 2 * r['size']
    assert many(queries.op8_source_mixing(spark, d).collect()) == many(got)


def test_op8_comes_near_targets(spark):
    got = queries.op8_source_mixing(spark, '/root/testdata/sf0.1').groupBy('source_size', 'target').agg(
        F.sum('taken').alias('taken')).collect()
    assert all(abs(r.taken - r.target) <= 0.15 * r.target for r in got)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    def digits(m):
        return re.sub('[^0-9]', '', m[0])
    out = [('email', *m.span()) for m in re.finditer(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', text)]
    out += [('ip', *m.span()) for m in re.finditer(r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', text)
            if all(int(x) <= 255 for x in m[0].split('.'))]
    out += [('card', *m.span()) for m in re.finditer(r'[0-9]([\x20-]?[0-9])+', text)
            if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [('phone', *m.span()) for m in re.finditer(r'\+[0-9][\x20().0-9-]+[0-9]', text)
                  if 9 <= len(digits(m)) <= 15]


def pii_row(doc_id, text):
    s = brute_pii(text)
    n = Counter(x[0] for x in s)
    return (doc_id, n['email'], n['ip'], n['card'], n['phone'],
            hashlib.sha256(','.join(f'{k}:{a}:{e}' for k, a, e in s).encode()).hexdigest())


def test_op9_base_findings(spark, case):
    d, docs = case
    got = queries.op9_pii_weak_supervision(spark, d).collect()
    assert many(r[:6] for r in got) == Counter(pii_row(doc_id, t) for doc_id, t, _ in docs)


def test_op9_borders(spark):
    rng = np.random.default_rng(5)
    parts = ['a', 'b.c', '@', 'x@y.z', '.', '%', '-', '+', '+1', '1', '12', '256', '1.2.3.4', '001.2.3.255', ' ', '\n',
             '4111111111111111', '4111-1111 1111 1111', '5500005555555559', '(', ')', '555-0100', '🙂', 'é', '_', '(at)']
    texts = [''.join(rng.choice(parts, rng.integers(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id long, text string')
    found = pii.personal_data(df).select('doc_id', *queries._counts('base', pii.KINDS),
                                         F.sha2(pii.joined('base'), 256)).collect()
    assert many(found) == Counter(pii_row(i, t) for i, t in enumerate(texts))


def test_op9_score_decides_on_cued_numbers(spark):
    """Cue-led digit groups of 12 to 22 digits are found, also where a card
    check fails on them; numbers without a cue or behind a decoy are not."""
    private = {'Tel: ': '0151 2345 6789', 'phone ': '0049 151 2345 6789', 'IBAN: ': 'DE89 3704 0044 0532 0130 00',
               'account ': '1234 5678 9012 3456 7890 12', 'konto: ': '12-34-56-78-90-12-34-56-78-90', 'card ': '1234-5678-9012-3456'}
    other = ['order 1234 5678 9012', 'page 1234 5678 9012 3456', 'x 1234 5678 9012 y', 'ISBN 978-3-16-148410-1',
             'no 4444333322221112', 'nothing 1234567812345678', 'Contact 1111 1111 1111']
    texts = [k + v for k, v in private.items()] + other
    more = spark.createDataFrame([((1 << 40) + i, t) for i, t in enumerate(texts)], 'doc_id long, text string')
    docs = spark.read.parquet('/root/testdata/sf0.01/documents.parquet').select('doc_id', 'text')
    found = pii.personal_data(docs.unionByName(more)).filter(F.col('doc_id') >= 1 << 40).collect()
    got = {texts[r.doc_id - (1 << 40)]: [(s.kind, s.start, s.end) for s in r.spans] for r in found}
    assert got == {k + v: [('other', len(k), len(k + v))] for k, v in private.items()} | {t: [] for t in other}


def test_op9_overlaps(spark):
    """Overlapping and holding spans as every two compared."""
    rng = np.random.default_rng(6)

    def spans(n, kinds):
        a = rng.integers(0, 60, n).tolist()
        return sorted({(str(rng.choice(kinds)), x, x + int(rng.integers(1, 15)), 'm', False) for x in a})

    rows = []
    for i in range(400):
        free = spans(rng.integers(0, 8), ['loose'])
        free = [s for s in free if not any(s != t and s[1] < t[2] and t[1] < s[2] for t in free)]
        failed = {s[1:3]: s for s in spans(rng.integers(0, 8), ['card', 'ip', 'phone'])}
        rows.append((i, free, list(failed.values())))
    span = 'array<struct<kind:string,start:int,end:int,m:string,valid:boolean>>'
    df = spark.createDataFrame(rows, f'id int, free {span}, failed {span}')
    got = df.select('id', pii.marked(F.col('failed'), F.col('free')).alias('met'),
                    pii.outermost(F.col('free'), F.col('failed')).alias('out')).collect()
    for r in got:
        _, free, failed = rows[r.id]
        assert sorted((*x.s, x.met) for x in r.met) == sorted(
            (*s, any(s[1] < t[2] and t[1] < s[2] for t in free)) for s in failed)
        every = [(s, 0) for s in free] + [(s, 1) for s in failed]
        kept = [s for s, late in every if not any(
            t[1] <= s[1] and s[2] <= t[2] and (t[1:3] != s[1:3] or before < late) for t, before in every)]
        assert sorted((x.kind, x.start, x.end, x.m, x.valid) for x in r.out) == sorted(kept)


def test_op9_dense_texts(spark):
    """Tens of thousands of findings and failed checks in one text."""
    n = 20000
    texts = ['ab@cd.org 🙂 ' * n, '1234 5678 9012 3456 x ' * n, 'é +49 151 234 5678 x\n' * n]
    df = spark.createDataFrame(list(enumerate(texts)), 'doc_id long, text string')
    found = {r.doc_id: r for r in pii.found_spans(df).collect()}
    assert [(s.start, s.end) for s in found[0].base] == [(12 * i, 12 * i + 9) for i in range(n)]
    assert found[1].base == [] and len(found[1].cand) == n
    assert [(s.start, s.end) for s in found[2].base] == [(21 * i + 2, 21 * i + 18) for i in range(n)]
    for r in found.values():
        for s in r.cand[::997] + r.cand[-3:]:
            t = texts[r.doc_id]
            assert (s.m, s.left, s.right) == (t[s.start:s.end], t[max(0, s.start - 32):s.start], t[s.end:s.end + 1])


def test_op9_reliabilities():
    """A labeler that agrees with the others is found reliable, a coin is not."""
    rng = np.random.default_rng(2)
    rows = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple(int(x) for x in (np.where(rng.random(5) < [0.95, 0.9, 0.85, 0.8, 0.5], 1, -1) * (1 if y else -1)))
        rows[v] += 1
    _, share, rate = pii.expectation_maximisation([{f'v{i}': x for i, x in enumerate(k)} | {'n': n}
                                                   for k, n in rows.items()])
    assert abs(share - 0.4) < 0.05
    assert rate[0][1][1] > 0.9 and abs(rate[4][1][1] - 0.5) < 0.06


def brute_tree(text):
    """Fingerprint of a text, and the nodes of its tree, built node by node."""
    def node(x):
        return hashlib.blake2b(x, digest_size=16).digest()

    sections, paragraphs = [[]], []
    for line in re.findall(rb'[^\n]*\n|[^\n]+$|\Z', text.encode())[:text.count('\n') + 1]:
        leaves, held = [], []
        for word in re.findall(rb'[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[\x20\x09-\x0d]+', line):
            held.append(word)
            if xxhash.xxh64_intdigest(word) % 8 == 0:
                leaves, held = leaves + [held], []
        leaves = [(node(b''.join(x)), len(x)) for x in (leaves + [held] if held else leaves)]
        paragraphs.append(node(b''.join(x for x, _ in leaves)))
        sections[-1].append((paragraphs[-1], leaves))
        if not line.strip(b' \t\n\v\f\r') or paragraphs[-1][0] % 8 == 0:
            sections.append([])
    sections = [x for x in sections if x]
    nodes = [node(b''.join(x for x, _ in s)) for s in sections]
    shown = ';'.join(','.join('.'.join(f'{x[:4].hex()}{n:x}' for x, n in leaves) for _, leaves in s) for s in sections)
    every = [x for s in sections for _, leaves in s for x in leaves]
    root = node(b''.join(nodes)).hex()
    return f'{root}:{sum(n for _, n in every)}:{shown}', root, [x.hex() for x in nodes], [x.hex() for x in paragraphs], Counter(every)


def brute_likeness(one, two):
    """By the leaves' whole nodes, all at once."""
    if one[1] == two[1]:
        return 1.0
    total = sum(n * k for (_, n), k in (one[4] + two[4]).items())
    return min(2 * sum(n * k for (_, n), k in (one[4] & two[4]).items()), total - 1) / total


def test_op10_merkle(spark, case):
    d, docs = case
    order = sorted(docs, key=lambda r: r[1].encode())
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = queries.op10_merkle(spark, d).collect()
    want = Counter()
    for (doc_id, t, _), (_, nxt, _) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        a, b, c = brute_tree(t), brute_tree(e), brute_tree(nxt)
        want[doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), a[0], b[0], brute_likeness(a, b),
             brute_likeness(a, c)] += 1
    assert many(r[:7] for r in got) == want
    assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) for r in got)
    assert all(r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint) for r in got)


def test_op10_nodes(spark):
    rng = np.random.default_rng(8)
    parts = ['a', 'bb ', 'é', ' ', '\n', '\n\n', '\r\n', '\t', 'word ', 'x y z ', '🙂\n', '\x0b', '\u2028', '\x1c']
    texts = [''.join(rng.choice(parts, rng.integers(0, 60))) for _ in range(500)]
    df = spark.createDataFrame([*enumerate(texts), (500, None)], 'doc_id long, text string')
    got = {r.doc_id: tuple(r[1:]) for r in merkle.merkle_nodes(df).collect()}
    assert got == {i: brute_tree(t)[1:4] for i, t in enumerate([*texts, ''])}
    for t, u in zip(texts, texts[1:]):
        for one, two in ((t, u), (t + u, u + t), (t, t + 'x')):
            assert merkle.likeness(merkle.Tree(one).fingerprint(), merkle.Tree(two).fingerprint()) == brute_likeness(
                brute_tree(one), brute_tree(two))


def test_op10_locates_edits():
    text = '\n'.join(f'paragraph number {i} of this text' for i in range(50))
    other = text.replace('number 17', 'number seventeen')
    a, b = merkle.Tree(text), merkle.Tree(other)
    assert a.edits(b) == [17] and a.root != b.root and 0.9 < merkle.likeness(a.fingerprint(), b.fingerprint()) < 1
    assert merkle.Tree(text).root == a.root and a.edits(merkle.Tree(text)) == []


def test_op10_edit_in_one_paragraph():
    """A word of 200 in a text without line breaks leaves most leaves common."""
    words = [f'w{i * 7919 % 1009}' for i in range(200)]
    a = merkle.Tree(' '.join(words)).fingerprint()
    for at in range(0, 200, 10):
        b = merkle.Tree(' '.join(words[:at] + ['edited'] + words[at + 1:])).fingerprint()
        assert 0.8 < merkle.likeness(a, b) < 1
