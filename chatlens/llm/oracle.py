"""DuckDB SQL of the queries that SQL can express, for the supplied views."""

from __future__ import annotations

FILL_MIDDLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, z - a) AS middle, substring(text, z + 1) AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

#: Levels written out for the lang trees and for the tree above them; a tree
#: that has its root earlier just keeps it.
_LEVELS, _TOP_LEVELS = 10, 4


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field(text)})"


def _climb(prefix: str, base: str, levels: int) -> str:
    """CTEs <prefix>0.. over (tree, i, h): the levels of all trees, and what is
    left at the end."""
    out = [f"{prefix}0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS m FROM {base})"]
    for k in range(1, levels + 1):
        out.append(f"""{prefix}{k} AS (
  SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS m FROM (
    SELECT tree, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
    FROM {prefix}{k - 1} GROUP BY tree, i // 8))""")
    return ',\n'.join(out)


def _steps(prefix: str, base: str, levels: int, tree: str, index: str) -> str:
    """CTEs <base>_<prefix>1..: per row the siblings level by level (`proof`)
    and the node above the claimed leaf (`node`)."""
    out, before = [], base
    for k in range(levels):
        name = f'{base}_{prefix}{k + 1}'
        out.append(f"""{prefix}r{k} AS (
  SELECT tree, i // 8 AS r, any_value(m) AS m, list(h ORDER BY i) AS hs FROM {prefix}{k} GROUP BY tree, i // 8),
{name} AS (
  SELECT b.* EXCLUDE (proof, node, {index}), b.{index} // 8 AS {index},
         CASE WHEN g.m = 1 THEN b.proof ELSE
           b.proof || array_to_string(hs[:b.{index} % 8], '') || array_to_string(hs[b.{index} % 8 + 2:], '') END AS proof,
         CASE WHEN g.m = 1 THEN b.node ELSE
           sha256(array_to_string(hs[:b.{index} % 8], '') || b.node || array_to_string(hs[b.{index} % 8 + 2:], '')) END AS node
  FROM {before} b JOIN {prefix}r{k} g ON g.tree = b.{tree} AND g.r = b.{index} // 8)""")
        before = name
    return ',\n'.join(out)


_UPPER = 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'
# crc32 of a short decimal string, bit by bit: DuckDB has no such function.
_CRC = """
crc AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS v
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"""

MERKLE_MANIFEST = f"""
WITH {_CRC.strip()},
d AS (
  SELECT documents.*, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
         CASE WHEN xor(v, 4294967295) % 3 = 0 THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END AS claimed
  FROM documents LEFT JOIN crc ON documents.doc_id = crc.doc_id),
l AS (
  SELECT doc_id, tree, {_leaf('text')} AS leaf, {_leaf('claimed')} AS node FROM d),
n AS (
  SELECT *, (row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS i FROM l),
base AS (SELECT tree, i, leaf AS h FROM n),
{_climb('lv', 'base', _LEVELS)},
langs AS (
  SELECT tree AS lang_tree, h AS subroot, (row_number() OVER (ORDER BY tree) - 1)::BIGINT AS j FROM lv{_LEVELS}),
tops AS (SELECT '' AS tree, j AS i, subroot AS h FROM langs),
{_climb('tp', 'tops', _TOP_LEVELS)},
w AS (
  SELECT n.doc_id, n.tree, n.leaf, n.node, n.i, langs.subroot, langs.j, '' AS top, '' AS proof
  FROM n JOIN langs ON n.tree = langs.lang_tree),
{_steps('lv', 'w', _LEVELS, 'tree', 'i')},
{_steps('tp', f'w_lv{_LEVELS}', _TOP_LEVELS, 'top', 'j')}
SELECT doc_id, leaf, subroot, tp{_TOP_LEVELS}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = tp{_TOP_LEVELS}.h AS verified
FROM w_lv{_LEVELS}_tp{_TOP_LEVELS}, tp{_TOP_LEVELS}
"""

# Equal sets are one node; of two nodes the common shingles are counted.
JACCARD_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
         END AS g
  FROM w),
k AS (SELECT doc_id, r, g, len(g)::BIGINT AS n, dense_rank() OVER (ORDER BY g) AS id FROM s),
d AS (SELECT id, any_value(g) AS g, any_value(n) AS n, min(doc_id) AS least FROM k WHERE n > 0 GROUP BY id),
t AS (SELECT id, n, unnest(g) AS x FROM d),
l AS (
  SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT id AS u, id AS v FROM d UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
c AS (SELECT reach.u AS id, min(d.least) AS component_id FROM reach JOIN d ON d.id = reach.v GROUP BY reach.u)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE c.component_id END AS component_id
FROM k LEFT JOIN c ON c.id = k.id
"""

ORACLE_SQL: dict[str, str] = {'op11_fill_middle': FILL_MIDDLE, 'op12_merkle_manifest': MERKLE_MANIFEST,
                              'op13_jaccard_join': JACCARD_JOIN}
