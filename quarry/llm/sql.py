"""DuckDB SQL that is put together from repeated steps."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, a bit at a time."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda a, e: xor(xor(a, e) >> 1, CASE WHEN xor(a, e) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


def _tree(name: str, nodes: str, found: str, levels: int) -> str:
    """CTEs of the trees over nodes (g, i, d) with arity 3, and of what the rows of ``found`` (g, i, f) fold to.

    ``name``_top has g and d, ``name``_end the columns of found with f and proof.
    """
    out = [f"{name}0 AS MATERIALIZED ({nodes})", f"{name}_t0 AS MATERIALIZED ({found})"]
    for k in range(levels):
        others = "row_number() OVER w AS r, count(*) OVER (PARTITION BY g) AS n, coalesce(CASE i % 3 WHEN 1 THEN lag(d) OVER w WHEN 2 THEN lag(d, 2) OVER w || lag(d) OVER w END, '') AS a, CASE WHEN i % 3 < 2 THEN coalesce(lead(d) OVER w, '') ELSE '' END || CASE WHEN i % 3 = 0 THEN coalesce(lead(d, 2) OVER w, '') ELSE '' END AS b"
        out.append(f"{name}_w{k} AS MATERIALIZED (SELECT g, i, d, {others} FROM {name}{k} WINDOW w AS (PARTITION BY g ORDER BY i))")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}_w{k} GROUP BY g, i // 3)")
        out.append(f"{name}_t{k + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (i, f, proof), t.i // 3 AS i, CASE WHEN w.n = 1 THEN t.f ELSE sha256(w.a || t.f || w.b) END AS f, t.proof || w.a || w.b AS proof FROM {name}_t{k} t JOIN {name}_w{k} w ON t.g = w.g AND t.i = w.i)")
    out += [f"{name}_top AS (SELECT g, d FROM {name}{levels})", f"{name}_end AS (SELECT * EXCLUDE (i) FROM {name}_t{levels})"]
    return ",\n".join(out)


def manifest(levels: int = 14) -> str:
    """The Merkle manifest of documents, for groups of at most 3 ** levels."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
WITH hashed AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS f FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
{_tree('l', 'SELECT g, i, leaf AS d FROM leaves', "SELECT doc_id, g, leaf, i, f, '' AS proof FROM leaves", levels)},
subs AS MATERIALIZED (SELECT g AS own, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d FROM l_top),
{_tree('u', 'SELECT g, i, d FROM subs', "SELECT e.doc_id, e.leaf, s.d AS subroot, s.g, s.i, e.f, e.proof FROM l_end e JOIN subs s ON e.g = s.own", levels)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM u_end CROSS JOIN u_top"""


def prefix_trie() -> str:
    """The prefix trie of rebuilt conversations."""
    return f"""
WITH turns AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT c, {crc32('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
built AS (SELECT k.c, t.p AS p, t.role, t.text FROM convs k JOIN turns t ON t.c = k.c - k.c % 100 AND t.p <= k.h
  UNION ALL SELECT k.c, t.p + 6 AS p, t.role, t.text FROM convs k JOIN turns t ON t.c = k.c AND t.p > k.h),
paths AS MATERIALIZED (SELECT c, text, row_number() OVER w AS depth, list(struct_pack(role := role, text := text)) OVER w AS path FROM built WINDOW w AS (PARTITION BY c ORDER BY p)),
lengths AS MATERIALIZED (SELECT k.c, coalesce(max(depth), 0) AS len FROM convs k LEFT JOIN paths USING (c) GROUP BY 1),
members AS MATERIALIZED (SELECT c, depth, sha256(CAST(path AS VARCHAR)) AS node, CASE WHEN depth = 1 THEN 'root' ELSE sha256(CAST(path[:-2] AS VARCHAR)) END AS parent, length(text) AS tokens FROM paths
  UNION ALL SELECT c, 0, 'root', NULL, 0 FROM convs),
nodes AS MATERIALIZED (SELECT m.node, m.depth, m.parent, min(m.c) AS conv_id, count(*) AS n_convs, max(m.tokens) AS tokens, coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE l.len = m.depth), '') AS ends FROM members m JOIN lengths l USING (c) GROUP BY 1, 2, 3),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY 1),
marked AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node)),
below AS (SELECT a.node, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.tokens) AS saved_tokens
  FROM marked d JOIN members o ON o.c = d.conv_id AND o.depth <= d.depth JOIN marked a ON a.node = o.node GROUP BY 1)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN below b USING (node) LEFT JOIN marked p ON p.node = m.parent"""
