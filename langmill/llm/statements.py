"""DuckDB SQL that queries of this package are checked against."""

#: Every level of every tree as rows; paths are followed node by node.
MERKLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, lang, n_chars, text,
    -- CRC-32, bit by bit: only its last bit is asked for
    (xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295), 4294967295)) % 2 = 0 AS broken
  FROM documents
), texts AS (
  SELECT *, CASE WHEN broken THEN replace(text, chr(10), '') ELSE text END AS later FROM fields
), hashed AS (
  SELECT doc_id, source,
    sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
      || coalesce(strlen(later) || ':' || later, '-')) AS later
  FROM texts
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS row_no
  FROM hashed
), nodes(g, level, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY g, level, pos // 3, n
), sub AS (
  SELECT g, level AS height, h FROM nodes WHERE n = 1
), tops(level, pos, n, h) AS (
  SELECT 0, g, (SELECT count(*) FROM sub), h FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n
), every AS (
  SELECT g, level, pos, n, h, g AS at FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.g, s.height + t.level, t.pos, t.n, t.h, NULL FROM sub s, tops t WHERE t.n > 1
), flanks AS (
  SELECT a.g, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.g = b.g AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY ALL
), walk(row_no, g, level, height, pos, folded, proof) AS (
  SELECT row_no, l.g, 0, s.height, CASE WHEN s.height = 0 THEN l.g ELSE pos END, later, '' FROM leaves l JOIN sub s ON s.g = l.g
  UNION ALL
  SELECT w.row_no, w.g, w.level + 1, w.height, CASE WHEN w.level + 1 = w.height THEN w.g ELSE w.pos // 3 END,
    sha256(f.l || w.folded || f.r), w.proof || f.l || f.r
  FROM walk w JOIN flanks f ON f.g = w.g AND f.level = w.level AND f.pos = w.pos
), ends AS (
  SELECT row_no, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM walk GROUP BY row_no
)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = t.h AS verified
FROM leaves l JOIN ends e ON e.row_no = l.row_no JOIN sub s ON s.g = l.g JOIN tops t ON t.n = 1
"""
