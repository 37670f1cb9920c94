"""SQL (DuckDB) for the corpus queries that SQL can express in reasonable time.

Each statement follows the contract by definition: windows as joined words or hexadecimal bytes, the first
occurrence of each as a minimum, cover as distinct positions. Rows are numbered, so repeated rows stay apart.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), places AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM wins))
), found AS (
  SELECT p.rid, p.s, p.n, wins.item_id FROM places p JOIN wins ON p.n = wins.n AND p.k = wins.k
), hit AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS pos FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

SUBSTRING_DEDUP = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT rid, doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)
), later AS (
  SELECT rid, s FROM (SELECT rid, doc_id, s, min(struct_pack(d := doc_id, s := s)) OVER (PARTITION BY k) AS f FROM wins)
  WHERE struct_pack(d := doc_id, s := s) > f
), gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 20)) AS pos FROM later
), word AS (
  SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM docs
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY pos) AS joined FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid
), cut AS (
  SELECT rid, count(*) AS n FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid) LEFT JOIN cut USING (rid)
"""

SUFFIX_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (  -- 1000 starts each, with the bytes that their windows reach
  SELECT rid, doc_id, o, substr(h, 2 * o + 1, 2198) AS h FROM (SELECT rid, doc_id, h, unnest(range(0, length(h) // 2 - 99, 1000)) AS o FROM docs)
), wins AS (
  SELECT rid, doc_id, o + s AS s, md5(substr(h, 2 * s + 1, 200)) AS k
  FROM (SELECT rid, doc_id, o, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM blocks)
), firsts AS (
  SELECT k, min(struct_pack(d := doc_id, s := s)) AS f FROM wins GROUP BY k HAVING count(*) > 1
), later AS (
  SELECT rid, s FROM wins JOIN firsts USING (k) WHERE struct_pack(d := doc_id, s := s) > f
), runs AS (  -- windows less than 101 bytes apart run together
  SELECT rid, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS run
        FROM (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY rid, run
), edges AS (
  SELECT rid, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS m FROM runs GROUP BY rid
), parts AS (  -- what lies between the runs
  SELECT rid, doc_id, h, coalesce(n, 0) AS n, coalesce(m, 0) AS m,
         list_prepend(0, coalesce(b, [])) AS lo, list_append(coalesce(a, []), length(h) // 2) AS hi
  FROM docs LEFT JOIN edges USING (rid)
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, CAST(m AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(lo) + 1), lambda i: substr(h, 2 * lo[i] + 1, 2 * (hi[i] - lo[i]))), ''))) AS kept_sha256
FROM parts
"""
