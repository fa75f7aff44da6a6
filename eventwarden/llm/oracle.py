"""DuckDB SQL for the dealt operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN NULL
    ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ranked AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
  FROM cut LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""

ORACLES["op5_warc"] = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS print FROM pages
), marked AS (
  SELECT *, max(page_id) OVER (PARTITION BY print) AS first, (unhex(print)::BIT)::VARCHAR AS bits FROM rows
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
      + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
      + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1) for i in range(32)], '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM marked
"""

#: Runs of letters and digits; every character beyond ASCII counts as a letter.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES["op4_benchmark_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS t(i)),
sizes AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item_shingles
"""

ORACLES["op13_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents
), masks AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask FROM docs
), said AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
  FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask
), letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, bit, coalesce((SELECT sum(x.bit) FROM letters x
    WHERE strpos(filter_order, x.c) < step), 0) AS before
  FROM orders, range(1, 6) AS r(step), letters WHERE c = substr(filter_order, step, 1)
)
SELECT part, filter_order, CAST(step AS INT) AS step,
  coalesce(CAST(sum(n) FILTER (mask & (before + bit)::INT = 0) AS BIGINT), 0) AS kept,
  coalesce(CAST(sum(n) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS BIGINT), 0) AS removed,
  coalesce(CAST(sum(n) FILTER (mask & bit <> 0 AND mask & before::INT <> 0) AS BIGINT), 0) AS redundant,
  coalesce(CAST(sum(n) FILTER (mask = bit) AS BIGINT), 0) AS unique_fails,
  coalesce(CAST(sum(good) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS BIGINT), 0) AS good_lost,
  coalesce(CAST(sum(toxic) FILTER (mask & bit <> 0 AND mask & before::INT = 0) AS BIGINT), 0) AS toxic_lost,
  coalesce(CAST(sum(n * (120 // nullif(bit_count(mask), 0))) FILTER (mask & bit <> 0) AS BIGINT), 0) AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""

#: A mark inside a text, and how many signs the marks around a turn have.
_MARK = r"([<]\\*)(s>|/s>|<SYS>>|</SYS>>)|([\[]\\*)(INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])"

ORACLES["op12_chat_formatting"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '{_MARK}'))
    + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
      ELSE 22 + length(role) + len(regexp_extract_all(role, '{_MARK}')) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: Components: every node takes the smallest id among itself and its neighbours until none changes.
_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(node, low) USING KEY (node) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT w.node, min(o.low) AS low FROM recurring.walk w JOIN both_ways ON both_ways.a = w.node
    JOIN recurring.walk o ON o.node = both_ways.b GROUP BY w.node, w.low HAVING min(o.low) < w.low
)"""

ORACLES["op8_minhash_near_dedup"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= 85 * (p.n + q.n - same)
), nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept
FROM documents JOIN walk ON node = doc_id LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op10_embedding_near_dedup"] = rf"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), nodes AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS}, counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN walk ON node = vec_id LEFT JOIN counts ON a = vec_id
"""
