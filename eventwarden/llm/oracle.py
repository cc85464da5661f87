"""The same queries in SQL for a second engine, where SQL can express the whole result."""

from __future__ import annotations

# words, then every window of an item's length that occurs in an item, then the positions it covers
CONTAMINATION = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS size FROM item WHERE len(w) > 0),
item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
doc_window AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, d.size FROM doc_window d JOIN item_window USING (size, t)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, i + k AS place FROM (SELECT DISTINCT doc_id, i, size, unnest(range(size)) AS k FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


# each turn's formatted length: marks by role, one escape per control string or backslash in the text (and in an own role)
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|\\')) AS body,
         length(role) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|\\')) AS named FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE named + 21 END) AS BIGINT)
         AS formatted_chars
FROM sized GROUP BY conv_id
"""

# word shingles, pairs that share one, and the components of the links by repeated smallest neighbour
JACCARD = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b USING (s)
           WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least_id, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size z USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) r
USING (doc_id)
"""


# CRC-32 over the hex digits of each distinct feature, bucket totals, gains, mean gains and the seeded draw
RESAMPLING = r"""
WITH raw AS (
  SELECT 0 AS wanted, doc_id, row_number() OVER () AS row_id, text FROM documents
  UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
worded AS (
  SELECT wanted, doc_id, row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
feature AS (
  SELECT wanted, row_id, unnest(w) AS f FROM worded
  UNION ALL SELECT wanted, row_id, w[i] || ' ' || w[i + 1]
  FROM (SELECT wanted, row_id, w, unnest(range(1, len(w))) AS i FROM worded)),
step AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
bucketed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)),
                  lambda k: CAST('0x' || substr(hex(encode(f)), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM feature), step),
held AS (
  SELECT bucket, count(*) FILTER (wanted = 0) AS s, count(*) FILTER (wanted = 1) AS t
  FROM feature JOIN bucketed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
                                      / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS g FROM held),
weighed AS (
  SELECT row_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS total
  FROM feature JOIN bucketed USING (f) JOIN gain USING (bucket) WHERE wanted = 0 GROUP BY row_id),
scored AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n, 0) AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM worded LEFT JOIN weighed USING (row_id) WHERE wanted = 0),
drawn AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, n_features, weight) AS r,
         25 * count(*) OVER (PARTITION BY fit) // 100 AS k FROM drawn)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN fit AND r <= k THEN r END AS rank FROM ranked
"""

# every kept term for every group and language, its share in each, and both rankings
DIVERGENCE = r"""
WITH doc AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
term AS (SELECT lang, source, row_id, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS held FROM term GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(held) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
counted AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS held FROM term JOIN kept USING (lang, term) GROUP BY ALL),
whole AS (SELECT lang, source, CAST(sum(held) AS HUGEINT) AS n FROM counted GROUP BY ALL),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.held, 0) AS held,
         1 + 1000000000 * (coalesce(c.held, 0) + 1) // (coalesce(o.n, 0) + s.v) AS p,
         1 + 1000000000 * (k.held + 1) // (s.n + s.v) AS lang_p
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang)
  LEFT JOIN whole o ON o.lang = g.lang AND o.source = g.source
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share a JOIN share b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
told AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p FROM share WHERE held > 0 AND p > lang_p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": JACCARD, "op6_chat_prefix_tree": CHAT, "op10_decontamination": CONTAMINATION,
            "op11_importance_resampling": RESAMPLING, "op13_source_divergence": DIVERGENCE}
