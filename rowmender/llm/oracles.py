"""The SQL of those queries of this package that SQL can express."""

from __future__ import annotations

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def folded(column: str) -> str:
    """The words of a text in DuckDB: A to Z in lower case, runs of digits, letters and all beyond ASCII."""
    return rf"regexp_extract_all(translate(coalesce({column}, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


LEAKS = f"""
WITH item AS (SELECT item_id, {folded('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS win FROM (
    SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {folded('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM win),
place AS (
  SELECT doc_id, i, size, list_slice(w, i + 1, i + size) AS win FROM (
    SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM place JOIN win USING (win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def crc32(column: str) -> str:
    """CRC-32 of the bytes of a text in DuckDB, by the table that the reflected polynomial gives."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    entries = f"CAST([{', '.join(map(str, table))}] AS BIGINT[])"
    numbers = f"list_transform(range(0, octet_length(encode({column}))), lambda i: CAST(('0x' || substr(hex(encode({column})), 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce({numbers}, lambda c, b: xor(c >> 8, {entries}[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295)"


IMPORTANCE = f"""
WITH text AS (
  SELECT TRUE AS ours, doc_id, {folded('text')} AS w FROM documents
  UNION ALL SELECT FALSE, NULL, {folded('text')} FROM benchmark),
feature AS (
  SELECT ours, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM text),
numbered AS (SELECT f, {crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature)),
counted AS (SELECT doc_id, ours, bucket, count(*) AS n FROM feature JOIN numbered USING (f) GROUP BY ALL),
total AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (ours), 0) AS s, coalesce(sum(n) FILTER (NOT ours), 0) AS t
  FROM (SELECT unnest(range(0, 10000)) AS bucket) b LEFT JOIN counted USING (bucket) GROUP BY 1),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g
  FROM total),
weighed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN gain USING (bucket) WHERE ours GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('7:' || doc_id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM text LEFT JOIN weighed USING (doc_id) WHERE ours),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


TRIE = rf"""
WITH turn_row AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS turns FROM turn_row GROUP BY conv_id),
head AS (SELECT conv_id, turns, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(a.turns, h + 1, len(a.turns))) AS turns
  FROM head a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
member AS (
  SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS path, len(turns) = d AS stops
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256
  FROM member GROUP BY depth, path),
sized AS (
  SELECT n.depth, n.path, n.conv_id, n.n_convs, n.ends_sha256, p.conv_id AS parent_conv_id,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saves
  FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)),
counted AS (SELECT *, (SELECT count(*) FROM node c WHERE c.depth = s.depth + 1 AND list_slice(c.path, 1, s.depth) = s.path) AS n_children FROM sized s)
SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
  count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saves) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM counted a JOIN counted b ON b.depth >= a.depth AND list_slice(b.path, 1, a.depth) = a.path
GROUP BY a.conv_id, a.depth
"""
