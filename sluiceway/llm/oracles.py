"""DuckDB SQL for the queries that SQL can express; written from their definitions, not from their methods."""

from __future__ import annotations

from sluiceway.llm.decontaminate import IN_WINDOW, LEAST_MATCHED, LEAST_WORDS, MASKS, SHARE, WINDOW
from sluiceway.llm.quality import STOP_WORDS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (n + m - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON a = doc_id
"""

_ITEMS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
_SEEDS = " UNION ALL ".join(
    f"SELECT id, pos, {k} AS mask, array_to_string([{', '.join(f'ws[pos + {1 + o}]' for o in mask)}], ' ') AS seed "
    f"FROM (SELECT id, ws, unnest(range(0, len(ws) - {max(mask)})) AS pos FROM {{0}})"
    for k, mask in enumerate(MASKS)
)

OP7 = f"""
WITH d AS (SELECT doc_id AS id, {_ITEMS} AS ws FROM documents),
items AS (SELECT item_id AS id, {_ITEMS} AS ws FROM benchmark),
b AS (SELECT * FROM items WHERE len(ws) >= {LEAST_WORDS}),
brief AS (SELECT * FROM items WHERE len(ws) BETWEEN 1 AND {LEAST_WORDS - 1}),
ds AS ({_SEEDS.format("d")}),
bs AS ({_SEEDS.format("b")}),
p AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
f AS (SELECT p.doc_id, p.item_id, len(b.ws) AS n,
    list_transform(range(1, len(b.ws) + 1), lambda i: CASE WHEN i + shift >= 1 AND b.ws[i] = d.ws[i + shift] THEN 1 ELSE 0 END) AS same
  FROM p JOIN d ON d.id = p.doc_id JOIN b ON b.id = p.item_id),
j AS (SELECT doc_id, item_id, n, list_sum(same) AS matched,
    list_max(list_transform(range(1, greatest(n - {WINDOW} + 1, 1) + 1), lambda i: list_sum(same[i:i + {WINDOW - 1}]))) AS best FROM f),
h AS (SELECT doc_id, item_id, max(matched) / CAST(max(n) AS DOUBLE) AS share FROM j WHERE matched >= greatest({SHARE} * n, {LEAST_MATCHED}) OR best >= {IN_WINDOW} GROUP BY ALL
  UNION ALL SELECT d.id, brief.id, 1.0 FROM d JOIN brief ON contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(brief.ws, ' ') || ' ')),
g AS (SELECT doc_id, count(*) AS n_items, max(share) AS overlap, array_to_string(list(item_id ORDER BY item_id), ',') AS item_ids FROM h GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, n_items IS NULL AS kept, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(overlap, 0.0) AS overlap, coalesce(item_ids, '') AS item_ids
FROM documents LEFT JOIN g USING (doc_id)
"""

_STOPS = "|".join(STOP_WORDS)

OP8 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
x AS (SELECT doc_id, pos, ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3] AS x FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS pos FROM w)),
y AS (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, x) AS n FROM x) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM y GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda v: regexp_matches(v, '^(?i:{_STOPS})(?:[.,;:!?]|$)'))) AS stops
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_symbols / CAST(n_words AS DOUBLE) <= 0.1
    AND n_dup_lines / CAST(n_lines AS DOUBLE) <= 0.4 AND word_chars / CAST(n_words AS DOUBLE) BETWEEN 2.5 AND 12
    AND stops / CAST(n_words AS DOUBLE) >= 0.01 AS kept
FROM m
"""

ORACLES = {"op6_near_dedup": OP6, "op7_decontamination": OP7, "op8_quality": OP8}
