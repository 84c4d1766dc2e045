"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

# Common tables, in dependency order. Each query gets the ones up to the last it names.
_TABLES = {
    "req": """
  WITH e AS (
    SELECT event_id, user_id, event_type, props, epoch_us(ts)//1000 AS ms,
           md5(CAST(event_id % 2500 AS STRING)) AS h0,
           md5(CAST((event_id + 1) % 2500 AS STRING)) AS h1,
           md5(CAST((event_id + 2) % 2500 AS STRING)) AS h2
    FROM events),
  u AS (
    SELECT *,
      substr(h0,1,8)||'-'||substr(h0,9,4)||'-'||substr(h0,13,4)||'-'||substr(h0,17,4)||'-'||substr(h0,21,12) AS id0,
      substr(h1,1,8)||'-'||substr(h1,9,4)||'-'||substr(h1,13,4)||'-'||substr(h1,17,4)||'-'||substr(h1,21,12) AS id1,
      substr(h2,1,8)||'-'||substr(h2,9,4)||'-'||substr(h2,13,4)||'-'||substr(h2,17,4)||'-'||substr(h2,21,12) AS id2,
      CASE event_type WHEN 'click' THEN 'telemetry'
        WHEN 'view' THEN 'testpilot_'||CAST(event_id % 3 AS STRING)
        WHEN 'purchase' THEN 'marketplace_apps' WHEN 'signup' THEN 'metrics' ELSE 'bogus' END AS ns
    FROM e)
  SELECT event_id // 8 AS seq, event_id % 8 AS shard, ms AS recv_ms,
    CASE WHEN event_id % 11 = 0 THEN 'DELETE' WHEN event_id % 29 = 0 THEN 'GET'
         WHEN event_id % 43 = 0 THEN 'OPTIONS' WHEN event_id % 31 = 0 THEN 'PUT' ELSE 'POST' END AS method,
    CASE WHEN event_id % 101 = 0 THEN '/' ELSE
      CASE WHEN event_id % 3 = 0 THEN '/1.0' ELSE '' END
      || CASE WHEN event_id % 37 = 0 THEN '/fetch/' ELSE '/submit/' END || ns
      || CASE WHEN event_id % 23 = 0 THEN ''
              WHEN event_id % 17 = 0 THEN '/fakeid'
              ELSE '/'||id0 || CASE WHEN event_id % 5 = 0 THEN '/p1/p2' ELSE '' END END
    END AS uri,
    '172.16.0.'||CAST(user_id % 250 AS STRING) AS remote_addr,
    CASE WHEN event_id % 4 = 0 THEN '10.0.'||CAST(event_id % 256 AS STRING)||'.7, 10.9.9.9'
         WHEN event_id % 4 = 1 THEN '192.168.1.'||CAST(event_id % 256 AS STRING) END AS x_forwarded_for,
    CASE WHEN event_id % 7 = 0 THEN id1||', '||id2||',,'
         WHEN event_id % 49 = 1 THEN ',' WHEN event_id % 49 = 2 THEN '' END AS x_obsolete_document,
    CASE WHEN event_id % 6 = 0 THEN 'application/json+zlib; v=1' ELSE 'application/json' END AS content_type,
    CASE WHEN event_id % 12 = 0 THEN 'gzip' END AS content_encoding,
    CASE WHEN event_id % 19 = 0 THEN '' WHEN event_id % 13 = 0 THEN '{ "k : 7 }'
         WHEN event_id % 13 = 1 THEN props||' x'
         WHEN event_id % 53 = 0 THEN '{"pad":"'||repeat('x',100)||'"}' ELSE props END AS body
  FROM u""",
    "addressed": """
  SELECT *, coalesce(CASE WHEN instr(x_forwarded_for, ',') > 1 THEN split_part(x_forwarded_for, ',', 1)
                          ELSE x_forwarded_for END, remote_addr) AS addr
  FROM req""",
    "split": """
  SELECT *, regexp_extract_all(uri, '/([^/]+)', 1) AS path FROM addressed""",
    "shifted": """
  SELECT *, CASE WHEN regexp_full_match(coalesce(path[1], ''), '[0-9]+([.][0-9]+)?') THEN 1 ELSE 0 END AS off
  FROM split""",
    "parsed": """
  SELECT *, CASE WHEN off = 1 THEN path[1] END AS api_version, path[1 + off] AS endpoint,
         path[2 + off] AS namespace, path[3 + off] AS id, path[4 + off:] AS partition
  FROM shifted""",
    "classified": """
  SELECT *,
    CASE why WHEN 'body_too_large' THEN 413 WHEN 'namespace' THEN 404 WHEN 'id' THEN 404 WHEN 'endpoint' THEN 404
      WHEN 'get_denied' THEN 403 WHEN 'delete_denied' THEN 403 WHEN 'method_denied' THEN 403
      WHEN 'empty_body' THEN 400 WHEN 'created' THEN 201 ELSE 200 END AS outcome,
    CASE WHEN why NOT IN ('root', 'created', 'deleted') THEN why END AS reason
  FROM (SELECT *, CASE
      WHEN strlen(body) > 64 THEN 'body_too_large'
      WHEN uri IN ('/', '') THEN 'root'
      WHEN namespace IS NULL OR NOT regexp_matches(namespace, '(telemetry|testpilot_.+|marketplace_.+|metrics)')
        THEN 'namespace'
      WHEN id IS NOT NULL AND NOT starts_with(namespace, 'marketplace_') AND NOT regexp_full_match(id,
        '[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}') THEN 'id'
      WHEN method = 'GET' THEN 'get_denied'
      WHEN method = 'DELETE' AND namespace <> 'metrics' THEN 'delete_denied'
      WHEN method NOT IN ('POST', 'PUT', 'DELETE') THEN 'method_denied'
      WHEN endpoint <> 'submit' THEN 'endpoint'
      WHEN method = 'DELETE' THEN 'deleted'
      WHEN body = '' THEN 'empty_body'
      ELSE 'created' END AS why
    FROM parsed)""",
    "admitted": """
  SELECT seq, shard, recv_ms AS ts_ms, namespace, api_version, partition, method, body, x_obsolete_document AS h,
    printf('%02X%02X%02X%02X', CAST(split_part(addr, '.', 1) AS INT), CAST(split_part(addr, '.', 2) AS INT),
           CAST(split_part(addr, '.', 3) AS INT), CAST(split_part(addr, '.', 4) AS INT)) AS ip_hex,
    coalesce(id, substr(g,1,8)||'-'||substr(g,9,4)||'-'||substr(g,13,4)||'-'||substr(g,17,4)||'-'||substr(g,21,12)) AS id
  FROM (SELECT *, md5('id:'||coalesce(namespace, '')||':'||CAST(shard AS STRING)||':'||CAST(seq AS STRING)) AS g FROM classified)
  WHERE why IN ('created', 'deleted')""",
    "obsolete": """
  SELECT * EXCLUDE (raw), trim(raw) AS doc
  FROM (SELECT seq, shard, unnest(ids) AS raw, CAST(generate_subscripts(ids, 1) AS INT) AS ord
        FROM (SELECT seq, shard, CASE WHEN h <> '' AND rtrim(h, ',') = '' THEN [] ELSE string_split(rtrim(h, ','), ',') END AS ids
              FROM admitted WHERE h IS NOT NULL AND method <> 'DELETE'))""",
    "messages": """
  SELECT seq, shard, 0 AS ord, namespace, id, ip_hex, CASE WHEN method <> 'DELETE' THEN body END AS payload, ts_ms,
         CASE WHEN method = 'DELETE' THEN 'DELETE' ELSE 'CREATE_UPDATE' END AS operation, api_version, partition
  FROM admitted
  UNION ALL
  SELECT seq, shard, ord, namespace, doc, ip_hex, NULL, ts_ms, 'DELETE', api_version, partition
  FROM admitted JOIN obsolete USING (seq, shard)""",
    "gated": """
  SELECT *, CASE WHEN operation = 'DELETE' THEN 'delete' WHEN json_valid(payload) THEN 'store' ELSE 'invalid' END AS action
  FROM messages""",
    "puts": """
  SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS ds,
         row_number() OVER (PARTITION BY namespace, id ORDER BY ts_ms DESC, seq DESC, ord DESC, shard DESC) AS newest
  FROM gated WHERE action = 'store'""",
    "tombs": """
  SELECT namespace, id, max(ts_ms) AS del_ms FROM gated WHERE action = 'delete' GROUP BY ALL""",
    "alive": """
  SELECT namespace, id, ts_ms, seq, payload
  FROM puts LEFT JOIN tombs USING (namespace, id)
  WHERE newest = 1 AND (del_ms IS NULL OR ts_ms > del_ms + 604800000)""",
    "salted": """
  SELECT *, printf('%02X', (CAST('0x'||substr(id, 1, 2) AS INT) + 128) % 256)
         || hex(strftime(make_timestamp(ts_ms * 1000), '%Y%m%d')||id) AS row_key
  FROM puts""",
    "newest_salted": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, row_key ORDER BY ts_ms DESC, seq DESC, ord DESC, shard DESC) AS r
                 FROM salted) WHERE r = 1""",
}


def _sql(upto: str, body: str, more: str = "") -> str:
    parts = []
    for name, select in _TABLES.items():
        parts.append(f"{name} AS ({select})")
        if name == upto:
            break
    if more:
        parts.append(more)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


_MESSAGE = """SELECT seq, ord, namespace, id, ip_hex, payload, ts_ms, operation, api_version,
  array_to_string(partition, '|') AS partition"""
_RULES = """(VALUES ('metrics.allow.delete.access', 'true'), ('marketplace_*.id.validation', 'false'),
  ('testpilot_*.id.validation', 'true'), ('testpilot_1*.id.validation', 'FALSE'), ('*.id.validation', 'no'),
  ('*_apps.id.validation', 'true'), ('tele*.allow.delete.access', 'True')) AS r(rule, value)"""
_TURN = "CAST(conv_id AS STRING)||'-'||CAST(turn AS STRING) AS key"
_HANDLED = "why IN ('created', 'deleted', 'empty_body')"
_NEW_ID = "md5('replay:'||namespace||':'||CAST(shard AS STRING)||':'||CAST(seq AS STRING)||':'||CAST(ord AS STRING))"
_SHARE = "CAST('0x'||substr(md5(id), 1, 8) AS BIGINT) / 4294967296::DOUBLE"
_SALT = "printf('%02{x}', (CAST('0x'||substr(id, 1, 2) AS INT) + 128) % 256)"
_DAY8 = "strftime(make_timestamp(ts_ms * 1000), '%Y%m%d')"
_ID_OK = """(starts_with(namespace, 'marketplace_') OR id IS NULL
  OR regexp_full_match(id, '[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}'))"""
_HAS_SALT = "regexp_matches(id, '^([0-9a-fA-F]{2}|[0-9a-fA-F]$)')"

_ODD = """odd AS (SELECT * REPLACE (CASE WHEN seq % 31 = 0 THEN 'zz'||seq ELSE id END AS id,
  CASE WHEN seq % 7 <> 0 THEN ts_ms END AS ts_ms) FROM gated)"""

ORACLES: dict[str, str] = {
    "source_topic_pattern": _sql("messages", """
SELECT namespace AS topic, count(*) AS n, min(seq) AS min_seq, max(seq) AS max_seq FROM messages
WHERE regexp_full_match(namespace, 'testpilot_.+|marketplace_.+') GROUP BY ALL"""),
    "envelope_decode": _sql("messages", _MESSAGE + ", CAST(NULL AS STRING) AS reason FROM messages"),
    "seqfile_roundtrip": f"""
SELECT {_TURN}, md5(text) AS digest, CAST(strlen(text) AS INT) AS n_bytes FROM conversations""",
    "policy_load": """
WITH rules AS (SELECT CASE event_id % 7 WHEN 2 THEN 'ns'||event_id||'.allow.delete.access'
    WHEN 3 THEN 'grp'||event_id||'_*.id.validation' ELSE 'ns'||event_id||'.id.validation' END AS rule,
  CASE event_id % 7 WHEN 2 THEN 'true' WHEN 3 THEN 'false' ELSE event_type END AS value
  FROM events WHERE event_id % 7 > 1)
SELECT rule, value, CASE WHEN contains(rule, '*') THEN split_part(rule, '*', 1) END AS prefix,
  CASE WHEN contains(rule, '*') THEN split_part(rule, '*', 2) END AS suffix FROM rules""",
    "path_elements": _sql("split", """
SELECT 'request' AS kind, seq AS row_id, array_to_string(path, '|') AS path, CAST(len(path) AS INT) AS depth FROM split
UNION ALL
SELECT 'page', page_id, array_to_string(p, '|'), CAST(len(p) AS INT)
FROM (SELECT page_id, regexp_extract_all(url, '/([^/]+)', 1) AS p FROM pages)"""),
    "path_depth_stats": """
SELECT CAST(len(p) AS INT) AS depth, count(*) AS n, count(p[3]) AS with_third, CAST(max(length(p[2])) AS INT) AS longest_second
FROM (SELECT regexp_extract_all(url, '/([^/]+)', 1) AS p FROM pages) GROUP BY ALL""",
    "api_version_counts": _sql("shifted", """
SELECT path[1] AS first, off = 1 AS is_version, count(*) AS n FROM shifted GROUP BY ALL"""),
    "request_fields": _sql("parsed", """
SELECT seq, api_version, endpoint, namespace, id, array_to_string(partition, '|') AS partition,
  CAST(len(partition) AS INT) AS n_partitions FROM parsed"""),
    "assigned_ids": _sql("parsed", """
SELECT seq, id IS NOT NULL AS given,
  coalesce(id, substr(g,1,8)||'-'||substr(g,9,4)||'-'||substr(g,13,4)||'-'||substr(g,17,4)||'-'||substr(g,21,12)) AS id
FROM (SELECT *, md5('id:'||coalesce(namespace, '')||':'||CAST(shard AS STRING)||':'||CAST(seq AS STRING)) AS g FROM parsed)"""),
    "client_addr": _sql("addressed", "SELECT seq, addr FROM addressed"),
    "client_addr_bytes": _sql("addressed", """
SELECT seq, printf('%02X%02X%02X%02X', CAST(split_part(addr, '.', 1) AS INT), CAST(split_part(addr, '.', 2) AS INT),
  CAST(split_part(addr, '.', 3) AS INT), CAST(split_part(addr, '.', 4) AS INT)) AS addr_hex FROM addressed"""),
    "to_messages": _sql("messages", _MESSAGE + " FROM messages"),
    "obsolete_deletes": _sql("messages", "SELECT seq, ord, namespace, id FROM messages WHERE ord > 0"),
    "effective_encoding": _sql("req", """
SELECT content_encoding, content_type, coalesce(content_encoding,
  CASE WHEN starts_with(content_type, 'application/json+zlib') THEN 'deflate' END) AS effective, count(*) AS n
FROM req GROUP BY ALL"""),
    "inflate_payloads": """
SELECT doc_id AS seq, CASE WHEN doc_id % 97 <> 0 OR doc_id % 4 = 3 THEN md5(text) END AS digest,
  doc_id % 97 = 0 AND doc_id % 4 < 3 AS inflate_failed FROM documents""",
    "salted_rowkey": _sql("messages", f"""
SELECT seq, ord, CASE WHEN {_HAS_SALT} THEN {_SALT.format(x='X')} || hex({_DAY8}||id) END AS row_key FROM messages"""),
    "display_rowkey": _sql("messages", f"""
SELECT seq, ord, CASE WHEN {_HAS_SALT} THEN '"\\x' || {_SALT.format(x='x')} || {_DAY8} || id || '"' END AS row_key
FROM messages"""),
    "json_ingest_ts": _sql("messages", """
SELECT seq, CASE WHEN ok THEN CAST(json_extract_string(base, '$.k') AS BIGINT) END AS k,
  CASE WHEN ok THEN ts_ms END AS ingest_ts, CASE WHEN NOT ok THEN 'not_an_object' END AS reason
FROM (SELECT *, json_valid(base) AS ok FROM (SELECT *, regexp_replace(payload, ' x$', '') AS base FROM messages WHERE ord = 0))"""),
    "replay_dest": _sql("messages", """
SELECT seq, ord, 'http://replay.example.org/submit/'||id||'/again' AS url FROM messages"""),
    "record_sizes": f"""
SELECT {_TURN}, CAST(length({_TURN.removesuffix(' AS key')}) AS INT) AS key_len, CAST(strlen(text) AS INT) AS value_len,
  text AS value FROM conversations""",
    "replay_rekey": _sql("gated", f"""
SELECT seq, ord, action, id, CASE WHEN action = 'delete' THEN id ELSE
  substr(g,1,8)||'-'||substr(g,9,4)||'-'||substr(g,13,4)||'-'||substr(g,17,4)||'-'||substr(g,21,12) END AS new_id
FROM (SELECT *, {_NEW_ID} AS g FROM gated) WHERE action <> 'invalid'"""),
    "body_limit": _sql("req", "SELECT seq, CAST(strlen(body) AS INT) AS n_bytes FROM req WHERE strlen(body) <= 64"),
    "namespace_whitelist": _sql("parsed", """
SELECT namespace, count(*) AS n,
  coalesce(regexp_matches(namespace, '(telemetry|testpilot_.+|marketplace_.+|metrics)'), false) AS valid,
  coalesce(regexp_full_match(namespace, '(telemetry|testpilot_.+|marketplace_.+|metrics)'), false) AS valid_anchored
FROM (SELECT CASE seq % 5 WHEN 0 THEN 'x'||namespace||'x' WHEN 1 THEN split_part(namespace, '_', 1) ELSE namespace END AS namespace
      FROM parsed) GROUP BY ALL"""),
    "uuid_validation": _sql("parsed", """
SELECT seq, id, regexp_full_match(id, '[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}') AS lenient,
  regexp_full_match(id, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') AS strict
FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN upper(id) WHEN 1 THEN id||'0' WHEN 2 THEN seq||'-2-3-4-5'
        WHEN 3 THEN replace(id, '-', '') ELSE id END AS id FROM parsed) WHERE id IS NOT NULL"""),
    "id_policy": _sql("parsed", f"""
SELECT namespace, {_ID_OK} AS id_ok, count(*) AS n FROM parsed WHERE namespace IS NOT NULL GROUP BY ALL"""),
    "method_acl": _sql("parsed", f"""
SELECT namespace, method, method IN ('POST', 'PUT') OR (method = 'DELETE' AND namespace = 'metrics') AS allowed, count(*) AS n
FROM parsed WHERE namespace IS NOT NULL AND {_ID_OK} GROUP BY ALL"""),
    "user_agents": _sql("req", """
SELECT CASE WHEN seq % 5 <> 0 THEN 'client/'||(seq % 7) END AS user_agent, count(*) AS n FROM req GROUP BY ALL"""),
    "request_outcomes": _sql("classified", """
SELECT namespace, outcome, reason, count(*) AS n FROM classified GROUP BY ALL"""),
    "json_validation": _sql("req", """
SELECT seq, json_valid(CASE seq % 6 WHEN 0 THEN '['||body||']' WHEN 1 THEN body||','||body WHEN 2 THEN body||' '||seq
  WHEN 3 THEN CAST(seq AS STRING) WHEN 4 THEN body||',0] "x"' ELSE body END) AS valid FROM req"""),
    "validation_chain": _sql("messages", """
SELECT namespace, failed IS NULL AS valid, failed AS first_failed, count(*) AS n
FROM (SELECT *, CASE WHEN NOT json_valid(payload) THEN 'json' WHEN strlen(payload) > 9 THEN 'small'
        WHEN NOT contains(payload, '"k"') THEN 'has_k' END AS failed FROM messages WHERE payload IS NOT NULL) GROUP BY ALL"""),
    "operation_gate": _sql("messages", """
SELECT operation, action, CASE WHEN action = 'invalid' THEN 'json' END AS reason, count(*) AS n
FROM (SELECT operation, CASE WHEN operation = 'DELETE' THEN CASE WHEN id IS NULL THEN 'ignored' ELSE 'delete' END
        WHEN id IS NULL OR payload IS NULL THEN 'ignored' WHEN json_valid(payload) THEN 'store' ELSE 'invalid' END AS action
  FROM (SELECT CASE WHEN seq % 41 <> 0 THEN id END AS id, CASE WHEN seq % 47 <> 0 THEN payload END AS payload,
          CASE WHEN operation = 'DELETE' OR seq % 3 = 0 THEN operation END AS operation FROM messages)) GROUP BY ALL"""),
    "oversized_values": """
SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes FROM documents WHERE strlen(text) <= 8192""",
    "replay_sample": _sql("gated", f"""
SELECT seq, ord, action, id FROM gated WHERE action = 'delete' OR (action = 'store' AND {_SHARE} < 0.3)"""),
    "replay_plan": _sql("gated", f"""
SELECT seq, ord, CASE action WHEN 'store' THEN 'POST' ELSE 'DELETE' END AS method,
  'http://replay.example.org/submit/'||id AS url, payload AS body
FROM gated WHERE action = 'delete' OR (action = 'store' AND {_SHARE} < 0.5)"""),
    "policy_resolution": _sql("parsed", """
SELECT namespace, setting, coalesce(value, default_value) AS value, rule,
  lower(coalesce(value, default_value)) = 'true' AS flag FROM ranked WHERE r = 1""", f"""
names AS (SELECT DISTINCT namespace, setting, default_value, namespace||setting AS name FROM parsed,
    (VALUES ('.id.validation', 'true'), ('.allow.delete.access', 'false')) AS s(setting, default_value)
    WHERE namespace IS NOT NULL),
ranked AS (SELECT n.*, rule, value, row_number() OVER (PARTITION BY namespace, setting ORDER BY
    rule = name DESC NULLS LAST, length(split_part(rule, '*', 1)) DESC, length(split_part(rule, '*', 2)) DESC, rule) AS r
  FROM names n LEFT JOIN {_RULES} ON rule = name OR (contains(rule, '*') AND starts_with(name, split_part(rule, '*', 1))
    AND ends_with(name, split_part(rule, '*', 2)) AND length(name) >= length(rule) - 1))"""),
    "tombstone_antijoin": _sql("gated", """
SELECT seq, ord, namespace, id, ts_ms FROM gated p WHERE action = 'store' AND NOT EXISTS (SELECT 1 FROM gated d
  WHERE d.action = 'delete' AND d.namespace = p.namespace AND d.id = p.id AND p.ts_ms <= d.ts_ms + 604800000)"""),
    "request_metrics": _sql("classified", f"""
SELECT namespace, method, CAST(grouping(namespace, method) AS INT) AS level, count(*) AS n,
  CAST(sum(CASE WHEN method = 'DELETE' THEN 0 ELSE strlen(body) END) AS BIGINT) AS n_bytes
FROM classified WHERE {_HANDLED} GROUP BY GROUPING SETS ((namespace, method), (namespace), (method), ())"""),
    "response_counts": _sql("classified", f"""
SELECT namespace, outcome, false AS is_total, count(*) AS n FROM classified WHERE {_HANDLED} GROUP BY ALL
UNION ALL SELECT NULL, outcome, true, count(*) FROM classified WHERE why <> 'root' GROUP BY ALL"""),
    "consumer_metrics": _sql("gated", """
SELECT namespace AS topic, count(*) AS consumed, count(*) FILTER (WHERE action = 'invalid') AS invalid FROM gated GROUP BY ALL"""),
    "sink_metrics": _sql("gated", """
SELECT namespace, count(*) FILTER (WHERE action = 'store' AND strlen(payload) <= 8) AS stored,
  count(*) FILTER (WHERE action = 'delete') AS deleted,
  count(*) FILTER (WHERE action = 'store' AND strlen(payload) > 8) AS oversized,
  count(*) FILTER (WHERE action = 'invalid') AS failed FROM gated GROUP BY ALL"""),
    "rate_series": _sql("messages", """
SELECT namespace, bucket_ms, n, n_bytes, n / 60::DOUBLE AS n_per_sec, n_bytes / 60::DOUBLE AS bytes_per_sec
FROM (SELECT namespace, ts_ms - ts_ms % 60000 AS bucket_ms, count(*) AS n, CAST(coalesce(sum(strlen(payload)), 0) AS BIGINT) AS n_bytes
      FROM messages GROUP BY ALL)"""),
    "latency_report": "SELECT count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, "
    "round(max(value), 6) AS max, round(stddev_pop(value), 6) AS stddev, "
    + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90, 95, 99))
    + " FROM events",
    "code_frequency": "SELECT event_type AS code, count(*) AS n FROM events GROUP BY ALL",
    "flush_batches": _sql("messages", """
SELECT namespace, shard, seq, ord, CAST((row_number() OVER (PARTITION BY namespace, shard ORDER BY seq, ord) - 1) // 10 AS BIGINT) AS batch
FROM messages"""),
    "flush_batches_null_groups": _sql("messages", """
SELECT namespace, shard, seq, ord, "from",
  CAST((row_number() OVER (PARTITION BY namespace, shard ORDER BY seq, "from", ord) - 1) // 10 AS BIGINT) AS batch
FROM (SELECT CASE WHEN seq % 5 <> 0 THEN namespace END AS namespace, CASE WHEN seq % 3 <> 0 THEN shard END AS shard,
        seq, ord, shard AS "from" FROM messages)"""),
    "file_roll_plan": _sql("puts", """
SELECT namespace, ds, shard, file_no, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, min(seq) AS first_seq
FROM placed GROUP BY ALL""", """
lined AS (SELECT namespace, ds, shard, seq, length(id) + strlen(payload) AS n_bytes,
    row_number() OVER (PARTITION BY namespace, ds, shard ORDER BY seq, ord) AS rn FROM puts),
placed AS (
  SELECT namespace, ds, shard, seq, n_bytes, rn, n_bytes AS used, CAST(0 AS BIGINT) AS file_no FROM lined WHERE rn = 1
  UNION ALL
  SELECT l.namespace, l.ds, l.shard, l.seq, l.n_bytes, l.rn,
    CASE WHEN p.used >= 125 THEN l.n_bytes ELSE p.used + l.n_bytes END,
    CASE WHEN p.used >= 125 THEN p.file_no + 1 ELSE p.file_no END
  FROM placed p JOIN lined l ON l.namespace = p.namespace AND l.ds = p.ds AND l.shard = p.shard AND l.rn = p.rn + 1)"""),
    "poison_batches": _sql("req", """
SELECT shard, seq, n_bytes, batch, max(n_bytes) OVER (PARTITION BY shard, batch) > 64 AS lost
FROM (SELECT shard, seq, CAST(strlen(body) AS INT) AS n_bytes,
        CAST((row_number() OVER (PARTITION BY shard ORDER BY seq) - 1) // 10 AS BIGINT) AS batch FROM req)"""),
    "latest_by_key": _sql("messages", """
SELECT namespace, id, ts_ms, seq, ord, shard, operation, payload FROM messages
QUALIFY row_number() OVER (PARTITION BY namespace, id ORDER BY ts_ms DESC, seq DESC, ord DESC, shard DESC) = 1"""),
    "keyed_state": _sql("alive", "SELECT namespace, id, ts_ms, seq, payload FROM alive"),
    "keyed_state_stream": _sql("alive", "SELECT namespace, id, ts_ms, seq, payload FROM alive"),
    "keyed_state_stream_expiring": _sql("alive", "SELECT namespace, id, ts_ms, seq, payload FROM alive"),
    "keyed_state_untimed": _sql("gated", """
SELECT namespace, id, ts_ms, seq, payload FROM oddest LEFT JOIN gone USING (namespace, id)
WHERE deletes IS NULL OR ts_ms > del_ms + 604800000 OR (del_ms IS NULL AND ts_ms IS NOT NULL AND deletes = 0)""", _ODD + """,
oddest AS (SELECT * FROM odd WHERE action = 'store' QUALIFY row_number() OVER (PARTITION BY namespace, id
  ORDER BY ts_ms DESC NULLS LAST, seq DESC, ord DESC, shard DESC) = 1),
gone AS (SELECT namespace, id, max(ts_ms) AS del_ms, count(ts_ms) AS deletes FROM odd WHERE action = 'delete' GROUP BY ALL HAVING count(ts_ms) > 0)"""),
    "salted_refusals": _sql("gated", f"""
SELECT CASE WHEN lost THEN 'invalid' ELSE action END AS action,
  CASE WHEN lost THEN 'unsaltable' WHEN action = 'invalid' THEN 'json' END AS reason, count(*) AS n,
  count(key_size) AS keyed, CAST(sum(key_size) AS BIGINT) AS key_bytes
FROM (SELECT *, action = 'store' AND ts_ms IS NOT NULL AND NOT ({_HAS_SALT}) AS lost,
    CASE WHEN action = 'store' THEN CASE WHEN ts_ms IS NULL THEN strlen(id) WHEN {_HAS_SALT} THEN 9 + strlen(id) END END AS key_size FROM odd)
GROUP BY ALL""", _ODD),
    "keyed_state_salted": _sql("newest_salted", "SELECT namespace, id, row_key, ts_ms, seq FROM newest_salted"),
    "keyed_state_salted_fixed": _sql("newest_salted", """
SELECT namespace, id, row_key, ts_ms, seq FROM newest_salted LEFT JOIN tombs USING (namespace, id)
WHERE del_ms IS NULL OR ts_ms > del_ms + 604800000"""),
    "archive_by_day": _sql("puts", """
SELECT namespace, ds, count(*) AS n, CAST(sum(strlen(payload)) AS BIGINT) AS n_bytes FROM puts GROUP BY ALL"""),
    "publish_layout": _sql("messages", """
SELECT namespace AS topic, count(*) AS n, count(DISTINCT id) AS n_ids, CAST(0 AS BIGINT) AS n_split_ids FROM messages GROUP BY ALL"""),
    "namespace_routing": _sql("messages", """
SELECT namespace, CASE WHEN namespace IN ('telemetry', 'metrics') THEN 'state'
  WHEN regexp_full_match(namespace, 'testpilot_.+') THEN 'archive' END AS route, count(*) AS n FROM messages GROUP BY ALL"""),
    "quarantine_reasons": _sql("classified", """
SELECT reason, count(*) AS n FROM classified WHERE reason IS NOT NULL GROUP BY ALL"""),
    "dedupe_stream": _sql("messages", "SELECT namespace, shard, seq, ord, id FROM messages"),
    "stream_rates": _sql("messages", """
SELECT namespace, ts_ms - ts_ms % 60000 AS bucket_ms, count(*) AS n, CAST(coalesce(sum(strlen(payload)), 0) AS BIGINT) AS n_bytes
FROM messages GROUP BY ALL"""),
    "ingest_e2e": _sql("alive", """
SELECT 'state' AS sink, namespace AS item, count(*) AS n FROM alive WHERE namespace IN ('telemetry', 'metrics') GROUP BY ALL
UNION ALL
SELECT 'archive', namespace, count(*) FROM puts WHERE starts_with(namespace, 'testpilot_') GROUP BY ALL
UNION ALL
SELECT 'quarantine', why, count(*) FROM (
  SELECT reason AS why FROM classified WHERE reason IS NOT NULL
  UNION ALL SELECT CASE WHEN action = 'invalid' THEN 'json' ELSE 'unroutable' END FROM gated
  WHERE action = 'invalid' OR starts_with(namespace, 'marketplace_')) GROUP BY ALL"""),
    "consume_e2e": _sql("gated", """
SELECT 'state' AS sink, namespace AS item, count(*) AS n FROM (
  SELECT * FROM whole WHERE action = 'store' AND namespace IN ('telemetry', 'metrics') QUALIFY row_number() OVER (PARTITION BY namespace, id
    ORDER BY ts_ms DESC, seq DESC, ord DESC, shard DESC) = 1) p
  WHERE NOT EXISTS (SELECT 1 FROM whole d WHERE d.action = 'delete' AND d.namespace = p.namespace AND d.id = p.id
    AND p.ts_ms <= d.ts_ms + 604800000) GROUP BY ALL
UNION ALL
SELECT 'archive', namespace, count(*) FROM whole WHERE action = 'store' AND starts_with(namespace, 'testpilot_') GROUP BY ALL
UNION ALL
SELECT 'quarantine', CASE WHEN corrupt THEN 'undecodable' WHEN action = 'invalid' THEN 'json' ELSE 'unroutable' END AS why, count(*)
FROM marked WHERE corrupt OR action = 'invalid' OR starts_with(namespace, 'marketplace_') GROUP BY ALL""", """
marked AS (SELECT *, seq % 50 = 0 AND ord = 0 AS corrupt FROM gated),
whole AS (SELECT * FROM marked WHERE NOT corrupt)"""),
}

ORACLES["consume_redelivered"] = ORACLES["consume_e2e"]
ORACLES["consume_salted_e2e"] = _sql("gated", f"""
SELECT 'state' AS sink, namespace AS item, count(*) AS n FROM newest LEFT JOIN gone USING (namespace, id)
WHERE deletes IS NULL OR ts_ms > del_ms + 604800000 GROUP BY ALL
UNION ALL
SELECT 'quarantine', CASE WHEN action = 'invalid' THEN 'json' ELSE 'unsaltable' END, count(*) FROM odd
WHERE action = 'invalid' OR (action = 'store' AND ts_ms IS NOT NULL AND NOT ({_HAS_SALT})) GROUP BY ALL""", _ODD + f""",
newest AS (SELECT DISTINCT namespace, id, day, max(ts_ms) AS ts_ms FROM (SELECT *, ts_ms // 86400000 AS day FROM odd
  WHERE action = 'store' AND (ts_ms IS NULL OR {_HAS_SALT})) GROUP BY ALL),
gone AS (SELECT namespace, id, max(ts_ms) AS del_ms, count(ts_ms) AS deletes FROM odd WHERE action = 'delete' GROUP BY ALL HAVING count(ts_ms) > 0)""")
# The batches of the stream come one after the other, each in log order.
ORACLES["rolling_archive"] = ORACLES["file_roll_plan"].replace("ORDER BY seq, ord", "ORDER BY seq % 5, seq, ord")
ORACLES["keyed_state_stream_late"] = _sql("gated", """
SELECT namespace, count(*) FILTER (WHERE NOT late) AS n_applied, count(*) FILTER (WHERE late) AS n_late, coalesce(max(n_alive), 0) AS n_alive
FROM judged LEFT JOIN (SELECT namespace, count(*) AS n_alive FROM oddest LEFT JOIN gone USING (namespace, id)
  WHERE deletes IS NULL OR ts_ms > del_ms + 604800000 GROUP BY ALL) USING (namespace) GROUP BY ALL""", _ODD + """,
moved AS (SELECT *, coalesce(seq % 20 = 0 AND ts_ms < 1704067200000 + 3 * 6 * 86400000, false) AS last FROM odd WHERE action IN ('store', 'delete')),
judged AS (SELECT *, coalesce(last AND ts_ms <= (SELECT max(ts_ms) FROM moved WHERE NOT last AND ts_ms < 1704067200000 + 4 * 6 * 86400000) - 6 * 86400000,
  false) AS late FROM moved),
oddest AS (SELECT * FROM judged WHERE action = 'store' AND NOT late QUALIFY row_number() OVER (PARTITION BY namespace, id
  ORDER BY ts_ms DESC NULLS LAST, seq DESC, ord DESC, shard DESC) = 1),
gone AS (SELECT namespace, id, max(ts_ms) AS del_ms, count(ts_ms) AS deletes FROM judged WHERE action = 'delete' AND NOT late
  GROUP BY ALL HAVING count(ts_ms) > 0)""")
ORACLES["live_meters"] = _sql("gated", f"""
SELECT 'request' AS meter, namespace, method AS item, unnest(['n', 'bytes']) AS measure,
  unnest([count(*), CAST(sum(CASE WHEN method = 'DELETE' THEN 0 ELSE strlen(body) END) AS BIGINT)]) AS value
FROM classified WHERE {_HANDLED} GROUP BY namespace, method
UNION ALL SELECT 'response', namespace, CAST(outcome AS STRING), 'n', count(*) FROM classified WHERE {_HANDLED} GROUP BY namespace, outcome
UNION ALL SELECT 'consumer', namespace, NULL, unnest(['n', 'invalid']), unnest([count(*), count(*) FILTER (WHERE action = 'invalid')])
FROM gated GROUP BY namespace
UNION ALL SELECT 'sink', namespace, NULL, unnest(['stored', 'deleted', 'oversized', 'failed']), unnest([
  count(*) FILTER (WHERE action = 'store' AND strlen(payload) <= 8), count(*) FILTER (WHERE action = 'delete'),
  count(*) FILTER (WHERE action = 'store' AND strlen(payload) > 8), count(*) FILTER (WHERE action = 'invalid')])
FROM gated GROUP BY namespace""")
ORACLES["sinks_by_configuration"] = _sql("gated", """
SELECT sink, count(*) AS n, CAST(coalesce(sum(CASE WHEN action = 'store' THEN strlen(payload) + CASE WHEN sink = 'archive_stamped' THEN 26 ELSE 0 END END), 0)
  AS BIGINT) AS n_bytes, count(*) FILTER (WHERE sink = 'archive_stamped') AS n_stamped
FROM (SELECT *, CASE WHEN namespace = 'telemetry' THEN 'records' WHEN namespace = 'metrics' THEN 'own'
        WHEN starts_with(namespace, 'testpilot_') THEN 'archive_stamped' ELSE 'replay' END AS sink FROM gated)
WHERE action = 'store' OR (action = 'delete' AND sink IN ('own', 'replay')) GROUP BY ALL""")
