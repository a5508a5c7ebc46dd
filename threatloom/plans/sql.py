"""SQL that must give the same rows as the Spark queries, on the same Parquet tables.

Written from the definition of each question, not from the Spark plans: windows are
self-joins, quotas a recursion over requests, rules plain conditions.
"""

from threatloom.sources.tables import DEFAULT_RULES

# `events` rows as security events; the twin of `sources/testdata.py`.
SEC = """
ids AS (
  SELECT event_id AS arrival, ts, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events
),
sec AS (
  SELECT
    arrival,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST((arrival // 5) * 5 AS INTEGER) AS received_at,
    CAST(arrival AS VARCHAR) AS event_id,
    ts AS "timestamp",
    CAST([31, 32, 33][arrival % 3 + 1] AS INTEGER) AS config_id,
    'policy-' || [31, 32, 33][arrival % 3 + 1] AS policy_id,
    '203.0.113.' || (user_id % 150) AS client_ip,
    ['north.test', 'a.west.test', 'south.test'][k % 3 + 1] AS hostname,
    ['/', '/news/today', '/login/start', '/basket', '/admin/audit', '/team', '/feeds/jobs',
     '/login/reset', '/help/contact', '/media/logo.svg', '/feeds/news'][k % 11 + 1] AS path,
    ['HEAD', 'GET', 'PATCH', 'POST'][k % 4 + 1] AS method,
    CAST(CASE WHEN event_type = 'error' THEN 410 WHEN k % 3 = 0 THEN 204 ELSE 302 END AS INTEGER) AS status_code,
    ['reader (browser)', 'feed/5', 'browser/9', 'probe/2', 'cli/3'][k % 5 + 1] AS user_agent,
    CAST(7000 + 3 * k AS VARCHAR) AS rule_id,
    ['INJECTION', 'XSS', 'PROTOCOL_VIOLATION', 'DATA_LEAKAGE', 'BOT', 'DOS', 'RATE_LIMIT'][k % 7 + 1] AS category,
    ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][(arrival // 3) % 4 + 1] AS severity,
    CASE WHEN event_type = 'error' THEN 'DENY' WHEN event_type IN ('purchase', 'signup') THEN 'ALERT'
         ELSE 'MONITOR' END AS action,
    CASE WHEN k % 10 <> 9 THEN ['NO', 'PE', 'KE', 'NZ', 'CA', 'LA'][k % 6 + 1] END AS geo_country,
    CASE WHEN k % 10 <> 9
         THEN ['Oslo', 'Lima', 'Nairobi', 'Napier', 'Regina', 'Vientiane'][k % 6 + 1] END AS geo_city,
    CAST(100 + k * 37 AS BIGINT) AS request_size,
    CAST(50 + k * 23 AS BIGINT) AS response_size,
    k
  FROM ids
)
"""

BASE_SCORE = """
  CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 WHEN 'LOW' THEN 10 ELSE 0 END
  + CASE action WHEN 'DENY' THEN 20 WHEN 'ALERT' THEN 10 ELSE 0 END
  + CASE WHEN path LIKE '%/admin%' OR path LIKE '%/login%' THEN 15 ELSE 0 END
"""

ATTACK_TYPE = """
  CASE category
    WHEN 'INJECTION' THEN 'SQL/Command Injection' WHEN 'XSS' THEN 'Cross-Site Scripting'
    WHEN 'PROTOCOL_VIOLATION' THEN 'Protocol Anomaly' WHEN 'DATA_LEAKAGE' THEN 'Data Exfiltration'
    WHEN 'BOT' THEN 'Bot Activity' WHEN 'DOS' THEN 'Denial of Service' WHEN 'RATE_LIMIT' THEN 'Rate Limiting' END
"""

# Score without the rolling count: what a rule on a missing fact adds is nothing.
STORED = f"""{SEC},
stored AS (
  SELECT *, 'sig-' || lower(category) AS rule_name, 'matched ' || lower(category) AS rule_message,
    {ATTACK_TYPE} AS attack_type, CAST({BASE_SCORE} AS INTEGER) AS threat_score
  FROM sec
)
"""

COUNTED = f"""{SEC},
counted AS (
  SELECT e.arrival, CAST(count(*) AS BIGINT) AS offender_count
  FROM sec e JOIN sec o ON o.client_ip = e.client_ip
    AND o.received_at >= e.received_at - INTERVAL 10 MINUTE
    AND (o.received_at < e.received_at OR (o.received_at = e.received_at AND o.arrival <= e.arrival))
  GROUP BY e.arrival
),
enriched AS (
  SELECT sec.*, offender_count, {ATTACK_TYPE} AS attack_type,
    CAST(least(100, greatest(0, {BASE_SCORE} + CASE WHEN offender_count > 5 THEN 15 ELSE 0 END)) AS INTEGER)
      AS threat_score
  FROM sec JOIN counted USING (arrival)
)
"""

RULE_CASES = {
    # predicate: (fact, operand, SQL condition)
    "EQUAL_TO": ("statusCode", "410.0", "status_code = 410"),
    "NOT_EQUAL_TO": ("geoLocation.country", "NO", "geo_country <> 'NO'"),
    "GREATER_THAN": ("requestSize", "2000", "request_size > 2000"),
    "GREATER_THAN_OR_EQUAL": ("rule.id", "7150", "CAST(rule_id AS INTEGER) >= 7150"),
    "LESS_THAN": ("hostname", "b", "hostname < 'b'"),
    "LESS_THAN_OR_EQUAL": ("responseSize", " 1062 ", "response_size <= 1062"),
    "IN": ("method", "GET, POST ,", "method IN ('GET', 'POST')"),
    "NOT_IN": ("geoLocation.city", "Lima, Napier", "geo_city NOT IN ('Lima', 'Napier')"),
    "CONTAINS": ("userAgent", "browser", "user_agent LIKE '%browser%'"),
    "CONTAINS_ANY": ("path", "/admin,/login", "path LIKE '%/admin%' OR path LIKE '%/login%'"),
    "STARTS_WITH": ("path", "/feeds/", "path LIKE '/feeds/%'"),
    "ENDS_WITH": ("path", "s", "path LIKE '%s'"),
    "REGEX_MATCH": ("clientIp", r"203\.0\.113\.[0-9]", r"regexp_full_match(client_ip, '203\.0\.113\.[0-9]')"),
    "BETWEEN": ("statusCode", "300,303", "status_code BETWEEN 300 AND 303"),
    "EXISTS": ("geoLocation", "true", "geo_country IS NOT NULL"),
}

FILTER_FROM, FILTER_TO = "2024-01-03 00:00:00", "2024-01-24 12:00:00"
FILTERED = (
    f"config_id = 31 AND \"timestamp\" >= TIMESTAMP '{FILTER_FROM}' AND \"timestamp\" <= TIMESTAMP '{FILTER_TO}'"
)
ALERTS_AS_OF = "2024-01-20 00:00:00"
ALERT_RULES = [
    ("inj-day", "INJECTION", 10, 1440),
    ("inj-hour", "INJECTION", 10, 60),
    ("xss-week", "XSS", 1, 10080),
    ("xss-week-high", "XSS", 100000000, 10080),
    ("bot-minute", "BOT", 1, 1),
    ("dos-month", "DOS", 1, 43200),
]
_SEEDED = ", ".join(
    f"('{i}', 'SCORING', '{title}', '{fact}', '{operator}', '{operand}', '{points}', {priority}, TRUE)"
    for i, title, fact, operator, operand, points, priority in DEFAULT_RULES
)
_ALERT_VALUES = ", ".join(f"('{i}', '{c}', {t}, {w})" for i, c, t, w in ALERT_RULES)

# What `ingest_messages` breaks on purpose, by event number.
MESSAGES = f"""{SEC},
items AS (
  SELECT arrival AS n,
    CASE WHEN arrival % 20 = 19 THEN -arrival ELSE arrival // 4 END AS message_id,
    arrival % 79 = 3 OR arrival % 83 = 2 OR (arrival % 89 <> 1 AND arrival % 113 = 6)
    OR arrival % 127 = 11 OR arrival % 131 = 13 OR (arrival % 89 <> 1 AND arrival % 137 = 17) AS malformed
  FROM sec
),
placed AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY n) - 1 AS position FROM items),
verdicts AS (
  SELECT message_id, CAST(count(*) AS BIGINT) AS items,
    bool_or(malformed) OR (message_id >= 0 AND message_id % 61 = 7) AS malformed,
    bool_or(n % 101 = 5 OR (n % 79 <> 3 AND n % 103 = 7) OR n % 97 = 0 OR n % 89 = 1 OR n % 109 = 4) AS invalid
  FROM placed GROUP BY message_id
),
violations AS (
  SELECT p.message_id, '[' || position || '].' || field AS field, message
  FROM placed p JOIN verdicts v USING (message_id),
    (VALUES ('eventId', 'must not be blank'), ('timestamp', 'must not be null'), ('clientIp', 'must not be blank'),
            ('rule', 'must not be null'), ('rule.name', 'must not be blank')) AS f(field, message)
  WHERE NOT v.malformed AND CASE field
    WHEN 'eventId' THEN n % 101 = 5
    WHEN 'timestamp' THEN n % 79 <> 3 AND n % 103 = 7
    WHEN 'clientIp' THEN n % 97 = 0
    WHEN 'rule' THEN n % 89 = 1
    ELSE n % 89 <> 1 AND n % 109 = 4 END
)
"""

ACCEPTED = f"""{MESSAGES},
accepted AS (
  SELECT s.* REPLACE (CASE WHEN s.arrival % 107 = 9 THEN 0 ELSE s.status_code END AS status_code)
  FROM sec s JOIN items ON n = arrival JOIN verdicts v USING (message_id) WHERE NOT v.malformed AND NOT v.invalid
)
"""

FLAT = """event_id, "timestamp", config_id, policy_id, client_ip, hostname, path, method, status_code, user_agent,
  rule_id, rule_name, rule_message, severity, category, action, geo_country, geo_city, request_size, response_size,
  attack_type, threat_score, received_at"""

SUMMARY = """
  SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS event_count,
    CAST(sum(threat_score) AS DOUBLE) / count(*) AS average_threat_score FROM {0}
  UNION ALL SELECT 'category', category, count(*), CAST(sum(threat_score) AS DOUBLE) / count(*) FROM {0} GROUP BY category
  UNION ALL SELECT 'action', action, count(*), CAST(sum(threat_score) AS DOUBLE) / count(*) FROM {0} GROUP BY action
  UNION ALL (SELECT 'attacker', client_ip, count(*), CAST(sum(threat_score) AS DOUBLE) / count(*) FROM {0}
             GROUP BY client_ip ORDER BY count(*) DESC, client_ip LIMIT 10)
  UNION ALL (SELECT 'path', path, count(*), CAST(sum(threat_score) AS DOUBLE) / count(*) FROM {0}
             GROUP BY path ORDER BY count(*) DESC, path LIMIT 10)
"""

# Requests of 40 clients; window starts follow from one another, so this is a recursion.
QUOTA = """
RECURSIVE requests AS (
  SELECT event_id AS arrival,
    '10.0.0.' || (user_id % 40) AS client,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST((event_id // 5) * 5 AS INTEGER) AS ts
  FROM events
),
nexts AS (
  SELECT a.client, a.ts, (SELECT min(b.ts) FROM requests b
    WHERE b.client = a.client AND b.ts >= a.ts + INTERVAL 60 SECOND) AS next_ts
  FROM (SELECT DISTINCT client, ts FROM requests) a
),
starts AS (
  SELECT client, min(ts) AS start FROM requests GROUP BY client
  UNION ALL
  SELECT s.client, n.next_ts FROM starts s JOIN nexts n ON n.client = s.client AND n.ts = s.start
  WHERE n.next_ts IS NOT NULL
),
opened AS (
  SELECT r.arrival, r.client, r.ts, (SELECT max(start) FROM starts s WHERE s.client = r.client AND s.start <= r.ts) AS start
  FROM requests r
)
"""

# One blocking rule per client address, and one edit per denied event.
RULE_ROWS = f"""{SEC},
current_rules AS (
  SELECT 'block-' || client_ip AS id, 'SCORING' AS type, 'Block ' || client_ip AS title, 'clientIp' AS fact_key,
    'EQUAL_TO' AS operator, client_ip AS operand, '50' AS output, CAST(5 AS INTEGER) AS priority, TRUE AS enabled
  FROM (SELECT DISTINCT client_ip FROM sec WHERE action <> 'DENY')
),
changes AS (
  SELECT 'block-' || client_ip AS id, 'SCORING' AS type, 'Event ' || event_id AS title, 'clientIp' AS fact_key,
    'EQUAL_TO' AS operator, client_ip AS operand, CAST(k AS VARCHAR) AS output,
    CAST(arrival % 100 AS INTEGER) AS priority, k % 2 = 0 AS enabled, arrival
  FROM sec WHERE action = 'DENY'
)
"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "classify": f"WITH {SEC} SELECT event_id, {ATTACK_TYPE} AS attack_type FROM sec",
        "facts_dotted": f"""WITH {SEC} SELECT event_id, severity AS rule_severity, geo_country,
            CAST(status_code AS VARCHAR) AS status_code, CAST(NULL AS VARCHAR) AS unknown_key,
            CAST(NULL AS VARCHAR) AS below_text,
            strftime("timestamp", '%Y-%m-%dT%H:%M:%S') ||
              CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN ''
                   WHEN epoch_us("timestamp") % 1000 = 0 THEN '.' || lpad(CAST(epoch_us("timestamp") % 1000000 // 1000 AS VARCHAR), 3, '0')
                   ELSE '.' || lpad(CAST(epoch_us("timestamp") % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS event_time
            FROM sec""",
        "rule_first_match": f"""WITH {SEC} SELECT event_id, CASE
              WHEN severity = 'CRITICAL' THEN 'severity-critical' WHEN severity = 'HIGH' THEN 'severity-high'
              WHEN severity = 'LOW' THEN 'severity-low' WHEN severity = 'MEDIUM' THEN 'severity-medium'
              WHEN action = 'ALERT' THEN 'action-alert' WHEN action = 'DENY' THEN 'action-deny' END AS rule_id
            FROM sec""",
        "matching_rules": f"""WITH {SEC} SELECT event_id, concat_ws(',', 'severity-' || lower(severity),
              CASE WHEN action <> 'MONITOR' THEN 'action-' || lower(action) END,
              CASE WHEN path LIKE '%/admin%' OR path LIKE '%/login%' THEN 'sensitive-path' END) AS rule_ids
            FROM sec""",
        "rule_hits": f"""WITH {SEC} SELECT rule_id, CAST(hits AS BIGINT) AS hits FROM (
              SELECT 'severity-critical' AS rule_id, count(*) FILTER (severity = 'CRITICAL') AS hits FROM sec
              UNION ALL SELECT 'severity-high', count(*) FILTER (severity = 'HIGH') FROM sec
              UNION ALL SELECT 'severity-medium', count(*) FILTER (severity = 'MEDIUM') FROM sec
              UNION ALL SELECT 'severity-low', count(*) FILTER (severity = 'LOW') FROM sec
              UNION ALL SELECT 'action-deny', count(*) FILTER (action = 'DENY') FROM sec
              UNION ALL SELECT 'action-alert', count(*) FILTER (action = 'ALERT') FROM sec
              UNION ALL SELECT 'sensitive-path', count(*) FILTER (path LIKE '%/admin%' OR path LIKE '%/login%') FROM sec
              UNION ALL SELECT 'repeat-offender', 0)""",
        "threat_score": f"WITH {STORED} SELECT event_id, threat_score FROM stored",
        "offender_count": f"WITH {COUNTED} SELECT arrival, offender_count FROM counted",
        "offender_count_millis": f"""WITH {SEC} SELECT e.arrival,
              CAST(count(DISTINCT epoch_ms(o.received_at)) AS BIGINT) AS offender_count
            FROM sec e JOIN sec o ON o.client_ip = e.client_ip
              AND o.received_at BETWEEN e.received_at - INTERVAL 10 MINUTE AND e.received_at
            GROUP BY e.arrival""",
        "first_sight": f"WITH {SEC} SELECT event_id, arrival FROM sec",
        "enrich": f"WITH {COUNTED} SELECT event_id, offender_count, threat_score, attack_type, received_at FROM enriched",
        "enriched_summary": f"WITH {COUNTED} {SUMMARY.format('enriched')}",
        "enriched_by_category": f"""WITH {COUNTED} SELECT category, CAST(count(*) AS BIGINT) AS event_count,
              avg(threat_score) AS average_threat_score FROM enriched GROUP BY category""",
        "total_events": f"WITH {STORED} SELECT CAST(count(*) AS BIGINT) AS total_events FROM stored WHERE {FILTERED}",
        "count_all": "SELECT CAST(count(*) AS BIGINT) AS stored_events FROM events",
        "find_by_config": f"WITH {STORED} SELECT event_id, config_id, path FROM stored WHERE config_id = 32",
        "by_category": f"""WITH {STORED} SELECT category, CAST(count(*) AS BIGINT) AS event_count,
              avg(threat_score) AS average_threat_score FROM stored WHERE {FILTERED} GROUP BY category""",
        "by_action": f"""WITH {STORED} SELECT action, CAST(count(*) AS BIGINT) AS event_count FROM stored
              WHERE {FILTERED} GROUP BY action""",
        "top_attackers": f"""WITH {STORED} SELECT client_ip, CAST(count(*) AS BIGINT) AS event_count,
              avg(threat_score) AS average_threat_score FROM stored WHERE {FILTERED}
            GROUP BY client_ip ORDER BY event_count DESC, client_ip LIMIT 10""",
        "top_paths": f"""WITH {STORED} SELECT path, CAST(count(*) AS BIGINT) AS event_count FROM stored
              WHERE {FILTERED} GROUP BY path ORDER BY event_count DESC, path LIMIT 10""",
        "summary": f"WITH {STORED}, f AS (SELECT * FROM stored WHERE {FILTERED}) {SUMMARY.format('f')}",
        "summary_document": f"""WITH {STORED}, f AS (SELECT * FROM stored WHERE {FILTERED}), s AS ({SUMMARY.format('f')}),
              r AS (SELECT *, floor(average_threat_score * 10 + 0.5) / 10 AS average FROM s)
            SELECT CASE section WHEN 'category' THEN 'byCategory' ELSE 'topAttackers' END AS part, key,
              event_count, average FROM r WHERE section IN ('category', 'attacker')
            UNION ALL SELECT CASE section WHEN 'action' THEN 'byAction' WHEN 'path' THEN 'topTargetedPaths'
              ELSE 'totalEvents' END, key, event_count, NULL FROM r WHERE section IN ('action', 'path', 'total')""",
        "samples_page": f"""WITH {STORED} SELECT event_id, "timestamp", category, threat_score FROM stored
              WHERE category = 'INJECTION' AND action = 'ALERT' ORDER BY "timestamp" DESC, event_id OFFSET 40 LIMIT 100""",
        "samples_deep_page": f"""WITH {STORED} SELECT event_id, "timestamp" FROM stored
              ORDER BY "timestamp" DESC, event_id OFFSET 9950 LIMIT 100""",
        "samples_total": f"""WITH {STORED} SELECT CAST(count(*) AS BIGINT) AS total FROM stored
              WHERE category = 'INJECTION' AND action = 'ALERT'""",
        "samples_response": f"""WITH {STORED} SELECT event_id, rule_id, severity, geo_country, FALSE AS rule_missing,
              FALSE AS geo_missing FROM stored""",
        "count_category_within": f"""WITH {STORED} SELECT CAST(count(*) AS BIGINT) AS event_count FROM stored
              WHERE category = 'XSS' AND "timestamp" BETWEEN TIMESTAMP '{FILTER_FROM}' AND TIMESTAMP '{FILTER_TO}'""",
        "alerts": f"""WITH {SEC}, r(rule_id, category, threshold, window_minutes) AS (VALUES {_ALERT_VALUES}),
              c AS (SELECT r.*, (SELECT count(*) FROM sec WHERE sec.category = r.category
                AND "timestamp" BETWEEN TIMESTAMP '{ALERTS_AS_OF}' - INTERVAL 1 MINUTE * r.window_minutes
                AND TIMESTAMP '{ALERTS_AS_OF}') AS event_count FROM r)
            SELECT rule_id, category, CAST(threshold AS INTEGER) AS threshold,
              CAST(window_minutes AS INTEGER) AS window_minutes, CAST(event_count AS BIGINT) AS event_count,
              event_count >= threshold AS firing FROM c""",
        "quota_flags": f"""WITH {QUOTA}, numbered AS (SELECT arrival, client,
                row_number() OVER (PARTITION BY client, start ORDER BY ts, arrival) AS request_number FROM opened)
            SELECT arrival, client, CAST(request_number AS BIGINT) AS request_number, request_number <= 3 AS allowed
            FROM numbered""",
        "client_key": """SELECT event_id AS arrival, '10.0.0.' || (user_id % 40) AS client FROM events""",
        "ingest_verdicts": f"""WITH {MESSAGES} SELECT message_id, CASE WHEN malformed THEN 'MALFORMED_REQUEST'
              WHEN invalid THEN 'VALIDATION_FAILED' END AS error_code,
              CAST(CASE WHEN malformed OR invalid THEN 0 ELSE items END AS INTEGER) AS accepted_count FROM verdicts""",
        "ingest_violations": f"WITH {MESSAGES} SELECT message_id, field, message FROM violations",
        "ingest_accepted": f"""WITH {ACCEPTED} SELECT event_id, "timestamp", config_id, client_ip, path, status_code,
              rule_id, severity, category, action, geo_city, request_size FROM accepted""",
        "ingest_rejected": f"""WITH {MESSAGES} SELECT CASE WHEN malformed THEN 'MALFORMED_REQUEST'
              ELSE 'VALIDATION_FAILED' END AS error_code, CAST(count(*) AS BIGINT) AS messages
            FROM verdicts WHERE malformed OR invalid GROUP BY 1""",
        "correlation": f"""WITH {MESSAGES} SELECT message_id,
              CASE WHEN message_id % 3 = 0 THEN 'corr-' || message_id ELSE 'new' END AS correlation_id FROM verdicts""",
        "raw_log": f"""WITH {ACCEPTED} SELECT client_ip AS key, event_id, "timestamp", CAST(1 AS INTEGER) AS version
            FROM accepted""",
        "enriched_log": f"""WITH {STORED} SELECT CAST(config_id AS VARCHAR) AS key, event_id, threat_score,
              attack_type, received_at FROM stored""",
        "flatten_roundtrip": f"WITH {STORED} SELECT {FLAT} FROM stored",
        "append_once": f"WITH {STORED} SELECT {FLAT} FROM stored",
        "export_json": f"WITH {STORED} SELECT event_id, \"timestamp\", path, threat_score FROM stored",
        "rules_upsert": f"""WITH {RULE_ROWS}, newest AS (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival DESC) AS r FROM changes)
            SELECT id, type, title, fact_key, operator, operand, output, priority, enabled FROM newest WHERE r = 1
            UNION ALL SELECT * FROM current_rules WHERE id NOT IN (SELECT id FROM changes)""",
        "rules_delete": f"""WITH {RULE_ROWS} SELECT * FROM current_rules
            WHERE id NOT IN (SELECT 'block-' || client_ip FROM sec WHERE k = 7)""",
        "rules_delete_all_stored": f"""WITH {RULE_ROWS} SELECT 'before' AS moment, CAST(count(*) AS BIGINT) AS rules
            FROM current_rules UNION ALL SELECT 'after', 0""",
        "rules_edited_at_once": f"""WITH {RULE_ROWS}, newest AS (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival DESC) AS r FROM changes
              WHERE right(id, 1) IN ('0', '2', '4', '6', '8'))
            SELECT id, type, title, fact_key, operator, operand, output, priority, enabled FROM newest WHERE r = 1
            UNION ALL SELECT * FROM current_rules WHERE id NOT IN (SELECT id FROM newest)
              AND NOT (right(id, 1) NOT IN ('0', '2', '4', '6', '8') AND id IN (SELECT 'block-' || client_ip FROM sec WHERE k = 7))""",
        "rules_seed": f"""WITH {RULE_ROWS} SELECT * REPLACE ('BLOCKING' AS type) FROM current_rules
            UNION ALL VALUES {_SEEDED}""",
        "alert_rules_stored": f"""WITH {SEC}, r AS (SELECT 'rule-' || category AS rule_id, category,
                count(*) FILTER (action = 'DENY') + 1 AS threshold FROM sec GROUP BY category),
              c AS (SELECT r.*, (SELECT count(*) FROM sec WHERE sec.category = r.category AND "timestamp"
                BETWEEN TIMESTAMP '{ALERTS_AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{ALERTS_AS_OF}') AS event_count FROM r)
            SELECT rule_id, category, CAST(threshold AS INTEGER) AS threshold, CAST(10080 AS INTEGER) AS window_minutes,
              CAST(event_count AS BIGINT) AS event_count, event_count >= threshold AS firing FROM c""",
        "append_changed_days": f"""WITH {STORED} SELECT event_id, "timestamp", threat_score FROM stored WHERE arrival % 3 > 0
            UNION ALL SELECT CASE WHEN arrival % 7 = 0 THEN 'n' || event_id ELSE event_id END, "timestamp" + INTERVAL 2 DAY,
              threat_score FROM stored WHERE arrival % 3 = 0 OR arrival % 7 = 0""",
        "stream_rule_edit": f"""WITH {COUNTED} SELECT event_id, CAST(threat_score + CASE
              WHEN arrival <= (SELECT max(arrival) FROM sec) // 3 THEN 0
              ELSE (method = 'HEAD')::INTEGER * 7 - (severity = 'LOW')::INTEGER * 10 END AS INTEGER) AS threat_score FROM enriched""",
        # Receipt times of all messages are alike, so a client's events count in the order of the log.
        "stream_all_stages": f"""WITH {ACCEPTED}, ranked AS (
              SELECT a.*, row_number() OVER (PARTITION BY client_ip ORDER BY message_id, n) AS seen
              FROM accepted a JOIN items ON n = arrival),
            scored AS (SELECT *, {BASE_SCORE} + CASE WHEN seen > 5 THEN 15 ELSE 0 END AS threat_score FROM ranked)
            {SUMMARY.format("scored")}""",
        "stream_store": f"""WITH {COUNTED} SELECT arrival, CAST(config_id AS VARCHAR) AS key, 'corr-' || arrival AS correlation,
              CASE WHEN arrival % 50 <> 7 THEN threat_score END AS threat_score,
              CASE WHEN arrival % 50 <> 7 THEN received_at END AS occurred_at, arrival % 50 = 7 AS refused FROM enriched""",
        "rules_violations": f"""WITH {RULE_ROWS} SELECT id, title, 'operator' AS field FROM changes WHERE priority % 5 = 1
            UNION ALL SELECT id, title, 'operand' FROM changes WHERE priority % 7 = 1""",
        "alert_rule_violations": f"""WITH {SEC} SELECT event_id, field FROM sec,
              (VALUES ('category'), ('threshold'), ('windowMinutes')) AS f(field)
            WHERE CASE field WHEN 'category' THEN k % 6 = 0 WHEN 'threshold' THEN k % 9 = 0 ELSE k % 4 = 0 END""",
        "stream_ingest": f"""WITH {ACCEPTED} SELECT 'accepted' AS outcome, event_id AS key FROM accepted
            UNION ALL SELECT CASE WHEN malformed THEN 'malformed_request' ELSE 'validation_failed' END,
              CAST(message_id AS VARCHAR) FROM verdicts WHERE malformed OR invalid""",
        "stream_enrich": f"WITH {COUNTED} SELECT event_id, client_ip, threat_score, attack_type FROM enriched",
        "stream_offender_count": f"WITH {COUNTED} SELECT arrival, offender_count FROM counted",
        "stream_quota": f"""WITH {QUOTA}, numbered AS (SELECT arrival,
                row_number() OVER (PARTITION BY client, start ORDER BY ts, arrival) AS request_number FROM opened)
            SELECT arrival, CAST(request_number AS BIGINT) AS request_number, request_number <= 3 AS allowed FROM numbered""",
    }
    for operator, (_, _, condition) in RULE_CASES.items():
        sql[f"rule_{operator.lower()}"] = f"WITH {SEC} SELECT event_id, coalesce({condition}, FALSE) AS matched FROM sec"
    for label, seconds in {"1m": 60, "5m": 300, "1h": 3600}.items():
        buckets = f"""make_timestamp((epoch_us("timestamp") // {seconds * 1_000_000}) * {seconds * 1_000_000})"""
        sql[f"timeseries_{label}"] = f"""WITH {STORED} SELECT {buckets} AS bucket_start,
              CAST(count(*) AS BIGINT) AS event_count FROM stored WHERE {FILTERED} GROUP BY 1"""
    hours = """make_timestamp((epoch_us("timestamp") // 3600000000) * 3600000000)"""
    sql["stream_timeseries"] = f"""WITH {STORED} SELECT {hours} AS bucket_start,
          CAST(count(*) AS BIGINT) AS event_count FROM stored GROUP BY 1"""
    sql["stream_alerts"] = sql["alerts"]
    sql["stream_rejects"] = f"WITH {SEC} SELECT arrival FROM sec WHERE arrival % 50 = 7"
    series = [f"timeseries_{width}" for width in ("1m", "5m", "1h")]
    for name in ("total_events", "by_category", "by_action", "top_attackers", "top_paths", "summary", "summary_document", *series):
        sql[f"{name}_all"] = sql[name].replace(FILTERED, "TRUE")
    # Hourly rows must give what the events give.
    for name in ("by_category", "by_category_all", "by_action", "timeseries_1h", "count_category_within"):
        sql[f"rolled_{name}"] = sql[name]
    sql["rolled_page"] = sql["samples_deep_page"]
    return sql
