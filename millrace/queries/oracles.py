"""For each query the SQL that gives the same rows from the same tables."""

from __future__ import annotations

_LEDGER = """
ledger AS (
  SELECT c_mktsegment AS application, o_orderdate AS ts,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

#: The ledger with an amount of zero on each day between an application's first and last.
_EVERY_DAY = """
spans AS (
  SELECT application, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi
  FROM ledger GROUP BY application
),
every_day AS (
  SELECT application, ts, amount FROM ledger
  UNION ALL
  SELECT application, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP),
         CAST(0 AS DECIMAL(18,2))
  FROM spans
)"""

_PERIODS = """
periods AS (
  SELECT application, 'DAILY' AS time_unit, CAST(date_trunc('day', ts) AS DATE) AS period, amount
  FROM ledger
  UNION ALL
  SELECT application, 'MONTHLY', CAST(date_trunc('month', ts) AS DATE), amount FROM ledger
  UNION ALL
  SELECT application, 'QUARTERLY', CAST(date_trunc('quarter', ts) AS DATE), amount FROM ledger
  UNION ALL
  SELECT application, 'ANNUALLY', CAST(date_trunc('year', ts) AS DATE), amount FROM ledger
),
spend AS (
  SELECT application, time_unit, period, sum(amount) AS spend
  FROM periods GROUP BY application, time_unit, period
)"""

_SPEND = f"{_LEDGER},{_PERIODS}"
_SPEND_EVERY_DAY = f"{_LEDGER},{_EVERY_DAY},{_PERIODS.replace('FROM ledger', 'FROM every_day')}"

_SEGMENT_BUDGETS = """
budgets AS (
  SELECT c_mktsegment AS application,
         CAST(floor(sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) * 7) AS BIGINT) AS monthly_limit
  FROM customer GROUP BY c_mktsegment
)"""

_LIMITS = """
limits AS (
  SELECT application, 'DAILY' AS time_unit, monthly_limit // 30 AS limit_amount FROM budgets
  UNION ALL SELECT application, 'MONTHLY', monthly_limit FROM budgets
  UNION ALL SELECT application, 'QUARTERLY', monthly_limit * 3 FROM budgets
  UNION ALL SELECT application, 'ANNUALLY', monthly_limit * 12 FROM budgets
)"""

_ALERTS = f"""{_SPEND},{_SEGMENT_BUDGETS},{_LIMITS},
rules(time_unit, threshold) AS (
  VALUES ('DAILY', 80), ('DAILY', 100),
         ('MONTHLY', 90), ('MONTHLY', 95), ('MONTHLY', 99), ('MONTHLY', 100),
         ('QUARTERLY', 90), ('QUARTERLY', 100), ('ANNUALLY', 90), ('ANNUALLY', 100)
),
alerts AS (
  SELECT application, time_unit, period, CAST(threshold AS BIGINT) AS threshold, limit_amount,
         CAST(spend AS DOUBLE) AS spend
  FROM spend JOIN limits USING (application, time_unit) JOIN rules USING (time_unit)
  WHERE spend * 100 >= threshold * limit_amount AND (limit_amount > 0 OR spend > 0)
)"""

_REQUESTS = """
requests AS (
  SELECT event_id AS request_id, user_id AS api_key, event_type, ts,
         CASE user_id % 4 WHEN 0 THEN 'default' ELSE 'tier-' || (user_id % 4) END AS tier
  FROM events
)"""

_TIGHT_TIERS = """
tiers(tier, limit_per_minute) AS (
  VALUES ('default', NULL), ('tier-1', 1), ('tier-2', 2), ('tier-3', 3)
)"""


def _audit(tiers: str, unit: str) -> str:
    return f"""WITH {_REQUESTS},{tiers}
SELECT api_key, tier, date_trunc('{unit}', ts) AS window_start, count(*) AS requests,
       limit_per_minute, coalesce(count(*) > limit_per_minute, false) AS exceeded
FROM requests JOIN tiers USING (tier)
GROUP BY api_key, tier, date_trunc('{unit}', ts), limit_per_minute"""


_THROTTLED = f"""WITH {_REQUESTS},{_TIGHT_TIERS},
numbered AS (
  SELECT request_id, limit_per_minute,
         row_number() OVER (PARTITION BY event_type, tier, date_trunc('hour', ts)
                            ORDER BY ts, request_id) AS n
  FROM requests JOIN tiers USING (tier)
)
SELECT request_id, n FROM numbered WHERE n > limit_per_minute"""


_LOG = """
log AS (
  SELECT url AS key, 1 AS seq, 'put' AS op, html AS content FROM pages
  UNION ALL SELECT url, 2, 'put', html || '<!-- again -->' FROM pages WHERE url LIKE 'https:%'
  UNION ALL SELECT url, 3, 'delete', NULL FROM pages WHERE url LIKE '%#%'
  UNION ALL SELECT url, 4, 'put', html || '<!-- back -->' FROM pages
  WHERE url LIKE 'https:%' AND url LIKE '%#%'
),
state AS (
  SELECT key, content
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log)
  WHERE rn = 1 AND op = 'put'
)"""

_OUTCOMES = """
answers AS (
  SELECT conv_id,
         bool_or(role = 'system') AS timed_out,
         arg_max(role, turn) = 'user' AS answered,
         '{"messages":' || count(*) || ',"characters":' || sum(length(text)) || '}' AS answer
  FROM conversations GROUP BY conv_id
),
outcomes AS (
  SELECT conv_id,
         CASE WHEN timed_out THEN NULL WHEN answered THEN 200 ELSE 422 END AS status,
         CASE WHEN NOT timed_out AND answered THEN answer END AS response,
         CASE WHEN timed_out THEN 'TimeoutError: no answer'
              WHEN NOT answered THEN '{"error":"last message is not from the user"}' END AS error
  FROM answers
)"""

ORACLES = {
    "read_table": "SELECT * FROM orders",
    "read_topic": """
SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type""",
    "list_objects": """
SELECT lang, 'lang=' || lang || '/part-' AS key_prefix,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY lang""",
    "read_objects": "SELECT *, 'part' AS kind FROM pages",
    "read_named_objects": "SELECT page_id, url, 'part' AS kind FROM pages",
    "objects_at": """
SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes,
       CAST(1 AS BIGINT) AS found, CAST(1 AS BIGINT) AS absent
FROM documents GROUP BY lang""",
    "read_object_ranges": "SELECT *, 'part' AS kind FROM pages",
    "write_table": "SELECT * FROM orders",
    "write_table_own_rows": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "write_table_overwrite": """
SELECT o_orderkey, o_totalprice, o_orderstatus, TRUE AS in_place
FROM orders WHERE o_orderstatus = 'F'""",
    "write_stream": "SELECT * FROM events",
    "put_objects": """
SELECT url AS key, CAST(1 AS BIGINT) AS seq, 'put' AS op, html AS content FROM pages
UNION ALL
SELECT url, 2, 'put', html || '<!-- again -->' FROM pages WHERE url LIKE 'https:%'""",
    "delete_objects": "SELECT url AS key, html AS content FROM pages WHERE url NOT LIKE '%#%'",
    "object_state": f"WITH {_LOG} SELECT key, content FROM state",
    "compacted_state": f"WITH {_LOG} SELECT key, content FROM state",
    "object_keys": f"WITH {_LOG} SELECT key FROM state",
    "objects_exist": f"""WITH {_LOG},
keys AS (
  SELECT url AS key FROM pages
  UNION SELECT regexp_replace(url, '[?#].*$', '') FROM pages
)
SELECT key, key IN (SELECT key FROM state) AS exists FROM keys""",
    "run_application": f"""WITH {_SPEND}
SELECT application, time_unit, period, CAST(spend AS DOUBLE) AS spend FROM spend""",
    "run_application_streaming": "SELECT * FROM events",
    "run_application_streaming_tables": """
SELECT event_id, event_type, value, copy
FROM events CROSS JOIN (VALUES ('first'), ('second')) AS t(copy)""",
    "merge_tags": """
SELECT c_custkey, 'application' AS key, c_name AS value FROM customer
UNION ALL
SELECT c_custkey, 'tool', CASE WHEN c_acctbal < 0 THEN 'manual' ELSE 'millrace' END FROM customer
UNION ALL
SELECT c_custkey, 'env', lower(c_mktsegment) FROM customer""",
    "tag_filter": f"""WITH {_LEDGER}
SELECT application, ts, CAST(amount AS DOUBLE) AS amount
FROM ledger WHERE application = 'BUILDING'""",
    "name_audit": r"""WITH
names(name) AS (
  SELECT p_name FROM part UNION SELECT replace(p_name, ' ', '-') FROM part
  UNION SELECT c_name FROM customer UNION SELECT replace(lower(c_name), '#', '-') FROM customer
  UNION SELECT s_name FROM supplier UNION SELECT source FROM documents
),
forms AS (
  SELECT name, regexp_matches(name, '^[a-z0-9-]+\n?\z') AS ok,
         array_to_string(list_transform(
           regexp_extract_all(name, '[a-zA-Z0-9]+'),
           lambda w: upper(w[1]) || lower(w[2:])), '') AS camel
  FROM names
)
SELECT name, ok, camel, count(*) OVER (PARTITION BY camel) AS same_camel FROM forms""",
    "single_turn_requests": """
SELECT doc_id AS id,
       CAST(to_json({'messages': [{'role': CASE WHEN lang <> 'en' THEN 'assistant' ELSE 'user' END,
                              'content': text}],
                'parameters': {'max_new_tokens': 400},
                'stream': false}) AS VARCHAR) AS request
FROM documents""",
    "budget_limits": f"""WITH
budgets AS (
  SELECT c_name AS application,
         CAST(floor(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS BIGINT) AS monthly_limit
  FROM customer
),{_LIMITS}
SELECT * FROM limits""",
    "spend_by_period": f"""WITH {_SPEND}
SELECT application, time_unit, period, CAST(spend AS DOUBLE) AS spend FROM spend""",
    "spend_from_days": f"""WITH {_SPEND}
SELECT application, time_unit, period, CAST(spend AS DOUBLE) AS spend FROM spend""",
    "budget_alerts": f"WITH {_ALERTS} SELECT * FROM alerts",
    "low_spend_alerts": f"""WITH {_SPEND_EVERY_DAY},{_SEGMENT_BUDGETS},{_LIMITS},
rules(time_unit, threshold) AS (
  VALUES ('DAILY', 100000), ('DAILY', 250000), ('MONTHLY', 8000000)
)
SELECT application, time_unit, period, CAST(threshold AS BIGINT) AS threshold, limit_amount,
       CAST(spend AS DOUBLE) AS spend
FROM spend JOIN limits USING (application, time_unit) JOIN rules USING (time_unit)
WHERE spend < threshold""",
    "alert_recipients": f"""WITH {_ALERTS},
subscribers AS (
  SELECT DISTINCT c_mktsegment AS application,
         'region-' || (c_nationkey % 5) || '@example.com' AS subscriber
  FROM customer WHERE c_mktsegment <> 'BUILDING'
)
SELECT alerts.*, subscriber FROM alerts JOIN subscribers USING (application)""",
    "rate_limit_audit": _audit(
        """
tiers(tier, limit_per_minute) AS (
  VALUES ('default', NULL), ('tier-1', 500), ('tier-2', 5000), ('tier-3', 10000)
)""",
        "minute",
    ),
    "rate_limit_audit_daily": _audit(_TIGHT_TIERS, "day"),
    "rate_limit_stream": _audit(_TIGHT_TIERS, "day"),
    "throttled_requests": _THROTTLED,
    "throttle_stream": _THROTTLED,
    "conversation_requests": """
SELECT conv_id,
       CAST(to_json({'messages': list({'role': role, 'content': text} ORDER BY turn, role, text),
                'parameters': {'max_new_tokens': 400},
                'stream': false}) AS VARCHAR) AS request
FROM conversations GROUP BY conv_id""",
    "chat_completions": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
    "journaled_completions": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
    "chat_completed": f"WITH {_OUTCOMES} SELECT conv_id, response FROM outcomes WHERE status = 200",
    "chat_failed": f"""WITH {_OUTCOMES}
SELECT conv_id, status, error FROM outcomes WHERE status IS DISTINCT FROM 200""",
    "chat_outcomes": f"""WITH {_OUTCOMES}
SELECT CASE WHEN status = 200 THEN 'ok' ELSE 'failed' END AS status_class, count(*) AS n
FROM outcomes GROUP BY 1""",
}
