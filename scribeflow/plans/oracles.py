"""The same results in SQL over the driver's tables."""

from __future__ import annotations

from . import native_queries, stream_queries

_E = """
e AS (
  SELECT user_id::VARCHAR AS session_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    event_id, event_type, props, value, epoch_us(ts) AS ts_us, k, 'tool_' || (k % 7) AS tool,
    CASE k % 7 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'search' WHEN 3 THEN 'execute' WHEN 4 THEN 'fetch' WHEN 5 THEN 'think' ELSE 'other' END AS tool_kind,
    CASE event_type WHEN 'signup' THEN 'user_message' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'assistant_message' ELSE 'tool_result' END AS kind
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
_P = (
    _E
    + """,
p AS (
  SELECT *, last_value(CASE WHEN kind = 'tool_call' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_key, k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call_seq
  FROM e WHERE kind IN ('tool_call', 'tool_result')
),
i AS (
  SELECT session_key, k, coalesce(call_seq, seq) AS seq, bool_or(kind = 'tool_call') AS has_call, max(CASE WHEN kind = 'tool_call' THEN tool END) AS tool,
    max(CASE WHEN kind = 'tool_call' THEN tool_kind END) AS tool_kind, max(CASE WHEN kind = 'tool_call' THEN ts_us END) AS call_us,
    count(*) FILTER (WHERE kind = 'tool_result') AS n_results, count(*) FILTER (WHERE event_type = 'error') AS errors,
    coalesce(sum(strlen(props)) FILTER (WHERE kind = 'tool_result'), 0) AS bytes, max(CASE WHEN kind = 'tool_result' THEN ts_us END) AS last_us,
    string_agg(CASE WHEN kind = 'tool_result' THEN seq::VARCHAR END, ',' ORDER BY seq) AS result_seqs
  FROM p GROUP BY ALL
),
r AS (
  SELECT *, CASE WHEN has_call THEN tool ELSE '(unknown)' END AS name, CASE WHEN has_call AND last_us >= call_us THEN (last_us - call_us) // 1000 END AS ms FROM i
)"""
)
_P = _P.replace("FROM p GROUP BY ALL", "FROM p GROUP BY session_key, k, coalesce(call_seq, seq)")
_C = """
c AS (
  SELECT conv_id::VARCHAR AS session_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq, role, text,
    CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'system' END AS kind
  FROM conversations
)"""
_S = (
    _P
    + """,
s AS (
  SELECT session_key, count(*) AS events, count(*) FILTER (WHERE kind = 'user_message' AND k % 5 <> 0) AS user_messages, count(*) FILTER (WHERE kind = 'user_message' AND k % 5 = 0) AS harness_messages,
    sum(CASE WHEN kind = 'assistant_message' THEN k END)::BIGINT AS input_tokens, sum(CASE WHEN kind = 'assistant_message' THEN floor(value)::BIGINT END)::BIGINT AS output_tokens,
    sum(CASE WHEN kind = 'assistant_message' THEN 0 END)::BIGINT AS cache_read_input_tokens, sum(CASE WHEN kind = 'assistant_message' THEN 0 END)::BIGINT AS cache_creation_input_tokens,
    min(ts_us) AS start_us, max(ts_us) AS end_us, (max(ts_us) - min(ts_us)) // 1000 AS wall_time_ms,
    arg_max('bought ' || k, seq) FILTER (WHERE kind = 'assistant_message') AS final_answer, 0::BIGINT AS unknown_events
  FROM e GROUP BY session_key
),
t AS (
  SELECT session_key, count(*) FILTER (WHERE has_call) AS tool_calls, count(*) FILTER (WHERE has_call AND n_results = 0) AS unanswered_calls, coalesce(sum(n_results) FILTER (WHERE NOT has_call), 0)::BIGINT AS orphan_results,
    sum(errors)::BIGINT AS tool_errors, sum(bytes)::BIGINT AS result_bytes, 0::BIGINT AS fetch_raw_bytes, coalesce(sum(ms), 0)::BIGINT AS tool_time_ms
  FROM r GROUP BY session_key
),
w AS (
  SELECT s.*, coalesce(tool_calls, 0) AS tool_calls, coalesce(unanswered_calls, 0) AS unanswered_calls, coalesce(orphan_results, 0) AS orphan_results, coalesce(tool_errors, 0) AS tool_errors,
    coalesce(result_bytes, 0) AS result_bytes, coalesce(fetch_raw_bytes, 0) AS fetch_raw_bytes, coalesce(tool_time_ms, 0) AS tool_time_ms
  FROM s LEFT JOIN t USING (session_key)
)"""
)
_RT = """
SELECT session_key, {events} AS events, count(*) FILTER (WHERE role = 'user') AS user_messages, {tokens},
  sha256(coalesce(arg_max(text, seq) FILTER (WHERE role = 'assistant' AND text <> ''), '')) AS final_sha256
FROM c GROUP BY session_key"""

ORACLES: dict[str, str] = {
    "stats_summary": f"WITH {_S} SELECT * FROM w",
    "event_kind_counts": f"WITH {_E} SELECT session_key, kind, count(*) AS n FROM e GROUP BY ALL",
    "message_origin_counts": f"WITH {_S} SELECT session_key, user_messages, harness_messages FROM s",
    "tool_calls_by_name": f"WITH {_E} SELECT session_key, tool AS key, count(*) AS value FROM e WHERE kind = 'tool_call' GROUP BY ALL",
    "tool_calls_by_kind": f"WITH {_E} SELECT session_key, tool_kind AS key, count(*) AS value FROM e WHERE kind = 'tool_call' GROUP BY ALL",
    "tool_interactions": f"WITH {_P} SELECT session_key, seq, k::VARCHAR AS tool_call_id, has_call, n_results, coalesce(result_seqs, '') AS result_seqs FROM i",
    "unanswered_calls": f"WITH {_P} SELECT session_key, seq, tool FROM i WHERE has_call AND n_results = 0",
    "orphan_results": f"WITH {_P} SELECT session_key, seq, k::VARCHAR AS tool_call_id FROM i WHERE NOT has_call",
    "tool_errors": f"WITH {_P} SELECT session_key, sum(errors)::BIGINT AS tool_errors FROM i GROUP BY session_key",
    "result_bytes_by_tool": f"WITH {_P} SELECT session_key, name AS key, sum(bytes)::BIGINT AS value FROM r WHERE n_results > 0 GROUP BY ALL",
    "tool_latency_ms": f"WITH {_P} SELECT session_key, name AS key, sum(ms)::BIGINT AS value FROM r WHERE ms IS NOT NULL GROUP BY ALL",
    "system_by_subtype": f"WITH {_C} SELECT session_key, 'message/' || coalesce(role, '') AS key, count(*) AS value FROM c WHERE kind = 'system' GROUP BY ALL",
    "models_first_observed": f"WITH {_E}, m AS (SELECT session_key, 'm' || (k % 3) AS model, min(seq) AS first_seq FROM e WHERE kind = 'assistant_message' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY first_seq) AS model_ord FROM m",
    "session_totals": f"WITH {_S} SELECT session_key, input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens FROM s",
    "session_wall_time": f"WITH {_S} SELECT session_key, start_us, end_us, wall_time_ms FROM s",
    "final_answer": f"WITH {_C} SELECT session_key, arg_max(text, seq) FILTER (WHERE kind = 'assistant_message' AND text <> '') AS final_answer FROM c GROUP BY session_key",
    "session_report": f"WITH {_P} SELECT session_key, 'unknown_events' AS metric, '' AS key, 0::BIGINT AS value FROM e GROUP BY session_key UNION ALL SELECT session_key, 'orphan_results', '', coalesce(sum(n_results) FILTER (WHERE NOT has_call), 0)::BIGINT FROM i GROUP BY session_key",
    "acp_updates": f"""WITH {_E} SELECT session_key, seq, 0::BIGINT AS block_idx,
      CASE kind WHEN 'user_message' THEN 'user_message_chunk' WHEN 'assistant_message' THEN 'agent_message_chunk' WHEN 'tool_call' THEN 'tool_call' ELSE 'tool_call_update' END AS update,
      CASE kind WHEN 'assistant_message' THEN 'bought ' || k WHEN 'tool_call' THEN NULL ELSE props END AS text,
      CASE WHEN kind IN ('tool_call', 'tool_result') THEN k::VARCHAR END AS tool_call_id, CASE WHEN kind = 'tool_call' THEN tool END AS title, CASE WHEN kind = 'tool_call' THEN tool_kind END AS tool_kind,
      CASE WHEN kind = 'tool_call' THEN 'pending' WHEN event_type = 'error' THEN 'failed' WHEN kind = 'tool_result' THEN 'completed' END AS status FROM e""",
    "acp_loss_totals": f"""WITH {_E}, {_C}, n AS (SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM c WHERE kind <> 'system' AND text <> '') AS cp)
      SELECT 'total_events' AS key, (e + c)::BIGINT AS value FROM n UNION ALL SELECT 'projected_events', e + cp FROM n UNION ALL SELECT 'updates', e + cp FROM n""",
    "acp_loss_events": f"WITH {_C} SELECT CASE WHEN kind = 'system' THEN 'system/message/' || coalesce(role, '') ELSE kind || '_empty' END AS key, count(*) AS value FROM c WHERE kind = 'system' OR coalesce(text, '') = '' GROUP BY ALL",
    "acp_loss_fields": f"WITH {_E} SELECT 'timestamp' AS key, count(*) AS value FROM e UNION ALL SELECT 'user_message.origin', count(*) FROM e WHERE kind = 'user_message' AND k % 5 = 0 UNION ALL SELECT 'assistant_message.model', count(*) FROM e WHERE kind = 'assistant_message' UNION ALL SELECT 'assistant_message.usage', count(*) FROM e WHERE kind = 'assistant_message'",
    "codex_usage_pool": f"""WITH {_E}, f AS (SELECT session_key, seq, kind, lead(seq) OVER (PARTITION BY session_key ORDER BY seq) AS n FROM e WHERE kind <> 'tool_result'),
      o AS (SELECT session_key, seq, n AS close_seq, lag(n) OVER (PARTITION BY session_key ORDER BY seq) AS prev_close FROM f WHERE kind = 'assistant_message')
      SELECT o.session_key, o.seq, o.close_seq, sum(v.k)::BIGINT AS tokens FROM o LEFT JOIN e v ON v.session_key = o.session_key AND v.kind = 'tool_result' AND v.seq > coalesce(prev_close, -1) AND v.seq < coalesce(close_seq, {2**62}) GROUP BY 1, 2, 3""",
    "claude_fold": f"""WITH {_E}, x AS (SELECT session_key, seq, k, k % 3 AS mid, CASE WHEN lag(k % 3) OVER w IS DISTINCT FROM k % 3 THEN 1 ELSE 0 END AS new FROM e WHERE kind = 'tool_result' WINDOW w AS (PARTITION BY session_key ORDER BY seq)),
      y AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY seq)::BIGINT AS island FROM x)
      SELECT session_key, island, mid, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(k, seq) AS usage, count(*) AS n FROM y GROUP BY session_key, island, mid""",
    "resumed_folds": f"""WITH {_E}, x AS (SELECT session_key, seq, k % 3 AS mid, CASE WHEN lag(k % 3) OVER w IS DISTINCT FROM k % 3 THEN 1 ELSE 0 END AS new FROM e WHERE kind = 'tool_result' WINDOW w AS (PARTITION BY session_key ORDER BY seq)),
      y AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY seq)::BIGINT AS island FROM x), z AS (SELECT session_key, mid, island, min(seq) AS seq FROM y GROUP BY ALL)
      SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY session_key, mid ORDER BY island) > 1""",
    "antigravity_fifo": f"""WITH {_E}, x AS (SELECT *, max(CASE WHEN kind = 'assistant_message' THEN seq END) OVER (PARTITION BY session_key ORDER BY seq) AS plan FROM e),
      y AS (SELECT x.session_key, x.seq, x.kind, x.plan, a.k % 4 AS n FROM x LEFT JOIN e a ON a.session_key = x.session_key AND a.seq = x.plan),
      z AS (SELECT *, row_number() OVER (PARTITION BY session_key, plan ORDER BY seq) AS i FROM y WHERE kind = 'tool_result')
      SELECT session_key, seq, CASE WHEN i <= n THEN plan END AS plan_seq, CASE WHEN i <= n THEN i - 1 END AS call_index FROM z""",
    "model_carry_forward": f"WITH {_E} SELECT session_key, seq, last_value(CASE WHEN kind = 'assistant_message' THEN 'm' || (k % 3) END IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model_now FROM e",
    "step_order_sort": f"WITH {_E} SELECT session_key, seq, row_number() OVER (PARTITION BY session_key ORDER BY CASE WHEN kind IN ('tool_call', 'tool_result') THEN k END NULLS LAST, seq) - 1 AS step_ord FROM e",
    "promote_telemetry": f"""WITH {_E}, x AS (SELECT *, kind = 'user_message' AS t, seq + coalesce(sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
      y AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'p' || k ELSE 'web_search_end:L' || (seq + 1) END AS ident, CASE WHEN k % 2 = 0 THEN 'apply_patch' ELSE 'web_search' END AS name FROM x WHERE t)
      SELECT session_key, place::BIGINT AS seq, 'tool_call' AS kind, ident AS tool_call_id, name AS tool, CASE WHEN k % 2 = 0 THEN '{{"n":' || k || '}}' ELSE '{{"q":' || k || '}}' END AS input, NULL::BOOLEAN AS is_error FROM y
      UNION ALL SELECT session_key, place::BIGINT + 1, 'tool_result', ident, name, NULL, k % 2 = 0 AND k % 4 <> 0 FROM y""",
    "validate_events": f"""WITH {_E}, v AS (SELECT session_key, CASE WHEN seq % 11 = 0 THEN 'not exactly one payload' END AS violation FROM e UNION ALL SELECT session_key, CASE WHEN kind = 'tool_call' AND seq % 7 = 0 THEN 'tool call without id' END FROM e)
      SELECT session_key, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL""",
    "line_accounting": f"""WITH {_E}, g AS (SELECT session_key, seq + 1 AS line FROM e WHERE kind <> 'tool_call' UNION SELECT session_key, seq + 2 FROM e WHERE kind = 'tool_result' UNION SELECT session_key, seq + 1 FROM e WHERE kind = 'tool_call' AND seq % 5 = 0)
      SELECT session_key, seq + 1 AS line FROM e WHERE (session_key, seq + 1) NOT IN (SELECT session_key, line FROM g)""",
    "vocab_keys": "SELECT DISTINCT event_type AS record_type, unnest(['type', 'user', 'payload'] || list_transform(json_keys(props), lambda x: 'payload.' || x)) AS value FROM events",
    "vocab_discriminators": "SELECT DISTINCT 'event_msg' AS record_type, 'payload.type' AS path, event_type AS value FROM events",
    "drift_findings": "SELECT 'new_record_type' AS finding, 'click' AS record_type, '' AS value WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'click') UNION ALL SELECT 'new_key', 'view', 'extra' WHERE EXISTS (SELECT 1 FROM events WHERE event_type = 'view') UNION ALL SELECT 'unexercised', 'retired', ''",
    "truncate_payloads": "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN len(text) END AS kept_chars, CASE WHEN strlen(text) > 1000 THEN true END AS truncated, CASE WHEN strlen(text) > 1000 THEN strlen(text) END AS size, CASE WHEN strlen(text) > 1000 THEN sha256(text) END AS digest, coalesce(strlen(text), 0) AS bytes FROM documents",
    "payload_digest": "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations",
    "version_compare": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> o_custkey % 5 THEN o_orderkey % 5 > o_custkey % 5 WHEN o_custkey % 7 <> o_orderkey % 3 THEN o_custkey % 7 > o_orderkey % 3 ELSE false END AS newer FROM orders",
    "session_window_filter": f"""WITH {_E}, s AS (SELECT session_key, CASE WHEN session_key::BIGINT % 3 > 0 THEN min(ts_us) END AS a, max(ts_us) AS b FROM e GROUP BY session_key), q AS (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM e)
      SELECT session_key FROM s, q WHERE greatest(coalesce(a, b), b) >= lo + (hi - lo) // 4 AND coalesce(a, b) <= hi - (hi - lo) // 4""",
    "detect_format": """WITH k AS (SELECT conv_id::VARCHAR AS session_key, arg_min(role, (turn, role, text)) AS role FROM conversations GROUP BY conv_id)
      SELECT session_key, 'codex' AS written_as, 'codex' AS detected, 'certain' AS confidence FROM k UNION ALL SELECT session_key, 'claude-code', 'claude-code', 'certain' FROM k
      UNION ALL SELECT session_key, 'antigravity', 'antigravity', 'certain' FROM k""",
    "parse_roundtrip_codex": f"WITH {_C} " + _RT.format(events="count(*) + 1 + count(*) FILTER (WHERE role = 'assistant')", tokens="sum(len(text)) FILTER (WHERE role = 'assistant')::BIGINT AS input_tokens, sum(seq + 1) FILTER (WHERE role = 'assistant')::BIGINT AS output_tokens"),
    "parse_roundtrip_claude": f"WITH {_C} " + _RT.format(events="count(*) + 1", tokens="sum(len(text)) FILTER (WHERE role = 'assistant')::BIGINT AS input_tokens, sum(seq + 1) FILTER (WHERE role = 'assistant')::BIGINT AS output_tokens"),
    "parse_roundtrip_antigravity": f"WITH {_C} " + _RT.format(events="count(*) + 1", tokens="NULL::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens"),
    "harness_side_by_side": f"""WITH {_S} SELECT CASE WHEN session_key::BIGINT % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS harness, count(*) AS sessions, sum(events)::BIGINT AS events, sum(tool_calls)::BIGINT AS tool_calls, sum(tool_time_ms)::BIGINT AS tool_time_ms,
      sum(coalesce(input_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens FROM w GROUP BY 1""",
    "harness_rollup": f"WITH {_S}, h AS (SELECT *, CASE WHEN session_key::BIGINT % 2 = 0 THEN 'claude-code' ELSE 'codex' END AS harness FROM s) SELECT harness, session_key, sum(events)::BIGINT AS events, sum(input_tokens)::BIGINT AS input_tokens FROM h GROUP BY ROLLUP (harness, session_key)",
    "fetch_compression": "WITH x AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, strlen(regexp_replace(html, '<[^>]*>', '', 'g')) AS c, strlen(html) AS r FROM pages) SELECT host, sum(c)::BIGINT AS content_bytes, sum(r)::BIGINT AS raw_bytes, (sum(c) * 10000 // sum(r))::BIGINT AS per_myriad FROM x GROUP BY host",
    "probe_predicates": f"""WITH {_P}, a AS (SELECT session_key, bool_or(kind = 'assistant_message') AS has_answer FROM e GROUP BY session_key), b AS (SELECT session_key, bool_or(coalesce(tool_kind = 'fetch', false) AND n_results > 0) AS f, count(*) FILTER (WHERE has_call) >= 3 AS t FROM i GROUP BY session_key)
      SELECT session_key, has_answer, coalesce(f, false) AS fetch_answered, coalesce(t, false) AS three_calls FROM a LEFT JOIN b USING (session_key)""",
    "first_claims": "SELECT user_id::VARCHAR AS path, arg_min(event_type, event_id) AS owner FROM events GROUP BY user_id",
    "line_gaps": f"""WITH {_E}, s AS (SELECT session_key, seq + 1 AS line, CASE WHEN kind = 'tool_result' THEN seq + 3 ELSE seq + 1 END AS end_line FROM e WHERE seq % 3 <> 1 AND (kind <> 'tool_call' OR seq % 5 = 0)),
  c AS (SELECT DISTINCT session_key, unnest(range(line, end_line + 1)) AS line FROM s), m AS (SELECT session_key, unnest(range(1, max(end_line) + 1)) AS line FROM s GROUP BY session_key),
  u AS (SELECT session_key, line, line - row_number() OVER (PARTITION BY session_key ORDER BY line) AS run FROM (SELECT * FROM m EXCEPT SELECT * FROM c))
  SELECT session_key, min(line) AS first, max(line) AS last FROM u GROUP BY session_key, run""",
    **native_queries.ORACLES,
    **stream_queries.ORACLES,
}

# How sessions are cut changes no result.
ORACLES |= {f"segmented_{n}": ORACLES[n] for n in ("codex_usage_pool", "claude_fold", "antigravity_fifo", "model_carry_forward")}
