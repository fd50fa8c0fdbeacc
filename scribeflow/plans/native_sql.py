"""What the records of ``native`` should parse to, in SQL over ``events``."""

from __future__ import annotations

from .native import FLAT

_X = """
x AS (
  SELECT user_id::VARCHAR AS session_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, k, props, event_type AS t,
    CASE WHEN k % 13 = 5 THEN 'skip' WHEN k % 17 = 3 THEN 'novel' ELSE event_type END AS r
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
_NONE = "SELECT " + ", ".join(f"NULL::{t} AS {c}" for c, t in FLAT.items()) + " WHERE false"
_OUT = ", ".join(f"coalesce({c}, '') AS {c}" if t == "VARCHAR" else f"coalesce({c}, false) AS {c}" if t == "BOOLEAN" else c for c, t in FLAT.items() if c != "name")
_END = 2**62
#: Events of the CTE ``o`` in order, with the names of results from the calls before them.
_FLAT = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY major, minor, sub) - 1 AS seq FROM o),
flat AS (
  SELECT session_key, seq, kind, ts_us, line, end_line, {_OUT},
    coalesce(CASE WHEN kind = 'tool_result' AND name IS NULL THEN last_value(CASE WHEN kind = 'tool_call' THEN name END IGNORE NULLS) OVER (PARTITION BY session_key, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE name END, '') AS name
  FROM numbered
)"""

_CLAUDE = f"""{_X},
y AS (SELECT *, 1767225600000000 + n * 1000000 AS ts_us, 'u-' || n AS id, 'u-' || (n - 1) AS parent_id, 'm-' || (n // 4) AS mid, 'mo' || (k % 3) AS mo,
  ['Read', 'Glob', 'Grep', 'ToolSearch', 'Bash', 'Edit', 'Write', 'NotebookEdit', 'WebFetch', 'WebSearch', 'TodoWrite', 'mcp__a__b', 'Other'][k % 13 + 1] AS tool FROM x),
z AS (SELECT *, n AS major, 1 AS minor, 0 AS sub, n AS line, n AS end_line FROM y),
folds AS (
  SELECT session_key, mid, min(n) AS n, max(n) AS last, arg_min(mo, n) AS model, arg_min(ts_us, n) AS ts_us, arg_min(id, n) AS id, arg_min(parent_id, n) AS parent_id,
    string_agg(CASE WHEN r = 'purchase' AND k % 4 <> 0 THEN 'bought ' || k END, chr(10) ORDER BY n) AS text, string_agg(CASE WHEN r = 'purchase' AND k % 4 <> 0 THEN 'text' END, ',' ORDER BY n) AS blocks,
    arg_max('end_turn', n) FILTER (WHERE r = 'purchase' AND k % 2 = 1) AS stop_reason, arg_max([k, n, 1, 0], n) FILTER (WHERE r = 'click' OR k % 5 <> 0) AS u
  FROM y WHERE r IN ('click', 'purchase') GROUP BY session_key, mid
),
o AS ({_NONE}
  UNION ALL BY NAME SELECT session_key, min(n) AS major, 0 AS minor, 0 AS sub, 'session_meta' AS kind, arg_min(ts_us, n) AS ts_us, min(n) AS line, min(n) AS end_line, session_key || '|/w/' || session_key || '|main|2.1.200|claude-code' AS text FROM y WHERE r NOT IN ('skip', 'novel') GROUP BY session_key
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, 'unknown' AS kind, 'novel' AS record_type FROM z WHERE r = 'novel'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, 'user_message' AS kind, CASE WHEN k % 5 = 0 THEN 'harness' ELSE 'human' END AS origin,
    CASE WHEN k % 3 < 2 THEN props END AS text, ['text,image', 'text', ''][k % 3 + 1] AS blocks FROM z WHERE r = 'signup'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, mid AS message_id, 'thinking' AS kind, 'think ' || k AS text, 's' || k AS signature FROM z WHERE r = 'click' AND k % 2 = 0
  UNION ALL BY NAME SELECT session_key, major, minor, 1 AS sub, line, end_line, ts_us, id, parent_id, mid AS message_id, 'tool_call' AS kind, 'c' || k AS call_id, tool AS name, props AS input,
    CASE WHEN tool = 'Read' THEN 'read' WHEN tool IN ('Glob', 'Grep', 'ToolSearch') THEN 'search' WHEN tool = 'Bash' THEN 'execute' WHEN tool IN ('Edit', 'Write', 'NotebookEdit') THEN 'edit' WHEN tool IN ('WebFetch', 'WebSearch') THEN 'fetch' WHEN tool = 'TodoWrite' THEN 'think' ELSE 'other' END AS tool_kind FROM z WHERE r = 'click'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, mid AS message_id, 'system' AS kind, 'assistant/fallback' AS subtype FROM z WHERE r = 'purchase' AND k % 6 = 0
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, 'tool_result' AS kind, 'c' || k AS call_id, props AS text, CASE WHEN k % 2 = 0 THEN 'text' ELSE 'text,image' END AS blocks,
    CASE WHEN k % 3 = 0 THEN 'http://h/' || k END AS fetch_url, CASE WHEN k % 3 = 0 THEN nullif(k * 10, 0) END AS fetch_bytes, CASE WHEN k % 3 = 0 THEN 200 END AS fetch_status, CASE WHEN k % 3 = 0 THEN nullif(k, 0) END AS fetch_ms FROM z WHERE r = 'view'
  UNION ALL BY NAME SELECT session_key, major, minor, 1 AS sub, line, end_line, ts_us, id, parent_id, 'user_message' AS kind, 'human' AS origin, 'note' AS text, 'text' AS blocks FROM z WHERE r = 'view' AND k % 7 = 0
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, 'tool_result' AS kind, 'c' || k AS call_id, true AS is_error, 'failed' AS text, 'text' AS blocks FROM z WHERE r = 'error' AND k % 4 = 1
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, id, parent_id, 'system' AS kind, CASE k % 4 WHEN 0 THEN 'api_error' WHEN 2 THEN 'attachment/file' ELSE 'note' END AS subtype, CASE k % 4 WHEN 0 THEN 'error' WHEN 3 THEN 'warn' END AS level,
    CASE k % 4 WHEN 0 THEN 'boom ' WHEN 2 THEN 'att ' ELSE 'sys ' END || k AS text FROM z WHERE r = 'error' AND k % 4 <> 1
  UNION ALL BY NAME SELECT session_key, coalesce(lead(n) OVER (PARTITION BY session_key ORDER BY n), {_END}) AS major, 0 AS minor, 1 AS sub, n AS line, last AS end_line, ts_us, id, parent_id, mid AS message_id, 'assistant_message' AS kind, model, stop_reason, text, blocks,
    u[1] AS input_tokens, u[2] AS output_tokens, u[3] AS cache_read, u[4] AS cache_new FROM folds
),{_FLAT}"""

_CODEX = f"""{_X},
z AS (SELECT *, 1767225600000000 + n * 1000000 AS ts_us, n + 1 AS major, 1 AS minor, 0 AS sub, n + 1 AS line, n + 1 AS end_line, ['exec', 'shell', 'exec_command', 'unified_exec', 'apply_patch', 'update_plan', 'view_image', 'read_thread_terminal', 'other'][k % 9 + 1] AS tool FROM x),
shut AS (SELECT session_key, line, r, k, ts_us, lead(line) OVER (PARTITION BY session_key ORDER BY line) AS close FROM z WHERE r IN ('signup', 'click', 'purchase') OR r = 'view' AND k % 3 < 2 OR r = 'error' AND k % 4 < 2),
opened AS (SELECT *, lag(close) OVER (PARTITION BY session_key ORDER BY line) AS before FROM shut WHERE r = 'purchase'),
pools AS (
  SELECT a.session_key, a.line, sum(v.k)::BIGINT AS input_tokens, 2 * count(*) AS output_tokens, count(*) AS cache_read, 0 AS cache_new
  FROM opened a JOIN z v ON v.session_key = a.session_key AND v.r = 'view' AND v.k % 3 = 2 AND v.line > coalesce(a.before, 0) AND v.line < coalesce(a.close, {_END}) GROUP BY a.session_key, a.line
),
models AS (SELECT a.session_key, a.line, arg_max('mo' || (m.k % 3), m.line) AS model FROM opened a JOIN z m ON m.session_key = a.session_key AND m.r = 'error' AND m.k % 4 = 2 AND m.line < a.line GROUP BY a.session_key, a.line),
calls AS (SELECT *, CASE k % 4 WHEN 2 THEN 'local_shell' WHEN 3 THEN 'web_search' ELSE tool END AS name, CASE WHEN k % 4 < 3 THEN 'c' || k WHEN k % 8 = 3 THEN 'web_search_call:L' || line ELSE 'w' || k END AS call_id FROM z WHERE r = 'click'),
o AS ({_NONE}
  UNION ALL BY NAME SELECT DISTINCT session_key, 1 AS major, 0 AS minor, 0 AS sub, 1 AS line, 1 AS end_line, 1767225600000000 AS ts_us, 'session_meta' AS kind, session_key || '|/w/' || session_key || '|main|0.144.1|codex' AS text FROM z
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, 'unknown' AS kind, 'novel' AS record_type FROM z WHERE r = 'novel'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, CASE WHEN k % 5 = 1 THEN 'system' ELSE 'user_message' END AS kind, CASE k % 5 WHEN 0 THEN 'harness' WHEN 1 THEN NULL ELSE 'human' END AS origin, CASE WHEN k % 5 = 1 THEN 'message/developer' END AS subtype,
    CASE WHEN k % 5 = 0 THEN '<environment_context>' ELSE '' END || props AS text, CASE WHEN k % 5 = 1 THEN '' WHEN k % 3 = 0 THEN 'text,image' ELSE 'text' END AS blocks FROM z WHERE r = 'signup'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'tool_call' AS kind, call_id, name, CASE k % 4 WHEN 1 THEN '"raw ' || k || '"' WHEN 2 THEN '{{"k":' || k || '}}' ELSE props END AS input,
    CASE WHEN name IN ('exec', 'shell', 'exec_command', 'unified_exec', 'local_shell') THEN 'execute' WHEN name = 'apply_patch' THEN 'edit' WHEN name = 'update_plan' THEN 'think' WHEN name IN ('view_image', 'read_thread_terminal') THEN 'read' WHEN name = 'web_search' THEN 'fetch' ELSE 'other' END AS tool_kind FROM calls
  UNION ALL BY NAME SELECT session_key, major, minor, 1 AS sub, line, end_line, ts_us, 'tool_result' AS kind, call_id, name, k % 3 = 0 AS is_error FROM calls WHERE k % 4 = 3
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'tool_result' AS kind, 'c' || k AS call_id, CASE WHEN k % 3 = 0 THEN props ELSE 'out ' || k END AS text, 'text' AS blocks FROM z WHERE r = 'view' AND k % 3 < 2
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, 'token_count' AS subtype FROM z WHERE r = 'view' AND k % 3 = 2
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'tool_result' AS kind, 'c' || k AS call_id, k // 4 % 2 = 1 AS is_error, '{{"metadata":{{"exit_code":' || (k // 4 % 2) || '}}}}' AS text, 'text' AS blocks FROM z WHERE r = 'error' AND k % 4 = 0
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'thinking' AS kind, 'why ' || k AS text, 's' || k AS signature FROM z WHERE r = 'error' AND k % 4 = 1
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, 'turn_context' AS subtype FROM z WHERE r = 'error' AND k % 4 = 2
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, 'error' AS subtype, 'error' AS level, 'boom ' || k AS text FROM z WHERE r = 'error' AND k % 4 = 3
  UNION ALL BY NAME SELECT session_key, coalesce(close, {_END}) AS major, 0 AS minor, 1 AS sub, line, line AS end_line, ts_us, 'assistant_message' AS kind, model, 'bought ' || k AS text, 'text' AS blocks, input_tokens, output_tokens, cache_read, cache_new
    FROM opened LEFT JOIN pools USING (session_key, line) LEFT JOIN models USING (session_key, line)
),{_FLAT}"""

_NAMES = "['run_command', 'write_to_file', 'view_file', 'list_dir', 'grep_search', 'search_web', 'read_url_content', 'other']"
_ANTIGRAVITY = f"""{_X},
s AS (SELECT *, n - k % 3 AS step, row_number() OVER (PARTITION BY session_key ORDER BY n - k % 3, n) AS ord FROM x),
z AS (SELECT *, 1767225600000000 + n * 1000000 AS ts_us, ord AS major, 1 AS minor, 0 AS sub, n AS line, n AS end_line, 'step-' || step AS mid,
  max(CASE WHEN r IN ('click', 'purchase') THEN ord END) OVER (PARTITION BY session_key ORDER BY ord) AS plan, r = 'view' OR r = 'error' AND k % 4 IN (0, 2) AS takes,
  last_value(CASE WHEN r = 'signup' AND k % 3 = 2 THEN 'M' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY session_key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model_now FROM s),
w AS (SELECT z.*, p.step AS p_step, p.k AS p_k, CASE WHEN p.r = 'click' THEN p.k % 3 + 1 ELSE 0 END AS p_n, row_number() OVER (PARTITION BY z.session_key, z.plan ORDER BY z.ord) - 1 AS i FROM z LEFT JOIN s p ON p.session_key = z.session_key AND p.ord = z.plan WHERE z.takes),
res AS (SELECT *, i < p_n AS matched FROM w),
o AS ({_NONE}
  UNION ALL BY NAME SELECT session_key, major, 0 AS minor, sub, line, end_line, ts_us, 'session_meta' AS kind, 'antigravity' AS text FROM z WHERE ord = 1
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, 'unknown' AS kind, 'NOVEL' AS record_type FROM z WHERE r = 'novel'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, 'conversation_history' AS subtype FROM z WHERE r = 'skip'
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'user_message' AS kind, 'human' AS origin, CASE WHEN k % 3 = 1 THEN props ELSE 'ask ' || k END AS text, 'text' AS blocks FROM z WHERE r = 'signup'
  UNION ALL BY NAME SELECT session_key, major, minor, 1 AS sub, line, end_line, ts_us, 'system' AS kind, 'user_input_context' AS subtype, CASE WHEN k % 3 = 0 THEN 'rest ' || k ELSE '`Model Selection` from None to M' || (k % 4) || '. Done' END AS text FROM z WHERE r = 'signup' AND k % 3 <> 1
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, mid AS message_id, 'thinking' AS kind, 'think ' || k AS text FROM z WHERE r = 'click' AND k % 2 = 1
  UNION ALL BY NAME SELECT session_key, major, minor, 1 AS sub, line, end_line, ts_us, mid AS message_id, 'assistant_message' AS kind, model_now AS model, CASE WHEN r = 'purchase' THEN 'bought ' || k END AS text, CASE WHEN r = 'purchase' THEN 'text' END AS blocks FROM z WHERE r IN ('click', 'purchase')
  UNION ALL BY NAME SELECT session_key, major, minor, 2 + i AS sub, line, end_line, ts_us, mid AS message_id, 'tool_call' AS kind, mid || ':call-' || i AS call_id, {_NAMES}[(k + i) % 8 + 1] AS name, props AS input,
    ['execute', 'edit', 'read', 'read', 'search', 'fetch', 'fetch', 'other'][(k + i) % 8 + 1] AS tool_kind FROM z, (SELECT unnest([0, 1, 2]) AS i) WHERE r = 'click' AND i <= k % 3
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'tool_result' AS kind, CASE WHEN matched THEN 'step-' || p_step || ':call-' || i ELSE mid || ':orphan' END AS call_id, CASE WHEN matched THEN {_NAMES}[(p_k + i) % 8 + 1] ELSE '' END AS name,
    r = 'error' AND k % 4 = 2 AS is_error, CASE WHEN r = 'view' THEN props WHEN k % 4 = 0 THEN 'gen ' || k END AS text, 'text' AS blocks FROM res WHERE matched OR r = 'view' OR k % 4 = 2
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, 'generic' AS subtype, 'gen ' || k AS text FROM res WHERE NOT matched AND r = 'error' AND k % 4 = 0
  UNION ALL BY NAME SELECT session_key, major, minor, sub, line, end_line, ts_us, 'system' AS kind, CASE k % 4 WHEN 1 THEN 'error_message' ELSE 'checkpoint' END AS subtype, CASE WHEN k % 4 = 1 THEN 'error' END AS level, CASE k % 4 WHEN 1 THEN 'boom ' ELSE 'cp ' END || k AS text FROM z WHERE r = 'error' AND k % 4 IN (1, 3)
),{_FLAT}"""

WITH = {"claude-code": _CLAUDE, "codex": _CODEX, "antigravity": _ANTIGRAVITY}
X = _X
