"""DuckDB SQL of the queries over telemetry, from the tables alone."""

from __future__ import annotations

from .functions.pricing import ESTIMATED
from .oracle import _EV, _MASKS, _RAW, _UNGUARDED, _guard, _masked
from .oracle import SQL as _CORE

_SRC = """src0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
  src AS (SELECT *, 'w' || substr('abcdefg', CAST(k % 7 + 1 AS INT), 1) AS word, 1000 + 10 * n AS sec FROM src0)"""


def _hash(text: str) -> str:
    return f"substr(sha256({text}), 1, 16)"


_QUERY = """'{"q":"' || word || '"}'"""
#: Models of events without one, from the nearest model call by place.
_FILLED = """marked AS (SELECT *, max(CASE WHEN event_type = 'llm_call' THEN step_index END) OVER (PARTITION BY task_id ORDER BY step_index) AS p,
    min(CASE WHEN event_type = 'llm_call' THEN step_index END) OVER (PARTITION BY task_id ORDER BY step_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM seq),
  chosen AS (SELECT *, CASE WHEN event_type = 'llm_call' OR model IS NOT NULL THEN NULL WHEN p IS NOT NULL AND (f IS NULL OR step_index - p <= f - step_index) THEN p ELSE f END AS near FROM marked),
  filled AS (SELECT c.* REPLACE (coalesce(c.model, l.model) AS model), CASE WHEN c.near IS NOT NULL AND l.model IS NOT NULL THEN CASE WHEN c.near < c.step_index THEN 'preceding_llm_call' ELSE 'following_llm_call' END END AS model_basis
    FROM chosen c LEFT JOIN seq l ON l.task_id = c.task_id AND l.step_index = c.near)"""
_BASE = 'task_id, step_index, event_type, name, outcome, "at", usd, model, parent_id, workflow, tokens_in, tokens_out'

_OPENINFERENCE = f"""WITH {_SRC}, parts AS (
    SELECT user_id, n, 0 AS sub, 'llm_call' AS event_type, coalesce(CASE WHEN k % 7 > 0 THEN 'm' || (k % 3) END, 'call') AS name, {_hash("word")} AS hash, k * 10 AS tokens_in, CASE WHEN k % 3 > 0 THEN k END AS tokens_out, CASE WHEN k % 5 = 0 THEN 'error' END AS outcome, sec * 1000 AS at,
      CASE WHEN k % 4 > 0 THEN value / 1000 WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 1 THEN k * 10 * 0.001 + k * 0.002 WHEN k % 3 = 2 THEN k * 10 * 0.003 + k * 0.004 END AS cost, CASE WHEN k % 7 > 0 THEN 'm' || (k % 3) END AS model,
      CASE WHEN k % 4 = 0 AND k % 7 > 0 AND k % 3 > 0 THEN '{ESTIMATED}' END AS cost_basis FROM src WHERE event_type = 'view'
    UNION ALL SELECT user_id, n, 0, 'tool_call', event_type, {_hash("word")}, NULL, NULL, NULL, sec * 1000, NULL, NULL, NULL FROM src WHERE event_type IN ('click', 'purchase')
    UNION ALL SELECT user_id, n, 1, 'tool_result', event_type, {_hash("'r' || word")}, NULL, NULL, CASE WHEN k % 5 = 0 THEN 'error' END, (sec + 5) * 1000, NULL, NULL, NULL FROM src WHERE event_type IN ('click', 'purchase') AND k % 2 = 0),
  numbered AS (SELECT *, row_number() OVER w - 1 AS step_index, max(event_type = 'llm_call') OVER (PARTITION BY user_id ORDER BY n, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called FROM parts WINDOW w AS (PARTITION BY user_id ORDER BY n, sub)),
  seq AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'u' ELSE 't' END || user_id AS task_id, round(CAST(cost AS DOUBLE), 6) AS usd, 'w' || (user_id % 4) AS workflow, CASE WHEN user_id % 3 = 0 THEN 'conversation_id' ELSE 'trace_id_fallback' END AS task_source,
    CASE event_type WHEN 'tool_call' THEN CASE WHEN called THEN step_index - 1 END WHEN 'tool_result' THEN step_index - 1 END AS parent_id FROM numbered), {_FILLED}
  SELECT {_BASE}, hash, cost_basis, model_basis, task_source FROM filled"""

_CODING_CLI = f"""WITH {_SRC}, parts AS (
    SELECT user_id, n, 0 AS late, 0 AS sub, 'llm_call' AS event_type, 'm' || (k % 3) AS name, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY n) = 1 THEN {_hash("'fix it please'")} END AS hash, k + k % 5 AS tokens_in, 2 * k AS tokens_out,
      CASE WHEN k % 9 > 0 THEN 'ok' ELSE 'error' END AS outcome, sec * 1000 AS at, CASE WHEN k % 2 = 0 THEN value / 1000 END AS cost, 'm' || (k % 3) AS model, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY n) = 1 THEN 'prompt' ELSE 'opaque' END AS basis FROM src WHERE event_type = 'view'
    UNION ALL SELECT user_id, n, 0, 0, 'tool_call', event_type, CASE WHEN k % 13 > 0 AND k % 11 > 0 THEN {_hash(_QUERY)} ELSE {_hash("'{" + '"file_path":"' + "' || word || '" + '"}' + "'")} END, NULL, NULL, NULL, sec * 1000, NULL, NULL, 'tool_input' FROM src WHERE event_type IN ('click', 'purchase')
    UNION ALL SELECT user_id, n, 0, 1, 'tool_result', event_type, CASE WHEN k % 2 = 0 THEN {_hash("'ok ' || word")} END, NULL, NULL, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'error' END WHEN k % 3 = 1 AND k % 5 = 0 THEN 'error' END, (sec + 5) * 1000, NULL, NULL,
      CASE WHEN k % 2 = 0 THEN 'prompt' ELSE 'opaque' END FROM src WHERE event_type IN ('click', 'purchase') AND (k % 2 = 0 OR k % 3 = 0 OR (k % 3 = 1 AND k % 5 = 0))
    UNION ALL SELECT user_id, n, 1, 0, 'llm_call', 'ms', NULL, k, 1, NULL, sec * 1000, value / 1000, 'ms', 'log_only_no_span' FROM src WHERE event_type = 'signup'),
  seq AS (SELECT *, 'u' || user_id AS task_id, row_number() OVER w - 1 AS step_index, round(CAST(cost AS DOUBLE), 6) AS usd, 'main' AS workflow, 'session_id' AS task_source, CASE WHEN late = 1 THEN true END AS billing_only,
    CASE WHEN late = 0 AND row_number() OVER w > 1 THEN row_number() OVER w - 2 END AS parent_id FROM parts WINDOW w AS (PARTITION BY user_id ORDER BY late, n, sub)), {_FILLED}
  SELECT {_BASE}, hash, basis, model_basis, task_source, billing_only FROM filled"""

_COWORK = f"""WITH {_SRC}, prompts AS (SELECT user_id, k % 3 AS p, arg_min(word || ' please', n) AS prompt FROM src WHERE event_type = 'signup' AND k % 5 > 0 GROUP BY 1, 2),
  calls AS (SELECT *, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY n) = 1 AS claims FROM src WHERE event_type IN ('view', 'error')),
  parts AS (
    SELECT c.user_id, n, 'llm_call' AS event_type, CASE c.event_type WHEN 'view' THEN 'm' || (k % 3) ELSE 'me' END AS name, CASE WHEN claims THEN {_hash("prompt")} END AS hash, CASE WHEN c.event_type = 'view' THEN k + k % 5 END AS tokens_in, CASE WHEN c.event_type = 'view' THEN 2 * k END AS tokens_out,
      CASE c.event_type WHEN 'view' THEN 'ok' ELSE 'error' END AS outcome, CASE WHEN c.event_type = 'view' AND k % 4 > 0 THEN value / 1000 END AS cost, CASE c.event_type WHEN 'view' THEN 'm' || (k % 3) ELSE 'me' END AS model, CASE WHEN claims AND prompt IS NOT NULL THEN 'prompt' ELSE 'opaque' END AS basis,
      CASE WHEN c.event_type = 'view' AND k % 4 = 0 THEN {_hash("'said ' || word")} END AS response, sec FROM calls c LEFT JOIN prompts q ON q.user_id = c.user_id AND q.p = k % 3
    UNION ALL SELECT user_id, n, 'tool_call', CASE WHEN k % 5 = 0 THEN 'mcp__srv__x' ELSE 'run' END, CASE WHEN k % 2 = 0 THEN {_hash(_QUERY)} END, NULL, NULL, CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' END, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'tool_input' ELSE 'opaque' END, NULL, sec FROM src WHERE event_type = 'click'
    UNION ALL SELECT user_id, n, 'tool_call', 'buy', NULL, NULL, NULL, 'error', NULL, NULL, 'opaque', NULL, sec FROM src WHERE event_type = 'purchase' AND k % 2 = 0)
  SELECT 'u' || user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS step_index, event_type, name, outcome, sec * 1000 AS at, round(CAST(cost AS DOUBLE), 6) AS usd, model, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS VARCHAR) AS workflow, tokens_in, tokens_out, hash, basis, response FROM parts"""

_OPENCLAW = f"""WITH {_SRC}, parts AS (
    SELECT user_id, n, 0 AS sub, 'llm_call' AS event_type, 'm' || (k % 3) AS name, CASE WHEN k % 2 = 0 THEN {_hash("'[" + '"' + "' || word || '" + '"]' + "'")} END AS hash, k + k % 5 AS tokens_in, CASE WHEN k % 3 > 0 THEN k END AS tokens_out, CASE WHEN k % 9 = 0 THEN 'error' ELSE 'ok' END AS outcome, sec * 1000 AS at,
      'm' || (k % 3) AS model, CASE WHEN k % 2 = 0 THEN 'prompt' ELSE 'opaque' END AS basis, CASE WHEN k % 4 = 0 THEN {_hash("'[" + '"said ' + "' || word || '" + '"]' + "'")} END AS response FROM src WHERE event_type = 'view'
    UNION ALL SELECT user_id, n, 0, 'tool_call', 'run', CASE WHEN k % 2 = 0 THEN {_hash(_QUERY)} END, NULL, NULL, CASE WHEN k % 10 = 0 THEN 'error' END, sec * 1000, NULL, CASE WHEN k % 2 = 0 THEN 'prompt' ELSE 'opaque' END, NULL FROM src WHERE event_type = 'click'
    UNION ALL SELECT user_id, n, 1, 'tool_result', 'run', {_hash("'{" + '"r":"' + "' || word || '" + '"}' + "'")}, NULL, NULL, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END, (sec + 5) * 1000, NULL, 'prompt', NULL FROM src WHERE event_type = 'click' AND k % 3 = 0),
  sized AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, sub) - 1 AS step_index, coalesce(tokens_in, 0) + coalesce(tokens_out, 0) AS tokens FROM parts),
  shared AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id % 2, model) AS every, count(*) OVER (PARTITION BY user_id % 2, model) AS calls FROM sized)
  SELECT 't' || user_id AS task_id, step_index, event_type, name, outcome, "at", CASE WHEN model IS NOT NULL THEN floor(CASE WHEN every > 0 THEN CAST(1000 AS DOUBLE) * tokens / every ELSE CAST(1000 AS DOUBLE) / calls END * 1e6 + 0.5) / 1e6 END AS usd, model, CASE WHEN sub = 1 THEN step_index - 1 END AS parent_id, 'bot' || (user_id % 4) AS workflow,
    tokens_in, tokens_out, hash, basis, CASE WHEN model IS NULL THEN NULL WHEN every > 0 THEN 'apportioned_from_metrics_by_tokens' ELSE 'apportioned_from_metrics_equal_split' END AS cost_basis, response FROM shared"""

_LOCALTRACE = f"""WITH {_SRC}, parts AS (
    SELECT user_id, n, 0 AS sub, 'llm_call' AS event_type, 'm' || (k % 3) AS name, CASE WHEN k % 2 = 0 THEN {_hash("'[" + '"' + "' || word || '" + '"]' + "'")} END AS hash, CASE WHEN k % 2 = 0 THEN k END AS tokens_in, CASE WHEN k % 9 = 0 THEN 'error' ELSE 'ok' END AS outcome, sec * 1000 AS at,
      CASE WHEN k % 4 = 0 THEN value / 1000 END AS cost, 'm' || (k % 3) AS model, CASE WHEN k % 2 = 0 THEN 'prompt' ELSE 'opaque' END AS basis, NULL AS write FROM src WHERE event_type = 'view'
    UNION ALL SELECT user_id, n, 0, 'tool_call', 'run', CASE WHEN k % 2 = 0 THEN {_hash(_QUERY)} END, NULL, CASE WHEN k % 10 = 0 THEN 'error' END, sec * 1000, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'prompt' ELSE 'opaque' END, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END FROM src WHERE event_type = 'click'
    UNION ALL SELECT user_id, n, 1, 'tool_result', 'run', {_hash("'{" + '"r":"' + "' || word || '" + '"}' + "'")}, NULL, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END, (sec + 5) * 1000, NULL, NULL, 'prompt', NULL FROM src WHERE event_type = 'click' AND k % 5 = 0),
  sized AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, sub) - 1 AS step_index, event_type = 'llm_call' AND cost IS NULL AND user_id % 3 > 0 AS open FROM parts),
  shared AS (SELECT *, sum(coalesce(tokens_in, 0)) OVER (PARTITION BY user_id, open) AS every, count(*) OVER (PARTITION BY user_id, open) AS calls FROM sized),
  seq AS (SELECT *, CASE WHEN user_id % 3 > 0 THEN 'u' ELSE 't' END || user_id AS task_id, round(CASE WHEN open THEN CASE WHEN every > 0 THEN CAST(5 AS DOUBLE) * coalesce(tokens_in, 0) / every ELSE CAST(5 AS DOUBLE) / calls END ELSE cost END, 6) AS usd, CAST(NULL AS BIGINT) AS parent_id, 'bot' || (user_id % 4) AS workflow, CAST(NULL AS BIGINT) AS tokens_out,
    CASE WHEN open THEN CASE WHEN every > 0 THEN 'apportioned_from_metrics_by_tokens' ELSE 'apportioned_from_metrics_equal_split' END WHEN cost IS NOT NULL THEN '{ESTIMATED}' END AS cost_basis, CASE WHEN user_id % 3 > 0 THEN 'conversation_id' ELSE 'trace_id_fallback' END AS task_source FROM shared), {_FILLED}
  SELECT {_BASE}, hash, basis, cost_basis, model_basis, task_source, write FROM filled"""

_TURNS = "c AS (SELECT conv_id, turn, role, to_json(coalesce(text, '')) AS said, 'w' || substr('abcdefg', CAST(conv_id % 7 + 1 AS INT), 1) AS word, conv_id % 5 = 0 AS bad, 'm' || (conv_id % 3) AS model FROM conversations)"
#: Prices of the two models that have one, by tokens: input, output, cache reads and writes.
_ESTIMATE = "CASE conv_id % 3 WHEN 1 THEN turn * 7 * 0.001 + {out} * 0.002 WHEN 2 THEN turn * 7 * 0.003 + {out} * 0.004 + 2 * 0.0005{more} END"

def _request_hashes(source: str) -> str:
    """CTE bodies up to hashed (conv_id, turn, what, hash): the hashes of texts (conv_id, turn, what, s), volatile spans masked."""
    steps, last, _ = _masked(f"SELECT conv_id, turn, what, {_guard('s')} AS s, 0 AS n FROM ({source})", _MASKS)
    return f"{', '.join(steps)}, hashed AS (SELECT conv_id, turn, what, substr(sha256({_UNGUARDED}), 1, 16) AS hash FROM {last})"


_ASSISTANTS = "(SELECT conv_id, turn AS call FROM c WHERE role = 'assistant') a"
_GREP = """'{"input":{"q":"' || word || '"},"output":"' || CASE WHEN bad THEN 'bad ' ELSE 'ok ' END || word || '","status":"' || CASE WHEN bad THEN 'error' ELSE 'completed' END || '","tool":"grep","type":"tool"}'"""
_OPENCODE_TEXTS = f"""placed AS (SELECT *, conv_id % 5 = 2 AND turn IN (2, 3) AND role = 'user' AND coalesce(lead(role) OVER w = 'assistant', false) AS asks FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  cut AS (SELECT conv_id, max(turn) AS asked FROM placed WHERE asks GROUP BY conv_id),
  m AS (SELECT conv_id, turn, '{{"text":' || said || ',"type":"text"}}' || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN ',' || {_GREP} ELSE '' END || CASE WHEN asks AND conv_id % 2 = 0 THEN ',{{"tail_start_id":"' || {{tail}} || '","type":"compaction"}}' WHEN asks THEN ',{{"type":"compaction"}}' ELSE '' END AS parts, role FROM placed),
  -- After a compaction: what asked for it, its summary, the tail that is kept, and what comes later.
  sent AS (SELECT conv_id, call, '{{"parts":[' || parts || '],"role":"' || role || '"}}' AS text, CASE WHEN call > asked + 1 AND turn IN (asked, asked + 1) THEN turn - 1000 ELSE turn END AS place
    FROM {_ASSISTANTS} JOIN m USING (conv_id) LEFT JOIN cut USING (conv_id) WHERE turn < call AND (asked IS NULL OR call <= asked + 1 OR turn >= asked OR (conv_id % 2 = 0 AND turn >= 1)))"""
_OPENCODE_HASHED = _request_hashes(
    """SELECT conv_id, call AS turn, 'request' AS what, '[' || string_agg(text, ',' ORDER BY place) || ']' AS s FROM sent GROUP BY ALL
    UNION ALL SELECT conv_id, turn, 'reply', '{"parts":[' || parts || '],"reason":null}' FROM m WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'request', '[]' FROM c WHERE role = 'assistant' AND turn = 0"""
)
_OPENCODE = f"""WITH {_TURNS}, {_OPENCODE_TEXTS},
  {_OPENCODE_HASHED},
  parts AS (
    SELECT conv_id, turn, 0 AS sub, 'llm_call' AS event_type, model AS name, r.hash, CASE WHEN conv_id % 6 <> 5 THEN p.hash END AS response, turn * 7 + 5 AS tokens_in, turn + 1 AS tokens_out, 'ok' AS outcome, CASE WHEN turn % 4 = 1 THEN 0.25 ELSE {_ESTIMATE.format(out="(turn + 1)", more=" + 3 * 0.25")} END AS cost,
      CASE WHEN turn % 4 <> 1 AND conv_id % 3 > 0 THEN '{ESTIMATED}' END AS cost_basis, CASE WHEN conv_id % 6 = 5 THEN 'opaque' ELSE 'prompt' END AS basis, CAST(NULL AS VARCHAR) AS model_basis, model FROM c LEFT JOIN hashed r USING (conv_id, turn) LEFT JOIN hashed p USING (conv_id, turn) WHERE role = 'assistant' AND r.what = 'request' AND p.what = 'reply'
    UNION ALL SELECT conv_id, turn, 1, 'tool_call', 'grep', {_hash(_QUERY)}, NULL, NULL, NULL, NULL, NULL, NULL, 'tool_input', 'issuing_llm_call', model FROM c WHERE role = 'assistant' AND turn % 4 = 1
    UNION ALL SELECT conv_id, turn, 2, 'tool_result', 'grep', {_hash("CASE WHEN bad THEN 'bad ' ELSE 'ok ' END || word")}, NULL, NULL, NULL, CASE WHEN bad THEN 'error' ELSE 'ok' END, NULL, NULL, 'tool_output', 'issuing_llm_call', model FROM c WHERE role = 'assistant' AND turn % 4 = 1)
  SELECT 'ses' || conv_id AS task_id, row_number() OVER w - 1 AS step_index, event_type, name, outcome, turn * 1000 AS at, round(CAST(cost AS DOUBLE), 6) AS usd, model, CASE WHEN row_number() OVER w > 1 THEN row_number() OVER w - 2 END AS parent_id, 'a' || (conv_id % 2) AS workflow, tokens_in, tokens_out, CASE WHEN basis <> 'opaque' THEN hash END AS hash, basis, cost_basis, model_basis, response,
    CASE WHEN conv_id % 4 = 1 THEN 'ses' || (conv_id - 1) END AS parent_task, CASE WHEN conv_id % 4 = 1 THEN 'delegation' END AS link FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY turn, sub)"""

_OPENCODE_EXPORTED = _OPENCODE.replace("{tail}", "'m001'")

_PI_TEXTS = """m AS (SELECT conv_id, turn, 0 AS p, '{"content":' || CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN '{e1}' ELSE '{own}' END || ',"role":"' || role || '"}' AS text, '[{"text":' || said || ',"type":"text"}' || CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN ',{"arguments":{"q":"' || word || '"},"name":"grep","type":"toolCall"}' ELSE '' END || ']' AS own, role FROM c
    UNION ALL SELECT conv_id, turn, 1, '{"content":[{"text":"ok ' || word || '","type":"text"}],"isError":' || bad || ',"role":"toolResult","toolName":"grep"}', NULL, NULL FROM c WHERE role = 'assistant' AND turn % 4 = 1 AND conv_id % 2 = 0
    UNION ALL SELECT conv_id, 4, -1, '{"role":"branchSummary","summary":"left behind"}', NULL, NULL FROM c WHERE conv_id % 5 = 3 AND turn = 4
    UNION ALL SELECT conv_id, -1, 0, '{"role":"compactionSummary","summary":"so far"}', NULL, NULL FROM c WHERE conv_id % 5 = 1 AND turn = 3),
  sent AS (SELECT conv_id, call, turn, p, CASE WHEN own IS NULL THEN text ELSE replace(replace(text, '{e1}', CASE WHEN call > 2 THEN '"cut"' ELSE own END), '{own}', own) END AS text
    FROM (SELECT conv_id, turn AS call FROM c WHERE role = 'assistant') a JOIN m USING (conv_id) WHERE (turn < call OR (turn = call AND p = -1))
      AND CASE conv_id % 5 WHEN 1 THEN CASE WHEN call > 3 THEN turn = -1 OR turn >= 2 ELSE turn >= 0 END WHEN 2 THEN NOT (call > 2 AND turn = 1 AND p = 0 AND conv_id % 2 = 1) WHEN 3 THEN call < 4 OR turn <= 1 OR turn >= 4 ELSE true END)"""
_RESULT = """'[{"text":"ok ' || word || '","type":"text"}]'"""
_PI_HASHED = _request_hashes(
    """SELECT conv_id, call AS turn, 'request' AS what, '[' || string_agg(text, ',' ORDER BY turn, p) || ']' AS s FROM sent GROUP BY ALL
    UNION ALL SELECT conv_id, turn, 'reply', '{"content":' || own || ',"errorMessage":null,"stopReason":null}' FROM m WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 'request', '[]' FROM c WHERE role = 'assistant' AND turn = 0"""
)
_PI = f"""WITH {_TURNS}, {_PI_TEXTS},
  {_PI_HASHED},
  kept AS (SELECT * FROM c WHERE conv_id % 4 <> 1 OR turn > 0), parts AS (
    SELECT conv_id, turn, 0 AS sub, 'llm_call' AS event_type, model AS name, r.hash, p.hash AS response, turn * 7 + 2 AS tokens_in, turn AS tokens_out, 'ok' AS outcome, turn * 60000 AS at, CASE WHEN turn % 4 = 3 THEN 0.25 ELSE {_ESTIMATE.format(out="turn", more="")} END AS cost,
      CASE WHEN turn % 4 <> 3 AND conv_id % 3 > 0 THEN '{ESTIMATED}' END AS cost_basis, 'prompt' AS basis, CAST(NULL AS VARCHAR) AS model_basis, model, false AS billed FROM kept LEFT JOIN hashed r USING (conv_id, turn) LEFT JOIN hashed p USING (conv_id, turn) WHERE role = 'assistant' AND r.what = 'request' AND p.what = 'reply'
    UNION ALL SELECT conv_id, turn, 1, 'tool_call', 'grep', {_hash(_QUERY)}, NULL, NULL, NULL, NULL, turn * 60000, NULL, NULL, 'tool_input', 'issuing_llm_call', model, false FROM kept WHERE role = 'assistant' AND turn % 4 = 1
    UNION ALL SELECT conv_id, turn, 2, 'tool_result', 'grep', {_hash(_RESULT)}, NULL, NULL, NULL, CASE WHEN bad THEN 'error' ELSE 'ok' END, turn * 60000, NULL, NULL, 'tool_output', 'issuing_llm_call', model, false FROM kept WHERE role = 'assistant' AND turn % 4 = 1 AND conv_id % 2 = 0
    UNION ALL SELECT DISTINCT conv_id, 1000000, 0, 'llm_call', 'mt', NULL, NULL, 5, 1, NULL, 3600000, 0.125, NULL, 'opaque', NULL, 'mt', true FROM c WHERE conv_id % 6 = 0),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS step_index FROM parts),
  -- What a later call hangs on: a result, or a call whose tool wasn't answered, on its own branch.
  anchored AS (SELECT n.*, (SELECT max(o.step_index) FROM numbered o WHERE o.conv_id = n.conv_id AND o.step_index < n.step_index AND NOT o.billed AND o.sub IN (0, 2) AND (n.conv_id % 5 <> 3 OR n.turn < 4 OR o.turn <= 1 OR o.turn >= 4)) AS above FROM numbered n)
  SELECT 'ses' || conv_id AS task_id, step_index, event_type, name, outcome, "at", round(CAST(cost AS DOUBLE), 6) AS usd, model, CASE WHEN billed THEN NULL WHEN sub = 0 THEN above ELSE step_index - 1 END AS parent_id, 'main' AS workflow, tokens_in, tokens_out, hash, basis, cost_basis, model_basis, response,
    CASE WHEN conv_id % 4 = 1 AND EXISTS (SELECT 1 FROM c p WHERE p.conv_id = anchored.conv_id - 1) THEN 'ses' || (conv_id - 1) END AS parent_task, CASE WHEN conv_id % 4 = 1 AND EXISTS (SELECT 1 FROM c p WHERE p.conv_id = anchored.conv_id - 1) THEN 'continuation' END AS link, CASE WHEN billed THEN true END AS billing_only FROM anchored"""

_TREE = f"""{_RAW}, tree AS (
  SELECT 'u' || user_id AS task_id, s AS step_index, CASE WHEN event_type = 'view' THEN 'llm_call' WHEN event_type IN ('click', 'purchase') THEN 'tool_call' ELSE 'tool_result' END AS event_type, event_type AS name, {_hash("'k' || (k % 25)")} AS content_hash,
    CASE event_type WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'error' END AS outcome, CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN true WHEN event_type IN ('click', 'purchase') AND k % 5 < 4 THEN false END AS write,
    CASE WHEN event_type = 'view' AND k % 3 > 0 THEN CAST(CAST(floor(value / 40) AS BIGINT) % 3 AS VARCHAR) END AS response_hash, k = 97 AS synthesized, CASE WHEN k % 10 > 0 THEN {_hash("'f' || (k % 25)")} END AS mark,
    CASE WHEN k % 3 = 0 AND s > 3 THEN s - 1 - (k // 3) % 3 WHEN k % 17 = 1 THEN s + 100000 END AS parent_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM raw)),
  placed AS (SELECT t.*, CASE WHEN p.step_index IS NOT NULL THEN t.parent_id WHEN t.step_index > 0 THEN t.step_index - 1 END AS eff_parent FROM tree t LEFT JOIN tree p ON p.task_id = t.task_id AND p.step_index = t.parent_id)"""
#: Each call looks back along its own ancestors until one fits; the steps of writes and of unflagged tools on the way are kept.
_WALK = """walk AS (SELECT c.task_id, c.step_index AS start, c.eff_parent AS at, CAST(NULL AS BIGINT) AS write_step, CAST(NULL AS BIGINT) AS unknown_step, c.event_type, c.name, c.content_hash FROM placed c WHERE c.event_type <> 'tool_result'
    UNION ALL SELECT w.task_id, w.start, a.eff_parent, CASE WHEN a.write AND a.event_type <> 'tool_result' THEN a.step_index ELSE w.write_step END, CASE WHEN a.write IS NULL AND a.event_type = 'tool_call' THEN a.step_index ELSE w.unknown_step END, w.event_type, w.name, w.content_hash
    FROM walk w JOIN placed a ON a.task_id = w.task_id AND a.step_index = w.at WHERE NOT (a.event_type = w.event_type AND a.name = w.name AND {fits})),
  met AS (SELECT w.*, a.content_hash AS other, a.mark AS other_mark, a.step_index AS original_step FROM walk w JOIN placed a ON a.task_id = w.task_id AND a.step_index = w.at WHERE a.event_type = w.event_type AND a.name = w.name AND {fits})"""
_SAME = _WALK.format(fits="a.content_hash = w.content_hash")
_LIKE = _WALK.format(fits="true").replace("walk", "walk2").replace("met AS", "met2 AS")
_RESULTS = """results AS (SELECT c.task_id, c.step_index, CASE WHEN c.event_type = 'llm_call' THEN c.response_hash ELSE (SELECT arg_min(r.content_hash, r.step_index) FROM placed r WHERE r.task_id = c.task_id AND r.eff_parent = c.step_index AND r.event_type = 'tool_result') END AS result FROM placed c WHERE c.event_type <> 'tool_result'),
  ends AS (SELECT task_id, nullif(arg_max(coalesce(outcome, '-'), step_index), '-') AS terminal_outcome FROM placed WHERE NOT synthesized GROUP BY task_id)"""

#: Counts of one source's events by each measure; missing columns are null.
_MEASURES = """SELECT 'event type' AS measure, event_type AS value, usd FROM {t} UNION ALL SELECT 'content', {content}, usd FROM {t} UNION ALL SELECT 'cost', CASE WHEN usd IS NULL THEN '(none)' ELSE coalesce(cost_basis, 'reported') END, usd FROM {t} WHERE event_type = 'llm_call'
    UNION ALL SELECT 'model', coalesce(model_basis, CASE WHEN model IS NULL THEN '(none)' ELSE 'reported' END), usd FROM {t} UNION ALL SELECT 'task id', {source}, usd FROM {t} UNION ALL SELECT 'parent task', {link}, usd FROM {t} WHERE {link} IS NOT NULL
    UNION ALL SELECT 'tool writes', '(none)', usd FROM {t} WHERE event_type = 'tool_call' UNION ALL SELECT 'outcome', coalesce(outcome, '(none)'), usd FROM {t}"""
_COUNTED = "count(*) AS events, round(CAST(coalesce(sum(CAST(usd AS DECIMAL(38, 9))), 0) AS DOUBLE), 6) AS usd"

SQL: dict[str, str] = {
    "conversion_summary": f"""WITH a AS ({_OPENINFERENCE}), b AS ({_OPENCODE_EXPORTED}), x AS ({_MEASURES.format(t="a", content="'(none)'", source="task_source", link="CAST(NULL AS VARCHAR)")}), y AS ({_MEASURES.format(t="b", content="coalesce(basis, '(none)')", source="'session_id'", link="link")})
      SELECT measure, value, {_COUNTED}, 'openinference' AS source FROM x GROUP BY 1, 2 UNION ALL SELECT measure, value, {_COUNTED}, 'opencode' FROM y GROUP BY 1, 2""",
    "openinference_events": _OPENINFERENCE,
    "openinference_skipped": f"WITH {_SRC} SELECT 'AGENT' AS kind, count(DISTINCT user_id) AS spans FROM src UNION ALL SELECT 'CHAIN', count(*) FROM src WHERE event_type = 'signup'",
    "coding_cli_events": _CODING_CLI,
    "subagent_events": f"""WITH {_SRC}, e AS (SELECT user_id, n, event_type, CASE WHEN k % 5 > 0 THEN CASE WHEN k % 2 = 0 THEN 'scout' ELSE 'writer' END END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS step FROM src WHERE event_type IN ('view', 'purchase')),
      a AS (SELECT v.*, (SELECT max(p.step) FROM e p WHERE p.user_id = v.user_id AND p.event_type = 'purchase' AND p.step < v.step AND v.event_type = 'view') AS above FROM e v),
      s AS (SELECT *, lag(step) OVER (PARTITION BY user_id, coalesce(above, -1) ORDER BY step) AS brother FROM a)
      SELECT 'u' || s.user_id AS task_id, s.step AS step_index, CASE s.event_type WHEN 'view' THEN 'llm_call' ELSE 'tool_call' END AS event_type, CASE s.event_type WHEN 'view' THEN 'm' ELSE 'Task' END AS name, coalesce(t.kind, 'main') AS workflow, coalesce(brother, above) AS parent_id FROM s LEFT JOIN e t ON t.user_id = s.user_id AND t.step = s.above""",
    "cowork_events": _COWORK,
    "openclaw_events": _OPENCLAW,
    "openclaw_localtrace_events": _LOCALTRACE,
    "opencode_events": _OPENCODE_EXPORTED,
    "opencode_table_events": _OPENCODE.replace("{tail}", "'m' || conv_id || '-m001'"),
    "canonical_json": f"""WITH {_SRC} SELECT event_id, {_hash("CASE WHEN k % 10 = 0 THEN '{broken ' || word ELSE '{" + '"a":[' + "' || k || '" + ',2.5,true],"b":1,"c":{"x":"éé ' + "' || word || '" + '","y":null}}' + "' END")} AS hash FROM src""",
    "jsonl_round_trip": f"""WITH {_EV} SELECT task_id, step_index, event_type, content_hash, tokens_in, tokens_out, outcome, epoch_us(ts) AS at, cost_usd, model, workflow, write, '/in/folder' AS source_path FROM ev""",
    "pi_events": _PI,
    "otlp_documents": "WITH d AS (SELECT count(DISTINCT user_id // 20) AS n, count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN user_id // 20 END) AS v FROM events) SELECT true AS is_trace, false AS is_log, false AS is_metrics, 2 * n AS documents FROM d UNION ALL SELECT false, true, false, n FROM d UNION ALL SELECT false, false, true, 12 FROM d",
    "otlp_spans": f"""WITH {_SRC} SELECT 't' || user_id AS trace_id, 'i' || user_id AS span_id, CAST(NULL AS VARCHAR) AS parent_id, 'claude_code.interaction' AS name, 0 AS start, 1000000 AS "end", CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS input_tokens, CAST(NULL AS VARCHAR) AS success, CAST(NULL AS VARCHAR) AS said, 'claude-code' AS service FROM src GROUP BY user_id
      UNION ALL SELECT 't' || user_id, 's' || event_id, 'i' || user_id, 'claude_code.llm_request', sec, sec + 5, 'm' || (k % 3), CAST(k AS VARCHAR), CAST(k % 9 > 0 AS VARCHAR), NULL, 'claude-code' FROM src WHERE event_type = 'view'
      UNION ALL SELECT 't' || user_id, 's' || event_id, 'i' || user_id, 'claude_code.tool', sec, sec + 5, NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'ok ' || word END, 'claude-code' FROM src WHERE event_type IN ('click', 'purchase')
      UNION ALL SELECT 't' || user_id, 's' || event_id || 'x', 's' || event_id, CASE WHEN k % 3 = 0 THEN 'claude_code.tool.execution' ELSE 'claude_code.tool.blocked_on_user' END, sec, sec + 5, NULL, NULL, CASE WHEN k % 3 = 0 THEN CAST(k % 2 = 0 AS VARCHAR) END, NULL, 'claude-code' FROM src WHERE event_type IN ('click', 'purchase') AND (k % 3 = 0 OR (k % 3 = 1 AND k % 5 = 0))""",
    "otlp_outcomes": f"""WITH {_SRC}, s AS (SELECT 'agent' AS name, NULL AS outcome, 2 + CAST(user_id % 3 = 0 AS INT) AS a FROM src GROUP BY user_id
      UNION ALL SELECT 'call', CASE WHEN k % 5 = 0 THEN 'error' END, 2 + CAST(event_type = 'view' AS INT) + CAST(k % 7 > 0 AS INT) + CAST(k % 3 > 0 AS INT) + CAST(k % 4 > 0 AS INT) FROM src WHERE event_type IN ('view', 'error')
      UNION ALL SELECT 'use', CASE WHEN k % 5 = 0 THEN 'error' END, 3 + CAST(k % 2 = 0 AS INT) FROM src WHERE event_type IN ('click', 'purchase') UNION ALL SELECT 'chain', NULL, 1 FROM src WHERE event_type = 'signup')
      SELECT name, outcome, count(*) AS spans, CAST(sum(a) AS BIGINT) AS attributes FROM s GROUP BY 1, 2""",
    "otlp_logs": f"""WITH {_SRC} SELECT sec AS at, 'u' || user_id AS session_id, CASE event_type WHEN 'view' THEN 'api_request' WHEN 'error' THEN 'api_error' WHEN 'signup' THEN 'user_prompt' WHEN 'click' THEN 'tool_result' ELSE 'tool_decision' END AS event_name, CAST(n AS VARCHAR) AS event_sequence,
      CASE WHEN event_type = 'signup' THEN CASE WHEN k % 5 = 0 THEN '<REDACTED>' ELSE word || ' please' END END AS prompt, CASE WHEN event_type = 'click' AND k % 5 = 0 THEN '{{"mcp_server_name": "srv", "mcp_tool_name": "x"}}' END AS tool_parameters, CASE WHEN event_type = 'view' AND k % 4 > 0 THEN round(value / 1000, 6) END AS cost, 'cowork' AS service FROM src
      UNION ALL SELECT sec, 'u' || user_id, 'assistant_response', CAST(n AS VARCHAR), NULL, NULL, NULL, 'cowork' FROM src WHERE event_type = 'view' AND k % 4 = 0""",
    "otlp_metric_points": """SELECT 'm-' || o_orderkey AS file, CASE o_orderkey % 4 WHEN 2 THEN 'level' WHEN 3 THEN 'spread' ELSE 'spent' END AS name, CASE o_orderkey % 4 WHEN 2 THEN 'gauge' WHEN 3 THEN 'histogram' ELSE 'sum' END AS kind, round(CAST(o_totalprice AS DOUBLE), 4) AS value, 7 AS start, o_orderkey % 1000 AS at,
      CASE o_orderkey % 4 WHEN 0 THEN 'cumulative' WHEN 1 THEN 'delta' END AS temporality, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS monotonic, o_orderpriority AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'm-' || o_orderkey END AS again FROM orders""",
    "source_signals": """SELECT * FROM (VALUES ('coding_cli', true, true, false, false, false, false, true), ('cowork', false, false, true, false, false, false, true), ('openclaw', false, false, false, true, false, false, false),
      ('localtrace', false, false, false, false, true, false, false), ('openinference', false, false, false, false, false, true, false)) v(telemetry, span_names, service, cowork, openclaw, localtrace, openinference, residual)""",
    "jsonl_rows": f"""WITH {_SRC}, e AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing required field task_id' WHEN k % 11 = 0 THEN 'step_index is not an integer' WHEN k % 13 = 0 THEN 'unknown event_type call'
        WHEN k % 5 > 0 AND k % 23 = 0 THEN 'unknown outcome maybe' WHEN k % 19 = 0 THEN 'tokens_in is not an integer' END AS error FROM src)
      SELECT event_id, error, CASE WHEN error IS NULL THEN 'u' || user_id END AS task_id, CASE WHEN error IS NULL THEN n END AS step_index, CASE WHEN error IS NULL THEN 'llm_call' END AS event_type, CASE WHEN error IS NULL THEN k * 10 END AS tokens_in, CASE WHEN error IS NULL AND k % 5 > 0 THEN 'ok' END AS outcome,
        CASE WHEN error IS NULL THEN sec END AS at, CASE WHEN error IS NULL AND k % 2 = 0 THEN k % 4 = 0 END AS write, CASE WHEN error IS NULL AND k % 2 = 0 THEN 'h' || k END AS response FROM e""",
    "price_overlay": """WITH rates AS (SELECT p_type AS model, min(p_retailprice) * 0.001 AS i, min(CASE WHEN p_size > 10 THEN p_size / 100 END) AS r, 0 AS o FROM part WHERE p_partkey % 7 > 0 GROUP BY 1
        UNION ALL SELECT p_type, min(p_retailprice) * 0.5, min(CASE WHEN p_size > 10 THEN p_size / 100 END), 1 FROM part WHERE p_partkey % 5 = 0 GROUP BY 1), best AS (SELECT model, arg_max(i, o) AS i, arg_max(coalesce(r, 0), o) AS r FROM rates GROUP BY model)
      SELECT p_partkey, round(CASE WHEN p_partkey % 3 > 0 THEN p_size * i + p_size * r END, 4) AS estimated_usd FROM part LEFT JOIN best ON model = p_type""",
    "price_curation": "SELECT 'm' || p_partkey AS model, round(p_retailprice, 4) AS input FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0",
    "tree_effective_parent": f"WITH {_TREE} SELECT task_id, step_index, eff_parent, max(eff_parent IS DISTINCT FROM CASE WHEN step_index > 0 THEN step_index - 1 END) OVER (PARTITION BY task_id) AS branching FROM placed",
    "tree_exact_repeats": f"""WITH RECURSIVE {_TREE}, {_SAME}, {_RESULTS} SELECT m.task_id, m.original_step, m.start AS repeat_step, o.result AS original_result, r.result AS repeat_result, write_step, unknown_step, terminal_outcome
      FROM met m JOIN results o ON o.task_id = m.task_id AND o.step_index = m.original_step JOIN results r ON r.task_id = m.task_id AND r.step_index = m.start LEFT JOIN ends e ON e.task_id = m.task_id""",
    "tree_near_repeats": f"""WITH RECURSIVE {_TREE}, {_SAME}, {_LIKE} SELECT m.task_id, m.original_step, m.start AS repeat_step, bit_count(CAST('0x' || p.mark AS UBIGINT)::BIT # CAST('0x' || m.other_mark AS UBIGINT)::BIT) AS distance FROM met2 m JOIN placed p ON p.task_id = m.task_id AND p.step_index = m.start
      WHERE m.other <> m.content_hash AND p.mark IS NOT NULL AND m.other_mark IS NOT NULL AND bit_count(xor(CAST('0x' || p.mark AS UBIGINT), CAST('0x' || m.other_mark AS UBIGINT))) <= 30 AND NOT EXISTS (SELECT 1 FROM met x WHERE x.task_id = m.task_id AND x.start = m.start)""".replace("bit_count(CAST('0x' || p.mark AS UBIGINT)::BIT # CAST('0x' || m.other_mark AS UBIGINT)::BIT)", "CAST(bit_count(xor(CAST('0x' || p.mark AS UBIGINT), CAST('0x' || m.other_mark AS UBIGINT))) AS INT)"),
    "tree_terminal_outcome": _CORE["terminal_outcome"],
    "pair_notes": "WITH b AS (" + _CORE["bucket_counts"] + """) SELECT (SELECT count(DISTINCT user_id) FROM events) AS tasks, 0 AS tasks_with_near, sum(CASE WHEN bucket = 'near_duplicate' THEN pairs END) AS near_pairs, sum(CASE WHEN bucket = 'cross_task_redundancy' THEN pairs END) AS redundancy_pairs, sum(CASE WHEN bucket = 'recurring_pattern' THEN pairs END) AS recurring_pairs FROM b""",
}
