"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from .functions.hashing import INTEGERS, MASKS

_RAW = "raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_EV = (
    _RAW
    + """, ev AS (
  SELECT 'u' || user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index,
    CASE WHEN event_type = 'view' THEN 'llm_call' WHEN event_type IN ('click', 'purchase') THEN 'tool_call' ELSE 'tool_result' END AS event_type,
    event_type AS name, substr(sha256('k' || (k % 25)), 1, 16) AS content_hash, k * 10 AS tokens_in, CASE WHEN k % 3 > 0 THEN k END AS tokens_out,
    CASE event_type WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'error' END AS outcome, ts, CASE WHEN k % 4 > 0 THEN round(value / 1000, 6) END AS cost_usd,
    CASE WHEN event_type = 'view' AND k % 7 > 0 THEN 'm' || (k % 3) END AS model, CASE WHEN user_id % 4 > 0 THEN 'w' || (user_id % 4) END AS workflow,
    CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN true WHEN event_type IN ('click', 'purchase') AND k % 5 < 4 THEN false END AS write,
    CASE WHEN event_type = 'view' AND k % 3 > 0 THEN CAST(CAST(floor(value / 40) AS BIGINT) % 3 AS VARCHAR) END AS response_hash,
    CASE WHEN k % 6 = 0 THEN 'estimated' END AS cost_basis, k = 97 AS synthesized,
    CASE WHEN user_id % 10 = 0 THEN 'u' || (user_id + 1) END AS parent_task_id,
    CASE WHEN user_id % 20 = 0 THEN 'continuation' WHEN user_id % 10 = 0 THEN 'spawn' END AS link_kind,
    CASE user_id % 3 WHEN 0 THEN 'conversation_id' WHEN 1 THEN 'trace_id_fallback' END AS task_id_source
  FROM raw)"""
)
#: By self-join and correlated counts, unlike the windows of the library.
_PAIRS = (
    _EV
    + """, calls AS (SELECT *, CASE WHEN event_type = 'llm_call' THEN response_hash ELSE
      (SELECT n.content_hash FROM ev n WHERE n.task_id = e.task_id AND n.step_index = e.step_index + 1 AND n.event_type = 'tool_result') END AS result_hash
    FROM ev e WHERE event_type IN ('llm_call', 'tool_call')),
  ends AS (SELECT task_id, arg_max(coalesce(outcome, '-'), step_index) AS o FROM ev WHERE NOT synthesized GROUP BY task_id),
  near AS (SELECT r.task_id, r.step_index AS r, max(o.step_index) AS o FROM calls r JOIN calls o
    ON r.task_id = o.task_id AND r.event_type = o.event_type AND r.name = o.name AND r.content_hash = o.content_hash AND o.step_index < r.step_index GROUP BY 1, 2),
  pairs AS (SELECT x.task_id, x.o AS original_step, x.r AS repeat_step, r.event_type, r.name, r.content_hash, r.model, r.workflow, r.cost_usd, r.tokens_in, r.tokens_out,
      o.result_hash AS original_result, r.result_hash AS repeat_result,
      (SELECT min(w.step_index) FROM ev w WHERE w.task_id = x.task_id AND w.step_index > x.o AND w.step_index < x.r AND w.write AND w.event_type <> 'tool_result') AS write_step,
      (SELECT min(w.step_index) FROM ev w WHERE w.task_id = x.task_id AND w.step_index > x.o AND w.step_index < x.r AND w.write IS NULL AND w.event_type = 'tool_call') AS unknown_step,
      nullif(ends.o, '-') AS terminal_outcome
    FROM near x JOIN calls r ON r.task_id = x.task_id AND r.step_index = x.r JOIN calls o ON o.task_id = x.task_id AND o.step_index = x.o LEFT JOIN ends ON ends.task_id = x.task_id),
  signals AS (SELECT *, CASE WHEN original_result IS NULL OR repeat_result IS NULL THEN 'unknown' WHEN original_result = repeat_result THEN 'waste_supporting' ELSE 'legit_supporting' END AS result_signal,
      CASE WHEN write_step IS NOT NULL THEN 'legit_supporting' WHEN unknown_step IS NOT NULL THEN 'unknown' ELSE 'waste_supporting' END AS write_signal,
      CASE terminal_outcome WHEN 'error' THEN 'waste_supporting' WHEN 'ok' THEN 'legit_supporting' ELSE 'unknown' END AS terminal_signal FROM pairs),
  judged AS (SELECT *, CASE WHEN 'legit_supporting' IN (result_signal, write_signal) THEN 'likely_legitimate'
      WHEN terminal_signal = 'legit_supporting' AND 'waste_supporting' NOT IN (result_signal, write_signal) THEN 'likely_legitimate'
      WHEN result_signal = 'waste_supporting' AND write_signal = 'waste_supporting' AND terminal_signal = 'waste_supporting' THEN 'confirmed_waste' ELSE 'unclassified' END AS verdict FROM signals),
  notes AS (SELECT *, CASE result_signal WHEN 'unknown' THEN 'result not observable for one or both calls' WHEN 'waste_supporting' THEN 'result identical' ELSE 'result changed' END AS rn,
      CASE write_signal WHEN 'legit_supporting' THEN 'write intervened at step ' || write_step WHEN 'unknown' THEN 'write status not recorded for at least one intervening tool call' ELSE 'no intervening write' END AS wn,
      CASE terminal_signal WHEN 'waste_supporting' THEN 'task terminated in failure' WHEN 'legit_supporting' THEN 'task terminated in success' ELSE 'task terminal outcome not recorded' END AS tn FROM judged),
  reasoned AS (SELECT *, CASE WHEN 'legit_supporting' IN (result_signal, write_signal) THEN concat_ws('; ', CASE WHEN result_signal = 'legit_supporting' THEN rn END, CASE WHEN write_signal = 'legit_supporting' THEN wn END)
      WHEN verdict = 'likely_legitimate' THEN tn WHEN verdict = 'confirmed_waste' THEN rn || '; ' || wn || '; ' || tn
      WHEN terminal_signal = 'legit_supporting' THEN rn || '; ' || wn || '; task succeeded, but that doesn''t confirm this specific repeated call contributed: task-level outcome isn''t a substitute for the missing call-level answer'
      ELSE 'no legitimate-use signal fired, but ' || concat_ws('; ', CASE WHEN result_signal = 'unknown' THEN rn END, CASE WHEN write_signal = 'unknown' THEN wn END, CASE WHEN terminal_signal = 'unknown' THEN tn END) END AS reason FROM notes)"""
)
_USD = "round(CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(38, 9))), 0) AS DOUBLE), 6)"
_SLICE = f"count(*) AS pairs, {_USD} AS cost_usd, count(*) FILTER (cost_usd IS NULL) AS unpriced, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out"
_SLICES = (
    _PAIRS
    + f""", shown AS (SELECT verdict AS bucket, coalesce(nullif(model, ''), '(unknown model)') AS model, coalesce(nullif(workflow, ''), '(unlabeled workflow)') AS workflow, cost_usd, tokens_in, tokens_out FROM judged),
  every AS (SELECT bucket, 'all' AS level, '' AS segment, {_SLICE} FROM shown GROUP BY bucket UNION ALL
    SELECT bucket, 'model', model, {_SLICE} FROM shown GROUP BY bucket, model UNION ALL
    SELECT bucket, 'workflow', workflow, {_SLICE} FROM shown GROUP BY bucket, workflow)"""
)
_BUCKETS = "(VALUES ('confirmed_waste'), ('likely_legitimate'), ('unclassified'), ('near_duplicate'), ('cross_task_redundancy'), ('recurring_pattern')) b(bucket)"
_CROSS = """across AS (SELECT task_id, repeat_step, original_task, original_step FROM (
  SELECT r.task_id, r.step_index AS repeat_step, o.task_id AS original_task, o.step_index AS original_step, row_number() OVER (PARTITION BY r.task_id, r.step_index ORDER BY o.ts DESC, o.task_id DESC, o.step_index DESC) AS n
  FROM cand r JOIN cand o ON r.event_type = o.event_type AND r.name = o.name AND r.content_hash = o.content_hash AND r.task_id <> o.task_id AND (o.ts, o.task_id, o.step_index) < (r.ts, r.task_id, r.step_index)) WHERE n = 1)"""
_CAND = "cand AS (SELECT e.* FROM ev e WHERE event_type IN ('llm_call', 'tool_call') AND ts IS NOT NULL)"
_UNCLAIMED = "cand AS (SELECT e.* FROM ev e WHERE event_type IN ('llm_call', 'tool_call') AND ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM near p WHERE p.task_id = e.task_id AND p.r = e.step_index))"
_EDGES = """edges AS (SELECT task_id, CASE WHEN count(DISTINCT parent_task_id) = 1 THEN min(parent_task_id) END AS parent_task_id,
  CASE WHEN count(DISTINCT parent_task_id) = 1 THEN min(link_kind) END AS link_kind FROM ev GROUP BY task_id)"""
_COMPONENTS = (
    _EDGES
    + """, nodes AS (SELECT task_id FROM edges UNION SELECT parent_task_id FROM edges WHERE parent_task_id IS NOT NULL),
  both_ways AS (SELECT task_id AS a, parent_task_id AS b FROM edges WHERE parent_task_id IS NOT NULL UNION SELECT parent_task_id, task_id FROM edges WHERE parent_task_id IS NOT NULL),
  reach AS (SELECT task_id AS a, task_id AS b FROM nodes UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
  comps AS (SELECT a AS task_id, min(b) AS component FROM reach GROUP BY a)"""
)
_HOPS = """hops AS (SELECT task_id AS tip, 0 AS hop, task_id AS successor, parent_task_id AS predecessor FROM edges WHERE link_kind = 'continuation'
    AND task_id NOT IN (SELECT parent_task_id FROM edges WHERE link_kind = 'continuation')
  UNION ALL SELECT h.tip, h.hop + 1, h.predecessor, e.parent_task_id FROM hops h JOIN edges e ON e.task_id = h.predecessor AND e.link_kind = 'continuation' WHERE h.hop < 1000)"""
_SHAPES = """signs AS (SELECT event_type, name, chr(33 + CAST(row_number() OVER (ORDER BY event_type, name) AS INTEGER)) AS c FROM (SELECT DISTINCT event_type, name FROM ev WHERE event_type <> 'tool_result')),
  shapes AS (SELECT task_id, string_agg(c, '' ORDER BY step_index) AS shape FROM ev JOIN signs USING (event_type, name) GROUP BY task_id)"""
#: The whole table of edit distances row by row, then the way back: a pair if it is as good, else a removal, else an addition.
_ALIGNED = """line AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY step_index) AS place, step_index, event_type, name FROM ev WHERE event_type <> 'tool_result'),
  lists AS (SELECT task_id, list(event_type || chr(31) || name ORDER BY place) AS s FROM line GROUP BY task_id),
  hop AS (SELECT DISTINCT predecessor, successor, coalesce(x.s, []) AS a, coalesce(y.s, []) AS b FROM hops LEFT JOIN lists x ON x.task_id = predecessor LEFT JOIN lists y ON y.task_id = successor),
  filled AS (SELECT predecessor, successor, a, b, 0 AS i, CAST(range(0, len(b) + 1) AS BIGINT[]) AS r FROM hop
    UNION ALL SELECT predecessor, successor, a, b, i + 1, list_transform(u, lambda v, j: j - 1 + list_min(list_transform(u[1:j], lambda w, k: w - k + 1)))
    FROM (SELECT predecessor, successor, a, b, i, list_prepend(r[1] + 1, list_transform(b, lambda y, j: least(r[j] + CAST(y <> a[i + 1] AS BIGINT), r[j + 1] + 1))) AS u FROM filled WHERE i < len(a))),
  tables AS (SELECT predecessor, successor, any_value(a) AS a, any_value(b) AS b, list(r ORDER BY i) AS d FROM filled GROUP BY predecessor, successor),
  back AS (SELECT predecessor, successor, a, b, d, len(a) AS i, len(b) AS j, CAST(NULL AS VARCHAR) AS op, 0 AS n FROM tables
    UNION ALL SELECT predecessor, successor, a, b, d, CASE WHEN next = 'added' THEN i ELSE i - 1 END, CASE WHEN next = 'removed' THEN j ELSE j - 1 END, next, n + 1 FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND d[i + 1][j + 1] = d[i][j] + CAST(a[i] <> b[j] AS BIGINT) THEN 'pair' WHEN i > 0 AND d[i + 1][j + 1] = d[i][j + 1] + 1 THEN 'removed' ELSE 'added' END AS next FROM back WHERE i > 0 OR j > 0)),
  steps AS (SELECT predecessor, successor, op, i + 1 AS i, j + 1 AS j FROM back)"""
_EMB = """emb AS (SELECT 't' || (vec_id % 7) AS task_id, vec_id // 7 AS step_index, 'l' || label AS name, vec_id,
  list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"""
_FAR = "CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN r.bits[i] <> o.bits[i] THEN 1 ELSE 0 END)) AS INTEGER)"
# White space as Python splits at; the rest is composed (NFC).
_NORMAL = r"trim(regexp_replace(nfc_normalize(text), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
# A boundary lies where a word of any script ends, here only of ASCII: so a q, marked to be taken out again, stands between an
# ASCII word character and a letter or number of another script (but the sign of microseconds, which a rule names).
_OTHER = r"[^\x00-\x7F\x{b5}\p{P}\p{S}\p{Z}\p{C}\p{M}]"


def _guard(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '({_OTHER})([0-9A-Za-z_])', '\\1\ue000q\\2', 'g'), '([0-9A-Za-z_])({_OTHER})', '\\1q\ue000\\2', 'g')"


_GUARDED = _guard(_NORMAL)
_UNGUARDED = "replace(replace(s, '\ue000q', ''), 'q\ue000', '')"
_MASKS, _INTEGERS = MASKS, INTEGERS


def _masked(text: str, masks: list) -> tuple[list[str], str, str]:
    """CTE bodies t0, t1, …: a column s masked step by step and n, the spans so far."""
    steps = [f"t0 AS ({text})"]
    for i, (token, pattern) in enumerate(masks):
        p, t = pattern.replace("'", "''"), token.replace("'", "''")
        steps.append(f"t{i + 1} AS (SELECT * REPLACE (regexp_replace(s, '{p}', '{t}', 'g') AS s, n + len(regexp_extract_all(s, '{p}')) AS n) FROM t{i})")
    return steps, f"t{len(masks)}", "CAST(n AS INTEGER)"


def _mask_sql(source: str, masks: list, columns: str) -> str:
    steps, last, n = _masked(source, masks)
    return f"WITH {', '.join(steps)} SELECT {columns.format(n=n)} FROM {last}"


_NEAR_ACROSS = f"""WITH {_EMB}, pos AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY vec_id, task_id, step_index) AS rn FROM emb),
      met AS (SELECT r.task_id, r.step_index AS repeat_step, o.task_id AS original_task, o.step_index AS original_step, {_FAR} AS distance, r.rn - o.rn AS back, o.rn AS orn,
        list_bool_or(list_transform(range(0, 4), lambda b: r.bits[16 * b + 1:16 * b + 16] = o.bits[16 * b + 1:16 * b + 16])) AS band
        FROM pos r JOIN pos o ON r.name = o.name AND o.rn < r.rn AND o.task_id <> r.task_id WHERE {_FAR} <= 24),
      best AS (SELECT *, row_number() OVER (PARTITION BY task_id, repeat_step ORDER BY back <= {{window}} DESC, orn DESC) AS n FROM met WHERE back <= {{window}} OR band)
      SELECT task_id, repeat_step, original_task, original_step, distance FROM best WHERE n = 1"""
_GEN = "pts AS (SELECT o_custkey % 50 AS channel, o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS start, o_orderkey AS point, o_totalprice AS value FROM orders), starts AS (SELECT DISTINCT channel, model, start FROM pts WHERE start % 2 = 0)"
_SPANS = """spans AS (SELECT l_orderkey AS parent, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS span_id, min(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))) AS start,
  max(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT)) AS stop FROM lineitem GROUP BY 1, 2)"""

SQL: dict[str, str] = {
    "verdict_counts": f"WITH {_PAIRS} SELECT verdict, count(*) AS pairs FROM judged GROUP BY verdict",
    "effective_parent": f"WITH {_EV} SELECT task_id, step_index, CASE WHEN step_index > 0 THEN step_index - 1 END AS eff_parent FROM ev",
    "terminal_outcome": f"WITH {_EV}, last AS (SELECT task_id, max(step_index) AS s FROM ev WHERE NOT synthesized GROUP BY task_id) SELECT t.task_id, e.outcome AS terminal_outcome FROM (SELECT DISTINCT task_id FROM ev) t LEFT JOIN last ON last.task_id = t.task_id LEFT JOIN ev e ON e.task_id = last.task_id AND e.step_index = last.s",
    "call_filter": f"WITH {_EV} SELECT task_id, step_index, event_type, name FROM ev WHERE event_type <> 'tool_result'",
    "exact_repeat_pairs": f"WITH {_PAIRS} SELECT task_id, original_step, repeat_step, event_type, name, content_hash FROM pairs",
    "call_result_link": f"WITH {_PAIRS} SELECT task_id, step_index, result_hash FROM calls WHERE event_type = 'tool_call'",
    "write_signal": f"WITH {_PAIRS} SELECT task_id, repeat_step, write_step, write_signal FROM signals",
    "result_signal": f"WITH {_PAIRS} SELECT task_id, repeat_step, result_signal FROM signals",
    "pair_verdicts": f"WITH {_PAIRS} SELECT task_id, original_step, repeat_step, result_signal, write_signal, terminal_signal, verdict FROM judged",
    "verdict_reasons": f"WITH {_PAIRS} SELECT task_id, repeat_step, reason FROM reasoned",
    "slice_grouping_sets": f"WITH {_SLICES} SELECT * FROM every",
    "slice_by_model": f"WITH {_SLICES} SELECT * EXCLUDE (level) FROM every WHERE level = 'model'",
    "slice_by_workflow": f"WITH {_SLICES} SELECT * EXCLUDE (level) FROM every WHERE level = 'workflow'",
    "coverage": f"""WITH {_EV} SELECT count(*) AS total_events, count(*) FILTER (event_type <> 'tool_result') AS call_events, count(cost_usd) AS priced_events, count(*) - count(cost_usd) AS unpriced_events,
      {_USD} AS priced_usd, count(*) FILTER (synthesized) AS synthesized_events, round(CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(38, 9))) FILTER (synthesized), 0) AS DOUBLE), 6) AS synthesized_usd,
      count(*) FILTER (task_id_source = 'conversation_id') AS confident_task_ids, count(*) FILTER (task_id_source = 'trace_id_fallback') AS fallback_task_ids,
      round(count(*) FILTER (task_id_source = 'conversation_id') / nullif(count(task_id_source), 0), 4) AS task_id_confidence, CAST(NULL AS VARCHAR) AS source_path FROM ev""",
    "cost_by_basis": f"WITH {_EV} SELECT CASE WHEN synthesized THEN 'synthesized_billing_only' ELSE coalesce(cost_basis, 'direct_from_source') END AS basis, count(*) AS events, {_USD} AS usd FROM ev WHERE cost_usd IS NOT NULL GROUP BY 1",
    "comparability": f"""WITH {_PAIRS}, w AS (SELECT DISTINCT task_id FROM pairs) SELECT count(DISTINCT task_id) AS tasks, count(DISTINCT task_id) FILTER (task_id IN (FROM w)) AS tasks_with_pairs,
      count(*) FILTER (task_id NOT IN (FROM w)) AS events_without, round(CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(38, 9))) FILTER (task_id NOT IN (FROM w)), 0) AS DOUBLE), 6) AS usd_without FROM ev""",
    "verdicts_reached": f"""WITH {_PAIRS} SELECT count(*) FILTER (verdict <> 'unclassified') AS judged, count(*) AS judgeable,
      CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (verdict <> 'unclassified') / count(*), 4) END AS share, count(*) AS total_candidates FROM judged""",
    "top_highlights": f"WITH {_PAIRS} SELECT task_id, repeat_step, event_type, name, cost_usd FROM judged WHERE verdict = 'confirmed_waste' AND cost_usd > 0 ORDER BY cost_usd DESC, task_id, repeat_step LIMIT 3",
    "sample_reasons": f"""WITH {_PAIRS} SELECT verdict AS bucket, rank, 'task=' || task_id || ' step=' || repeat_step || ' (' || event_type || '/' || name || '): ' || reason AS line FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY verdict ORDER BY task_id, repeat_step) AS INTEGER) AS rank FROM reasoned) WHERE rank <= 20""",
    "unpriced_samples": f"WITH {_EV} SELECT task_id, step_index, 'task=' || task_id || ' step=' || step_index || ' (' || event_type || '/' || name || '): no cost_usd recorded' AS line FROM ev WHERE cost_usd IS NULL ORDER BY task_id, step_index LIMIT 20",
    "synthesized_samples": f"WITH {_EV} SELECT task_id, step_index, 'task=' || task_id || ' step=' || step_index || ' (' || event_type || '/' || name || '): billing-only, no matching span' AS line FROM ev WHERE synthesized ORDER BY task_id, step_index LIMIT 20",
    "cross_exact_pairs": f"WITH {_EV}, {_CAND}, {_CROSS} SELECT * FROM across",
    "cross_exact_unclaimed": f"WITH {_PAIRS}, {_UNCLAIMED}, {_CROSS} SELECT * FROM across",
    "cross_split": f"""WITH RECURSIVE {_PAIRS}, {_UNCLAIMED}, {_CROSS}, {_COMPONENTS} SELECT CASE WHEN x.component = y.component THEN 'cross_task_redundancy' ELSE 'recurring_pattern' END AS bucket, count(*) AS pairs
      FROM across LEFT JOIN comps x ON x.task_id = across.task_id LEFT JOIN comps y ON y.task_id = across.original_task GROUP BY 1""",
    "bucket_counts": f"""WITH RECURSIVE {_PAIRS}, {_UNCLAIMED}, {_CROSS}, {_COMPONENTS}, every AS (SELECT verdict AS bucket, cost_usd, tokens_in, tokens_out FROM judged UNION ALL
      SELECT CASE WHEN x.component = y.component THEN 'cross_task_redundancy' ELSE 'recurring_pattern' END, r.cost_usd, r.tokens_in, r.tokens_out
      FROM across JOIN ev r ON r.task_id = across.task_id AND r.step_index = across.repeat_step LEFT JOIN comps x ON x.task_id = across.task_id LEFT JOIN comps y ON y.task_id = across.original_task),
      found AS (SELECT bucket, {_SLICE} FROM every GROUP BY bucket)
      SELECT b.bucket, coalesce(pairs, 0) AS pairs, coalesce(cost_usd, 0) AS cost_usd, coalesce(unpriced, 0) AS unpriced, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out FROM {_BUCKETS} LEFT JOIN found USING (bucket)""",
    "task_edges": f"WITH {_EV}, {_EDGES} SELECT * FROM edges",
    "task_components": f"WITH RECURSIVE {_EV}, {_COMPONENTS} SELECT * FROM comps",
    "continuation_hops": f"WITH RECURSIVE {_EV}, {_EDGES}, {_HOPS} SELECT * FROM hops",
    "continuation_tips": f"""WITH RECURSIVE {_EV}, {_EDGES}, {_HOPS}, n AS (SELECT successor, predecessor, count(*) AS tips FROM hops GROUP BY ALL), far AS (SELECT tip, max(hop) + 1 AS hops, arg_max(predecessor, hop) AS root FROM hops GROUP BY tip)
      SELECT successor, predecessor, any_value(root) AS root, any_value(hops - hop) AS depth, any_value(tips) AS tips FROM hops JOIN far USING (tip) JOIN n USING (successor, predecessor) GROUP BY successor, predecessor""",
    "drift_details": f"""WITH RECURSIVE {_EV}, {_EDGES}, {_HOPS}, {_ALIGNED} SELECT predecessor, successor, coalesce(string_agg(CASE WHEN op = 'added' THEN CAST(y.step_index AS VARCHAR) END, ',' ORDER BY j), '') AS added, coalesce(string_agg(CASE WHEN op = 'removed' THEN CAST(x.step_index AS VARCHAR) END, ',' ORDER BY i), '') AS removed,
      coalesce(string_agg(CASE WHEN op = 'pair' AND (x.event_type, x.name) <> (y.event_type, y.name) THEN x.step_index || '-' || y.step_index END, ',' ORDER BY i), '') AS substituted, '' AS content
      FROM steps LEFT JOIN line x ON x.task_id = predecessor AND x.place = i LEFT JOIN line y ON y.task_id = successor AND y.place = j GROUP BY predecessor, successor""",
    "shape_distance": f"""WITH RECURSIVE {_EV}, {_EDGES}, {_HOPS}, {_SHAPES} SELECT DISTINCT predecessor, successor, CAST(length(coalesce(x.shape, '')) AS INTEGER) AS predecessor_calls, CAST(length(coalesce(y.shape, '')) AS INTEGER) AS successor_calls,
      CAST(levenshtein(coalesce(x.shape, ''), coalesce(y.shape, '')) AS INTEGER) AS shape_distance, round(levenshtein(coalesce(x.shape, ''), coalesce(y.shape, '')) / greatest(length(coalesce(x.shape, '')), length(coalesce(y.shape, '')), 1), 4) AS shape_fraction
      FROM hops LEFT JOIN shapes x ON x.task_id = predecessor LEFT JOIN shapes y ON y.task_id = successor""",
    "near_same_task": f"""WITH {_EMB}, pos AS (SELECT *, lag(step_index) OVER (PARTITION BY task_id, name ORDER BY step_index) AS before FROM emb)
      SELECT r.task_id, o.step_index AS original_step, r.step_index AS repeat_step, {_FAR} AS distance FROM pos r JOIN emb o ON o.task_id = r.task_id AND o.name = r.name AND o.step_index = r.before WHERE {_FAR} <= 24""",
    "near_cross_task": _NEAR_ACROSS.format(window=4096),
    "near_cross_task_bands": _NEAR_ACROSS.format(window=16),
    "hamming": f"""WITH {_EMB} SELECT r.task_id, r.step_index, {_FAR} AS distance FROM emb r JOIN emb o ON o.task_id = r.task_id AND o.step_index = r.step_index - 1""",
    "bands": f"""WITH {_EMB} SELECT task_id, step_index, {", ".join(f"CAST(list_sum(list_transform(range(0, 16), lambda i: bits[{64 - 16 * b} - i] * (1 << i))) AS BIGINT) AS band{b}" for b in range(4))} FROM emb""",
    "content_hash_text": _mask_sql(f"SELECT 'c' || conv_id AS task_id, turn AS step_index, {_GUARDED} AS s, 0 AS n FROM conversations", _MASKS, f"task_id, step_index, substr(sha256({_UNGUARDED}), 1, 16) AS content_hash, {{n}} AS masked_spans"),
    "mask_counts": _mask_sql(f"SELECT doc_id, {_GUARDED} AS s, 0 AS n FROM documents", [*_MASKS, _INTEGERS], f"doc_id, substr(sha256({_UNGUARDED}), 1, 16) AS masked_hash, {{n}} AS spans"),
    "normalize_text": f"SELECT doc_id, substr(sha256({_NORMAL}), 1, 16) AS normal_hash FROM documents",
    "exact_duplicate_docs": "SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "nearest_model_fill": f"""WITH {_EV}, pos AS (SELECT *, row_number() OVER (PARTITION BY task_id, workflow ORDER BY step_index) AS rn FROM ev),
      ranked AS (SELECT e.task_id, e.step_index, l.model, l.rn < e.rn AS before, row_number() OVER (PARTITION BY e.task_id, e.step_index ORDER BY abs(l.rn - e.rn), l.rn) AS n
        FROM pos e JOIN pos l ON l.task_id = e.task_id AND l.workflow IS NOT DISTINCT FROM e.workflow AND l.event_type = 'llm_call' WHERE e.event_type <> 'llm_call')
      SELECT e.task_id, e.step_index, coalesce(e.model, r.model) AS model, CASE WHEN e.model IS NULL AND r.model IS NOT NULL THEN CASE WHEN r.before THEN 'preceding_llm_call' ELSE 'following_llm_call' END END AS model_basis
      FROM ev e LEFT JOIN ranked r ON r.task_id = e.task_id AND r.step_index = e.step_index AND r.n = 1""",
    "prompt_window_claim": """WITH s AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'signup'),
      m AS (SELECT s.user_id AS session, s.event_id AS start_id, p.event_id AS point_id, row_number() OVER (PARTITION BY s.event_id ORDER BY p.ts, p.event_id) AS n
        FROM s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'view' AND p.ts >= s.ts AND (s.nxt IS NULL OR p.ts < s.nxt)) SELECT session, start_id, point_id FROM m WHERE n = 1""",
    "turn_cost_asof": """SELECT p.user_id AS session, p.event_id AS point_id, (SELECT arg_max(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'click' AND e.ts <= p.ts) AS end_id
      FROM events p WHERE p.event_type = 'purchase'""",
    "positional_join": """WITH a AS (SELECT user_id AS session, event_type, event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS name, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
      SELECT l.session, CAST(l.n AS INTEGER) AS n, l.event_id AS left_id, r.event_id AS right_id FROM a l JOIN a r ON l.session = r.session AND l.n = r.n WHERE l.event_type = 'click' AND r.event_type = 'purchase' AND (l.name IS NULL OR r.name IS NULL OR l.name = r.name)""",
    "greedy_pairing": """WITH RECURSIVE e AS (SELECT user_id AS trace, event_type = 'view' AS call, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'view', event_id) AS n FROM events WHERE event_type IN ('view', 'click')),
      walk AS (SELECT trace, 1 AS n, call, id, CASE WHEN call THEN []::BIGINT[] ELSE [id] END AS pile, CAST(NULL AS BIGINT) AS end_id FROM e WHERE n = 1
        UNION ALL SELECT e.trace, e.n, e.call, e.id, CASE WHEN e.call THEN w.pile[1:len(w.pile) - 1] ELSE list_append(w.pile, e.id) END, CASE WHEN e.call THEN w.pile[len(w.pile)] END FROM walk w JOIN e ON e.trace = w.trace AND e.n = w.n + 1)
      SELECT trace, id AS call_id, end_id FROM walk WHERE call""",
    "orphan_cost_rows": "SELECT o_orderkey AS key, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "latest_counter_points": f"WITH {_GEN} SELECT channel, model, start, arg_max(value, point) AS value FROM pts GROUP BY channel, model, start",
    "restart_windows": f"WITH {_GEN} SELECT channel, model, start, CASE WHEN EXISTS (SELECT 1 FROM starts b WHERE b.channel = a.channel AND b.model = a.model AND b.start < a.start) THEN start END AS lo, (SELECT min(b.start) FROM starts b WHERE b.channel = a.channel AND b.model = a.model AND b.start > a.start) AS hi FROM starts a",
    "restart_window_calls": f"""WITH {_GEN}, g AS (SELECT p.channel, p.model, p.point AS call_id, coalesce((SELECT max(s.start) FROM starts s WHERE s.channel = p.channel AND s.model = p.model AND s.start <= p.start),
      (SELECT min(s.start) FROM starts s WHERE s.channel = p.channel AND s.model = p.model)) AS start FROM pts p) SELECT channel, model, start, count(*) AS calls, CAST(sum(call_id) AS BIGINT) AS ids FROM g WHERE start IS NOT NULL GROUP BY 1, 2, 3""",
    "cost_apportion": """WITH c AS (SELECT l_orderkey AS key, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS call_id, CASE WHEN l_orderkey % 9 > 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS tokens FROM lineitem),
      t AS (SELECT key, sum(tokens) AS s, count(*) AS n FROM c GROUP BY key) SELECT c.key, call_id, floor(CASE WHEN s > 0 THEN o_totalprice * tokens / s ELSE o_totalprice / n END * 1e6 + 0.5) / 1e6 AS usd FROM c JOIN t USING (key) JOIN orders ON o_orderkey = c.key""",
    "sibling_chain_watermark": f"""WITH {_SPANS}, m AS (SELECT a.parent, a.span_id, a.start, b.span_id AS tail, b.stop, row_number() OVER (PARTITION BY a.parent, a.span_id ORDER BY b.stop DESC NULLS LAST, b.start DESC, b.span_id DESC) AS n
      FROM spans a LEFT JOIN spans b ON a.parent = b.parent AND (b.start, b.span_id) < (a.start, a.span_id))
      SELECT parent, span_id, CASE WHEN start >= stop THEN tail END AS tail_id, coalesce(start >= stop, false) AS chained FROM m WHERE n = 1""",
    "sibling_chain": f"WITH {_SPANS} SELECT parent, span_id, lag(span_id) OVER (PARTITION BY parent ORDER BY start, span_id) AS previous_id FROM spans",
    "nearest_kept_ancestor": """WITH RECURSIVE s AS (SELECT l_orderkey AS trace, CAST(l_linenumber AS BIGINT) AS span_id, max(l_returnflag) = 'N' AS kept FROM lineitem GROUP BY 1, 2),
      up AS (SELECT trace, span_id, CASE WHEN span_id > 1 THEN span_id // 2 END AS up_id FROM s
        UNION ALL SELECT u.trace, u.span_id, CASE WHEN u.up_id > 1 THEN u.up_id // 2 END FROM up u JOIN s ON s.trace = u.trace AND s.span_id = u.up_id AND NOT s.kept WHERE u.up_id IS NOT NULL)
      SELECT s.trace, s.span_id, max(up.up_id) AS ancestor FROM s LEFT JOIN up ON up.trace = s.trace AND up.span_id = s.span_id AND EXISTS (SELECT 1 FROM s k WHERE k.trace = up.trace AND k.span_id = up.up_id AND k.kept) GROUP BY 1, 2""",
    "price_estimate": """WITH p AS (SELECT p_type AS model, min(p_retailprice) / 1000 AS i, max(p_retailprice) / 1000 AS o FROM part GROUP BY 1)
      SELECT p_partkey, round(CASE WHEN p_partkey % 3 > 0 OR p_partkey % 2 > 0 THEN CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 0 END * i + CASE WHEN p_partkey % 2 > 0 THEN p_size ELSE 0 END * o END, 4) AS estimated_usd
      FROM part LEFT JOIN p ON p.model = p_type AND p_partkey % 5 > 0""",
    "hash_spec_guard": "SELECT CAST(count(*) > 0 AS BIGINT) AS hash_specs, CAST(0 AS BIGINT) AS similarity_specs FROM events",
    "sessions_detected": "SELECT user_id, bool_or(event_type LIKE 'sign%') AS has_signup, bool_or(event_type = 'error') AS has_error, bool_and(event_type IN ('view', 'click', 'purchase')) AS only_calls FROM events GROUP BY user_id",
}
