"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Each kind: its pattern, the group of its value, its least length.  Bare tokens are whole runs of their characters that hold a digit.
_SECRETS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("owned", "[A-Za-z0-9+/_-]+", 0, 24),
)


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: matches and the pieces between them alternate, so running sums of their lengths give the starts."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, pos, pos + length(m) AS until, v FROM (
        SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS pos FROM (
          SELECT doc_id, source, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p FROM (
            SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS ps FROM d))) WHERE length(v) >= {least}"""


_EVERY_SPAN = " UNION ALL ".join(_spans(rank, *kind) for rank, kind in enumerate(_SECRETS))
_SHOWN = "string_agg(kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(until AS BIGINT), ',' ORDER BY pos, rank, until)"


def _kmeans(rounds: int = 3) -> str:
    """Rounds unrolled; sums by component, floors by the exact remainder."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    parts = [
        """kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v LIMIT 16)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT id, vec_id, v, cluster, d FROM (SELECT id, vec_id, v, unnest(best, recursive := true) FROM (SELECT id, vec_id, v, min({{'d': CAST({far} AS BIGINT), 'cluster': cluster}}) AS best FROM kept CROSS JOIN c{i} GROUP BY ALL)))")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY cluster, i)")
            parts.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


SQL: dict[str, str] = {
    "op7_secret_scans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS source FROM documents), every AS ({_EVERY_SPAN}),
      base AS (SELECT * FROM every WHERE rank < 3), bare AS (SELECT * FROM every WHERE rank = 3 AND regexp_matches(v, '[0-9]')),
      clear AS (SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.doc_id = b.doc_id AND s.pos < b.until AND b.pos < s.until)),
      both_kinds AS (SELECT * FROM base UNION ALL SELECT * FROM clear), held AS (SELECT v, count(DISTINCT source) AS owners FROM both_kinds GROUP BY v),
      judged AS (SELECT k.*, owners <= 2 AS live FROM both_kinds k JOIN held USING (v) WHERE rank < 3 OR owners <= 2),
      counts AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (live) AS n_live, {_SHOWN} AS spans,
        string_agg(CASE WHEN rank < 3 THEN kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(until AS BIGINT) END, ',' ORDER BY pos, rank, until) AS base FROM judged GROUP BY doc_id)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN counts USING (doc_id)""",
    "op2_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
      both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x),
      c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
      SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op6_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
      win AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w),
      hashed AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM win),
      firsts AS (SELECT g, min((doc_id, p)) AS f FROM hashed GROUP BY g HAVING count(*) > 1),
      covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM hashed JOIN firsts USING (g) WHERE (doc_id, p) <> f),
      each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
      SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_chat_formatting": r"""WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
      c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN {'t': turn, 'r': role, 'x': text} END)
      SELECT conv_id, len(l) AS n_turns, array_to_string(list_transform(l, lambda m: '<|' || coalesce(m.r, '') || '|>' || chr(10) || coalesce(m.x, '') || chr(10) || '<|end|>' || chr(10)), '') AS rendered FROM c
      WHERE NOT EXISTS (SELECT 1 FROM c d WHERE len(d.l) > len(c.l) AND d.l[1:len(c.l)] = c.l) AND NOT EXISTS (SELECT 1 FROM c e WHERE e.l = c.l AND e.conv_id < c.conv_id)""",
    "op12_centroids": _kmeans(),
    "op13_collocations": rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
      f AS (SELECT lang, w[i:i + k - 1] AS p, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
      n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
      c AS (SELECT * FROM f WHERE len(p) >= 2 AND a >= 30),
      cut AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, CAST(floor(2000000::HUGEINT * c.a // (x.a + y.a)) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
      s AS (SELECT lang, p, a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, k)) AS b FROM cut GROUP BY ALL),
      inner_ones AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM (SELECT *, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS m FROM c)) GROUP BY ALL),
      t AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score FROM s LEFT JOIN inner_ones USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
      o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
      SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
    "op11_suffix_dedup": """WITH b AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
      win AS (SELECT id, p, md5(array_slice(b, p, p + 199)) AS g FROM (SELECT id, b, unnest(range(1, octet_length(b) - 198)) AS p FROM b)),
      again AS (SELECT id, p FROM win JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
      edges AS (SELECT id, p, coalesce(p > lag(p) OVER o + 200, true) AS new FROM again WINDOW o AS (PARTITION BY id ORDER BY p)),
      runs AS (SELECT id, min(p) AS a, max(p) + 199 AS z FROM (SELECT id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY id ORDER BY p) AS r FROM edges) GROUP BY id, r),
      kept AS (SELECT id, a, lag(z, 1, 0) OVER (PARTITION BY id ORDER BY a) AS from_, z FROM runs),
      gone AS (SELECT id, sum(z - a + 1) AS n, count(*) AS spans, max(z) AS last, list(array_slice(b, from_ + 1, a - 1) ORDER BY a) AS parts FROM kept JOIN b USING (id) GROUP BY id)
      SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
        sha256(unhex(CASE WHEN n IS NULL THEN hex(b) ELSE array_to_string(list_transform(parts, lambda x: hex(x)), '') || hex(array_slice(b, last + 1, octet_length(b))) END)) AS kept_sha256 FROM b LEFT JOIN gone USING (id)""",
}
