"""The same results in DuckDB SQL, where SQL can say them; written for small tables."""

from loomlake.llm.quality import BOILERPLATE, MARKS, UNMARKED

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"
_MIX = """
WITH sized AS (
  SELECT doc_id, source, len({words}) AS size, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sized GROUP BY source
), weighted AS (SELECT *, [5, 2, 1][(sid % 3 + 1)::INT] AS w FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * coalesce(sum(s) OVER (ORDER BY s::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY s::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), top AS (SELECT min_by(level, s::DOUBLE / w) AS level FROM levels WHERE 2.0::DOUBLE * s / w >= level
), plan AS (
  SELECT source, s, coalesce(least(top.level * w, 2.0::DOUBLE * s), 2.0::DOUBLE * s) AS target FROM levels, top
), cut AS (
  SELECT doc_id, size, s, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (CASE WHEN s > 0 THEN budget // s * size + greatest(0, least(size, budget % s - before)) ELSE 0 END)::BIGINT AS taken
FROM cut
""".replace("{words}", _WORDS)

_SUBSTRING = """
WITH w AS (SELECT doc_id, {words} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t FROM w, unnest(range(1, len(ws) - 18)) AS u(i) WHERE len(ws) >= 20
), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS rn FROM windows) WHERE rn > 1
), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(0, 20) AS r(j)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM (
    SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""".replace("{words}", _WORDS)

_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0
), occ AS (
  SELECT doc_id, i, n, item_id FROM (
    SELECT doc_id, i, s.n, array_to_string(ws[i:i + s.n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(ws) - s.n + 2)) AS u(i) WHERE len(ws) >= s.n
  ) x JOIN win USING (n, t)
), hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, unnest(range(0, n)) AS r(j) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LINES = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \t-\r]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord
  FROM raw WHERE regexp_matches(line, '[^ \t-\r]')
), runs AS (
  SELECT a.doc_id, a.ord, m, string_agg(b.line, chr(10) ORDER BY b.ord) AS t FROM l a, range(1, 11) AS r(m), l b
  WHERE b.doc_id = a.doc_id AND b.ord BETWEEN a.ord AND a.ord + m - 1 GROUP BY a.doc_id, a.ord, m HAVING sum(b.n) >= 10 AND count(*) = m
), later AS (SELECT doc_id, ord, m FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY doc_id, ord) AS rn FROM runs) WHERE rn > 1
), gone AS (SELECT DISTINCT later.doc_id, l.pos FROM later JOIN l ON l.doc_id = later.doc_id AND l.ord BETWEEN later.ord AND later.ord + m - 1
), kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) a USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""

_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS t
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

_FAILS = r"""len(ws) > 0 AND (
    len(list_filter(ws, lambda x: x LIKE '%!!')) * 2 >= len(ws)
    OR (NOT regexp_matches(line, '[{marks}]') AND len(ws) >= 8)
    OR len(list_filter(ws, lambda x: x IN ('|', '»', '›', '·', '•'))) >= 3
    OR regexp_matches(lower(line), '{phrases}')
    OR (length(line) - length(translate(line, '#*$%&|<>', ''))) * 2 >= len(ws)
    OR (len(ws) >= 16 AND len(list_distinct(ws)) * 4 < len(ws)))""".replace("{phrases}", "|".join(BOILERPLATE)).replace("{marks}", MARKS + UNMARKED)

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents
), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (SELECT doc_id, line, regexp_extract_all(line, '[^ \t-\r]+') AS ws FROM l
), judged AS (
  SELECT doc_id, line, len(ws) AS n, {fails} AS fails FROM lw
), lines AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS dups, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY doc_id
), win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS c FROM d, unnest(range(1, len(ws) - 3)) AS u(i) WHERE len(ws) >= 5
), rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(0, 5) AS r(j) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    dups::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, lost FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * n_words AS kept FROM m
""".replace("{fails}", _FAILS)

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM c
), w AS (
  SELECT *, len(regexp_extract_all(text, '[^ \t-\r]+')) + 4 AS cost, i = 1 AND role = 'system' AS sys,
    length('### ' || replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '\#\#\#'), ':', '\:') || ': ' || replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\#\#\#') || '</turn>' || chr(10)) AS chars FROM r
), l AS (SELECT conv_id, max(cost) FILTER (sys) AS lead, max(chars) FILTER (sys) AS lead_chars FROM w GROUP BY conv_id
), p AS (SELECT w.*, CASE WHEN sys THEN 0 ELSE cost END AS t, 512 - coalesce(lead, 0) AS room, lead IS NOT NULL AS led, lead_chars FROM w JOIN l USING (conv_id)
), q AS (SELECT *, greatest(room - 128, floor(room / 2.0)::BIGINT, 1) AS cell, coalesce(sum(t) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM p
), s AS (SELECT *, b // cell AS here, (b + t) // cell AS there, b + t > (b // cell + 1) * cell AS x FROM q
), cells AS (SELECT conv_id, here, coalesce(sum(t) FILTER (NOT x), 0) AS own, max(t) FILTER (x) AS out, any_value(cell) AS cell FROM s GROUP BY 1, 2
), f AS (SELECT *, coalesce(own > 0 AND own + out <= cell, false) AS takes FROM cells
), g AS (SELECT *, own + CASE WHEN takes THEN out ELSE 0 END AS total FROM f
), a AS (
  SELECT s.*, CASE WHEN NOT x OR m.takes THEN 2 * s.here + 1 WHEN n.own > 0 AND n.total + t <= s.cell THEN 2 * s.there + 1 ELSE 2 * s.here + 2 END AS w
  FROM s LEFT JOIN g m ON m.conv_id = s.conv_id AND m.here = s.here LEFT JOIN g n ON n.conv_id = s.conv_id AND n.here = s.there
), e AS (
  SELECT conv_id, w, min(b) AS begin, greatest(0, least(128, any_value(room) - sum(t))) AS past, any_value(coalesce(lead_chars, 0)) AS lead_chars, bool_or(w = 1 OR (w = 2 AND b = 0 AND NOT led)) AS head FROM a GROUP BY 1, 2
), again AS (
  SELECT e.conv_id, sum(a.chars) AS chars FROM e JOIN a ON a.conv_id = e.conv_id AND NOT a.sys AND a.b >= e.begin - e.past AND a.b < e.begin WHERE NOT head GROUP BY 1
), led AS (SELECT conv_id, sum(lead_chars) AS chars FROM e WHERE NOT head GROUP BY 1
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM w GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (whole.chars + coalesce(again.chars, 0) + coalesce(led.chars, 0))::BIGINT AS formatted_chars
FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN led USING (conv_id)
"""

_MODELS = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents
), t AS (SELECT doc_id, good, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS a, ws[i] AS b FROM d, unnest(range(1, len(ws) + 1)) AS u(i)
), pair AS (SELECT a, b, count(*) AS n0, count(*) FILTER (good) AS n1 FROM t GROUP BY a, b
), word AS (SELECT w, count(*) AS n0, count(*) FILTER (good) AS n1 FROM (SELECT b AS w, good FROM t UNION ALL SELECT '', good FROM d WHERE len(ws) > 0) GROUP BY w
), size AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM word
), loss AS (
  SELECT doc_id, count(*) AS n, avg(-ln((pair.n0 + 50.0::DOUBLE * (y.n0 + 1) / (t0 + v)) / (x.n0 + 50))) AS l0, avg(-ln((pair.n1 + 50.0::DOUBLE * (y.n1 + 1) / (t1 + v)) / (x.n1 + 50))) AS l1
  FROM t JOIN pair USING (a, b) JOIN word x ON x.w = a JOIN word y ON y.w = b, size GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(l1, 6) AS target_loss, round(l0, 6) AS background_loss, round(l1 - l0, 6) AS score FROM d LEFT JOIN loss USING (doc_id)
"""

_WINDOWS = r"""
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0
)"""
#: One cut of all that a benchmark window hits; the texts' words and what lies between them alternate.
_CUT = r"""
WITH k AS (
  SELECT doc_id, part, pos, regexp_matches(part, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS word FROM (
    SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS parts FROM {t}))
), w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lw FROM k WHERE word
), d AS (SELECT doc_id, list(lw ORDER BY i) AS ws FROM w GROUP BY doc_id
), occ AS (
  SELECT doc_id, i, n FROM (
    SELECT doc_id, i, s.n, array_to_string(ws[i:i + s.n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(ws) - s.n + 2)) AS u(i) WHERE len(ws) >= s.n
  ) x JOIN win USING (n, t)
), hit AS (SELECT DISTINCT doc_id, i + j AS i, true AS hit FROM occ, unnest(range(0, n)) AS r(j)
), m AS (SELECT k.doc_id, k.pos, k.part, k.word, coalesce(hit.hit, false) AS hit FROM k LEFT JOIN w USING (doc_id, pos) LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.i = w.i
), g AS (SELECT *, CASE WHEN word THEN hit ELSE coalesce(lag(hit) OVER o, false) AND coalesce(lead(hit) OVER o, false) END AS gone FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), p AS (SELECT *, sum(gone::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS piece FROM g
), q AS (SELECT doc_id, piece, trim(string_agg(part, '' ORDER BY pos), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM p WHERE NOT gone GROUP BY doc_id, piece
), r AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY piece) AS text FROM q WHERE t <> '' GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.doc_id IN (SELECT doc_id FROM occ) THEN coalesce(r.text, '') ELSE t.text END AS text, lang, source FROM {t} t LEFT JOIN r USING (doc_id)
"""
#: Cuts that follow each other; on any text of the tables the second already finds nothing, and one more than that is made.
_CUTS = 3


def _pipeline() -> str:
    """The five stages on tables whose ids are distinct."""
    lines = _LINES.replace("documents", "s1").replace("sha256(coalesce(k.text, '')) AS kept_sha256", "k.text, d.lang, d.source")
    clean = r"""
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fails), '') AS text FROM (
    SELECT doc_id, pos, line, {fails} AS fails FROM (
      SELECT doc_id, line, pos, regexp_extract_all(line, '[^ \t-\r]+') AS ws FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id""".replace("{fails}", _FAILS)
    cuts = ", ".join(f"c{i + 1} AS MATERIALIZED ({_CUT.replace('{t}', f'c{i}')})" for i in range(_CUTS))
    return rf"""
WITH s1 AS MATERIALIZED (
  SELECT d.doc_id, clean.text, lang, source FROM documents d JOIN ({_QUALITY}) q USING (doc_id) JOIN ({clean}) clean USING (doc_id) WHERE q.kept
), s2 AS MATERIALIZED (SELECT doc_id, text, lang, source FROM ({lines}) WHERE n_removed = 0 OR n_removed < n_lines
), c0 AS MATERIALIZED (SELECT s2.* FROM s2 JOIN ({_NEAR.replace("documents", "s2")}) n USING (doc_id) WHERE n.kept
), {_WINDOWS.strip()}, {cuts}, s4 AS MATERIALIZED (
  SELECT c{_CUTS}.* FROM c{_CUTS} JOIN c0 USING (doc_id) WHERE NOT coalesce(regexp_matches(c0.text, '[^ 	-
]'), false) OR regexp_matches(c{_CUTS}.text, '[^ 	-
]')
)
SELECT doc_id, text, lang, source, length(text)::BIGINT AS n_chars, size, taken FROM s4 JOIN ({_MIX.replace("documents", "s4")}) m USING (doc_id) WHERE taken > 0
"""


PIPELINE = _pipeline()


def _lloyd(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after the other."""
    apart = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    nearest = f"SELECT r, vec_id, v, min(struct_pack(d := {apart}, c := c)) AS best FROM kept, {{now}} GROUP BY r, vec_id, v"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(now=f'c{i}')})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(moved, m) AS m FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS moved FROM (
      SELECT best.c AS c, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY 1, 2) GROUP BY c) USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS key, v FROM kept ORDER BY key, v LIMIT {k})
), {", ".join(steps)}, last AS MATERIALIZED ({nearest.format(now=f"c{rounds}")})
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN c{rounds} ON c = best.c
"""


_AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {words} AS ws FROM documents
), fails AS (
  SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w
), marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before FROM orders, letters s
), sums AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS bad, len(list_filter(before, lambda x: f[x])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS alone FROM cells, steps
), per AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM sums GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM per
""".replace("{words}", _WORDS)

ORACLES: dict[str, str] = {
    "op4_chat_format": _CHAT,
    "op6_lm_score": _MODELS,
    "op2_mixing": _MIX,
    "op3_substring_dedup": _SUBSTRING,
    "op5_decontamination": _LEAKS,
    "op8_line_dedup": _LINES,
    "op9_minhash_dedup": _NEAR,
    "op10_quality": _QUALITY,
    "op11_centroid_clustering": _lloyd(),
    "op12_filter_audit": _AUDIT,
}
