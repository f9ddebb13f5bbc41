"""DuckDB SQL for the corpus queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from lixora.llm import licenses, secrets


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Sets of 4-word shingles, all pairs that share one, and the closure of the links.
JACCARD = r"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::UBIGINT[] WHEN len(w) < 4 THEN [hash(array_to_string(w, chr(1)))]
    ELSE list_sort(list_distinct([hash(concat_ws(chr(1), w[i], w[i + 1], w[i + 2], w[i + 3])) FOR i IN range(1, len(w) - 2)])) END AS s FROM docs),
nodes AS (SELECT s, row_number() OVER () AS node, len(s) AS size FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0) x),
members AS (SELECT node, size, unnest(s) AS h FROM nodes),
pairs AS (SELECT a.node AS x, b.node AS y, a.size + b.size AS total, count(*) AS shared FROM members a JOIN members b ON a.h = b.h AND a.node < b.node GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
named AS (SELECT x AS node, min(y) AS class FROM reach GROUP BY 1),
rows AS (SELECT r, doc_id, len(sets.s) AS n_shingles, class FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN named USING (node))
SELECT doc_id, n_shingles::BIGINT AS n_shingles, CASE WHEN class IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY class) END AS component_id,
    CASE WHEN class IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY class) END AS n_same FROM rows"""

#: The turns themselves, and the length of their rendered form.
CHAT = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT *, length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|\[/?SYS\]|\[TURN |\[/TURN\])', '\1\\\2', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 13
    ELSE 16 + length(regexp_replace(role, '([\\\[\]<>])', '\\\1', 'g')) END AS size FROM rows),
whole AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, 3 + sum(size) AS formatted_chars FROM turns GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM whole"""

_TEMPLATES = ", ".join(f"({i}, {text(a)}, {text(t)})" for i, (a, t) in enumerate(licenses.TEMPLATES))
_WORDS = "string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"
_GRAMS = "[concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) FOR i IN range(1, len(w) - 3)]"

#: The containment of every template in every window of its class; no MinHash.
LICENSES = f"""WITH templates AS (SELECT id AS template_id, license, {_WORDS.format('t')} AS w FROM (VALUES {_TEMPLATES}) x(id, license, t)),
grams AS (SELECT template_id, license, pow(2, ceil(log2(len(w) - 4)) + 1)::BIGINT AS width, unnest(list_distinct({_GRAMS})) AS gram FROM templates),
sizes AS (SELECT template_id, count(*) AS size FROM grams GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
places AS (SELECT r, doc_id, unnest(range(1, len(w) - 3)) AS spot, unnest({_GRAMS}) AS gram FROM docs),
hits AS (SELECT r, doc_id, spot - 1 AS spot, gram, template_id, license, width, (spot - 1) // (width // 2) AS own FROM places JOIN grams USING (gram)),
windows AS (SELECT *, own AS win FROM hits UNION ALL SELECT *, own - 1 FROM hits WHERE own > 0),
held AS (SELECT r, doc_id, template_id, license, win, count(DISTINCT gram) AS n, min(spot) AS first_word FROM windows GROUP BY ALL),
found AS (SELECT r, doc_id, license, template_id, max(n / size) AS containment, min(first_word) AS first_word FROM held JOIN sizes USING (template_id) WHERE n / size >= 0.8 GROUP BY ALL)
SELECT doc_id, license, template_id::BIGINT AS template_id, containment, first_word::INTEGER AS first_word, rank() OVER (PARTITION BY r, first_word ORDER BY containment DESC)::INTEGER AS rank FROM found"""


def _kind(rank: int, kind: str) -> str:
    pattern, part = secrets.PATTERNS[kind]
    p = text(pattern)
    name = {
        "assign": f"CASE WHEN length(regexp_extract(m, {p}, 2)) >= 12 THEN 'assign' WHEN length(regexp_extract(m, {p}, 2)) >= 6 THEN 'weak_secret' END",
        "access": "CASE WHEN length(m) >= 18 THEN 'access' ELSE 'weak_access' END",
        "user": "'weak_access'",
    }.get(kind, text(kind))
    return f"""SELECT r, {rank} AS rank, '{part}' AS part, {name} AS kind, size, sum(gap + size) OVER (PARTITION BY r ORDER BY i) AS stop
  FROM (SELECT r, i, found[i] AS m, length(found[i]) AS size, length(gaps[i]) AS gap FROM (SELECT r, found, gaps, unnest(range(1, len(found) + 1)) AS i
    FROM (SELECT r, regexp_extract_all(t, {p}) AS found, string_split_regex(t, {p}) AS gaps FROM docs) a) b) c"""


#: All matches by the text between them, and a look for each weak one's complement among all others.
SECRETS = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({' UNION ALL '.join(_kind(rank, kind) for rank, kind in enumerate(secrets.PATTERNS))}),
spans AS (SELECT r, rank, part, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM matches WHERE kind IS NOT NULL),
kept AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM spans s WHERE kind IN ('assign', 'access', 'hex') OR EXISTS (SELECT 1 FROM spans o
    WHERE o.r = s.r AND (s.part = 'secret' AND o.part IN ('access', 'endpoint') OR s.part IN ('access', 'endpoint') AND o.part = 'secret') AND o.stop >= s.start - 200 AND o.start <= s.stop + 200))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
  FROM docs LEFT JOIN kept USING (r) GROUP BY r"""

#: Base32 of the SHA-1: 5 hex digits at a time are 4 of base32.
_BASE32 = " || ".join(f"to_base(('0x' || substr(hexed, {1 + 5 * k}, 5))::BIGINT, 32, 4)" for k in range(8))
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hexed, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""


def _round(i: int) -> str:
    """Vectors by their nearest centroid of round i, and the centroids after it."""
    return f"""near{i} AS (SELECT r, vec_id, v, arg_min({{'c': c, 'd': d}}, (d, c)) AS best FROM (SELECT r, vec_id, v, c, list_sum([(v[j] - m[j]) * (v[j] - m[j]) FOR j IN range(1, 65)])::BIGINT AS d FROM kept CROSS JOIN c{i}) x GROUP BY ALL),
sums{i} AS (SELECT best.c AS c, j, sum(v[j]) AS s, count(*)::HUGEINT AS n FROM near{i}, range(1, 65) x(j) GROUP BY ALL),
means{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM sums{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(means{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN means{i} USING (c))"""


#: Every vector with every centroid.
CENTROIDS = f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])),
first AS (SELECT v, sha256('1:' || vec_id) AS name FROM kept ORDER BY name NULLS LAST, v LIMIT 16),
c0 AS (SELECT row_number() OVER (ORDER BY name NULLS LAST, v) - 1 AS c, v AS m FROM first),
{", ".join(map(_round, range(4)))},
placed AS (SELECT vec_id, best.c AS c, best.d AS d FROM near3)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM placed JOIN c3 USING (c)"""

#: What the article elements of the given pages hold; these pages use few character references, some without a semicolon.
HTML = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

#: Filter by filter, for every order, from the documents themselves.
FILTERS = r"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
fails AS (SELECT r, doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f FROM words),
says AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
known AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN says USING (doc_id) GROUP BY ALL),
orders AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, 15 - a.i - b.i - c.i - d.i AS e FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i])) = 4),
steps AS (SELECT array_to_string(['ABCDE'[i] FOR i IN [a, b, c, d, e]], '') AS filter_order, s AS step, [a, b, c, d, e] AS o FROM orders, range(1, 6) x(s)),
seen AS (SELECT part, filter_order, step, o[step] AS own, good, toxic, n, f[o[step]] AS failing, list_bool_or([false] || [f[i] FOR i IN o[1:step - 1]]) AS gone, len([1 FOR x IN f IF x]) AS n_fails FROM known, steps),
counts AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts"""

ORACLES = {
    "op3_ngram_jaccard_join": JACCARD,
    "op5_chat_formatting": CHAT,
    "op8_license_scans": LICENSES,
    "op9_secret_scans": SECRETS,
    "op10_warc": WARC,
    "op11_centroid_clustering": CENTROIDS,
    "op12_html_extraction": HTML,
    "op13_filter_interaction_audit": FILTERS,
}
