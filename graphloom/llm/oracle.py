"""DuckDB SQL for the training-data queries that SQL can express on whole tables.

Fingerprints (XXH64), tokens, k-d trees, a trained network and eigenvectors are beyond SQL: op2, op3, op6, op7, op11, op12 and
the pipeline are tested against brute force, an exact round trip and held-out accuracy in tests/llm instead.
"""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

SPACES = r"[\x20\x09-\x0D]+"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) r(i)),
least_id AS (SELECT h, min(doc_id) AS source FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM win JOIN least_id USING (h) WHERE doc_id > source), unnest(range(i, i + 50)) r(p)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) r(p)),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH raw AS (SELECT doc_id, md5(text) AS h, string_split(text, chr(10)) AS l, {WORDS} AS t FROM documents),
line AS (SELECT doc_id, h, i, l[i] AS s, list_filter(regexp_split_to_array(l[i], '{SPACES}'), lambda x: x <> '') AS t FROM raw, unnest(range(1, len(l) + 1)) r(i)),
parsed AS (SELECT doc_id, h, i, len(t) AS n, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END) AS t FROM line WHERE len(t) > 0),
lines AS (SELECT doc_id, h, i, n, t, n || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS masked, len(list_filter(t, lambda x: x <> '<*>')) AS fixed FROM parsed WHERE fixed > 0),
hot AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(*) >= 10),
near AS (SELECT * FROM lines JOIN hot USING (leaf)),
token AS (SELECT doc_id, i, leaf, p, t[p] AS x FROM near, unnest(range(1, n + 1)) r(p) WHERE t[p] <> '<*>'),
often AS (SELECT leaf, p, x, count(*) AS c FROM token GROUP BY leaf, p, x),
usual AS (SELECT leaf, p, x FROM often QUALIFY row_number() OVER (PARTITION BY leaf, p ORDER BY c DESC, x DESC) = 1),
agree AS (SELECT doc_id, i, count(*) AS m FROM token JOIN usual USING (leaf, p, x) GROUP BY doc_id, i),
named AS (SELECT doc_id, h, i, CASE WHEN 100 * m >= 60 * fixed THEN leaf ELSE leaf || chr(10) || masked END AS template FROM near LEFT JOIN agree USING (doc_id, i)),
long AS (SELECT h, t, list_transform(list_filter(t, lambda x: length(x) >= 8), lambda x: md5(x) || x) AS w FROM (SELECT h, any_value(t) AS t FROM raw WHERE h IS NOT NULL GROUP BY h)),
first AS (SELECT h, t, k, substr(list_min(list_transform(w, lambda x: substr(x, 8 * k + 1))), 33 - 8 * k) AS x FROM long, unnest(range(4)) r(k) WHERE len(w) > 0),
passage AS (SELECT h, k, array_to_string(t[list_position(t, x):list_position(t, x) + 4], ' ') AS x FROM first),
pair AS (SELECT a.h, a.k AS j, b.k, a.x, b.x AS y FROM passage a JOIN passage b ON a.h = b.h AND a.k < b.k),
family AS (SELECT h, min(least) AS f FROM pair JOIN (SELECT j, k, x, y, min(h) AS least FROM pair GROUP BY j, k, x, y) USING (j, k, x, y) GROUP BY h),
again AS (SELECT template FROM named LEFT JOIN family USING (h) GROUP BY template HAVING count(DISTINCT coalesce(f, h)) >= 10 AND 100 * count(DISTINCT coalesce(f, h)) >= 5 * count(DISTINCT h)),
gone AS (SELECT doc_id, i FROM named JOIN again USING (template)),
kept AS (SELECT line.doc_id, count(gone.i) AS n_dropped, string_agg(s, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL) AS t FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id)
SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN l IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256 FROM raw LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""


def _op8() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    kept = " AND ".join(f"{a} >= {lo} * {b} AND {a} <= {hi} * {b}" for a, b, lo, hi in RULES.values())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS v, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM d, unnest(range(1, len(w) - 6)) r(i)),
twice AS (SELECT doc_id, h FROM win GROUP BY doc_id, h HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i FROM win JOIN twice USING (doc_id, h)), unnest(range(i, i + 8)) r(p) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(v) - length(regexp_replace(v, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, length(v) - length(regexp_replace(v, '[!?]', '', 'g')) AS n_loud FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM b
"""


_CONTROL = r"'<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]'"
_ESCAPED = f"length({{x}}) + length({{x}}) - length(replace({{x}}, chr(92), '')) + len(regexp_extract_all({{x}}, {_CONTROL}))"
_SAID = "'</s>[INST] ok [/INST]'"

OP9 = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -1, 0, 'user', {_SAID} UNION ALL SELECT -1, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t)) AS turns_sha256,
 coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 3 + sum({_ESCAPED.format(x='t')} + CASE WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 4 WHEN role IS NULL THEN 19 ELSE 17 + {_ESCAPED.format(x='role')} END) AS formatted_chars
FROM c GROUP BY conv_id
"""

_BARE = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_BARE} AS w FROM documents), b AS (SELECT item_id, {_BARE} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) r(i)),
win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM item), unnest(range(1, len(w) - k + 2)) r(i)),
hit AS (SELECT DISTINCT doc_id, win.k, i, item_id FROM win JOIN item ON win.k = item.k AND win.s = item.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP13 = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // l AS m FROM n, s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op4_line_templates": OP4, "op5_warc": OP5, "op8_quality": _op8(), "op9_chat": OP9, "op10_decontamination": OP10, "op13_ranked_search": OP13}
