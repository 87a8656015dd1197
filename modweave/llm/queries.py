"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from modweave.llm.chat import op7_chat_format
from modweave.llm.fingerprints import op6_fingerprints
from modweave.llm.html import op4_html_extraction
from modweave.llm.line_dedup import op2_line_dedup
from modweave.llm.mixing import op3_mixing
from modweave.llm.near_dups import op9_near_duplicates
from modweave.llm.packing import op8_packing
from modweave.llm.quality import op10_host_quality
from modweave.llm.sharding import op5_sharding
from modweave.llm.tokens import op1_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_line_dedup, op3_mixing, op4_html_extraction, op5_sharding, op6_fingerprints,
        op7_chat_format, op8_packing, op9_near_duplicates, op10_host_quality,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(14 + length(role) + len(regexp_extract_all(role, '\\|:|###|</turn>')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_QUALITY = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 50 * n_words) AS f FROM b GROUP BY host),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, max(n) AS most FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(most, greatest(m * (1 - m) / v - 1, 1e-6)) ELSE most END AS k FROM p),
o AS (SELECT host, (f + m * k) / (n + k) <= 0.5 AS host_ok FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_ok FROM b JOIN o ON o.host IS NOT DISTINCT FROM b.host"""

_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = w.doc_id"""

#: The others have no SQL form (tokenizers, hash rings, schedules, suffix arrays, trained models); tests hold them
#: against brute force, round trips or held-out pages.
SQL: dict[str, str] = {"op7_chat_format": _CHAT, "op9_near_duplicates": _NEAR, "op10_host_quality": _QUALITY}
