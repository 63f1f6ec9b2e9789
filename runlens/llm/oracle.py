"""DuckDB SQL of the registered queries, written from the result's definition and not from the operator's method."""

from __future__ import annotations

#: Words: maximal runs of characters other than space and 0x09-0x0D.
_WORDS = r"[w FOR w IN string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+') IF w <> '']"

ORACLE = {
    "op2_near_duplicates": rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM doc)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS c FROM documents
  UNION SELECT link.y, reach.c FROM reach JOIN link ON link.x = reach.x
), comp AS (SELECT x, min(c) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN comp ON comp.x = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
""",
    "op6_exact_duplicates": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
best AS (SELECT norm, arg_min(doc_id, (-length(text), doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN best USING (norm)
""",
    "op3_quality_rules": rf"""
WITH doc AS (
  SELECT doc_id, source, text, {_WORDS.format("text")} AS w, [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM documents
), base AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM doc
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc)
), twice AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM twice GROUP BY doc_id
), raw AS (
  SELECT doc_id, source, unnest(lines) AS l, unnest(range(len(lines))) AS i FROM doc
), norm AS (
  SELECT doc_id, source, i, md5(array_to_string({_WORDS.format("l")}, ' '))[:16] AS line, len({_WORDS.format("l")}) AS k FROM raw
), held AS (
  SELECT doc_id, source, line, sum(k) AS words FROM norm GROUP BY ALL
), host AS (SELECT source, count(*) AS host_docs FROM documents GROUP BY source
), freq AS (
  SELECT source, line FROM held JOIN host USING (source) GROUP BY source, line, host_docs HAVING count(*) > 10 AND (count(*) > 0.01 * host_docs OR count(*) > 100)
), occ AS (SELECT held.* FROM held JOIN freq USING (source, line)
), flag AS (
  SELECT norm.*, freq.line IS NOT NULL AS hit, count(*) FILTER (freq.line IS NULL) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM norm LEFT JOIN freq USING (source, line)
), inside AS (
  SELECT doc_id, sum(greatest(k - 4, 0)) AS shingles FROM (SELECT doc_id, run, sum(k) AS k FROM flag WHERE hit GROUP BY doc_id, run) GROUP BY doc_id
), copies AS (
  SELECT doc_id FROM inside JOIN base USING (doc_id) WHERE shingles >= 6 / 7 * greatest(n_words - 4, 1)
), other AS (
  SELECT o.*, c.doc_id IS NOT NULL AS copy, coalesce((SELECT min(x.line) FROM occ x WHERE x.doc_id = o.doc_id AND x.line <> o.line), o.line) AS least FROM occ o LEFT JOIN copies c USING (doc_id)
), boiler AS (
  SELECT source, line FROM (SELECT source, line, CASE WHEN copy THEN 'g' || least ELSE 'd' || doc_id END AS voter FROM other) JOIN host USING (source)
  GROUP BY source, line, host_docs HAVING count(DISTINCT voter) > 10 AND (count(DISTINCT voter) > 0.01 * host_docs OR count(DISTINCT voter) > 100)
), gone AS (SELECT doc_id, sum(words) AS removed FROM occ JOIN boiler USING (source, line) GROUP BY doc_id
), v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words - n_removed_words < 0.3 * n_words AS depleted,
  NOT base_failed AND n_words - n_removed_words >= 0.3 * n_words AS kept
FROM v
""",
    "op10_repeated_passages": rf"""
WITH doc AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id
), word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM doc
), gone AS (
  SELECT word.doc_id, word.p, last.i IS NOT NULL AND word.p < last.i + 50 AS removed, t
  FROM word ASOF LEFT JOIN hit AS last ON last.doc_id = word.doc_id AND last.i <= word.p
), cut AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(t, ' ' ORDER BY p) FILTER (NOT removed), '') AS kept FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN cut USING (doc_id)
""",
    "op8_url_filter": r"""
WITH rules(host, path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS p FROM pages),
s AS (SELECT page_id, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path FROM u),
fit AS (
  SELECT s.*, r.host || r.path AS rule, r.v FROM s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE enc AS (
  SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS size, coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS other,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    list_reduce(list_concat([4294967295], [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda crc, byte:
      list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS state
  FROM documents
), doc AS (
  SELECT doc_id, lang, sha256(head || size || body) AS leaf, CASE WHEN doc_id IS NOT NULL AND xor(state, 4294967295) % 7 = 0 THEN sha256(head || other || body) END AS tampered FROM enc
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM doc
), up AS (
  SELECT lang, 0 AS level, k, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaf
  UNION ALL
  SELECT lang, level + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, k // 2, n
), sub AS (
  SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM up WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS k, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT level + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, k // 2, n
), node AS (
  SELECT lang, level, k, h FROM up WHERE n > 1
), step AS (
  SELECT l.doc_id, l.lang, l.k, l.leaf, u.level, u.h, (l.k >> u.level) & 1 AS odd
  FROM leaf l JOIN node u ON u.lang IS NOT DISTINCT FROM l.lang AND u.k = xor(l.k >> u.level, 1)
), sides AS (
  SELECT lang, k, list(CASE WHEN odd = 1 THEN h || '|' ELSE '|' || h END ORDER BY level) AS s, list(level ORDER BY level) AS levels FROM step GROUP BY lang, k
), top AS (
  SELECT s.place, list(CASE WHEN (s.place >> o.level) & 1 = 1 THEN o.h || '|' ELSE '|' || o.h END ORDER BY o.level) AS s, list(o.level ORDER BY o.level) AS levels
  FROM sub s JOIN upper o ON o.n > 1 AND o.k = xor(s.place >> o.level, 1) GROUP BY s.place
), proof AS (
  SELECT l.doc_id, l.leaf, l.tampered, b.subroot, (SELECT h FROM upper WHERE n = 1) AS root,
    [coalesce(d.s[list_position(d.levels, i)], '|') FOR i IN range(b.height)] || [coalesce(t.s[list_position(t.levels, i)], '|') FOR i IN range((SELECT max(level) FROM upper))] AS sides
  FROM leaf l JOIN sub b ON b.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN sides d ON d.lang IS NOT DISTINCT FROM l.lang AND d.k = l.k LEFT JOIN top t ON t.place = b.place
), folded AS (
  SELECT *, sha256(replace(array_to_string(sides, ''), '|', '')) AS proof_sha256,
    list_reduce(list_concat([coalesce(tampered, leaf)], sides), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM proof
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, md5(text) AS tie, regexp_replace(text, '([<\[])(\\*(?:(?:s|/s|unk|\|im_start\||\|im_end\||\|endoftext\||\|startoftext\|)>|/?INST\]))', '\1\\\2', 'g') AS written FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, tie) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(written) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
