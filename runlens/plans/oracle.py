"""Independent DuckDB SQL oracles, one per registered query.

Written against the raw driver tables (pre-registered views), re-deriving each
fixture projection in SQL rather than reusing the Spark code.  Doubles are
rounded to 6 places where the Spark side rounds; lists are emitted as long
form or joined strings; ranks are emitted as columns.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --------------------------------------------------------------- shared fixture CTEs

BASELINE_RUNS = """
baseline_runs AS (
  SELECT event_id AS ordinal, 'proj' || CAST(user_id % 7 AS VARCHAR) AS project,
         CAST(user_id AS VARCHAR) AS class, event_type = 'click' AS success,
         value AS cov, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mut,
         CASE WHEN event_id % 5 = 0 THEN []::VARCHAR[]
              ELSE [CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) || '.java'] END AS test_files
  FROM events
)"""

VALID_RUNS = """
valid_runs AS (
  SELECT event_id AS ordinal, CAST(user_id AS VARCHAR) AS class, value >= 10 AS verified,
         value AS cov, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mut
  FROM events WHERE event_type = 'purchase'
)"""

PAIRED = f"""
{BASELINE_RUNS},
{VALID_RUNS},
last_base AS (
  SELECT class, arg_max(cov, ordinal) AS cov, arg_max(mut, ordinal) AS mut
  FROM baseline_runs WHERE success GROUP BY class
),
paired AS (
  SELECT v.ordinal, v.class,
         CAST(coalesce(b.cov, 0) AS DOUBLE) AS baseline_cov, CAST(coalesce(v.cov, 0) AS DOUBLE) AS valid_cov,
         CAST(coalesce(b.mut, 0) AS DOUBLE) AS baseline_mut, CAST(coalesce(v.mut, 0) AS DOUBLE) AS valid_mut
  FROM valid_runs v JOIN last_base b ON v.class = b.class
  WHERE v.verified
)"""

ORACLE["paired_metrics"] = f"""
WITH {PAIRED}
SELECT * FROM paired
"""

ORACLE["describe_numeric"] = f"""
WITH {PAIRED},
long AS (
  SELECT 'baseline_cov' AS col, baseline_cov AS v FROM paired UNION ALL
  SELECT 'valid_cov', valid_cov FROM paired UNION ALL
  SELECT 'baseline_mut', baseline_mut FROM paired UNION ALL
  SELECT 'valid_mut', valid_mut FROM paired
),
stats AS (
  SELECT col,
         CAST(count(v) AS DOUBLE) AS s0, avg(v) AS s1, stddev_samp(v) AS s2, min(v) AS s3,
         quantile_cont(v, 0.25) AS s4, quantile_cont(v, 0.5) AS s5, quantile_cont(v, 0.75) AS s6, max(v) AS s7
  FROM long GROUP BY col
),
cells AS (
  SELECT col, 'count' AS statistic, 0 AS stat_order, s0 AS v FROM stats UNION ALL
  SELECT col, 'mean', 1, s1 FROM stats UNION ALL
  SELECT col, 'std', 2, s2 FROM stats UNION ALL
  SELECT col, 'min', 3, s3 FROM stats UNION ALL
  SELECT col, '25%', 4, s4 FROM stats UNION ALL
  SELECT col, '50%', 5, s5 FROM stats UNION ALL
  SELECT col, '75%', 6, s6 FROM stats UNION ALL
  SELECT col, 'max', 7, s7 FROM stats
)
SELECT statistic, stat_order,
       round(max(v) FILTER (WHERE col = 'baseline_cov'), 6) AS baseline_cov,
       round(max(v) FILTER (WHERE col = 'valid_cov'), 6) AS valid_cov,
       round(max(v) FILTER (WHERE col = 'baseline_mut'), 6) AS baseline_mut,
       round(max(v) FILTER (WHERE col = 'valid_mut'), 6) AS valid_mut
FROM cells GROUP BY statistic, stat_order
"""

# --------------------------------------------------------------- manifest / listing statistics

MANIFEST = """
manifest AS (
  SELECT doc_id AS ordinal, source AS project,
         CASE WHEN doc_id % 10 = 0 THEN 'Doc' || CAST(doc_id AS VARCHAR)
              ELSE concat_ws('.', lang, source, 'Doc' || CAST(doc_id AS VARCHAR)) END AS class
  FROM documents
)"""

LISTING = """
listing AS (
  SELECT page_id AS ordinal, p AS path, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir,
         CAST(strlen(html) AS BIGINT) AS bytes
  FROM (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)
)"""

LISTING_DOCS = """
listing_docs AS (
  SELECT doc_id AS ordinal, source AS project,
         source || CASE WHEN doc_id % 4 = 0 THEN '/' ELSE '/lib/' END || CAST(doc_id AS VARCHAR) || '.jar' AS path, n_chars AS bytes
  FROM documents
)"""

SOME_JARS = f"""{LISTING_DOCS},
some_jars AS (SELECT * FROM listing_docs WHERE CAST(regexp_extract(project, '([0-9]+)$', 1) AS INTEGER) < 15)"""

ENTRIES = f"""{LISTING},
entries AS (
  SELECT ordinal, CASE WHEN ordinal % 7 = 0 THEN '.' || leaf ELSE leaf END AS name
  FROM (SELECT ordinal, split_part(path, '/', -1) AS leaf FROM listing)
)"""

SFT_PAIRS = """
sft_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

ORACLE["group_lists"] = f"""
WITH {MANIFEST}
SELECT project, row_number() OVER (PARTITION BY project ORDER BY ordinal) AS pos, class FROM manifest
"""

ORACLE["overview_totals"] = f"""
WITH {MANIFEST}
SELECT count(DISTINCT project) AS n_groups, count(*) AS n_rows FROM manifest
"""

ORACLE["group_size_stats"] = f"""
WITH {MANIFEST}, sizes AS (SELECT project, count(*) AS n FROM manifest GROUP BY project)
SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 1) AS mean_size FROM sizes
"""

ORACLE["top_segments"] = f"""
WITH {MANIFEST},
seg AS (SELECT CASE WHEN contains(class, '.') THEN split_part(class, '.', 1) ELSE 'default' END AS segment, ordinal FROM manifest),
c AS (SELECT segment, count(*) AS n, min(ordinal) AS first_seen FROM seg GROUP BY segment)
SELECT segment, n, row_number() OVER (ORDER BY n DESC, first_seen) AS rank
FROM c ORDER BY n DESC, first_seen LIMIT 10
"""

ORACLE["size_stats"] = f"""
WITH {LISTING}
SELECT count(bytes) AS n_files, round(sum(bytes / 1048576.0), 2) AS total_mb, round(avg(bytes / 1048576.0), 2) AS mean_mb,
       round(min(bytes / 1048576.0), 2) AS min_mb, round(max(bytes / 1048576.0), 2) AS max_mb
FROM listing
"""

ORACLE["listing_rollup"] = f"""
WITH {LISTING}
SELECT dir, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS total_bytes,
       count(*) FILTER (WHERE ends_with(path, '.html')) AS n_html
FROM listing GROUP BY dir
"""

ORACLE["project_counts"] = f"""
WITH {MANIFEST}, {SOME_JARS},
a AS (SELECT project, count(*) AS n_classes FROM manifest GROUP BY project),
b AS (SELECT project, count(*) AS n_jars FROM some_jars GROUP BY project)
SELECT a.project, a.n_classes, CAST(coalesce(b.n_jars, 0) AS BIGINT) AS n_jars FROM a LEFT JOIN b USING (project)
"""

ORACLE["groups_by_size"] = f"""
WITH {MANIFEST},
g AS (SELECT project, count(*) AS n, min(ordinal) AS first_seen FROM manifest GROUP BY project)
SELECT project, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM g
"""

ORACLE["largest_files"] = f"""
WITH {LISTING}
SELECT *, row_number() OVER (ORDER BY bytes DESC, path, ordinal) AS rank
FROM listing ORDER BY bytes DESC, path, ordinal LIMIT 10
"""

ORACLE["head_groups"] = f"""
WITH {MANIFEST},
g AS (SELECT project, count(*) AS n FROM manifest GROUP BY project)
SELECT project, n, row_number() OVER (ORDER BY project) AS rank,
       greatest((SELECT count(*) FROM g) - 5, 0) AS remaining
FROM g ORDER BY project LIMIT 5
"""

ORACLE["limit_input"] = f"""
WITH {MANIFEST}
SELECT * FROM manifest ORDER BY ordinal LIMIT 25
"""

ORACLE["latest_name"] = f"""
WITH {LISTING}
SELECT coalesce(max(path) FILTER (WHERE regexp_matches(path, '/en/[0-9]+\\.html$')), 'none') AS latest,
       coalesce(max(path) FILTER (WHERE regexp_matches(path, 'zz-[0-9.]+\\.jar$')), 'none') AS latest_missing
FROM listing
"""

ORACLE["row_at"] = f"""
WITH {SFT_PAIRS}
SELECT * FROM sft_pairs ORDER BY conv_id, turn LIMIT 1 OFFSET 5
"""

ORACLE["union_listings"] = f"""
WITH {LISTING}, {LISTING_DOCS}
SELECT 'pages' AS source, path AS rel_path, bytes FROM listing
UNION ALL
SELECT 'jars', path, bytes FROM listing_docs
"""

ORACLE["distinct_projects"] = f"""
WITH {MANIFEST}
SELECT DISTINCT project FROM manifest
"""

ORACLE["first_k_per_group"] = f"""
WITH {MANIFEST}
SELECT *, row_number() OVER (PARTITION BY project ORDER BY ordinal) AS rank
FROM manifest QUALIFY rank <= 3
"""

ORACLE["latest_per_key"] = f"""
WITH {BASELINE_RUNS}
SELECT class, max(ordinal) AS ordinal, arg_max(project, ordinal) AS project, arg_max(success, ordinal) AS success,
       arg_max(cov, ordinal) AS cov, arg_max(mut, ordinal) AS mut
FROM baseline_runs GROUP BY class
"""

ORACLE["position_in_group"] = f"""
WITH {MANIFEST}
SELECT *, row_number() OVER (PARTITION BY project ORDER BY ordinal) AS pos,
       count(*) OVER (PARTITION BY project) AS n
FROM manifest
"""

ORACLE["leading_digit"] = f"""
WITH {ENTRIES}
SELECT ordinal, name FROM entries WHERE regexp_matches(name, '^[0-9]')
"""

ORACLE["suffix_count"] = f"""
WITH {LISTING}
SELECT count(*) FILTER (WHERE ends_with(path, '.html')) AS n_html FROM listing
"""

ORACLE["visible_entries"] = f"""
WITH {ENTRIES}
SELECT ordinal, name, row_number() OVER (ORDER BY name, ordinal) AS name_rank
FROM entries WHERE NOT starts_with(name, '.')
"""

ORACLE["format_rows"] = f"""
WITH {MANIFEST}
SELECT project, printf('%-25s - %3d classes', project, count(*)) AS line FROM manifest GROUP BY project
"""

ORACLE["sample_groups"] = f"""
WITH {MANIFEST},
wanted(list_pos, project) AS (VALUES (0, 'src3'), (1, 'src1'), (2, 'none'), (3, 'src12'))
SELECT m.project, m.ordinal, m.class, w.list_pos,
       row_number() OVER (PARTITION BY m.project ORDER BY m.ordinal) AS rank
FROM manifest m JOIN wanted w USING (project)
QUALIFY rank <= 3
"""

# --------------------------------------------------------------- run records

VERDICTS = """
verdicts AS (
  SELECT doc_id, doc_id % 7 <> 0 AS refined_ok, doc_id % 11 <> 0 AS original_ok,
         quality = 1 AS orig_passed, toxic = 0 AS ref_passed
  FROM labels
),
judged AS (
  SELECT *,
    CASE WHEN NOT refined_ok THEN 'Compilation failed'
         WHEN NOT original_ok THEN 'Original compilation failed'
         WHEN orig_passed AND ref_passed THEN 'Preserved (Pass)'
         WHEN NOT orig_passed AND NOT ref_passed THEN 'Preserved (Fail)'
         WHEN orig_passed AND NOT ref_passed THEN 'Regression'
         ELSE 'Fix (Unexpected)' END AS reason,
    refined_ok AND original_ok AND orig_passed = ref_passed AS valid
  FROM verdicts
)"""

SRC_NO = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER)"

CATALOGS = f"""
req AS (SELECT DISTINCT source AS project FROM documents),
ca AS (SELECT DISTINCT source AS project, 'catalog_a/' || source AS root FROM documents WHERE {SRC_NO} BETWEEN 0 AND 9),
cb AS (SELECT DISTINCT source AS project, 'catalog_b/' || source AS root FROM documents WHERE {SRC_NO} BETWEEN 5 AND 14)"""

ORACLE["successful_runs"] = f"""
WITH {BASELINE_RUNS}
SELECT ordinal, class, cov FROM baseline_runs WHERE success
"""

ORACLE["verified_runs"] = f"""
WITH {VERDICTS}
SELECT doc_id FROM judged WHERE valid
"""

ORACLE["run_outcome"] = """
SELECT event_id AS ordinal,
  CASE WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN 'no_jar'
       WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'timeout' END
       WHEN event_id % 4 = 0 THEN 'no_tests_generated'
       ELSE 'success' END AS outcome,
  (event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_type <> 'error' AND event_id % 4 <> 0) AS success
FROM events
"""

ORACLE["verdict"] = f"""
WITH {VERDICTS}
SELECT doc_id, valid, reason FROM judged
"""

ORACLE["verified_records"] = f"""
WITH {VERDICTS}
SELECT doc_id, refined_ok, original_ok, orig_passed, ref_passed, valid AS verified,
       CASE WHEN valid THEN true END AS oracle_preserved,
       CASE WHEN NOT valid THEN reason END AS error
FROM judged
"""

ORACLE["parse_coverage"] = """
SELECT user_id AS key, upper(event_type) AS criterion, arg_max(value, event_id) AS value
FROM events GROUP BY user_id, upper(event_type)
"""

ORACLE["coverage_lookup"] = """
WITH last AS (
  SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY user_id, event_type
)
SELECT user_id AS key,
       coalesce(max(v) FILTER (WHERE event_type = 'click'), 0.0) AS click_cov,
       0.0::DOUBLE AS line_cov,
       CAST(count(*) AS INTEGER) AS n_criteria
FROM last GROUP BY user_id
"""

ORACLE["marker_flag"] = """
SELECT user_id AS key, bool_or(event_type IN ('purchase', 'error')) AS flagged FROM events GROUP BY user_id
"""

ORACLE["run_summary"] = f"""
WITH {BASELINE_RUNS}
SELECT project, count(*) AS total, count(*) FILTER (WHERE success) AS successes,
       round(count(*) FILTER (WHERE success) * 100.0 / count(*), 1) AS percent
FROM baseline_runs GROUP BY project
"""

ORACLE["estimate_hours"] = """
SELECT count(*) AS rows, (count(*) * 60) // 3600 AS hours FROM lineitem
"""

ORACLE["ratio_metrics"] = """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber,
       round(l_quantity * 100.0 / 50, 6) AS mutation_score,
       round(l_linenumber * 100.0 / 7, 6) AS line_coverage
FROM lineitem
"""

ORACLE["ratio_totals"] = """
SELECT l_returnflag = 'R' AS failed, round(sum(l_quantity) * 100.0 / sum(50), 6) AS mutation_score, count(*) AS n
FROM lineitem GROUP BY l_returnflag = 'R'
"""

ORACLE["composite_score"] = """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber,
  round(CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE
    0.0 + (-0.3) * (l_tax * 100) + (-0.2) * CAST(l_linenumber AS DOUBLE) + 0.15 * (1 - l_discount)
        + 0.25 * ((l_linenumber * 100.0 / 7) / 100.0) + 0.25 * ((l_quantity * 100.0 / 50) / 100.0) + 0.15 * 1.0
  END, 6) AS score
FROM lineitem
"""

ORACLE["priority_lookup"] = f"""
WITH {CATALOGS}
SELECT r.project, coalesce(ca.root, cb.root) AS root,
       CASE WHEN ca.project IS NOT NULL THEN 'a' WHEN cb.project IS NOT NULL THEN 'b' END AS dataset
FROM req r LEFT JOIN ca USING (project) LEFT JOIN cb USING (project)
"""

ORACLE["missing_refs"] = f"""
WITH {CATALOGS}
SELECT project FROM req WHERE project NOT IN (SELECT project FROM ca)
"""

ORACLE["presence_report"] = f"""
WITH {CATALOGS}
SELECT project, project IN (SELECT project FROM ca) AS present FROM req
"""

ORACLE["resolve_or_drop"] = f"""
WITH {MANIFEST}, {SOME_JARS}, {CATALOGS},
fj AS (
  SELECT project, coalesce(min(path) FILTER (WHERE NOT contains(path, '/lib/')), min(path)) AS first_jar FROM some_jars GROUP BY project
)
SELECT m.project, m.ordinal, m.class, ca.root, fj.first_jar
FROM manifest m JOIN ca USING (project) JOIN fj USING (project)
"""

ORACLE["name_paths"] = f"""
WITH {MANIFEST}
SELECT ordinal, replace(class, '.', '_') AS dir_name, replace(class, '.', '/') || '.class' AS member_path,
       class || '_ESTest' AS test_name, split_part(class, '.', 1) AS first_segment,
       split_part(class, '.', -1) AS last_segment,
       concat_ws('/', 'generated/baseline', project, replace(class, '.', '_')) AS output_dir
FROM manifest
"""

ORACLE["accepted_paths"] = f"""
WITH {MANIFEST}, {VERDICTS}
SELECT m.ordinal, m.project,
       'generated/validated/' || m.project || '/' || replace(m.class, '.', '_') || '/' || split_part(m.class, '.', -1) || '_ESTest.java' AS accepted_path
FROM manifest m WHERE m.ordinal IN (SELECT doc_id FROM judged WHERE valid)
"""

ORACLE["keys_from_path"] = f"""
WITH {MANIFEST}
SELECT ordinal, project, split_part(class, '.', -1) || '_ESTest' AS class_stem FROM manifest
"""

ORACLE["joined_paths"] = f"""
WITH {LISTING_DOCS}
,
placed AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY contains(path, '/lib/'), path) - 1) AS pos FROM listing_docs)
SELECT project, pos // 64 AS chunk, string_agg(path, ':' ORDER BY pos) AS classpath FROM placed GROUP BY project, pos // 64
"""

ORACLE["explode_artifacts"] = f"""
WITH {BASELINE_RUNS}
SELECT ordinal, class, t.f AS test_file, CAST(len(test_files) AS INTEGER) AS num_tests, test_files[1] AS first_file
FROM baseline_runs, unnest(test_files) AS t(f)
WHERE success
"""

ORACLE["json_roundtrip"] = """
SELECT event_id, k, CAST(to_json({'event_id': event_id, 'k': k}) AS VARCHAR) AS json
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

ORACLE["run_name"] = """
SELECT event_id, 'results_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_name FROM events
"""

ORACLE["runs_json_scan"] = f"""
WITH {BASELINE_RUNS}
SELECT ordinal, project, class, success, cov, mut, array_to_string(test_files, ',') AS test_files FROM baseline_runs
"""

# --------------------------------------------------------------- text, containment, chat


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10), quotes doubled)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


# Fixed values (restated independently of the Spark code): prompt template, chat markers, system message.
_PROMPT_HEAD = sql_str("Refine this Java test to be concise and readable. Remove redundancy.\nORIGINAL:\n```java\n")
_PROMPT_TAIL = sql_str("\n```\nOUTPUT ONLY JAVA CODE.")
_SYSTEM = sql_str("You are a helpful coding assistant that generates JUnit test cases for Java methods.")
_NL = "chr(10)"


def _chatml(role_sql: str, content_sql: str) -> str:
    return f"'<|im_start|>' || {role_sql} || {_NL} || {content_sql} || '<|im_end|>' || {_NL}"


_TRIM = "regexp_replace(l, '^\\s+|\\s+$', '', 'g')"


def _clean_sql(text_sql: str) -> str:
    ls = f"string_split({text_sql}, chr(10))"
    st = f"list_position(list_transform({ls}, lambda l: regexp_matches({_TRIM}, '^(import|package|@)')), true)"
    return (
        f"CASE WHEN coalesce({st}, 0) = 0 THEN '' ELSE "
        f"array_to_string(list_filter(({ls})[{st}:], lambda l: NOT starts_with({_TRIM}, '```')), chr(10)) END"
    )


REPLIES = """
replies AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 1
           THEN concat_ws(chr(10), 'Here is the code:', '```java', 'import x;', text, '```', 'Done')
           ELSE text END AS reply
  FROM documents
)"""

ORACLE["clean_code"] = f"""
WITH {REPLIES}
SELECT doc_id, {_clean_sql('reply')} AS cleaned FROM replies
"""

ORACLE["build_prompt"] = f"""
SELECT doc_id, {_PROMPT_HEAD} || text || {_PROMPT_TAIL} AS prompt FROM documents
"""

ORACLE["truncate_text"] = """
SELECT doc_id,
       left(text, 500) || CASE WHEN length(text) > 500 THEN chr(10) || '... (truncado)' ELSE '' END AS head,
       right(text, 200) AS tail
FROM documents
"""

ORACLE["first_line"] = """
SELECT doc_id, split_part(text, chr(10), 1) AS first_line FROM documents
"""

ORACLE["duration_parts"] = """
WITH span AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS s FROM events GROUP BY user_id)
SELECT user_id, round(s, 3) AS elapsed_s, CAST(floor(s) AS BIGINT) // 3600 AS hours,
       (CAST(floor(s) AS BIGINT) % 3600) // 60 AS minutes
FROM span
"""

ORACLE["find_container"] = f"""
WITH {MANIFEST},
req AS (SELECT *, replace(class, '.', '/') || '.class' AS member FROM manifest),
mem AS (
  SELECT project, 2 AS depth, project || '/lib/z.jar' AS archive, member FROM req WHERE ordinal % 3 <> 0
  UNION ALL SELECT project, 1, project || '/z.jar', member FROM req WHERE ordinal % 3 <> 0 AND ordinal % 5 = 0
  UNION ALL SELECT 'src0', 2, 'src0/lib/a.jar', member FROM req WHERE ordinal % 10 = 0
)
SELECT r.ordinal, r.project, r.class, r.member,
       (SELECT arg_min(archive, (depth, archive)) FROM mem WHERE mem.project = r.project AND mem.member = r.member) AS archive
FROM req r
"""

ORACLE["fuzzy_match"] = """
WITH req(req_pos, pattern) AS (VALUES (0, 'customer#00000001'), (1, 'CUSTOMER#0000012'), (2, 'zz')),
hits AS (
  SELECT r.req_pos, arg_min(c.c_name, c.c_custkey) AS match, count(*) AS n_candidates
  FROM req r JOIN customer c ON contains(lower(c.c_name), lower(r.pattern)) GROUP BY r.req_pos
)
SELECT r.req_pos, r.pattern, h.match, coalesce(h.n_candidates, 0) AS n_candidates
FROM req r LEFT JOIN hits h USING (req_pos)
"""

ORACLE["companions"] = f"""
WITH {MANIFEST},
art AS (
  SELECT ordinal, concat_ws('/', 'generated/baseline', project, replace(class, '.', '_'),
                            split_part(class, '.', -1) || '_ESTest.java') AS path
  FROM manifest
)
SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(path, '\\.java$', '_scaffolding.java') AS companion
FROM art WHERE ordinal % 3 = 0
"""

ORACLE["sft_pairs"] = f"""
WITH {SFT_PAIRS}
SELECT * FROM sft_pairs
"""

ORACLE["conversation_messages"] = f"""
WITH {SFT_PAIRS}
SELECT conv_id, turn, 0 AS msg_pos, 'system' AS role, {_SYSTEM} AS content FROM sft_pairs
UNION ALL SELECT conv_id, turn, 1, 'user', source FROM sft_pairs
UNION ALL SELECT conv_id, turn, 2, 'assistant', target FROM sft_pairs
"""

ORACLE["render_chat"] = f"""
WITH {SFT_PAIRS}
SELECT conv_id, turn, {_chatml("'system'", _SYSTEM)} || {_chatml("'user'", "source")} || {_chatml("'assistant'", "target")} AS text
FROM sft_pairs
"""

ORACLE["render_chat_thread"] = f"""
SELECT conv_id, string_agg({_chatml('role', 'text')}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
"""

# --------------------------------------------------------------- checks

CHECKS = """
checks AS (
  SELECT 1 AS check_no, 'documents >= 100' AS "check", n >= 100 AS passed,
         CASE WHEN n < 100 THEN 'error' END AS severity, n AS observed, 100::BIGINT AS threshold, NULL::VARCHAR AS detail
  FROM (SELECT count(*) AS n FROM documents)
  UNION ALL
  SELECT 2, 'labels.doc_id in documents', n = 0, CASE WHEN n <> 0 THEN 'error' END, n, 0, NULL
  FROM (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
  UNION ALL
  SELECT 3, 'orders.o_custkey in customer', n = 0, CASE WHEN n <> 0 THEN 'error' END, n, 0, NULL
  FROM (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
  UNION ALL
  SELECT 4, 'events >= 1e9', true, CASE WHEN n < 1000000000 THEN 'warning' END, n, 1000000000, NULL
  FROM (SELECT count(*) AS n FROM events)
  UNION ALL
  SELECT 5, 'languages present', n = 0, CASE WHEN n <> 0 THEN 'error' END, n, 0,
         CASE WHEN n > 0 THEN missing END
  FROM (
    SELECT count(*) AS n, string_agg(v, ',' ORDER BY pos) AS missing
    FROM (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es'), (4, 'it')) AS req(pos, v)
    WHERE v NOT IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
  )
)"""

ORACLE["run_checks"] = f"""
WITH {CHECKS}
SELECT check_no, "check", passed, severity, observed, threshold, detail FROM checks
"""

ORACLE["check_tally"] = f"""
WITH {CHECKS}
SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS total, coalesce(bool_and(passed), true) AS all_passed FROM checks
"""

ORACLE["check_status"] = f"""
WITH {CHECKS}
SELECT count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings,
       CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'failed'
            WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'degraded' ELSE 'ready' END AS status
FROM checks
"""

# --------------------------------------------------------------- more statistics

PAIRED_LONG = f"""{PAIRED},
long AS (
  SELECT 'baseline_cov' AS col, baseline_cov AS v FROM paired UNION ALL
  SELECT 'valid_cov', valid_cov FROM paired UNION ALL
  SELECT 'baseline_mut', baseline_mut FROM paired UNION ALL
  SELECT 'valid_mut', valid_mut FROM paired
)"""

ORACLE["describe_text"] = """
WITH f AS (SELECT role AS v, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY role)
SELECT 'role' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM f
"""

ORACLE["column_profile"] = """
SELECT * FROM (VALUES
  ('doc_id', 0::BIGINT, (SELECT count(doc_id) FROM documents), 'int64'),
  ('text', 1::BIGINT, (SELECT count(text) FROM documents), 'object'),
  ('lang', 2::BIGINT, (SELECT count(lang) FROM documents), 'object'),
  ('source', 3::BIGINT, (SELECT count(source) FROM documents), 'object'),
  ('n_chars', 4::BIGINT, (SELECT count(n_chars) FROM documents), 'int64')
) AS t("column", position, non_null, dtype)
"""

ORACLE["box_stats"] = f"""
WITH {PAIRED_LONG},
q AS (
  SELECT col, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
  FROM long GROUP BY col
),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.col AS "column", f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(f.lo, 6) AS lower_fence, round(f.hi, 6) AS upper_fence,
       round(min(l.v) FILTER (WHERE l.v BETWEEN f.lo AND f.hi), 6) AS whisker_low,
       round(max(l.v) FILTER (WHERE l.v BETWEEN f.lo AND f.hi), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (l.v BETWEEN f.lo AND f.hi)) AS n_outliers
FROM f JOIN long l ON l.col = f.col
GROUP BY f.col, f.n, f.q1, f.median, f.q3, f.iqr, f.lo, f.hi
"""

ORACLE["improvement"] = f"""
WITH {PAIRED}
SELECT 'cov' AS metric, count(*) AS n, count(*) FILTER (WHERE valid_cov > baseline_cov) AS n_improved,
       count(*) FILTER (WHERE valid_cov = baseline_cov) AS n_equal, count(*) FILTER (WHERE valid_cov < baseline_cov) AS n_worse,
       round(avg(valid_cov - baseline_cov), 6) AS mean_delta
FROM paired
UNION ALL
SELECT 'mut', count(*), count(*) FILTER (WHERE valid_mut > baseline_mut), count(*) FILTER (WHERE valid_mut = baseline_mut),
       count(*) FILTER (WHERE valid_mut < baseline_mut), round(avg(valid_mut - baseline_mut), 6)
FROM paired
"""

ORACLE["signed_rank"] = f"""
WITH {PAIRED},
d AS (SELECT valid_cov - baseline_cov AS d FROM paired WHERE valid_cov - baseline_cov <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS mr FROM d),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))),
s AS (SELECT count(*) AS n, coalesce(sum(mr) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(mr) FILTER (WHERE d < 0), 0) AS wm FROM r)
SELECT s.n, round(s.wp, 6) AS w_plus, round(s.wm, 6) AS w_minus,
       round((s.wp - s.n * (s.n + 1) / 4.0) / sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24.0 - t.ties / 48.0), 6) AS z
FROM s, t
"""

RANK_SUM = f"""{PAIRED},
pooled AS (SELECT 0 AS g, baseline_cov AS v FROM paired UNION ALL SELECT 1, valid_cov FROM paired),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS mr FROM pooled),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM pooled GROUP BY v)),
s AS (
  SELECT count(*) FILTER (WHERE g = 0) AS n1, count(*) FILTER (WHERE g = 1) AS n2, sum(mr) FILTER (WHERE g = 0) AS r1 FROM r
),
u AS (SELECT s.n1, s.n2, s.r1 - s.n1 * (s.n1 + 1) / 2.0 AS u1, t.ties FROM s, t)"""

ORACLE["rank_sum"] = f"""
WITH {RANK_SUM}
SELECT n1, n2, round(u1, 6) AS u1, round(n1 * n2 - u1, 6) AS u2,
       round((u1 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z
FROM u
"""

ORACLE["effect_size"] = f"""
WITH {RANK_SUM},
a AS (SELECT (n1 * n2 - u1) / (n1 * n2 * 1.0) AS a12 FROM u)
SELECT round(a12, 6) AS a12,
       CASE WHEN abs(a12 - 0.5) >= 0.21 THEN 'large' WHEN abs(a12 - 0.5) >= 0.14 THEN 'medium'
            WHEN abs(a12 - 0.5) >= 0.06 THEN 'small' ELSE 'negligible' END AS magnitude
FROM a
"""

# --------------------------------------------------------------- sources, sinks, streaming, generation

ORACLE["manifest_scan"] = f"""
WITH {MANIFEST}
SELECT row_number() OVER (ORDER BY ordinal) AS pos, project, class FROM manifest
"""

ORACLE["coverage_csv_available"] = """
SELECT count(*) AS n_rows, count(*) > 0 AS available FROM lineitem
"""

ORACLE["incremental_append"] = """
SELECT * FROM events
"""

_PROMPT = f"({_PROMPT_HEAD} || text || {_PROMPT_TAIL})"

ANSWERED = f"""{MANIFEST}, {REPLIES},
art AS (
  SELECT m.ordinal, m.project, m.class, {_clean_sql('r.reply')} AS code,
         concat_ws('/', 'generated/baseline', m.project, replace(m.class, '.', '_'), split_part(m.class, '.', -1) || '_ESTest.java') AS path
  FROM manifest m JOIN replies r ON r.doc_id = m.ordinal
)"""

ORACLE["refine_job"] = f"""
WITH {ANSWERED}
SELECT ordinal, project, class, path AS original_file, replace(path, 'generated/baseline/', 'generated/refined/') AS refined_file, code AS refined_code, true AS success
FROM art WHERE code <> ''
"""

ORACLE["refine_failures"] = f"""
WITH {ANSWERED}
SELECT ordinal, project, class, path AS original_file, 'no code in the reply' AS error, false AS success FROM art WHERE code = ''
"""

ORACLE["refine_prompts"] = f"""
WITH {BASELINE_RUNS},
p AS (SELECT doc_id, {_PROMPT} AS prompt FROM documents)
SELECT r.ordinal, r.class, t.f AS test_file, p.prompt, CASE WHEN p.doc_id IS NULL THEN 'no text' END AS error
FROM baseline_runs r CROSS JOIN unnest(r.test_files) AS t(f) LEFT JOIN p ON p.doc_id = r.ordinal WHERE r.success
"""

ORACLE["accepted_write"] = f"""
WITH {VERDICTS}
SELECT source AS project, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE doc_id IN (SELECT doc_id FROM judged WHERE valid) GROUP BY source
"""

ORACLE["has_rows"] = """
SELECT 'documents' AS name, count(*) > 0 AS has_rows FROM documents
UNION ALL SELECT 'events', count(*) > 0 FROM events
UNION ALL SELECT 'labels', count(*) > 0 FROM labels
UNION ALL SELECT 'toxic over 1', count(*) > 0 FROM labels WHERE toxic > 1
"""

ORACLE["recursive_counts"] = f"""
WITH {LISTING},
roots AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM listing UNION SELECT 'absent.example')
SELECT root, count(l.path) AS n_files, count(*) FILTER (WHERE ends_with(l.path, '.html')) AS n_html
FROM roots LEFT JOIN listing l ON starts_with(l.path, root || '/') GROUP BY root
"""

ORACLE["catalog_lookup"] = """
WITH req(req_pos, pattern) AS (VALUES (0, 'Customer#000000012'), (1, 'customer#00000001'), (2, 'zz')),
hits AS (
  SELECT r.req_pos, arg_min(c.c_name, (c.c_name <> r.pattern, c.c_custkey)) AS match, bool_or(c.c_name = r.pattern) AS exact
  FROM req r JOIN customer c ON contains(lower(c.c_name), lower(r.pattern)) GROUP BY r.req_pos
)
SELECT r.req_pos, r.pattern, h.match, h.exact FROM req r LEFT JOIN hits h USING (req_pos)
"""

ORACLE["file_listing_scan"] = """
SELECT source, count(DISTINCT doc_id // 1024) AS n_files, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, max(doc_id // 1024) AS last_part
FROM documents GROUP BY source
"""

ORACLE["artifact_scan"] = """
SELECT source AS project, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source
"""

# --------------------------------------------------------------- more sources and sinks

ORACLE["preview_pairs"] = f"""
WITH {SFT_PAIRS}
SELECT * FROM sft_pairs ORDER BY conv_id, turn LIMIT 5
"""

ORACLE["manifest_fallback"] = ORACLE["manifest_scan"]

ORACLE["summary_csv"] = ORACLE["describe_numeric"]

ORACLE["archive_substring"] = f"""
WITH {MANIFEST},
req AS (SELECT ordinal, project, split_part(class, '.', -1) || '.class' AS wanted, replace(class, '.', '/') || '.class' AS member FROM manifest),
mem AS (
  SELECT project, 2 AS depth, project || '/lib/z.jar' AS archive, member FROM req WHERE ordinal % 3 <> 0
  UNION ALL SELECT project, 1, project || '/z.jar', member FROM req WHERE ordinal % 3 <> 0 AND ordinal % 5 = 0
  UNION ALL SELECT 'src0', 2, 'src0/lib/a.jar', member FROM req WHERE ordinal % 10 = 0
),
hit AS (
  SELECT r.ordinal, arg_min(m.member, (m.depth, m.archive, m.member)) AS member, arg_min(m.archive, (m.depth, m.archive, m.member)) AS archive, count(*) AS n
  FROM req r JOIN mem m ON m.project = r.project AND contains(m.member, r.wanted) GROUP BY r.ordinal
)
SELECT r.ordinal, r.project, r.wanted, h.member, h.archive, coalesce(h.n, 0) AS n_candidates FROM req r LEFT JOIN hit h USING (ordinal)
"""

ORACLE["name_substring"] = """
WITH key AS (SELECT DISTINCT o_custkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k FROM orders),
req AS (
  SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN 'x' || k WHEN o_custkey % 10 = 1 THEN substring(k, 8, 2) ELSE 'MER#' || substring(k, 1, 8) END AS fragment FROM key
),
hit AS (
  SELECT r.fragment, arg_min(c.c_name, c.c_custkey) AS match, count(*) AS n
  FROM (SELECT DISTINCT fragment FROM req) r JOIN customer c ON contains(lower(c.c_name), lower(r.fragment)) GROUP BY r.fragment
)
SELECT r.o_custkey, r.fragment, h.match, coalesce(h.n, 0) AS n_candidates FROM req r LEFT JOIN hit h USING (fragment)
"""

ORACLE["stream_latest"] = ORACLE["latest_per_key"]

ORACLE["running_tally"] = f"""
WITH {BASELINE_RUNS},
arrived AS (
  SELECT *, 2 - ordinal % 3 AS batch_id FROM baseline_runs UNION ALL SELECT *, 2 FROM baseline_runs WHERE ordinal % 15 = 2
),
b AS (SELECT DISTINCT project, batch_id FROM arrived)
SELECT b.project, b.batch_id, count(*) AS total, count(*) FILTER (WHERE success) AS successes, round(count(*) FILTER (WHERE success) * 100.0 / count(*), 1) AS percent
FROM b JOIN arrived a ON a.project = b.project AND a.batch_id <= b.batch_id GROUP BY b.project, b.batch_id
"""

ORACLE["record_keys"] = """
WITH r AS (SELECT CASE WHEN event_type = 'click' THEN 'success' ELSE event_type END AS outcome FROM events),
k(key, type, kind) AS (VALUES ('id', 'integer', 'any'), ('class', 'string', 'any'), ('success', 'boolean', 'any'), ('num_tests', 'integer', 'success'), ('test_files', 'array', 'success'),
  ('time', 'number', 'success'), ('coverage', 'object', 'success'), ('error', 'string', 'failure'), ('retry', 'object', 'purchase'))
SELECT outcome, key, type, count(*) AS n FROM r JOIN k ON kind = 'any' OR kind = outcome OR (kind = 'failure' AND outcome <> 'success')
GROUP BY outcome, key, type
"""

ORACLE["variant_records"] = """
SELECT event_id AS id, event_type = 'click' AS success, CASE WHEN event_type <> 'click' THEN event_type END AS error,
  CAST(CASE WHEN event_type = 'click' THEN event_id % 4 + 1 END AS INTEGER) AS num_tests,
  CASE WHEN event_type = 'click' AND event_id % 4 = 3 THEN CAST(user_id AS VARCHAR) || '/3.java' END AS last_file,
  CASE WHEN event_type = 'click' THEN value END AS line_cov, CAST(CASE WHEN event_type = 'purchase' THEN event_id % 4 END AS INTEGER) AS attempt,
  CAST(CASE event_type WHEN 'click' THEN 7 WHEN 'purchase' THEN 5 ELSE 4 END AS INTEGER) AS n_keys
FROM events
"""

# P(Z > |z|) by the series of erf, summed from its last term
_TAIL = """greatest(0, 0.5 - exp(-{z} * {z} / 2) * abs({z}) / sqrt(2 * pi()) * list_reduce(list_concat([1.0::DOUBLE], [k::DOUBLE FOR k IN list_reverse(range(1, 400))]), lambda acc, k: 1 + acc * {z} * {z} / (2 * k + 1)))"""

ORACLE["signed_rank_by_class"] = f"""
WITH {PAIRED},
d AS (SELECT class, valid_cov - baseline_cov AS d FROM paired WHERE valid_cov - baseline_cov <> 0),
r AS (SELECT class, d, rank() OVER (PARTITION BY class ORDER BY abs(d)) + (count(*) OVER (PARTITION BY class, abs(d)) - 1) / 2.0 AS mr FROM d),
t AS (SELECT class, sum(c * c * c - c) AS ties FROM (SELECT class, count(*) AS c FROM d GROUP BY class, abs(d)) GROUP BY class),
s AS (
  SELECT class, count(*) AS n, coalesce(sum(mr) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(mr) FILTER (WHERE d < 0), 0) AS wm, any_value(ties) AS ties FROM r JOIN t USING (class) GROUP BY class
), z AS (
  SELECT *, least(greatest((wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), -8), 8) AS zz,
    (wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z, n <= 50 AND ties = 0 AS exact FROM s
), p AS (
  SELECT *, CASE WHEN exact THEN 2 * list_sum(list_slice(
    list_reduce(list_concat([list_concat([1.0::DOUBLE], [0.0::DOUBLE FOR i IN range(n * (n + 1) // 2)])], [[CAST(k AS DOUBLE)] FOR k IN range(1, n + 1)]),
      lambda acc, k: [acc[i] + CASE WHEN i - CAST(k[1] AS INTEGER) >= 1 THEN acc[i - CAST(k[1] AS INTEGER)] ELSE 0 END FOR i IN range(1, len(acc) + 1)]),
    1, CAST(least(wp, wm) AS INTEGER) + 1)) / pow(2, n) ELSE 2 * {_TAIL.format(z="zz")} END AS p FROM z
)
SELECT class, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(z, 6) AS z, round(least(1.0, p), 6) AS p_value, CASE WHEN exact THEN 'exact' ELSE 'normal' END AS method FROM p
"""

ORACLE["rank_sum_by_class"] = f"""
WITH pooled AS (SELECT user_id AS class, event_type = 'purchase' AS g, value AS v FROM events WHERE event_type IN ('click', 'purchase')),
r AS (SELECT class, g, v, rank() OVER (PARTITION BY class ORDER BY v) + (count(*) OVER (PARTITION BY class, v) - 1) / 2.0 AS mr FROM pooled),
t AS (SELECT class, sum(c * c * c - c) AS ties FROM (SELECT class, count(*) AS c FROM pooled GROUP BY class, v) GROUP BY class),
s AS (SELECT class, count(*) FILTER (WHERE NOT g) AS n1, count(*) FILTER (WHERE g) AS n2, coalesce(sum(mr) FILTER (WHERE NOT g), 0) AS r1, any_value(ties) AS ties FROM r JOIN t USING (class) GROUP BY class),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0) AS u2, n1 BETWEEN 1 AND 20 AND n2 BETWEEN 1 AND 20 AND ties = 0 AS exact,
  sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - CASE WHEN n1 + n2 > 1 THEN ties / ((n1 + n2) * (n1 + n2 - 1.0)) END)) AS sigma FROM s),
z AS (SELECT *, CASE WHEN sigma > 0 THEN (u1 - n1 * n2 / 2.0) / sigma END AS z FROM u),
-- arrangements by U: element j of the sorted pool belongs to the first sample or not; ways[m * (n1 * n2 + 1) + s] with m taken so far
p AS (
  SELECT *, CASE WHEN exact THEN 2 * list_sum(list_slice(
    list_reduce(list_concat([list_concat([1.0::DOUBLE], [0.0::DOUBLE FOR i IN range((n1 + 1) * (n1 * n2 + 1) - 1)])], [[CAST(j AS DOUBLE)] FOR j IN range(n1 + n2)]),
      lambda w, j: [w[i] + CASE WHEN (i - 1) // (n1 * n2 + 1) >= 1 AND CAST(j[1] AS INTEGER) - ((i - 1) // (n1 * n2 + 1) - 1) BETWEEN 0 AND n2
          AND (i - 1) % (n1 * n2 + 1) >= CAST(j[1] AS INTEGER) - ((i - 1) // (n1 * n2 + 1) - 1)
        THEN w[i - (n1 * n2 + 1) - (CAST(j[1] AS INTEGER) - ((i - 1) // (n1 * n2 + 1) - 1))] ELSE 0 END FOR i IN range(1, len(w) + 1)]),
    n1 * (n1 * n2 + 1) + 1, n1 * (n1 * n2 + 1) + 1 + CAST(least(u1, u2) AS INTEGER)))
    / list_reduce(list_concat([1.0::DOUBLE], [k::DOUBLE FOR k IN range(1, n1 + 1)]), lambda a, i: a * (n2 + i) / i) ELSE 2 * {_TAIL.format(z="least(greatest(z, -8), 8)")} END AS p FROM z
)
SELECT class, n1, n2, round(u1, 6) AS u1, round(u2, 6) AS u2, round(z, 6) AS z, CASE WHEN z IS NOT NULL THEN round(least(1.0, p), 6) END AS p_value,
  CASE WHEN exact THEN 'exact' ELSE 'normal' END AS method
FROM p
"""

ORACLE["limit_large"] = """
SELECT l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 50000
"""

ORACLE["frequent_words"] = """
WITH words AS (SELECT unnest(string_split(text, ' ')) AS value FROM documents),
counts AS (SELECT value, count(*) AS n FROM words WHERE value <> '' GROUP BY value)
SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM counts QUALIFY rank <= 50
"""

ORACLE["frequent_parts"] = """
WITH counts AS (SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey)
SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM counts QUALIFY rank <= 20
"""

ORACLE["marker_hits"] = """
WITH w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
m AS (SELECT DISTINCT unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS marker FROM w WHERE len(w) >= 3)
SELECT doc_id, marker, strpos(text, marker) AS first_at FROM documents JOIN m ON contains(text, marker) WHERE marker <> ''
"""

ORACLE["describe_batches"] = f"""
WITH {PAIRED_LONG}
SELECT col AS "column", count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, true AS quartiles_hold
FROM long GROUP BY col
"""

ORACLE["checks_on_write"] = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IS NULL) AS lost FROM documents),
r AS (
  SELECT count(*) AS n, string_agg(v, ',' ORDER BY pos) AS missing FROM (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es'), (4, 'it'), (5, 'xx')) AS req(pos, v)
  WHERE v NOT IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)
)
SELECT 1 AS check_no, 'documents >= 100' AS "check", n >= 100 AS passed, CASE WHEN n < 100 THEN 'error' END AS severity, n AS observed, CAST(100 AS BIGINT) AS threshold, CAST(NULL AS VARCHAR) AS detail FROM c
UNION ALL SELECT 2, 'documents >= 1e9', true, CASE WHEN n < 1000000000 THEN 'warning' END, n, 1000000000, NULL FROM c
UNION ALL SELECT 3, 'languages present', n = 0, CASE WHEN n <> 0 THEN 'error' END, n, 0, missing FROM r
UNION ALL SELECT 4, 'doc_id set', lost = 0, CASE WHEN lost <> 0 THEN 'error' END, lost, 0, NULL FROM c
"""

ORACLE["accepted_rerun"] = f"""
WITH {VERDICTS},
a AS (SELECT source AS project, text || CASE WHEN length(source) % 2 = 1 THEN '// 2' ELSE '' END AS code FROM documents WHERE doc_id IN (SELECT doc_id FROM judged WHERE valid))
SELECT project, count(*) AS n, CAST(sum(length(code)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE ends_with(code, '// 2')) AS n_second FROM a GROUP BY project
"""
