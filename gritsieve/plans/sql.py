"""DuckDB SQL for the queries of ``gritsieve.plans.bindings``."""

from __future__ import annotations

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_FILES = """
raw AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS sha, CAST(l_linenumber AS INTEGER) AS pos_in_commit, l_partkey AS part, l_suppkey AS supp,
           CAST(floor(l_quantity) AS INTEGER) AS q, l_linenumber AS line, l_returnflag AS flag,
           ['src/', 'tests/', 'docs/', 'vendor/x/', 'lib/core/', 'examples/', 'src/main/java/test/'][CAST(l_partkey % 7 AS INTEGER) + 1] AS dir,
           ['.py', '.rs', '.go', '.java', '.md', '.ts'][CAST(l_suppkey % 6 AS INTEGER) + 1] AS ext,
           ['python', 'rust', 'go', 'java', NULL, 'typescript'][CAST(l_suppkey % 6 AS INTEGER) + 1] AS language
    FROM lineitem
), files AS (
    SELECT *, dir || 'm' || part || ext AS path,
           CASE WHEN line = 7 THEN NULL ELSE q END AS added, CASE WHEN line = 7 THEN NULL ELSE CAST(line AS INTEGER) END AS deleted, line = 7 AS bin,
           supp % 6 = 1 AND line = 3 AS gained, flag <> 'N' AND line <> 7 AS measured,
           CASE WHEN flag <> 'N' AND line <> 7 AND supp % 6 = 1 AND line = 2 THEN 1 ELSE 0 END AS inline_added,
           CASE WHEN dir = 'vendor/x/' THEN 'vendored-dir' WHEN dir = 'tests/' THEN 'test-dir' WHEN dir = 'docs/' THEN 'docs-dir'
                WHEN ext = '.md' THEN 'docs-file' WHEN dir = 'examples/' THEN 'tooling-dir'
                WHEN ext = '.py' THEN 'py-source' WHEN ext = '.rs' THEN 'rust-source' WHEN ext = '.ts' THEN 'js-source' WHEN ext = '.go' THEN 'go-source' ELSE 'java-source' END AS rule_id
    FROM raw
), classed AS (
    SELECT *, CASE rule_id WHEN 'vendored-dir' THEN 'vendored' WHEN 'test-dir' THEN 'test' WHEN 'docs-dir' THEN 'docs' WHEN 'docs-file' THEN 'docs' WHEN 'tooling-dir' THEN 'other' ELSE 'source' END AS category
    FROM files
)"""

_STATS = f"""{_FILES}, marked AS (
    SELECT *, category = 'source' AS src, category = 'test' AS tst, coalesce(added, 0) AS a, coalesce(deleted, 0) AS d,
           coalesce(added, 0) + coalesce(deleted, 0) - inline_added AS outside, category = 'source' AND (gained OR inline_added > 0) AS inl,
           measured OR bin AS patched, line % 3 AS hunks_c, q // 2 AS code_a, line % 4 AS asserts
    FROM classed
), stats AS (
    SELECT sha, count(*) AS n_files, count(*) FILTER (src) AS n_source, count(*) FILTER (tst) AS n_test, count(*) FILTER (category = 'docs') AS n_docs,
           count(*) FILTER (category = 'vendored') AS n_vendored, count(*) FILTER (category = 'other') AS n_other,
           CAST(coalesce(sum(a + d) FILTER (src OR tst), 0) AS BIGINT) AS changed_lines,
           CAST(coalesce(sum(a - inline_added) FILTER (src), 0) AS BIGINT) AS source_added, CAST(coalesce(sum(d) FILTER (src), 0) AS BIGINT) AS source_deleted,
           CAST(coalesce(sum(a) FILTER (tst), 0) + coalesce(sum(inline_added) FILTER (src), 0) AS BIGINT) AS test_added, CAST(coalesce(sum(d) FILTER (tst), 0) AS BIGINT) AS test_deleted,
           count(*) FILTER (src AND outside > 0) AS n_source_changed, coalesce(bool_and(patched) FILTER (src), true) AS source_patched,
           count(*) FILTER (src AND CASE WHEN measured THEN hunks_c ELSE outside END > 0) AS n_code_files, count(*) FILTER (inl) AS n_inline_test,
           coalesce(bool_and(patched) FILTER (tst OR inl), true) AS tests_patched,
           CASE WHEN coalesce(bool_and(patched) FILTER (src), true) THEN CAST(coalesce(sum(hunks_c) FILTER (src AND measured), 0) AS BIGINT) END AS code_hunks,
           CASE WHEN coalesce(bool_and(patched) FILTER (src), true) THEN CAST(coalesce(sum(code_a + line) FILTER (src AND measured), 0) AS BIGINT) END AS code_lines,
           CASE WHEN coalesce(bool_and(patched) FILTER (tst OR inl), true) THEN CAST(coalesce(sum(asserts) FILTER ((tst OR inl) AND measured), 0) AS BIGINT) END AS assertions
    FROM marked GROUP BY sha
)"""

_COMMITS = """
commits AS (
    SELECT 'repo' || (o_custkey % 5) AS repo, CAST(o_orderkey AS VARCHAR) AS sha, o_orderkey AS pos, o_orderkey % 6 AS k, o_orderdate AS ts,
           [1.0, 0.5, 0.0, 0.5, 0.0, 0.5][CAST(o_orderkey % 6 AS INTEGER) + 1] AS ref,
           [1.0, 0.0, 0.0, 1.0, 0.0, 1.0][CAST(o_orderkey % 6 AS INTEGER) + 1] AS fix,
           ['Closes #' || o_orderkey, '#' || o_orderkey, 'no issue or pull-request reference', 'gh-' || o_orderkey, 'no issue or pull-request reference', 'owner/repo#' || o_orderkey][CAST(o_orderkey % 6 AS INTEGER) + 1] AS ref_detail,
           ['Fix', 'no fix keyword in the subject', 'no fix keyword in the subject', 'wrong', 'no fix keyword in the subject', 'bug'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS fix_detail
    FROM orders
)"""

_OUTCOMES = f"""{_STATS}, {_COMMITS}, api AS (
    SELECT sha, list_sort(list(DISTINCT 'def f' || (part % 10))) AS names FROM marked WHERE src AND measured AND part % 4 = 0 GROUP BY sha
), judged AS (
    SELECT c.*, s.* EXCLUDE (sha), CASE WHEN s.source_patched THEN coalesce(a.names, []) END AS api,
           CASE WHEN s.sha IS NULL THEN 'empty' WHEN n_docs = n_files THEN 'docs-only' WHEN n_vendored = n_files THEN 'generated-only' WHEN n_source = 0 THEN 'no-source'
                WHEN n_source_changed = 0 THEN 'source-unchanged' WHEN source_patched AND n_code_files = 0 THEN 'source-cosmetic'
                WHEN n_test + n_inline_test = 0 THEN 'no-test' WHEN changed_lines > 400 OR n_source > 10 THEN 'oversize' END AS reason
    FROM commits c LEFT JOIN stats s ON c.sha = s.sha LEFT JOIN api a ON c.sha = a.sha
), valued AS (
    SELECT *, round(1 - least(changed_lines, 400) / 400.0::DOUBLE, 4) AS f1, round(least(test_added, 40) / 40.0::DOUBLE, 4) AS f2, round(least(coalesce(assertions, 0), 5) / 5.0::DOUBLE, 4) AS f3,
           ref::DOUBLE AS f4, fix::DOUBLE AS f5, CASE WHEN n_source > 0 THEN round(1.0::DOUBLE / n_source, 4) END AS f6,
           round(least(n_source + n_test, 10) / 10.0::DOUBLE, 4) AS d1, round(least(coalesce(code_hunks, 0), 10) / 10.0::DOUBLE, 4) AS d2, round(least(coalesce(code_lines, 0), 100) / 100.0::DOUBLE, 4) AS d3,
           round(least(greatest(n_code_files - 1, 0), 4) / 4.0::DOUBLE, 4) AS d4,
           CASE WHEN len(api) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d5
    FROM judged
), scored AS (
    SELECT *, CASE WHEN reason IS NULL THEN round(round(3 * f1, 4) + round(2 * f2, 4) + round(f3, 4) + round(2 * f4, 4) + round(f5, 4) + round(f6, 4), 4) END AS score,
           CASE WHEN reason IS NULL THEN round(round(d1, 4) + round(3 * d2, 4) + round(3 * d3, 4) + round(2 * d4, 4) + round(d5, 4), 4) END AS difficulty
    FROM valued
), banded AS (
    SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN difficulty >= 4.5 THEN 'hard' WHEN difficulty >= 2 THEN 'medium' ELSE 'easy' END END AS band FROM scored
)"""

_ORDER = "score DESC, ts DESC, sha"
_REASON_ORD = "list_position(['empty', 'docs-only', 'generated-only', 'no-source', 'source-unchanged', 'source-cosmetic', 'no-test', 'oversize'], reason)"


def _plural(n: str, word: str) -> str:
    return f"{n} || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


def _feature(rows: list[tuple[str, str, float, str]]) -> str:
    return " UNION ALL ".join(f"SELECT repo, sha, '{name}' AS name, {value} AS value, {weight}::DOUBLE AS weight, round({weight} * {value}, 4) AS contribution, {detail} AS detail FROM banded WHERE reason IS NULL" for name, value, weight, detail in rows)


_SCORE_FEATURES = _feature([
    ("small_diff", "f1", 3.0, "changed_lines || ' of at most 400 source+test lines changed'"),
    ("test_lines_added", "f2", 2.0, f"test_added || ' test lines added (full value at 40)' || CASE WHEN n_inline_test > 0 THEN ', in #[cfg(test)] of ' || {_plural('n_inline_test', 'src file')} ELSE '' END"),
    ("added_assertions", "f3", 1.0, f"CASE WHEN assertions IS NULL THEN 'unknown: no patch data' ELSE {_plural('assertions', 'assertion line')} || ' added in tests (full value at 5)' END"),
    ("linked_reference", "f4", 2.0, "ref_detail"),
    ("fix_keyword", "f5", 1.0, "fix_detail"),
    ("focused_source", "f6", 1.0, f"{_plural('n_source', 'source file')} || ' changed'"),
])

_DIFFICULTY_FEATURES = _feature([
    ("files", "d1", 1.0, f"{_plural('(n_source + n_test)', 'source+test file')} || ' changed (full value at 10)'"),
    ("hunks", "d2", 3.0, f"CASE WHEN code_hunks IS NULL THEN 'unknown: no patch data' ELSE {_plural('code_hunks', 'source code hunk')} || ' (full value at 10)' END"),
    ("lines", "d3", 3.0, f"CASE WHEN code_lines IS NULL THEN 'unknown: no patch data' ELSE {_plural('code_lines', 'source code line')} || ' changed (full value at 100)' END"),
    ("cross_file", "d4", 2.0, f"{_plural('n_code_files', 'source file')} || ' with code changes (full value at 5)'"),
    ("public_api", "d5", 1.0, "CASE WHEN api IS NULL THEN 'unknown: no patch data' WHEN len(api) = 0 THEN 'no public declaration changed' ELSE array_to_string(api[1:3], ', ') || CASE WHEN len(api) > 3 THEN ' (+' || (len(api) - 3) || ' more)' ELSE '' END END"),
])

_LINES = f"""
doc_lines AS (
    SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents
), shaped AS (
    SELECT doc_id, source, n, line, {_norm('line')} AS shape, {_strip('line')} AS inner_ FROM doc_lines
), hashed AS (
    SELECT doc_id, source, n, substr(sha256('+' || shape || chr(10)), 1, 16) AS hash FROM shaped WHERE shape <> ''
), prints AS (
    SELECT doc_id, any_value(source) AS source, substr(sha256(string_agg(hash || chr(10), '' ORDER BY hash)), 1, 16) AS patch, CAST(count(DISTINCT hash) AS INTEGER) AS hunks FROM hashed GROUP BY doc_id
), items AS (
    SELECT item_id, substr(sha256('+' || {_norm('line')} || chr(10)), 1, 16) AS hash
    FROM (SELECT item_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM benchmark) WHERE {_norm('line')} <> ''
), item_prints AS (
    SELECT item_id, substr(sha256(string_agg(hash || chr(10), '' ORDER BY hash)), 1, 16) AS patch, CAST(count(DISTINCT hash) AS INTEGER) AS hunks FROM items GROUP BY item_id
), entries AS (
    SELECT min(doc_id) AS id, patch, arg_min(source, doc_id) AS repo FROM prints GROUP BY patch
    UNION ALL
    SELECT -min(item_id) - 1, patch, 'benchmark' FROM item_prints WHERE patch NOT IN (SELECT patch FROM prints) GROUP BY patch
), entry_hunks AS (
    SELECT DISTINCT e.id, h.hash FROM entries e JOIN hashed h ON e.id = h.doc_id WHERE e.id >= 0
    UNION
    SELECT DISTINCT e.id, i.hash FROM entries e JOIN items i ON i.item_id = -e.id - 1 WHERE e.id < 0
), entry_sizes AS (
    SELECT id, CAST(count(*) AS INTEGER) AS n FROM entry_hunks GROUP BY id
), shared AS (
    SELECT d.doc_id, e.id, CAST(count(*) AS INTEGER) AS shared FROM (SELECT DISTINCT doc_id, hash FROM hashed) d JOIN entry_hunks e ON d.hash = e.hash GROUP BY d.doc_id, e.id
), pairs AS (
    SELECT s.doc_id, s.id, s.shared, least(p.hunks, z.n) AS smaller FROM shared s JOIN prints p ON s.doc_id = p.doc_id JOIN entry_sizes z ON s.id = z.id
    WHERE s.shared / least(p.hunks, z.n)::DOUBLE >= 0.5
), matches AS (
    SELECT p.doc_id, e.id, e.repo, true AS exact, z.n AS shared, z.n AS smaller FROM prints p JOIN entries e ON e.patch = p.patch JOIN entry_sizes z ON e.id = z.id WHERE e.id <> p.doc_id
    UNION ALL
    SELECT x.doc_id, x.id, e.repo, false, x.shared, x.smaller FROM pairs x JOIN entries e ON x.id = e.id JOIN prints p ON x.doc_id = p.doc_id WHERE e.patch <> p.patch
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY exact DESC, shared / smaller::DOUBLE DESC, shared DESC, id) AS place FROM matches
), judged AS (
    SELECT d.doc_id, d.source, p.patch IS NULL AS none, b.id AS best_id, b.shared, b.smaller, b.exact, b.repo AS best_repo,
           coalesce((SELECT count(*) FROM placed m WHERE m.doc_id = d.doc_id), 0) AS n, coalesce((SELECT bool_or(m.repo <> d.source) FROM placed m WHERE m.doc_id = d.doc_id), false) AS foreign_
    FROM documents d LEFT JOIN prints p ON d.doc_id = p.doc_id LEFT JOIN placed b ON b.doc_id = d.doc_id AND b.place = 1
), verdicts AS (
    SELECT *, CASE WHEN none THEN 'unknown' WHEN exact THEN 'duplicate' WHEN best_id IS NOT NULL THEN 'overlap' ELSE 'new' END AS status FROM judged
), outcomes AS (
    SELECT *, CASE WHEN status IN ('new', 'unknown') THEN status WHEN best_id = doc_id AND best_repo = source THEN 'recorded' WHEN foreign_ THEN 'collision' ELSE 'internal' END AS outcome FROM verdicts
)"""

_WALKED = "walked AS (SELECT event_type AS repo, event_id AS sha, ts, ts < TIMESTAMP '2024-01-16' AS seen FROM events)"

#: Verdicts in order against ``held`` (id, patch, since): entries of the benchmark's ledger, of negative ids, and inserted documents.
_IN_ORDER = """
held_hunks AS (
    SELECT DISTINCT e.id, h.hash FROM held e JOIN hashed h ON e.id = h.doc_id WHERE e.id >= 0
    UNION
    SELECT DISTINCT e.id, i.hash FROM held e JOIN items i ON i.item_id = -e.id - 1 WHERE e.id < 0
), held_sizes AS (
    SELECT id, count(*) AS n FROM held_hunks GROUP BY id
), met AS (
    SELECT d.doc_id, e.id, count(*) AS shared FROM (SELECT DISTINCT doc_id, hash FROM hashed) d JOIN held_hunks e ON d.hash = e.hash GROUP BY d.doc_id, e.id
), told AS (
    SELECT p.doc_id, e.patch = p.patch AS exact FROM met m JOIN prints p ON m.doc_id = p.doc_id JOIN held e ON m.id = e.id JOIN held_sizes z ON z.id = m.id
    WHERE e.since < p.doc_id AND (e.patch = p.patch OR m.shared / least(p.hunks, z.n)::DOUBLE >= 0.5)
), in_order AS (
    SELECT d.doc_id, p.patch IS NULL AS none, coalesce(bool_or(t.exact), false) AS exact, count(t.doc_id) AS n
    FROM documents d LEFT JOIN prints p ON d.doc_id = p.doc_id LEFT JOIN told t ON t.doc_id = d.doc_id GROUP BY d.doc_id, p.patch
), ruled AS (
    SELECT doc_id, CASE WHEN none THEN 'unknown' WHEN exact THEN 'duplicate' WHEN n > 0 THEN 'overlap' ELSE 'new' END AS status, CAST(n AS INTEGER) AS matches FROM in_order
)"""

_LEDGER = "SELECT -min(item_id) - 1 AS id, patch, -1 AS since FROM item_prints GROUP BY patch"

#: The fixes that one pass in order inserts: fix by fix, what overlaps nothing inserted before it.
_RECORDED = f"""
ledger_hunks AS (
    SELECT DISTINCT e.id, i.hash FROM ({_LEDGER}) e JOIN items i ON i.item_id = -e.id - 1
), ledger_sizes AS (
    SELECT id, count(*) AS n FROM ledger_hunks GROUP BY id
), fixes AS (
    SELECT patch, min(doc_id) AS doc_id, any_value(hunks) AS n FROM prints WHERE patch NOT IN (SELECT patch FROM item_prints) GROUP BY patch
), fix_hunks AS (
    SELECT DISTINCT f.doc_id, f.n, h.hash FROM fixes f JOIN hashed h ON f.doc_id = h.doc_id
), known AS (
    SELECT DISTINCT doc_id FROM (
        SELECT f.doc_id, l.id, f.n, z.n AS m, count(*) AS shared FROM fix_hunks f JOIN ledger_hunks l ON f.hash = l.hash JOIN ledger_sizes z ON l.id = z.id GROUP BY ALL
    ) WHERE shared / least(n, m)::DOUBLE >= 0.5
), open_fixes AS (
    SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) AS k FROM fixes WHERE doc_id NOT IN (SELECT doc_id FROM known)
), conflicts AS (
    SELECT a AS k, list(b) AS ahead FROM (
        SELECT x.k AS a, y.k AS b, x.n, y.n AS m, count(*) AS shared FROM open_fixes x JOIN fix_hunks g ON g.doc_id = x.doc_id
        JOIN fix_hunks h ON g.hash = h.hash JOIN open_fixes y ON h.doc_id = y.doc_id WHERE y.k < x.k GROUP BY ALL
    ) WHERE shared / least(n, m)::DOUBLE >= 0.5 GROUP BY a
), steps AS (
    SELECT o.k, coalesce(c.ahead, []) AS ahead FROM open_fixes o LEFT JOIN conflicts c ON o.k = c.k
), pass AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
    UNION ALL
    SELECT s.k, CASE WHEN list_has_any(p.kept, s.ahead) THEN p.kept ELSE list_append(p.kept, s.k) END FROM pass p JOIN steps s ON s.k = p.k + 1
), inserted AS (
    SELECT o.doc_id FROM open_fixes o JOIN (SELECT unnest(kept) AS k FROM (SELECT kept FROM pass ORDER BY k DESC LIMIT 1)) i ON o.k = i.k
), held AS (
    {_LEDGER} UNION ALL SELECT p.doc_id, p.patch, p.doc_id FROM prints p JOIN inserted i ON p.doc_id = i.doc_id
)"""

SQL: dict[str, str] = {
    "checked_run": f"""WITH {_LINES}, held AS ({_LEDGER} UNION ALL SELECT min(doc_id), patch, min(doc_id) FROM prints WHERE patch NOT IN (SELECT patch FROM item_prints) GROUP BY patch), {_IN_ORDER}
        SELECT doc_id, status, matches FROM ruled""",
    "recorded_run": f"""WITH RECURSIVE {_LINES}, {_RECORDED}, {_IN_ORDER}
        SELECT r.doc_id, i.doc_id IS NOT NULL AS inserted, r.status, r.matches FROM ruled r LEFT JOIN inserted i ON r.doc_id = i.doc_id""",
    "mine_ranked": f"WITH {_OUTCOMES} SELECT repo, sha, CAST(row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS INTEGER) AS rank, score, difficulty, band FROM banded WHERE reason IS NULL",
    "classify_files": f"WITH {_FILES} SELECT sha, pos_in_commit, path, language, category, rule_id FROM classed",
    "commit_stats": f"WITH {_STATS} SELECT * FROM stats",
    "commit_lists": f"""WITH {_STATS}, tests AS (
        SELECT sha, string_agg(t, ',' ORDER BY t) AS fail_to_pass FROM (SELECT DISTINCT sha, path || '::t' || line AS t FROM marked WHERE (tst OR inl) AND measured) GROUP BY sha
    ), api AS (
        SELECT sha, string_agg(a, ',' ORDER BY a) AS names FROM (SELECT DISTINCT sha, 'def f' || (part % 10) AS a FROM marked WHERE src AND measured AND part % 4 = 0) GROUP BY sha
    ), prints AS (
        SELECT sha, string_agg(h || chr(10), '' ORDER BY h) AS hashes, CAST(count(*) AS INTEGER) AS n, bool_or(NOT measured) AS unknown
        FROM (SELECT sha, substr(sha256('h' || (part % 50)), 1, 16) AS h, measured FROM marked WHERE (src OR tst) AND NOT bin) GROUP BY sha
    )
    SELECT s.sha, coalesce(t.fail_to_pass, '') AS fail_to_pass, CASE WHEN s.source_patched THEN coalesce(a.names, '') END AS public_api,
           CASE WHEN NOT p.unknown THEN substr(sha256(p.hashes), 1, 16) END AS fingerprint, CASE WHEN NOT p.unknown THEN p.n END AS n_hunks
    FROM stats s LEFT JOIN tests t ON s.sha = t.sha LEFT JOIN api a ON s.sha = a.sha LEFT JOIN prints p ON s.sha = p.sha""",
    "reject_reasons": f"""WITH {_OUTCOMES} SELECT repo, sha, reason, CASE WHEN reason = 'oversize' THEN concat_ws(', ', CASE WHEN changed_lines > 400 THEN changed_lines || ' source+test lines (max 400)' END,
        CASE WHEN n_source > 10 THEN n_source || ' source files (max 10)' END) END AS detail FROM banded""",
    "score_features": f"WITH {_OUTCOMES} {_SCORE_FEATURES}",
    "difficulty_features": f"WITH {_OUTCOMES} {_DIFFICULTY_FEATURES}",
    "top_candidates": f"WITH {_OUTCOMES} SELECT repo, sha, score, band FROM banded WHERE reason IS NULL ORDER BY {_ORDER} LIMIT 25",
    "reason_counts": f"WITH {_OUTCOMES} SELECT repo, reason, count(*) AS n FROM banded WHERE reason IS NOT NULL GROUP BY ALL",
    "band_counts": f"WITH {_OUTCOMES} SELECT repo, band, count(*) AS n FROM banded WHERE band IS NOT NULL GROUP BY ALL",
    "funnel": f"""WITH {_OUTCOMES}, steps AS (SELECT repo, reason, count(*) AS n, {_REASON_ORD} AS o FROM banded WHERE reason IS NOT NULL GROUP BY ALL), whole AS (SELECT repo, count(*) AS w FROM banded GROUP BY repo)
    SELECT repo, 'walked' AS step, w AS n, w AS remaining FROM whole UNION ALL
    SELECT s.repo, s.reason, s.n, CAST(w.w - sum(s.n) OVER (PARTITION BY s.repo ORDER BY s.o ROWS UNBOUNDED PRECEDING) AS BIGINT) FROM steps s JOIN whole w ON s.repo = w.repo""",
    "feature_table": f"WITH {_OUTCOMES} SELECT repo, sha, round(3 * f1, 4) AS small_diff, round(2 * f2, 4) AS test_lines_added, round(f3, 4) AS added_assertions, round(2 * f4, 4) AS linked_reference, round(f5, 4) AS fix_keyword, round(f6, 4) AS focused_source FROM banded WHERE reason IS NULL",
    "rejected_lists": f"""WITH {_OUTCOMES}, r AS (SELECT repo, reason, pos, sha, CAST((row_number() OVER (PARTITION BY repo, reason ORDER BY pos, sha) - 1) // 10000 AS INTEGER) AS part FROM banded WHERE reason IS NOT NULL)
    SELECT repo, reason, part, CAST(count(*) AS INTEGER) AS n, substr(sha256(string_agg(sha, ',' ORDER BY pos, sha)), 1, 16) AS shas FROM r GROUP BY repo, reason, part""",
    "commit_messages": f"""WITH {_COMMITS} SELECT sha,
        ['Fix crash in parser', 'Add feature (#' || sha || ')', 'Update docs and more', 'Handle wrong input', 'refactor: tidy up', 'Resolve bug: owner/repo#' || sha || ' broken'][CAST(k AS INTEGER) + 1] AS subject,
        ['Closes #' || sha, '', '', 'See gh-' || sha, 'body text', ''][CAST(k AS INTEGER) + 1] AS body, CAST(pos - 1 AS VARCHAR) AS base,
        ref::DOUBLE AS reference, ref_detail AS reference_detail, fix::DOUBLE AS fix, fix_detail FROM commits""",
    "linked_issues": f"""WITH {_COMMITS}, found AS (
        SELECT sha, '' AS w, pos AS n FROM commits UNION SELECT sha, '', pos % 100 FROM commits UNION SELECT sha, 'other/repo', 7 FROM commits
    ) SELECT sha, string_agg(w || '#' || n, ' ' ORDER BY w, n) AS issues FROM found GROUP BY sha""",
    "normalized_lines": f"WITH {_LINES} SELECT d.doc_id, CAST(count(s.shape) AS INTEGER) AS n, sha256(coalesce(string_agg(s.shape, chr(10) ORDER BY s.n), '')) AS lines FROM documents d LEFT JOIN shaped s ON d.doc_id = s.doc_id AND s.shape <> '' GROUP BY d.doc_id",
    "hunk_hashes": f"""WITH {_LINES}, sides AS (
        SELECT doc_id, coalesce(string_agg(shape, chr(10) ORDER BY n) FILTER (n = 1 AND shape <> ''), '') AS o, coalesce(string_agg(shape, chr(10) ORDER BY n) FILTER (n > 1 AND shape <> ''), '') AS w,
               coalesce(string_agg(inner_, chr(10) ORDER BY n) FILTER (n = 1 AND inner_ <> ''), '') AS oi, coalesce(string_agg(inner_, chr(10) ORDER BY n) FILTER (n > 1 AND inner_ <> ''), '') AS wi,
               coalesce(string_agg(CASE WHEN n = 1 THEN '-' ELSE '+' END || shape || chr(10), '' ORDER BY n) FILTER (shape <> ''), '') AS signed,
               coalesce(string_agg(CASE WHEN n = 1 THEN '-' ELSE '+' END || inner_ || chr(10), '' ORDER BY n) FILTER (inner_ <> ''), '') AS signed_inner
        FROM shaped GROUP BY doc_id
    ) SELECT doc_id, CASE WHEN o <> w THEN substr(sha256(signed), 1, 16) WHEN oi <> wi THEN substr(sha256('INNER' || chr(10) || signed_inner), 1, 16) END AS hash FROM sides""",
    "fingerprints": f"WITH {_LINES} SELECT d.doc_id, p.patch, p.hunks FROM documents d LEFT JOIN prints p ON d.doc_id = p.doc_id",
    "first_occurrences": f"WITH {_LINES} SELECT min(doc_id) AS doc_id, patch FROM prints GROUP BY patch",
    "shared_hunks": f"WITH {_LINES} SELECT doc_id, id AS entry_id, shared, smaller FROM pairs WHERE id >= 0",
    "verdicts": f"WITH {_LINES} SELECT doc_id, status, outcome, CAST(n AS INTEGER) AS matches, best_id, shared, smaller FROM outcomes",
    "collisions": f"""WITH {_LINES} SELECT o.doc_id, o.source AS repo, f.repo AS other, f.id AS other_id, o.status FROM outcomes o
        JOIN (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY place) AS k FROM placed p JOIN documents d ON p.doc_id = d.doc_id WHERE p.repo <> d.source) f ON f.doc_id = o.doc_id AND f.k = 1 WHERE o.outcome = 'collision'""",
    "collision_summary": f"""WITH {_LINES}, met AS (SELECT o.source AS repo, f.repo AS other, CASE WHEN f.id < 0 THEN -f.id - 1 ELSE f.id END = o.doc_id AS same, o.status FROM outcomes o
        JOIN (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY place) AS k FROM placed p JOIN documents d ON p.doc_id = d.doc_id WHERE p.repo <> d.source) f ON f.doc_id = o.doc_id AND f.k = 1 WHERE o.outcome = 'collision')
        SELECT repo, other, count(*) AS n, count(*) FILTER (same) AS same_commits, count(*) FILTER (NOT same AND status = 'duplicate') AS same_fixes, count(*) FILTER (status = 'overlap') AS overlaps FROM met GROUP BY repo, other""",
    "outcome_counts": f"""WITH {_LINES} SELECT source AS repo, count(*) FILTER (outcome = 'new') AS "new", count(*) FILTER (outcome = 'recorded') AS recorded, count(*) FILTER (outcome = 'internal') AS internal,
        count(*) FILTER (outcome = 'collision') AS collision, count(*) FILTER (outcome = 'unknown') AS unknown FROM outcomes GROUP BY source""",
    "status_counts": f"""WITH {_LINES} SELECT source AS repo, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'overlap') AS overlap,
        count(*) FILTER (status = 'unknown') AS unknown FROM outcomes GROUP BY source""",
    "url_cleaning": """SELECT page_id, regexp_replace(url, '^(https?://)[^/?#]*@', '\\1') AS plain, regexp_replace(url, '^(https?://)[^/?#]*@', '\\1') AS cleaned, 'ssh://git@host/' || page_id AS ssh,
        ['python', 'rust', 'go', 'java', NULL, 'typescript'][CAST(page_id % 6 AS INTEGER) + 1] AS language FROM pages""",
    "file_signals": """WITH raw AS (
        SELECT page_id, page_id % 3 AS k, CASE page_id % 3 WHEN 0 THEN '// Code generated by x. DO NOT EDIT.' || chr(10) WHEN 1 THEN '#[cfg(test)]' || chr(10) ELSE '' END || coalesce(html, '') AS c FROM pages
    ), c AS (
        SELECT page_id, k, left(CASE WHEN page_id % 5 = 0 THEN replace(c, chr(10), ' ') ELSE c END, 65536) AS c FROM raw
    ), m AS (
        SELECT *, length(c) >= 512 AND length(c) >= 200 * (length(c) - length(replace(c, chr(10), '')) + 1) AS minified FROM c
    ) SELECT page_id, CASE WHEN k = 0 THEN 'generated-header' WHEN k = 1 AND minified THEN 'minified' ELSE '' END AS signals, minified FROM m""",
    "resume": f"WITH {_WALKED} SELECT repo, sha FROM walked w WHERE NOT EXISTS (SELECT 1 FROM walked s WHERE s.seen AND s.repo = w.repo AND s.sha = w.sha)",
    "resume_by_index": f"WITH {_WALKED} SELECT repo, sha FROM walked w WHERE NOT EXISTS (SELECT 1 FROM walked s WHERE s.seen AND s.repo = w.repo AND s.sha = w.sha)",
    "watermarks": f"""WITH {_WALKED} SELECT repo, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS position, count(*) AS walked, CAST(max(CASE WHEN seen THEN 1 ELSE 0 END) + max(CASE WHEN seen THEN 0 ELSE 1 END) AS INTEGER) AS runs
        FROM walked GROUP BY repo""",
    "prefix_stop": f"""WITH {_WALKED}, r AS (SELECT *, bool_or(seen) OVER w AS shut, count(*) OVER w AS n FROM walked
        WINDOW w AS (PARTITION BY repo ORDER BY ts DESC, sha DESC ROWS UNBOUNDED PRECEDING)) SELECT repo, sha, n FROM r WHERE NOT shut""",
    "run_segments": "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events",
    "range_cuts": """WITH r AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem),
        n AS (SELECT *, 1 + q % 4 + CASE WHEN q % 3 <> 0 THEN 1 ELSE 0 END AS n_lines FROM r),
        p AS (SELECT *, CAST(sum(n_lines) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM n)
        SELECT l_orderkey, 't' || l_linenumber || '_' || l_partkey AS name, stop - n_lines + 1 AS start, stop FROM p""",
    "multiset_gain": """WITH c AS (SELECT l_orderkey, l_suppkey % 5 AS k, count(*) FILTER (l_linenumber > 2) AS n, count(*) FILTER (l_linenumber <= 2) AS o FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS gain FROM c GROUP BY l_orderkey""",
    "set_overlap": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        w AS (SELECT doc_id, list_distinct(list_filter(string_split(array_to_string(list_filter(lines, lambda x, k: k % 2 = 1), ' '), ' '), lambda x: x <> '')) AS a,
        list_distinct(list_filter(string_split(array_to_string(list_filter(lines, lambda x, k: k % 2 = 0), ' '), ' '), lambda x: x <> '')) AS b FROM l)
        SELECT doc_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 6) ELSE 0.0::DOUBLE END AS share FROM w""",
    "label_measures": """SELECT source, lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS unknown, CASE WHEN bool_and(toxic IS NOT NULL) THEN CAST(sum(toxic) AS BIGINT) END AS toxic, CAST(sum(toxic) AS BIGINT) AS known_toxic
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""",
    "repository_summary": f"""WITH {_OUTCOMES} SELECT r_name, c_mktsegment, count(*) AS walked, count(*) FILTER (reason IS NULL) AS candidates, count(*) FILTER (band = 'hard') AS hard, round(max(score), 4) AS best
        FROM banded b JOIN orders o ON o.o_orderkey = b.pos JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_mktsegment""",
    "verdict_texts": f"""WITH {_LINES} SELECT o.doc_id, CASE WHEN o.status IN ('new', 'unknown') THEN o.status ELSE o.status || ': ' ||
        CASE WHEN o.status = 'overlap' THEN o.shared || ' of ' || o.smaller || ' hunks shared with ' || o.best_repo || ' ' || e.sha
             WHEN o.best_repo = o.source AND o.best_id = o.doc_id THEN 'already in the ledger'
             WHEN e.sha = CAST(o.doc_id AS VARCHAR) THEN 'same commit as ' || o.best_repo || ' ' || e.sha ELSE 'same fix as ' || o.best_repo || ' ' || e.sha END
        || ' (proposed on 2024-01-01)' || CASE WHEN o.n > 1 THEN ' (+' || (o.n - 1) || ' more)' ELSE '' END END AS verdict
        FROM outcomes o LEFT JOIN (SELECT id, CAST(CASE WHEN id < 0 THEN -id - 1 ELSE id END AS VARCHAR) AS sha FROM entries) e ON e.id = o.best_id""",
    "best_candidates": f"""WITH {_OUTCOMES}, r AS (SELECT repo, sha, k, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS rank FROM banded WHERE reason IS NULL)
        SELECT repo, CAST(rank AS INTEGER) AS rank, left(sha, 10) AS commit,
        ['Fix crash...', 'Add featu...', 'Update do...', 'Handle wr...', 'refactor:...', 'Resolve b...'][CAST(k AS INTEGER) + 1] AS subject FROM r WHERE rank <= 5""",
    "commit_dates": """SELECT CAST(o_orderkey AS VARCHAR) AS sha, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ['+00:00', '+02:00', '-05:30'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS date,
        epoch_us(date_trunc('second', o_orderdate)) - [0, 7200, -19800][CAST(o_orderkey % 3 AS INTEGER) + 1] * 1000000::BIGINT AS instant FROM orders""",
    "test_counts": r"""SELECT page_id, CAST(2 * (page_id % 4) + len(regexp_extract_all(coalesce(html, ''), '(?m)^\s*#\[(?:\w+::)*test(?:\]|\()')) AS INTEGER) AS tests,
        2 * (page_id % 4) + len(regexp_extract_all(coalesce(html, ''), '(?m)^\s*#\[(?:\w+::)*test(?:\]|\()')) > CASE WHEN page_id % 5 <> 0 THEN page_id % 7 ELSE 0 END AS gained,
        regexp_replace(regexp_replace(url, '/$', ''), '\.git$', '') AS web, 'https://host/o/' || page_id AS remote FROM pages""",
    "classify_by_index": f"WITH {_FILES} SELECT sha, pos_in_commit, path, language, category, rule_id FROM classed",
    "touched_definitions": """WITH r AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 200 END AS file, l_linenumber AS line, l_orderkey * 8 + l_linenumber AS place,
        CAST(floor(l_quantity) AS BIGINT) AS n, 't' || (l_suppkey % 50) AS name FROM lineitem),
        h AS (SELECT * FROM r WHERE line > 2), d AS (SELECT file, name, place AS s, place + CASE WHEN n = 50 THEN 1000 ELSE n END AS e FROM r WHERE line <= 2)
        SELECT h.file, h.place, count(*) AS touched, min(d.name) AS first, max(d.name) AS last FROM h JOIN d ON h.file = d.file AND h.place <= d.e AND d.s <= h.place + h.n - 1 GROUP BY h.file, h.place""",
}
