"""DuckDB statements for the registered queries.

They work from the generic tables alone: expected chunks come from document lines and not from diff
text, expected findings from line items and not from answers. Word boundaries, which RE2 knows for
ASCII only, are put into the text as marks: chr(4) chr(1) word chr(2) chr(3), with chr(5) before
chr(1) where the word starts with a digit.
"""

from __future__ import annotations


from patchloom.checks.registry import FEATURE_GROUPS
from patchloom.functions import constants as C
from patchloom.functions.regex import SPACE, WORD
from patchloom.sources import fixtures as X

S = SPACE.replace(r"\x85", r"\x{85}").replace(r"\xa0", r"\x{a0}")


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def regex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern as an SQL literal, with the Unicode meaning of its classes spelled out."""
    spelled = (
        pattern.replace(r"[\w", f"[{WORD}").replace(r"\w", f"[{WORD}]")
        .replace(r"\s", f"[{S}]").replace(r"\S", f"[^{S}]").replace(r"\d", r"\p{Nd}")
    )
    return text(("(?i)" if ignore_case else "") + spelled)


def bounded(pattern: str, ignore_case: bool = True) -> str:
    """For existence tests: a neighbour in place of each word boundary."""
    head, tail = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    core = pattern[2 if head else 0: len(pattern) - (2 if tail else 0)]
    return regex(
        (r"(?:^|[^\p{L}\p{N}_])" if head else "") + core + (r"(?:[^\p{L}\p{N}_]|$)" if tail else ""),
        ignore_case,
    )


def words(pattern: str) -> str:
    """A pattern over marked text."""
    return "'" + pattern + "'"


BANK = texts(X.CODE_LINES)
SIZE = len(X.CODE_LINES)


def path_of(source: str, doc: str) -> str:
    return (
        f"{texts(X.DIRECTORIES)}[({doc}) % 6 + 1] || '/' || {source} || '/doc_' || ({doc}) || '.'"
        f" || {texts(X.EXTENSIONS)}[({doc}) % 9 + 1]"
    )


def stem_of(path: str) -> str:
    return f"regexp_replace(regexp_extract({path}, '[^/]*$'), '\\.[^.]*$', '')"


def extension_of(path: str) -> str:
    return f"regexp_extract({path}, '\\.([^.]*)$', 1)"


def reviewable(path: str) -> str:
    return (
        f"({extension_of(path)} IN ({', '.join(text(e) for e in C.CODE_EXTENSIONS)})"
        f" AND NOT regexp_matches({path}, {text('|'.join(C.SKIPPED_PATHS))}))"
    )


def ratio4(n: str, m: str) -> str:
    return f"CAST(format('{{:.4f}}', ({n})::DOUBLE / ({m})) AS DOUBLE)"


def band(score: str) -> str:
    return f"CASE WHEN {score} >= 0.7 THEN 'high' WHEN {score} >= 0.6 THEN 'medium' ELSE 'low' END"


# --- common table expressions ------------------------------------------------------------------

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def sql(needs: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    recursive = any("UNION ALL -- step" in CTES[name][1] for name in order)
    heads = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}\n{body}"


cte("docs", [], f"""
  SELECT doc_id, source, text, 'org/' || source AS repo, source || '-' || (doc_id // 400) AS pr_id,
    {path_of('source', 'doc_id')} AS file_path,
    list_transform(range(0, 3 + doc_id % 12),
      lambda k: {BANK}[(doc_id + k * (1 + doc_id % 5)) % {SIZE} + 1]) AS bank
  FROM documents""")

cte("v1", ["docs"], """
  SELECT doc_id, pr_id, repo, file_path, (doc_id % 100) / 100.0::DOUBLE AS base_score,
    list_concat(string_split(text, chr(10)), bank) AS lines, 0 AS context
  FROM docs""")

# lines of a diff section: k-th line with its mark and hunk
cte("sized", ["docs"], """
  SELECT doc_id, pr_id, repo, file_path, CASE WHEN doc_id % 8 = 5 THEN 400 ELSE 7 END AS per_hunk,
    list_concat(CASE WHEN doc_id % 8 = 5 THEN string_split(replace(text, ' ', chr(10)), chr(10))
                     ELSE string_split(text, chr(10)) END, bank) AS lines,
    max(doc_id) OVER (PARTITION BY pr_id) AS last_doc
  FROM docs""")

cte("plain_lines", ["sized"], """
  SELECT doc_id, pr_id, repo, file_path, per_hunk, last_doc, len(lines) AS n,
    unnest(lines) AS txt, generate_subscripts(lines, 1) - 1 AS k
  FROM sized""")

cte("marked", ["plain_lines"], """
  SELECT doc_id, pr_id, repo, file_path, per_hunk, k, k // per_hunk AS h,
    ['+', '+', '+', ' ', '-'][k % 5 + 1] AS mark, txt FROM plain_lines
  UNION ALL
  SELECT doc_id, pr_id, repo, file_path, per_hunk, len(lines), (len(lines) - 1) // per_hunk, '',
    chr(92) || ' No newline at end of file' FROM sized WHERE doc_id % 3 = 0
  UNION ALL
  SELECT doc_id, pr_id, repo, file_path, per_hunk, len(lines) + 1, (len(lines) - 1) // per_hunk, '', ''
  FROM sized WHERE doc_id = last_doc""")

cte("numbered", ["marked"], """
  SELECT *, 1 + h * per_hunk + 2 * ((h + 1) // 2) + 15 * (h // 2) AS c,
    mark = '+' AND NOT starts_with(txt, '++') AS is_add,
    mark = '-' AND NOT starts_with(txt, '--') AS is_rem
  FROM marked""")

cte("placed", ["numbered"], """
  SELECT *, c + coalesce(sum((NOT is_rem)::INT) OVER (PARTITION BY doc_id, h ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM numbered""")

cte("hunk_rows", ["placed"], """
  SELECT pr_id, repo, doc_id, h, file_path, c, count(*) AS body_lines, count(*) FILTER (is_add) AS n_add,
    max(line_no) FILTER (is_add) AS end_line,
    list(txt ORDER BY k) FILTER (is_add) AS added,
    coalesce(list(txt ORDER BY k) FILTER (mark = ' '), []) AS context,
    string_agg(mark || txt || chr(10), '' ORDER BY k) AS raw_patch
  FROM placed GROUP BY ALL""")

cte("chunk_rows", ["hunk_rows"], f"""
  SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY doc_id, h) - 1 AS chunk_ord
  FROM hunk_rows WHERE n_add > 0 AND {reviewable('file_path')}""")

cte("gaps", ["chunk_rows"], """
  SELECT *, CASE WHEN lag(file_path) OVER w = file_path AND c - lag(end_line) OVER w < 10
    THEN 0 ELSE 1 END AS opens
  FROM chunk_rows WINDOW w AS (PARTITION BY pr_id ORDER BY chunk_ord)""")

cte("islands", ["gaps"], """
  SELECT *, sum(opens) OVER (PARTITION BY pr_id ORDER BY chunk_ord) - 1 AS island FROM gaps""")

cte("merged", ["islands"], """
  SELECT pr_id, repo, island AS chunk_ord, file_path, min(c) AS start_line,
    max_by(end_line, chunk_ord) AS end_line,
    flatten(list(added ORDER BY chunk_ord)) AS lines,
    flatten(list(context ORDER BY chunk_ord)) AS context_lines,
    string_agg(raw_patch, '' ORDER BY chunk_ord) AS raw_patch,
    len(flatten(list(context))) AS context
  FROM islands GROUP BY pr_id, repo, island, file_path""")

# --- features ----------------------------------------------------------------------------------

MARK_WORDS = regex(r"([\p{L}\p{N}_]+)")


def add_features(name: str, source: str) -> None:
    """Chunks of ``source`` with the feature columns, from ``lines``, ``context`` and ``file_path``."""
    cte(f"{name}_code", [source], f"""
      SELECT *, array_to_string(lines, chr(10)) AS code FROM {source}""")
    cte(f"{name}_marked", [f"{name}_code"], f"""
      SELECT *, regexp_replace(
        regexp_replace(code, {MARK_WORDS}, chr(4) || chr(1) || '\\1' || chr(2) || chr(3), 'g'),
        chr(1) || '(\\p{{Nd}})', chr(5) || chr(1) || '\\1', 'g') AS m
      FROM {name}_code""")
    flag = {
        key: f"regexp_matches(code, {bounded(value)})" for key, value in C.FLAG_PATTERNS.items()
    }
    defined = " || ".join(f"regexp_extract_all(code, {regex(p)}, 1)" for p in C.DEFINED_NAME_PATTERNS)
    number = r"\x01(\p{Nd}{2,})\x02"
    excluded = "NOT IN ('100', '200', '404', '500')"
    cte(f"{name}_features", [f"{name}_marked"], f"""
      SELECT * EXCLUDE (code, m, lines),
        len(lines)::INT AS num_added_lines, context::INT AS num_context_lines,
        list_sum(list_transform(lines, lambda l: length(l)))::DOUBLE / len(lines) AS avg_line_length,
        list_max(list_transform(lines, lambda l: length(l)))::INT AS max_line_length,
        len(list_filter(lines, lambda l: length(l) > 120))::INT AS num_long_lines,
        len(regexp_extract_all(code, {regex(C.FUNCTION_PATTERN, True)}))::INT AS num_functions_changed,
        (coalesce(list_max(list_transform(list_filter(lines, lambda l: regexp_matches(l, '[^{S}]')),
          lambda l: length(regexp_extract(l, '^[{S}]*')))), 0) // 3)::INT AS max_nesting_depth,
        len(regexp_extract_all(m, {words(r"\x01(if|else\x02\x03 \x04\x01if|elif|else|switch|case|when)\x02")}))::INT AS num_branches,
        (len(regexp_extract_all(m, {words(r"\x01(for|while|do|foreach)\x02")}))
          + len(regexp_extract_all(m, {words(r"\x03\.\x04\x01(forEach|map|filter)\x02")})))::INT AS num_loops,
        ((length(code) - length(replace(code, 'return ', ''))) // 7)::INT AS num_returns,
        ((length(code) - length(replace(code, ' = ', ''))) // 3
          + (length(code) - length(replace(code, ' += ', ''))) // 4
          + (length(code) - length(replace(code, ' -= ', ''))) // 4)::INT AS num_assignments,
        (num_branches + num_loops + 1)::INT AS cyclomatic_estimate,
        {flag['has_eval_exec']} AS has_eval_exec,
        {flag['has_sql_statement']} OR {flag['has_sql_fstring']} AS has_sql_string,
        {flag['has_shell_command']} AS has_shell_command,
        {flag['has_hardcoded_secret']} AS has_hardcoded_secret,
        {flag['has_todo_fixme']} AS has_todo_fixme,
        {flag['has_type_cast']} AS has_type_cast,
        {flag['has_null_check']} AS has_null_check,
        {flag['has_exception_handling']} AS has_exception_handling,
        {flag['has_file_io']} AS has_file_io,
        {flag['has_network_call']} AS has_network_call,
        {flag['has_print_debug']} AS has_print_debug,
        len(list_filter(lines, lambda l: regexp_matches(l, '^[{S}]*(#|//|/\\*|\\*)')))::DOUBLE / len(lines) AS comment_ratio,
        (len(list_filter(regexp_extract_all(m, {words(number)}, 1), lambda x: x {excluded}))
          - len(list_filter(regexp_extract_all(m, {words(number + r"\x03\.\x04\x05")}, 1),
              lambda x: x {excluded})))::INT AS num_magic_numbers,
        contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') AS is_test_file,
        coalesce(map([{', '.join(text(k) for k in C.EXTENSION_CODES)}],
          [{', '.join(str(v) for v in C.EXTENSION_CODES.values())}])[{extension_of('file_path')}], 0)::INT AS file_extension_id,
        len(list_filter(list_distinct(regexp_extract_all(m, {words(chr(92) + 'x01([' + WORD + ']+)' + chr(92) + 'x02' + chr(92) + 'x03[' + S + ']*' + chr(92) + '(')}, 1)),
          lambda x: NOT list_contains({defined} || {texts(C.BUILTIN_CALLS)}, x)))::INT AS cross_function_calls,
        len(regexp_extract_all(code, {regex(C.IMPORT_PATTERN)}))::INT AS import_complexity,
        {ratio4("len(regexp_extract_all(m, " + words(r"\x01(try|except|catch)\x02") + "))", "len(lines)")} AS error_handling_ratio
      FROM {name}_marked""")


add_features("v1", "v1")
add_features("merged", "merged")

# --- PR tables ---------------------------------------------------------------------------------

cte("drafts", [], """
  SELECT DISTINCT doc_id // 40 AS draft, 'draft-' || (doc_id // 40) AS pr_id FROM labels""")

cte("prs", ["docs", "drafts"], """
  SELECT pr_id, CASE WHEN n % 5 <> 4 THEN 'Change ' || pr_id ELSE '' END AS title,
    CASE WHEN n % 7 <> 3 THEN txt ELSE '' END AS body,
    CASE WHEN n % 2 = 0 THEN 'main' ELSE '' END AS base_branch
  FROM (SELECT pr_id, min(doc_id) AS n, min_by(text, doc_id) AS txt FROM docs GROUP BY pr_id)
  UNION ALL SELECT pr_id, '', '', '' FROM drafts""")

cte("files", ["docs"], f"""
  SELECT pr_id, doc_id * 2 AS file_ord, file_path AS filename, doc_id % 11 <> 10 AS has_patch, doc_id
  FROM docs
  UNION ALL
  SELECT pr_id, doc_id * 2 + 1,
    CASE doc_id % 9 WHEN 0 THEN 'tests/unit/test_' || {stem_of('file_path')} || '.py'
      WHEN 3 THEN 'tests/my_' || {stem_of('file_path')} || '_test.go'
      ELSE 'spec_' || {stem_of('file_path')} || '_more.js' END, false, NULL
  FROM docs WHERE doc_id % 3 = 0""")

cte("contents", ["docs"], """
  SELECT doc_id, pr_id, file_path AS path,
    CASE WHEN doc_id % 10 = 9 OR doc_id % 13 = 12 THEN ''
      ELSE text || chr(10) || array_to_string(bank, chr(10)) END AS content
  FROM docs""")

cte("coverage", ["docs", "files"], f"""
  SELECT d.doc_id, d.pr_id, d.file_path, {stem_of('d.file_path')} AS stem,
    bool_or(contains(f.filename, 'test_' || {stem_of('d.file_path')})
      OR contains(f.filename, {stem_of('d.file_path')} || '_test')
      OR contains(f.filename, 'spec_' || {stem_of('d.file_path')})) AS has_test_coverage
  FROM docs d JOIN files f ON f.pr_id = d.pr_id GROUP BY ALL""")

MESSAGES = " ".join(
    f"WHEN {text(kind)} THEN {texts(values)}[event_id % 3 + 1]"
    for kind, values in X.COMMIT_MESSAGES.items()
).replace("\n", "' || chr(10) || '")

cte("event_docs", [], """
  SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id // 10
    ELSE event_id // 10 - (event_id // 10) % 10 END AS d FROM events""")

cte("v3", ["event_docs"], f"""
  SELECT event_id, event_id::VARCHAR AS sha, 'org/src' || (d % 20) AS repo,
    {path_of("'src' || (d % 20)", 'd')} AS file_path, ts, CASE event_type {MESSAGES} END AS message,
    event_id % 23 > 1 AS has_diff
  FROM event_docs""")

cte("recent", ["v3"], """
  SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY ts DESC, sha) AS place FROM v3
  QUALIFY place <= 20""")

cte("crawled", ["v3"], """
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha) AS place FROM v3
  QUALIFY place <= 250""")

cte("history", ["recent"], f"""
  SELECT repo, file_path, count(*) FILTER (regexp_matches(message, {bounded(C.HISTORY_FIX_PATTERN)})) AS fix_commits,
    count(*) AS commits, {ratio4('fix_commits', 'commits')} AS commit_history_risk
  FROM recent GROUP BY repo, file_path""")


def budgeted(chunks: str, ordinal: str) -> str:
    return f"""
      SELECT pr_id, repo, file_path, row_number() OVER (PARTITION BY pr_id ORDER BY min({ordinal})) AS file_rank
      FROM {chunks} GROUP BY pr_id, repo, file_path"""


cte("v1_budget", ["v1"], budgeted("v1", "doc_id"))
cte("merged_budget", ["merged"], budgeted("merged", "chunk_ord"))

cte("enriched", ["v1_features", "coverage", "v1_budget", "history"], """
  SELECT f.*, c.has_test_coverage, coalesce(h.commit_history_risk, 0.0) AS commit_history_risk
  FROM v1_features f JOIN coverage c USING (doc_id)
  JOIN v1_budget b ON b.pr_id = f.pr_id AND b.file_path = f.file_path
  LEFT JOIN history h ON h.repo = f.repo AND h.file_path = f.file_path AND b.file_rank <= 5""")


def adjusted(base: str) -> str:
    score = base
    for applies, amount in (
        ("commit_history_risk > 0.5", 0.10),
        ("NOT has_test_coverage AND cross_function_calls > 5", 0.05),
        ("import_complexity > 5", 0.05),
        ("error_handling_ratio < 0.05 AND cross_function_calls > 3", 0.05),
    ):
        score = f"(CASE WHEN {applies} THEN least({score} + {amount}::DOUBLE, 1.0::DOUBLE) ELSE {score} END)"
    return f"round({score}, 4)"


AREAS = f"""list_filter([
  CASE WHEN has_eval_exec THEN {text(C.FOCUS_EVAL)} END,
  CASE WHEN has_sql_string THEN {text(C.FOCUS_SQL)} END,
  CASE WHEN has_hardcoded_secret THEN {text(C.FOCUS_SECRET)} END,
  CASE WHEN has_shell_command THEN {text(C.FOCUS_SHELL)} END,
  CASE WHEN cyclomatic_estimate > 8 THEN printf({text(C.FOCUS_COMPLEXITY)}, cyclomatic_estimate) END,
  CASE WHEN commit_history_risk > 0.4 THEN format('{{:.0f}}', commit_history_risk * 100) || '% of its recent commits were fixes' END,
  CASE WHEN NOT has_test_coverage THEN {text(C.FOCUS_NO_TEST)} END,
  CASE WHEN cross_function_calls > 8 THEN printf({text(C.FOCUS_CALLS)}, cross_function_calls) END,
  CASE WHEN error_handling_ratio < 0.05 AND num_added_lines > 20 THEN {text(C.FOCUS_ERRORS)} END
], lambda a: a IS NOT NULL)"""

cte("scored", ["enriched"], f"""
  SELECT *, {adjusted('base_score')} AS score, {AREAS} AS areas FROM enriched""")

cte("routes", ["merged"], """
  SELECT pr_id, file_path, min(chunk_ord)::BIGINT AS file_ord, count(*) AS chunks,
    sum(len(lines))::BIGINT AS added, min_by(start_line, chunk_ord)::BIGINT AS first_start_line,
    CASE WHEN sum(len(lines)) > 500 THEN 'oversize' WHEN sum(len(lines)) < 3 THEN 'drop'
      ELSE 'prompt' END AS route
  FROM merged GROUP BY pr_id, file_path""")

cte("oversize", ["routes"], """
  SELECT pr_id, file_path, file_ord, 0 AS finding_ord, first_start_line AS line, 'style' AS type,
    'low' AS severity,
    added || ' lines were added to this file, too many to review at once; smaller steps would help.' AS message,
    '' AS line_content, '' AS suggestion, 1.0::DOUBLE AS confidence
  FROM routes WHERE route = 'oversize'""")

SIGNATURES = (
    f"array_to_string(list_transform(regexp_extract_all(content, {regex(C.SIGNATURE_PATTERN)})[1:50],"
    f" lambda x: regexp_replace(x, '^[{S}]+|[{S}]+$', '', 'g')), chr(10))"
)

cte("summary_lines", ["files", "marked"], f"""
  SELECT f.pr_id, f.place, f.filename,
    list(regexp_replace(m.txt, '^[{S}]+|[{S}]+$', '', 'g') ORDER BY m.k)[1:3] AS named
  FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) AS place FROM files) f
  JOIN marked m ON m.doc_id = f.doc_id
  WHERE f.place <= 10 AND f.has_patch AND m.mark = '+'
    AND regexp_matches('+' || m.txt, {regex(C.PATCH_SIGNATURE_PATTERN)})
  GROUP BY f.pr_id, f.place, f.filename""")

cte("summaries", ["summary_lines"], """
  SELECT pr_id, string_agg('`' || filename || '`: ' || array_to_string(named, '; '), chr(10) ORDER BY place) AS changed_files_summary
  FROM summary_lines GROUP BY pr_id""")

cte("context", ["prs", "summaries"], """
  SELECT p.pr_id, p.title, substr(p.body, 1, 500) AS body,
    coalesce(s.changed_files_summary, '') AS changed_files_summary,
    CASE WHEN p.title <> '' THEN substr(p.body, 1, 400) ELSE '' END AS shown_body
  FROM prs p LEFT JOIN summaries s USING (pr_id)""")

cte("signature_lists", ["merged_budget", "contents"], f"""
  SELECT b.pr_id, b.file_path, b.file_rank::INT AS file_rank, {SIGNATURES} AS signatures
  FROM merged_budget b JOIN contents c ON c.pr_id = b.pr_id AND c.path = b.file_path
  WHERE b.file_rank <= 5 AND content <> ''""")

# --- diff lines --------------------------------------------------------------------------------

# part 0: section header, 1: detached header, 2: hunk header, 3: body
cte("ordered_lines", ["sized", "marked"], """
  SELECT pr_id, doc_id, 0 AS h, 0 AS part, i AS k, line FROM (
    SELECT pr_id, doc_id, unnest(header) AS line, generate_subscripts(header, 1) AS i FROM (
      SELECT pr_id, doc_id, list_filter(['diff --git a/' || file_path || ' b/' || file_path,
        CASE WHEN doc_id % 4 = 1 THEN 'old mode 100644' END,
        CASE WHEN doc_id % 4 = 1 THEN 'new mode 100755' END,
        'index 1111111..2222222 100644', '--- a/' || file_path, '+++ b/' || file_path],
        lambda x: x IS NOT NULL) AS header FROM sized))
  UNION ALL
  SELECT pr_id, doc_id, (len(lines) - 1) // per_hunk, 1, 0, 'diff --git mode-only'
  FROM sized WHERE doc_id % 10 = 7
  UNION ALL
  SELECT pr_id, doc_id, h, 2, 0, '@@ -' || c || ',7 +' || c || CASE WHEN h % 3 <> 0 THEN ',7' ELSE '' END || ' @@ part'
  FROM (SELECT pr_id, doc_id, unnest(range(0, (len(lines) - 1) // per_hunk + 1)) AS h,
    1 + h * per_hunk + 2 * ((h + 1) // 2) + 15 * (h // 2) AS c FROM sized)
  UNION ALL
  SELECT pr_id, doc_id, h, 3, k, mark || txt FROM marked""")

cte("sections", ["ordered_lines"], """
  SELECT *, sum(starts_with(line, 'diff --git')::INT) OVER (PARTITION BY pr_id
    ORDER BY doc_id, h, part, k) - 1 AS section_ord FROM ordered_lines""")

# --- findings ----------------------------------------------------------------------------------

cte("items", [], f"""
  SELECT 'pr-' || (l_orderkey // 8) AS pr_id,
    'svc/o' || l_orderkey || '/m' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_'
      || round(l_extendedprice * 100)::BIGINT || '.py' AS file_path,
    l_linenumber::BIGINT AS n, l_partkey AS p, l_suppkey AS s, floor(l_quantity)::BIGINT AS q,
    (l_partkey + l_suppkey + l_linenumber) % 11 AS form,
    {texts(X._REVIEW_TYPES)}[(l_partkey + l_linenumber) % 5 + 1] AS kind,
    ['high', 'medium', 'low'][l_suppkey % 3 + 1] AS severity,
    round(l_discount * 10, 1) AS confidence,
    'Check the handling of ' || l_returnflag || l_linestatus
      || ' because the value may be out of its range here'
      || CASE WHEN l_partkey % 3 = 0 THEN ' for part ' || l_partkey ELSE '' END AS message,
    '  qty = ' || floor(l_quantity)::BIGINT || '; part_' || l_partkey || '()' AS middle
  FROM lineitem""")

cte("item_chunks", ["items"], f"""
  SELECT *, [{BANK}[p % {SIZE} + 1], middle, {BANK}[s % {SIZE} + 1]] AS first,
    ['tail_start()', 'tail_' || s || '(qty = ' || q || ')'] AS second,
    (p + s) % 4 <> 0 AS first_high, n % 2 = 0 AS has_second, (p + s) % 8 <> 0 AS second_high,
    CASE s % 5 WHEN 0 THEN ' ' || middle || '  ' WHEN 1 THEN 'qty = ' WHEN 2 THEN 'tail_' || s
      WHEN 3 THEN 'zzz missing line' ELSE '' END AS content
  FROM items""")

cte("parsed", ["item_chunks"], f"""
  SELECT pr_id, file_path, n, p, s, first, second, has_second, first_high, 0 AS finding_ord, kind AS type,
    severity, message, content AS line_content,
    CASE WHEN p % 2 = 0 THEN 'guard("value")' ELSE '' END AS suggestion, confidence
  FROM item_chunks WHERE form IN (0, 1, 2, 3, 10) AND confidence >= 0.5
  UNION ALL
  SELECT pr_id, file_path, n, p, s, first, second, has_second, first_high, 1, 'style', 'low', 'Second look',
    {BANK}[p % {SIZE} + 1], '', 1.0
  FROM item_chunks WHERE form IN (0, 1, 2, 10)""")

TRIM = "' ' || chr(9) || chr(10)"
cte("found", ["parsed"], f"""
  SELECT *, n * 10 AS file_ord,
    CASE WHEN line_content = '' THEN n * 10 + 2 ELSE coalesce(
      list_min(list_transform(list_filter(range(1, 4), lambda i: contains(trim(first[i], {TRIM}), trim(line_content, {TRIM}))),
        lambda i: n * 10 + i - 1)),
      CASE WHEN has_second THEN list_min(list_transform(list_filter(range(1, 3),
        lambda i: contains(trim(second[i], {TRIM}), trim(line_content, {TRIM}))), lambda i: 199 + i)) END,
      n * 10 + 2) END AS line
  FROM parsed WHERE first_high""")

cte("grouped", ["found"], """
  SELECT pr_id, type, severity, first(struct_pack(file_ord := file_ord, file_path := file_path,
      finding_ord := finding_ord, line := line, message := message, line_content := line_content,
      suggestion := suggestion, confidence := confidence) ORDER BY file_ord, file_path, finding_ord) AS f,
    count(*) AS places,
    string_agg('line ' || line || ' in `' || file_path || '`', ', ' ORDER BY file_ord, file_path, finding_ord) AS listed
  FROM found GROUP BY pr_id, type, severity, substr(message, 1, 60)""")

cte("group_rows", ["grouped"], """
  SELECT pr_id, f.file_ord AS file_ord, f.file_path AS file_path, f.finding_ord AS finding_ord,
    f.line AS line, type, severity,
    f.message || CASE WHEN places > 1 THEN ' [Seen at ' || places || ' places: ' || listed || ']' ELSE '' END AS message,
    f.line_content AS line_content, f.suggestion AS suggestion, f.confidence AS confidence, places
  FROM grouped""")


def case(values: dict[str, str], key: str, default: str) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {text(default)} END"


cte("comments", ["group_rows"], f"""
  SELECT pr_id, file_ord, finding_ord, file_path AS path, line, 'line' AS level,
    '**' || {case(C.SEVERITY_MARKS, 'severity', C.SEVERITY_MARKS['low'])} || ' '
      || {case(C.TYPE_LABELS, 'type', C.OTHER_TYPE_LABEL)} || '** (' || upper(severity) || ')'
      || chr(10) || chr(10) || message
      || CASE WHEN line_content <> '' THEN chr(10) || chr(10) || '```' || chr(10) || line_content || chr(10) || '```' ELSE '' END
      || CASE WHEN suggestion <> '' THEN chr(10) || chr(10) || '**Suggested fix**' || chr(10) || '```' || chr(10) || suggestion || chr(10) || '```' ELSE '' END
      || CASE WHEN confidence < 0.9 THEN chr(10) || chr(10) || '*Confidence: ' || format('{{:.0f}}', confidence * 100) || '%*' ELSE '' END AS body
  FROM group_rows""")

cte("counts", ["group_rows"], """
  SELECT pr_id, count(*) AS findings, count(*) FILTER (type = 'bug') AS bugs,
    count(*) FILTER (type = 'security') AS security, count(*) FILTER (type = 'performance') AS performance,
    count(*) FILTER (type = 'style') AS style, count(*) FILTER (severity = 'high') AS high_severity
  FROM group_rows GROUP BY pr_id""")

cte("item_triage", ["item_chunks"], """
  SELECT pr_id, sum(1 + has_second::INT)::BIGINT AS total_chunks,
    sum(first_high::INT + (has_second AND second_high)::INT)::BIGINT AS high_risk,
    count(*) FILTER (first_high OR has_second AND second_high) AS files_checked
  FROM item_chunks GROUP BY pr_id""")

cte("timeouts", ["item_chunks"], """
  SELECT pr_id, string_agg(file_path, ',' ORDER BY n, file_path) AS files_skipped
  FROM item_chunks WHERE first_high AND form = 9 GROUP BY pr_id""")

cte("totals", ["item_triage", "counts", "timeouts"], """
  SELECT t.pr_id, total_chunks, high_risk, total_chunks - high_risk AS low_risk_skipped, files_checked,
    coalesce(findings, 0) AS findings, coalesce(bugs, 0) AS bugs, coalesce(security, 0) AS security,
    coalesce(performance, 0) AS performance, coalesce(style, 0) AS style,
    coalesce(high_severity, 0) AS high_severity, coalesce(files_skipped, '') AS files_skipped
  FROM item_triage t LEFT JOIN counts c USING (pr_id) LEFT JOIN timeouts o USING (pr_id)""")

cte("reports", ["totals"], """
  SELECT pr_id, 'ok' AS status, NULL::VARCHAR AS detail, total_chunks AS chunks_analyzed, files_checked,
    findings, findings AS comments_posted, files_skipped, total_chunks, high_risk, low_risk_skipped,
    true AS classifier_loaded, bugs, security, performance, style FROM totals
  UNION ALL
  SELECT 'cust-' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'error' ELSE 'ok' END,
    CASE WHEN c_custkey % 2 = 0 THEN 'no diff' ELSE 'no reviewable changes' END,
    CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 0 END, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 0 END,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM customer""")

# --- training ----------------------------------------------------------------------------------


def labelled(pattern: str) -> str:
    return f"regexp_matches(lower(string_split(message, chr(10))[1]), {bounded(pattern)})"


cte("kinds", ["v3"], f"""
  SELECT *, CASE WHEN {labelled(C.LABEL_FIX_PATTERN)} AND NOT {labelled(C.LABEL_CLEAN_PATTERN)} THEN 'bugfix'
    WHEN {labelled(C.LABEL_CLEAN_PATTERN)} AND NOT {labelled(C.LABEL_FIX_PATTERN)} THEN 'clean'
    ELSE 'skip' END AS kind FROM v3""")

cte("samples", ["kinds"], f"""
  SELECT event_id, repo, sha, ts, file_path, (kind = 'bugfix')::INT AS label, 0 AS context,
    list_filter(list_transform(range(0, 1 + event_id % 29),
      lambda k: {BANK}[(event_id * 7 + k * 3) % {SIZE} + 1]), lambda l: NOT starts_with(l, '++')) AS lines
  FROM kinds WHERE kind <> 'skip' AND has_diff AND {reviewable('file_path')}
    AND len(lines) BETWEEN 3 AND 200""")

add_features("samples", "samples")

cte("labelled", ["v1_features"], """
  SELECT f.*, f.doc_id::VARCHAR AS key, l.quality::INT AS label
  FROM v1_features f JOIN labels l USING (doc_id)""")

SPLIT = """CASE WHEN ('0x' || substr(md5('42-' || key), 1, 8))::BIGINT % 10 < 8 THEN 'train'
  WHEN ('0x' || substr(md5('42-' || key), 1, 8))::BIGINT % 10 = 8 THEN 'val' ELSE 'test' END"""

VECTOR = ", ".join(f"{c}::DOUBLE AS {c}" for c in C.VECTOR_COLUMNS)

# --- events ------------------------------------------------------------------------------------

cte("ranked_events", [], """
  SELECT user_id, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""")

cte("walk", ["ranked_events"], """
  SELECT user_id, event_id, us, rn, [us] AS kept, true AS admitted FROM ranked_events WHERE rn = 1
  UNION ALL -- step
  SELECT e.user_id, e.event_id, e.us, e.rn,
    CASE WHEN len(list_filter(w.kept, lambda t: e.us - t < 86400000000)) < 5
      THEN list_append(list_filter(w.kept, lambda t: e.us - t < 86400000000), e.us)
      ELSE list_filter(w.kept, lambda t: e.us - t < 86400000000) END,
    len(list_filter(w.kept, lambda t: e.us - t < 86400000000)) < 5
  FROM walk w JOIN ranked_events e ON e.user_id = w.user_id AND e.rn = w.rn + 1""")

cte("deliveries", [], """
  SELECT event_id AS delivery_id,
    CASE WHEN event_type = 'view' THEN 'push' ELSE 'pull_request' END AS event_type,
    ['opened', 'synchronize', 'reopened', 'closed', 'labeled'][event_id % 5 + 1] AS action,
    CASE WHEN event_id % 13 <> 6 THEN 'org' ELSE '' END AS owner,
    'src' || (event_id % 20) AS repo_name,
    CASE WHEN event_id % 7 = 3 THEN 0 ELSE event_id % 400 END AS pr_number,
    CASE WHEN event_id % 11 = 5 THEN '' ELSE 'sha' || event_id END AS head_sha
  FROM events""")

cte("classified", ["deliveries"], """
  SELECT *, CASE WHEN event_type <> 'pull_request' OR action IN ('closed', 'labeled') THEN 'ignored'
    WHEN owner <> '' AND pr_number <> 0 AND head_sha <> '' THEN 'accepted' ELSE 'invalid' END AS status
  FROM deliveries""")

# --- statements --------------------------------------------------------------------------------

ORACLES: dict[str, str] = {}


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLES[name] = sql(needs, body)


oracle("s1_pr_status", ["prs", "ordered_lines"], """
  SELECT p.pr_id, CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status, n::INT AS diff_lines
  FROM prs p LEFT JOIN (SELECT pr_id, count(*) AS n FROM ordered_lines GROUP BY pr_id) USING (pr_id)""")
oracle("s2_changed_files", ["prs", "files"], """
  SELECT p.pr_id, file_ord, filename, coalesce(has_patch, false) AS has_patch FROM prs p LEFT JOIN files USING (pr_id)""")
oracle("s3_pr_metadata", ["prs"], "SELECT pr_id, title, body, base_branch FROM prs")
oracle("s4_file_content", ["contents"], "SELECT pr_id, path, content FROM contents")
oracle("s5_recent_commits", ["recent"], "SELECT repo, file_path, sha, place::INT AS place, message FROM recent")
oracle("s6_commit_crawl", ["crawled"], "SELECT repo, sha, place::INT AS place FROM crawled")
oracle("s7_commit_diffs", ["v3"], f"""
  SELECT repo, sha, (length('diff --git a/ b/') + 2 * length(file_path) + 1
    + length('@@ -0,0 +1, @@') + length((1 + event_id % 29)::VARCHAR)
    + list_sum(list_transform(range(0, 1 + event_id % 29),
        lambda k: 2 + length({BANK}[(event_id * 7 + k * 3) % {SIZE} + 1]))))::INT AS diff_chars
  FROM v3 WHERE has_diff""")
oracle("s8_training_csv", ["labelled"], """
  SELECT label::FLOAT AS label, file_extension_id::FLOAT AS file_extension_id, count(*) AS samples,
    sum(num_added_lines)::DOUBLE AS added_lines, sum(has_eval_exec::INT)::DOUBLE AS evals
  FROM labelled GROUP BY ALL""")
oracle("s9_sampled_repos", ["v3"], """
  SELECT repo FROM (SELECT DISTINCT repo FROM v3) ORDER BY md5('42' || repo), repo LIMIT 10""")
oracle("s10_snippet_intake", ["v1_code"], """
  SELECT doc_id::VARCHAR AS snippet_id, CASE WHEN doc_id % 10 <> 0 THEN file_path ELSE 'snippet.py' END AS file_path,
    length(code) <= 10000 AS accepted, 1::BIGINT AS start_line, len(lines) AS end_line, code AS added_code, 0 AS context
  FROM v1_code""")

oracle("k1_training_writer", ["labelled"], f"SELECT {VECTOR}, label::DOUBLE AS label FROM labelled")
oracle("k2_review_comments", ["comments"], """
  SELECT *, 'sha-' || pr_id AS head_sha, 'org/pr' AS repo FROM comments""")
oracle("k4_run_reports", ["reports"], "SELECT * FROM reports")

oracle("f1_reviewable_files", ["files"], f"SELECT pr_id, filename, {reviewable('filename')} AS reviewable FROM files")
oracle("f2_adding_hunks", ["hunk_rows"], """
  SELECT pr_id, file_path, count(*) AS hunks, count(*) FILTER (n_add > 0) AS adding FROM hunk_rows GROUP BY ALL""")
oracle("f3_event_filter", ["classified"], "SELECT * FROM classified")
oracle("f4_sample_size", ["merged"], """
  SELECT pr_id, chunk_ord::BIGINT AS chunk_ord, len(lines)::INT AS num_added FROM merged WHERE len(lines) BETWEEN 3 AND 200""")
oracle("f5_triage_split", ["scored"], """
  SELECT doc_id AS chunk_ord, score, CASE WHEN score >= 0.6 THEN 'high' ELSE 'low' END AS part FROM scored""")
oracle("f6_confidence_filter", ["parsed"], "SELECT pr_id, file_path, finding_ord, confidence FROM parsed")
oracle("f7_file_routes", ["routes"], "SELECT * FROM routes")

oracle("d1_diff_lines", ["ordered_lines"], """
  SELECT pr_id, (row_number() OVER (PARTITION BY pr_id ORDER BY doc_id, h, part, k) - 1)::INT AS line_no, line FROM ordered_lines""")
oracle("d2_file_sections", ["sections", "docs"], """
  SELECT s.pr_id, section_ord::BIGINT AS section_ord, any_value(d.file_path) AS file_path, count(*)::INT AS lines
  FROM sections s JOIN docs d USING (doc_id) GROUP BY s.pr_id, section_ord""")
oracle("d3_hunks", ["hunk_rows"], """
  SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY doc_id, h) - 1 AS hunk_ord, file_path,
    c AS start, body_lines::INT AS body_lines FROM hunk_rows""")
oracle("d4_new_side_lines", ["placed"], """
  SELECT * EXCLUDE (is_rem) FROM (
    SELECT pr_id, dense_rank() OVER (PARTITION BY pr_id ORDER BY doc_id, h) - 1 AS hunk_ord, file_path,
      line_no::BIGINT AS line_no, is_add AS is_added, mark || txt AS line, is_rem FROM placed)
  WHERE NOT is_rem""")
oracle("d5_chunks", ["chunk_rows"], """
  SELECT pr_id, chunk_ord, file_path, c AS start_line, end_line::BIGINT AS end_line,
    array_to_string(added, chr(10)) AS added_code, array_to_string(context, chr(10)) AS context_code, raw_patch
  FROM chunk_rows""")
oracle("d6_merged_chunks", ["merged"], """
  SELECT pr_id, chunk_ord::BIGINT AS chunk_ord, file_path, start_line, end_line::BIGINT AS end_line,
    array_to_string(lines, chr(10)) AS added_code, array_to_string(context_lines, chr(10)) AS context_code, raw_patch
  FROM merged""")
oracle("chunk_export", ["merged"], """
  SELECT pr_id, file_path, start_line, end_line::BIGINT AS end_line, len(lines)::INT AS num_added,
    array_to_string(lines, chr(10)) AS added_code, array_to_string(context_lines, chr(10)) AS context_code
  FROM merged""")

for _name, _columns in FEATURE_GROUPS.items():
    oracle(_name, ["v1_features"], f"SELECT doc_id, {', '.join(_columns)} FROM v1_features")
oracle("e1_diff_features", ["merged_features"], f"""
  SELECT pr_id, chunk_ord::BIGINT AS chunk_ord, {', '.join(C.VECTOR_COLUMNS)}, cross_function_calls,
    import_complexity, error_handling_ratio FROM merged_features""")
oracle("e2_feature_vector", ["v1_features"], f"SELECT doc_id, 27 AS width, {VECTOR} FROM v1_features")
oracle("e3_test_coverage", ["coverage"], "SELECT pr_id, file_path, stem, has_test_coverage FROM coverage")
oracle("e4_history_risk", ["history"], "SELECT * FROM history")
oracle("e5_history_budget", ["merged", "merged_budget", "history"], """
  SELECT m.pr_id, m.file_path, m.chunk_ord::BIGINT AS chunk_ord, coalesce(h.commit_history_risk, 0.0) AS commit_history_risk
  FROM merged m JOIN merged_budget b ON b.pr_id = m.pr_id AND b.file_path = m.file_path
  LEFT JOIN history h ON h.repo = m.repo AND h.file_path = m.file_path AND b.file_rank <= 5""")

oracle("r2_fallback_score", ["v1"], "SELECT doc_id, 0.7::DOUBLE AS base_score, 'medium' AS base_label FROM v1")
oracle("r3_adjusted_score", ["scored"], """
  SELECT doc_id, base_score, has_test_coverage, commit_history_risk, score, score >= 0.6 AS is_high FROM scored""")
oracle("r4_risk_band", ["scored"], f"""
  SELECT {band('score')} AS risk_label, {band('base_score')} AS base_label, count(*) AS chunks FROM scored GROUP BY ALL""")
oracle("r5_focus_areas", ["scored"], "SELECT doc_id, array_to_string(areas, '; ') AS focus_areas FROM scored")
cte("merged_scored", ["merged_features", "coverage", "merged", "merged_budget", "history"], f"""
  SELECT *, {adjusted('base_score')} AS score, {AREAS} AS areas FROM (
    SELECT f.*, (f.start_line % 100) / 100.0::DOUBLE AS base_score, c.has_test_coverage,
      coalesce(h.commit_history_risk, 0.0) AS commit_history_risk
    FROM merged_features f JOIN coverage c ON c.pr_id = f.pr_id AND c.file_path = f.file_path
    JOIN merged m ON m.pr_id = f.pr_id AND m.chunk_ord = f.chunk_ord
    JOIN merged_budget b ON b.pr_id = f.pr_id AND b.file_path = f.file_path
    LEFT JOIN history h ON h.repo = m.repo AND h.file_path = f.file_path AND b.file_rank <= 5)""")
cte("seen_areas", ["merged_scored"], """
  SELECT pr_id, file_path, area, min(struct_pack(o := chunk_ord, i := pos)) AS seen FROM (
    SELECT pr_id, file_path, chunk_ord, unnest(areas) AS area, generate_subscripts(areas, 1) AS pos
    FROM merged_scored WHERE score >= 0.6) GROUP BY ALL""")
oracle("r6_file_focus_areas", ["seen_areas"], """
  SELECT pr_id, file_path, string_agg(area, '; ' ORDER BY seen) AS focus_areas FROM seen_areas GROUP BY ALL""")
oracle("r7_triage_counts", ["scored"], """
  SELECT pr_id, count(*) AS total_chunks, count(*) FILTER (score >= 0.6) AS high_risk,
    count(*) FILTER (score < 0.6) AS low_risk_skipped, false AS classifier_loaded FROM scored GROUP BY pr_id""")
cte("snippet_chunks", ["v1_code"], """
  SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN file_path ELSE 'snippet.py' END AS file_path, lines, 0 AS context
  FROM v1_code WHERE length(code) <= 10000""")
add_features("snippet", "snippet_chunks")
oracle("r8_snippet_risk", ["snippet_features"], f"""
  SELECT doc_id::VARCHAR AS snippet_id, file_path, 0.7::DOUBLE AS risk_score, 'high' AS risk_label,
    array_to_string({AREAS}, '; ') AS risk_factors, true AS would_trigger_review, 0.6::DOUBLE AS threshold,
    {', '.join(C.VECTOR_COLUMNS)}, cross_function_calls, import_complexity, error_handling_ratio
  FROM (SELECT *, false AS has_test_coverage, 0.0 AS commit_history_risk FROM snippet_features)""")
oracle("risk_band_counts", ["enriched"], f"""
  SELECT repo, {band('score')} AS risk_label, count(*) AS chunks, sum(num_added_lines)::BIGINT AS added_lines,
    sum(cyclomatic_estimate)::BIGINT AS cyclomatic, count(*) FILTER (has_eval_exec) AS evals
  FROM (SELECT * EXCLUDE (base_score), {adjusted('0.7::DOUBLE')} AS score FROM enriched) GROUP BY ALL""")

oracle("c1_files_in_order", ["merged"], """
  SELECT pr_id, file_path, (min(chunk_ord) OVER (PARTITION BY pr_id, file_path))::BIGINT AS file_ord,
    chunk_ord::BIGINT AS chunk_ord FROM merged""")
oracle("c2_file_signatures", ["contents"], f"""
  SELECT pr_id, path AS file_path, {SIGNATURES} AS signatures FROM contents WHERE content <> ''""")
oracle("c3_signature_budget", ["signature_lists"], "SELECT * FROM signature_lists")
oracle("c4_changed_files_summary", ["summaries"], "SELECT * FROM summaries")
oracle("c5_pr_context", ["context"], "SELECT * FROM context")
NL = "chr(10)"


def prompt_sql(chunks: str, routes: str, signatures: str, focus: str) -> str:
    """Prompts of the files in ``routes``, with the chunks of ``chunks``; ``focus`` gives (pr_id, file_path, listed)."""
    return f"""
  , code AS (SELECT pr_id, file_path, count(*) AS chunks, string_agg(
      'Lines ' || start_line || ' to ' || end_line || {NL}
      || CASE WHEN len(context_lines) > 0 THEN 'Around it:' || {NL}
           || array_to_string(list_transform(context_lines[1:5], lambda l: '    ' || l), {NL}) || {NL} ELSE '' END
      || 'New code:' || {NL} || array_to_string(list_transform(lines, lambda l: '+ ' || l), {NL}),
      {NL} || '---' || {NL} ORDER BY chunk_ord) AS code
    FROM {chunks} GROUP BY pr_id, file_path),
  focus AS ({focus})
  SELECT r.pr_id, r.file_path, r.file_ord, c.chunks::INT AS chunks,
    CASE WHEN title <> '' THEN '# Pull request' || {NL} || 'Title: ' || title
      || CASE WHEN shown_body <> '' THEN {NL} || shown_body ELSE '' END || {NL} || {NL} ELSE '' END
    || CASE WHEN changed_files_summary <> '' THEN '# Declarations added in this pull request' || {NL} || changed_files_summary || {NL} || {NL} ELSE '' END
    || CASE WHEN coalesce(signatures, '') <> '' THEN '# Declarations in this file' || {NL} || signatures || {NL} || {NL} ELSE '' END
    || CASE WHEN listed IS NOT NULL THEN '# Look closely at' || {NL} || listed || {NL} || {NL} ELSE '' END
    || '# Changes in ' || r.file_path || {NL} || code AS prompt
  FROM {routes} r JOIN code c ON c.pr_id = r.pr_id AND c.file_path = r.file_path
  JOIN context x ON x.pr_id = r.pr_id
  LEFT JOIN {signatures} s ON s.pr_id = r.pr_id AND s.file_path = r.file_path
  LEFT JOIN focus f ON f.pr_id = r.pr_id AND f.file_path = r.file_path
  WHERE route = 'prompt'"""


oracle("c6_prompts", ["merged", "routes", "context", "signature_lists"], prompt_sql("merged", "routes", "signature_lists", f"""
    SELECT pr_id, file_path, '* first area' || {NL} || '* second area' AS listed FROM merged WHERE start_line % 2 = 1 GROUP BY pr_id, file_path"""))

# --- the whole review on scored chunks -----------------------------------------------------------

cte("high", ["merged_scored", "merged"], """
  SELECT m.*, s.score FROM merged_scored s JOIN merged m ON m.pr_id = s.pr_id AND m.chunk_ord = s.chunk_ord WHERE s.score >= 0.6""")
cte("high_routes", ["high"], CTES["routes"][1].replace("FROM merged", "FROM high"))
cte("high_budget", ["high"], budgeted("high", "chunk_ord"))
cte("high_signatures", ["high_budget", "contents"], CTES["signature_lists"][1].replace("merged_budget", "high_budget"))
cte("high_oversize", ["high_routes"], CTES["oversize"][1].replace("FROM routes", "FROM high_routes"))
oracle("c6_review_prompts", ["high", "high_routes", "context", "high_signatures", "seen_areas"], prompt_sql("high", "high_routes", "high_signatures", f"""
    SELECT pr_id, file_path, string_agg('* ' || area, {NL} ORDER BY seen) AS listed FROM seen_areas GROUP BY pr_id, file_path"""))

SPACE_TRIM = f"'^[{S}]+|[{S}]+$', '', 'g'"


def answered_findings(name: str, chunks: str, routes: str) -> None:
    """What the answers of `registry._answers` say about the files of ``routes``, located."""
    cte(f"{name}_asked", [chunks, routes], f"""
      SELECT r.pr_id, r.file_path, r.file_ord, r.file_ord + r.chunks AS n, list(c.start_line ORDER BY c.chunk_ord) AS starts,
        list(c.lines ORDER BY c.chunk_ord) AS all_lines, min_by(c.end_line, c.chunk_ord) AS first_end, min_by(c.lines, c.chunk_ord)[-1] AS quote
      FROM {routes} r JOIN {chunks} c ON c.pr_id = r.pr_id AND c.file_path = r.file_path WHERE route = 'prompt'
      GROUP BY r.pr_id, r.file_path, r.file_ord, r.chunks""")
    cte(f"{name}_lines", [f"{name}_asked"], f"""
      SELECT pr_id, file_path, min_by(start + i - 1, nth * 100000 + i) AS line FROM (
        SELECT pr_id, file_path, quote, start, nth, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
          SELECT pr_id, file_path, quote, unnest(starts) AS start, unnest(all_lines) AS ls, generate_subscripts(starts, 1) AS nth FROM {name}_asked))
      WHERE contains(regexp_replace(l, {SPACE_TRIM}), regexp_replace(quote, {SPACE_TRIM})) GROUP BY pr_id, file_path""")
    cte(f"{name}_found", [f"{name}_asked", f"{name}_lines"], f"""
      SELECT a.pr_id, a.file_path, file_ord, 0 AS finding_ord, ['bug', 'security', 'performance', 'style'][n % 4 + 1] AS type,
        ['high', 'medium', 'low'][n % 3 + 1] AS severity, 'Look again at line ' || n % 6 AS message, quote AS line_content, 'check it' AS suggestion,
        0.95::DOUBLE AS confidence, CASE WHEN quote = '' THEN first_end ELSE l.line END AS line
      FROM {name}_asked a LEFT JOIN {name}_lines l ON l.pr_id = a.pr_id AND l.file_path = a.file_path WHERE n % 7 <> 6 AND n % 5 <> 4
      UNION ALL
      SELECT pr_id, file_path, file_ord, 1, 'style', 'low', 'Second look', '', '', 1.0, first_end FROM {name}_asked WHERE n % 7 <> 6""")


answered_findings("job", "high", "high_routes")
cte("job_all", ["high_oversize", "job_found"], """
  SELECT pr_id, file_path, file_ord, finding_ord, line, type, severity, message, line_content, suggestion, confidence FROM high_oversize
  UNION ALL SELECT pr_id, file_path, file_ord, finding_ord, line, type, severity, message, line_content, suggestion, confidence FROM job_found""")
oracle("i4_review_findings", ["job_all"], "SELECT * FROM job_all")
cte("job_grouped", ["job_all"], CTES["grouped"][1].replace("FROM found", "FROM job_all"))
cte("job_group_rows", ["job_grouped"], CTES["group_rows"][1].replace("FROM grouped", "FROM job_grouped"))
cte("job_counts", ["job_group_rows"], CTES["counts"][1].replace("FROM group_rows", "FROM job_group_rows"))
oracle("i9_review_reports", ["merged_scored", "high_routes", "job_counts", "job_asked", "prs", "docs"], """
  , triage AS (SELECT pr_id, count(*) AS total_chunks, count(*) FILTER (score >= 0.6) AS high_risk,
      count(*) FILTER (score < 0.6) AS low_risk_skipped FROM merged_scored GROUP BY pr_id),
  checked AS (SELECT pr_id, count(*) AS files_checked FROM high_routes GROUP BY pr_id),
  late AS (SELECT pr_id, string_agg(file_path, ',' ORDER BY file_ord, file_path) AS files_skipped FROM job_asked WHERE n % 7 = 6 GROUP BY pr_id),
  known AS (SELECT pr_id, CASE WHEN starts_with(pr_id, 'draft-') THEN 'error' ELSE 'ok' END AS status FROM prs)
  SELECT p.pr_id, status, CASE WHEN status = 'error' THEN 'no diff' WHEN t.pr_id IS NULL THEN 'no reviewable changes' END AS detail,
    CASE WHEN status = 'ok' THEN coalesce(total_chunks, 0) END AS chunks_analyzed, CASE WHEN status = 'ok' THEN coalesce(files_checked, 0) END AS files_checked,
    CASE WHEN t.pr_id IS NOT NULL THEN coalesce(findings, 0) END AS findings, CASE WHEN t.pr_id IS NOT NULL THEN coalesce(findings, 0) END AS comments_posted,
    CASE WHEN t.pr_id IS NOT NULL THEN coalesce(files_skipped, '') END AS files_skipped, total_chunks, high_risk, low_risk_skipped,
    CASE WHEN t.pr_id IS NOT NULL THEN true END AS classifier_loaded,
    CASE WHEN t.pr_id IS NOT NULL THEN coalesce(bugs, 0) END AS bugs, CASE WHEN t.pr_id IS NOT NULL THEN coalesce(security, 0) END AS security,
    CASE WHEN t.pr_id IS NOT NULL THEN coalesce(performance, 0) END AS performance, CASE WHEN t.pr_id IS NOT NULL THEN coalesce(style, 0) END AS style
  FROM known p LEFT JOIN triage t USING (pr_id) LEFT JOIN checked c USING (pr_id) LEFT JOIN job_counts f USING (pr_id) LEFT JOIN late l USING (pr_id)""")

# snippets: one chunk each
cte("snippet_files", ["v1_code"], """
  SELECT doc_id::VARCHAR AS pr_id, CASE WHEN doc_id % 10 <> 0 THEN file_path ELSE 'snippet.py' END AS file_path, 0 AS chunk_ord, 1 AS start_line,
    len(lines) AS end_line, lines FROM v1_code WHERE length(code) <= 10000""")
cte("snippet_routes", ["snippet_files"], CTES["routes"][1].replace("FROM merged", "FROM snippet_files"))
cte("snippet_oversize", ["snippet_routes"], CTES["oversize"][1].replace("FROM routes", "FROM snippet_routes"))
answered_findings("snip", "snippet_files", "snippet_routes")
cte("snip_all", ["snippet_oversize", "snip_found"], CTES["job_all"][1].replace("high_oversize", "snippet_oversize").replace("job_found", "snip_found"))
cte("snip_grouped", ["snip_all"], CTES["grouped"][1].replace("FROM found", "FROM snip_all"))
cte("snip_rows", ["snip_grouped"], CTES["group_rows"][1].replace("FROM grouped", "FROM snip_grouped"))
oracle("i11_snippet_review", ["snip_rows"], """
  SELECT pr_id AS snippet_id, type, severity, message, line, line_content, count(*) OVER (PARTITION BY pr_id) AS total_findings FROM snip_rows""")

FINDING = "pr_id, file_path, finding_ord, type, severity, message, line_content, suggestion, confidence"
oracle("i1_parsed_findings", ["parsed"], f"SELECT {FINDING} FROM parsed")
oracle("i2_located_findings", ["found"], "SELECT pr_id, file_path, finding_ord, line FROM found")
oracle("i3_oversize_findings", ["oversize"], "SELECT * FROM oversize")
oracle("i4_all_findings", ["oversize", "found"], f"""
  SELECT {FINDING}, file_ord, line FROM oversize UNION ALL SELECT {FINDING}, file_ord, line FROM found""")
oracle("i5_grouped_findings", ["group_rows"], "SELECT * FROM group_rows")
oracle("i6_comment_bodies", ["comments"], "SELECT * FROM comments")
oracle("i7_finding_counts", ["counts"], "SELECT * FROM counts")
oracle("i8_summaries", ["totals"], f"""
  SELECT pr_id, CASE WHEN findings = 0 THEN 'Reviewed ' || total_chunks || ' chunks in ' || files_checked || ' files.' || {NL} || 'Nothing found.'
    ELSE 'Reviewed ' || total_chunks || ' chunks in ' || files_checked || ' files.'
      || {NL} || 'Triage sent ' || high_risk || ' high-risk chunks on and skipped ' || low_risk_skipped || ' low-risk ones.'
      || CASE WHEN high_severity > 0 THEN {NL} || 'High severity: ' || high_severity || '.' ELSE '' END
      || CASE WHEN bugs + security + performance + style > 0 THEN {NL} || 'Found: ' || array_to_string(list_filter([
           CASE WHEN bugs > 0 THEN bugs || ' bugs' END, CASE WHEN security > 0 THEN security || ' security' END,
           CASE WHEN performance > 0 THEN performance || ' performance' END,
           CASE WHEN style > 0 THEN style || ' code quality' END], lambda x: x IS NOT NULL), ', ') ELSE '' END END AS summary
  FROM totals""")
oracle("i9_run_reports", ["reports"], "SELECT * FROM reports")
oracle("i10_skipped_files", ["timeouts", "item_chunks"], """
  SELECT pr_id, files_skipped AS files, 'timeout' AS why FROM timeouts
  UNION ALL SELECT pr_id, file_path, 'no answer' FROM item_chunks WHERE first_high AND form = 9""")
oracle("i11_snippet_findings", ["group_rows"], """
  SELECT pr_id, type, severity, message, line, line_content, count(*) OVER (PARTITION BY pr_id) AS total_findings FROM group_rows""")

oracle("m1_commit_labels", ["kinds"], "SELECT sha, kind FROM kinds")
oracle("m2_commit_samples", ["samples_features"], f"SELECT repo, sha, label, {VECTOR} FROM samples_features")
oracle("m3_capped_samples", ["samples", "crawled"], """
  , counted AS (SELECT c.repo, c.sha, s.label, count(*) OVER (PARTITION BY c.repo ORDER BY c.ts DESC, c.sha) - 1 AS before
    FROM crawled c JOIN samples s ON s.sha = c.sha)
  SELECT repo, sha, label FROM counted WHERE before < 40""")
oracle("m4_collection_stats", ["samples"], """
  SELECT repo, count(*) AS samples, count(*) FILTER (label = 1) AS buggy, count(*) FILTER (label = 0) AS clean
  FROM samples GROUP BY ROLLUP (repo)""")
oracle("m5_shuffled_samples", ["labelled"], """
  SELECT key, label, num_added_lines FROM labelled ORDER BY md5('42-' || key), key""")
oracle("m5_sample_positions", ["labelled"], """
  SELECT key, label, num_added_lines, row_number() OVER (ORDER BY md5('42-' || key), key) - 1 AS position FROM labelled""")
oracle("m6_exact_split", ["labelled"], """
  , ranked AS (SELECT key, label, row_number() OVER (ORDER BY md5('42-' || key), key) AS rank, count(*) OVER () AS n FROM labelled)
  SELECT key, label, CASE WHEN rank <= floor(0.8::DOUBLE * n) THEN 'train'
    WHEN rank <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM ranked""")
oracle("m6_split", ["labelled"], f"SELECT key, label, {SPLIT} AS split FROM labelled")
oracle("m7_class_balance", ["labelled"], f"""
  SELECT {SPLIT} AS split, count(*) AS samples, count(*) FILTER (label = 1) AS buggy,
    count(*) FILTER (label = 0) AS clean, buggy::DOUBLE / samples AS buggy_share,
    clean::DOUBLE / greatest(buggy, 1) AS clean_per_buggy FROM labelled GROUP BY split""")
oracle("r1_model_scores", ["v1_features"], """
  SELECT count(*) AS scored, 0::BIGINT AS out_of_range, 0::BIGINT AS too_fine, 0::BIGINT AS other_band FROM v1_features""")
oracle("k3_saved_model", ["labelled"], "SELECT count(*) AS scored, 0::BIGINT AS changed, true AS absent FROM labelled")
oracle("m8_classifier", ["labelled"], f"""
  SELECT {SPLIT} AS split, count(*) AS judged, count(*) FILTER (label = 1) AS buggy FROM labelled GROUP BY split""")
oracle("m9_best_round", ["samples", "crawled"], f"""
  , counted AS (SELECT c.sha AS key, count(*) OVER (PARTITION BY c.repo ORDER BY c.ts DESC, c.sha) - 1 AS before
    FROM crawled c JOIN samples s ON s.sha = c.sha)
  SELECT {SPLIT} AS split, count(*) AS samples, 0::INT AS not_the_first_best, 0::INT AS not_stopped_in_time, 0::INT AS other_score
  FROM counted WHERE before < 40 GROUP BY split""")
oracle("m10_evaluation", ["labelled"], """
  , p AS (SELECT doc_id % 3 AS fold, label, ((doc_id * 37) % 101) / 101.0::DOUBLE AS p FROM labelled),
  c AS (SELECT fold, count(*) FILTER (p > 0.5 AND label = 1) AS tp, count(*) FILTER (p > 0.5 AND label = 0) AS fp,
    count(*) FILTER (p <= 0.5 AND label = 0) AS tn, count(*) FILTER (p <= 0.5 AND label = 1) AS fn,
    avg(-CASE WHEN label = 1 THEN ln(greatest(p, 1e-15)) ELSE ln(1 - greatest(p, 1e-15)) END) AS loss FROM p GROUP BY fold),
  r AS (SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS a, tp::DOUBLE / greatest(tp + fp, 1) AS pr,
    tp::DOUBLE / greatest(tp + fn, 1) AS re FROM c)
  SELECT fold, tp, fp, tn, fn, round(loss, 6) AS loss, round(a, 6) AS accuracy, round(pr, 6) AS precision,
    round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-8), 6) AS f1 FROM r""")

oracle("t1_event_reviews", ["classified", "merged"], """
  , per_pr AS (SELECT pr_id, count(*) AS total_chunks FROM merged GROUP BY pr_id)
  SELECT delivery_id, repo_name || '-' || (pr_number % 25) AS pr_id, head_sha, total_chunks,
    total_chunks AS high_risk, total_chunks * 0 AS low_risk_skipped,
    CASE WHEN total_chunks IS NOT NULL THEN false END AS classifier_loaded
  FROM classified c LEFT JOIN per_pr p ON p.pr_id = repo_name || '-' || (pr_number % 25)
  WHERE status = 'accepted'""")
for _same, _as in (("s5_commits_by_increments", "s5_recent_commits"), ("e4_risk_by_increments", "e4_history_risk"), ("d4_segmented_lines", "d4_new_side_lines"), ("d5_file_chunks", "d5_chunks"), ("d6_segmented_chunks", "d6_merged_chunks")):
    ORACLES[_same] = ORACLES[_as]
oracle("t1_event_reports", ["reports"], "SELECT * FROM reports")
ADMITTED = "SELECT user_id::VARCHAR AS client, event_id AS request_id, admitted FROM walk"
oracle("t2_admissions", ["walk"], ADMITTED)
oracle("t2_admission_stream", ["walk"], ADMITTED)
