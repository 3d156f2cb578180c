"""The expected answer of each query as SQL over the given tables.

The SQL works on the table columns alone and never sees a log line, so it
checks the decode, tree and view operators from the outside.
"""

from __future__ import annotations

from threadloom.plans.catalog import MALFORMED_EVERY, PHRASE, WORD
from threadloom.sources.bridges import TOOLBOX

NL = "chr(10)"

# --- conversations: c0 = every turn, m = messages, b = blocks, tr = ordered tree

_CHAT = f"""
c0 AS (
  SELECT conv_id AS c, turn AS t, role, text AS x,
    '-home-user-src-proj' || (conv_id % 7) AS project_key, 'conv-' || conv_id AS session_id,
    CAST(turn * 2 AS BIGINT) AS line_no,
    CASE WHEN conv_id % 11 = 0 AND turn = 0
           THEN '<command-name>/run</command-name><command-args>' || text || '</command-args>'
         WHEN conv_id % 13 = 0 THEN 'intro' || {NL} || '```sql' || {NL} || text || {NL} || '```' || {NL} || 'outro'
         ELSE text END AS said,
    conv_id % 2 = 1 AS arr, conv_id % 23 = 9 AND role = 'user' AS hollow,
    conv_id % 4 = 3 AS has_tail, role = 'assistant' AND turn % 4 = 1 AND conv_id % 2 = 1 AS thinks,
    role = 'user' AND conv_id % 10 = 4 AND turn = 2 AS is_compacted,
    turn % 5 = 3 AS is_sidechain, conv_id % 17 = 5 AND turn = 0 AS is_meta,
    epoch_us(TIMESTAMP '2024-01-01') + ((conv_id % 50000) * 3600 + turn * 5) * 1000000 AS ts_us,
    TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * ((conv_id % 50000) * 3600 + turn * 5) AS ts,
    length(text) AS n
  FROM conversations),
m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 'assistant' WHEN is_compacted THEN 'compact_summary' WHEN is_meta THEN 'meta'
                 WHEN c % 11 = 0 AND t = 0 AND NOT hollow THEN 'command' ELSE 'user_prompt' END AS kind,
    CASE WHEN hollow THEN '' WHEN has_tail THEN said || {NL} || 'tail ' || t ELSE said END AS lines_text
  FROM c0 WHERE role IN ('user', 'assistant')),
b AS (
  SELECT m.*, 0 AS block_no, 'thinking' AS block_type, 'think ' || t AS block_text FROM m WHERE thinks
  UNION ALL SELECT m.*, CAST(thinks AS INTEGER), 'text', said FROM m WHERE NOT hollow
  UNION ALL SELECT m.*, CAST(thinks AS INTEGER) + 1, 'text', 'tail ' || t FROM m WHERE has_tail AND NOT hollow),
notes AS (
  SELECT * FROM (SELECT c, project_key, session_id, t * 2 + 1 AS line_no,
    CASE WHEN c % 5 = 2 AND t = 0 THEN CASE WHEN c % 25 = 7 THEN 'Warmup' ELSE 'Summary of ' || c END
         WHEN c % 10 = 2 AND t = 1 THEN 'Later summary of ' || c END AS note
  FROM c0) WHERE note IS NOT NULL)"""

_TREE = _CHAT + """,
k AS (
  SELECT l.*, p.t AS parent_t FROM (
    SELECT *, CASE WHEN t = 0 THEN NULL WHEN c % 3 = 0 AND t >= 2 THEN t - 2 ELSE t - 1 END AS up FROM m) l
  LEFT JOIN m p ON p.c = l.c AND p.t = l.up),
w AS (
  SELECT c, t, [t] AS path, 0 AS depth FROM k WHERE parent_t IS NULL
  UNION ALL
  SELECT k.c, k.t, list_append(w.path, k.t), w.depth + 1 FROM k JOIN w ON k.c = w.c AND k.parent_t = w.t),
tr AS (
  SELECT k.*, w.path, w.depth, row_number() OVER (PARTITION BY k.c ORDER BY w.path) - 1 AS dfs_pos
  FROM k JOIN w ON k.c = w.c AND k.t = w.t)"""


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _first_line(c: str) -> str:
    return f"split_part({_trim(c)}, {NL}, 1)"


_LISTING = _CHAT + f""",
ls AS (
  SELECT c0.c, any_value(c0.project_key) AS project_key, any_value(c0.session_id) AS session_id,
    count(*) FILTER (role = 'assistant' OR (role = 'user' AND NOT is_compacted AND NOT is_meta)) AS message_count,
    count(*) FILTER (role = 'user' AND NOT is_compacted AND NOT is_meta) AS user_prompts,
    count(*) FILTER (is_compacted) AS continuations, count(*) FILTER (is_sidechain) AS agent_sidechains,
    min(ts_us) AS start_time, max(ts_us) AS end_time,
    coalesce(any_value(nn.note), min_by(first_said, t) FILTER (first_said <> '' AND first_said NOT LIKE '<%'), '(no summary)') AS summary
  FROM (SELECT *, CASE WHEN role = 'user' AND NOT is_compacted AND NOT hollow THEN {_first_line("said || CASE WHEN has_tail THEN ' tail ' || t ELSE '' END")} END AS first_said FROM c0) c0
  LEFT JOIN (SELECT c, max_by(note, line_no) AS note FROM notes GROUP BY c) nn ON nn.c = c0.c
  GROUP BY c0.c),
li AS (SELECT * FROM ls WHERE summary <> '(no summary)' AND lower(summary) <> 'warmup'),
pr AS (
  SELECT project_key, count(*) AS n_sessions, max(end_time) AS last_modified,
    replace(project_key, '-home-user-src-', '') AS display_name, replace(project_key, '-', '/') AS full_path
  FROM li GROUP BY project_key),
lp AS (SELECT li.*, pr.display_name, pr.full_path, pr.last_modified AS project_modified FROM li JOIN pr USING (project_key))"""

_DETAIL = _CHAT + f""",
ds AS (
  SELECT a.*, coalesce(s.message_count, 0) AS message_count, coalesce(s.user_prompts, 0) AS user_prompts,
    coalesce(s.continuations, 0) AS continuations, coalesce(s.agent_sidechains, 0) AS agent_sidechains,
    s.start_time, s.end_time, s.start_ts, coalesce((s.end_time - s.start_time) / 1e6, 0.0) AS duration_seconds,
    coalesce(nn.note, s.prompt, '(no summary)') AS summary
  FROM (
    SELECT c, any_value(project_key) AS project_key, any_value(session_id) AS session_id,
      CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS input_tokens,
      CAST(coalesce(sum(n // 4) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens,
      CAST(coalesce(sum(t) FILTER (role = 'assistant'), 0) AS BIGINT) AS cache_read_tokens,
      max(CASE WHEN t = 1 THEN 'slug-' || c END) AS slug, '1.0.' || (c % 5) AS version,
      min_by('branch-' || t, t) FILTER (t >= 2) AS git_branch,
      max(CASE WHEN t = 0 THEN '/home/user/src/proj' || (c % 7) END) AS cwd
    FROM c0 GROUP BY c) a
  LEFT JOIN (
    SELECT c, count(*) FILTER (kind IN ('user_prompt', 'assistant')) AS message_count,
      count(*) FILTER (kind = 'user_prompt') AS user_prompts, count(*) FILTER (is_compacted) AS continuations,
      count(*) FILTER (is_sidechain) AS agent_sidechains, min(ts_us) AS start_time, max(ts_us) AS end_time, min(ts) AS start_ts,
      min_by({_first_line("said")}, t) FILTER (kind = 'user_prompt' AND NOT hollow) AS prompt
    FROM m GROUP BY c) s ON s.c = a.c
  LEFT JOIN (SELECT c, min_by({_trim("note")}, line_no) AS note FROM notes GROUP BY c) nn ON nn.c = a.c)"""

# --- events: ec = calls, em = messages in order, eu = tool uses, er = results

_EVENTS = """
e0 AS (
  SELECT event_id AS e, user_id AS u, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, props, ts,
    '-home-user-src-proj' || (user_id % 10) AS project_key, 'user-' || user_id AS session_id,
    lag(event_id) OVER o AS prev_id, lag(event_type) OVER o AS prev_kind,
    max(CASE WHEN event_type <> 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_call,
    first_value(event_id) OVER o AS first_id
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
eu AS (
  SELECT *, e * 2 AS line_no, CAST(e % 3 = 0 AS INTEGER) AS block_no, 'tool-' || e AS tool_id,
    CASE WHEN k % 10 = 0 THEN 'Probe' WHEN kind = 'view' THEN 'Read' WHEN kind = 'click' THEN 'Bash'
         WHEN kind = 'purchase' THEN 'Task' ELSE 'Grep' END AS tool_name,
    CASE WHEN k % 10 = 0 THEN '{"k":' || k || '}'
         WHEN kind = 'view' THEN '{"file_path":"src/f' || k || '.py"}'
         WHEN kind = 'click' THEN '{"command":"run ' || k || '","timeout":' || k || '}'
         WHEN kind = 'purchase' THEN '{"description":"buy ' || k || '","prompt":"please ' || k || '","subagent_type":"agent-' || (k % 4) || '"}'
         ELSE '{"path":"src","pattern":"err' || k || '"}' END AS tool_input,
    CASE WHEN k % 10 = 0 THEN 'k=' || k WHEN kind = 'view' THEN 'src/f' || k || '.py' WHEN kind = 'click' THEN '$ run ' || k
         WHEN kind = 'purchase' THEN '[agent-' || (k % 4) || '] buy ' || k ELSE '/err' || k || '/' END AS preview,
    'cents ' || CAST(round(value * 100) AS BIGINT) AS cents
  FROM e0 WHERE kind <> 'signup'),
er AS (
  SELECT *, e * 2 + 1 AS result_line, 0 AS result_block,
    CASE WHEN e % 4 = 0 THEN '[{"text":"' || cents || '","type":"text"}]' ELSE '"' || cents || '"' END AS tool_result, kind = 'error' AS is_error FROM eu
  UNION ALL
  SELECT *, e * 2 + 1, 1, '"again ' || e || '"', false FROM eu WHERE e % 50 = 0),
el AS (
  SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY u, tool_id ORDER BY result_line DESC, result_block DESC) = 1),
em AS (
  SELECT u, e, session_id, project_key, e * 2 AS line_no, 'assistant' AS kind, e % 13 = 5 AS is_sidechain FROM e0 WHERE kind <> 'signup'
  UNION ALL SELECT u, e, session_id, project_key, e * 2 + 1, 'tool_result', false FROM e0 WHERE kind <> 'signup'
  UNION ALL SELECT u, e, session_id, project_key, e * 2 + 1, 'compact_summary', false FROM e0 WHERE kind = 'signup'),
et AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY line_no) - 1 AS dfs_pos FROM em)"""


def _chat(sql: str) -> str:
    return f"WITH {_CHAT} {sql}"


def _tree(sql: str) -> str:
    return f"WITH RECURSIVE {_TREE} {sql}"


def _listing(sql: str) -> str:
    return f"WITH {_LISTING} {sql}"


def _detail(sql: str) -> str:
    return f"WITH {_DETAIL} {sql}"


def _events(sql: str) -> str:
    return f"WITH {_EVENTS} {sql}"


def _toolbox(tool: str, columns: str, tail: str = "") -> str:
    return f"""SELECT * FROM (SELECT 'box-' || user_id AS session_id, event_id AS line_no, CAST(1 AS BIGINT) AS block_no,
      'v' || event_id AS tool_id, {columns} FROM events WHERE event_id % {len(TOOLBOX)} = {TOOLBOX.index(tool)}) {tail}"""


def _snippet(c: str, q: str, size: int) -> str:
    return _snippet_of(c, f"'{q}'", str(len(q)), size)


def _snippet_of(c: str, q: str, length: str, size: int) -> str:
    """Text around the first hit of the SQL expression ``q``."""
    at = f"(strpos(lower({c}), {q}) - 1)"
    start = f"greatest({at} - 20, 0)"
    stop = f"least({at} + {length} + {size - 20}, length({c}))"
    return (
        f"CASE WHEN {at} >= 0 THEN (CASE WHEN {start} > 0 THEN '...' ELSE '' END) || "
        f"replace(substring({c}, {start} + 1, {stop} - {start}), {NL}, ' ') || "
        f"(CASE WHEN {stop} < length({c}) THEN '...' ELSE '' END) END"
    )


def _relevance(c: str, query: str) -> str:
    words = query.split()
    divisor, bonus = ("10.0", "10.0") if len(words) == 1 else ("20.0", "5.0")
    total, found = "CAST(0 AS DOUBLE)", []
    for word in words:
        at = f"(strpos(lower({c}), '{word}') - 1)"
        base = 10.0 + (len(word) if len(words) == 1 else 0)
        total += (
            f" + CAST({base} AS DOUBLE) + CASE WHEN {at} < 100 THEN CAST(100 - {at} AS DOUBLE) / CAST({divisor} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
            f" + CASE WHEN {at} = 0 OR regexp_matches(substring(lower({c}), {at}, 1), '[^A-Za-z0-9_]') THEN CAST({bonus} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
        )
        found.append(f"{at} >= 0")
    return f"CASE WHEN {' AND '.join(found)} THEN {total} ELSE CAST(0 AS DOUBLE) END"


def _clock(c: str) -> str:
    return f"strftime({c}, '%H:%M:%S')"


# Rendering helpers for the exports of conversations.
_SHORT = "substring(ds.session_id, 1, 8)"
_DATE = "coalesce(strftime(start_ts, '%Y-%m-%d'), '0001-01-01')"
_CLOCK = "coalesce(strftime(start_ts, '%H:%M:%S'), '00:00:00')"
_MINUTE = "coalesce(strftime(start_ts, '%H:%M'), '00:00')"
_CUT_AGENT = "EXISTS (SELECT 1 FROM m a WHERE a.c = tr.c AND list_contains(tr.path, a.t) AND a.is_sidechain)"
_CUT_COMPACT = "EXISTS (SELECT 1 FROM m a WHERE a.c = tr.c AND list_contains(tr.path, a.t) AND a.t <> tr.t AND a.is_compacted)"


def _escaped(c: str) -> str:
    for raw, safe in (("&", "&amp;"), ("''", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = f"replace({c}, '{raw}', '{safe}')"
    return c


def _quoted(s: str) -> str:
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in s.split("\n"))


def _document(head: str, fragment: str, name: str, where: str = "true", foot: str = "''", json_commas: bool = False) -> str:
    joiner = "','" if json_commas else "''"
    return f"""WITH RECURSIVE {_TREE}, {_DETAIL[len(_CHAT) + 1:]},
      fr AS (SELECT c, string_agg({fragment}, {joiner} ORDER BY dfs_pos) AS body FROM tr WHERE {where} GROUP BY c)
      SELECT ds.project_key, ds.session_id, CAST(0 AS BIGINT) AS part_no, {name} AS file_name,
        {head} || coalesce(fr.body, '') || {foot} AS document
      FROM ds LEFT JOIN fr ON fr.c = ds.c"""


def _file(fmt: str) -> str:
    return f"'session-' || {_SHORT} || '.{fmt}'"


_TEXT_NAME = f"""{_DATE} || '-' || coalesce(nullif(substring(array_to_string(list_slice(
  list_filter(string_split(regexp_replace(lower(ds.summary), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> ''), 1, 6), '-'), 1, 50), ''), 'session') || '.txt'"""

# Text blocks of a message put through a template; hollow messages have none.
def _texts(make) -> str:
    return (
        f"(CASE WHEN hollow THEN '' ELSE {make('said')} || CASE WHEN has_tail THEN {make(chr(39) + 'tail ' + chr(39) + ' || t')} ELSE '' END END)"
    )


def _shown_texts(make) -> str:
    """As above for renderings that leave out empty texts; the tables hold none."""
    return _texts(make)


_MD = f"""CASE WHEN is_compacted THEN {_quoted("## ═══ Context Compacted ═══" + chr(10) * 2)} || {_texts(lambda x: f"'*' || {x} || '*' || {NL} || {NL}")} || {_quoted("---" + chr(10) * 2)}
  ELSE '## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ' (' || {_clock('ts')} || ')' || {NL} || {NL} ||
    CASE WHEN thinks THEN {_quoted("<details>" + chr(10) + "<summary>Thinking</summary>" + chr(10) * 2)} || 'think ' || t || {_quoted(chr(10) * 2 + "</details>" + chr(10) * 2)} ELSE '' END ||
    {_shown_texts(lambda x: f"{x} || {NL} || {NL}")} || {_quoted("---" + chr(10) * 2)} END"""

_ORG = f"""CASE WHEN is_compacted THEN repeat('*', depth + 2) || {_quoted(" ═══ COMPACTED ═══" + chr(10))} || {_texts(lambda x: f"{x} || {NL} || {NL}")}
  ELSE repeat('*', depth + 2) || ' ' || upper(role) || ' [' || strftime(ts, '%Y-%m-%d %a %H:%M') || ']' || {NL} ||
    {_shown_texts(lambda x: f"{x} || {NL} || {NL}")} || {NL} END"""


def _paragraphs(c: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(list_transform(string_split({c}, {NL} || {NL}), lambda p: {_trim('p')}), lambda p: p <> ''), "
        f"lambda p: '<p>' || {_escaped('p')} || '</p>' || {NL}), '')"
    )


_HTML = f"""CASE WHEN is_compacted THEN {_quoted('<div class="message compacted">' + chr(10) + '<div class="message-header compacted-header">═══ COMPACTED ═══</div>' + chr(10) + '<div class="message-content">' + chr(10))} ||
    {_texts(lambda x: f"'<p class=" + chr(34) + "dim" + chr(34) + ">' || " + _escaped(x) + f" || '</p>' || {NL}")} || {_quoted("</div>" + chr(10) + "</div>" + chr(10))}
  ELSE '<div class="message ' || role || CASE WHEN is_sidechain THEN ' sidechain' ELSE '' END || '">' || {NL} ||
    '<div class="message-header ' || role || '-header">[' || upper(role) || '] ' || {_clock('ts')} || '</div>' || {NL} || '<div class="message-content">' || {NL} ||
    CASE WHEN thinks THEN {_quoted('<details class="thinking">' + chr(10) + '<summary>Thinking</summary>' + chr(10) + '<div class="thinking-content">think ')} || t || {_quoted("</div>" + chr(10) + "</details>" + chr(10))} ELSE '' END ||
    {_shown_texts(_paragraphs)} || {_quoted("</div>" + chr(10) + "</div>" + chr(10))} END"""

_MD_KIND = f"""CASE kind
    WHEN 'command' THEN '## ⌘ /run (' || {_clock('ts')} || ')' || {NL} || {NL} || CASE WHEN {_trim('x')} <> '' THEN {_trim('x')} || {NL} || {NL} ELSE '' END
    ELSE CASE kind WHEN 'compact_summary' THEN {_quoted("---" + chr(10) + "## ◇ CONTEXT COMPACTED" + chr(10) * 2)}
      WHEN 'user_prompt' THEN '## ▶ USER (' || {_clock('ts')} || ')' || {NL} || {NL}
      WHEN 'meta' THEN '> *System Instructions* (' || {_clock('ts')} || ')' || {NL} || {NL}
      ELSE '### ● ASSISTANT (' || {_clock('ts')} || ')' || {NL} || {NL} END ||
      CASE WHEN thinks THEN {_quoted("> *∴ Thinking...*" + chr(10) * 2)} ELSE '' END || {_texts(lambda x: f"{x} || {NL} || {NL}")} END"""

_ORG_KIND = f"""CASE kind
    WHEN 'command' THEN '* ⌘ /run [' || {_clock('ts')} || ']' || {NL} || CASE WHEN {_trim('x')} <> '' THEN {_trim('x')} || {NL} ELSE '' END
    ELSE CASE kind WHEN 'compact_summary' THEN {_quoted("* ◇ CONTEXT COMPACTED" + chr(10))}
      WHEN 'user_prompt' THEN '* ▶ USER [' || {_clock('ts')} || ']' || {NL}
      WHEN 'meta' THEN '** System Instructions [' || {_clock('ts')} || ']' || {NL}
      ELSE '** ● ASSISTANT [' || {_clock('ts')} || ']' || {NL} END ||
      CASE WHEN thinks THEN {_quoted("/∴ Thinking.../" + chr(10))} ELSE '' END || {_texts(lambda x: f"{x} || {NL}")} END"""

_FIRST_TEXT = "CASE WHEN hollow THEN '' ELSE said END"
_TXT = f"""CASE kind
    WHEN 'compact_summary' THEN {_quoted("══════════════════ Conversation compacted ═════════════════" + chr(10) * 2)}
    WHEN 'user_prompt' THEN '> ' || {_FIRST_TEXT} || {NL} || {NL}
    WHEN 'command' THEN '> /run ' || {_trim('x')} || {NL} || {NL}
    WHEN 'meta' THEN ''
    ELSE '● ' || {_FIRST_TEXT} || {NL} || {NL} END"""

_TEXT_JSON = """'{"text":' || to_json(%s) || ',"type":"text"}'"""
_CONTENT_JSON = f"""(CASE WHEN hollow THEN '' ELSE CASE WHEN thinks THEN '{{"thinking":"think ' || t || '","type":"thinking"}},' ELSE '' END ||
  {_TEXT_JSON % 'said'} || CASE WHEN has_tail THEN ',' || {_TEXT_JSON % "('tail ' || t)"} ELSE '' END END)"""
_JSON = f"""'{{"line":' || (t * 2) || CASE WHEN parent_t IS NOT NULL THEN ',"parent_line":' || (parent_t * 2) ELSE '' END || ',"depth":' || depth ||
  ',"uuid":"c' || c || '-t' || t || '","type":"' || role || '","kind":"' || kind || '","is_sidechain":' || is_sidechain ||
  ',"is_compacted":' || is_compacted || ',"content":[' || {_CONTENT_JSON} || ']}}'"""
_JSON_HEAD = """'{"session":{"project_key":"' || ds.project_key || '","session_id":"' || ds.session_id || '","summary":' || to_json(ds.summary) ||
  ',"message_count":' || message_count || ',"user_prompts":' || user_prompts || ',"tool_calls":0,"continuations":' || continuations ||
  ',"agent_sidechains":' || agent_sidechains || ',"input_tokens":' || input_tokens || ',"output_tokens":' || output_tokens || '},"messages":['"""

_NOTES = """
log AS (
  SELECT event_id AS seq, ts AS event_ts,
    CASE WHEN event_id % 97 = 0 THEN 'bogus' WHEN event_id % 4 = 0 THEN 'add' WHEN event_id % 4 = 1 THEN 'remove'
         WHEN event_id % 4 = 2 THEN 'tag' ELSE 'untag' END AS action,
    CASE event_type WHEN 'view' THEN 'session' WHEN 'click' THEN 'message' ELSE 'project' END AS item_type,
    'item-' || (user_id % 40) AS item_id, 'p' || (user_id % 10) AS project_id,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS note, 'tag-' || (CAST(json_extract(props, '$.k') AS BIGINT) % 12) AS tag
  FROM events),
stars AS (
  SELECT seq AS star_id, item_type, item_id, project_id, note FROM (
    SELECT *, row_number() OVER (PARTITION BY item_type, item_id ORDER BY seq DESC) AS rn FROM log WHERE action IN ('add', 'remove'))
  WHERE rn = 1 AND action = 'add'),
links AS (
  SELECT item_type, item_id, tag AS name FROM (
    SELECT *, row_number() OVER (PARTITION BY item_type, item_id, tag ORDER BY seq DESC) AS rn FROM log WHERE action IN ('tag', 'untag'))
  WHERE rn = 1 AND action = 'tag')"""


def _notes(sql: str) -> str:
    return f"WITH {_NOTES} {sql}"


_NO_MATCH = "CAST(NULL AS VARCHAR)"


def _metadata_hits(queries: list[str], only: str = "") -> str:
    parts = []
    for q in queries:
        if only != "session":
            parts.append(
                f"""SELECT '{q}' AS query, 1 AS priority, 'project' AS type, project_key, {_NO_MATCH} AS session_id, display_name AS project,
                full_path AS summary, last_modified AS project_modified, CAST(NULL AS BIGINT) AS end_time FROM pr
                WHERE contains(lower(project_key), '{q}') OR contains(lower(full_path), '{q}') OR contains(lower(display_name), '{q}')"""
            )
        parts.append(
            f"""SELECT '{q}' AS query, CASE WHEN starts_with(lower(session_id), '{q}') THEN 0 ELSE 2 END AS priority, 'session' AS type, project_key, session_id,
            display_name AS project, summary, project_modified, end_time FROM lp
            WHERE starts_with(lower(session_id), '{q}') OR contains(lower(summary), '{q}')"""
        )
    return " UNION ALL ".join(parts)


_HIT_RANK = """row_number() OVER (PARTITION BY query ORDER BY priority, project_modified DESC, project_key, type <> 'project',
  end_time DESC NULLS LAST, session_id NULLS FIRST)"""


def _content_hits(q: str, source: str = "tr") -> str:
    return f"""SELECT '{q}' AS query, c, session_id, line_no, 'c' || c || '-t' || t AS message_id, snippet FROM (
      SELECT tr.c, tr.t, tr.session_id, tr.line_no, {_snippet('b.block_text', q, 60)} AS snippet,
        row_number() OVER (PARTITION BY tr.c ORDER BY tr.dfs_pos, b.block_no) AS rn
      FROM tr JOIN b ON b.c = tr.c AND b.t = tr.t WHERE b.block_type = 'text' AND contains(lower(b.block_text), '{q}')) WHERE rn = 1"""


def _tool_hits(q: str) -> str:
    return f"""SELECT '{q}' AS query, session_id, line_no, message_id, snippet FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY line_no, block_no) AS rn FROM (
        SELECT u, session_id, line_no, 0 AS block_no, 'e' || e || '-u' AS message_id, {_snippet("'step ' || e", q, 60)} AS snippet FROM eu WHERE e % 3 = 0
        UNION ALL SELECT u, session_id, line_no, block_no, 'e' || e || '-u', '[' || tool_name || '] ' || {_snippet('tool_input', q, 40)} FROM eu
        UNION ALL SELECT u, session_id, result_line, result_block, 'e' || e || '-r', {_snippet("shown", q, 60)} FROM
          (SELECT *, CASE WHEN starts_with(tool_result, '"') THEN json_extract_string(tool_result, '$') ELSE tool_result END AS shown FROM er)
        UNION ALL SELECT u, session_id, e * 2 + 1, 0, 'e' || e || '-c', {_snippet("'Compacted at ' || e", q, 60)} FROM e0 WHERE kind = 'signup')
      WHERE snippet IS NOT NULL) WHERE rn = 1"""


def _facets(query: str, facets: list[str]) -> str:
    parts = []
    command = f"CASE WHEN kind = 'command' THEN '/run' || {NL} || {_trim('x')} ELSE lines_text END"
    score = _relevance(command, query)
    if "user" in facets:
        parts.append(f"SELECT '{query}' AS query, 'user' AS type, session_id, line_no, -1 AS block_no, {score} AS raw, 50 AS bonus FROM m WHERE kind = 'user_prompt'")
    if "response" in facets:
        parts.append(f"SELECT '{query}' AS query, 'response' AS type, session_id, line_no, -1 AS block_no, {score} AS raw, 0 AS bonus FROM m WHERE kind <> 'user_prompt'")
    if "thinking" in facets:
        parts.append(f"SELECT '{query}' AS query, 'thinking' AS type, session_id, line_no, block_no, {_relevance('block_text', query)} AS raw, 0 AS bonus FROM b WHERE block_type = 'thinking'")
    whole = " UNION ALL ".join(parts)
    return _chat(f"SELECT query, type, session_id, line_no, CAST(block_no AS BIGINT) AS block_no, raw + bonus AS score FROM ({whole}) WHERE raw > 0")


_LISTED = "SELECT session_id, project_key, summary"
_PAGE_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
_PAGE_KEY = f"regexp_replace(replace((CASE WHEN page_id % 2 = 0 THEN '/home/kim/work/github/com' ELSE '/Users/kim/src' END) || {_PAGE_PATH}, '/', '-'), '^-', '')"
_AGE = "(epoch_us(TIMESTAMP '2024-01-12') - epoch_us(ts))"

_TAILED = _chat("""SELECT session_id, line_no, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS tail_kind,
      role = 'assistant' AND is_sidechain AS is_agent FROM m WHERE NOT is_meta AND NOT is_compacted""")

# Events in files: two lines per event, without gaps.
_EVENTS_NTH = _EVENTS + ", nth AS (SELECT e, row_number() OVER (PARTITION BY u ORDER BY e) - 1 AS nth FROM e0)"
_DENSE = "(nth * 2 + 1)"


def _long(sql: str, more: str = "") -> str:
    """One long session per project; ``hidden`` follows sidechains and what hangs below compact summaries."""
    return f"""WITH RECURSIVE l AS (
        SELECT '-home-user-src-proj' || (user_id % 10) AS project_key, 'long-' || (user_id % 10) AS session_id,
          row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1 AS n FROM events),
      k AS (
        SELECT *, CASE WHEN n = 0 THEN NULL WHEN n % 7 = 0 THEN n // 2 ELSE n - 1 END AS up, n % 50 = 49 AS compact, n % 97 = 41 AS side,
          CASE WHEN n % 50 = 49 THEN 'compact_summary' WHEN n % 4 = 0 THEN 'user_prompt' ELSE 'assistant' END AS kind FROM l),
      w AS (
        SELECT session_id, n, kind, compact, [n] AS path, 0 AS depth, side AS hidden FROM k WHERE up IS NULL
        UNION ALL
        SELECT k.session_id, k.n, k.kind, k.compact, list_append(w.path, k.n), w.depth + 1, w.hidden OR w.compact OR k.side
        FROM k JOIN w ON k.session_id = w.session_id AND k.up = w.n){more}
      {sql}"""


# Parts by the lengths of the contents: a part is full after 2,000 characters, 64 of them per message for its marks.
_WEIGHT = f"length(CASE WHEN arr OR hollow THEN '[' || {_CONTENT_JSON} || ']' ELSE CAST(to_json(said) AS VARCHAR) END)"
_MD_PARTS = f"""WITH RECURSIVE {_TREE}, {_DETAIL[len(_CHAT) + 1:]},
  sized AS (SELECT *, {_WEIGHT} + 64 AS cost FROM tr),
  cut AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY c ORDER BY dfs_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS part FROM sized),
  fr AS (SELECT c, part, string_agg({_MD_KIND}, '' ORDER BY dfs_pos) AS body FROM cut GROUP BY c, part),
  heads AS (SELECT ds.*, '# Session ' || ds.session_id || {_quoted(chr(10) * 2 + "**Started:** ")} || {_DATE} || ' ' || {_CLOCK} || {_quoted(chr(10) * 2 + "**Messages:** ")}
    || message_count || ' | **Tools:** 0' || {_quoted(chr(10) * 2 + "---" + chr(10) * 2)} AS head FROM ds)
  SELECT project_key, session_id, CAST(coalesce(part, 0) AS BIGINT) AS part_no,
    'session-' || substring(session_id, 1, 8) || CASE WHEN coalesce(part, 0) = 0 THEN '' ELSE '-part-' || lpad(CAST(CAST(part AS BIGINT) + 1 AS VARCHAR), 4, '0') END || '.md' AS file_name,
    CASE WHEN coalesce(part, 0) = 0 THEN head ELSE '' END || coalesce(body, '') AS document
  FROM heads LEFT JOIN fr ON fr.c = heads.c"""


# --- exports of sessions of tool calls: xm = messages in order with their calls and results

_CALL_TREE = _EVENTS + """,
xa AS (
  SELECT e0.*, eu.tool_name, eu.tool_input, eu.preview, eu.cents,
    count(*) FILTER (e0.kind <> 'signup') OVER (PARTITION BY e0.u ORDER BY e0.e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(e0.kind <> 'signup' AS INTEGER) AS calls_before,
    min(CASE WHEN e0.kind <> 'signup' AND e0.e % 13 = 5 THEN e0.e END) OVER (PARTITION BY e0.u) AS first_side
  FROM e0 LEFT JOIN eu ON eu.e = e0.e),
xm AS (
  SELECT *, 'assistant' AS role, e * 2 AS line_no, calls_before * 2 AS depth FROM xa WHERE kind <> 'signup'
  UNION ALL SELECT *, 'result', e * 2 + 1, calls_before * 2 + 1 FROM xa WHERE kind <> 'signup'
  UNION ALL SELECT *, 'compact', e * 2 + 1, calls_before * 2 FROM xa WHERE kind = 'signup'),
xt AS (
  SELECT *, coalesce(e < first_side, true) AS shown, row_number() OVER (PARTITION BY u ORDER BY line_no) - 1 AS dfs_pos,
    CASE WHEN e % 4 = 0 THEN '[{"text":"' || cents || '","type":"text"}]' ELSE cents END AS answer, e % 50 = 0 AS twice,
    kind = 'error' AS failed FROM xm),
xs AS (
  SELECT u, any_value(project_key) AS project_key, any_value(session_id) AS session_id, count(*) FILTER (kind <> 'signup') AS calls,
    count(*) FILTER (kind = 'signup') AS continuations, count(*) FILTER (kind <> 'signup' AND e % 13 = 5) AS sidechains, min_by(ts, e) AS start_ts
  FROM e0 WHERE kind <> 'signup' OR true GROUP BY u)"""

_ARGS = f"""CASE tool_name WHEN 'Probe' THEN 'k: ' || k WHEN 'Read' THEN 'file_path: src/f' || k || '.py'
  WHEN 'Bash' THEN 'command: run ' || k || {NL} || 'timeout: ' || k
  WHEN 'Task' THEN 'description: buy ' || k || {NL} || 'prompt: please ' || k || {NL} || 'subagent_type: agent-' || (k % 4)
  ELSE 'path: src' || {NL} || 'pattern: err' || k END"""
_INPUT_LINES = f"""CASE tool_name WHEN 'Probe' THEN '  "k": ' || k WHEN 'Read' THEN '  "file_path": "src/f' || k || '.py"'
  WHEN 'Bash' THEN '  "command": "run ' || k || '",' || {NL} || '  "timeout": ' || k
  WHEN 'Task' THEN '  "description": "buy ' || k || '",' || {NL} || '  "prompt": "please ' || k || '",' || {NL} || '  "subagent_type": "agent-' || (k % 4) || '"'
  ELSE '  "path": "src",' || {NL} || '  "pattern": "err' || k || '"' END"""
_XCLOCK, _XDATE = "strftime(ts, '%H:%M:%S')", "strftime(start_ts, '%Y-%m-%d')"
_XSTAMP = "strftime(ts, '%Y-%m-%d %a %H:%M')"


def _lines(*parts: str) -> str:
    """SQL text of literal parts and expressions in turn; a literal is written ``=text``."""
    return " || ".join(_quoted(p[1:]) if p.startswith("=") else f"({p})" for p in parts)


def _call_document(head: str, fragment: str, ending: str, pruned: bool, foot: str = "''", joiner: str = "''", name: str | None = None) -> str:
    named = name or f"'session-' || substring(xs.session_id, 1, 8) || '.{ending}'"
    where = "WHERE shown" if pruned else ""
    return f"""WITH {_CALL_TREE}, fr AS (SELECT u, string_agg({fragment}, {joiner} ORDER BY dfs_pos) AS body FROM xt {where} GROUP BY u)
      SELECT xs.project_key, xs.session_id, CAST(0 AS BIGINT) AS part_no, {named} AS file_name, {head} || coalesce(fr.body, '') || {foot} AS document
      FROM xs LEFT JOIN fr ON fr.u = xs.u"""


def _each_answer(make) -> str:
    return f"({make('answer', 'failed')} || CASE WHEN twice THEN {make(chr(39) + 'again ' + chr(39) + ' || e', 'false')} ELSE '' END)"


_STEP = "CASE WHEN e % 3 = 0 THEN 'step ' || e || {} ELSE '' END"
_COMPACTED = "'Compacted at ' || e"
_XSHORT = "substring(xs.session_id, 1, 8)"
_XMINUTE = "strftime(start_ts, '%H:%M')"

_CALL_EXPORTS = {
    "export_markdown_calls": _call_document(
        _lines("=# Session: ", _XSHORT, "=\n\n**Started:** ", _XDATE, "= ", _XMINUTE, "=\n**Messages:** ", "calls", "= | **Tools:** ", "calls", "=\n\n---\n\n"),
        f"""CASE role
          WHEN 'compact' THEN {_lines("=## ═══ Context Compacted ═══" + chr(10) * 2 + "*", _COMPACTED, "=*" + chr(10) * 2 + "---" + chr(10) * 2)}
          WHEN 'assistant' THEN {_lines("=## Assistant (", _XCLOCK, "=)" + chr(10) * 2, _STEP.format(f"{NL} || {NL}"), "=### Tool: ", "tool_name", "=" + chr(10) * 2,
            f"CASE WHEN contains({_ARGS}, {NL}) OR length({_ARGS}) > 80 THEN '```' || {NL} || {_ARGS} || {NL} || '```' ELSE '`' || {_ARGS} || '`' END", "=" + chr(10) * 2 + "---" + chr(10) * 2)}
          ELSE {_lines("=## User (", _XCLOCK, "=)" + chr(10) * 2, _each_answer(lambda a, bad: _lines(f"CASE WHEN {bad} THEN '### Error' ELSE '### Result' END", "=" + chr(10) * 2 + "```" + chr(10), a, "=" + chr(10) + "```" + chr(10) * 2)), "=---" + chr(10) * 2)} END""",
        "md", True,
    ),
    "export_org_calls": _call_document(
        _lines("=#+TITLE: Session ", _XSHORT, "=\n#+DATE: ", _XDATE, "=\n#+OPTIONS: toc:2 num:nil\n\n* Session Metadata\n- Started: ", _XDATE, "= ", _XMINUTE, "=\n- Messages: ", "calls",
               "=\n- Tool Calls: ", "calls", "=\n", f"CASE WHEN continuations > 0 THEN '- Continuations: ' || continuations || {NL} ELSE '' END", "=\n* Conversation\n\n"),
        f"""CASE role
          WHEN 'compact' THEN {_lines("repeat('*', depth + 2)", "= ═══ COMPACTED ═══" + chr(10), _COMPACTED, "=" + chr(10) * 2)}
          WHEN 'assistant' THEN {_lines("repeat('*', depth + 2)", "= ASSISTANT [", _XSTAMP, "=]" + chr(10), _STEP.format(f"{NL} || {NL}"), "repeat('*', depth + 3)", "= TOOL: ", "tool_name", "=" + chr(10) + "#+BEGIN_SRC ",
            "CASE tool_name WHEN 'Read' THEN 'python' WHEN 'Bash' THEN 'bash' ELSE '' END", "=" + chr(10), _ARGS, "=" + chr(10) + "#+END_SRC" + chr(10) * 3)}
          ELSE {_lines("repeat('*', depth + 2)", "= USER [", _XSTAMP, "=]" + chr(10), _each_answer(lambda a, bad: _lines("repeat('*', depth + 3)", f"CASE WHEN {bad} THEN ' ERROR' ELSE ' RESULT' END", "=" + chr(10) + "#+BEGIN_EXAMPLE" + chr(10), a, "=" + chr(10) + "#+END_EXAMPLE" + chr(10) * 2)), "=" + chr(10))} END""",
        "org", True,
    ),
    "export_html_calls": _call_document(
        _lines('=<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>Session: ', _XSHORT, '=</title>\n</head>\n<body>\n<div class="container">\n<header>\n<h1>Session: ', _XSHORT,
               '=</h1>\n<p class="meta">Started: ', _XDATE, "= ", _XMINUTE, "= | Messages: ", "calls", "= | Tools: ", "calls", '=</p>\n</header>\n<div class="messages">\n'),
        f"""CASE role
          WHEN 'compact' THEN {_lines('=<div class="message compacted">' + chr(10) + '<div class="message-header compacted-header">═══ COMPACTED ═══</div>' + chr(10) + '<div class="message-content">' + chr(10) + '<p class="dim">', _COMPACTED, "=</p>" + chr(10) + "</div>" + chr(10) + "</div>" + chr(10))}
          WHEN 'assistant' THEN {_lines('=<div class="message assistant">' + chr(10) + '<div class="message-header assistant-header">[ASSISTANT] ', _XCLOCK, "=</div>" + chr(10) + '<div class="message-content">' + chr(10),
            "CASE WHEN e % 3 = 0 THEN '<p>step ' || e || '</p>' || chr(10) ELSE '' END", '=<div class="tool-use">' + chr(10) + '<div class="tool-header">Tool: ', "tool_name", "=</div>" + chr(10) + '<pre class="tool-input">', _ARGS, "=</pre>" + chr(10) + "</div>" + chr(10) + "</div>" + chr(10) + "</div>" + chr(10))}
          ELSE {_lines('=<div class="message user">' + chr(10) + '<div class="message-header user-header">[USER] ', _XCLOCK, "=</div>" + chr(10) + '<div class="message-content">' + chr(10),
            _each_answer(lambda a, bad: _lines('=<div class="tool-result', f"CASE WHEN {bad} THEN ' error' ELSE '' END", '=">' + chr(10) + "<pre>", _escaped(a), "=</pre>" + chr(10) + "</div>" + chr(10))), "=</div>" + chr(10) + "</div>" + chr(10))} END""",
        "html", True, foot=_quoted("</div>\n</div>\n</body>\n</html>"),
    ),
    "export_markdown_kind_calls": _call_document(
        _lines("=# Session ", "xs.session_id", "=\n\n**Started:** ", _XDATE, "= ", "strftime(start_ts, '%H:%M:%S')", "=\n\n**Messages:** ", "calls", "= | **Tools:** ", "calls", "=\n\n---\n\n"),
        f"""CASE role
          WHEN 'compact' THEN {_lines("=---" + chr(10) + "## ◇ CONTEXT COMPACTED" + chr(10) * 2, _COMPACTED, "=" + chr(10) * 2)}
          WHEN 'assistant' THEN {_lines("=### ● ASSISTANT (", _XCLOCK, "=)" + chr(10) * 2, _STEP.format(f"{NL} || {NL}"), "=#### ● ", "tool_name", "=" + chr(10) * 2 + "```json" + chr(10) + "{" + chr(10), _INPUT_LINES, "=" + chr(10) + "}" + chr(10) + "```" + chr(10) * 2)}
          ELSE {_each_answer(lambda a, bad: _lines("=```" + chr(10), a, "=" + chr(10) + "```" + chr(10) * 2))} END""",
        "md", False,
    ),
    "export_org_kind_calls": _call_document(
        _lines("=#+TITLE: Session ", "xs.session_id", "=\n#+DATE: ", _XDATE, "=\n\n"),
        f"""CASE role
          WHEN 'compact' THEN {_lines("=* ◇ CONTEXT COMPACTED" + chr(10), _COMPACTED, "=" + chr(10))}
          WHEN 'assistant' THEN {_lines("=** ● ASSISTANT [", _XCLOCK, "=]" + chr(10), _STEP.format(NL), "=*** ● ", "tool_name", "=" + chr(10) + "#+BEGIN_SRC json" + chr(10) + "{" + chr(10), _INPUT_LINES, "=" + chr(10) + "}" + chr(10) + "#+END_SRC" + chr(10))}
          ELSE {_each_answer(lambda a, bad: _lines("=#+BEGIN_EXAMPLE" + chr(10), a, "=" + chr(10) + "#+END_EXAMPLE" + chr(10)))} END""",
        "org", False,
    ),
    "export_text_calls": _call_document(
        f"{NL} || {NL}",
        f"""CASE role
          WHEN 'compact' THEN {_quoted("══════════════════ Conversation compacted ═════════════════" + chr(10) * 2)}
          WHEN 'assistant' THEN {_lines("=● ", "CASE WHEN e % 3 = 0 THEN 'step ' || e ELSE '' END", "=" + chr(10) * 2 + "● ", "tool_name", "=(",
            "CASE tool_name WHEN 'Read' THEN 'src/f' || k || '.py' WHEN 'Bash' THEN 'run ' || k WHEN 'Grep' THEN 'err' || k ELSE '' END", "=)" + chr(10))}
          ELSE '' END""",
        "txt", False, name=f"{_XDATE} || '-no-summary.txt'",
    ),
    "export_json_calls": _call_document(
        """'{"session":{"project_key":"' || xs.project_key || '","session_id":"' || xs.session_id || '","summary":"(no summary)","message_count":' || calls || ',"user_prompts":0,"tool_calls":' || calls ||
          ',"continuations":' || continuations || ',"agent_sidechains":' || sidechains || ',"input_tokens":0,"output_tokens":0},"messages":['""",
        """'{"line":' || line_no ||
          CASE WHEN role = 'result' THEN ',"parent_line":' || (e * 2) WHEN prev_call IS NOT NULL THEN ',"parent_line":' || (prev_call * 2 + 1) ELSE '' END || ',"depth":' || depth ||
          ',"uuid":"e' || e || CASE role WHEN 'assistant' THEN '-u' WHEN 'result' THEN '-r' ELSE '-c' END || '","type":"' || CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END ||
          '","kind":"' || CASE role WHEN 'assistant' THEN 'assistant' WHEN 'result' THEN 'tool_result' ELSE 'compact_summary' END || '","is_sidechain":' || (role = 'assistant' AND e % 13 = 5) ||
          ',"is_compacted":' || (role = 'compact') || ',"content":[' ||
          CASE role WHEN 'compact' THEN '{"text":"Compacted at ' || e || '","type":"text"}'
            WHEN 'assistant' THEN CASE WHEN e % 3 = 0 THEN '{"text":"step ' || e || '","type":"text"},' ELSE '' END ||
              '{"id":"tool-' || e || '","input":' || tool_input || ',"name":"' || tool_name || '","type":"tool_use"}'
            ELSE '{"content":' || CASE WHEN e % 4 = 0 THEN answer ELSE '"' || answer || '"' END || CASE WHEN failed THEN ',"is_error":true' ELSE '' END || ',"tool_use_id":"tool-' || e || '","type":"tool_result"}' ||
              CASE WHEN twice THEN ',{"content":"again ' || e || '","tool_use_id":"tool-' || e || '","type":"tool_result"}' ELSE '' END END || ']}'""",
        "json", False, foot="']}'", joiner="','",
    ),
}

_ORG_IMAGES = f"""SELECT '-home-user-src-proj' || (user_id % 10) AS project_key, 'box-' || user_id AS session_id,
  string_agg('image/png;base64,' || base64(encode('v' || event_id)), {NL} ORDER BY event_id) AS images FROM events GROUP BY user_id"""

def _search(queries: str, content: str) -> str:
    """Hits of the queries ``qs`` by key, path, id, summary and content."""
    return f"""WITH RECURSIVE {_TREE}, {_LISTING[len(_CHAT) + 1:]},
      {queries},
      ct AS ({content}),
      hits AS (
        SELECT query, CASE WHEN contains(project_key, query) THEN 0 ELSE 1 END AS priority, 'project' AS type, project_key, {_NO_MATCH} AS session_id,
          display_name AS project, display_name AS summary, CASE WHEN contains(project_key, query) THEN NULL ELSE full_path END AS snippet, {_NO_MATCH} AS message_id,
          last_modified AS project_modified, CAST(NULL AS BIGINT) AS end_time
        FROM pr JOIN qs ON contains(project_key, query) OR contains(lower(full_path), query)
        UNION ALL
        SELECT query, CASE WHEN starts_with(session_id, query) THEN 0 ELSE 2 END, 'session', project_key, session_id, display_name, summary, NULL, NULL, project_modified, end_time
        FROM lp JOIN qs ON starts_with(session_id, query) OR contains(lower(summary), query)
        UNION ALL
        SELECT ct.query, 3, 'message', project_key, lp.session_id, display_name, summary, ct.snippet, ct.message_id, project_modified, end_time
        FROM ct JOIN lp ON lp.session_id = ct.session_id WHERE NOT starts_with(lp.session_id, ct.query) AND NOT contains(lower(summary), ct.query))
      SELECT query, CAST(priority AS BIGINT) AS priority, type, project_key, session_id, project, summary, snippet, message_id FROM hits"""


REFERENCE_SQL: dict[str, str] = {
    "line_ordinal": _chat("""SELECT project_key, session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS ordinal
      FROM (SELECT project_key, session_id, line_no FROM c0 UNION ALL SELECT project_key, session_id, line_no FROM notes)"""),
    "path_keys": _chat("SELECT DISTINCT 'file:///logs/' || project_key || '/' || session_id || '.jsonl' AS path, project_key, session_id FROM c0"),
    "malformed_audit": f"""SELECT '-home-user-src-proj' || (user_id % 10) AS project_key, 'not_json' AS reason, count(*) AS n_lines
      FROM events WHERE event_id % {MALFORMED_EVERY} = 0 GROUP BY ALL""",
    "decode_envelope": _chat("""SELECT project_key, session_id, line_no, role AS type, 'c' || c || '-t' || t AS uuid,
        CASE WHEN t = 0 THEN NULL WHEN c % 3 = 0 AND t >= 2 THEN 'c' || c || '-t' || (t - 2) ELSE 'c' || c || '-t' || (t - 1) END AS parent_uuid_raw,
        ts_us AS ts, is_compacted, is_sidechain, is_meta, CASE WHEN role = 'assistant' THEN 'model-' || (c % 3) END AS model, NULL AS summary_text,
        CASE WHEN t = 1 THEN 'slug-' || c END AS slug, '1.0.' || (c % 5) AS version, CASE WHEN t >= 2 THEN 'branch-' || t END AS git_branch,
        CASE WHEN t = 0 THEN '/home/user/src/proj' || (c % 7) END AS cwd FROM c0
      UNION ALL SELECT project_key, session_id, line_no, 'summary', NULL, NULL, NULL, false, false, false, NULL, note, NULL, NULL, NULL, NULL FROM notes"""),
    "usage_pick": _chat("""SELECT session_id, line_no, n AS input_tokens, n // 4 AS output_tokens, t AS cache_read_tokens, CAST(NULL AS BIGINT) AS cache_create_tokens
      FROM c0 WHERE role = 'assistant'"""),
    "content_blocks": _chat("SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, block_type, block_text AS text FROM b"),
    "text_blocks": _chat("SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, block_text AS text FROM b WHERE block_type = 'text'"),
    "thinking_blocks": _chat("SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, block_text AS text FROM b WHERE block_type = 'thinking'"),
    "classify_messages": _chat("SELECT session_id, line_no, role AS type, kind, kind = 'command' AS is_command FROM m"),
    "command_extract": _chat(f"SELECT session_id, line_no, '/run' AS command_name, {_trim('x')} AS command_args FROM m WHERE kind = 'command'"),
    "first_text": _chat(f"SELECT session_id, line_no, {_FIRST_TEXT} AS first_text FROM m"),
    "joined_text": _chat(f"""SELECT session_id, line_no, CASE WHEN hollow THEN '' ELSE {_trim("said || CASE WHEN has_tail THEN ' tail ' || t ELSE '' END")} END AS joined_text FROM m"""),
    "first_line": _chat(f"SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, {_first_line('block_text')} AS first_line FROM b WHERE block_type = 'text'"),
    "conversational": _chat("SELECT project_key, role AS type, count(*) AS n_messages FROM m GROUP BY ALL"),
    "code_blocks": _chat("""SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, CAST(0 AS BIGINT) AS code_no, 'sql' AS language, x AS body
      FROM b WHERE block_type = 'text' AND c % 13 = 0 AND NOT (c % 11 = 0 AND t = 0) AND block_text = said"""),
    "raw_content": _chat(f"SELECT session_id, line_no, '[' || {_CONTENT_JSON} || ']' AS content_json FROM m"),
    "session_stats_detail": _detail("SELECT project_key, session_id, message_count, user_prompts, CAST(0 AS BIGINT) AS tool_calls, continuations, agent_sidechains FROM ds"),
    "session_stats_listing": _listing("SELECT project_key, session_id, message_count, user_prompts, CAST(0 AS BIGINT) AS tool_calls, continuations, agent_sidechains FROM ls"),
    "token_usage": _detail("""SELECT project_key, session_id, input_tokens, output_tokens, cache_read_tokens, CAST(0 AS BIGINT) AS cache_create_tokens,
      input_tokens + output_tokens AS total_tokens, cache_read_tokens > 0 AS has_cache_tokens FROM ds"""),
    "session_metadata": _detail("SELECT project_key, session_id, slug, version, git_branch, cwd FROM ds"),
    "session_duration": _detail("SELECT project_key, session_id, start_time, end_time, duration_seconds FROM ds"),
    "session_summary_detail": _detail("SELECT project_key, session_id, summary FROM ds"),
    "session_summary_listing": _listing("SELECT project_key, session_id, summary FROM ls"),
    "listable_sessions": _listing("SELECT project_key, session_id, summary FROM li"),
    "project_listing": _listing("SELECT project_key, n_sessions, last_modified, display_name, full_path FROM pr"),
    "project_filter": _listing("SELECT project_key, n_sessions, last_modified, display_name, full_path FROM pr WHERE contains(display_name, 'proj3')"),
    "session_filter": _listing("SELECT project_key, session_id, summary, message_count FROM li WHERE contains(lower(summary), 'summary of') OR contains(session_id, 'summary of')"),
    "session_listing": _listing("SELECT session_id, display_name, summary, start_time, end_time FROM lp"),
    "recent_sessions": _listing("SELECT session_id, display_name, summary, end_time FROM lp ORDER BY project_modified DESC, project_key, lp.end_time DESC, session_id LIMIT 25"),
    "recent_index": _listing("""SELECT row_number() OVER (ORDER BY project_modified DESC, project_key, end_time DESC, session_id) AS position, project_key, session_id, summary
      FROM lp QUALIFY position <= 10"""),
    "find_project": _listing("""SELECT request, project_key, n_sessions, last_modified, display_name, full_path FROM pr
      JOIN (VALUES ('proj3'), ('PROJ'), ('-home-user-src-proj5'), ('nowhere')) r(request)
        ON project_key = lower(request) OR contains(display_name, lower(request))
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY last_modified DESC, project_key) = 1"""),
    "find_session": _listing("""SELECT request, project_key, session_id, summary FROM lp
      JOIN (VALUES ('conv-1', '', 'conv-1'), ('proj2:conv-1', 'proj2', 'conv-1'), ('proj2:conv', 'proj2', 'conv'), ('conv-3', '', 'conv-3'),
                   ('proj0:conv-1', 'proj0', 'conv-1'), ('none:conv-1', 'none', 'conv-1')) r(request, p, s)
        ON starts_with(session_id, s) AND (p = '' OR display_name = p)
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY project_modified DESC, project_key, end_time DESC, session_id) = 1"""),
    "global_stats": _listing("SELECT count(DISTINCT project_key) AS projects, count(*) AS sessions FROM li"),
    "ingest_audit": f"""SELECT 2 * count(*) AS lines, count(*) FILTER (event_id % {MALFORMED_EVERY} = 0) AS bad_lines, CAST(0 AS BIGINT) AS oversize_lines, CAST(0 AS BIGINT) AS odd_case_lines,
      count(DISTINCT user_id % 10) AS projects_found, count(DISTINCT user_id % 10) AS empty_projects, count(DISTINCT user_id) AS sessions_found,
      count(DISTINCT user_id) AS sessions_dropped FROM events""",
    "message_tree": _tree("""SELECT session_id, line_no, CASE WHEN up IS NOT NULL THEN 'c' || c || '-t' || up END AS parent_uuid, parent_t * 2 AS parent_line,
      parent_t IS NULL AS is_root, true AS reachable FROM tr"""),
    "dfs_order": _tree("""SELECT tr.session_id, tr.line_no, tr.dfs_pos, tr.dfs_pos + count(*) AS dfs_end FROM tr
      JOIN w d ON d.c = tr.c AND list_slice(d.path, 1, len(tr.path)) = tr.path GROUP BY tr.session_id, tr.line_no, tr.dfs_pos"""),
    "message_depth": _tree("SELECT session_id, line_no, CAST(depth AS BIGINT) AS depth FROM tr"),
    "root_messages": _tree("SELECT session_id, line_no, kind FROM tr WHERE parent_t IS NULL"),
    "subtree_prune": _tree(f"SELECT session_id, line_no, kind FROM tr WHERE NOT {_CUT_AGENT}"),
    "subtree_prune_compact": _tree(f"SELECT session_id, line_no, kind FROM tr WHERE NOT {_CUT_AGENT} AND NOT {_CUT_COMPACT}"),
    "compact_reparent": _events("""SELECT session_id, e * 2 AS line_no,
        'e' || prev_id || CASE WHEN prev_kind = 'signup' THEN '-b' ELSE '-r' END AS parent_uuid_raw,
        CASE WHEN prev_id IS NULL THEN NULL WHEN prev_call IS NOT NULL THEN 'e' || prev_call || '-r' ELSE 'e' || first_id || '-b' END AS parent_uuid,
        prev_call * 2 + 1 AS parent_line FROM e0 WHERE kind <> 'signup'
      UNION ALL SELECT session_id, e * 2 + 1, 'e' || e || '-u', 'e' || e || '-u', e * 2 FROM e0 WHERE kind <> 'signup'
      UNION ALL SELECT session_id, e * 2 + 1, 'e' || e || '-b', CASE WHEN prev_call IS NOT NULL THEN 'e' || prev_call || '-r' ELSE 'e' || first_id || '-b' END,
        prev_call * 2 + 1 FROM e0 WHERE kind = 'signup'"""),
    "threads": _tree("""SELECT session_id, line_no, thread_no, CAST(CASE WHEN opener OR thread_no = 0 THEN 0 WHEN is_sidechain THEN 2 ELSE 1 END AS BIGINT) AS level FROM (
      SELECT *, kind IN ('user_prompt', 'command') AS opener,
        CAST(count(*) FILTER (kind IN ('user_prompt', 'command')) OVER (PARTITION BY c ORDER BY dfs_pos) AS BIGINT) AS thread_no FROM tr)"""),
    "thread_messages": _events("SELECT session_id, line_no, kind, CAST(0 AS BIGINT) AS thread_no, CAST(0 AS BIGINT) AS level FROM et WHERE kind <> 'tool_result'"),
    "sections": _events("""SELECT session_id, section_no, count(*) AS n_messages, min(line_no) AS first_line_no FROM (
      SELECT *, count(*) FILTER (kind = 'compact_summary' AND dfs_pos > 0) OVER (PARTITION BY u ORDER BY dfs_pos) AS section_no FROM et) GROUP BY session_id, section_no"""),
    "prompt_chunks": f"""WITH RECURSIVE {_TREE}, ch AS (
        SELECT c, dfs_pos, line_no, session_id, CAST(0 AS BIGINT) AS open_pos, CAST(0 AS BIGINT) AS chunk_no FROM tr WHERE dfs_pos = 0
        UNION ALL SELECT tr.c, tr.dfs_pos, tr.line_no, tr.session_id,
          CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 2 THEN tr.dfs_pos ELSE ch.open_pos END,
          ch.chunk_no + CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 2 THEN 1 ELSE 0 END
        FROM ch JOIN tr ON tr.c = ch.c AND tr.dfs_pos = ch.dfs_pos + 1)
      SELECT session_id, line_no, chunk_no FROM ch""",
    "tail_sections": f"""WITH RECURSIVE {_TREE}, ch AS (
        SELECT c, dfs_pos, CAST(0 AS BIGINT) AS open_pos, CAST(0 AS BIGINT) AS chunk_no FROM tr WHERE dfs_pos = 0
        UNION ALL SELECT tr.c, tr.dfs_pos,
          CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 2 THEN tr.dfs_pos ELSE ch.open_pos END,
          ch.chunk_no + CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 2 THEN 1 ELSE 0 END
        FROM ch JOIN tr ON tr.c = ch.c AND tr.dfs_pos = ch.dfs_pos + 1),
      pt AS (SELECT tr.*, ch.chunk_no, count(*) FILTER (kind = 'compact_summary' AND tr.dfs_pos > 0) OVER (PARTITION BY tr.c ORDER BY tr.dfs_pos) AS section_no
        FROM tr JOIN ch ON ch.c = tr.c AND ch.dfs_pos = tr.dfs_pos),
      pa AS (SELECT *, CASE WHEN count(*) OVER s <= 4 THEN 0 WHEN max(section_no) OVER s > 0 THEN section_no ELSE chunk_no END AS part_no FROM pt WINDOW s AS (PARTITION BY c)),
      hd AS (SELECT *, max(part_no) OVER (PARTITION BY c) AS hidden_parts FROM pa)
      SELECT project_key, session_id, CAST(max(hidden_parts) AS BIGINT) AS hidden_parts, count(*) FILTER (part_no < hidden_parts) AS hidden_messages
      FROM hd GROUP BY project_key, session_id""",
    "nav_groups": _tree("""SELECT session_id, group_no, min_by(line_no, dfs_pos) AS head_line, min_by(kind, dfs_pos) AS head_kind, count(*) - 1 AS n_children,
        greatest(count(*) - 11, 0) AS n_more, group_no > any_value(last_group) - 3 AS is_open FROM (
      SELECT *, max(group_no) OVER (PARTITION BY c) AS last_group FROM (
        SELECT *, count(*) FILTER (kind IN ('user_prompt', 'command', 'compact_summary')) OVER (PARTITION BY c ORDER BY dfs_pos) AS group_no FROM tr))
      WHERE group_no > 0 GROUP BY session_id, group_no"""),
    "nav_labels": _events("""SELECT g.session_id, g.line_no, group_no, child_no, child_no <= 10 AS listed,
        CASE WHEN g.kind = 'compact_summary' THEN 'COMPACT' WHEN g.kind = 'assistant' THEN eu.tool_name || '(' || eu.preview || ')' END AS label FROM (
      SELECT *, dfs_pos - max(CASE WHEN kind = 'compact_summary' THEN dfs_pos END) OVER o AS child_no, count(*) FILTER (kind = 'compact_summary') OVER o AS group_no
      FROM et WINDOW o AS (PARTITION BY u ORDER BY dfs_pos)) g LEFT JOIN eu ON eu.e = g.e WHERE group_no > 0"""),
    "prompt_neighbors": _tree("""SELECT session_id, line_no, dfs_pos, coalesce(lag(dfs_pos) OVER o, dfs_pos) AS prev_pos, coalesce(lead(dfs_pos) OVER o, dfs_pos) AS next_pos
      FROM tr WHERE kind = 'user_prompt' WINDOW o AS (PARTITION BY c ORDER BY dfs_pos)"""),
    "tool_uses": _events("SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, tool_id, tool_name, tool_input FROM eu"),
    "tool_results": _events("SELECT session_id, result_line AS line_no, CAST(result_block AS BIGINT) AS block_no, tool_id, tool_result, is_error FROM er"),
    "last_result": _events("SELECT session_id, tool_id, result_line, CAST(result_block AS BIGINT) AS result_block, tool_result, is_error FROM el"),
    "tool_call_results": _events("""SELECT eu.session_id, eu.line_no, eu.tool_id, eu.tool_name, el.result_line, el.is_error, eu.tool_name IN ('Bash', 'Task') AS is_active, el.tool_result
      FROM eu LEFT JOIN el ON el.u = eu.u AND el.tool_id = eu.tool_id"""),
    "tool_preview": _events("SELECT session_id, line_no, tool_name, preview FROM eu"),
    "tool_arg_preview": _events("""SELECT session_id, line_no, CASE tool_name WHEN 'Read' THEN 'src/f' || k || '.py' WHEN 'Bash' THEN 'run ' || k WHEN 'Grep' THEN 'err' || k ELSE '' END AS argument FROM eu"""),
    "active_tools": _events("SELECT project_key, tool_name, tool_name IN ('Bash', 'Task') AS is_active, count(*) AS n_calls FROM eu GROUP BY ALL"),
    "guess_language": _events("SELECT session_id, line_no, tool_name, CASE tool_name WHEN 'Read' THEN 'python' WHEN 'Bash' THEN 'bash' ELSE '' END AS language FROM eu"),
    "tool_input_lines": _events(f"""SELECT session_id, line_no, CASE tool_name WHEN 'Probe' THEN 'k: ' || k WHEN 'Read' THEN 'file_path: src/f' || k || '.py'
        WHEN 'Bash' THEN 'command: run ' || k || {NL} || 'timeout: ' || k
        WHEN 'Task' THEN 'description: buy ' || k || {NL} || 'prompt: please ' || k || {NL} || 'subagent_type: agent-' || (k % 4)
        ELSE 'path: src' || {NL} || 'pattern: err' || k END AS argument_text FROM eu"""),
    "tool_args_generic": _events("SELECT session_id, line_no, CAST(block_no AS BIGINT) AS block_no, tool_id, tool_name, tool_input AS arguments FROM eu WHERE tool_name = 'Probe'"),
    "tool_call_count": _events("SELECT session_id, line_no, CAST(CASE WHEN kind = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS n_calls FROM em"),
    "file_edits": _toolbox("Edit", "'a/v' || event_id || '.go' AS file_path, 'old ' || event_type AS old_string, 'new ' || event_type AS new_string"),
    "file_writes": _toolbox("Write", f"""'b/v' || event_id || '.md' AS file_path, event_type || {NL} || 'v' || event_id AS content,
      length(event_type || {NL} || 'v' || event_id) AS n_chars"""),
    "todo_items": f"""SELECT 'box-' || user_id AS session_id, event_id AS line_no, CAST(1 AS BIGINT) AS block_no, i AS todo_no, 'item ' || i || ' of ' || event_id AS content,
        CASE i WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' ELSE event_type END AS status,
        CASE i WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' ELSE 'pending' END AS status_class
      FROM events, range(3) r(i) WHERE event_id % {len(TOOLBOX)} = {TOOLBOX.index('TodoWrite')}""",
    "agent_tasks": _toolbox("Task", "event_type AS subagent_type, CASE WHEN event_id % 2 = 0 THEN 'small' END AS model, 'do v' || event_id AS prompt, 'v' || event_id AS description"),
    "skill_calls": _toolbox("Skill", "event_type AS skill, 'v' || event_id AS args"),
    "web_searches": _toolbox("WebSearch", "'find v' || event_id AS query"),
    "web_fetches": _toolbox("WebFetch", "CASE WHEN event_id % 2 = 0 THEN 'HTTPS' ELSE 'ftp' END || '://example.org/' || event_id AS url, 'v' || event_id AS prompt, event_id % 2 = 0 AS is_safe_url"),
    "asked_options": f"""SELECT 'box-' || user_id AS session_id, event_id AS line_no, CAST(1 AS BIGINT) AS block_no, CAST(q AS BIGINT) AS question_no,
        CASE q WHEN 0 THEN event_type ELSE 'last' END AS header, CASE q WHEN 0 THEN 'which ' ELSE 'why ' END || event_id AS question_text,
        CAST(o AS BIGINT) AS option_no, 'opt' || o AS label, CASE WHEN o IS NOT NULL THEN 'about ' || event_id END AS description
      FROM events, (VALUES (0, 0), (0, 1), (1, NULL)) r(q, o) WHERE event_id % {len(TOOLBOX)} = {TOOLBOX.index('AskUserQuestion')}""",
    "lsp_calls": _toolbox("LSP", """event_type AS operation, '/x/y/v' || event_id || '.rs' AS "filePath", event_id AS line, event_id % 80 AS character"""),
    "task_outputs": _toolbox("TaskOutput", "'v' || event_id AS task_id, CASE event_id % 4 WHEN 1 THEN 'blocking' WHEN 3 THEN 'async' END AS mode"),
    "shell_kills": _toolbox("KillShell", "'v' || event_id AS shell_id"),
    "other_arguments": _toolbox("Other", """'Other' AS tool_name, '{"a":[' || (event_id % 3) || ',"' || event_type || '"],"b":' || event_id || '}' AS arguments"""),
    "image_blocks": "SELECT 'box-' || user_id AS session_id, event_id AS line_no, CAST(2 AS BIGINT) AS block_no, 'image/png' AS media_type, base64(encode('v' || event_id)) AS image_data FROM events",
    "unknown_blocks": "SELECT 'box-' || user_id AS session_id, event_id AS line_no, CAST(3 AS BIGINT) AS block_no, 'mystery' AS block_type, CAST(NULL AS VARCHAR) AS text FROM events",
    "table_cells": f"""WITH ln AS (
        SELECT doc_id, parts[i] AS line, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents))),
      rn AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ln WHERE contains(line, '|')),
      kept AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS table_no,
          row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1 AS row_no FROM rn WHERE NOT contains(line, '---')),
      cl AS (SELECT doc_id, table_no, row_no, string_split(trim('| ' || line || ' |', '|'), '|') AS cells FROM kept)
      SELECT doc_id, table_no, row_no, n - 1 AS cell_no, trim(cells[n]) AS cell FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS n FROM cl)""",
    "search_sessions": _listing(f"SELECT query, CAST(priority AS BIGINT) AS priority, type, project_key, session_id, project, summary FROM ({_metadata_hits(['summary', 'conv-1', 'proj4'])})"),
    "search_type_filter": _listing(f"""SELECT query, CAST(priority AS BIGINT) AS priority, type, project_key, session_id, summary FROM ({_metadata_hits(['o'], 'session')})
"""),
    "content_first_hit": _tree(f"SELECT session_id, query, line_no, message_id, snippet FROM ({_content_hits(WORD)} UNION ALL {_content_hits('tail')})"),
    "tool_content_hit": _events(f"SELECT session_id, query, line_no, message_id, snippet FROM ({_tool_hits('run 3')} UNION ALL {_tool_hits('cents 99')})"),
    "search_global": _search(
        f"qs(query) AS (VALUES ('{WORD}'), ('proj4'), ('/src/proj'), ('conv-2'))",
        " UNION ALL ".join(_content_hits(q) for q in (WORD, "proj4", "/src/proj", "conv-2")),
    ) + f" QUALIFY {_HIT_RANK} <= 40",
    "search_many": _search(
        """qs(query) AS (SELECT DISTINCT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE length(w) >= 9
          UNION SELECT 'conv-' || conv_id FROM conversations UNION SELECT unnest(['proj4', '/src/proj']))""",
        f"""SELECT query, c, session_id, line_no, 'c' || c || '-t' || t AS message_id, snippet FROM (
          SELECT query, tr.c, tr.t, tr.session_id, tr.line_no, {_snippet_of('b.block_text', 'query', 'length(query)', 60)} AS snippet,
            row_number() OVER (PARTITION BY tr.c, query ORDER BY tr.dfs_pos, b.block_no) AS rn
          FROM tr JOIN b ON b.c = tr.c AND b.t = tr.t JOIN qs ON contains(lower(b.block_text), query) WHERE b.block_type = 'text') WHERE rn = 1""",
    ),
    "size_policies": _events("""SELECT session_id, policy, count(*) AS n_lines FROM (
        SELECT *, min(CASE WHEN bad THEN line_no END) OVER (PARTITION BY session_id) AS cut
        FROM (SELECT session_id, e * 2 + h AS line_no, (e * 2 + h) % 61 = 60 AS bad FROM e0, range(2) r(h))) l
      JOIN (VALUES ('skip_line'), ('truncate_session'), ('fail_session'), ('quarantine')) p(policy)
        ON CASE policy WHEN 'skip_line' THEN NOT bad WHEN 'truncate_session' THEN cut IS NULL OR line_no < cut WHEN 'fail_session' THEN cut IS NULL ELSE bad END
      GROUP BY ALL"""),
    "laid_out_inputs": f"""SELECT event_id, array_to_string(list_transform(range(1, d + 1), lambda i: '{{' || {NL} || repeat('  ', i) || '"a": '), '')
      || '[' || {NL} || repeat('  ', d + 1) || '"{{,' || event_type || '",' || {NL} || repeat('  ', d + 1) || '[],' || {NL} || repeat('  ', d + 1) || event_id || {NL}
      || repeat('  ', d) || ']' || array_to_string(list_transform(range(1, d + 1), lambda i: {NL} || repeat('  ', d - i) || '}}'), '') AS shown
      FROM (SELECT event_id, event_type, event_id % 14 AS d FROM events)""",
    "find_projects_many": _listing("""SELECT request, project_key, n_sessions, display_name FROM pr
      JOIN (SELECT DISTINCT unnest([project_key, display_name, upper(display_name), substring(display_name, 1, 4)]) AS request FROM pr) r
        ON lower(project_key) = lower(request) OR contains(lower(display_name), lower(request))
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY last_modified DESC, project_key) = 1"""),
    "find_sessions_many": _listing("""SELECT request, lp.project_key, session_id, summary FROM lp
      JOIN (SELECT DISTINCT p, s, CASE WHEN p = '' THEN s ELSE p || ':' || s END AS request FROM
              (SELECT unnest(['', display_name]) AS p, session_id FROM lp) names, (SELECT unnest([4, 6, 7, 99]) AS n) sizes, LATERAL (SELECT substring(session_id, 1, n) AS s) cut) r
        ON starts_with(session_id, s)
      LEFT JOIN (SELECT q.name, pr.project_key FROM pr JOIN (SELECT DISTINCT display_name AS name FROM pr) q ON contains(pr.display_name, q.name)
                 QUALIFY row_number() OVER (PARTITION BY q.name ORDER BY pr.last_modified DESC, pr.project_key) = 1) ch ON ch.name = p
      WHERE p = '' OR ch.project_key = lp.project_key
      QUALIFY row_number() OVER (PARTITION BY request ORDER BY project_modified DESC, lp.project_key, end_time DESC, session_id) = 1"""),
    "faceted_search": _facets(WORD, ["user", "response", "thinking"]),
    "faceted_words": _facets(PHRASE, ["user", "response"]),
    "faceted_tool_search": _events("""SELECT 'agent-2' AS query, type, session_id, line_no, CAST(block_no AS BIGINT) AS block_no, score
      FROM eu JOIN (VALUES ('tool', 20.0::DOUBLE), ('agent', 25.0::DOUBLE)) f(type, score) ON tool_name = 'Task' AND k % 4 = 2"""),
    "snippets": f"SELECT doc_id, {_snippet('text', WORD, 60)} AS snippet FROM documents WHERE contains(lower(text), '{WORD}')",
    "relevance_score": f"SELECT doc_id, {_relevance('text', WORD)} AS one_word, {_relevance('text', PHRASE)} AS two_words FROM documents",
    "result_cap": "SELECT doc_id, CASE WHEN length(text) > 5000 THEN substring(text, 1, 4997) || '...' ELSE text END AS capped FROM documents",
    "truncate_text": """SELECT doc_id, substring(text, 1, 8) AS cut_8, CASE WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS dots_60,
      CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS dots_after_40 FROM documents""",
    "subpath_scope": f"SELECT page_id, {_PAGE_PATH} AS path FROM pages WHERE {_PAGE_PATH} = '/en' OR starts_with({_PAGE_PATH}, '/en/')",
    "safe_urls": "SELECT page_id, page_id % 3 <> 1 AS is_safe FROM pages",
    "encode_path": f"SELECT page_id, regexp_replace(replace({_PAGE_PATH}, '/', '-'), '^-', '') AS encoded FROM pages",
    "decode_path": f"SELECT page_id, CASE WHEN p = '' THEN '' ELSE '/' || p END AS decoded FROM (SELECT page_id, regexp_replace(replace(replace({_PAGE_PATH}, '/', '-'), '-', '/'), '^/', '') AS p FROM pages)",
    "project_display_name": f"""SELECT page_id, project_key, array_to_string(list_slice(parts, greatest(len(parts) - 3, 1), len(parts)), '-') AS display_name FROM (
      SELECT page_id, {_PAGE_KEY} AS project_key, list_filter(string_split({_PAGE_PATH}, '/'), lambda p: p <> '') AS parts FROM (SELECT page_id, url FROM pages))""",
    "recency_bucket": f"""SELECT event_id, CASE WHEN {_AGE} < 60000000 THEN 'just now'
        WHEN {_AGE} < 3600000000 THEN ({_AGE} // 60000000) || 'm ago' WHEN {_AGE} < 86400000000 THEN ({_AGE} // 3600000000) || 'h ago'
        WHEN {_AGE} < 604800000000 THEN ({_AGE} // 86400000000) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age FROM events""",
    "star_events_valid": _notes("SELECT action, action <> 'bogus' AS is_valid, count(*) AS n_events FROM log GROUP BY ALL"),
    "stars_current": _notes("SELECT star_id, item_type, item_id, project_id, note FROM stars"),
    "stars_by_type": _notes("SELECT star_id, item_type, item_id, project_id, note FROM stars WHERE item_type = 'session'"),
    "is_starred": _notes("SELECT item_type, item_id FROM stars"),
    "tags": _notes("SELECT DISTINCT tag AS name FROM log WHERE action = 'tag'"),
    "item_tags": _notes("SELECT item_type, item_id, name FROM links"),
    "tags_of_item": _notes("SELECT name FROM links WHERE item_type = 'session' AND item_id = 'item-7'"),
    "export_markdown": _document(
        f"""'# Session: ' || {_SHORT} || {_quoted(chr(10) * 2 + "**Started:** ")} || {_DATE} || ' ' || {_MINUTE} || {_quoted(chr(10) + "**Messages:** ")} || message_count
        || ' | **Tools:** 0' || {_quoted(chr(10) * 2 + "---" + chr(10) * 2)}""",
        _MD, _file("md"), f"NOT {_CUT_AGENT} AND NOT {_CUT_COMPACT}",
    ),
    "export_org": _document(
        f"""'#+TITLE: Session ' || {_SHORT} || {_quoted(chr(10) + "#+DATE: ")} || {_DATE} || {_quoted(chr(10) + "#+OPTIONS: toc:2 num:nil" + chr(10) * 2 + "* Session Metadata" + chr(10) + "- Started: ")}
        || {_DATE} || ' ' || {_MINUTE} || {_quoted(chr(10) + "- Messages: ")} || message_count || {_quoted(chr(10) + "- Tool Calls: 0" + chr(10))}
        || CASE WHEN continuations > 0 THEN '- Continuations: ' || continuations || {NL} ELSE '' END || {_quoted(chr(10) + "* Conversation" + chr(10) * 2)}""",
        _ORG, _file("org"), f"NOT {_CUT_COMPACT}",
    ),
    "export_html": _document(
        f"""{_quoted('<!DOCTYPE html>' + chr(10) + '<html lang="en">' + chr(10) + '<head>' + chr(10) + '<meta charset="UTF-8">' + chr(10) + '<title>Session: ')} || {_SHORT} ||
        {_quoted('</title>' + chr(10) + '</head>' + chr(10) + '<body>' + chr(10) + '<div class="container">' + chr(10) + '<header>' + chr(10) + '<h1>Session: ')} || {_SHORT} ||
        {_quoted('</h1>' + chr(10) + '<p class="meta">Started: ')} || {_DATE} || ' ' || {_MINUTE} || ' | Messages: ' || message_count || ' | Tools: 0</p>' ||
        {_quoted(chr(10) + '</header>' + chr(10) + '<div class="messages">' + chr(10))}""",
        _HTML, _file("html"), f"NOT {_CUT_AGENT} AND NOT {_CUT_COMPACT}",
        foot=_quoted("</div>" + chr(10) + "</div>" + chr(10) + "</body>" + chr(10) + "</html>"),
    ),
    "export_markdown_kind": _document(
        f"""'# Session ' || ds.session_id || {_quoted(chr(10) * 2 + "**Started:** ")} || {_DATE} || ' ' || {_CLOCK} || {_quoted(chr(10) * 2 + "**Messages:** ")} || message_count
        || ' | **Tools:** 0' || {_quoted(chr(10) * 2 + "---" + chr(10) * 2)}""",
        _MD_KIND, _file("md"),
    ),
    "export_org_kind": _document(
        f"""'#+TITLE: Session ' || ds.session_id || {_quoted(chr(10) + "#+DATE: ")} || {_DATE} || {NL} || {NL}""", _ORG_KIND, _file("org")
    ),
    "export_text": _document(f"{NL} || {NL}", _TXT, _TEXT_NAME),
    "export_json": _document(_JSON_HEAD, _JSON, _file("json"), foot="']}'", json_commas=True),
    "export_filename": _detail(f"SELECT session_id, {_TEXT_NAME} AS text_name, {_file('md')} AS default_name FROM ds"),
    "tail_messages": _TAILED,
    "tail_growing": _chat("SELECT project_key, session_id, line_no FROM c0 UNION ALL SELECT project_key, session_id, line_no FROM notes"),
    "tail_capped": _chat("SELECT project_key, session_id, line_no FROM c0 UNION ALL SELECT project_key, session_id, line_no FROM notes"),
    "tail_truncated": _chat("""SELECT * FROM (SELECT project_key, session_id, line_no FROM c0 UNION ALL SELECT project_key, session_id, line_no FROM notes)
      WHERE line_no < 4 OR CAST(regexp_extract(session_id, '(\\d+)$', 1) AS BIGINT) % 3 <> 1"""),
    "tail_chunks": _TAILED,
    "tail_tool_names": _events(f"SELECT session_id, {_DENSE} AS line_no, CAST(result_block AS BIGINT) AS block_no, tool_id, tool_name FROM er JOIN nth USING (e)").replace(_EVENTS, _EVENTS_NTH),
    "tail_unknown_results": _events(f"""SELECT session_id, {_DENSE} AS line_no, CAST(result_block AS BIGINT) AS block_no, tool_id,
      CASE WHEN e % 7 = 0 THEN 'result' ELSE tool_name END AS tool_name FROM er JOIN nth USING (e)""").replace(_EVENTS, _EVENTS_NTH),
    "tail_running_stats": _detail("SELECT session_id, message_count, user_prompts, CAST(0 AS BIGINT) AS tool_calls, input_tokens, output_tokens FROM ds"),
    "scan_transcripts": _chat("""SELECT project_key, session_id, line_no, role AS type, 'c' || c || '-t' || t AS uuid FROM c0
      UNION ALL SELECT project_key, session_id, line_no, 'summary', NULL FROM notes"""),
    "scan_line_numbers": f"""WITH {_EVENTS_NTH} SELECT project_key, session_id, {_DENSE} - 1 + h AS line_no,
      'e' || e || CASE WHEN kind = 'signup' THEN CASE h WHEN 0 THEN '-b' ELSE '-c' END ELSE CASE h WHEN 0 THEN '-u' ELSE '-r' END END AS uuid
      FROM e0 JOIN nth USING (e), range(2) r(h)""",
    "scan_projects": _chat("""SELECT project_key, count(*) AS n_lines FROM (SELECT project_key FROM c0 UNION ALL SELECT project_key FROM notes)
      WHERE project_key IN ('-home-user-src-proj3', '-home-user-src-proj5') GROUP BY project_key"""),
    "lake_sessions": _detail("SELECT project_key, session_id, message_count, user_prompts, continuations, agent_sidechains, summary, duration_seconds FROM ds"),
    "lake_incremental": _detail("SELECT project_key, session_id, message_count, user_prompts, continuations, agent_sidechains, summary, duration_seconds FROM ds"),
    "lake_projects": _listing("SELECT project_key, n_sessions, last_modified, display_name, full_path FROM pr"),
    "lake_tool_calls": _events(f"""SELECT eu.project_key, eu.tool_name, el.is_error, count(*) AS n_calls FROM eu LEFT JOIN el ON el.u = eu.u AND el.tool_id = eu.tool_id
      WHERE eu.e % {MALFORMED_EVERY} <> 0 GROUP BY ALL"""),
    "dfs_order_long": _long("SELECT session_id, n AS line_no, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS dfs_pos FROM w"),
    "subtree_prune_long": _long("SELECT session_id, n AS line_no, kind FROM w WHERE NOT hidden"),
    "prompt_chunks_long": _long("SELECT session_id, line_no, chunk_no FROM ch", """, tr AS (
        SELECT *, n AS line_no, row_number() OVER (PARTITION BY session_id ORDER BY path) - 1 AS dfs_pos FROM w),
      ch AS (
        SELECT session_id, dfs_pos, line_no, CAST(0 AS BIGINT) AS open_pos, CAST(0 AS BIGINT) AS chunk_no FROM tr WHERE dfs_pos = 0
        UNION ALL SELECT tr.session_id, tr.dfs_pos, tr.line_no,
          CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 5 THEN tr.dfs_pos ELSE ch.open_pos END,
          ch.chunk_no + CASE WHEN tr.kind = 'user_prompt' AND tr.dfs_pos - ch.open_pos >= 5 THEN 1 ELSE 0 END
        FROM ch JOIN tr ON tr.session_id = ch.session_id AND tr.dfs_pos = ch.dfs_pos + 1)"""),
    "json_projects": _listing("""SELECT project_key, n_sessions, last_modified, display_name, full_path,
      row_number() OVER (ORDER BY last_modified DESC, project_key) AS position FROM pr"""),
    "json_sessions": _listing("""SELECT project_key, session_id, summary, message_count, end_time,
      row_number() OVER (ORDER BY end_time DESC NULLS LAST, project_key, session_id) AS position FROM li"""),
    "json_search": _listing(f"""SELECT row_number() OVER (ORDER BY query, priority, project_modified DESC, project_key, type <> 'project', end_time DESC NULLS LAST, session_id NULLS FIRST) AS position,
      query, CAST(priority AS BIGINT) AS priority, type, project_key, session_id, summary FROM ({_metadata_hits(['summary', 'proj4'])})"""),
    "json_documents": f"SELECT project_key, session_id, file_name, document FROM ({_document(f'{NL} || {NL}', _TXT, _TEXT_NAME)})",
    "annotation_log": _notes("SELECT star_id, item_type, item_id, project_id, note FROM stars"),
    "annotation_compacted": _notes("SELECT star_id, item_type, item_id, project_id, note FROM stars"),
    "annotation_compacted_tags": _notes("SELECT item_type, item_id, name FROM links"),
    "annotation_rejects": _notes("SELECT CASE WHEN action = 'bogus' THEN 'rejected' ELSE 'events' END AS part, action, count(*) AS n_events FROM log GROUP BY ALL"),
    "export_markdown_parts": _MD_PARTS,
    **_CALL_EXPORTS,
    "export_org_images": _ORG_IMAGES,
}
