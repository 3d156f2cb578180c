"""Bulk export: every session as Markdown, Org, HTML, plain text or JSON.

A message becomes a fragment of text by Column expressions alone. Fragments of
a session are put together in order, in parts of bounded size: the common
session is one part, a huge one many, and the parts in order are the whole
document. Which message goes to which part is decided on the narrow tree index, from the
lengths it holds, before any content is read. No task ever holds more than one part, and no document is staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text, times
from threadloom.functions.tools import argument_lines, argument_preview, guess_language, result_text
from threadloom.functions.variants import array_of, child, entries_of, flag_at, is_object, is_present, show_value, text_at
from threadloom.operators.messages import first_text, item_type
from threadloom.operators.records import KEYS, once
from threadloom.operators.scans import running
from threadloom.operators.tree import reachable, visible, with_content
PART_CHARS = 32 * 1024 * 1024
# What a fragment weighs besides its characters, so that a part is bounded in pieces too.
FRAGMENT_COST = 64
FORMATS = {"md": "md", "markdown": "md", "org": "org", "html": "html", "txt": "txt", "text": "txt", "json": "json"}
EMPTY = ""


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _short_id(c: Column) -> Column:
    return text.cut(c, 8)


def _minutes(clock: Column) -> Column:
    return F.substring(clock, 1, 5)


def _date() -> Column:
    return times.wall_date(F.col("ts_raw"), F.col("ts"))


def _clock() -> Column:
    return times.wall_clock(F.col("ts_raw"), F.col("ts"))


def _start_date() -> Column:
    return times.wall_date(F.col("start_raw"), F.col("start_time"))


def _start_clock() -> Column:
    return times.wall_clock(F.col("start_raw"), F.col("start_time"))


def _each_item(render) -> Column:
    """Texts of all items, joined."""
    return F.array_join(F.transform("items", render), EMPTY)


def _only_texts(render) -> Column:
    return _each_item(lambda i: F.when(item_type(i) == "text", render(_text_of(i))).otherwise(EMPTY))


def _text_of(item: Column) -> Column:
    return F.coalesce(text_at(item, "$.text"), F.lit(EMPTY))


def _item_switch(item: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(EMPTY)
    kind = item_type(item)
    for name, value in cases.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _tool_name(item: Column) -> Column:
    return F.coalesce(text_at(item, "$.name"), F.lit(EMPTY))


def _input_of(item: Column) -> Column:
    return argument_lines(child(item, "$.input"))


def _result_of(item: Column) -> Column:
    return result_text(child(item, "$.content"))


def _raw_result(item: Column) -> Column:
    return show_value(child(item, "$.content"))


def _thinking_of(item: Column, with_thinking: bool) -> Column:
    """Thinking text, NULL where it is empty or left out."""
    return text.none_if_empty(text_at(item, "$.thinking")) if with_thinking else F.lit(None).cast("string")


# The headings, marks and rules in the renderings below are the
# formats readers of these exports expect.

# --- Markdown and Org by tree, HTML: pruned subtrees, full input and results


def markdown_head() -> Column:
    return _cat(
        "# Session: ", _short_id(F.col("session_id")), "\n\n**Started:** ", _start_date(), " ", _minutes(_start_clock()),
        "\n**Messages:** ", F.col("message_count").cast("string"), " | **Tools:** ", F.col("tool_calls").cast("string"),
        "\n\n---\n\n",
    )


def markdown_fragment(with_thinking: bool) -> Column:
    def item(i: Column) -> Column:
        said, args, result, thought = _text_of(i), _input_of(i), _result_of(i), _thinking_of(i, with_thinking)
        long_input = F.contains(args, F.lit("\n")) | (F.length(args) > 80)
        shown_args = F.when(long_input, _cat("```\n", args, "\n```\n\n")).otherwise(_cat("`", args, "`\n\n"))
        label = F.when(flag_at(i, "$.is_error"), "### Error\n\n").otherwise("### Result\n\n")
        return _item_switch(
            i,
            {
                "text": F.when(said != EMPTY, _cat(said, "\n\n")).otherwise(EMPTY),
                "thinking": F.coalesce(
                    _cat("<details>\n<summary>Thinking</summary>\n\n", thought, "\n\n</details>\n\n"), F.lit(EMPTY)
                ),
                "tool_use": _cat("### Tool: ", _tool_name(i), "\n\n", F.coalesce(shown_args, F.lit(EMPTY))),
                "tool_result": _cat(label, F.coalesce(_cat("```\n", result, "\n```\n\n"), F.lit(EMPTY))),
                "image": _cat("![Image](", F.coalesce(text_at(i, "$.source.media_type"), F.lit(EMPTY)), ")\n\n"),
            },
        )

    role = F.when(F.col("type") == "user", "User").otherwise("Assistant")
    compacted = _cat("## ═══ Context Compacted ═══\n\n", _only_texts(lambda t: _cat("*", t, "*\n\n")), "---\n\n")
    return F.when(F.col("is_compacted"), compacted).otherwise(
        _cat("## ", role, " (", _clock(), ")\n\n", _each_item(item), "---\n\n")
    )


def org_head() -> Column:
    return _cat(
        "#+TITLE: Session ", _short_id(F.col("session_id")), "\n#+DATE: ", _start_date(), "\n#+OPTIONS: toc:2 num:nil\n\n",
        "* Session Metadata\n- Started: ", _start_date(), " ", _minutes(_start_clock()),
        "\n- Messages: ", F.col("message_count").cast("string"), "\n- Tool Calls: ", F.col("tool_calls").cast("string"), "\n",
        F.when(F.col("continuations") > 0, _cat("- Continuations: ", F.col("continuations").cast("string"), "\n")).otherwise(EMPTY),
        "\n* Conversation\n\n",
    )


def org_fragment(with_thinking: bool) -> Column:
    stars = F.repeat(F.lit("*"), (F.col("depth") + 2).cast("int"))
    inner = F.repeat(F.lit("*"), (F.col("depth") + 3).cast("int"))

    def item(i: Column) -> Column:
        said, args, result, thought = _text_of(i), _input_of(i), _result_of(i), _thinking_of(i, with_thinking)
        data = F.coalesce(text_at(i, "$.source.data"), F.lit(EMPTY))
        return _item_switch(
            i,
            {
                "text": F.when(said != EMPTY, _cat(said, "\n\n")).otherwise(EMPTY),
                "thinking": F.coalesce(
                    _cat(inner, " THINKING\n:PROPERTIES:\n:VISIBILITY: folded\n:END:\n", thought, "\n\n"), F.lit(EMPTY)
                ),
                "tool_use": _cat(
                    inner, " TOOL: ", _tool_name(i), "\n",
                    F.coalesce(
                        _cat("#+BEGIN_SRC ", guess_language(_tool_name(i), args), "\n", args, "\n#+END_SRC\n\n"), F.lit(EMPTY)
                    ),
                ),
                "tool_result": _cat(
                    inner, F.when(flag_at(i, "$.is_error"), " ERROR\n").otherwise(" RESULT\n"),
                    F.coalesce(_cat("#+BEGIN_EXAMPLE\n", result, "\n#+END_EXAMPLE\n\n"), F.lit(EMPTY)),
                ),
                "image": _cat("[[data:", F.coalesce(text_at(i, "$.source.media_type"), F.lit(EMPTY)), ";base64,", data, "]]\n\n"),
            },
        )

    role = F.when(F.col("type") == "user", "USER").otherwise("ASSISTANT")
    when = _cat("[", _date(), " ", times.wall_weekday(F.col("ts_raw"), F.col("ts")), " ", _minutes(_clock()), "]")
    compacted = _cat(stars, " ═══ COMPACTED ═══\n", _only_texts(lambda t: _cat(t, "\n\n")))
    return F.when(F.col("is_compacted"), compacted).otherwise(_cat(stars, " ", role, " ", when, "\n", _each_item(item), "\n"))


def html_head() -> Column:
    name = text.escape_html(_short_id(F.col("session_id")))
    return _cat(
        '<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>Session: ', name,
        '</title>\n</head>\n<body>\n<div class="container">\n<header>\n<h1>Session: ', name, '</h1>\n<p class="meta">Started: ',
        _start_date(), " ", _minutes(_start_clock()), " | Messages: ", F.col("message_count").cast("string"),
        " | Tools: ", F.col("tool_calls").cast("string"), '</p>\n</header>\n<div class="messages">\n',
    )


HTML_FOOT = "</div>\n</div>\n</body>\n</html>"


def html_fragment(with_thinking: bool) -> Column:
    safe = text.escape_html

    def item(i: Column) -> Column:
        args, result, thought = _input_of(i), _result_of(i), _thinking_of(i, with_thinking)
        paragraphs = F.filter(F.transform(F.split(_text_of(i), "\n\n"), text.trim_all), lambda p: p != EMPTY)
        data = text_at(i, "$.source.data")
        return _item_switch(
            i,
            {
                "text": F.array_join(F.transform(paragraphs, lambda p: _cat("<p>", safe(p), "</p>\n")), EMPTY),
                "thinking": F.coalesce(
                    _cat(
                        '<details class="thinking">\n<summary>Thinking</summary>\n<div class="thinking-content">', safe(thought),
                        "</div>\n</details>\n",
                    ),
                    F.lit(EMPTY),
                ),
                "tool_use": _cat(
                    '<div class="tool-use">\n<div class="tool-header">Tool: ', safe(_tool_name(i)), "</div>\n",
                    F.coalesce(_cat('<pre class="tool-input">', safe(args), "</pre>\n"), F.lit(EMPTY)), "</div>\n",
                ),
                "tool_result": _cat(
                    '<div class="tool-result', F.when(flag_at(i, "$.is_error"), " error").otherwise(EMPTY), '">\n',
                    F.coalesce(_cat("<pre>", safe(result), "</pre>\n"), F.lit(EMPTY)), "</div>\n",
                ),
                "image": F.when(
                    data != EMPTY,
                    _cat(
                        '<img src="data:', safe(F.coalesce(text_at(i, "$.source.media_type"), F.lit(EMPTY))), ";base64,", safe(data),
                        '" class="inline-image">\n',
                    ),
                ).otherwise(EMPTY),
            },
        )

    compacted = _cat(
        '<div class="message compacted">\n<div class="message-header compacted-header">═══ COMPACTED ═══</div>\n'
        '<div class="message-content">\n',
        _only_texts(lambda t: _cat('<p class="dim">', safe(t), "</p>\n")), "</div>\n</div>\n",
    )
    role = F.col("type")
    return F.when(F.col("is_compacted"), compacted).otherwise(
        _cat(
            '<div class="message ', role, F.when(F.col("is_sidechain"), " sidechain").otherwise(EMPTY),
            '">\n<div class="message-header ', role, '-header">[', F.upper(role), "] ", _clock(),
            '</div>\n<div class="message-content">\n', _each_item(item), "</div>\n</div>\n",
        )
    )


# --- Markdown, Org and text by message kind: nothing pruned


#: Parts of a JSON text: strings, empty containers, signs, and what stands between signs.
JSON_PARTS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|\{\}|\[\]|[{}\[\],:]|[^"{}\[\],:\s]++'


def laid_out(v: Column) -> Column:
    """JSON text over lines, two blanks per level, however deep: the levels are the running count of open brackets outside strings."""
    parts = F.regexp_extract_all(F.to_json(v), F.lit(JSON_PARTS), F.lit(0))
    none = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("levels"))

    def count(seen: Column, part: Column) -> Column:
        now = seen["open"] + F.when(part.isin("{", "["), 1).when(part.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("open"), F.concat(seen["levels"], F.array(now)).alias("levels"))

    def shown(part: Column, level: Column) -> Column:
        line = F.concat(F.lit("\n"), F.repeat(F.lit("  "), level))
        return (
            F.when(part.isin("{", "[", ","), F.concat(part, line))
            .when(part.isin("}", "]"), F.concat(line, part))
            .when(part == ":", ": ")
            .otherwise(part)
        )

    return F.array_join(F.zip_with(parts, F.aggregate(parts, none, count, lambda seen: seen["levels"]), shown), "")


def _laid_out_input(item: Column) -> Column:
    args = child(item, "$.input")
    return F.when(is_present(args), laid_out(args))


def _kind_switch(cases: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def markdown_kind_head() -> Column:
    return _cat(
        "# Session ", F.col("session_id"), "\n\n**Started:** ", _start_date(), " ", _start_clock(),
        "\n\n**Messages:** ", F.col("message_count").cast("string"), " | **Tools:** ", F.col("tool_calls").cast("string"),
        "\n\n---\n\n",
    )


def markdown_kind_fragment() -> Column:
    def item(i: Column) -> Column:
        args = _laid_out_input(i)
        return _item_switch(
            i,
            {
                "text": _cat(_text_of(i), "\n\n"),
                "thinking": F.lit("> *∴ Thinking...*\n\n"),
                "tool_use": _cat(
                    "#### ● ", _tool_name(i), "\n\n", F.coalesce(_cat("```json\n", args, "\n```\n\n"), F.lit(EMPTY))
                ),
                "tool_result": _cat("```\n", _raw_result(i), "\n```\n\n"),
            },
        )

    at = _cat(" (", _clock(), ")\n\n")
    args = F.when(F.col("command_args") != EMPTY, _cat(F.col("command_args"), "\n\n")).otherwise(EMPTY)
    head = _kind_switch(
        {
            "compact_summary": F.lit("---\n## ◇ CONTEXT COMPACTED\n\n"),
            "user_prompt": _cat("## ▶ USER", at),
            "meta": _cat("> *System Instructions*", at),
            "assistant": _cat("### ● ASSISTANT", at),
        },
        F.lit(EMPTY),
    )
    command = _cat("## ⌘ ", F.col("command_name"), at, args)
    return F.when(F.col("kind") == "command", command).otherwise(_cat(head, _each_item(item)))


def org_kind_head() -> Column:
    return _cat("#+TITLE: Session ", F.col("session_id"), "\n#+DATE: ", _start_date(), "\n\n")


def org_kind_fragment() -> Column:
    def item(i: Column) -> Column:
        args = _laid_out_input(i)
        return _item_switch(
            i,
            {
                "text": _cat(_text_of(i), "\n"),
                "thinking": F.lit("/∴ Thinking.../\n"),
                "tool_use": _cat(
                    "*** ● ", _tool_name(i), "\n", F.coalesce(_cat("#+BEGIN_SRC json\n", args, "\n#+END_SRC\n"), F.lit(EMPTY))
                ),
                "tool_result": _cat("#+BEGIN_EXAMPLE\n", _raw_result(i), "\n#+END_EXAMPLE\n"),
            },
        )

    at = _cat(" [", _clock(), "]\n")
    args = F.when(F.col("command_args") != EMPTY, _cat(F.col("command_args"), "\n")).otherwise(EMPTY)
    head = _kind_switch(
        {
            "compact_summary": F.lit("* ◇ CONTEXT COMPACTED\n"),
            "user_prompt": _cat("* ▶ USER", at),
            "meta": _cat("** System Instructions", at),
            "assistant": _cat("** ● ASSISTANT", at),
        },
        F.lit(EMPTY),
    )
    command = _cat("* ⌘ ", F.col("command_name"), at, args)
    return F.when(F.col("kind") == "command", command).otherwise(_cat(head, _each_item(item)))


def text_fragment() -> Column:
    said = first_text(F.col("items"))
    calls = _each_item(
        lambda i: F.when(
            item_type(i) == "tool_use", _cat("● ", _tool_name(i), "(", argument_preview(child(i, "$.input")), ")\n")
        ).otherwise(EMPTY)
    )
    return _kind_switch(
        {
            "compact_summary": F.lit("══════════════════ Conversation compacted ═════════════════\n\n"),
            "user_prompt": _cat("> ", said, "\n\n"),
            "command": _cat("> ", F.col("command_name"), " ", F.col("command_args"), "\n\n"),
            "assistant": _cat("● ", said, "\n\n", calls),
        },
        F.lit(EMPTY),
    )


# --- JSON


def json_head() -> Column:
    session = F.struct(
        "project_key", "session_id", "summary", "message_count", "user_prompts", "tool_calls", "continuations",
        "agent_sidechains", "input_tokens", "output_tokens",
    )
    return _cat('{"session":', F.to_json(session), ',"messages":[')


JSON_FOOT = "]}"


def json_fragment() -> Column:
    """A message as a JSON object. The tree is in ``line``, ``parent_line`` and ``depth``."""
    envelope = F.to_json(
        F.struct(F.col("line_no").alias("line"), "parent_line", "depth", "uuid", "type", "kind", "is_sidechain", "is_compacted")
    )
    content = F.array_join(F.transform("items", lambda i: F.to_json(i)), ",")
    comma = F.when(F.col("dfs_pos") > 0, ",").otherwise(EMPTY)
    return _cat(comma, F.regexp_replace(envelope, r"\}\z", ""), ',"content":[', content, "]}")


# --- Assembly


def shown_index(tree: DataFrame, fmt: str, *, with_agents: bool = False, by_kind: bool = False) -> DataFrame:
    """The index rows a format shows."""
    pruned = fmt in ("md", "org", "html") and not by_kind
    return visible(tree, include_agents=with_agents) if pruned else reachable(tree)


def in_parts(index: DataFrame, part_chars: int) -> DataFrame:
    """Add ``part_no``: parts hold about ``part_chars`` characters of content, and each message some more for its marks."""
    cost = F.col("weight") + FRAGMENT_COST
    placed = running(index, KEYS, "dfs_pos", {"before": ("sum", cost, "before")})
    return placed.withColumn("part_no", F.floor(F.coalesce("before", F.lit(0)) / F.lit(part_chars)).cast("bigint")).drop("before")


def fragments(index: DataFrame, messages: DataFrame, fmt: str, *, with_thinking: bool = False, by_kind: bool = False) -> DataFrame:
    """One text per message of the index and its place, ``(keys, part_no, dfs_pos, fragment)``; a file name in the index is kept."""
    if fmt == "txt":
        body = text_fragment()
    elif fmt == "json":
        body = json_fragment()
    elif by_kind:
        body = markdown_kind_fragment() if fmt == "md" else org_kind_fragment()
    else:
        body = {"md": markdown_fragment, "org": org_fragment, "html": html_fragment}[fmt](with_thinking)
    carried = [c for c in ("file_name",) if c in index.columns]
    return once(with_content(index, messages), "fragment", body).select(*KEYS, "part_no", "dfs_pos", *carried, "fragment")


def assemble(pieces: DataFrame) -> DataFrame:
    """Fragments to documents, ``(keys, part_no, document)``. A part without any text is left out."""
    ordered = F.array_sort(F.collect_list(F.struct("dfs_pos", "fragment")))
    named = [F.max(c).alias(c) for c in ("file_name",) if c in pieces.columns]
    return (
        pieces.where("fragment != ''")
        .groupBy(*KEYS, "part_no")
        .agg(ordered.alias("f"), *named)
        .withColumn("document", F.array_join("f.fragment", EMPTY))
        .drop("f")
    )


def default_file_name(session_id: Column, fmt: str) -> Column:
    """``session-<first 8 of the id>.<ending>``; an unnamed ending is html."""
    return _cat("session-", _short_id(session_id), "." + (fmt if fmt in ("html", "md", "org", "json", "txt") else "html"))


def text_file_name(summary: Column, date: Column) -> Column:
    """Date and the first six words of the summary, at most 50 characters, else ``session``."""
    clean = F.regexp_replace(F.lower(summary), "[^a-z0-9 ]", "")
    words = F.filter(F.split(clean, " "), lambda w: w != EMPTY)
    slug = text.cut(F.array_join(F.slice(words, 1, 6), "-"), 50)
    return _cat(date, "-", F.when(slug == EMPTY, "session").otherwise(slug), ".txt")


def export_transcripts(
    tree: DataFrame,
    messages: DataFrame,
    sessions: DataFrame,
    fmt: str,
    *,
    with_thinking: bool = False,
    with_agents: bool = False,
    by_kind: bool = False,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Every session as ``(keys, part_no, file_name, document)``.

    ``sessions`` is the detail table, ``tree`` a written index. Write the result with
    ``partitionBy("project_key")``. By default trees are rendered with pruned
    subtrees; ``by_kind`` selects the flat rendering by message kind. The parts of a
    session in order of ``part_no`` are its whole document; a later part has its number in its file name.
    """
    wanted = FORMATS.get(fmt.lower())
    if wanted is None:
        raise ValueError("unknown export format")
    if by_kind and wanted == "html":
        raise ValueError("HTML is exported by tree only")
    by_summary = wanted == "txt"
    index = in_parts(shown_index(tree, wanted, with_agents=with_agents, by_kind=by_kind), part_chars)
    named = sessions
    if by_summary:
        # The name depends on the session row: it joins the narrow index, not the documents.
        named = sessions.withColumn("file_name", text_file_name(F.col("summary"), _start_date()))
        index = index.join(named.select(*KEYS, "file_name"), KEYS)
    pieces = fragments(index, messages, wanted, with_thinking=with_thinking, by_kind=by_kind)
    heads = {
        "md": markdown_kind_head() if by_kind else markdown_head(),
        "org": org_kind_head() if by_kind else org_head(),
        "html": html_head(),
        "json": json_head(),
        # The plain text opens with two blank lines where a product banner would be.
        "txt": F.lit("\n\n"),
    }
    carried = ["file_name"] if by_summary else []
    first, before, after = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")
    whole = pieces.unionByName(
        named.select(*KEYS, first.alias("part_no"), before.alias("dfs_pos"), *carried, heads[wanted].alias("fragment"))
    )
    foot = {"html": HTML_FOOT, "json": JSON_FOOT}.get(wanted)
    if foot:
        last = index.groupBy(*KEYS).agg(F.max("part_no").alias("part_no"))
        closed = named.select(*KEYS).join(last, KEYS, "left").withColumn("part_no", F.coalesce("part_no", first))
        whole = whole.unionByName(closed.select(*KEYS, "part_no", after.alias("dfs_pos"), F.lit(foot).alias("fragment")))
    documents = assemble(whole)
    if not by_summary:
        documents = documents.withColumn("file_name", default_file_name(F.col("session_id"), wanted))
    return documents.select(*KEYS, "part_no", part_file_name(F.col("file_name"), F.col("part_no")).alias("file_name"), "document")


def part_file_name(name: Column, part_no: Column) -> Column:
    """The name of a part: the first has the plain name, the second ``...-part-0002.md``."""
    mark = _cat("-part-", F.lpad((part_no + 1).cast("string"), 4, "0"))
    stem = F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 1)
    return F.when(part_no == 0, name).otherwise(_cat(stem, mark, F.regexp_extract(name, r"^(.*)(\.[^.]*)$", 2)))


def raw_content(items: Column) -> Column:
    """JSON array of a message's content items."""
    return _cat("[", F.array_join(F.transform(items, lambda i: F.to_json(i)), ","), "]")
