"""Every registered query: a name, and a function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import paths, text, times, tools
from threadloom.functions.variants import child
from threadloom.operators import annotation_log as notes_log, annotations, export, many, markup, messages, records, search, sessions, tool_calls, tree, views
from threadloom.plans import lake
from threadloom.session import new_folder, scratch, stage
from threadloom.sources import bridges, sinks, transcripts
from threadloom.streaming import names, tail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = records.KEYS
SID = "session_id"

# Parameters of the search and lookup queries.
WORD = "tion"
PHRASE = "the an"
MALFORMED_EVERY = 97


def register(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and times as epoch micros, so results compare across engines."""
    def shape(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(c).alias(f.name)
        return c

    return df.select(*[shape(f) for f in df.schema.fields])


# --- shared inputs; plans only, no data is kept


@lru_cache(maxsize=4)
def chat_lines(spark, sf):
    return bridges.chat_lines(bridges.table(spark, sf, "conversations"))


@lru_cache(maxsize=4)
def chat_records(spark, sf):
    return records.decode(chat_lines(spark, sf))


@lru_cache(maxsize=4)
def chat_messages(spark, sf):
    return messages.build_messages(chat_records(spark, sf))


def chat_tree(spark, sf):
    return tree.build_tree(chat_records(spark, sf))


@lru_cache(maxsize=4)
def chat_blocks(spark, sf):
    return messages.explode_blocks(chat_messages(spark, sf))


def chat_listing(spark, sf):
    listed = stage(sessions.listable(sessions.listing_sessions(chat_records(spark, sf))))
    return listed, sessions.project_table(listed)


def classified(found: DataFrame) -> DataFrame:
    """Records with their items, written once for the branches of a query, which would each parse the lines again."""
    return stage(messages.classify(found))


@lru_cache(maxsize=4)
def event_lines(spark, sf, malformed_every=0):
    return bridges.event_lines(bridges.table(spark, sf, "events"), malformed_every)


@lru_cache(maxsize=4)
def event_messages(spark, sf):
    return messages.build_messages(records.decode(event_lines(spark, sf)))


def event_tree(spark, sf):
    return tree.build_tree(records.decode(event_lines(spark, sf)), weigh=False)


def event_content(spark, sf):
    """The tree of the events and their messages, from lines parsed once."""
    found = classified(records.decode(event_lines(spark, sf)))
    return tree.build_tree(found), messages.build_messages(found)


@lru_cache(maxsize=4)
def event_blocks(spark, sf):
    return messages.explode_blocks(event_messages(spark, sf))


@lru_cache(maxsize=4)
def toolbox_blocks(spark, sf):
    lines = bridges.toolbox_lines(bridges.table(spark, sf, "events"))
    return messages.explode_blocks(messages.build_messages(records.decode(lines)))


def notes(spark, sf):
    return bridges.annotation_events(bridges.table(spark, sf, "events"))


# --- scans, decoding


@register
def line_ordinal(spark, sf):
    return transcripts.line_ordinals(chat_lines(spark, sf)).select(*KEYS, "line_no", "ordinal")


@register
def path_keys(spark, sf):
    named = chat_lines(spark, sf).select(F.concat(F.lit("file:///logs/"), "project_key", F.lit("/"), SID, F.lit(".jsonl")).alias("path")).distinct()
    project, session = transcripts.path_keys(F.col("path"))
    return named.select("path", project.alias("project_key"), session.alias(SID))


@register
def malformed_audit(spark, sf):
    bad = records.quarantine(event_lines(spark, sf, MALFORMED_EVERY))
    return bad.groupBy("project_key", "reason").agg(F.count("*").alias("n_lines"))


@register
def decode_envelope(spark, sf):
    return chat_records(spark, sf).select(
        *KEYS, "line_no", "type", "uuid", "parent_uuid_raw", "ts", "is_compacted", "is_sidechain", "is_meta", "model",
        "summary_text", "slug", "version", "git_branch", "cwd",
    )


@register
def usage_pick(spark, sf):
    return chat_records(spark, sf).where("type = 'assistant'").select(
        SID, "line_no", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens"
    )


@register
def content_blocks(spark, sf):
    return chat_blocks(spark, sf).select(SID, "line_no", "block_no", "block_type", "text")


@register
def text_blocks(spark, sf):
    return chat_blocks(spark, sf).where("block_type = 'text'").select(SID, "line_no", "block_no", "text")


@register
def thinking_blocks(spark, sf):
    return chat_blocks(spark, sf).where("block_type = 'thinking'").select(SID, "line_no", "block_no", "text")


@register
def classify_messages(spark, sf):
    return chat_messages(spark, sf).select(SID, "line_no", "type", "kind", "is_command")


@register
def command_extract(spark, sf):
    return chat_messages(spark, sf).where("is_command").select(SID, "line_no", "command_name", "command_args")


@register
def first_text(spark, sf):
    return chat_messages(spark, sf).select(SID, "line_no", messages.first_text(F.col("items")).alias("first_text"))


@register
def joined_text(spark, sf):
    return chat_messages(spark, sf).select(SID, "line_no", messages.joined_text(F.col("items")).alias("joined_text"))


@register
def first_line(spark, sf):
    return chat_blocks(spark, sf).where("block_type = 'text'").select(SID, "line_no", "block_no", text.first_line(F.col("text")).alias("first_line"))


@register
def conversational(spark, sf):
    return chat_records(spark, sf).where(messages.is_conversational()).groupBy("project_key", "type").agg(F.count("*").alias("n_messages"))


@register
def code_blocks(spark, sf):
    texts = chat_blocks(spark, sf).where("block_type = 'text'")
    return markup.code_blocks(texts, [SID, "line_no", "block_no"])


@register
def raw_content(spark, sf):
    return chat_messages(spark, sf).select(SID, "line_no", export.raw_content(F.col("items")).alias("content_json"))


# --- sessions and projects


@register
def session_stats_detail(spark, sf):
    return sessions.detail_sessions(chat_records(spark, sf)).select(
        *KEYS, "message_count", "user_prompts", "tool_calls", "continuations", "agent_sidechains"
    )


@register
def session_stats_listing(spark, sf):
    return sessions.listing_sessions(chat_records(spark, sf)).select(
        *KEYS, "message_count", "user_prompts", "tool_calls", "continuations", "agent_sidechains"
    )


@register
def token_usage(spark, sf):
    found = sessions.detail_sessions(chat_records(spark, sf))
    return found.select(
        *KEYS, "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        ((F.col("cache_read_tokens") > 0) | (F.col("cache_create_tokens") > 0)).alias("has_cache_tokens"),
    )


@register
def session_metadata(spark, sf):
    return sessions.detail_sessions(chat_records(spark, sf)).select(*KEYS, *sessions.METADATA)


@register
def session_duration(spark, sf):
    return sessions.detail_sessions(chat_records(spark, sf)).select(*KEYS, "start_time", "end_time", "duration_seconds")


@register
def session_summary_detail(spark, sf):
    return sessions.detail_sessions(chat_records(spark, sf)).select(*KEYS, "summary")


@register
def session_summary_listing(spark, sf):
    return sessions.listing_sessions(chat_records(spark, sf)).select(*KEYS, "summary")


@register
def listable_sessions(spark, sf):
    return chat_listing(spark, sf)[0].select(*KEYS, "summary")


@register
def project_listing(spark, sf):
    return sessions.list_projects(chat_listing(spark, sf)[1])


@register
def project_filter(spark, sf):
    return sessions.list_projects(chat_listing(spark, sf)[1], by="name", name_contains="PROJ3")


@register
def session_filter(spark, sf):
    return sessions.list_sessions(chat_listing(spark, sf)[0], by="messages", contains="SUMMARY OF").select(*KEYS, "summary", "message_count")


@register
def session_listing(spark, sf):
    listed, projects = chat_listing(spark, sf)
    return sessions.list_sessions(sessions.with_project(listed, projects)).select(SID, "display_name", "summary", "start_time", "end_time")


@register
def recent_sessions(spark, sf):
    return sessions.recent_sessions(*chat_listing(spark, sf), limit=25).select(SID, "display_name", "summary", "end_time")


@register
def recent_index(spark, sf):
    return sessions.recent_index(*chat_listing(spark, sf)).select("position", *KEYS, "summary")


@register
def find_project(spark, sf):
    return sessions.find_projects(chat_listing(spark, sf)[1], ["proj3", "PROJ", "-home-user-src-proj5", "nowhere"])


@register
def find_session(spark, sf):
    found = sessions.find_sessions(*chat_listing(spark, sf), ["conv-1", "proj2:conv-1", "proj2:conv", "conv-3", "proj0:conv-1", "none:conv-1"])
    return found.select("request", *KEYS, "summary")


@register
def global_stats(spark, sf):
    return sessions.global_counts(chat_listing(spark, sf)[0])


@register
def ingest_audit(spark, sf):
    lines = event_lines(spark, sf, MALFORMED_EVERY)
    return sessions.ingest_audit(records.parse_lines(lines), sessions.listing_sessions(records.decode(lines, "listing")))


# --- trees and views


@register
def message_tree(spark, sf):
    return chat_tree(spark, sf).select(SID, "line_no", "parent_uuid", "parent_line", "is_root", "reachable")


@register
def dfs_order(spark, sf):
    return chat_tree(spark, sf).select(SID, "line_no", "dfs_pos", "dfs_end")


@register
def message_depth(spark, sf):
    return chat_tree(spark, sf).select(SID, "line_no", "depth")


@register
def root_messages(spark, sf):
    return chat_tree(spark, sf).where("is_root").select(SID, "line_no", "kind")


@register
def subtree_prune(spark, sf):
    return tree.visible(chat_tree(spark, sf), cut_compacted=False).select(SID, "line_no", "kind")


@register
def subtree_prune_compact(spark, sf):
    return tree.visible(chat_tree(spark, sf)).select(SID, "line_no", "kind")


@register
def compact_reparent(spark, sf):
    return event_tree(spark, sf).select(SID, "line_no", "parent_uuid_raw", "parent_uuid", "parent_line")


@register
def threads(spark, sf):
    return views.threads(chat_tree(spark, sf)).select(SID, "line_no", "thread_no", "level")


@register
def thread_messages(spark, sf):
    return views.threads(event_tree(spark, sf)).select(SID, "line_no", "kind", "thread_no", "level")


@register
def sections(spark, sf):
    return views.sections(event_tree(spark, sf)).groupBy(SID, "section_no").agg(
        F.count("*").alias("n_messages"), F.min("line_no").alias("first_line_no")
    )


@register
def prompt_chunks(spark, sf):
    return views.prompt_chunks(chat_tree(spark, sf), size=2).select(SID, "line_no", "chunk_no")


@register
def tail_sections(spark, sf):
    return views.hidden_counts(views.tail_view(chat_tree(spark, sf), keep=1, threshold=4, chunk_size=2))


@register
def nav_groups(spark, sf):
    return views.nav_groups(chat_tree(spark, sf)).drop("project_key")


@register
def nav_labels(spark, sf):
    return views.nav_labels(*event_content(spark, sf)).select(SID, "line_no", "group_no", "child_no", "listed", "label")


@register
def prompt_neighbors(spark, sf):
    return views.prompt_neighbors(chat_tree(spark, sf)).select(SID, "line_no", "dfs_pos", "prev_pos", "next_pos")


# --- tool calls


@register
def tool_uses(spark, sf):
    return tool_calls.tool_uses(event_blocks(spark, sf)).select(SID, "line_no", "block_no", "tool_id", "tool_name", F.to_json("tool_input").alias("tool_input"))


@register
def tool_results(spark, sf):
    found = tool_calls.tool_results(event_blocks(spark, sf))
    return found.select(SID, "line_no", "block_no", "tool_id", F.to_json("tool_result").alias("tool_result"), "is_error")


@register
def last_result(spark, sf):
    found = tool_calls.last_results(tool_calls.tool_results(event_blocks(spark, sf)))
    return found.select(SID, "tool_id", "result_line", "result_block", F.to_json("tool_result").alias("tool_result"), "is_error")


@register
def tool_call_results(spark, sf):
    found = tool_calls.pair_calls(event_blocks(spark, sf))
    return found.select(SID, "line_no", "tool_id", "tool_name", "result_line", "is_error", "is_active", F.to_json("tool_result").alias("tool_result"))


@register
def tool_preview(spark, sf):
    calls = tool_calls.tool_uses(event_blocks(spark, sf))
    return calls.select(SID, "line_no", "tool_name", tools.tool_preview(F.col("tool_name"), F.col("tool_input")).alias("preview"))


@register
def tool_arg_preview(spark, sf):
    found = tool_calls.tool_uses(event_blocks(spark, sf))
    return found.select(SID, "line_no", tools.argument_preview(F.col("tool_input")).alias("argument"))


@register
def active_tools(spark, sf):
    found = tool_calls.tool_uses(event_blocks(spark, sf)).withColumn("is_active", tools.is_active(F.col("tool_name")))
    return found.groupBy("project_key", "tool_name", "is_active").agg(F.count("*").alias("n_calls"))


@register
def guess_language(spark, sf):
    return tool_calls.described_calls(event_blocks(spark, sf)).select(SID, "line_no", "tool_name", "language")


@register
def tool_input_lines(spark, sf):
    return tool_calls.described_calls(event_blocks(spark, sf)).select(SID, "line_no", "argument_text")


@register
def tool_args_generic(spark, sf):
    return tool_calls.tool_arguments(event_blocks(spark, sf), "Probe").drop("project_key")


@register
def tool_call_count(spark, sf):
    return event_messages(spark, sf).select(SID, "line_no", messages.tool_call_count(F.col("items")).alias("n_calls"))


def _arguments_query(name: str, tool: str) -> None:
    def run(spark, sf):
        return tool_calls.tool_arguments(toolbox_blocks(spark, sf), tool).drop("project_key")

    run.__name__ = name
    register(run)


for _name, _tool in {
    "file_edits": "Edit", "file_writes": "Write", "todo_items": "TodoWrite", "agent_tasks": "Task", "skill_calls": "Skill",
    "web_searches": "WebSearch", "web_fetches": "WebFetch", "asked_options": "AskUserQuestion", "lsp_calls": "LSP",
    "task_outputs": "TaskOutput", "shell_kills": "KillShell", "other_arguments": "Other",
}.items():
    _arguments_query(_name, _tool)


@register
def image_blocks(spark, sf):
    return toolbox_blocks(spark, sf).where("block_type = 'image'").select(SID, "line_no", "block_no", "media_type", "image_data")


@register
def unknown_blocks(spark, sf):
    known = ("text", "thinking", "tool_use", "tool_result", "image")
    return toolbox_blocks(spark, sf).where(~F.col("block_type").isin(*known)).select(SID, "line_no", "block_no", "block_type", "text")


@register
def table_cells(spark, sf):
    piped = F.regexp_replace("text", r"(?dm)^(.*\|.*)$", r"\| $1 \|")
    docs = bridges.table(spark, sf, "documents").select("doc_id", piped.alias("text"))
    return markup.table_cells(docs, ["doc_id"])


# --- search


@register
def search_sessions(spark, sf):
    found = search.search_sessions(*chat_listing(spark, sf), ["summary", "CONV-1", "proj4"], limit=0)
    return found.select("query", "priority", "type", *KEYS, "project", "summary")


@register
def search_type_filter(spark, sf):
    found = search.search_sessions(*chat_listing(spark, sf), ["o"], only="session")
    return found.select("query", "priority", "type", *KEYS, "summary")


@register
def content_first_hit(spark, sf):
    return search.content_hits(chat_tree(spark, sf), chat_messages(spark, sf), [WORD, "tail"]).select(SID, "query", "line_no", "message_id", "snippet")


@register
def tool_content_hit(spark, sf):
    return search.content_hits(*event_content(spark, sf), ["run 3", "cents 99"]).select(SID, "query", "line_no", "message_id", "snippet")


@register
def search_global(spark, sf):
    found = search.search_global(*chat_listing(spark, sf), chat_tree(spark, sf), chat_messages(spark, sf), [WORD, "proj4", "/src/proj", "conv-2"], limit=40)
    return found.select("query", "priority", "type", *KEYS, "project", "summary", "snippet", "message_id")


def chat_words(spark, sf) -> DataFrame:
    """Queries: every long word of the conversations, in the case it stands in, ids of sessions and starts of them."""
    given = bridges.table(spark, sf, "conversations")
    words = given.select(F.explode(F.split("text", " ")).alias("query")).where("length(query) >= 9")
    ids = given.select(F.explode(F.array(F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")), F.lit("proj4"), F.lit("/src/proj"))).alias("query"))
    return words.unionAll(ids)


@register
def search_many(spark, sf):
    found = many.search_many(*chat_listing(spark, sf), chat_tree(spark, sf), chat_messages(spark, sf), chat_words(spark, sf))
    return found.select("query", "priority", "type", *KEYS, "project", "summary", "snippet", "message_id")


@register
def find_projects_many(spark, sf):
    listed = chat_listing(spark, sf)[1]
    asked = listed.select(F.explode(F.array("project_key", "display_name", F.upper("display_name"), F.substring("display_name", 1, 4))).alias("request"))
    return many.find_projects_many(listed, asked).select("request", "project_key", "n_sessions", "display_name")


@register
def find_sessions_many(spark, sf):
    """Every session id cut at several lengths, alone and below the name of its project."""
    listed, of = chat_listing(spark, sf)
    named = sessions.with_project(listed, of)
    cut = F.transform(F.array(*map(F.lit, (4, 6, 7, 99))), lambda n: F.substring(F.col(SID), F.lit(1), n))
    starts = named.select("display_name", F.explode(cut).alias("start"))
    asked = starts.select("start").unionAll(starts.select(F.concat("display_name", F.lit(":"), "start"))).toDF("request")
    return many.find_sessions_many(listed, of, asked).select("request", *KEYS, "summary")


@register
def faceted_search(spark, sf):
    return search.faceted_search(chat_tree(spark, sf), chat_messages(spark, sf), WORD).drop("project_key")


@register
def faceted_words(spark, sf):
    return search.faceted_search(chat_tree(spark, sf), chat_messages(spark, sf), PHRASE, ["user", "response"]).drop("project_key")


@register
def faceted_tool_search(spark, sf):
    return search.faceted_search(*event_content(spark, sf), "agent-2", ["tool", "agent"]).drop("project_key")


@register
def snippets(spark, sf):
    return bridges.table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(WORD), 60).alias("snippet")).where("snippet is not null")


@register
def relevance_score(spark, sf):
    docs = bridges.table(spark, sf, "documents")
    return docs.select("doc_id", text.relevance(F.col("text"), WORD).alias("one_word"), text.relevance(F.col("text"), PHRASE).alias("two_words"))


# --- texts, paths, times


@register
def result_cap(spark, sf):
    return bridges.table(spark, sf, "documents").select("doc_id", tools.cap_result(F.col("text"), 5000).alias("capped"))


@register
def truncate_text(spark, sf):
    c = F.col("text")
    return bridges.table(spark, sf, "documents").select(
        "doc_id", text.cut(c, 8).alias("cut_8"), text.ellipsize(c, 60).alias("dots_60"), text.cut_with_dots(c, 40).alias("dots_after_40")
    )


def _page_paths(spark, sf) -> DataFrame:
    return bridges.table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@register
def subpath_scope(spark, sf):
    return _page_paths(spark, sf).where(paths.under_root(F.col("path"), "/en")).select("page_id", "path")


@register
def safe_urls(spark, sf):
    mixed = F.when(F.col("page_id") % 3 == 0, F.upper("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x-"), "url")).otherwise(F.col("url"))
    return bridges.table(spark, sf, "pages").select("page_id", text.is_web_url(mixed).alias("is_safe"))


@register
def encode_path(spark, sf):
    return _page_paths(spark, sf).select("page_id", paths.encode_path(F.col("path")).alias("encoded"))


@register
def decode_path(spark, sf):
    key = paths.encode_path(F.col("path"))
    return _page_paths(spark, sf).select("page_id", paths.decode_path(key).alias("decoded"))


@register
def project_display_name(spark, sf):
    host = F.when(F.col("page_id") % 2 == 0, "/home/kim/work/github/com").otherwise("/Users/kim/src")
    key = paths.encode_path(F.concat(host, "path"))
    return _page_paths(spark, sf).select("page_id", key.alias("project_key"), paths.display_name(key).alias("display_name"))


@register
def recency_bucket(spark, sf):
    events = bridges.table(spark, sf, "events")
    micros = F.unix_micros(F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))
    as_of = F.unix_micros(F.lit("2024-01-12 00:00:00Z").cast("timestamp"))
    return events.select("event_id", times.recency(micros, as_of).alias("age"))


# --- annotations


@register
def star_events_valid(spark, sf):
    log = notes(spark, sf)
    good = annotations.valid_events(log).withColumn("is_valid", F.lit(True))
    bad = annotations.rejected_events(log).withColumn("is_valid", F.lit(False))
    return good.unionByName(bad).groupBy("action", "is_valid").agg(F.count("*").alias("n_events"))


@register
def stars_current(spark, sf):
    return _star_rows(annotations.list_stars(annotations.current_stars(notes(spark, sf))))


@register
def stars_by_type(spark, sf):
    return _star_rows(annotations.list_stars(annotations.current_stars(notes(spark, sf)), "session"))


def _star_rows(stars: DataFrame) -> DataFrame:
    return stars.select("star_id", "item_type", "item_id", "project_id", "note")


@register
def is_starred(spark, sf):
    log = notes(spark, sf)
    return annotations.starred(log.select("item_type", "item_id").distinct(), annotations.current_stars(log))


@register
def tags(spark, sf):
    return annotations.all_tags(notes(spark, sf)).select("name")


@register
def item_tags(spark, sf):
    return annotations.item_tags(notes(spark, sf)).select("item_type", "item_id", "name")


@register
def tags_of_item(spark, sf):
    log = notes(spark, sf)
    return annotations.tags_of(annotations.all_tags(log), annotations.item_tags(log), "session", "item-7").select("name")


# --- export


def _export_query(name: str, fmt: str, source=chat_records, **options) -> None:
    def run(spark, sf):
        found = classified(source(spark, sf))
        detail = stage(sessions.detail_sessions(found))
        return export.export_transcripts(tree.build_tree(found), messages.build_messages(found), detail, fmt, **options)

    run.__name__ = name
    register(run)


_export_query("export_markdown", "md", with_thinking=True)
_export_query("export_org", "org", with_agents=True)
_export_query("export_html", "html", with_thinking=True)
_export_query("export_markdown_kind", "md", by_kind=True)
_export_query("export_org_kind", "org", by_kind=True)
_export_query("export_text", "txt")
_export_query("export_json", "json")
_export_query("export_markdown_parts", "md", by_kind=True, part_chars=2000)


def event_records(spark, sf):
    return records.decode(event_lines(spark, sf))


def toolbox_records(spark, sf):
    return records.decode(bridges.toolbox_lines(bridges.table(spark, sf, "events")))


for _fmt, _kind in (("md", False), ("org", False), ("html", False), ("md", True), ("org", True), ("txt", False), ("json", False)):
    _long = {"md": "markdown", "txt": "text"}.get(_fmt, _fmt) + ("_kind" if _kind else "")
    _export_query(f"export_{_long}_calls", _fmt, event_records, by_kind=_kind)


@register
def export_org_images(spark, sf):
    found = classified(toolbox_records(spark, sf))
    whole = export.export_transcripts(tree.build_tree(found), messages.build_messages(found), sessions.detail_sessions(found), "org")
    images = F.regexp_extract_all("document", F.lit(r"\[\[data:([^\]]*)\]\]"), F.lit(1))
    return whole.select(*KEYS, F.array_join(images, "\n").alias("images"))


@register
def export_filename(spark, sf):
    found = sessions.detail_sessions(chat_records(spark, sf))
    date = times.wall_date(F.col("start_raw"), F.col("start_time"))
    return found.select(
        SID, export.text_file_name(F.col("summary"), date).alias("text_name"), export.default_file_name(F.col(SID), "md").alias("default_name")
    )


@register
def laid_out_inputs(spark, sf):
    """Arguments nested up to thirteen deep, as the exports by kind write them."""
    depth = (F.col("event_id") % 14).cast("int")
    nested = F.concat(F.repeat(F.lit('{"a":'), depth), F.lit('["{,'), "event_type", F.lit('",[],'), F.col("event_id").cast("string"), F.lit("]"), F.repeat(F.lit("}"), depth))
    return bridges.table(spark, sf, "events").select("event_id", export.laid_out(F.parse_json(nested)).alias("shown"))


@register
def size_policies(spark, sf):
    """Lines over the cap under each policy: the line goes, all after it, the whole session; and how many lines the quarantine holds."""
    lines = event_lines(spark, sf)
    long = lines.withColumn("value", F.when(F.col("line_no") % 61 == 60, F.concat("value", F.repeat(F.lit(" "), 5000))).otherwise(F.col("value")))
    table = stage(records.ingest(long, cap=4096))
    kept = [records.records_for(table, "detail", policy=p).groupBy(SID).agg(F.count("*").alias("n_lines")).withColumn("policy", F.lit(p)) for p in records.POLICIES]
    held = records.rejected(table).groupBy(SID).agg(F.count("*").alias("n_lines")).withColumn("policy", F.lit("quarantine"))
    return kept[0].unionAll(kept[1]).unionAll(kept[2]).unionAll(held)


# --- log files: lines written as the log writers do, then scanned, ingested, tailed


def _logs(spark, lines: DataFrame, **options) -> str:
    root = new_folder(spark)
    bridges.write_logs(lines, root, **options)
    return root


@register
def scan_transcripts(spark, sf):
    lines = transcripts.scan_transcripts(spark, _logs(spark, chat_lines(spark, sf), padded=True))
    return records.decode(lines).select(*KEYS, "line_no", "type", "uuid")


@register
def scan_line_numbers(spark, sf):
    lines = transcripts.scan_transcripts(spark, _logs(spark, event_lines(spark, sf)))
    return records.decode(lines).select(*KEYS, "line_no", "uuid")


@register
def scan_projects(spark, sf):
    wanted = [f"{bridges.PROJECT_PREFIX}{n}" for n in (3, 5)] + ["none"]
    lines = transcripts.scan_transcripts(spark, _logs(spark, chat_lines(spark, sf), padded=True), projects=wanted)
    return lines.where("value != ''").groupBy("project_key").agg(F.count("*").alias("n_lines"))


def _lake(spark, lines: DataFrame, **options) -> str:
    out = new_folder(spark)
    with scratch(spark):
        lake.build_lake(spark, _logs(spark, lines, **options), out)
    return out


@register
def lake_sessions(spark, sf):
    found = lake.read_table(spark, _lake(spark, chat_lines(spark, sf), padded=True), "sessions")
    return found.select(*KEYS, "message_count", "user_prompts", "continuations", "agent_sidechains", "summary", "duration_seconds")


@register
def lake_incremental(spark, sf):
    """A lake of the sessions of even number, their logs four lines long at first, brought up to date with all of them."""
    root, out = new_folder(spark), new_folder(spark)
    lines = chat_lines(spark, sf)
    bridges.write_logs(lines.where((F.regexp_extract(SID, r"(\d+)$", 1).cast("bigint") % 2 == 0) & (F.col("line_no") < 4)), root, padded=True)
    lake.build_lake(spark, root, out)
    bridges.write_logs(lines, root, padded=True)
    lake.update_lake(spark, root, out)
    found = lake.read_table(spark, out, "sessions")
    return found.select(*KEYS, "message_count", "user_prompts", "continuations", "agent_sidechains", "summary", "duration_seconds")


@register
def lake_projects(spark, sf):
    return lake.read_table(spark, _lake(spark, chat_lines(spark, sf)), "projects")


@register
def lake_tool_calls(spark, sf):
    found = lake.read_table(spark, _lake(spark, event_lines(spark, sf, MALFORMED_EVERY)), "tool_calls")
    return found.groupBy("project_key", "tool_name", "is_error").agg(F.count("*").alias("n_calls"))


# --- long sessions, by the paths that cut a session over many tasks


@lru_cache(maxsize=4)
def long_records(spark, sf):
    return records.decode(bridges.long_lines(bridges.table(spark, sf, "events")))


def long_tree(spark, sf):
    return tree.build_tree(long_records(spark, sf), pack_limit=64, weigh=False)


@register
def dfs_order_long(spark, sf):
    return long_tree(spark, sf).select(SID, "line_no", "depth", "dfs_pos")


@register
def subtree_prune_long(spark, sf):
    return tree.visible(long_tree(spark, sf)).select(SID, "line_no", "kind")


@register
def prompt_chunks_long(spark, sf):
    return views.prompt_chunks(long_tree(spark, sf), size=5, span=16).select(SID, "line_no", "chunk_no")


# --- streaming: log files read as streams, landed batch by batch

_STATS = "project_key string, session_id string, span bigint, message_count bigint, user_prompts bigint, tool_calls bigint, input_tokens bigint, output_tokens bigint"


def _land(apply):
    return lambda stream, **where: tail.land(stream, apply, **where)


def _from_chunks(spark, lines: DataFrame, **options) -> DataFrame:
    return tail.read_chunks(spark, _logs(spark, lines, padded=True, chunk=3), index=new_folder(spark), **options)


def _tailed(stream: DataFrame, ticks: bool = False) -> DataFrame:
    shown = lambda lines: tail.tail_messages(lines).select(SID, "line_no", "tail_kind", "is_agent")
    return tail.replay(stream, _land(shown), "session_id string, line_no bigint, tail_kind string, is_agent boolean", ticks=ticks).drop("batch")


def _from_growing(spark, lines: DataFrame, **options) -> DataFrame:
    return tail.read_growing(spark, _logs(spark, lines, **options), startingOffsets="earliest", maxBytesPerTrigger=0)


def _named_results(spark, lines: DataFrame) -> DataFrame:
    named = tail.replay(_from_growing(spark, lines), tail.land_result_names, names.NAMED)
    return named.select(SID, "line_no", "block_no", "tool_id", "tool_name")


@register
def tail_messages(spark, sf):
    return _tailed(_from_growing(spark, chat_lines(spark, sf), padded=True))


@register
def tail_growing(spark, sf):
    stream = _from_growing(spark, chat_lines(spark, sf), padded=True)
    keys = lambda lines: lines.select(*KEYS, "line_no")
    return tail.replay(stream, _land(keys), "project_key string, session_id string, line_no bigint").drop("batch")


_PLACES = "project_key string, session_id string, line_no bigint"


@register
def tail_capped(spark, sf):
    """A tail that reads 64 KiB a tick."""
    root = _logs(spark, chat_lines(spark, sf), padded=True)
    stream = tail.read_growing(spark, root, startingOffsets="earliest", maxBytesPerTrigger=64 << 10)
    keys = lambda lines: lines.select(*KEYS, "line_no")
    return tail.replay(stream, _land(keys), _PLACES, ticks=True).drop("batch")


@register
def tail_truncated(spark, sf):
    """Files of four lines, two thirds of them cut to one line; one third grows, one third is written anew and longer, one stays short."""
    root, index, out, state = (new_folder(spark) for _ in range(4))
    turn = F.regexp_extract(SID, r"(\d+)$", 1).cast("bigint") % 3
    lines = chat_lines(spark, sf).withColumn("third", turn)
    for now in ("line_no < 4", "line_no < 1 and third > 0", "third <> 1"):
        bridges.write_logs(lines.where(now).drop("third"), root, padded=True)
        stream = tail.read_growing(spark, root, index, startingOffsets="earliest", maxBytesPerTrigger=0)
        tail.land(stream, lambda found: found.select(*KEYS, "line_no"), out, state, {"availableNow": True}).awaitTermination()
    return tail.read_landed(spark, out, _PLACES).drop("batch")


@register
def tail_chunks(spark, sf):
    return _tailed(_from_chunks(spark, chat_lines(spark, sf)), ticks=True)


@register
def tail_tool_names(spark, sf):
    return _named_results(spark, event_lines(spark, sf))


@register
def tail_unknown_results(spark, sf):
    lost = F.col("line_no") % 14 == 0  # every seventh event loses its first line
    return _named_results(spark, event_lines(spark, sf).withColumn("value", F.when(lost, "").otherwise(F.col("value"))))


@register
def tail_running_stats(spark, sf):
    stream = _from_chunks(spark, chat_lines(spark, sf), max_files=100)
    return tail.current_stats(tail.replay(stream, tail.land_running_stats, _STATS, ticks=True)).drop("project_key")


# --- sinks


def _json_again(spark, listing: DataFrame, *order: Column) -> DataFrame:
    folder = new_folder(spark)
    sinks.write_json(listing, folder, *order)
    return spark.read.schema(listing.withColumn("position", F.lit(0).cast("bigint")).schema).json(folder)


@register
def json_projects(spark, sf):
    listed = chat_listing(spark, sf)[1].select("project_key", "n_sessions", "display_name", "full_path", F.unix_micros("last_modified").alias("last_modified"))
    return _json_again(spark, listed, F.desc_nulls_last("last_modified"), F.asc("project_key"))


@register
def json_sessions(spark, sf):
    listed = chat_listing(spark, sf)[0].select(*KEYS, "summary", "message_count", F.unix_micros("end_time").alias("end_time"))
    return _json_again(spark, listed, F.desc_nulls_last("end_time"), F.asc("project_key"), F.asc(SID))


@register
def json_search(spark, sf):
    found = search.search_sessions(*chat_listing(spark, sf), ["summary", "proj4"])
    hits = found.withColumns({c: F.unix_micros(c) for c in ("project_modified", "end_time")})
    shown = _json_again(spark, hits, *search.hit_order())
    return shown.select("position", "query", "priority", "type", *KEYS, "summary")


@register
def json_documents(spark, sf):
    found = classified(chat_records(spark, sf))
    whole = export.export_transcripts(tree.build_tree(found), messages.build_messages(found), sessions.detail_sessions(found), "txt")
    folder = new_folder(spark)
    sinks.write_documents(whole, folder)
    return spark.read.schema(whole.schema).parquet(folder).select(*KEYS, "file_name", "document")


@register
def annotation_log(spark, sf):
    log, events = new_folder(spark), notes(spark, sf)
    notes_log.append_events(events.where("seq % 3 != 0"), log)
    notes_log.append_events(events, log)
    notes_log.append_events(events, log)
    return _star_rows(annotations.list_stars(annotations.current_stars(notes_log.read_log(spark, log))))


def _compacted(spark, sf) -> DataFrame:
    """The log after appends that overlap, folded in between with and without its history."""
    log, events = new_folder(spark), notes(spark, sf)
    notes_log.append_events(events.where("seq % 3 = 0"), log)
    notes_log.append_events(events.where("seq % 3 < 2"), log)
    notes_log.compact_log(spark, log, history=False)
    notes_log.append_events(events, log)
    notes_log.compact_log(spark, log)
    notes_log.sweep_log(spark, log)
    notes_log.compact_log(spark, log, history=False)
    return notes_log.read_log(spark, log)


@register
def annotation_compacted(spark, sf):
    return _star_rows(annotations.list_stars(annotations.current_stars(_compacted(spark, sf))))


@register
def annotation_compacted_tags(spark, sf):
    return annotations.item_tags(_compacted(spark, sf)).select("item_type", "item_id", "name")


@register
def annotation_rejects(spark, sf):
    log, events = new_folder(spark), notes(spark, sf)
    notes_log.append_events(events, log)
    notes_log.append_events(events.unionByName(events), log)
    both = [notes_log.read_log(spark, log, name).withColumn("part", F.lit(name)) for name in ("events", "rejected")]
    return both[0].unionByName(both[1]).groupBy("part", "action").agg(F.count("*").alias("n_events"))
