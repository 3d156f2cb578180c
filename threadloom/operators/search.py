"""Ranked search over projects, sessions and message content.

Queries are a short list given by the caller. Each row is tested against the
list in place and only its hits are exploded; nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.tools import tool_preview
from threadloom.functions.variants import child, show_value, text_at
from threadloom.operators.messages import explode_blocks, item_type, texts_of
from threadloom.operators.records import KEYS, explode_once, once
from threadloom.operators.sessions import with_project
from threadloom.operators.tree import reachable
from threadloom.session import stage

HIT_COLUMNS = ["query", "priority", "type", *KEYS, "project", "summary", "snippet", "message_id", "project_modified", "end_time"]


def _blank(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def _hits(queries: Sequence[str], *ranks) -> Column:
    """Array of ``(query, priority)`` of the queries a row answers, by each of the ranks."""
    made = [
        F.when(priority.isNotNull(), F.struct(F.lit(q).alias("query"), priority.alias("priority")))
        for q in queries
        for priority in (rank(q) for rank in ranks)
    ]
    return F.array_compact(F.array(*made))


def _project_hits(projects: DataFrame, queries: Sequence[str], ranks, summary: Column, snippet: Column) -> DataFrame:
    return explode_once(projects, "hit", _hits(queries, *ranks)).select(
        "hit.query", "hit.priority", F.lit("project").alias("type"), "project_key", _blank("session_id"),
        F.col("display_name").alias("project"), summary.alias("summary"), snippet.alias("snippet"), _blank("message_id"),
        F.col("last_modified").alias("project_modified"), _blank("end_time", "timestamp"),
    )


def _session_hits(named_sessions: DataFrame, queries: Sequence[str]) -> DataFrame:
    return explode_once(named_sessions, "hit", _hits(queries, _session_rank)).select(
        "hit.query", "hit.priority", F.lit("session").alias("type"), *KEYS, F.col("display_name").alias("project"),
        "summary", _blank("snippet"), _blank("message_id"), "project_modified", "end_time",
    )


def hit_order() -> list[Column]:
    """Priority, then discovery order; a project comes before its sessions."""
    return [
        F.col("query").asc(), F.col("priority").asc(), F.col("project_modified").desc_nulls_last(), F.col("project_key").asc(),
        (F.col("type") != "project").asc(), F.col("end_time").desc_nulls_last(), F.col("session_id").asc_nulls_first(),
    ]


def _session_rank(q: str) -> Column:
    by_id = F.lower("session_id").startswith(q)
    by_summary = text.contains_folded(F.col("summary"), q)
    return F.when(by_id, 0).when(by_summary, 2)


def search_sessions(
    sessions: DataFrame, projects: DataFrame, queries: Sequence[str], only: str | None = None, limit: int = 0
) -> DataFrame:
    """Metadata search: session id prefix (0), project key, path or name (1), summary (2).

    ``only`` keeps ``project`` or ``session`` results; ``limit`` is per query, 0 meaning all.
    """
    queries = [q.lower() for q in queries]

    def project_rank(q: str) -> Column:
        named = [text.contains_folded(F.col(c), q) for c in ("project_key", "full_path", "display_name")]
        return F.when(named[0] | named[1] | named[2], 1)

    branches = []
    if only != "session":
        branches.append(_project_hits(projects, queries, [project_rank], F.col("full_path"), _blank("snippet")))
    if only != "project":
        branches.append(_session_hits(with_project(sessions, projects), queries))
    found = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
    return top_hits(found, limit)


def top_hits(found: DataFrame, limit: int) -> DataFrame:
    """Hits by query and rank, the first ``limit`` of each query (0: all). Ranks are cut per task before the shuffle."""
    if limit > 0:
        best = Window.partitionBy("query").orderBy(*hit_order())
        found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit).drop("nth")
    return found.orderBy(*hit_order())


def searchable(blocks: DataFrame) -> Column:
    """Text a block is searched by: its text, tool input as JSON, or result. Thinking is not searched."""
    kind = F.col("block_type")
    return (
        F.when(kind == "text", F.col("text"))
        .when(kind == "tool_use", F.coalesce(F.to_json("tool_input"), F.lit("null")))
        .when(kind == "tool_result", show_value(F.col("tool_result")))
    )


def first_hit() -> Column:
    """The hit of a session that comes first in the conversation."""
    return F.min_by(F.struct("uuid", "line_no", "snippet"), F.struct("dfs_pos", "block_no"))


def content_hits(tree: DataFrame, messages: DataFrame, queries: Sequence[str]) -> DataFrame:
    """First content hit per session and query in conversation order, with a snippet.

    Only messages with a hit are joined with the tree index.
    """
    queries = [q.lower() for q in queries]
    blocks = explode_blocks(messages, "uuid").drop("image_data")
    folded, query = F.lower("body"), F.col("query")
    answered = F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(q)), F.lit(q)) for q in queries]))
    found = explode_once(once(blocks, "body", searchable(blocks)), "query", answered)
    in_call = F.concat(F.lit("["), "tool_name", F.lit("] "), text.snippet(F.col("body"), query, 40))
    shown = F.when(F.col("block_type") == "tool_use", in_call).otherwise(text.snippet(F.col("body"), query, 60))
    return (
        found.select(*KEYS, "line_no", "uuid", "block_no", "query", shown.alias("snippet"))
        .join(reachable(tree).select(*KEYS, "line_no", "dfs_pos"), [*KEYS, "line_no"])
        .groupBy(*KEYS, "query")
        .agg(first_hit().alias("h"))
        .select(*KEYS, "query", F.col("h.line_no").alias("line_no"), F.col("h.uuid").alias("message_id"), F.col("h.snippet").alias("snippet"))
    )


def search_global(
    sessions: DataFrame, projects: DataFrame, tree: DataFrame, messages: DataFrame, queries: Sequence[str],
    limit: int = 0,
) -> DataFrame:
    """Search with content: project key (0) or path (1), session id (0), summary (2), content (3).

    A session answers a query once, by its best branch. All content is ranked
    before the limit, so the answer does not depend on scan order. An empty
    query finds nothing.
    """
    wanted = [q.lower() for q in queries if q]
    queries = wanted or ["-"]

    key, path = F.col("project_key"), F.col("full_path")

    def key_rank(q: str) -> Column:
        return F.when(F.contains(key, F.lit(q)) | (F.lower(key) == q), 0)

    def path_rank(q: str) -> Column:
        # A key equal to the query but for case answers by its path as well.
        return F.when(text.contains_folded(path, q) & ~F.contains(key, F.lit(q)), 1)

    by_path = F.when(F.col("hit.priority") == 1, F.col("full_path"))
    named = with_project(sessions, projects)
    by_metadata = _session_hits(named, queries)
    by_content = (
        content_hits(tree, messages, queries)
        .join(named, KEYS)
        .where(
            ~F.lower("session_id").startswith(F.col("query")) & ~F.contains(F.lower("summary"), F.col("query"))
        )
        .select(
            "query", F.lit(3).alias("priority"), F.lit("message").alias("type"), *KEYS, F.col("display_name").alias("project"),
            "summary", "snippet", "message_id", "project_modified", "end_time",
        )
    )
    found = _project_hits(projects, queries, [key_rank, path_rank], F.col("display_name"), by_path).unionByName(by_metadata).unionByName(by_content)
    return top_hits(found if wanted else found.limit(0), limit)


FACETS = ("user", "response", "thinking", "tool", "agent")


def faceted_search(tree: DataFrame, messages: DataFrame, query: str, facets: Sequence[str] = FACETS) -> DataFrame:
    """Search inside sessions by facet, scored; queries under two characters find nothing.

    User messages score 50 more than responses; tool calls and sub-agents
    have a fixed score. Every shown message that is no user prompt is a
    response, and is searched without its thinking. One pass over the messages
    gives a row per message (``block_no`` -1) and per content item.
    """
    unknown = set(facets) - set(FACETS)
    if unknown:
        raise ValueError(f"unknown facets: {sorted(unknown)}")
    q = query.strip().lower()
    said = F.when(F.col("is_command"), F.concat_ws("\n", "command_name", "command_args")).otherwise(
        F.array_join(texts_of(F.col("items")), "\n")
    )
    item, kind = F.col("item"), F.col("kind")
    is_item = F.col("block_no") >= 0
    units = (
        once(messages, "said", said)
        .select(
            *KEYS, "line_no", "kind", "said",
            F.posexplode(F.concat(F.array(F.lit(None).cast("variant")), "items")).alias("unit_no", "item"),
        )
        .withColumn("block_no", F.col("unit_no").cast("bigint") - 1)
        .withColumn("item_type", F.when(is_item, item_type(item)))
        .where(~is_item | F.col("item_type").isin("thinking", "tool_use"))
    )
    name = F.coalesce(text_at(item, "$.name"), F.lit(""))
    is_call = F.col("item_type") == "tool_use"
    called = F.when(is_call, F.concat_ws(" ", name, tool_preview(name, child(item, "$.input"))))
    prose = F.when(~is_item, F.col("said")).when(F.col("item_type") == "thinking", text_at(item, "$.thinking"))
    units = once(units, "called", called)
    units = once(units, "agent", F.when(F.contains("called", F.lit("Task")), F.regexp_extract("called", r"\[([^\]]+)\]", 1)))
    units = once(units, "relevance", text.relevance(prose, query)).drop("said", "item")
    relevance, hit = F.col("relevance"), F.col("relevance") > 0
    rules = {
        "user": (~is_item & (kind == "user_prompt") & hit, relevance + 50),
        "response": (~is_item & ~kind.isin("user_prompt", "tool_result") & hit, relevance),
        "thinking": ((F.col("item_type") == "thinking") & hit, relevance),
        "tool": (text.contains_folded(F.col("called"), q), F.lit(20.0)),
        "agent": (text.contains_folded(F.col("agent"), q), F.lit(25.0)),
    }
    hits = [
        F.when(rules[f][0] & F.lit(len(q) >= 2), F.struct(F.lit(f).alias("type"), rules[f][1].alias("score"))) for f in facets
    ]
    found = (
        explode_once(units, "hit", F.array_compact(F.array(*hits)))
        .select(F.lit(query).alias("query"), *KEYS, "line_no", "block_no", "hit.*")
        .join(reachable(tree).select(*KEYS, "line_no"), [*KEYS, "line_no"], "left_semi")
        .select("query", "type", *KEYS, "line_no", "block_no", "score")
    )
    # A global sort samples its input first; the hits are few, so they are written once.
    return stage(found).orderBy(F.col("score").desc(), *KEYS, "line_no", "block_no", "type")
