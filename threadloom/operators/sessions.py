"""Session and project tables: two reader profiles, listing, lookup.

All aggregates are sums, counts and min_by/max_by, which Spark combines before
the shuffle, so one huge session costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import paths, text
from threadloom.functions.variants import array_of, is_object
from threadloom.operators.messages import (
    classify, content_items, first_text, is_conversational, item_type, joined_text, tool_call_count,
)
from threadloom.operators.records import KEYS, odd_keys

NO_SUMMARY = "(no summary)"
METADATA = ("slug", "version", "git_branch", "cwd")
STATS = (
    "message_count", "user_prompts", "tool_calls", "continuations", "agent_sidechains",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens",
)


def first_by_line(value: Column, when: Column | None = None) -> Column:
    """First non-NULL value in file order (optionally only where ``when`` holds)."""
    kept = value if when is None else F.when(when, value)
    return F.min_by(kept, F.when(kept.isNotNull(), F.col("line_no")))


def last_by_line(value: Column, when: Column | None = None) -> Column:
    kept = value if when is None else F.when(when, value)
    return F.max_by(kept, F.when(kept.isNotNull(), F.col("line_no")))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def token_sums() -> dict[str, Column]:
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens")
    return {n: _sum(F.col(n)) for n in names}


def metadata_picks() -> dict[str, Column]:
    """First non-empty value of each metadata field, each on its own."""
    return {n: first_by_line(F.col(n)) for n in METADATA}


def detail_sessions(records: DataFrame) -> DataFrame:
    """One row per session as the detail reader sees it, in one pass over the records."""
    talk = F.col("talk")
    prompt = talk & (F.col("kind") == "user_prompt")
    per_line = classify(records.withColumn("talk", is_conversational())).withColumns(
        {
            "calls": F.when(talk, tool_call_count(F.col("items"))),
            # Only the first line is carried on; a first text of blanks counts, as an empty line.
            "prompt_line": text.first_line(F.when(prompt, text.none_if_empty(first_text(F.col("items"))))),
            "talk_line": F.when(talk, F.col("line_no")),
            "summary_line": F.when(F.col("type") == "summary", text.none_if_empty(text.trim_all(F.col("summary_text")))),
        }
    ).drop("items", "content")
    agg = per_line.groupBy(*KEYS).agg(
        F.count_if(prompt | (talk & (F.col("kind") == "assistant"))).alias("message_count"),
        F.count_if(prompt).alias("user_prompts"),
        _sum(F.col("calls")).alias("tool_calls"),
        F.count_if(talk & F.col("is_compacted")).alias("continuations"),
        F.count_if(talk & F.col("is_sidechain")).alias("agent_sidechains"),
        F.min_by(F.struct("ts", "ts_raw"), "talk_line").alias("first"),
        F.max_by(F.struct("ts", "ts_raw"), "talk_line").alias("last"),
        first_by_line(F.col("prompt_line")).alias("prompt_line"),
        first_by_line(F.col("summary_line")).alias("summary_line"),
        *[c.alias(n) for n, c in {**token_sums(), **metadata_picks()}.items()],
    )
    seconds = (F.unix_micros("last.ts") - F.unix_micros("first.ts")) / F.lit(1e6)
    return agg.select(
        *KEYS,
        F.coalesce("summary_line", "prompt_line", F.lit(NO_SUMMARY)).alias("summary"),
        F.col("first.ts").alias("start_time"),
        F.col("last.ts").alias("end_time"),
        F.col("first.ts_raw").alias("start_raw"),
        *METADATA,
        *STATS,
        F.coalesce(seconds, F.lit(0.0)).alias("duration_seconds"),
    )


def listing_sessions(records: DataFrame) -> DataFrame:
    """One row per session as the listing reader sees it."""
    user = F.coalesce(F.col("type") == "user", F.lit(False))
    first_raw = F.get(array_of(F.col("content")), F.lit(0))
    is_result = F.coalesce(is_object(first_raw) & (item_type(first_raw) == "tool_result"), F.lit(False))
    prompt = user & ~F.col("is_compacted") & ~F.col("is_meta") & ~F.col("is_result")
    items = F.col("items")
    per_line = (
        records.withColumn("is_result", is_result)
        .withColumn("items", content_items(F.col("content")))
        .withColumn("said", F.when(user & ~F.col("is_compacted"), joined_text(items)))
        .withColumn("calls", F.when(is_conversational(), tool_call_count(items)))
        .withColumn("said_line", F.when((F.col("said") != "") & ~F.col("said").startswith("<"), text.head_line(F.col("said"))))
        .drop("content", "items", "said")
    )
    listed_summary = last_by_line(F.col("summary_text"), F.col("type") == "summary")
    agg = per_line.groupBy(*KEYS).agg(
        F.count_if(prompt | (F.col("type") == "assistant")).alias("message_count"),
        F.count_if(prompt).alias("user_prompts"),
        _sum(F.col("calls")).alias("tool_calls"),
        F.count_if("is_compacted").alias("continuations"),
        F.count_if("is_sidechain").alias("agent_sidechains"),
        *[c.alias(n) for n, c in {**token_sums(), **metadata_picks()}.items()],
        first_by_line(F.col("ts")).alias("start_time"),
        first_by_line(F.col("ts_raw"), F.col("ts").isNotNull()).alias("start_raw"),
        last_by_line(F.col("ts")).alias("end_time"),
        listed_summary.alias("listed"),
        first_by_line(F.col("said_line")).alias("said_line"),
    )
    return agg.select(
        *KEYS,
        F.coalesce("listed", "said_line", F.lit(NO_SUMMARY)).alias("summary"),
        "start_time", "end_time", "start_raw", *METADATA, *STATS,
        F.lit(0.0).alias("duration_seconds"),
    )


def session_table(records: DataFrame, profile: str = "detail") -> DataFrame:
    if profile not in ("detail", "listing"):
        raise ValueError(f"unknown profile: {profile}")
    return detail_sessions(records) if profile == "detail" else listing_sessions(records)


def listable(sessions: DataFrame) -> DataFrame:
    """Sessions a listing shows: with a summary, and not a warm-up."""
    return sessions.where((F.col("summary") != NO_SUMMARY) & (F.lower("summary") != "warmup"))


def project_table(sessions: DataFrame) -> DataFrame:
    """Projects with at least one listed session; most recent session end as last change."""
    return (
        sessions.groupBy("project_key")
        .agg(F.count("*").alias("n_sessions"), F.max("end_time").alias("last_modified"))
        .withColumn("display_name", paths.display_name(F.col("project_key")))
        .withColumn("full_path", paths.decode_path(F.col("project_key")))
    )


PROJECT_ORDERS = ("time", "name", "sessions")


def _project_order(by: str) -> list[Column]:
    if by not in PROJECT_ORDERS:
        raise ValueError(f"unknown project order: {by}")
    key = F.col("project_key").asc()
    return {
        "time": [F.col("last_modified").desc_nulls_last(), key],
        "name": [F.col("display_name").asc(), key],
        "sessions": [F.col("n_sessions").desc(), key],
    }[by]


def limited(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows, 0 meaning all."""
    return df.limit(n) if n > 0 else df


def list_projects(projects: DataFrame, by: str = "time", limit: int = 0, name_contains: str = "") -> DataFrame:
    found = projects.where(text.contains_folded(F.col("display_name"), name_contains)) if name_contains else projects
    return limited(found.orderBy(*_project_order(by)), limit)


SESSION_ORDERS = ("time", "messages")


def list_sessions(sessions: DataFrame, by: str = "time", limit: int = 0, contains: str = "") -> DataFrame:
    """Sessions newest first, or by message count; optional text in summary or id."""
    if by not in SESSION_ORDERS:
        raise ValueError(f"unknown session order: {by}")
    lead = F.col("end_time").desc_nulls_last() if by == "time" else F.col("message_count").desc()
    found = sessions
    if contains:
        hit = text.contains_folded(F.col("summary"), contains) | text.contains_folded(F.col("session_id"), contains)
        found = sessions.where(hit)
    return limited(found.orderBy(lead, "project_key", "session_id"), limit)


def with_project(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Sessions with the name and recency of their project."""
    cols = projects.select("project_key", "display_name", "full_path", F.col("last_modified").alias("project_modified"))
    return sessions.join(cols, "project_key")


def discovery_order() -> list[Column]:
    """Projects by recency, inside them sessions by recency; ids break ties."""
    return [
        F.col("project_modified").desc_nulls_last(), F.col("project_key").asc(),
        F.col("end_time").desc_nulls_last(), F.col("session_id").asc(),
    ]


def _newest(c: str) -> Column:
    return -F.coalesce(F.unix_micros(c), F.lit(-(1 << 62)))


def recency_rank() -> Column:
    """The recency order of projects as one comparable value, smallest first."""
    return F.struct(_newest("last_modified"), "project_key")


def discovery_rank() -> Column:
    """The discovery order as one comparable value, smallest first."""
    return F.struct(_newest("project_modified"), "project_key", _newest("end_time"), "session_id")


def recent_sessions(sessions: DataFrame, projects: DataFrame, limit: int = 20) -> DataFrame:
    return limited(with_project(sessions, projects).orderBy(*discovery_order()), limit)


def recent_index(sessions: DataFrame, projects: DataFrame, size: int = 10) -> DataFrame:
    """The ``@1`` ... ``@size`` shortcuts: a top-k of the discovery order, numbered."""
    if size <= 0:
        raise ValueError("an index needs a size; number_in_order numbers a whole listing")
    top = recent_sessions(sessions, projects, size)
    numbered = F.row_number().over(Window.orderBy(*discovery_order()))  # at most ``size`` rows
    return top.withColumn("position", numbered.cast("bigint"))


def _hits(matchers: Sequence[Column]) -> Column:
    """Positions of the matchers that hold for a row."""
    marks = F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(matchers)])
    return F.explode(F.array_compact(marks))


def find_projects(projects: DataFrame, names: Sequence[str]) -> DataFrame:
    """First project in recency order per requested name.

    A project answers by exact display name or key, or by a name that contains
    the request; a newer partial hit beats an older exact one.
    """
    def answers(name: str) -> Column:
        folded = name.lower()
        return (F.lower("project_key") == folded) | text.contains_folded(F.col("display_name"), folded)

    asked = F.get(F.array(*[F.lit(n) for n in names]), F.col("request_no"))
    return (
        projects.withColumn("request_no", _hits([answers(n) for n in names]))
        .groupBy("request_no")
        .agg(F.min_by(F.struct(*projects.columns), recency_rank()).alias("p"))
        .select(asked.alias("request"), "p.*")
    )


def split_request(request: str) -> tuple[str, str]:
    """``project:session`` at the first colon; no colon means any project."""
    project, colon, session = request.partition(":")
    return (project, session) if colon else ("", request)


def find_sessions(sessions: DataFrame, projects: DataFrame, requests: Sequence[str]) -> DataFrame:
    """First session in discovery order per request (id or id prefix, ``project:`` optional)."""
    split = [split_request(r) for r in requests]
    named = sorted({p for p, _ in split if p})
    joined = with_project(sessions, projects)
    if named:
        # One row per requested project name, as many as the caller typed.
        chosen = find_projects(projects, named).groupBy("project_key").agg(F.collect_set("request").alias("asked_as"))
        joined = joined.join(chosen, "project_key", "left")
    else:
        joined = joined.withColumn("asked_as", F.lit(None).cast("array<string>"))

    def answers(project: str, prefix: str) -> Column:
        by_id = F.col("session_id").startswith(prefix)
        return by_id & F.array_contains("asked_as", project) if project else by_id

    asked = F.get(F.array(*[F.lit(r) for r in requests]), F.col("request_no"))
    return (
        joined.withColumn("request_no", _hits([answers(p, s) for p, s in split]))
        .groupBy("request_no")
        .agg(F.min_by(F.struct(*sessions.columns), discovery_rank()).alias("s"))
        .select(asked.alias("request"), "s.*")
    )


def global_counts(sessions: DataFrame) -> DataFrame:
    """Projects and sessions in all. Two small steps instead of a global distinct."""
    per_project = sessions.groupBy("project_key").agg(F.count("*").alias("n"))
    return per_project.agg(F.count("*").alias("projects"), _sum(F.col("n")).alias("sessions"))


def ingest_audit(parsed: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of counts over an ingest: lines, bad lines, sessions, projects, what the listing drops."""
    lines = parsed.agg(
        F.count("*").alias("lines"),
        F.count_if(~F.col("parse_ok")).alias("bad_lines"),
        F.count_if("oversize").alias("oversize_lines"),
        F.count_if(F.col("parse_ok") & (F.size(odd_keys(F.col("rec"))) > 0)).alias("odd_case_lines"),
    )
    per_project = sessions.groupBy("project_key").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("summary") == NO_SUMMARY) | (F.lower("summary") == "warmup")).alias("dropped"),
    )
    tables = per_project.agg(
        F.count("*").alias("projects_found"),
        F.count_if(F.col("n") == F.col("dropped")).alias("empty_projects"),
        _sum(F.col("n")).alias("sessions_found"),
        _sum(F.col("dropped")).alias("sessions_dropped"),
    )
    # Two single rows, put side by side by a sum over their union.
    both = lines.unionByName(tables, allowMissingColumns=True)
    return both.agg(*[_sum(F.col(c)).alias(c) for c in both.columns])
