"""Search and lookup by tables of queries and requests.

A text is read once, whatever the number of queries. A table that fits a block makes one Aho-Corasick automaton, which a task builds once.
A larger one is looked up by prints (``operators.windows``): a bitmap of fixed size says which windows of a text may be a query, and a join by
equality says which are. So neither the passes over the texts nor the memory of a task grow with the queries; texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.messages import explode_blocks
from threadloom.operators.records import KEYS, once
from threadloom.operators.search import HIT_COLUMNS, first_hit, searchable, top_hits
from threadloom.operators.sessions import discovery_rank, recency_rank, with_project
from threadloom.operators.tree import reachable
from threadloom.operators.windows import Windows, first_windows, slices, windows_of
from threadloom.session import stage

#: Queries and characters that an automaton takes.
BLOCK_QUERIES, BLOCK_CHARS = 50_000, 2 << 20

_BUILT: dict = {}


def _automaton(name: str, queries: list[str]):
    """The automaton of a block, kept by this worker until it meets another block."""
    if name not in _BUILT:
        import ahocorasick

        found = ahocorasick.Automaton()
        for n, q in enumerate(queries):
            found.add_word(q, (n, len(q)))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[name] = found
    return _BUILT[name]


def first_places(automaton, text: str) -> dict[int, int]:
    """Number of every query in the text, with the place of its first character."""
    found: dict[int, int] = {}
    for end, (n, size) in automaton.iter(text):
        found.setdefault(n, end - size + 1)
    return found


def snippet_at(text: str, at: int, size: int, max_len: int) -> str:
    """The text around a hit as ``functions.text.snippet`` cuts it."""
    start, stop = max(at - 20, 0), min(at + size + max_len - 20, len(text))
    return ("..." if start else "") + text[start:stop].replace("\n", " ") + ("..." if stop < len(text) else "")


def folded_queries(queries: DataFrame) -> DataFrame:
    """The different queries in lower case; empty ones find nothing."""
    return queries.select(F.lower("query").alias("query")).where("query <> ''").distinct()


def find_all(
    texts: DataFrame, queries: DataFrame, keys: Sequence[str], folded: str = "folded", shown: str | None = None, max_len: str | None = None,
    block_queries: int = BLOCK_QUERIES, block_chars: int = BLOCK_CHARS, windows: Windows | None = None,
) -> DataFrame:
    """``keys``, ``query`` and ``at`` (place of the first character) of every query that occurs in ``folded``; null texts hold none.

    ``queries`` are in lower case and without repeats. With ``shown`` and ``max_len``, columns of the text as written and of a length,
    a ``snippet`` around the place is added. ``windows`` are those of the queries, for whoever asks them of several texts.
    """
    columns = [*keys, folded, *([shown, max_len] if shown else [])]
    texts = texts.select(*columns).where(F.col(folded).isNotNull())
    schema = texts.select(*keys).schema.add("query", "string").add("at", "long")
    if shown:
        schema = schema.add("snippet", "string")
    windows = windows or windows_of(queries, block_queries, block_chars)
    if windows.few is not None:
        return texts.mapInArrow(_runner(texts, windows.few, list(keys), folded, shown, max_len), schema)
    found = texts.mapInArrow(_window_runner(texts, windows, list(keys), folded, shown, max_len), schema)
    return found.join(windows.queries, "query", "left_semi").select(schema.names)


def _runner(texts: DataFrame, block: list[str], keys: list[str], folded: str, shown: str | None, max_len: str | None):
    name, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shared.value:
            return
        automaton = _automaton(name, shared.value)
        for batch in batches:
            texts_found = (
                [(shared.value[n], place) for n, place in first_places(automaton, text.as_py()).items()] for text in batch.column(folded)
            )
            yield _hits_of(batch, texts_found, keys, shown, max_len)

    return run


def _window_runner(texts: DataFrame, windows: Windows, keys: list[str], folded: str, shown: str | None, max_len: str | None):
    """What the windows of a text may be, a row for each different one; the caller joins them with the queries."""
    shared = texts.sparkSession.sparkContext.broadcast((windows.sizes, windows.bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, folded):
                yield _hits_of(part, first_windows(part.column(folded), *shared.value), keys, shown, max_len)

    return run


def _hits_of(batch: pa.RecordBatch, found: Iterable, keys: list[str], shown: str | None, max_len: str | None) -> pa.RecordBatch:
    row, query, at, cut = [], [], [], []
    for r, hits in enumerate(found):
        written = batch.column(shown)[r].as_py() if shown and hits else None
        for q, place in hits:
            row.append(r)
            query.append(q)
            at.append(place)
            if shown:
                cut.append(snippet_at(written, place, len(q), batch.column(max_len)[r].as_py()))
    made = [pa.array(query, pa.string()), pa.array(at, pa.int64()), *([pa.array(cut, pa.string())] if shown else [])]
    taken = batch.select(keys).take(pa.array(row, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, *made], [*keys, "query", "at", *(["snippet"] if shown else [])])


def content_hits_many(tree: DataFrame, messages: DataFrame, queries: DataFrame, windows: Windows | None = None) -> DataFrame:
    """``search.content_hits`` for a table of folded queries: the first hit per session and query in conversation order."""
    blocks = explode_blocks(messages, "uuid").drop("image_data")
    texts = once(blocks, "body", searchable(blocks)).withColumns(
        {"folded": F.lower("body"), "max_len": F.when(F.col("block_type") == "tool_use", 40).otherwise(60)}
    )
    keys = [*KEYS, "line_no", "uuid", "block_no", "block_type", "tool_name"]
    found = find_all(texts, queries, keys, "folded", "body", "max_len", windows=windows)
    in_call = F.concat(F.lit("["), "tool_name", F.lit("] "), "snippet")
    shown = F.when(F.col("block_type") == "tool_use", in_call).otherwise(F.col("snippet"))
    return (
        found.select(*KEYS, "line_no", "uuid", "block_no", "query", shown.alias("snippet"))
        .join(reachable(tree).select(*KEYS, "line_no", "dfs_pos"), [*KEYS, "line_no"])
        .groupBy(*KEYS, "query").agg(first_hit().alias("h"))
        .select(*KEYS, "query", "h.line_no", F.col("h.uuid").alias("message_id"), "h.snippet")
    )


def search_many(sessions: DataFrame, projects: DataFrame, tree: DataFrame, messages: DataFrame, queries: DataFrame, limit: int = 0) -> DataFrame:
    """``search.search_global`` for a table of queries (column ``query``), any number of them."""
    asked = stage(folded_queries(queries))
    windows = windows_of(asked, BLOCK_QUERIES, BLOCK_CHARS)
    named = with_project(sessions, projects)

    projects = projects.withColumns({"as_key": F.col("project_key"), "as_path": F.lower("full_path")})
    key_hits = find_all(projects, asked, ["project_key"], "as_key", windows=windows).select("project_key", "query")
    same = projects.select("project_key", F.lower("project_key").alias("query")).join(asked, "query").select("project_key", "query")
    path_hits = find_all(projects, asked, ["project_key"], "as_path", windows=windows).where(~F.contains("project_key", "query")).select("project_key", "query")
    hits = key_hits.unionAll(same).distinct().withColumn("priority", F.lit(0)).unionAll(path_hits.withColumn("priority", F.lit(1)))
    none = F.lit(None).cast("string")
    by_project = hits.join(projects, "project_key").select(
        "query", "priority", F.lit("project").alias("type"), "project_key", none.alias("session_id"), F.col("display_name").alias("project"),
        F.col("display_name").alias("summary"), F.when(F.col("priority") == 1, F.col("full_path")).alias("snippet"), none.alias("message_id"),
        F.col("last_modified").alias("project_modified"), F.lit(None).cast("timestamp").alias("end_time"),
    )

    narrow = sessions.select(*KEYS, F.lower("session_id").alias("as_id"), F.lower("summary").alias("as_summary"))
    by_id = find_all(narrow, asked, KEYS, "as_id", windows=windows).where("at = 0").select(*KEYS, "query", F.lit(0).alias("priority"))
    by_summary = find_all(narrow, asked, KEYS, "as_summary", windows=windows).where(~F.lower("session_id").startswith(F.col("query")))
    session_hits = by_id.unionAll(by_summary.select(*KEYS, "query", F.lit(2).alias("priority"))).join(named, KEYS)
    by_session = session_hits.select(
        "query", "priority", F.lit("session").alias("type"), *KEYS, F.col("display_name").alias("project"), "summary", none.alias("snippet"),
        none.alias("message_id"), "project_modified", "end_time",
    )

    other = ~F.lower("session_id").startswith(F.col("query")) & ~F.contains(F.lower("summary"), F.col("query"))
    by_content = content_hits_many(tree, messages, asked, windows).join(named, KEYS).where(other).select(
        "query", F.lit(3).alias("priority"), F.lit("message").alias("type"), *KEYS, F.col("display_name").alias("project"), "summary",
        "snippet", "message_id", "project_modified", "end_time",
    )
    return top_hits(by_project.unionByName(by_session).unionByName(by_content).select(*HIT_COLUMNS), limit)


def find_projects_many(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """``sessions.find_projects`` for a table of requests (column ``request``)."""
    asked = requests.select("request").distinct().withColumn("query", F.lower("request"))
    folded = stage(asked.select("query").where("query <> ''").distinct())
    named = projects.withColumn("folded", F.lower("display_name"))
    by_name = find_all(named, folded, ["project_key"]).select("project_key", "query")
    by_key = projects.select("project_key", F.lower("project_key").alias("query")).join(folded, "query").select("project_key", "query")
    hits = by_name.unionAll(by_key).join(projects.select("project_key", "last_modified"), "project_key")
    best = hits.groupBy("query").agg(F.min(recency_rank()).alias("first"))
    # An empty request stands for any project.
    newest = projects.agg(F.min(recency_rank()).alias("first")).where("first is not null").select(F.lit("").alias("query"), "first")
    first = best.unionAll(newest).select("query", F.col("first.project_key").alias("project_key"))
    return asked.join(first, "query").join(projects, "project_key").select("request", *projects.columns)


def find_sessions_many(sessions: DataFrame, projects: DataFrame, requests: DataFrame) -> DataFrame:
    """``sessions.find_sessions`` for a table of requests (column ``request``).

    A request is the start of an id, so each session is looked up under the starts of its id that have the length of some request: an
    equality join of as many rows as there are lengths. The first session of every start is found before the join, in the tasks
    first, so a start that many sessions share costs a row per task.
    """
    colon = F.instr("request", ":")
    asked = requests.select("request").distinct().select(
        "request", F.when(colon > 0, F.substring_index("request", ":", 1)).otherwise("").alias("named"),
        F.when(colon > 0, F.expr("substring(request, instr(request, ':') + 1)")).otherwise(F.col("request")).alias("prefix"),
    )
    asked = stage(asked)
    chosen = find_projects_many(projects, asked.where("named <> ''").select(F.col("named").alias("request")))
    chosen = chosen.select(F.col("request").alias("named"), F.col("project_key").alias("within"))
    ranked = with_project(sessions, projects).select(discovery_rank().alias("rank"), *KEYS)
    longest = sessions.agg(F.coalesce(F.max(F.length("session_id")), F.lit(0))).first()[0]
    sizes = sorted(r.n for r in asked.select(F.length("prefix").alias("n")).where(F.col("n") <= longest).distinct().collect())  # at most one per character of an id
    if not sizes:
        return sessions.limit(0).select(F.lit("").alias("request"), *sessions.columns)
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("session_id"))
    starts = ranked.withColumn("size", F.explode(fitting)).withColumn("prefix", F.expr("left(session_id, size)"))

    def first_of(wanted: DataFrame, *by: str) -> DataFrame:
        near = starts.withColumn("within", F.col("project_key")).join(wanted.select(*by).distinct(), [*by], "left_semi")
        first = near.groupBy(*by).agg(F.min(F.struct("rank", *KEYS)).alias("first"))
        return wanted.join(first, [*by]).select("request", *(F.col(f"first.{k}").alias(k) for k in KEYS))

    anywhere = first_of(asked.where("named = ''").select("request", "prefix"), "prefix")
    inside = first_of(asked.where("named <> ''").join(chosen, "named").select("request", "within", "prefix"), "within", "prefix")
    return anywhere.unionAll(inside).join(sessions, KEYS).select("request", *sessions.columns)
