"""Ordered views of a conversation: threads, sections, chunks, tail, navigation.

All of them run along the depth-first position with segmented scans, so a very
long session is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.functions.tools import tool_preview
from threadloom.functions.variants import child, text_at
from threadloom.operators.messages import first_text, item_type
from threadloom.operators.records import KEYS, once
from threadloom.operators.scans import running
from threadloom.operators.tree import reachable, with_content
from threadloom.session import stage

# Fixed values of the long-session view.
TAIL_SECTIONS = 3
CHUNK_SIZE = 50
NAV_CHILDREN = 10
NAV_OPEN_GROUPS = 3
# Chunk sizes of positions folded in one row when chunking; see chunk_starts.
CHUNKS_PER_SPAN = 1024
# Segments chained in one row before the blocks of them are.
SEGMENTS_PER_BLOCK = 512


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _flag(c: Column) -> Column:
    return c.cast("bigint")


def threads(tree: DataFrame) -> DataFrame:
    """Messages of the thread view, without standalone tool results.

    A prompt or command opens a thread; what comes before the first one is
    thread 0. ``level`` is 0 for the opener and for thread 0, 2 for
    sidechains, else 1.
    """
    shown = reachable(tree).where(~_is("tool_result"))
    opener = _is("user_prompt", "command")
    out = running(shown, KEYS, "dfs_pos", {"thread_no": ("sum", _flag(opener))})
    level = F.when(opener | (F.col("thread_no") == 0), 0).when(F.col("is_sidechain"), 2).otherwise(1)
    return out.withColumn("level", level)


def _opens_section() -> Column:
    return _flag(_is("compact_summary") & (F.col("dfs_pos") > 0))


def sections(tree: DataFrame) -> DataFrame:
    """Add ``section_no``: a new section starts at every compact summary, the first is 0."""
    return running(reachable(tree), KEYS, "dfs_pos", {"section_no": ("sum", _opens_section())})


def _fold_starts(prompts: Column, start: Column, size: int) -> Column:
    """Chunk starts after ``start``: a prompt opens a chunk once the open one holds ``size`` messages."""
    seed = F.struct(start.cast("bigint").alias("open"), F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(
        prompts,
        seed,
        lambda acc, p: F.when(
            p - acc["open"] >= size,
            F.struct(p.alias("open"), F.concat(acc["starts"], F.array(p)).alias("starts")),
        ).otherwise(acc),
        lambda acc: acc["starts"],
    )


def _fold_open(prompts: Column, start: Column, size: int) -> Column:
    """Start of the chunk still open after all prompts."""
    return F.aggregate(prompts, start.cast("bigint"), lambda at, p: F.when(p - at >= size, p).otherwise(at))


def _chain_state(held: Column, next_seg: Column) -> Column:
    """How many messages the open chunk holds, and the segment it holds them at the start of."""
    return F.struct(held.cast("bigint").alias("held"), next_seg.cast("bigint").alias("next_seg"))


def _entering(state: Column, link: Column, size: int) -> Column:
    return F.when(link["first_seg"] == state["next_seg"], state["held"]).otherwise(F.lit(size)).cast("bigint")


def _passed(state: Column, link: Column, size: int) -> Column:
    return _chain_state(F.get(link["held_after"], _entering(state, link, size).cast("int")), link["next_seg"])


def _through(chain: str, start: Column, size: int) -> Column:
    """The state after all links of a chain, each with a table of what is held after it for every number held before."""
    return F.aggregate(chain, start, lambda state, link: _passed(state, link, size))


def _states(chain: str, start: Column, size: int) -> Column:
    """Per link its first segment, the one that follows, and what is held before and after."""
    seed = F.struct(start.alias("state"), F.array().cast("array<struct<first_seg:bigint,next_seg:bigint,before:bigint,after:bigint>>").alias("out"))

    def step(acc: Column, link: Column) -> Column:
        now = _passed(acc["state"], link, size)
        row = F.struct(
            link["first_seg"].alias("first_seg"), link["next_seg"].alias("next_seg"),
            _entering(acc["state"], link, size).alias("before"), now["held"].alias("after"),
        )
        return F.struct(now.alias("state"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(chain, seed, step, lambda acc: acc["out"])


def chunk_starts(tree: DataFrame, size: int = CHUNK_SIZE, span: int | None = None) -> DataFrame:
    """Positions that open a chunk: a prompt does once the open chunk holds ``size`` messages.

    Greedy and sequential, so it folds over prompt positions, in segments of
    ``span`` positions, so that a fold makes a bounded number of starts. A segment only depends on how many messages the chunk
    open at its start holds, and any number from ``size`` up acts alike. So
    every segment of a longer session first works out its result for each of
    the ``size + 1`` cases; chaining these short tables gives each segment its
    true case. Sessions of one segment skip that step.
    """
    span = span or size * CHUNKS_PER_SPAN
    if span < size:
        raise ValueError("a segment must be longer than a chunk")
    prompts = (
        reachable(tree).where(_is("user_prompt"))
        .withColumn("seg", F.floor(F.col("dfs_pos") / F.lit(span)))
        .groupBy(*KEYS, "seg")
        .agg(F.array_sort(F.collect_list("dfs_pos")).alias("prompts"))
    )
    seg_start, seg_stop = F.col("seg") * span, (F.col("seg") + 1) * span
    last_seg = Window.partitionBy(*KEYS)
    # Later segments carry on from earlier ones; the tables of cases exist only
    # for segments that have a successor.
    cases = (
        prompts.withColumn("last_seg", F.max("seg").over(last_seg))
        .where("last_seg > 0 and seg < last_seg")
        .select(
            *KEYS, "seg",
            F.transform(
                F.sequence(F.lit(0), F.lit(size)),
                lambda held: F.least(seg_stop - _fold_open(F.col("prompts"), seg_start - held, size), F.lit(size)),
            ).alias("held_after"),
        )
    )
    # A gap of whole segments without a prompt leaves the chunk full. The chain
    # walks the segments that have prompts, in order: blocks of them first, each for all cases, then the blocks, then inside the blocks.
    # An array a step grows by is copied at every step, so none holds more than the segments of a block, or the blocks.
    one = [F.col("seg").alias("first_seg"), (F.col("seg") + 1).alias("next_seg"), "held_after"]
    blocks = (
        cases.groupBy(*KEYS, F.floor(F.col("seg") / F.lit(SEGMENTS_PER_BLOCK)).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(*one))).alias("chain"))
        .withColumns({"first_seg": F.col("chain")[0]["first_seg"], "next_seg": F.element_at("chain", -1)["next_seg"]})
        .withColumn(
            "held_after",
            F.transform(F.sequence(F.lit(0), F.lit(size)), lambda held: _through("chain", _chain_state(held, F.col("first_seg")), size)["held"]),
        )
    )
    chained = blocks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("first_seg", "next_seg", "held_after"))).alias("chain"))
    start = _chain_state(F.lit(0), F.lit(0))
    into = chained.select(*KEYS, F.explode(_states("chain", start, size)).alias("e")).select(
        *KEYS, F.floor(F.col("e.first_seg") / F.lit(SEGMENTS_PER_BLOCK)).alias("block"), F.col("e.before").alias("held_before")
    )
    entries = (
        blocks.select(*KEYS, "block", "chain", "first_seg").join(into, [*KEYS, "block"])
        .select(*KEYS, F.explode(_states("chain", _chain_state(F.col("held_before"), F.col("first_seg")), size)).alias("e"))
        .select(*KEYS, F.col("e.next_seg").alias("seg"), F.col("e.after").alias("held"))
    )
    held = F.when(F.col("seg") == 0, F.lit(0)).otherwise(F.coalesce("held", F.lit(size)))
    return prompts.join(entries, [*KEYS, "seg"], "left").select(
        *KEYS, F.explode(_fold_starts(F.col("prompts"), seg_start - held, size)).alias("dfs_pos")
    )


def _with_chunk_starts(tree: DataFrame, size: int, span: int | None) -> DataFrame:
    starts = chunk_starts(tree, size, span).withColumn("opens_chunk", F.lit(1).cast("bigint"))
    return stage(reachable(tree).join(starts, [*KEYS, "dfs_pos"], "left"))


def prompt_chunks(tree: DataFrame, size: int = CHUNK_SIZE, span: int | None = None) -> DataFrame:
    """Add ``chunk_no``, the number of the greedy chunk a message is in."""
    marked = _with_chunk_starts(tree, size, span)
    return running(marked, KEYS, "dfs_pos", {"chunk_no": ("sum", F.coalesce("opens_chunk", F.lit(0)))}).drop("opens_chunk")


def tail_view(
    tree: DataFrame, keep: int = TAIL_SECTIONS, threshold: int | None = None, chunk_size: int = CHUNK_SIZE
) -> DataFrame:
    """Add ``part_no`` and ``shown`` with the hidden counts per session.

    Sessions are parted
    at compact summaries, or in chunks where there is none; the last ``keep``
    parts are shown. With a ``threshold`` sessions up to so many messages stay whole.
    """
    marked = _with_chunk_starts(tree, chunk_size, None)
    parted = running(
        marked, KEYS, "dfs_pos",
        {"section_no": ("sum", _opens_section()), "chunk_no": ("sum", F.coalesce("opens_chunk", F.lit(0)))},
    ).drop("opens_chunk")
    # The numbers of the last sections and chunks are counts of their openings.
    totals = marked.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.sum(_opens_section()).alias("max_section"),
        F.coalesce(F.sum("opens_chunk"), F.lit(0)).alias("max_chunk"),
    )
    whole = F.lit(False) if threshold is None else F.col("n") <= threshold
    part = F.when(whole, F.lit(0)).when(F.col("max_section") > 0, F.col("section_no")).otherwise(F.col("chunk_no"))
    n_parts = F.when(whole, F.lit(0)).when(F.col("max_section") > 0, F.col("max_section")).otherwise(F.col("max_chunk")) + 1
    return (
        parted.join(totals, KEYS)
        .withColumn("part_no", part.cast("bigint"))
        .withColumn("hidden_parts", F.greatest(n_parts - keep, F.lit(0)).cast("bigint"))
        .withColumn("shown", F.col("part_no") >= F.col("hidden_parts"))
        .drop("n", "max_section", "max_chunk")
    )


def hidden_counts(tail: DataFrame) -> DataFrame:
    """Parts and messages the tail view leaves out, per session."""
    return tail.groupBy(*KEYS).agg(
        F.max("hidden_parts").alias("hidden_parts"), F.count_if(~F.col("shown")).alias("hidden_messages")
    )


def nav_messages(tree: DataFrame) -> DataFrame:
    """Messages with their navigation group and place in it.

    A prompt, command or compact summary heads a group; messages before the
    first head are left out. ``child_no`` is 0 for the head.
    """
    head = _is("user_prompt", "command", "compact_summary")
    out = running(
        reachable(tree), KEYS, "dfs_pos",
        {"group_no": ("sum", _flag(head)), "head_pos": ("max", F.when(head, F.col("dfs_pos")))},
    )
    return (
        out.where("group_no > 0")
        .withColumn("child_no", F.col("dfs_pos") - F.col("head_pos"))
        .withColumn("listed", F.col("child_no") <= NAV_CHILDREN)
    )


def nav_groups(tree: DataFrame) -> DataFrame:
    """One row per navigation group: head, size, how many children are not listed, open or folded."""
    placed = nav_messages(tree)
    groups = placed.groupBy(*KEYS, "group_no").agg(
        F.max(F.when(F.col("child_no") == 0, F.col("line_no"))).alias("head_line"),
        F.max(F.when(F.col("child_no") == 0, F.col("kind"))).alias("head_kind"),
        (F.count("*") - 1).alias("n_children"),
    )
    last = groups.groupBy(*KEYS).agg(F.max("group_no").alias("last_group"))
    return (
        groups.join(last, KEYS)
        .withColumn("n_more", F.greatest(F.col("n_children") - NAV_CHILDREN, F.lit(0)).cast("bigint"))
        .withColumn("is_open", F.col("group_no") > F.col("last_group") - NAV_OPEN_GROUPS)
        .drop("last_group")
    )


def nav_labels(tree: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``label``, NULL where the navigation shows none."""
    call = F.get(F.filter("items", lambda i: item_type(i) == "tool_use"), F.lit(0))
    found = once(with_content(nav_messages(tree), messages), "call", F.when(_is("assistant"), call))
    found = found.withColumn("tool_name", F.coalesce(text_at(F.col("call"), "$.name"), F.lit("")))
    found = once(found, "preview", tool_preview(F.col("tool_name"), child(F.col("call"), "$.input")))
    found = once(found, "said", F.when(_is("user_prompt"), first_text(F.col("items"))))
    preview = F.col("preview")
    with_preview = F.concat("tool_name", F.lit("("), preview, F.lit(")"))
    label = (
        F.when(_is("compact_summary"), "COMPACT")
        .when(_is("command"), F.col("command_name"))
        .when(_is("user_prompt"), F.when(F.col("said") == "", "(empty)").otherwise(text.cut_with_dots(text.first_line(F.col("said")), 40)))
        .when(_is("assistant") & F.col("call").isNull(), "response")
        .when(_is("assistant"), F.when((preview != "") & (F.length(preview) < 30), with_preview).otherwise(F.col("tool_name")))
        .when(_is("meta"), "system")
    )
    return found.withColumn("label", label).drop("call", "tool_name", "preview", "said")


def prompt_neighbors(tree: DataFrame) -> DataFrame:
    """Per prompt the previous and next one, itself at the ends."""
    prompts = reachable(tree).where(_is("user_prompt"))
    back = running(prompts, KEYS, "dfs_pos", {"prev_pos": ("max", F.col("dfs_pos"), "before")})
    both = running(back, KEYS, "dfs_pos", {"next_pos": ("min", F.col("dfs_pos"), "before")}, backward=True)
    return both.withColumns(
        {"prev_pos": F.coalesce("prev_pos", "dfs_pos"), "next_pos": F.coalesce("next_pos", "dfs_pos")}
    )
