"""Conversation trees as columns: parent links, compaction hops, depth-first order.

The depth-first order of a forest is the order of *enter* steps on an Euler
tour: every message has an enter and an exit step, each step knows the next
one, and pointer doubling turns "next" into "distance to the end" in
logarithmically many rounds. Sessions up to ``PACK_LIMIT`` messages are
doubled inside a task, many sessions per Arrow batch. Longer ones are cut into
segments of lines: a task doubles inside a segment, and only the steps by which
the tour enters a segment are doubled in distributed joins, so no session is
ever held by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from threadloom.functions import text
from threadloom.operators.messages import classify, is_conversational
from threadloom.operators.records import KEYS, once
from threadloom.operators.scans import SPAN, running
from threadloom.session import stage

PACK_LIMIT = 4096
DOUBLINGS = 4  # 2**4 = the 16 hops followed across compaction boundaries
TREE_COLUMNS = ["parent_line", "is_root", "reachable", "depth", "dfs_pos", "dfs_end"]


def skeleton(records: DataFrame, weigh: bool = True) -> DataFrame:
    """What the tree needs of messages and compaction boundaries, narrow, in one pass.

    ``target`` is the logical parent of a boundary and NULL on messages; ``weight`` is the length of the content, which exports
    cut by. It has to lay out the content, so it is left out where nothing is to be exported.
    """
    is_boundary = F.coalesce((F.col("type") == "system") & (F.col("subtype") == "compact_boundary"), F.lit(False))
    target = text.none_if_empty(text.trim_all(F.col("logical_parent_uuid")))
    fields = ["type", "subtype", "uuid", "logical_parent_uuid"]
    # Taken once: the filter would else be pushed below the fields it looks at, with copies of all of them.
    held = once(records, "__own", F.struct(*fields)).withColumns({c: F.col(f"__own.{c}") for c in fields})
    aimed = once(held, "target", F.when(is_boundary, target))
    kept = aimed.where(is_conversational() | (F.col("uuid").isNotNull() & F.col("target").isNotNull()))
    weight = F.coalesce(F.length(F.to_json("content")), F.lit(0)).cast("bigint").alias("weight")
    return classify(kept).select(
        *KEYS, "line_no", "uuid", "parent_uuid_raw", "type", "kind", "is_compacted", "is_sidechain", *([weight] if weigh else []), "target"
    )


def boundaries(bones: DataFrame) -> DataFrame:
    """Compaction boundaries with a logical parent, the last one per uuid."""
    return bones.where("target is not null").groupBy(*KEYS, "uuid").agg(F.max_by("target", "line_no").alias("target"))


def hop_targets(bounds: DataFrame) -> DataFrame:
    """Where each boundary leads after at most 16 hops.

    With f(x) = target of x, or x itself where there is none, the answer is f
    applied 16 times, which is four squarings of f. Squaring stops early once
    no target is itself a boundary.
    """
    hops = bounds
    for _ in range(DOUBLINGS):
        further = hops.select(*KEYS, F.col("uuid").alias("target"), F.col("target").alias("next_target"))
        moved = stage(
            hops.join(further, [*KEYS, "target"], "left").select(
                *KEYS, "uuid", F.coalesce("next_target", "target").alias("target"),
                F.coalesce(F.col("next_target") != F.col("target"), F.lit(False)).alias("moved"),
            )
        )
        hops = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return hops


def _spread_nulls(df: DataFrame, column: str) -> DataFrame:
    """Give rows without a link a key of their own, so they do not pile up in one join task."""
    return df.withColumn("__link", F.coalesce(column, F.concat(F.lit("\u0000"), F.col("line_no").cast("string"))))


def resolve_parents(bones: DataFrame) -> DataFrame:
    """Messages with ``parent_uuid``: the logged parent after hops over compaction boundaries."""
    messages = bones.where("target is null").drop("target")
    bounds = boundaries(bones)
    if bones.where("target is not null").isEmpty():
        return messages.withColumn("parent_uuid", F.col("parent_uuid_raw"))
    hops = hop_targets(bounds).withColumnRenamed("uuid", "__link")
    return (
        _spread_nulls(messages, "parent_uuid_raw")
        .join(hops, [*KEYS, "__link"], "left")
        .withColumn("parent_uuid", F.coalesce("target", "parent_uuid_raw"))
        .drop("target", "__link")
    )


def link_parents(messages: DataFrame) -> DataFrame:
    """Add ``parent_line``, NULL for roots (no parent, or one that is not there).

    A repeated uuid stands for its last message.
    """
    last = (
        messages.where("uuid is not null")
        .groupBy(*KEYS, "uuid")
        .agg(F.max("line_no").alias("parent_line"))
        .withColumnRenamed("uuid", "__link")
    )
    return _spread_nulls(messages, "parent_uuid").join(last, [*KEYS, "__link"], "left").drop("__link")


def _double(next_step: np.ndarray, weights: list[np.ndarray], rounds: int) -> None:
    for _ in range(rounds):
        for w in weights:
            w[:-1] += w[next_step[:-1]]
        next_step[:-1] = next_step[next_step[:-1]]


def _walk(lines: np.ndarray, parents: np.ndarray, session: np.ndarray) -> tuple[np.ndarray, ...]:
    """Depth-first positions of many sessions at once; inputs sorted by session and line.

    ``parents`` is -1 for roots. Positions count within the session.
    """
    n = len(lines)
    up = np.full(n, -1)
    linked = parents >= 0
    # Parent rows are found by binary search on (session, line).
    stride = int(lines.max()) + 2
    rank = session * stride + lines
    up[linked] = np.searchsorted(rank, session[linked] * stride + parents[linked])

    end = 2 * n
    step = np.empty(end + 1, dtype=np.int64)
    step[:n] = np.arange(n, end)  # enter -> own exit, unless there is a child
    step[n:end] = np.where(up >= 0, up + n, end)  # exit -> exit of the parent, unless there is a sibling
    step[end] = end
    family = np.where(up >= 0, up + len(lines), session)  # siblings share a parent, roots a session
    order = np.lexsort((np.arange(n), family))
    same = family[order][1:] == family[order][:-1]
    step[n + order[:-1][same]] = order[1:][same]
    heads = order[np.concatenate(([True], ~same))]
    heads = heads[up[heads] >= 0]
    step[up[heads]] = heads

    enters = np.zeros(end + 1, dtype=np.int64)
    enters[:n] = 1
    level = np.zeros(end + 1, dtype=np.int64)
    level[:n], level[n:end] = 1, -1
    longest = int(np.bincount(session).max())
    _double(step, [enters, level], math.ceil(math.log2(2 * longest + 1)) + 1)

    reachable = step[:n] == end
    total = np.bincount(session, weights=reachable, minlength=int(session.max()) + 1).astype(np.int64)[session]
    return reachable, -level[:n], total - enters[:n], total - enters[n:end]


_LONGS = T.ArrayType(T.LongType())
_WALKED = T.StructType(
    [
        T.StructField("line", _LONGS),
        T.StructField("reach", T.ArrayType(T.BooleanType())),
        T.StructField("depth", _LONGS),
        T.StructField("pos", _LONGS),
        T.StructField("stop", _LONGS),
    ]
)


@pandas_udf(_WALKED)
def _walk_packed(lines: pd.Series, parents: pd.Series) -> pd.DataFrame:
    names = ["line", "reach", "depth", "pos", "stop"]
    if lines.empty:
        return pd.DataFrame({name: [] for name in names})
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    flat_lines = np.concatenate(lines.to_list()).astype(np.int64)
    flat_parents = np.concatenate(parents.to_list()).astype(np.int64)
    session = np.repeat(np.arange(len(sizes)), sizes)
    cuts = np.cumsum(sizes)[:-1]
    columns = [flat_lines, *_walk(flat_lines, flat_parents, session)]
    return pd.DataFrame(dict(zip(names, [np.split(c, cuts) for c in columns])))


def walk_packed(links: DataFrame) -> DataFrame:
    """Order short sessions, many per batch. ``links`` holds the keys, line and parent line."""
    packed = links.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("parent_line", F.lit(-1)).alias("up")))).alias("m")
    )
    walked = packed.select(*KEYS, _walk_packed(F.col("m.line_no"), F.col("m.up")).alias("w"))
    zipped = F.arrays_zip("w.line", "w.reach", "w.depth", "w.pos", "w.stop")
    return walked.select(*KEYS, F.explode(zipped).alias("r")).select(
        *KEYS,
        F.col("r.line").alias("line_no"),
        F.col("r.reach").alias("reachable"),
        *[F.when(F.col("r.reach"), F.col(f"r.{src}")).alias(dst) for src, dst in
          (("depth", "depth"), ("pos", "dfs_pos"), ("stop", "dfs_end"))],
    )


def _part(line: Column, span: int) -> Column:
    return F.floor(line / F.lit(span))


def _borders(links: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Where a tour leaves the segment it is in: ``(at, next)`` by segment, and where each session's tour starts.

    A step is four times a line, plus 0 to enter the message, 1 to leave it, and 2 and 3 before and after those of its
    children that lie in its own segment. Only children in other segments than their parent (and roots) are looked at,
    one row per parent and segment, so what a parent has in its own segment need not be known here.
    """
    up = F.coalesce("parent_line", F.lit(-1))
    away = links.select(*KEYS, up.alias("up"), "line_no", _part(F.col("line_no"), span).alias("part")).where(
        (F.col("up") < 0) | (_part(F.col("up"), span) != F.col("part"))
    )
    pieces = away.groupBy(*KEYS, "up", "part").agg(
        (F.min("line_no") * 4).alias("first"), (F.max("line_no") * 4 + 1).alias("last")
    )
    home = pieces.where("up >= 0").select(*KEYS, "up").distinct().select(
        *KEYS, "up", _part(F.col("up"), span).alias("part"), (F.col("up") * 4 + 2).alias("first"), (F.col("up") * 4 + 3).alias("last")
    )
    along = Window.partitionBy(*KEYS, "up").orderBy("part")
    chained = stage(
        pieces.unionByName(home).withColumns({"follows": F.lead("first").over(along), "head": F.row_number().over(along) == 1})
    )
    home_exit = F.when(F.col("up") >= 0, F.col("up") * 4 + 1)
    onward = chained.select(*KEYS, "part", F.col("last").alias("at"), F.coalesce("follows", home_exit).alias("next"))
    inward = chained.where("head and up >= 0").select(
        *KEYS, _part(F.col("up"), span).alias("part"), (F.col("up") * 4).alias("at"), F.col("first").alias("next")
    )
    return onward.unionByName(inward), chained.where("head and up < 0").select(*KEYS, F.col("first").alias("start"))


class _Segment:
    """The steps of one segment, each taken to where it leaves the segment: ``out`` is the number of that border, or negative in a circle."""

    def __init__(self, lines: np.ndarray, ups: np.ndarray, at: np.ndarray, to: np.ndarray, span: int):
        order = np.argsort(lines)
        self.lines, ups = lines[order], ups[order]
        self.n = n = len(lines)
        part = self.lines[0] // span
        self.gates = np.sort(at[at % 4 == 3] // 4)
        k = len(self.gates)
        self.base = base = 2 * n + 2 * k
        step = np.arange(base + len(at) + 1)
        step[:n] += n

        here = (ups >= 0) & (ups // span == part)
        up = np.searchsorted(self.lines, ups[here])
        step[n + np.flatnonzero(here)] = n + up
        family = np.argsort(ups, kind="stable")
        same = ups[family][1:] == ups[family][:-1]
        step[n + family[:-1][same]] = family[1:][same]
        eldest, youngest = family[np.concatenate(([True], ~same))], family[np.concatenate((~same, [True]))]
        eldest, youngest = eldest[here[eldest]], youngest[here[youngest]]
        step[np.searchsorted(self.lines, ups[eldest])] = eldest

        # Steps before and after the children at home, for parents that have others elsewhere.
        gate = np.searchsorted(self.lines, self.gates)
        opening, closing = 2 * n + np.arange(k), 2 * n + k + np.arange(k)
        step[opening] = np.where(step[gate] == n + gate, closing, step[gate])
        gated = np.isin(ups[youngest], self.gates)
        step[n + youngest[gated]] = closing[np.searchsorted(self.gates, ups[youngest[gated]])]

        inside = (to >= 0) & (to // 4 // span == part)
        goal = base + np.arange(len(at))
        goal[inside] = self.place(to[inside])
        step[self.place(at)] = goal

        self.enters, self.level = np.zeros(len(step), dtype=np.int64), np.zeros(len(step), dtype=np.int64)
        self.enters[:n], self.level[:n], self.level[n : 2 * n] = 1, 1, -1
        _double(step, [self.enters, self.level], math.ceil(math.log2(len(step))) + 1)
        self.out = step - base
        self.out[-1] = -1

    def place(self, at: np.ndarray) -> np.ndarray:
        line, kind = at // 4, at % 4
        return np.where(
            kind < 2,
            np.searchsorted(self.lines, line) + kind * self.n,
            2 * self.n + np.searchsorted(self.gates, line) + (kind - 2) * len(self.gates),
        )


def _longs(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, -1).to_numpy().astype(np.int64)


def _segment(left: pa.Table, right: pa.Table, span: int) -> tuple[_Segment, pa.Table]:
    borders = right.filter(pc.is_valid(right["at"]))
    return _Segment(_longs(left["line_no"]), _longs(left["parent_line"]), _longs(borders["at"]), _longs(borders["next"]), span), borders


def _keyed(left: pa.Table, n: int, columns: dict) -> pa.Table:
    """Columns with the keys of the segment, ``n`` rows."""
    keys = {k: pa.array([left[k][0].as_py()] * n, pa.string()) for k in KEYS}
    return pa.table({**keys, **columns})


_KEY_TYPES = ", ".join(f"{k} string" for k in KEYS)


def walk_segments(links: DataFrame, span: int = SPAN) -> DataFrame:
    """Order sessions of any length, a segment of ``span`` lines at a time.

    Every segment is contracted by itself to the few steps by which the tour comes in, these are ranked by pointer
    doubling in joins, and a second pass over the segments adds what comes after. Links between neighbouring lines cost
    nothing but the two passes; what is ranked by joins grows with the links that cross a border of segments.
    """
    cut = links.select(*KEYS, "line_no", "parent_line", _part(F.col("line_no"), span).alias("part"))
    by_part = [*KEYS, "part"]
    borders, starts = _borders(links, span)
    borders = stage(borders)
    crossing = borders.where(F.col("next").isNotNull() & (_part(F.floor(F.col("next") / 4), span) != F.col("part")))
    none = F.lit(None).cast("bigint")
    entries = crossing.select("next", *KEYS).unionByName(starts.withColumnRenamed("start", "next")).select(
        *KEYS, _part(F.floor(F.col("next") / 4), span).alias("part"), none.alias("at"), none.alias("next"), F.col("next").alias("entry")
    )

    def contract(left: pa.Table, right: pa.Table) -> pa.Table:
        segment, known = _segment(left, right, span)
        entry = np.unique(_longs(right["entry"].drop_null()))
        place = segment.place(entry)
        found = segment.out[place] >= 0
        entry, place = entry[found], place[found]
        goes = _longs(known["next"])[segment.out[place]]
        columns = {"at": entry, "next": pa.array(goes, mask=goes < 0), "enters": segment.enters[place], "level": segment.level[place]}
        return _keyed(left, len(entry), columns)

    to_contract = borders.withColumn("entry", none).unionByName(entries)
    ranked = rank_steps(
        stage(
            cut.groupBy(*by_part).cogroup(to_contract.groupBy(*by_part)).applyInArrow(
                contract, f"{_KEY_TYPES}, at bigint, next bigint, enters bigint, level bigint"
            )
        )
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        segment, known = _segment(left, right, span)
        n = segment.n
        ends = np.append(known["ends"].to_numpy().astype(bool), False)
        after, below = (np.append(_longs(known[c]), 0) for c in ("enters", "level"))
        total = pc.max(known["total"]).as_py() or 0
        out = np.where(segment.out[: 2 * n] >= 0, segment.out[: 2 * n], len(ends) - 1)
        reach = ends[out][:n] & ends[out][n:]
        enters = segment.enters[: 2 * n] + after[out]
        level = segment.level[:n] + below[out[:n]]
        placed = {"depth": -level, "dfs_pos": total - enters[:n], "dfs_end": total - enters[n:]}
        columns = {"line_no": segment.lines, "reachable": reach, **{c: pa.array(v, mask=~reach) for c, v in placed.items()}}
        return _keyed(left, n, columns)

    totals = starts.join(ranked.withColumnRenamed("at", "start"), [*KEYS, "start"]).select(*KEYS, F.col("enters").alias("total"))
    after = ranked.select(*KEYS, F.col("at").alias("next"), "enters", "level", F.lit(True).alias("known"))
    # A border is known by where it leads; the end of a tour, and a step that stays inside, lead on to nothing more.
    to_finish = (
        borders.withColumn("next_key", F.coalesce("next", F.lit(-1)))
        .join(after.withColumnRenamed("next", "next_key"), [*KEYS, "next_key"], "left")
        .join(totals, KEYS, "left")
        .select(
            *by_part, "at", "next", F.coalesce("enters", F.lit(0)).alias("enters"), F.coalesce("level", F.lit(0)).alias("level"),
            (F.col("next").isNull() | F.col("known").isNotNull()).alias("ends"), "total",
        )
    )
    return cut.groupBy(*by_part).cogroup(to_finish.groupBy(*by_part)).applyInArrow(
        finish, f"{_KEY_TYPES}, line_no bigint, reachable boolean, depth bigint, dfs_pos bigint, dfs_end bigint"
    )


def rank_steps(steps: DataFrame) -> DataFrame:
    """Steps that reach an end (``next`` NULL), with ``enters`` and ``level`` summed up to it, by pointer doubling.

    A round writes the steps still under way; finished ones stay where they were written. Steps in a circle, and those
    that lead into one, come out of no round: what is under way doubles its reach, so rounds end once it is past the count of steps.
    A round reads the tables of all rounds before, so each is written in as few files as the steps are, or files and tasks would add up.
    """
    count, parts = steps.count(), max(1, steps.rdd.getNumPartitions())
    moved, finished = steps, [steps.where("next is null")]
    for _ in range(math.ceil(math.log2(count + 1)) + 1):
        going = moved.where("next is not null")
        if going.isEmpty():
            break
        whole = going
        for table in finished:
            whole = whole.unionByName(table)
        ahead = whole.select(
            *KEYS, F.col("at").alias("next"), F.col("next").alias("next2"), F.col("enters").alias("e2"), F.col("level").alias("l2")
        )
        moved = stage(
            going.join(ahead, [*KEYS, "next"]).select(
                *KEYS, "at", F.col("next2").alias("next"), (F.col("enters") + F.col("e2")).alias("enters"),
                (F.col("level") + F.col("l2")).alias("level"),
            ).coalesce(parts)
        )
        finished.append(moved.where("next is null"))
    ranked = finished[0]
    for table in finished[1:]:
        ranked = ranked.unionByName(table)
    return ranked.drop("next")


def order_messages(linked: DataFrame, pack_limit: int = PACK_LIMIT, span: int = SPAN) -> DataFrame:
    """Add depth-first columns to linked messages.

    Messages on a parent cycle, and below one, are not reachable from any root
    and get NULL positions.
    """
    links = linked.select(*KEYS, "line_no", "parent_line")
    sizes = linked.groupBy(*KEYS).agg(F.count("*").alias("n"))
    long_sessions = sizes.where(F.col("n") > pack_limit)
    long_keys = stage(long_sessions.select(*KEYS))
    if long_keys.isEmpty():
        walked = walk_packed(links)
    else:
        walked = walk_packed(links.join(long_keys, KEYS, "left_anti")).unionByName(
            walk_segments(links.join(long_keys, KEYS, "left_semi"), span)
        )
    return linked.withColumn("is_root", F.col("parent_line").isNull()).join(walked, [*KEYS, "line_no"])


def build_tree(records: DataFrame, pack_limit: int = PACK_LIMIT, span: int = SPAN, weigh: bool = True) -> DataFrame:
    """The tree index: one narrow row per message with parent links and depth-first interval.

    The records are read once. All views work on the index; ``with_content``
    adds the message content where a rendering needs it. Without ``weigh`` it has no ``weight``, which only exports ask for.
    """
    linked = stage(link_parents(resolve_parents(stage(skeleton(records, weigh)))))
    return stage(order_messages(linked, pack_limit, span))


def with_content(tree: DataFrame, messages: DataFrame) -> DataFrame:
    """Index rows with the remaining message columns."""
    added = [c for c in messages.columns if c not in tree.columns]
    return tree.join(messages.select(*KEYS, "line_no", *added), [*KEYS, "line_no"])


def reachable(tree: DataFrame) -> DataFrame:
    return tree.where("reachable")


def in_pruned_subtree(
    tree: DataFrame, *, include_agents: bool = False, cut_compacted: bool = True, compact_first: bool = False
) -> DataFrame:
    """Add ``hidden``: the message lies in a subtree a rendering leaves out.

    A sidechain message is left out with its subtree unless agents are
    included; a compact summary is shown but its descendants are not. With
    ``compact_first`` a message with both flags is shown. Subtrees are nested
    intervals of depth-first positions, so the running maximum of the interval
    ends says whether any cut interval is still open. No join is needed.
    """
    never = F.lit(None).cast("bigint")
    cut_self = F.lit(False) if include_agents else F.col("is_sidechain")
    if compact_first:
        cut_self = cut_self & ~F.col("is_compacted")
    flagged = reachable(tree).withColumns(
        {
            "__own": F.when(cut_self, F.col("dfs_end")).otherwise(never),
            "__below": F.when(F.col("is_compacted"), F.col("dfs_end")).otherwise(never) if cut_compacted else never,
        }
    )
    marked = running(
        flagged, KEYS, "dfs_pos",
        {"__open_own": ("max", F.col("__own")), "__open_below": ("max", F.col("__below"), "before")},
    )
    hidden = F.greatest(F.coalesce("__open_own", F.lit(0)), F.coalesce("__open_below", F.lit(0))) > F.col("dfs_pos")
    return marked.withColumn("hidden", hidden).drop("__own", "__below", "__open_own", "__open_below")


def visible(tree: DataFrame, **options) -> DataFrame:
    return in_pruned_subtree(tree, **options).where(~F.col("hidden")).drop("hidden")
