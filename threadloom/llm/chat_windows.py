"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes windows of at most ``budget`` tokens. Running sums of
turn tokens choose turn-aligned spans: a window takes turns until the next one would pass its
budget. Every window begins with the conversation's system turn, then repeats up to ``history``
tokens of the turns just before it. The loss mask covers the texts of assistant turns
that are new in the window; repeated turns and the system turn are masked.

A turn is written ``### role: text </turn>`` and a line end. Inside roles and texts ``\\``,
``#`` and ``<`` get a backslash, in roles ``:`` too, so that no text can hold a marker
and formatting can be undone.

Turns are numbered by a range sort: a turn's number is its place in its range and the sizes of the ranges before, so a conversation may
spread over many tasks, whatever its turn numbers are. It is cut into stretches of ``STRETCH`` turns by that place, and each stretch
is windowed by itself, starting at the running sum of the stretches before; a window ends early at the end of a stretch. Until windows
are known only sizes move, then each text meets its place once.

Defined results: null texts and roles count as empty. Turns come in order of turn (null ones last), role, the first ``SHORT`` characters of the
text, and a hash of it. Repeated rows are turns of their own. A turn longer than the
budget stands alone in a window, whole. Rows with a null conversation form one conversation. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import stage, unstage

#: Fixed values of the template.
END = " </turn>\n"
START = "### "

STRETCH = 256
STRETCHES = 1024
SHORT = 64
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def escape(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#<:])" if role else r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rendered turns; ``id`` grows with their order, without gaps inside a range (its upper bits)."""
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(F.col("role"), True), F.lit(": "))
    body = escape(F.col("text"))
    order = ["conv", F.asc_nulls_last("turn"), "role", F.left("text", F.lit(SHORT)), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("id", F.monotonically_increasing_id())
    return placed.select(
        "conv", "role", "id", F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("shown"),
    ).withColumn("tokens", F.regexp_count("shown", F.lit(TOKEN)).cast("long"))


def _same(left: DataFrame, right: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """Join on columns of equal names, null with null; those of the left side stay."""
    other = right.select(*(F.col(c).alias(f"_{c}" if c in by else c) for c in right.columns))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(other, on, how).drop(*(f"_{c}" for c in by))


def _numbered(turns: DataFrame) -> DataFrame:
    """``conv``, ``id``, ``tokens``, ``at`` (place in the conversation) and, for a system turn that begins it, ``system_tokens``."""
    narrow = turns.select("conv", "id", "tokens", "role", F.shiftright("id", 33).alias("range"))
    ranges = narrow.groupBy("conv", "range").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")  # one row per range
    placed = _same(narrow, ranges.select("conv", "range", "first_id", before.alias("before")), "conv", "range")
    at = F.col("before") + F.col("id") - F.col("first_id")
    return placed.select("conv", "id", "tokens", at.alias("at"), F.when((at == 0) & (F.col("role") == "system"), F.col("tokens")).alias("system_tokens"))


def _spots(numbered: DataFrame, budget: int, history: int) -> DataFrame:
    """``id``, ``at``, ``begin`` (tokens before it), and the place and begin of the first new turn of its window."""
    parts = numbered.groupBy("conv", F.floor(F.col("at") / STRETCH).alias("part")).agg(
        F.sum("tokens").alias("total"), F.sort_array(F.collect_list(F.struct("at", "id", "tokens"))).alias("turns")
    )
    # Running sums in two steps, so that no task needs all stretches of a conversation.
    parts = parts.withColumn("region", F.floor(F.col("part") / STRETCHES))
    regions = parts.groupBy("conv", "region").agg(F.sum("total").alias("all"))
    ahead = F.sum("all").over(Window.partitionBy("conv").orderBy("region")) - F.col("all")
    inside = F.sum("total").over(Window.partitionBy("conv", "region").orderBy("part")) - F.col("total")
    parts = _same(parts.withColumn("inside", inside), regions.select("conv", "region", ahead.alias("ahead")), "conv", "region")
    parts = _same(parts, numbered.where("system_tokens is not null").select("conv", "system_tokens"), "conv", how="left")
    room = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(1))
    spot = "struct<id:bigint,at:bigint,begin:bigint,first_turn:bigint,first_begin:bigint>"

    def place(seen: Column, turn: Column) -> Column:
        fits = (seen["first"] >= 0) & (seen["filled"] + turn["tokens"] <= room)
        first = F.when(fits, seen["first"]).otherwise(turn["at"])
        first_begin = F.when(fits, seen["first_begin"]).otherwise(seen["begin"])
        found = F.struct(turn["id"], turn["at"], seen["begin"], first.alias("first_turn"), first_begin.alias("first_begin")).cast(spot)
        return F.struct(
            F.concat(seen["spots"], F.array(found)).alias("spots"), first.alias("first"), first_begin.alias("first_begin"),
            (F.when(fits, seen["filled"]).otherwise(F.lit(0).cast("long")) + turn["tokens"]).alias("filled"), (seen["begin"] + turn["tokens"]).alias("begin"),
        )

    none = F.lit(0).cast("long")
    start = F.struct(
        F.array().cast(f"array<{spot}>").alias("spots"), (none - 1).alias("first"), none.alias("first_begin"), none.alias("filled"),
        (F.col("ahead") + F.col("inside")).alias("begin"),
    )
    return parts.select(F.explode(F.aggregate("turns", start, place, lambda seen: seen["spots"])).alias("spot")).select("spot.*")


def format_windows(
    conversations: DataFrame, budget: int = 512, history: int = 128, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per window.

    ``conv``; ``first_turn``, the place of its first new turn in the conversation; ``n_repeated``, turns repeated ahead of it; ``n_turns``, new turns;
    ``n_tokens``; ``text``; ``loss``, spans (start and length in characters) of the text that the loss covers.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than the budget")
    turns = stage(_turns(conversations, conv, turn, role, text))
    # Written once for the branches below that read it.
    placed = stage(turns.join(_spots(stage(_numbered(turns)), budget, history), "id"))
    unstage(turns)
    targets = placed.select(
        "conv", "first_turn", F.struct(F.col("at"), F.lit(False).alias("repeated"), F.col("role"), "head", "body", "shown", "tokens").alias("turn")
    )
    system = placed.where("at = 0 and role = 'system'").select(
        "conv",
        F.struct(
            F.lit(-1).cast("long").alias("at"), F.lit(True).alias("repeated"), "role", F.lit(0).alias("head"), F.lit(0).alias("body"), "shown", "tokens"
        ).alias("turn"),
    )
    systems = _same(placed.where("at = first_turn and at > 0").select("conv", "first_turn"), system, "conv")
    parts = targets.unionAll(systems)
    if history:
        parts = parts.unionAll(_history(placed, history))
    windows = parts.groupBy("conv", "first_turn").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    folded = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["shown"])).alias("at"),
            F.when(
                ~t["repeated"] & (t["role"] == "assistant"),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    repeated = F.size(F.filter("turns", lambda t: t["repeated"]))
    return windows.select(
        F.col("conv").alias(conv), "first_turn", repeated.alias("n_repeated"), (F.size("turns") - repeated).alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("text"), folded["spans"].alias("loss"),
    )


def _history(placed: DataFrame, history: int) -> DataFrame:
    """Turns that end just before a window and begin at most ``history`` tokens before it.

    Both sides meet on the running sum divided by ``history``, so a turn sees the windows of two neighbouring cells only.
    """
    windows = placed.where("at = first_turn and at > 0").select(
        F.col("conv").alias("_conv"), F.col("first_turn"), "first_begin",
        F.explode(F.array(*(F.floor(F.col("first_begin") / history) - k for k in (0, 1)))).alias("_cell"),
    )
    before = placed.where("not (at = 0 and role = 'system')").withColumn("cell", F.floor(F.col("begin") / history)).drop("first_turn", "first_begin")
    near = (F.col("begin") >= F.col("first_begin") - history) & (F.col("at") < F.col("first_turn"))
    return before.join(windows, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("cell") == F.col("_cell")) & near).select(
        "conv", "first_turn", F.struct(F.col("at"), F.lit(True).alias("repeated"), F.col("role"), "head", "body", "shown", "tokens").alias("turn")
    )


def parsed_turns(text: Column) -> Column:
    """``role`` and ``text`` of every turn in a formatted text."""
    shown = F.split(text, END, -1)
    pattern = r"(?s)^### ((?:\\.|[^\\:])*+): (.*)$"
    return F.transform(
        F.slice(shown, 1, F.size(shown) - 1),
        lambda t: F.struct(
            unescape(F.regexp_extract(t, pattern, 1)).alias("role"), unescape(F.regexp_extract(t, pattern, 2)).alias("text")
        ),
    )


def masked_texts(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))
