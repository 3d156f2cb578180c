import random

import pytest
from conftest import answer, user
from model import chunks, hidden, kind, tree as model_tree

from threadloom.operators import records, tree, views
from threadloom.operators.scans import running
from pyspark.sql import Window, functions as F


def random_session(rng: random.Random, n: int) -> list[dict]:
    """Duplicates, orphans, cycles, forward references, boundaries, both flags."""
    rows = []
    for i in range(n):
        uid = f"u{rng.randrange(n) if rng.random() < 0.1 else i}"
        parent = rng.choice([f"u{max(i - 1, 0)}", f"u{max(i - 1, 0)}", f"u{rng.randrange(n)}", "", "gone", f"b{rng.randrange(n)}"])
        if rng.random() < 0.12:
            rows.append({"type": "system", "subtype": "compact_boundary", "uuid": f"b{i}", "logicalParentUuid": rng.choice([f"u{rng.randrange(n)}", f"b{rng.randrange(n)}", f"b{i}", " "])})
            continue
        extra = {"uuid": rng.choice([uid, uid, uid, ""]), "parentUuid": parent}
        if rng.random() < 0.1:
            extra["isSidechain"] = True
        r = rng.random()
        if r < 0.1:
            rows.append(user("c", isCompactSummary=True, **extra))
        elif r < 0.5:
            rows.append(user("q", **extra))
        else:
            rows.append(answer("a", **extra))
    return rows


@pytest.fixture(scope="module")
def sessions():
    rng = random.Random(7)
    made = {f"s{i}": random_session(rng, rng.choice([1, 3, 8, 30, 60])) for i in range(25)}
    made["chain"] = [answer("a", uuid=f"c{i}", parentUuid=f"c{i - 1}") for i in range(200)]
    made["self"] = [user("a", uuid="x", parentUuid="x"), answer("b", uuid="y", parentUuid="x"), user("c", uuid="z")]
    return made


@pytest.fixture(scope="module")
def decoded(lines_of, sessions):
    return records.decode(lines_of(sessions))


@pytest.fixture(scope="module")
def index(decoded):
    return tree.build_tree(decoded)


def as_dict(df):
    return {(r.session_id, r.line_no): (r.parent_line, r.depth, r.dfs_pos, r.dfs_end, r.reachable, r.is_root) for r in df.collect()}


def expected(sessions):
    return {
        (sid, n): (v["parent"], v["depth"], v["pos"], v["end"], v["pos"] is not None, v["parent"] is None)
        for sid, rows in sessions.items()
        for n, v in model_tree(rows).items()
    }


def test_packed_order(index, sessions):
    assert as_dict(index) == expected(sessions)


@pytest.mark.parametrize("span", [1, 7, 1 << 16])
def test_segmented_order(decoded, sessions, span):
    """With a limit of 20 the longer sessions go the distributed way, cut into segments of any size."""
    assert as_dict(tree.build_tree(decoded, pack_limit=20, span=span)) == expected(sessions)


def test_siblings_and_circles_over_segments(lines_of):
    """One parent with children in all segments, forward parents, circles inside and across segments, all roots."""
    rng = random.Random(5)
    made = {
        "star": [user("r", uuid="r")] + [answer("a", uuid=f"s{i}", parentUuid="r") for i in range(40)],
        "late": [answer("a", uuid=f"l{i}", parentUuid="end") for i in range(20)] + [user("r", uuid="end")] + [answer("b", parentUuid="end") for _ in range(20)],
        "roots": [user("r", uuid=f"r{i}") for i in range(30)],
        "circle": [user("ok", uuid="ok")] + [answer("a", uuid=f"c{i}", parentUuid=f"c{(i + 1) % 30}") for i in range(30)] + [answer("b", parentUuid="c3"), answer("c", parentUuid="ok")],
        "wild": [answer("a", uuid=f"w{i}", parentUuid=f"w{rng.randrange(90)}" if i % 9 else "") for i in range(90)],
        "back": [answer("a", uuid=f"k{i}", parentUuid=f"k{i + 1}") for i in range(50)],
    }
    lines = records.decode(lines_of(made))
    for span in (3, 16):
        assert as_dict(tree.build_tree(lines, pack_limit=0, span=span)) == expected(made), span


def shuffled_rows(spark):
    jvm = spark._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_a_chain_is_ordered_in_few_shuffled_rows(spark):
    n = 200_000
    links = spark.range(n).select(
        F.lit("p").alias("project_key"), F.lit("s").alias("session_id"), F.col("id").alias("line_no"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_line"),
    )
    before = shuffled_rows(spark)
    got = tree.order_messages(links)
    wrong = got.where("not reachable or depth != line_no or dfs_pos != line_no or dfs_end != 200000").count()
    after = shuffled_rows(spark)
    assert (wrong, got.count()) == (0, n)
    assert 0 < sum(v for k, v in after.items() if k not in before) <= 6 * n


@pytest.mark.parametrize("length, root", [(15, "m"), (16, "m"), (17, None)])
def test_sixteen_hops(lines_of, length, root):
    rows = [user("m", uuid="m")]
    rows += [{"type": "system", "subtype": "compact_boundary", "uuid": f"b{i}", "logicalParentUuid": f"b{i - 1}" if i else "m"} for i in range(length)]
    rows.append(answer("x", uuid="x", parentUuid=f"b{length - 1}"))
    got = tree.build_tree(records.decode(lines_of({"s": rows}))).where("uuid = 'x'").first()
    assert got.parent_line == (0 if root else None)
    assert got.parent_uuid == ("m" if root else "b0")


def test_boundary_cycle_and_repeat(lines_of):
    b = lambda u, t: {"type": "system", "subtype": "compact_boundary", "uuid": u, "logicalParentUuid": t}
    rows = [user("m", uuid="m"), b("p", "q"), b("q", "p"), b("r", "gone"), b("r", "m"), answer("x", parentUuid="p"), answer("y", parentUuid="r")]
    got = {r.line_no: r.parent_uuid for r in tree.build_tree(records.decode(lines_of({"s": rows}))).collect()}
    assert got == {0: None, 5: "p", 6: "m"}


@pytest.mark.parametrize("options", [{}, {"include_agents": True}, {"compact_first": True}])
def test_pruned_subtrees(index, sessions, options):
    got = {(r.session_id, r.line_no) for r in tree.visible(index, **options).collect()}
    want = set()
    for sid, rows in sessions.items():
        laid = model_tree(rows)
        gone = hidden(rows, laid, **options)
        want |= {(sid, n) for n, v in laid.items() if v["pos"] is not None and n not in gone}
    assert got == want


@pytest.mark.parametrize("size, span", [(1, 1 << 20), (3, 1 << 20), (3, 4), (5, 7), (2, 16)])
def test_chunks(index, sessions, size, span):
    got = {(r.session_id, r.line_no): r.chunk_no for r in views.prompt_chunks(index, size, span).collect()}
    want = {}
    for sid, rows in sessions.items():
        order = sorted((v["pos"], n) for n, v in model_tree(rows).items() if v["pos"] is not None)
        for (_, n), c in zip(order, chunks([kind(rows[n]) for _, n in order], size)):
            want[sid, n] = c
    assert got == want


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_running_equals_window(spark, span):
    rng = random.Random(3)
    rows = [(g, p, rng.choice([None, rng.randrange(50)])) for g in range(4) for p in rng.sample(range(40), 25)]
    df = spark.createDataFrame(rows, "g int, p bigint, v int")
    w = Window.partitionBy("g").orderBy("p")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    got = running(df, ["g"], "p", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"), "before")}, span=span)
    got = running(got, ["g"], "p", {"n": ("min", F.col("v"), "before")}, backward=True, span=span)
    want = df.select("*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(before).alias("m"), F.min("v").over(after).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_threads_and_navigation(lines_of):
    rows = [
        answer("before", uuid="0"), user("p", uuid="1"), answer("a", uuid="2"), answer("s", uuid="3", isSidechain=True),
        user("<command-name>/x</command-name>", uuid="4"), user([{"type": "tool_result"}], uuid="5"), user("c", uuid="6", isCompactSummary=True), answer("b", uuid="7"),
    ]
    recs = records.decode(lines_of({"s": rows}))
    index = tree.build_tree(recs)
    got = [(r.line_no, r.thread_no, r.level) for r in views.threads(index).orderBy("line_no").collect()]
    assert got == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 0), (6, 2, 1), (7, 2, 1)]
    groups = [(r.head_line, r.head_kind, r.n_children, r.is_open) for r in views.nav_groups(index).orderBy("group_no").collect()]
    assert groups == [(1, "user_prompt", 2, True), (4, "command", 1, True), (6, "compact_summary", 1, True)]
    from threadloom.operators.messages import build_messages

    labels = [r.label for r in views.nav_labels(index, build_messages(recs)).orderBy("line_no").collect()]
    assert labels == ["p", "response", "response", "/x", None, "COMPACT", "response"]
    near = [(r.dfs_pos, r.prev_pos, r.next_pos) for r in views.prompt_neighbors(index).collect()]
    assert near == [(1, 1, 1)]


def long_session(n, compact_at=()):
    return [user("c", isCompactSummary=True) if i in compact_at else (user("p") if i % 3 == 0 else answer("a")) for i in range(n)]


def test_tail_view(lines_of):
    made = {"short": long_session(500, (100, 200, 300, 400)), "cut": long_session(600, (100, 200, 300, 550)), "plain": long_session(600)}
    index = tree.build_tree(records.decode(lines_of(made)))
    got = {r.session_id: (r.hidden_parts, r.hidden_messages) for r in views.hidden_counts(views.tail_view(index, threshold=500)).collect()}
    numbers = chunks([kind(r) for r in made["plain"]], 50)
    first_shown = max(numbers) - 2
    assert got == {"short": (0, 0), "cut": (2, 200), "plain": (first_shown, sum(c < first_shown for c in numbers))}
    alike = {r.session_id: r.hidden_parts for r in views.hidden_counts(views.tail_view(index)).collect()}
    assert alike["short"] == 2 and alike["cut"] == 2
