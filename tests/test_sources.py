"""Log files, split invariance, the lake, streaming."""

import json
import os
import random
import time

import pytest
from conftest import answer, call, result, user
from pyspark.sql import functions as F

from threadloom.operators.records import decode, quarantine
from threadloom.operators.sessions import session_table
from threadloom.plans import lake
from threadloom.sources import bridges, stores
from threadloom.sources.transcripts import line_ordinals, path_keys, scan_transcripts
from threadloom.streaming import growing, names, tail


def write(root, project, name, rows, mode="w", end="\n"):
    folder = root / project
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, mode, encoding="utf-8") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


def test_scan(spark, tmp_path):
    write(tmp_path, "-a b+c%", "s1.jsonl", ["one", "", "three\r"])
    write(tmp_path, "-a b+c%", "agent-x.jsonl", ["side"])
    write(tmp_path, "-a b+c%", "note.txt", ["no"])
    write(tmp_path, "-p", "s1.jsonl", ["other"], end="")
    (tmp_path / "-p" / "folder.jsonl").mkdir()
    (tmp_path / "-p" / "folder.jsonl" / "deep.jsonl").write_text("deep\n")
    (tmp_path / "top.jsonl").write_text("top\n")
    got = scan_transcripts(spark, str(tmp_path)).orderBy("project_key", "line_no").collect()
    assert [(r.project_key, r.session_id, r.line_no, r.value.strip()) for r in got] == [
        ("-a b+c%", "s1", 0, "one"), ("-a b+c%", "s1", 1, ""), ("-a b+c%", "s1", 2, "three"), ("-p", "s1", 0, "other")
    ]
    assert scan_transcripts(spark, str(tmp_path), with_side_files=True).where("session_id = 'agent-x'").count() == 1
    assert scan_transcripts(spark, str(tmp_path / "gone")).count() == 0


@pytest.mark.parametrize("then", ["1k", "128m"])
@pytest.mark.parametrize("split", ["1k", "128m"])
def test_line_numbers_over_splits(spark, tmp_path, split, then):
    """The settings may change between the scan and its use; parallelism as well."""
    for k in range(3):
        write(tmp_path, "-p", f"s{k}.jsonl", [json.dumps({"n": n, "pad": "é" * (n % 37)}) for n in range(600)])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], split)
        spark.conf.set(names[1], "3")
        lines = scan_transcripts(spark, str(tmp_path))
        spark.conf.set(names[0], then)
        spark.conf.set(names[1], "40")
        got = lines.select("session_id", "line_no", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    assert len(got) == 1800 and all(r.line_no == r.n for r in got)


def test_keys_cost_nothing_per_line(spark, tmp_path):
    """They are taken from a path once per split, and by no pattern that tries every place of the path."""
    write(tmp_path, "-p", "s1.jsonl", ["one", "two"])
    plan = scan_transcripts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "url_decode" not in plan.lower() and "UrlCodec" not in plan
    paths = ["/a/b.jsonl", "x/-p/s.1.jsonl", "file:/l/-p/agent-1.jsonl", "s.jsonl", "/s.jsonl", "/a//s.jsonl", "/a/.jsonl", "/a/s.json", "", "/a/\u00e9 +%.jsonl"]
    named = spark.createDataFrame([(p,) for p in paths], "path string")
    old = [F.regexp_extract("path", r"([^/]+)/([^/]+)\.jsonl$", n) for n in (1, 2)]
    assert named.select(*path_keys(F.col("path"))).collect() == named.select(*old).collect()


def test_scan_of_some_projects(spark, tmp_path):
    for name in ("-p[1]", "-p1", "-q*"):
        write(tmp_path, name, "s.jsonl", [f"in {name}"])
    lines = lambda projects: sorted(r.value for r in scan_transcripts(spark, str(tmp_path), projects=projects).collect())
    assert lines(["-p[1]", "-q*", "none"]) == ["in -p[1]", "in -q*"]
    assert lines(["none"]) == lines([]) == []
    assert len(lines(None)) == 3


class Counted:
    """A file store that counts the bytes read from it and can refuse to open logs."""

    def __init__(self, store, opens=True):
        self.store, self.bytes = store, 0
        self.get_file_info = store.get_file_info
        if opens:
            self.open_input_file = self._open

    def _open(self, path):
        return CountedFile(self, self.store.open_input_file(path))


class CountedFile:
    def __init__(self, owner, file):
        self.owner, self.file = owner, file

    def read_at(self, n, at):
        data = self.file.read_at(n, at)
        self.owner.bytes += len(data)
        return data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def grown(tmp_path, **options):
    return growing.GrowingReader({"path": str(tmp_path / "logs"), "index": str(tmp_path / "index"), "startingOffsets": "earliest", **options})


def ticks(reader, start):
    """Spans of the ticks from ``start`` until nothing new is there, and the offset reached."""
    spans = []
    while (end := reader.latestOffset()) != start:
        spans += reader.partitions(start, end)
        start = end
    return spans, start


def test_the_driver_opens_no_log(spark, tmp_path, monkeypatch):
    """Offsets come from sizes alone; only ``read``, which runs in tasks, opens files."""
    write(tmp_path / "logs", "-p", "s.jsonl", ["a", "b" * 40, "c"])
    reader = grown(tmp_path, maxBytesPerTrigger="20")
    monkeypatch.setattr(growing, "open_store", lambda root: (Counted(stores.open_store(root)[0], opens=False), stores.open_store(root)[1]))
    spans, _ = ticks(reader, reader.initialOffset())
    assert len(spans) == 3 and all(s.stop - s.start <= 20 for s in spans)
    monkeypatch.undo()
    got = [(n, value) for span in spans for _, _, n, value in reader.read(span)]
    assert got == [(0, "a"), (1, "b" * 40), (2, "c")]


@pytest.mark.parametrize("lost", [False, True])
def test_a_tick_reads_what_is_new(tmp_path, monkeypatch, lost):
    """Bytes read stay within twice the new ones, with a line that stays open over many ticks; a lost index costs a recount, no line."""
    rng = random.Random(5)
    values = [f"{n} " + "x" * (400_000 if n == 300 else rng.randint(0, 2000)) for n in range(1500)]
    text = "".join(v + "\n" for v in values).encode()
    store = Counted(stores.open_store(str(tmp_path))[0])
    monkeypatch.setattr(growing, "open_store", lambda root: (store, stores.open_store(root)[1]))
    (tmp_path / "logs" / "-p").mkdir(parents=True)
    reader, got, at, reads, recounted = grown(tmp_path), [], 0, 0, lost
    offset = reader.initialOffset()
    while at < len(text):
        step = rng.randint(1, 40_000)
        with open(tmp_path / "logs" / "-p" / "s.jsonl", "ab") as f:
            f.write(text[at : at + step])
        at += step
        spans, offset = ticks(reader, offset)
        if lost and at > len(text) // 2:
            lost = False
            for f in (tmp_path / "index" / "lines").rglob("*.json"):
                f.write_text("[[1, 2")
        got += [(n, value) for span in spans for _, _, n, value in reader.read(span)]
        reads += 2 * len(spans) + 8
        if at > len(text) // 2 and len(got) % 7 == 0:
            reader = grown(tmp_path)  # started again
    assert got == list(enumerate(values))
    assert store.bytes <= (3 if recounted else 2) * len(text) + 64 * reads


def test_a_rewritten_file_is_counted_anew(tmp_path):
    write(tmp_path / "logs", "-p", "s.jsonl", ["one", "two", "three"])
    reader = grown(tmp_path)
    spans, offset = ticks(reader, reader.initialOffset())
    assert [r[2:] for s in spans for r in reader.read(s)] == [(0, "one"), (1, "two"), (2, "three")]
    write(tmp_path / "logs", "-p", "s.jsonl", ["x"])
    assert ticks(reader, offset) == ([], offset)
    write(tmp_path / "logs", "-p", "s.jsonl", ["a much longer first line", "then"])
    spans, offset = ticks(reader, offset)
    assert [r[2:] for s in spans for r in reader.read(s)] == [(0, "a much longer first line"), (1, "then")]
    (tmp_path / "logs" / "-p" / "s.jsonl").unlink()
    assert [r for s in spans for r in reader.read(s)] == []


def test_offsets_hold_what_changed(tmp_path):
    for n in range(40):
        write(tmp_path / "logs", f"-p{n % 4}", f"s{n}.jsonl", ["start"])
    reader = grown(tmp_path, startingOffsets="latest")
    offset = first = reader.initialOffset()
    sizes = []
    for n in range(150):
        write(tmp_path / "logs", "-p1", "s1.jsonl", [f"line {n}"], "a")
        end = reader.latestOffset()
        spans = reader.partitions(offset, end)
        assert [(s.start < s.stop, s.path.endswith("/-p1/s1.jsonl")) for s in spans] == [(True, True)]
        sizes.append(len(json.dumps(end)) + os.path.getsize(tmp_path / "index" / "offsets" / f"{end['manifest']:012d}.change.json"))
        offset = end
    assert reader.latestOffset() == offset and max(sizes) < 250  # forty files, one of them in a tick
    again = grown(tmp_path, startingOffsets="latest")
    assert again.latestOffset() == offset and again.manifests.sizes == reader.manifests.sizes
    (span,) = reader.partitions(first, offset)
    assert [r[3] for r in reader.read(span)] == [f"line {n}" for n in range(150)]
    reader.commit(offset)
    assert len(os.listdir(tmp_path / "index" / "offsets")) < 40
    assert grown(tmp_path).manifests.sizes == reader.manifests.sizes


def test_ordinals(spark):
    df = spark.createDataFrame([("p", "s", n * 7) for n in range(50)], "project_key string, session_id string, line_no bigint")
    assert sorted((r.line_no, r.ordinal) for r in line_ordinals(df).collect()) == [(n * 7, n) for n in range(50)]


STORY = [
    user("Do it", uuid="1", timestamp="2025-01-01T00:00:00Z"),
    answer([call("Bash", {"command": "x"}, id="t")], uuid="2", parentUuid="1", timestamp="2025-01-01T00:00:01Z"),
    "{broken", user([result("done", id="t")], uuid="3", parentUuid="2", timestamp="2025-01-01T00:00:02Z"),
    user([result("who", id="gone")], uuid="4", timestamp="2025-01-01T00:00:03Z"), user("m", isMeta=True), user("c", isCompactSummary=True),
    answer("agent", isSidechain=True),
]


def test_lake(spark, tmp_path):
    write(tmp_path / "logs", "-home-u-src-x", "s.jsonl", STORY)
    write(tmp_path / "logs", "007", "w.jsonl", [user("Warmup", timestamp="2025-01-02T00:00:00Z")])
    out = str(tmp_path / "lake")
    lake.build_lake(spark, str(tmp_path / "logs"), out)
    read = lambda name: lake.read_table(spark, out, name)
    assert {r.project_key for r in read("sessions").collect()} == {"-home-u-src-x", "007"}
    assert [(r.line_no, r.reason, r.value) for r in lake.read_rejected(spark, out).collect()] == [(2, "not_json", "{broken")]
    assert lake.read_messages(spark, out).where("project_key = '007'").first().kind == "user_prompt"
    assert [r.display_name for r in read("projects").collect()] == ["x"]
    call_row = read("tool_calls").first()
    assert (call_row.preview, call_row.result_line) == ("$ x", 3)
    assert read("tree").where("project_key = '-home-u-src-x'").count() == 7
    write(tmp_path / "numbers", "042", "n.jsonl", [user("x", timestamp="2025-01-02T00:00:00Z")])
    lake.build_lake(spark, str(tmp_path / "numbers"), str(tmp_path / "lake2"))
    assert [r.project_key for r in lake.read_table(spark, str(tmp_path / "lake2"), "tree").collect()] == ["042"]
    plan = read("tree").where("project_key = '007'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_lake_is_brought_up_to_date(spark, tmp_path):
    """New, longer, rewritten and deleted logs are taken up; the others are not even opened."""
    logs, out, fresh = tmp_path / "logs", str(tmp_path / "lake"), str(tmp_path / "fresh")
    for project in ("-a b+c%", "-p", "-q"):
        for n in range(3):
            write(logs, project, f"s{n}.jsonl", [user(f"hello {n}", timestamp="2025-01-01T00:00:00Z"), answer([call("Bash", {"command": "x"}, id="t")])])
    lake.build_lake(spark, str(logs), out)
    assert lake.update_lake(spark, str(logs), out) == 0
    # Unlike content under the same size and time: seen only if the file is opened.
    for path in (logs / "-q" / "s0.jsonl", logs / "-p" / "s2.jsonl"):
        seen = path.stat()
        path.write_text("x" * seen.st_size)
        os.utime(path, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    write(logs, "-p", "s0.jsonl", [user([result("done", id="t")])], "a")
    write(logs, "-p", "new.jsonl", [user("new", timestamp="2025-01-02T00:00:00Z")])
    (logs / "-p" / "s1.jsonl").unlink()
    for n in range(3):
        (logs / "-a b+c%" / f"s{n}.jsonl").unlink()
    assert lake.update_lake(spark, str(logs), out) == 2
    for path in (logs / "-q" / "s0.jsonl", logs / "-p" / "s2.jsonl"):
        write(logs, path.parent.name, path.name, [user(f"hello {path.stem[1:]}", timestamp="2025-01-01T00:00:00Z"), answer([call("Bash", {"command": "x"}, id="t")])])
    lake.build_lake(spark, str(logs), fresh)
    for name in ("records", "tree", "tool_calls", "sessions", "listed_sessions", "projects"):
        rows = [sorted(map(str, lake.read_table(spark, where, name).collect())) for where in (out, fresh)]
        assert rows[0] == rows[1], name
    assert lake.update_lake(spark, str(logs), out) == 2  # their times are new
    for project in ("-p", "-q"):
        for f in (logs / project).iterdir():
            f.unlink()
    assert lake.update_lake(spark, str(logs), out) == 0 and lake.read_table(spark, out, "sessions").count() == 0


def landed(spark, tmp_path, stream, start, **where):
    query = start(stream, checkpoint=str(tmp_path / "state"), trigger={"availableNow": True}, **where)
    query.awaitTermination()


def test_stream_equals_batch(spark, lines_of, tmp_path):
    lines = lines_of({"s": STORY, "t": [user("x"), answer("y", usage={"input_tokens": 3})]})
    bridges.write_logs(lines, str(tmp_path / "chunks"), chunk=2)
    bridges.write_logs(lines, str(tmp_path / "logs"))
    key = lambda df: sorted(map(str, df.collect()))
    shown = ["session_id", "line_no", "tail_kind", "is_agent"]
    want = key(tail.tail_messages(lines).select(shown))
    for name, stream in (
        ("chunks", tail.read_chunks(spark, str(tmp_path / "chunks"), max_files=1)),
        ("logs", tail.read_growing(spark, str(tmp_path / "logs"), startingOffsets="earliest", maxBytesPerTrigger=0)),
    ):
        home = tmp_path / f"tail-{name}"
        landed(spark, home, stream, lambda s, **o: tail.land(s, lambda b: tail.tail_messages(b).select(shown), **o), out=str(home / "out"))
        assert key(spark.read.parquet(str(home / "out")).select(shown)) == want
    home = tmp_path / "stats"
    landed(spark, home, tail.read_chunks(spark, str(tmp_path / "chunks"), max_files=1), tail.land_running_stats, out=str(home / "out"))
    counts = ["session_id", "message_count", "user_prompts", "tool_calls", "continuations", "input_tokens"]
    found = tail.current_stats(tail.read_landed(spark, str(home / "out"), STATS))
    assert key(found.select(counts)) == key(session_table(decode(lines)).select(counts)) == key(tail.running_stats(lines).select(counts))


STATS = (
    "project_key string, session_id string, span bigint, message_count bigint, user_prompts bigint, tool_calls bigint, "
    "continuations bigint, agent_sidechains bigint, input_tokens bigint, output_tokens bigint"
)


@pytest.mark.parametrize("keep", [86_400_000, 1])
def test_every_result_gets_a_name_at_arrival(spark, lines_of, tmp_path, keep):
    """Paired, without a call, without a time, two days late, without an id: all come out, each in the batch it arrives in."""
    rows = [
        answer([call("Bash", {}, id="a"), call("Read", {}, id="late")], timestamp="2025-01-01T00:00:00Z"), user([result("1", id="a")], timestamp="2025-01-01T00:00:01Z"),
        user([result("2", id="gone")], timestamp="2025-01-01T00:00:02Z"), answer([call("Grep", {}, id="c"), call("Lost", {}, id="")]), user([result("3", id="c")]),
        user([result("4", id="late"), result("5", id="")], timestamp="2025-01-03T00:00:00Z"), answer([call("Edit", {}, id="a")]), user([result("6", id="a")]),
    ]
    bridges.write_logs(lines_of({"s": rows, "u": [user([result("7", id="a")])]}), str(tmp_path / "logs"), chunk=2)
    stream = tail.read_chunks(spark, str(tmp_path / "logs"), max_files=1)
    landed(spark, tmp_path, stream, tail.land_result_names, out=str(tmp_path / "out"), keep_ms=keep)
    found = tail.read_landed(spark, str(tmp_path / "out"), names.NAMED).collect()
    got = {(r.session_id, r.line_no, r.tool_id): r.tool_name for r in found}
    forgets = keep == 1
    assert len(found) == len(got) and got == {
        ("s", 1, "a"): "Bash", ("s", 2, "gone"): "result", ("s", 4, "c"): "result" if forgets else "Grep", ("s", 5, "late"): "result" if forgets else "Read",
        ("s", 5, ""): "result", ("s", 7, "a"): "Edit", ("u", 0, "a"): "result",
    }


def test_names_survive_a_restart(spark, tmp_path):
    """A query started again from its checkpoint goes on with the calls it knew, repeats nothing, and reads new lines only."""
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    (logs / "-p").mkdir(parents=True)
    read = []
    for n in range(4):
        write(logs / "-p", "s", f"part-{2 * n}.jsonl", [answer([call(f"Tool{n}", {}, id=f"t{n}")]), user([result("x", id=f"t{max(0, n - 1)}")])])
        query = tail.land_result_names(tail.read_chunks(spark, str(logs)), out, state, trigger={"availableNow": True}, buckets=5)
        query.awaitTermination()
        read.append(sum(p.numInputRows for p in query.recentProgress))
        assert sum(p.stateOperators[0].numRowsTotal for p in query.recentProgress[-1:]) == n + 1
    got = [(r.line_no, r.tool_name) for r in tail.read_landed(spark, out, names.NAMED).orderBy("line_no").collect()]
    assert got == [(1, "Tool0"), (3, "Tool0"), (5, "Tool1"), (7, "Tool2")]
    assert read == [1, 1, 1, 1]  # a chunk is one row of the source
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """Sessions that come one after another, some coming back: the state holds the latest spans, the counts all of them."""
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    (logs / "-p").mkdir(parents=True)
    held = []
    for n in range(6):
        write(logs / "-p", f"s{n}", "part-0.jsonl", [user("a"), answer("b", usage={"input_tokens": 5})])
        write(logs / "-p", "again", f"part-{n}.jsonl", [user("more")])
        query = tail.land_running_stats(tail.read_chunks(spark, str(logs)), out, state, trigger={"availableNow": True}, span="1 second")
        query.awaitTermination()
        held.append(query.lastProgress.stateOperators[0].numRowsTotal)
        time.sleep(1.2)
    assert max(held) <= 6  # two sessions a span
    stats = lambda: {r.session_id: (r.message_count, r.input_tokens) for r in tail.current_stats(tail.read_landed(spark, out, STATS)).collect()}
    want = {**{f"s{n}": (2, 5) for n in range(6)}, "again": (6, 0)}
    assert stats() == want
    tail.fold_landed(spark, out, STATS, tail.last_counters)
    folds = [f for f in os.listdir(out) if not f.startswith(".")]
    assert len(folds) == 1 and stats() == want
    write(logs / "-p", "again", "part-6.jsonl", [user("more")])
    query = tail.land_running_stats(tail.read_chunks(spark, str(logs)), out, state, trigger={"availableNow": True}, span="1 second")
    query.awaitTermination()
    os.makedirs(f"{out}/folded-99")  # one that was cut short
    assert stats() == {**want, "again": (7, 0)}
    tail.fold_landed(spark, out, STATS, tail.last_counters)
    assert stats() == {**want, "again": (7, 0)}


def test_closed_chunks(spark, tmp_path):
    (tmp_path / "logs" / "-p").mkdir(parents=True)
    write(tmp_path / "logs" / "-p", "s", "part-0.jsonl", [user("a")])
    stream = tail.read_chunks(spark, str(tmp_path / "logs"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for round_no in range(2):
        query = tail.land(stream, tail.tail_messages, out, state, trigger={"availableNow": True})
        query.awaitTermination()
        write(tmp_path / "logs" / "-p", "s", f"part-{round_no + 1}.jsonl", [answer("b")])
    got = spark.read.parquet(out).orderBy("batch").collect()
    assert [(r.project_key, r.session_id, r.line_no, r.tail_kind) for r in got] == [("-p", "s", 0, "user"), ("-p", "s", 1, "assistant")]


def test_growing_file(spark, tmp_path):
    """Appended bytes are picked up, an unfinished line waits, a shrunk file is left alone."""
    root = tmp_path / "logs"
    write(root, "-p", "s.jsonl", ["old"])
    write(root, "-p", "agent-z.jsonl", ["side"])
    live = tail.read_growing(spark, str(root)).writeStream.format("memory").queryName("live").trigger(processingTime="100 milliseconds").start()
    try:
        live.processAllAvailable()
        write(root, "-p", "s.jsonl", ["one", "tw"], "a", end="")
        live.processAllAvailable()
        assert [r.value for r in spark.table("live").collect()] == ["one"]
        write(root, "-p", "s.jsonl", ["o", "", "three"], "a")
        write(root, "-q", "new.jsonl", ["first"])
        live.processAllAvailable()
        got = spark.table("live").orderBy("session_id", "line_no").collect()
        assert [(r.session_id, r.line_no, r.value) for r in got] == [("new", 0, "first"), ("s", 1, "one"), ("s", 2, "two"), ("s", 4, "three")]
        (root / "-p" / "s.jsonl").write_text("x\n")
        live.processAllAvailable()
        assert spark.table("live").count() == 4
        (root / "-p" / "s.jsonl").write_text("x\n" + "y" * 60 + "\nlast\n")
        live.processAllAvailable()
        late = [r.value for r in spark.table("live").where("session_id = 's'").collect()][3:]
        assert late and set(late) <= {"x", "y" * 60, "last"}
    finally:
        live.stop()


def test_growing_goes_on_after_a_restart(spark, tmp_path):
    """64 bytes a tick, the query ended and started again in between: every line once, by its number."""
    values = [f"line {n} " + "x" * (n * 10) for n in range(30)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for upto in (9, 30):
        write(tmp_path / "logs", "-p", "s.jsonl", values[:upto])
        stream = tail.read_growing(spark, str(tmp_path / "logs"), str(tmp_path / "index"), startingOffsets="earliest", maxBytesPerTrigger=64 if upto == 9 else 400)
        query = tail.land(stream, lambda lines: lines.select("line_no", "value"), out, state, {"processingTime": "0 seconds"})
        query.processAllAvailable()
        query.stop()
    got = tail.read_landed(spark, out, "line_no bigint, value string").orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == list(enumerate(values))
    assert len({r.batch for r in got}) > 10
    with pytest.raises(Exception, match="index"):
        spark.readStream.format("growing_jsonl").load(str(tmp_path)).writeStream.format("noop").start().awaitTermination()


def test_quarantine_keeps_text(lines_of):
    assert [(r.line_no, r.value) for r in quarantine(lines_of({"s": STORY})).collect()] == [(2, "{broken")]


def test_filters_reach_the_scan(spark, lines_of, tmp_path):
    """A filter on the keys passes the parse; columns nobody asks for are not read."""
    lines_of({"s": STORY}).write.parquet(str(tmp_path / "lines"))
    recs = decode(spark.read.parquet(str(tmp_path / "lines"))).where("project_key = '-p' and type = 'user'").select("session_id")
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(project_key,-p)" in plan
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1
    assert "$.cwd" not in plan


def test_jobs_leave_nothing_behind(spark, tmp_path):
    from threadloom import session
    from threadloom.plans import catalog

    def staged():
        folder = session._stage_folder(spark)
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = staged()
    write(tmp_path / "logs", "-home-u-src-x", "s.jsonl", STORY)
    lake.build_lake(spark, str(tmp_path / "logs"), str(tmp_path / "lake"))
    with session.scratch(spark):
        catalog.QUERIES["export_markdown"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        catalog.QUERIES["tail_chunks"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        assert staged() != before
    assert staged() == before


def test_shared_folder(spark):
    """The session names it; a cluster without the setting is refused, a local session stays beside its own tables."""
    from types import SimpleNamespace

    from threadloom import session

    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    conf = SimpleNamespace(get=lambda name, default=None: {"spark.sql.warehouse.dir": "file:/w/"}.get(name, default))
    made = lambda master: session.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    assert made("local[4]") == "file:/w/_stages"
    with pytest.raises(RuntimeError):
        made("spark://host:7077")


def test_staged_files_are_dropped(spark):
    from threadloom import session

    staged = session.stage(spark.range(5).toDF("n"))
    path = staged.inputFiles()[0].removeprefix("file:")
    assert staged.count() == 5 and os.path.exists(path)
    session.drop_stages(spark)
    assert not os.path.exists(path)
