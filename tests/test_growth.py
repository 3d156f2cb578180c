"""What grows with the input must not grow faster than it: tasks, listings and files of a tail."""

import os
import random

import pytest

from test_sources import grown, ticks, write
from threadloom.operators import views
from threadloom.plans import catalog
from threadloom.sources import transcripts
from threadloom.streaming import chunks, growing, tail


def many(tmp_path, n=300):
    for k in range(n):
        write(tmp_path / "logs", f"-p{k % 5}", f"s{k}.jsonl", [f"{k} first", f"{k} second"])


def rows_of(reader, spans):
    return sorted((session, n, value) for span in spans for _, session, n, value in reader.read(span))


WHOLE = sorted((f"s{k}", n, f"{k} {w}") for k in range(300) for n, w in enumerate(("first", "second")))


def test_a_task_reads_many_short_logs(tmp_path):
    many(tmp_path)
    reader = grown(tmp_path, maxBytesPerTrigger="0")
    spans, _ = ticks(reader, reader.initialOffset())
    assert len(spans) <= 4  # three hundred with a task per log
    assert rows_of(reader, spans) == WHOLE


def test_weights_of_tasks():
    small, large = growing.Span("s", 0, 1000), growing.Span("l", 0, 1 << 30)
    tasks = growing.dealt([large, *[small] * 5000, large])
    assert tasks[0] is large and tasks[-1] is large
    held = [len(t.spans) for t in tasks[1:-1]]
    assert sum(held) == 5000 and 2 <= len(held) <= 25
    assert growing.dealt([]) == []


def test_capped_ticks_list_once(tmp_path, monkeypatch):
    """A backlog is listed once, its ticks stay within the cap, and all sizes are written no more often than they change."""
    many(tmp_path)
    calls, real = [], growing.list_logs
    monkeypatch.setattr(growing, "list_logs", lambda root: calls.append(root) or real(root))
    reader = grown(tmp_path, maxBytesPerTrigger="40")
    offset, got, n = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != offset:
        spans = reader.partitions(offset, end)
        inside = [s for t in spans for s in getattr(t, "spans", [t])]
        assert sum(s.stop - s.start for s in inside) <= 40
        got += rows_of(reader, spans)
        reader.commit(offset)
        offset, n = end, n + 1
    assert n > 100 and len(calls) <= 3 and sorted(got) == WHOLE
    assert grown(tmp_path).manifests.sizes == reader.manifests.sizes
    whole = [f for f in os.listdir(tmp_path / "index" / "offsets") if f.endswith(".whole.json")]
    assert len(whole) == 1


@pytest.mark.parametrize("gone", [False, True])
def test_a_log_that_shrinks_while_it_waits(tmp_path, gone):
    for name in ("a", "b"):
        write(tmp_path / "logs", "-p", f"{name}.jsonl", ["x" * 9] * 4)
    reader = grown(tmp_path, maxBytesPerTrigger="40")
    offset = reader.initialOffset()
    end = reader.latestOffset()
    assert rows_of(reader, reader.partitions(offset, end)) == [("a", n, "x" * 9) for n in range(4)]
    path = tmp_path / "logs" / "-p" / "b.jsonl"
    path.unlink() if gone else path.write_text("y\n")
    spans, end = ticks(reader, end)
    assert rows_of(reader, spans) == ([] if gone else [("b", 0, "y")])
    path.write_text("z" * 3 + "\nlast\n")
    spans, end = ticks(reader, end)
    assert [r[1:] for r in rows_of(reader, spans)][-1] == (1, "last")


def test_a_tick_of_counters_opens_few_stores(spark, tmp_path):
    """A query of its own settings: few partitions of state, and the log of files taken is not written whole every tenth tick."""
    (tmp_path / "logs" / "-p").mkdir(parents=True)
    for n in range(12):
        write(tmp_path / "logs" / "-p", f"s{n}", "part-0.jsonl", ['{"type":"user","message":{"content":"x"}}'])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        stream = tail.read_chunks(spark, str(tmp_path / "logs"), max_files=1)
        query = tail.land_running_stats(stream, str(tmp_path / "out"), str(tmp_path / "state"), trigger={"availableNow": True})
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    progress = [p for p in query.recentProgress if p.numInputRows]
    assert len(progress) == 12 and {p.stateOperators[0].numShufflePartitions for p in progress} == {12}
    assert not [f for f in os.listdir(tmp_path / "state" / "sources" / "0") if f.endswith(".compact")]


def test_chunks_by_index(spark, tmp_path):
    """Two chunks a tick, the query started again: every chunk once, a late one of a lower number and a name with a space too."""
    root, index, out, state = tmp_path / "logs", str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "state")

    def put(session: str, *numbers: int) -> None:
        (root / "-p" / session).mkdir(parents=True, exist_ok=True)
        for n in numbers:
            (root / "-p" / session / f"part-{n:08d}.jsonl").write_text(f"line {n}\nline {n + 1}\n")

    def run() -> None:
        stream = tail.read_chunks(spark, str(root), max_files=2, index=index)
        query = tail.land(stream.where("value != ''"), lambda lines: lines, out, state, {"processingTime": "0 seconds"})
        query.processAllAvailable()
        query.stop()

    put("s", 0, 2, 6, 8)
    put("a b", 10)
    (root / "-p" / "s" / "_part-4.jsonl").write_text("hidden")
    (root / "-p" / "s" / ".part-4.jsonl").write_text("hidden")
    run()
    put("s", 4, 10)
    run()
    run()
    schema = "project_key string, session_id string, line_no bigint, value string"
    landed = tail.read_landed(spark, out, schema)
    got = sorted((r.session_id, r.line_no, r.value) for r in landed.collect())
    assert got == sorted([("s", n, f"line {n}") for n in range(12)] + [("a b", n, f"line {n}") for n in (10, 11)])
    assert max(r["count"] for r in landed.groupBy("batch").count().collect()) == 4  # two chunks of two lines


def test_chunk_offsets_stay_small(tmp_path):
    """Ticks before the last state written whole are deleted, and a new reader knows all that was given out."""
    log, given = chunks.ChunkLog(str(tmp_path)), []
    for n in range(300):
        some = [f"-p/s{n}/part-{k}.jsonl" for k in range(40)]
        given += some
        log.advance(some)
        log.forget(log.number - 1)  # a tick is committed once the next one has begun
    assert len(os.listdir(tmp_path / "chunks")) < 3 * chunks.WHOLE
    again = chunks.ChunkLog(str(tmp_path))
    assert again.number == 300 and len(again.given) == len(given) == 12_000
    assert again.given.new([*given[:50], "-p/s/new.jsonl", *given[-50:]]) == ["-p/s/new.jsonl"]
    assert len(again.given.dump()) == chunks.PRINT * len(given)


def test_chunk_queries_list_no_files_on_the_heap(spark, monkeypatch):
    """Spark's file source, which does, is not what the registered queries read chunks by."""
    seen = []
    monkeypatch.setattr(tail, "replay", lambda stream, *a, **k: seen.append(stream._jdf.queryExecution().logical().toString()) or spark.createDataFrame([], catalog._STATS + ", batch bigint"))
    for name in ("tail_chunks", "tail_running_stats"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("FileSource" not in plan and "closed_chunks" in plan for plan in seen)


def test_local_checkpoints_start_no_processes(spark, tmp_path):
    """The tick's files on a local disk are written without the file manager that starts processes; the session keeps its settings."""
    (tmp_path / "logs" / "-p").mkdir(parents=True)
    (tmp_path / "logs" / "-p" / "s.jsonl").write_text("a\n")
    used = []

    def apply(lines):
        used.append(lines.sparkSession.conf.get(tail.FILE_MANAGER, None))
        return lines

    stream = tail.read_growing(spark, str(tmp_path / "logs"), startingOffsets="earliest")
    tail.land(stream, apply, str(tmp_path / "out"), str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    assert used and set(used) == {tail.LOCAL_SETTINGS[tail.FILE_MANAGER]} and spark.conf.get(tail.FILE_MANAGER, None) is None


def test_logs_are_listed_some_projects_at_a_time(spark, tmp_path, monkeypatch):
    """One read never lists all projects, which it would keep on the driver; lines, numbers and logs are the same."""
    many(tmp_path, 40)
    for hidden in (".trash", "_tmp"):
        write(tmp_path / "logs", hidden, "s.jsonl", ["hidden"])
    write(tmp_path / "logs", "-p0", "agent-s0.jsonl", ["side"])
    write(tmp_path / "logs" / "-p0", "deeper", "s.jsonl", ["deeper"])
    root = str(tmp_path / "logs")

    def found():
        lines = transcripts.scan_transcripts(spark, root).drop("file_path").collect()
        return sorted(lines), sorted(transcripts.list_logs(spark, root).drop("modified").collect())

    whole = found()
    assert len(whole[0]) == 80 and len(whole[1]) == 40 and {r.line_no for r in whole[0]} == {0, 1}
    monkeypatch.setattr(transcripts, "FILES_AT_ONCE", 20)
    groups = transcripts._groups(spark, root, None, None)
    assert [len(g) for g in groups] == [2, 2, 1]  # ten things in the first project, eight in each other
    assert found() == whole
    assert [len(g) for g in transcripts._groups(spark, root, None, [r.path for r in whole[1]])] == [20, 20]
    assert sorted(transcripts.scan_transcripts(spark, root, only=[r.path for r in whole[1]]).drop("file_path").collect()) == whole[0]


@pytest.mark.parametrize("block", [1, 2, 3, 512])
def test_chunks_are_chained_in_blocks(spark, monkeypatch, block):
    """The chain of a session's segments is cut into blocks, so that no array grows with the session; gaps of whole segments and blocks lie between."""
    monkeypatch.setattr(views, "SEGMENTS_PER_BLOCK", block)
    rng, rows, want, size = random.Random(block), [], [], 4
    for session in range(12):
        there = [p for p in range(200) if (p // 23 + session) % 3 and rng.random() < 0.4]
        opened = 0
        for p in there:
            rows.append(("-p", f"s{session}", p, "user_prompt", True))
            if p - opened >= size:
                opened = p
                want.append((f"s{session}", p))
    index = spark.createDataFrame(rows, "project_key string, session_id string, dfs_pos bigint, kind string, reachable boolean")
    got = views.chunk_starts(index, size, 5).select("session_id", "dfs_pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)
