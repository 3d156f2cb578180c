"""Search and lookup by tables of queries and requests, against the same by lists and against plain Python."""

import random

import numpy as np
import pytest
from conftest import answer, call, result, user
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import many, search, sessions
from threadloom.operators.messages import build_messages
from threadloom.operators.records import decode
from threadloom.operators.tree import build_tree
from threadloom.session import stage


@pytest.fixture(scope="module")
def corpus(spark, lines_of):
    rng = random.Random(6)
    words = ["Alpha", "beta", "gamma ray", "İstanbul", "STRASSE", "straße", "tab\there", "line\nbreak", "a" * 40]

    def talk(n):
        said = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(6)]
        rows = [
            {"type": "summary", "summary": f"About {said[0]}"},
            user(said[1], uuid=f"{n}-1", timestamp=f"2025-01-{n + 1:02d}T00:00:00Z"),
            answer([{"type": "text", "text": said[2]}, call("Bash", {"command": said[3]}, id="t")], uuid=f"{n}-2", parentUuid=f"{n}-1", timestamp=f"2025-01-{n + 1:02d}T00:00:01Z"),
            user([result(said[4], id="t")], uuid=f"{n}-3", parentUuid=f"{n}-2", timestamp=f"2025-01-{n + 1:02d}T00:00:02Z"),
        ]
        return rows

    lines = lines_of({f"{n % 3}ab{n}": talk(n) for n in range(9)}, "-home-u-src-Alpha-one").unionAll(
        lines_of({f"{n % 2}AB{n}": talk(n + 9) for n in range(6)}, "-home-u-src-beta")
    )
    found = decode(lines)
    listed = stage(sessions.listable(sessions.listing_sessions(found)))
    return listed, sessions.project_table(listed), build_tree(found), build_messages(found)


QUERIES = [
    "alpha", "ALPHA", "beta", "a", "ab", "0ab", "ray gamma", "istanbul", "İstanbul", "straße", "strasse", "tab\there", "k\nb", "none", "src/beta",
    "-home-u-src-beta", "about", "a" * 40, "1AB", "",
]


def test_table_and_list_find_the_same(spark, corpus):
    key = lambda df: sorted(map(str, df.collect()))
    table = spark.createDataFrame([(q, n) for n, q in enumerate([*QUERIES, *QUERIES[:4]])], "query string, n int")
    got = many.search_many(*corpus, table)
    assert key(got) == key(search.search_global(*corpus, sorted({q.lower() for q in QUERIES}))) and got.columns == search.HIT_COLUMNS
    first = many.search_many(*corpus, table, limit=2).groupBy("query").count().collect()
    assert max(r["count"] for r in first) == 2
    assert many.search_many(*corpus, table.where("query in ('', 'nowhere')")).count() == 0


@pytest.mark.parametrize("block_queries, block_chars", [(50_000, 1 << 20), (3, 1 << 20), (50_000, 30)])
def test_every_place_by_blocks(spark, block_queries, block_chars):
    rng = random.Random(9)
    queries = sorted({"".join(rng.choice("abé漢 ") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    rows = [(n, None if n % 9 == 0 else "".join(rng.choice("abé漢 \nX") for _ in range(rng.randint(0, 60))), 20 + n % 60) for n in range(120)]
    texts = spark.createDataFrame([(n, t, t, m) for n, t, m in rows], "id long, folded string, shown string, size int").repartition(3)
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    found = many.find_all(texts, asked, ["id"], "folded", "shown", "size", block_queries, block_chars)
    assert sorted((r.id, r.query, r.at) for r in found.collect()) == sorted((n, q, t.find(q)) for n, t, _ in rows if t for q in queries if q in t)
    # Snippets as the column function cuts them.
    joined = found.join(texts.select("id", "shown", "size"), "id").collect()
    for size in {r.size for r in joined}:
        these = [r for r in joined if r.size == size]
        plain = spark.createDataFrame([(n, r.shown, r.query) for n, r in enumerate(these)], "n int, shown string, query string")
        cut = {r.n: r.s for r in plain.select("n", text.snippet(plain["shown"], plain["query"], size).alias("s")).collect()}
        assert [r.snippet for r in these] == [cut[n] for n in range(len(these))]
        break
    assert many.find_all(texts, asked.limit(0), ["id"]).count() == 0
    assert many.find_all(texts.limit(0), asked, ["id"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_grow_with_the_queries(spark, corpus):
    sizes = []
    for n in (2, 2000):
        table = spark.range(n).selectExpr("concat('query ', id) as query")
        sizes.append(len(plan_of(many.search_many(*corpus, table)).splitlines()))
    assert sizes[0] == sizes[1]


REQUESTS = [
    "0", "0a", "0AB", "1ab", "zz", "", "Alpha-one:0ab", "alpha-one:0ab", "beta:", "beta:0AB2", "eta:1AB", "-home-u-src-beta:0", "none:0", ":1ab", "a:b:c",
    "0ab0", "0ab0x", "x" * 300, "ALPHA-ONE:1ab1",
]


def test_lookups(spark, corpus):
    listed, projects = corpus[:2]
    key = lambda df: sorted(map(str, df.collect()))
    asked = spark.createDataFrame([(r,) for r in [*REQUESTS, "0"]], "request string")
    found = many.find_sessions_many(listed, projects, asked)
    assert key(found) == key(sessions.find_sessions(listed, projects, REQUESTS))
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    names = ["alpha", "BETA", "src", "one", "a", "", "-home-u-src-beta", "-HOME-u-src-beta", "nowhere"]
    asked = spark.createDataFrame([(n,) for n in names], "request string")
    assert key(many.find_projects_many(projects, asked)) == key(sessions.find_projects(projects, names))
    assert many.find_sessions_many(listed, projects, asked.limit(0)).count() == 0
    assert many.find_sessions_many(listed.limit(0), projects, asked).count() == 0


def test_the_texts_pass_once_whatever_the_number_of_queries(spark, corpus, monkeypatch):
    """A table larger than a block is looked up in one pass per kind of text, and finds what an automaton finds."""
    table = spark.createDataFrame([(q,) for q in QUERIES], "query string")
    key = lambda df: sorted(map(str, df.collect()))
    few = key(many.search_many(*corpus, table))
    passes = []
    for block in (5, 1):
        monkeypatch.setattr(many, "BLOCK_QUERIES", block)
        texts = corpus[0].select("session_id", "summary")
        passes.append(plan_of(many.find_all(texts, many.folded_queries(table), ["session_id"], "summary", block_queries=block)).count("MapInArrow"))
        assert key(many.search_many(*corpus, table)) == few
    assert len(few) > 50 and passes == [passes[0]] * 2
    # No answer hangs on the bitmap.
    full = many.windows_of(texts.select(F.lit("x").alias("query")).distinct(), 0, 0)._replace(bitmap=np.full(1 << 7, 255, np.uint8))
    monkeypatch.setattr(many, "windows_of", lambda asked, *a: full._replace(queries=stage(asked), sizes=sorted({len(q.lower()) for q in QUERIES if q})))
    assert key(many.search_many(*corpus, table)) == few
