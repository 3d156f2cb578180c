"""Relative parsing, centroid tables and collocations, against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import catalog, collocations, phrase_filter, relative_parse, scalar_tables
from threadloom.llm.text import coded_words, texts_of

SMALL = "/root/testdata/sf0.001"


# Relative parsing


def removed_words(rows, width):
    """Per row: words, and those outside of windows that start in a text of a smaller id."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = {}
    for i, w in words:
        for s in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[s : s + width])
            low[key] = min(low.get(key, i), i)
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1 if i is not None else 0):
            if low[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        yield i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)


def parsed(frame, **more):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in relative_parse.without_duplicates(frame, **more).collect())


def shared_passages(seed):
    """Texts that copy stretches of each other, with changed words, boundaries inside anchors, and runs of one word."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randint(0, 30 if n % 3 else 500)}" for _ in range(rng.randint(5, 90))] for n in range(12)]
    rows = []
    for n in range(70):
        text = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = f"new{n}"
            a = rng.randint(0, len(part) // 2) if rng.random() < 0.5 else 0
            text += part[a:] + [f"own{n}x{k}" for k in range(rng.randint(0, 6))]
        rows.append((n * 3 % 70, (" \n\t".join if n % 2 else " ".join)(text)))
    rows += [(n, "to " * 200) for n in (3, 71)] + [(72, "to " * 30), (73, None), (74, ""), (75, " \x0b\x0c\r"), (None, " ".join(passages[0] * 3)), (None, "to " * 90)]
    rows += [(2, rows[0][1]), rows[5], rows[5], (76, " ".join(passages[3]) + " \x85\xa0 é漢字 " + " ".join(passages[4]))]
    return rows


@pytest.mark.parametrize("width, anchor", [(20, 6), (50, 16), (12, 11), (8, 8)])
def test_relative_parse(spark, width, anchor):
    rows = shared_passages(width)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, spans int")
    assert parsed(frame, width=width, anchor=anchor) == Counter(removed_words(rows, width))


def test_relative_parse_is_right_with_a_full_filter(spark):
    rows = shared_passages(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert parsed(frame, width=20, anchor=6, bits=6) == Counter(removed_words(rows, 20))


def test_relative_parse_of_long_and_no_texts(spark):
    rng = random.Random(2)
    long = [f"v{rng.randint(0, 900)}" for _ in range(150_000)]
    rows = [(1, " ".join(long[1000:1100])), (2, " ".join(long)), (3, " ".join(long[:60_000])), (0, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in relative_parse.without_duplicates(frame).collect()}
    assert got == {0: (2, 0), 1: (100, 0), 2: (150_000, 100), 3: (60_000, 60_000)}
    assert relative_parse.without_duplicates(frame.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "x " * 60), ("a", "x " * 55)], "name string, body string")
    got = relative_parse.without_duplicates(names, id="name", text="body").collect()
    assert {r.name: r.n_removed for r in got} == {"a": 0, "b": 60}


def test_stretches_cover_every_window_once():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))) for _ in range(20)] + ["z " * 100]
    words = coded_words(texts_of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])))
    found = relative_parse.stretches_of(words, 20, 7)
    windows = Counter((r, f + k) for r, f, n in zip(found.row.tolist(), found.first.tolist(), found.windows.tolist()) for k in range(n))
    assert windows == Counter((r, s) for r, t in enumerate(texts) for s in range(len(t.split()) - 19))


def test_query_of_spans(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op11_relative_parse(spark, SMALL).collect())
    assert got == Counter((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in removed_words(rows, 50))


# Centroid tables


def lloyd(rows, clusters, rounds, dimensions, scale, seed):
    def usable(v):
        return v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)

    def floor(x):
        return max(-(1 << 27), min(1 << 27, int(np.floor(max(-1e9, min(1e9, x)) * scale))))

    kept = [(i, [floor(float(x)) for x in v]) for i, v in rows if usable(v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:clusters]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    return [(i, *place(v)[::-1]) for i, v in kept], centroids


def odd_vectors(n=120, dimensions=6):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(dimensions) * (1 + i % 3)).tolist()) for i in range(n)]
    rows += [(i % 5, rows[i % 7][1]) for i in range(20)]  # repeated ids and vectors
    rows += [(900, None), (901, []), (902, [1.0] * (dimensions - 1)), (903, [None] + [1.0] * (dimensions - 1)), (904, [float("nan")] * dimensions)]
    rows += [(905, [float("inf")] + [0.0] * (dimensions - 1)), (906, [0.0] * dimensions), (None, [0.5] * dimensions), (None, [-0.25] * dimensions), (907, [1e300] * dimensions)]
    return rows


@pytest.mark.parametrize("clusters, rounds", [(7, 3), (1, 2), (500, 2), (4, 0)])
def test_centroids(spark, clusters, rounds):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    placed, centroids = scalar_tables.cluster(frame, clusters, rounds, dimensions=6, scale=16)
    want, means = lloyd(rows, clusters, rounds, 6, 16, 2)
    assert centroids.tolist() == means
    assert Counter((r.vec_id, r.cluster, r.distance) for r in placed.collect()) == Counter(want)
    sums = Counter()
    for _, k, d in want:
        sums[k] += d
    held = lambda n: n if n < 1 << 63 else None
    got = {r.cluster: (r.cluster_inertia, r.inertia, r.centroid_sha256) for r in scalar_tables.summary(placed, centroids).collect()}
    assert got == {k: (held(sums[k]), held(sum(sums.values())), hashlib.sha256(",".join(map(str, means[k])).encode()).hexdigest()) for k in {k for _, k, _ in want}}


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    placed, centroids = scalar_tables.cluster(frame)
    assert placed.count() == 0 and scalar_tables.summary(placed, centroids).count() == 0


def test_tables_gather_exact_distances():
    rng = np.random.default_rng(1)
    values, centroids = rng.integers(-300, 300, (200, 9)).astype(np.int32), rng.integers(-300, 300, (5, 9))
    assert (scalar_tables.distances(values, centroids) == ((values[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)).all()


# Collocations


def plain_collocations(rows, least, top, longest=4):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(
            g == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (g, q), b in found.items()
        ):
            out.append((lang, score, a, " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked = []
    for lang in total:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        ranked += [(lang, n + 1, p, a, l, r, total[lang], s) for n, (_, s, a, p, l, r) in enumerate(best)]
    return sorted(ranked)


def chatter(seed=1):
    rng = random.Random(seed)
    words = [f"W{n}" for n in range(14)] + ["é", "Éa", "漢字", "a\xa0b", "x\x85", "\x1c"]
    rows = []
    for n in range(160):
        text = "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t", ". ", "\n", "\x0b", "  ", "!?"]) for _ in range(rng.randint(0, 60)))
        if n % 3 == 0:
            text += " in the long run we"
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, None), ("fr", ""), ("de", ". ,"), ("en", "run " * 3000), rows[3], rows[3]]


@pytest.mark.parametrize("least, top, part, bits", [(5, 2000, 3, 16), (30, 7, 8, 16), (8, 2000, 1, 6), (4, 50, 40, 20)])
def test_collocations(spark, least, top, part, bits, monkeypatch):
    rows = chatter()
    frame = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, rank int, grp string").repartition(4)
    counted = collocations.frequent_phrases
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a, **k: counted(*a, **k, bits=bits))
    got = collocations.collocations(frame, least, top, part=part).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, least, top)


def test_tasks_that_hand_on_early(spark):
    frame = spark.createDataFrame([(t, lang or "und") for lang, t in chatter(3)], "text string, grp string").coalesce(1)
    frame = frame.where("text is not null").repartition(7)
    everything = ~phrase_filter.empty(10)
    counts = [{(r.h, r.g): r.a for r in collocations.count_prints(frame, 4, 0, everything, None, 6, gather).collect()} for gather in (10, 3_000_000)]
    assert counts[0] == counts[1] and len(counts[0]) > 100


def test_no_texts(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(frame).count() == 0


def test_words_of_slices_of_batches():
    """Texts that start inside the buffers of a batch."""
    rng = random.Random(1)
    signs = "aA zZ\t\n.,é漢;:!?x\x0b"
    for _ in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 20))]
        start = rng.randint(0, len(texts))
        part = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())[start : start + 9]], ["text"])
        row, piece, code, distinct = collocations.pieces_of(texts_of(part))
        want, pieces = [], 0
        for r, text in enumerate(part.column(0).to_pylist()):
            for p in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
                want += [(r, pieces, w) for w in re.findall(r"[^\x20\x09]+", p)]
                pieces += 1
        got = [(r, p, distinct[c].as_py().decode()) for r, p, c in zip(row.tolist(), piece.tolist(), code.tolist())]
        assert got == want


def test_filter_misses_no_member(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    bitmap = phrase_filter.built(spark.createDataFrame([(int(h),) for h in hashes], "h long"), 16)
    assert phrase_filter.holds(bitmap, hashes.astype(np.int64)).all()
    assert phrase_filter.holds(bitmap, rng.integers(-(1 << 63), (1 << 63) - 1, 5000)).mean() < 0.02
    assert not phrase_filter.built(spark.createDataFrame([], "h long"), 16).any()


def test_a_further_pass_asks_only_where_parts_are_proposed(monkeypatch):
    """It counts what the pass before did not, each phrase once, and works out no second print but of what it counts."""
    from threadloom.llm import collocations as c

    part = pa.RecordBatch.from_pydict({"grp": pa.array(["en"] * 40), "text": pa.array(["a b c d e. a b x%d y%d c d" % (n, n) for n in range(40)])})
    words = c.words_of(part)

    def holding(*frequent):
        bitmap = c.phrase_filter.empty(16)
        for _, h, _ in frequent:
            for place in c.phrase_filter._places(h, 16):
                np.bitwise_or.at(bitmap, (place >> np.uint64(3)).astype(int), np.left_shift(1, (place & np.uint64(7)).astype(int)).astype(np.uint8))
        return bitmap

    singles = [x for x in c._candidates(words, 3, c.phrase_filter.empty(16), None) if x[0] == 1]
    often = [(n, h[np.isin(h, [v for v, k in zip(*np.unique(h, return_counts=True)) if k >= 40])], None) for n, h, _ in singles]
    before = holding(*often)
    first = list(c._candidates(words, 3, before, None))
    proposed = before | holding(*[x for x in first if x[0] == 2])
    asked, worked = [], []
    real, second = c.phrase_filter.holds, c.Prints.second
    monkeypatch.setattr(c.phrase_filter, "holds", lambda bitmap, h: asked.append(len(h)) or real(bitmap, h))
    monkeypatch.setattr(c.Prints, "second", lambda self, n, at: worked.append(len(at)) or second(self, n, at))
    further = list(c._candidates(words, 3, proposed, before))
    counted = {(h, g) for _, hs, gs in first for h, g in zip(hs.tolist(), gs.tolist())}
    added = [(h, g) for _, hs, gs in further for h, g in zip(hs.tolist(), gs.tolist())]
    assert added and not counted & set(added)
    assert sum(worked) == len(added)
    assert sum(asked) < 3 * len(words.code)


@pytest.mark.parametrize("few, passes", [(0.25, 2), (0.0, 4)])
def test_few_failures_are_followed_up_in_one_pass(spark, monkeypatch, few, passes):
    """The sample missed a word with all its phrases: one closing pass counts them at every length, or one pass per length where they are many."""
    rng = random.Random(4)
    rows = [("en", " ".join(f"w{rng.randint(0, 5)}" for _ in range(60))) for _ in range(60)] + [("en", "missed in the run. a b missed in c")] * 40
    frame = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(3)
    propose, count, calls = collocations.sampled_proposal, collocations.count_prints, []
    monkeypatch.setattr(collocations, "sampled_proposal", lambda texts, *a: propose(texts.where("text not like '%missed%'"), *a))
    monkeypatch.setattr(collocations, "FEW", few, raising=False)
    monkeypatch.setattr(collocations, "count_prints", lambda *a, **k: calls.append(a[2]) or count(*a, **k))
    got = collocations.collocations(frame, 20, 2000, part=1).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 20, 2000)
    assert any(r.phrase == "missed in the run" for r in got)
    assert calls.count(0) == passes
