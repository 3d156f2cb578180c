"""Near-duplicate joins, line spread and the pipeline, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import buckets, components, embedding_dedup, line_spread, ngram_join

FOLDER = "/root/testdata/sf0.001"


def least_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    chain = [(n, n + 1) for n in range(1000, 1040)]
    star = [(5000, n) for n in range(5001, 5400)]
    loose = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    edges = chain + star + loose + [(7, 7), chain[0]]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    index = {x: n for n, x in enumerate(nodes)}
    want = least_of(len(nodes), [(index[a], index[b]) for a, b in edges if a != b])
    assert got == {x: nodes[want[n]] for n, x in enumerate(nodes)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_truth(rows):
    sets = [grams(r.text) for r in rows]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    ]
    return pairs


def variants(seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(120)]
    texts = [" ".join(base)] * 4
    for n in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"new{n}"
        texts.append((" " if n % 2 else "\n").join(words))
    texts += [None, "", "  ", "a b", "a b", "a  b", "b a", "long " * 5000, "long " * 5001, " ".join(base[:60])]
    return texts


@pytest.mark.parametrize("block", [16, 128])
def test_jaccard_links(spark, block):
    rows = [(n, t, 1, "x") for n, t in enumerate(variants())] + [(0, variants()[0], 2, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, size int, key string")
    got = sorted(ngram_join.near_duplicates(documents, block=block).collect(), key=lambda r: r.doc_id)
    given = sorted(documents.collect(), key=lambda r: r.doc_id)
    pairs = jaccard_truth(given)
    degree, root = Counter(x for p in pairs for x in p), least_of(len(given), pairs)
    assert [r.doc_id for r in got] == [r.doc_id for r in given]
    assert [r.n_links for r in got] == [degree[n] for n in range(len(given))]
    assert [r.class_id for r in got] == [given[x].doc_id for x in root]


def test_jaccard_of_null_ids_and_nothing(spark):
    text = " ".join(f"v{n}" for n in range(40))
    rows = [(None, text), (None, text), (3, text), (None, "other words entirely here now"), (None, None)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 3, 2): 2, (3, 3, 2): 1, (None, None, 0): 2})
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95, 1.0):
        bands, rows = ngram_join.choose_bands(threshold, 0.999)
        assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - threshold**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.9999)


def test_roots_inside_a_group():
    rng = np.random.default_rng(0)
    for n in (2, 5, 40, 200):
        left, right = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        assert buckets._roots(np.arange(n), left, right).tolist() == least_of(n, list(zip(left.tolist(), right.tolist())))


def test_vector_links(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 16))
    rows = []
    for n in range(240):
        v = centres[n % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])
        rows.append((n, v.tolist(), int(n % 4)))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], 1), (242, (np.array(rows[0][1]) * 1e200).tolist(), 0), (243, None, 0), (244, [0.0] * 16, 0), (245, [float("nan")] * 16, 0)]
    rows += [(246, [1.0, None], 0), (247, rows[0][1], None), (248, [], 0), (249, [float("inf"), 1.0], 0), (250, [2.0, 2.0], 0), (251, [1.0, 1.0], 0), (240, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, key string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table, block=32, miss=1e-9).collect())
    unit = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            unit[n] = x / np.linalg.norm(x)
    pairs = [
        (a, b) for a in unit for b in unit
        if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    ]
    degree = Counter(x for p in pairs for x in p)
    groups = least_of(len(rows), pairs)
    least = {g: min(rows[n][0] for n in range(len(rows)) if groups[n] == g) for g in set(groups)}
    want = Counter((rows[n][0], degree[n], least[groups[n]], rows[n][0] == least[groups[n]]) for n in range(len(rows)))
    assert got == want
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_vector_recall_and_work_as_rows_grow(spark, monkeypatch):
    """Pairs planted at the threshold are found at every size; for 4 times the rows buckets hold less than half of the square (16 times).

    Both sizes fill the same share of a power of two, so that rounding the logarithm says nothing.
    """
    in_buckets = {}
    made = buckets.bucket_members

    def counted(items, block, block_size):
        members = made(items, block, block_size)
        in_buckets[items.count()] = members.count()
        return members

    monkeypatch.setattr(buckets, "bucket_members", counted)
    rng = np.random.default_rng(4)
    for n in (750, 3000):
        base = rng.normal(size=(n, 64))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        # Every third vector gets a partner at a cosine of 0.93 to 0.95.
        side = rng.normal(size=(n // 3, 64))
        first = base[: n // 3]
        side -= (side * first).sum(axis=1, keepdims=True) * first
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cosine = rng.uniform(0.9301, 0.95, size=(n // 3, 1))
        whole = np.concatenate([base, cosine * first + np.sqrt(1 - cosine**2) * side])
        near = (whole @ whole.T >= 0.93) & ~np.eye(len(whole), dtype=bool)
        table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(whole)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(table).collect()}
        assert all(got[k] <= near[k].sum() for k in got)
        assert sum(got.values()) >= 0.99 * near.sum() and near.sum() >= 2 * (n // 3)
    small, large = (in_buckets[k] for k in sorted(in_buckets))
    assert large < 8 * small, (small, large)


def test_signs_and_tables():
    assert [embedding_dedup.signs_for(n) - embedding_dedup.SPARE for n in (0, 1, 2, 1024, 1025)] == [1, 1, 1, 10, 11]
    for signs in (5, 12, 20):
        tables = embedding_dedup.tables_for(0.93, signs)
        agree = (1 - np.arccos(0.93) / np.pi) ** signs
        assert (1 - agree) ** tables <= embedding_dedup.MISS < (1 - agree) ** (tables - 1)


def test_line_spread(spark):
    site = lambda n: None if n == 3 else f"s{n}"
    rows = []
    for n in range(14):
        own = "\n".join(f"own line {n} {k} with several words" for k in range(6))
        shared = " Subscribe now \t" if n % 2 else "Subscribe now"
        few = "on seven sites" if n < 7 else "elsewhere"
        rows.append((n, f"{shared}\n{own}\n\n{few}\nexact ten\n" if n < 10 else f"{shared}\n{own}\n\n{few}\n", site(n), 1))
    rows += [(20, "Subscribe now", "s1", 1), (21, None, "s2", 2), (22, "", None, 3), (23, "Subscribe now\n" + rows[0][1], "s5", 4), (0, rows[0][1], "s0", 1)]
    rows.append((24, "Subscribe now\n" * 3 + "z" * 300_000, "s5", 4))
    for n, share in enumerate((0.5, 0.6, 0.75, 0.9)):  # furniture makes up this share of the text
        own = "o" * max(1, round(13 * (1 - share) / share))
        rows.append((30 + n, f"Subscribe now\n{own}", "s6", 2))
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, hits int")
    got = Counter((r.row.doc_id, r.text, r.n_lines, r.n_removed) for r in line_spread.without_furniture(documents).collect())
    sites = {}
    for _, text, source, _ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line.strip(" \t\r"), set()).add(source)
    furniture = {k for k, v in sites.items() if k and len(v) >= 10}
    assert furniture == {"Subscribe now", "exact ten"}
    want = Counter()
    for doc, text, _, _ in rows:
        lines = [] if text is None else text.split("\n")
        hits = [line for line in lines if line.strip(" \t\r") in furniture]
        drop = len(hits) < sum(bool(line.strip(" \t\r")) for line in lines) and hits
        want[(doc, "\n".join(x for x in lines if x.strip(" \t\r") not in furniture) if drop else text, len(lines), len(hits) if drop else 0)] += 1
    assert got == want
    assert line_spread.without_furniture(documents.limit(0)).count() == 0


def test_furniture_goes_whatever_its_share(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(n, f"{passage}\nAll rights reserved.\nown words of page {n}\n \nAll rights reserved.", f"s{n}") for n in range(12)]
    rows += [(20, f"{passage}\n\nAll rights reserved.", "s1"), (21, "\tAll rights reserved.\nmine", "s2"), (22, "All rights reserved.", "s3"), (23, " \n", "s3")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: (r.text, r.n_removed) for r in line_spread.without_furniture(documents).collect()}
    want = {n: (f"own words of page {n}\n ", 3) for n in range(12)}
    want |= {20: (rows[12][1], 0), 21: ("mine", 1), 22: (rows[14][1], 0), 23: (" \n", 0)}
    assert got == want


def staged(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)


def odd_documents(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [None, "", "1234 5678", "\n", "the and of " * 3, "w " * 40_000]
    odd = spark.createDataFrame(
        [(10_000 + n, t, None if n % 2 else "en", None, None, "x", 1) for n, t in enumerate(texts)] + [(None, "Words of a row that has no id at all, but says something", None, "s", 1, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long, row string, found_score int",
    )
    copies = given.limit(5)
    return given.unionByName(copies).unionByName(odd, allowMissingColumns=True)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, name):
    docs = odd_documents(spark)
    out = staged(spark, name, docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    kept = out.collect()
    assert 0 < len(kept) <= docs.count()
    assert staged(spark, name, docs.limit(0)).count() == 0
    good = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    if name in ("language_id", "quality_rules"):
        left = {r.doc_id for r in kept}
        clean = [r for r in docs.join(good, "doc_id").collect() if len((r.text or "").split()) >= 10]
        assert sum(r.doc_id in left for r in clean) >= 0.97 * len(clean)


def test_language_stage_rejects_and_fills(spark):
    rows = {r.doc_id: r for r in staged(spark, "language_id", odd_documents(spark)).collect()}
    assert not {10_000, 10_001, 10_002, 10_003} & set(rows) and rows[10_005].lang is not None


UNLEARNED = [
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική και συνείδηση",
    "人 人 生 而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并 应 以 兄弟 关系 的 精神 相 对待",
]


def test_language_stage_rejects_what_was_never_learned(spark):
    rng = random.Random(3)
    strange = UNLEARNED + [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for letters in ("bcdfghjklmnpqrstvwxz", "abcdefghijklmnopqrstuvwxyz") for n in (40, 4000)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mislabelled = given.where("lang = 'es' and n_chars > 400").orderBy("doc_id").limit(1).collect()[0]
    rows = [(90_000 + n, t, None, "s", len(t)) for n, t in enumerate(strange)] + [(91_000, mislabelled.text + " ", "en", "s", 1)]
    left = {r.doc_id: r.lang for r in staged(spark, "language_id", given.unionByName(spark.createDataFrame(rows, given.schema))).collect()}
    assert not {d for d in left if 90_000 <= d < 91_000} and left[91_000] == "es"
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()
    assert sum(r.doc_id in left for r in good) >= 0.99 * len(good)


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    docs = odd_documents(spark).where("doc_id is not null")
    given = sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}, key=lambda r: r[0])
    rows = [type("R", (), {"doc_id": d, "text": t}) for d, t in given]
    root = least_of(len(rows), jaccard_truth(rows))
    kept = sorted(r.doc_id for r in staged(spark, "near_duplicates", docs).collect())
    assert kept == sorted(rows[n].doc_id for n in range(len(rows)) if root[n] == n)


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    def text(n):
        return " ".join(f"{n}w{k}" for k in range(40))

    rows = [
        (None, text(1)), (1, text(1) + " end"), (None, text(2)), (None, text(2)), (None, text(3)), (None, text(3) + " end"),
        (5, text(4)), (5, text(5)), (5, text(5) + " end"), (6, text(5)), (7, text(4)), (8, None), (8, ""), (None, None), (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in staged(spark, "near_duplicates", docs).collect())
    either = [{(None, text(3)), (None, text(3) + " end")}, {(5, text(5)), (5, text(5) + " end")}]
    assert all(sum(kept.pop(m, 0) for m in sorted(group, key=str)) == 1 for group in either)
    assert kept == Counter([(1, text(1) + " end"), (None, text(2)), (5, text(4)), (8, None), (8, ""), (None, None)])


def test_pipeline_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.setdefault(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] += r.length
    assert rows and max(fill.values()) <= 1024
    assert len({r.doc_id for r in rows}) > 80
