"""Packing and chat windows: lossless, within capacity, against the libraries and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import binary_packing, catalog, chat_windows, dominance_packing, vocabularies

SMALL = "/root/testdata/sf0.001"
PATH = vocabularies.default_path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "x y  z\n\n w", "<|endoftext|> a", "漢字 １２ ½", "a\x1cb\x85c\xa0d", "aaaa" * 1200, "word " * 3000, "é́ ̈", "don't 'S", "\n", "12 345",
    "no​space 　 wide", "Ǆ ǅ ſ", "🙂a🙂",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def documents_of(spark):
    rows = [(n, t, 1, "p") for n, t in enumerate(ODD)] + [(1, ODD[1], 2, None), (None, "null id", 3, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, length int, piece string")


def least_sequences(lengths, capacity):
    """Best number of sequences by search, for few pieces."""
    best = [len(lengths)]
    items = sorted(lengths, reverse=True)

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(items):
            best[0] = len(free)
            return
        for k in sorted(set(free)):
            if k >= items[i]:
                at = free.index(k)
                place(i + 1, free[:at] + [k - items[i]] + free[at + 1 :])
        place(i + 1, free + [capacity - items[i]])

    place(0, [])
    return best[0]


def check_plan(lengths, capacity):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    fillings = dominance_packing.plan(histogram, capacity)
    used = {}
    for f in fillings:
        assert f.sequences > 0 and sum(n * k for n, k in f.content) <= capacity
        for n, k in f.content:
            used[n] = used.get(n, 0) + k * f.sequences
    assert used == histogram
    return fillings


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(lengths):
    """After the fixed sets, an optimal packing of the rest is an optimal packing of all."""
    count = [lengths.count(n) for n in range(21)]
    fixed = dominance_packing.reduce_by_dominance(count, 20)
    rest = [n for n in range(21) for _ in range(count[n])]
    assert sum(f.sequences for f in fixed) + (least_sequences(rest, 20) if rest else 0) == least_sequences(lengths, 20)
    check_plan(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_counted_best_fit_equals_best_fit_piece_by_piece(lengths):
    one_by_one = binary_packing.best_fit_decreasing(lengths, 64)
    assert sorted(i for s in one_by_one for i in s) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in s) <= 64 for s in one_by_one)
    counted = dominance_packing.best_fit([lengths.count(n) for n in range(65)], 64)
    assert sum(f.sequences for f in counted) == len(one_by_one)
    check_plan(lengths, 64)


def test_tree_finds_the_least_capacity():
    rng, tree, held = random.Random(0), binary_packing.CapacityTree(100), []
    for _ in range(2000):
        if held and rng.random() < 0.5:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randint(0, 100))
            tree.add(held[-1], 1)
        n = rng.randint(1, 100)
        assert tree.least(n) == min((f for f in held if f >= n), default=-1)


def test_places_cover_every_number_once():
    rng = random.Random(1)
    fillings = check_plan([rng.choice([3, 5, 8, 13, 30, 64]) for _ in range(900)], 64)
    table, rows = dominance_packing.places(fillings), []
    for n in table:
        total = sum(k * f.sequences for f in fillings for m, k in f.content if m == n)
        sequence, offset = dominance_packing.look_up(np.full(total, n), np.arange(total), table)
        rows += [(s, o, n) for s, o in zip(sequence.tolist(), offset.tolist())]
    by = {}
    for s, o, n in sorted(rows):
        assert by.setdefault(s, 0) == o
        by[s] += n
    assert len(by) == sum(f.sequences for f in fillings) and max(by.values()) <= 64


def check_pieces(rows, documents, library):
    """Pieces give every document back, and sequences are gapless."""
    fill, parts = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.setdefault(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] += r.length
        assert fill[r.sequence_id] <= 1024
        parts.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    want = {}
    for d in documents:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want.setdefault(d.doc_id, []).extend((n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    return len(fill)


def test_dominance_packing(spark, library):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = catalog.op9_dominance_packing(spark, SMALL).collect()
    n = check_pieces(rows, documents.collect(), library)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1
    odd = documents_of(spark)
    check_pieces(dominance_packing.pack(odd).collect(), odd.collect(), library)
    assert dominance_packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("window", [3000, 8_000_000])
def test_binary_packing(spark, library, window):
    documents = documents_of(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").limit(40), allowMissingColumns=True)
    got = {}
    ids = set()
    for r in binary_packing.pack(documents, PATH, length=256, window_tokens=window).collect():
        tokens, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(tokens) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.sequence_id not in ids
        ids.add(r.sequence_id)
        assert not tokens[r.n_tokens :].any()
        for doc, piece, a, b in zip(r.ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault(doc, []).append((piece, tokens[a:b].tolist()))
    want = {}
    for d in documents.collect():
        whole = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(d.doc_id, []).append(whole)
    for doc, pieces in got.items():
        texts = want[doc]
        assert sorted(x for _, p in pieces for x in p) == sorted(x for t in texts for x in t)
        if len(texts) == 1:
            assert [x for _, p in sorted(pieces) for x in p] == texts[0]
    assert set(got) == set(want)
    assert binary_packing.pack(documents.limit(0), PATH).count() == 0


CHATS = [
    (1, 0, "system", "Be # brief"), (1, 1, "user", "a \\ b </turn> ### x: y"), (1, 2, "assistant", "fine\n### user: no </turn>\n"), (1, 3, "user", None), (1, 4, "assistant", "\\"),
    (2, 0, "assistant", "only me " * 400), (3, 0, "user", ""), (3, None, None, "null turn"), (3, None, "odd: role\\", "again"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"),
    (None, 0, "user", "no conversation"), (None, 1, "assistant", "still"),
]


def chats(spark, rows=None):
    made = CHATS + [(9, n, "user" if n % 2 else "assistant", f"turn {n} " + "w " * (n % 7)) for n in range(700)] if rows is None else rows
    return spark.createDataFrame([(*r, "x", 1) for r in made], "conv_id long, turn long, role string, text string, window string, at int")


def ordered(rows):
    return sorted(rows, key=lambda r: (r.turn is None, r.turn or 0, r.role or "", r.text or ""))


def test_windows_read_back(spark):
    given = chats(spark)
    windows = chat_windows.format_windows(given, budget=64, history=16)
    turns = chat_windows.parsed_turns(windows["text"])
    read = windows.withColumns({"turns": turns, "masked": chat_windows.masked_texts(windows["text"], windows["loss"])}).collect()
    by = {}
    for r in sorted(read, key=lambda r: r.first_turn):
        by.setdefault(r.conv_id, []).append(r)
    source = {}
    for r in given.collect():
        source.setdefault(r.conv_id, []).append(r)
    assert set(by) == set(source)
    for conv, rows in source.items():
        want = [(r.role or "", r.text or "") for r in ordered(rows)]
        new, masked, at = [], [], 0
        for w in by[conv]:
            shown = [(t.role, t.text) for t in w.turns]
            assert w.first_turn == at and len(shown) == w.n_repeated + w.n_turns
            assert w.n_tokens <= 64 or w.n_turns == 1
            if at:
                has_system = want[0][0] == "system"
                repeated = shown[: w.n_repeated]
                if has_system:
                    assert repeated[0] == want[0]
                rest = repeated[has_system:]
                assert rest == want[at - len(rest) : at]
            new += shown[w.n_repeated :]
            masked += w.masked
            at += w.n_turns
        assert new == want
        assert masked == [t for role, t in want if role == "assistant"]
    assert any(w.n_repeated for w in by[9])


@pytest.mark.parametrize("step", [50, 300, 10**12, None])
def test_windows_do_not_hang_on_turn_numbers(spark, step):
    """Sixty short turns, numbered in steps of any size or not at all (in order of their texts)."""
    def windows(step):
        rows = [(1, None if step is None else n * step, "user", f"{n:02d} some words here") for n in range(60)]
        rows += [(2, 5, "system", "be brief"), *((2, n * (step or 1) + 6, "assistant", f"turn {n:03d}") for n in range(700))]
        given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
        found = chat_windows.format_windows(given, budget=128, history=32).orderBy("conv_id", "first_turn").collect()
        return [(w.conv_id, w.first_turn, w.n_repeated, w.n_turns, w.n_tokens) for w in found]

    got = windows(step)
    assert got == windows(1)
    assert sum(w[3] for w in got if w[0] == 1) == 60 and max(w[3] for w in got if w[0] == 1) > 5


def test_history_may_be_left_out(spark):
    windows = chat_windows.format_windows(chats(spark), budget=64, history=0).collect()
    assert all(w.n_repeated <= 1 for w in windows)
    assert chat_windows.format_windows(chats(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_windows.format_windows(chats(spark), budget=10, history=10)


def test_chat_query(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    source = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in sorted(given, key=lambda r: (r.conv_id, r.turn)):
        source.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in catalog.op5_chat_windows(spark, SMALL).collect()}
    assert set(got) == set(source)
    for conv, turns in source.items():
        r, said = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.formatted_chars > sum(len(t) for _, t in turns)


def test_chat_windows_run_no_python(spark):
    plan = catalog.op5_chat_windows(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
