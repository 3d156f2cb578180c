"""Byte-pair encoding by a prefix-sharing trie walk, and decoding.

A word's encoding is found prefix by prefix. For each prefix only its last
token is kept: it is the one token that ends the prefix and may follow the last token of
what stands before it. Two tokens may follow each other when merging their
joined symbols gives the two tokens back. So the encoding of a prefix is a chain of states,
and every word with that prefix shares it.

The distinct words of a slice are inserted into a trie whose depth-first order is the
order of the sorted words: the states of the current path are kept on a
stack, the next word goes back to where it departs from the one before it, and
only the states below that point are computed. Words are encoded once while a worker remembers
them; texts are then joined from their words. Nothing is shuffled.

Texts are prepared as the vocabulary file says (normaliser, splitting pattern,
special tokens); files with other parts than those of ``word ends`` vocabularies are refused.

Defined results: a null text counts as empty, an empty text has no ids and
decodes to the empty string. Words may be of any length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadloom.llm import vocabularies
from threadloom.llm.text import EncodingTable, coded_words, gather, passed_on, segment_sums, slices, texts_of

#: Code points whose case, composition and classes are the same in all Unicode tables in use.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-İĲ-ǃΑ-ΡΤ-Ωα-ωА-я]*")


class WordVocabulary:
    """Symbols, merges and special tokens of a byte-level vocabulary whose words end in a suffix."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(data.decode())
        config = json.loads(data)
        model = config["model"]
        split = config["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in config["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or config["decoder"] or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
            raise ValueError("not a vocabulary of this kind")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        to_byte, suffix = vocabularies.byte_of_symbol(), model["end_of_word_suffix"]
        self.symbol = [c for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        # Bytes of a token inside a word, or ending it: the token, and which tokens it may follow (-1: word start).
        self.inside: dict[bytes, tuple[int, dict[int, bool]]] = {}
        self.ending: dict[bytes, tuple[int, dict[int, bool]]] = {}
        self.token = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        for token, i in model["vocab"].items():
            table, body = (self.ending, token[: -len(suffix)]) if token.endswith(suffix) else (self.inside, token)
            if body and all(c in to_byte for c in body):
                table[bytes(to_byte[c] for c in body)] = (i, {})
        self.longest = max(map(len, [*self.inside, *self.ending]))
        vocab = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.parts = {i: self._symbols(body, table is self.ending) for table in (self.inside, self.ending) for body, (i, _) in table.items()}
        self.checked = 0
        self.words: dict[bytes, list[int]] = {}

    def _symbols(self, body: bytes, ends: bool) -> list[int]:
        ids = [self.inside[body[i : i + 1]][0] for i in range(len(body))]
        if ends:
            ids[-1] = self.ending[body[-1:]][0]
        return ids

    def merged(self, ids: list[int]) -> list[int]:
        """Merges in order of rank, the leftmost first: the definition itself, for short runs."""
        ids = list(ids)
        while len(ids) > 1:
            found = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, before: int, entry: tuple[int, dict[int, bool]]) -> bool:
        """May the token of ``entry`` stand after ``before`` (-1: at the start of a word)?"""
        token, known = entry
        if self.checked > 1_500_000:
            for table in (self.inside, self.ending):
                for _, pairs in table.values():
                    pairs.clear()
            self.checked = 0
        self.checked += 1
        run = [token] if before < 0 else [before, token]
        known[before] = ok = self.merged([i for t in run for i in self.parts[t]]) == run
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of each word; the sorted words are walked as a trie."""
        out, path = {}, b""
        last, begin = [-1], [0]  # per prefix length: its last token, and where that token begins
        for word in sorted(words):
            shared = len(os.path.commonprefix((path, word[:-1])))
            del last[shared + 1 :], begin[shared + 1 :]
            for stop in range(shared + 1, len(word)):
                self._step(self.inside, word, stop, last, begin)
            path = word[:-1]
            self._step(self.ending, word, len(word), last, begin)
            ids, start = [last.pop()], begin.pop()
            while start:
                ids.append(last[start])
                start = begin[start]
            out[word] = ids[::-1]
        return out

    def _step(self, table: dict, word: bytes, stop: int, last: list[int], begin: list[int]) -> None:
        """Put the last token of ``word[:stop]`` on the stack. Just one token fits, so the likely ones are tried first:
        the token before it grown by a symbol, the new symbol alone, then the rest, longest first."""
        grown, low = begin[-1], max(0, stop - self.longest)
        for start in chain((grown, stop - 1), range(low, stop - 1)):
            entry = table.get(word[start:stop])
            if entry is not None:
                before = last[start]
                ok = entry[1].get(before)
                if ok or ok is None and self.follows(before, entry):
                    last.append(entry[0])
                    begin.append(start)
                    return

    def split(self, chunk: str) -> list[bytes]:
        """The words of a text without special tokens, normalised, as bytes."""
        if PLAIN.fullmatch(chunk):
            found = self.pattern.findall(chunk.lower())
            return [w.encode() for w in found]
        to_byte = vocabularies.byte_of_symbol()
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(to_byte[c] for c in piece) for piece, _ in pieces if piece]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of runs without white space; special tokens are cut out first."""
        plans = []
        for chunk in chunks:
            if "<|" in chunk and self.special_pattern.search(chunk):
                plan, at = [], 0
                for m in self.special_pattern.finditer(chunk):
                    plan += [*self.split(chunk[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                plans.append([*plan, *self.split(chunk[at:])])
            else:
                plans.append(self.split(chunk))
        if len(self.words) > 300_000:
            self.words.clear()
        known = self.words
        new = {w for plan in plans for w in plan if isinstance(w, bytes) and w not in known}
        known.update(self.encode_words(list(new)))
        return [[i for w in plan for i in (known[w] if isinstance(w, bytes) else (w,))] for plan in plans]


class ChunkEncoder:
    """Ids and decoded strings of the distinct runs between white space, kept within bounds."""

    def __init__(self, data: bytes):
        self.vocabulary = WordVocabulary(data)
        self.ids = EncodingTable(self._encode, limit=400_000)
        self.token = np.array([self.vocabulary.token.get(i, "") for i in range(max(self.vocabulary.token) + 1)], object)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.vocabulary.encode_chunks(chunks)
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), "<u4")

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        chunks = coded_words(texts)
        starts, lengths, flat = self.ids.lookup(chunks.distinct.to_pylist())
        per_chunk = lengths[chunks.code]
        ids = gather(starts[chunks.code], per_chunk, flat)
        ends = np.cumsum(segment_sums(per_chunk, chunks.counts)).tolist()
        tokens = self.token[ids].tolist()
        for start, stop in zip([0, *ends], ends):
            yield ids[start:stop], " ".join(tokens[start:stop])


def encode(documents: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """All columns but the text, then ``ids`` (binary, little-endian 32-bit) and ``decoded``.

    With ``digests`` the two are replaced by ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    """
    shared = vocabularies.share_file(documents.sparkSession, vocabulary)
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    others, schema = passed_on(documents, made, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabularies.worker_copy("word ends", shared.value, ChunkEncoder)
        for part in slices(batches, text):
            found = list(encoder.encode(texts_of(part, text)))
            if digests:
                columns = [
                    pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in found], pa.string()),
                ]
            else:
                columns = [pa.array([ids.tobytes() for ids, _ in found], pa.binary()), pa.array([decoded for _, decoded in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], schema.names)

    return documents.mapInArrow(run, schema)
