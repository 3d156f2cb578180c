"""Public vocabularies in tasks: the file travels as a broadcast, each worker parses it once.

A vocabulary file is a few megabytes whatever the corpus, so broadcasting it
is bounded; executors need no copy of it on their own disks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from threadloom.llm.text import EncodingTable, process_state

#: Fixed value: the pattern that splits text ahead of the byte-level merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space on which pattern libraries disagree.
SPECIAL_SPACE = r"[\x1c-\x1f\x{80}-\x{a0}]"

#: Letters and digits below this code point have been the same in every Unicode version for a decade.
SETTLED = 0x0530


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def share_file(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def worker_copy(kind: str, data: bytes, build: Callable[[bytes], object]) -> object:
    """What ``build`` makes of the file, kept by this worker for later tasks."""
    state, key = process_state(), (kind, len(data), hash(data))
    if state.get(kind, (None,))[0] != key:
        state[kind] = (key, build(data))
    return state[kind][1]


class ByteLevelEncoder:
    """Token ids of texts under a byte-level BPE vocabulary in the ``tokenizers`` JSON format.

    The same ranks and splitting pattern run in ``tiktoken``, which is four
    times as fast. Texts on which the two libraries could differ or slow down go to
    ``tokenizers`` itself: special tokens, characters beyond the settled
    range, and runs of a thousand characters without a space.
    """

    def __init__(self, data: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(data.decode())
        self.whole.no_truncation()
        self.whole.no_padding()
        config = json.loads(data)
        to_byte = byte_of_symbol()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in config["model"]["vocab"].items() if all(c in to_byte for c in token)}
        self.plain = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t["content"]) for t in config["added_tokens"]]
        self.apart = "|".join([*special, r"\S{1000}", SPECIAL_SPACE])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False)
        return [self._ids(text, odd) for text, odd in zip(texts.to_pylist(), apart.tolist())]

    def _ids(self, text: str, apart: bool) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if apart or not text.isascii() and ord(max(text)) >= SETTLED:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain.encode_to_numpy(text, disallowed_special=())


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class PieceEncoder:
    """Pieces of single words under a sentencepiece model, each word with its own word start."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        size = self.model.get_piece_size()
        self.size = size
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(size)])
        self.table = EncodingTable(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(words, num_threads=1) if words else []
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))
