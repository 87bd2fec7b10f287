"""Byte-level BPE ids for Arrow batches, from a public vocabulary file (never trained here).

A text is cut where an ASCII blank or line feed follows a character that is surely no
white space. No pre-token of this vocabulary's pattern has white space after another
character, so every cut is a pre-token border and pieces encode independently. Equal
pieces of a batch are encoded once, and a bounded cache keeps pieces between batches.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from tandem.llm.textkit import buffers, process_cache

VOCABULARY = "byte_bpe_50k"
CACHE_ENTRIES = 120_000  # about 30 MB


def vocabulary_dir() -> str:
    """The folder of the installed public tokenizers."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{VOCABULARY}.json"))


class Encoder:
    """Encodes texts as the `tokenizers` file does, special strings taken as ordinary text.

    Pieces of ASCII and Latin characters go through the same vocabulary as ranks, which
    is faster and gives the same ids; all others through the `tokenizers` file itself.
    """

    def __init__(self, folder: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.file, self.full = f"{folder}/{VOCABULARY}.json", None
        with open(f"{folder}/{VOCABULARY}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """The ids of a piece, four bytes each."""
        if text.isascii() or max(text) < "ɐ":
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.file)
            self.full.encode_special_tokens = True
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        off, data = buffers(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        before = np.concatenate([np.zeros(2, np.uint8), data[:-1]])
        latin = (before[1:] >= 0x80) & (before[1:] < 0xC0) & (before[:-1] >= 0xC3) & (before[:-1] < 0xE0)
        solid = ((before[1:] > 0x20) & (before[1:] < 0x7F)) | latin
        at = ((data == 0x20) | (data == 0x0A)) & solid
        edge = np.zeros(len(data) + 1, bool)
        edge[:-1] = at
        edge[off] = True
        cuts = np.flatnonzero(edge)
        first = np.searchsorted(cuts, off)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False)
        cache, found = self.cache, []
        for text in pieces.dictionary.to_pylist():
            ids = cache.get(text)
            if ids is None:
                ids = self.piece(text)
                if len(text) < 40 and len(cache) < CACHE_ENTRIES:
                    cache[text] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(size) - size
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[first])


def encoder(folder: str) -> Encoder:
    """One encoder per Python worker and vocabulary folder."""
    held = process_cache().__dict__.setdefault("encoders", {})
    if folder not in held:
        held[folder] = Encoder(folder)
    return held[folder]
