"""Public tokenizers behind one function: whole texts in, arrays of ids out, the same ids on either library.

The vocabulary exists for two libraries. The rank file's is about five times as fast, so texts go there unless
the two could differ: a text that holds the end-of-text string (one special id in the one, ordinary text in the
other) or a character outside Latin letters and common punctuation, where the libraries' Unicode tables might
not agree, goes to the vocabulary file's own library. Tests hold the two against each other.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

NAME = "byte_bpe_50k"
#: Beyond these characters the vocabulary file's own library is used.
FAR = re.compile("[^\x00-\x84\x86-ɏ‐-‧€]|<\\|endoftext\\|>")


@lru_cache(maxsize=4)
def _file_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _rank_tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``vocabulary``: a path without its ending; None for the installed byte-level vocabulary."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers

        self.json = f"{vocabulary}.json" if vocabulary else public_tokenizers.path(f"{NAME}.json")
        self.ranks = f"{vocabulary}.tiktoken" if vocabulary else public_tokenizers.path(f"{NAME}.tiktoken")

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if FAR.search(text):
            return np.array(_file_tokenizer(self.json).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(_rank_tokenizer(self.ranks).encode_ordinary(text), dtype=np.uint32)

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        return _byte_lengths(self.ranks)


@lru_cache(maxsize=4)
def _byte_lengths(path: str) -> np.ndarray:
    tokenizer = _rank_tokenizer(path)
    out = np.zeros(tokenizer.n_vocab + 1, dtype=np.int64)
    for token in tokenizer._mergeable_ranks.items():
        out[token[1]] = len(token[0])
    out[tokenizer.n_vocab] = len("<|endoftext|>")
    return out
