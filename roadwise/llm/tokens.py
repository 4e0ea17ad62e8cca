"""Byte-level BPE ids of whole texts, from vocabulary files named by path.

The ids are those of ``tokenizers`` for the JSON file with add_special_tokens=False. The
``tiktoken`` file holds the same vocabulary as ranks and is about four times as fast; the
two agree on every code point (tests/llm/test_operators.py). Very long texts go to the
``tokenizers`` library, whose word pattern cannot run out of stack.
"""

from __future__ import annotations

import base64
import json
import os
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

LONG_TEXT = 1_000_000  # code points
# Word pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    def __init__(self, json_path: str, ranks_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.json_path = json_path
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def library(self) -> Tokenizer:
        """The vocabulary in the tokenizers library, loaded when a text needs it."""
        t = Tokenizer.from_file(self.json_path)
        t.no_truncation()
        t.no_padding()
        return t

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if len(text) > LONG_TEXT:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode(text, allowed_special="all"), dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_tokens(json_path: str, ranks_path: str) -> ByteTokens:
    return ByteTokens(json_path, ranks_path)
