"""Byte-level BPE ids of texts, from the vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how this vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Gives the ids that the vocabulary's own tokenizer gives, without added special tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        byte_of, self.path = _byte_of(), path
        self.special = [x["content"] for x in said["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in said["model"]["vocab"].items() if piece not in self.special}
        self.fast = tiktoken.Encoding("sievework", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(*ranks.values(), *(x["id"] for x in said["added_tokens"])) + 1
        self.exact = None

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):  # a text may spell a special token, which is one id to the tokenizer
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
