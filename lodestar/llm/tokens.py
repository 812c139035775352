"""Token ids of a byte-level BPE vocabulary, fast enough for whole corpora."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Words whose ids one worker remembers; beyond it, it forgets all and starts anew.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64

#: A space before white space or the end: there a space does not begin a token of its own.
ODD_SPACE = re.compile(r" (?:\s|\Z)")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; only its name, where the package of those files is missing."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return name
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranked(vocabulary: str):
    """A tiktoken encoding of the merges in a tokenizers file, with its special tokens."""
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(p): p for p in points} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(points)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(f"byte_bpe:{vocabulary}", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Words(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a space and a word."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(" " + word), "<u4").tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Callable[[str], bytes]:
    """Text to ids as bytes, equal to the tokenizers library's without added special tokens.

    A space that stands before a non-space begins a token, so a text of single spaces is encoded
    word by word from memory; any other text is encoded whole.
    """
    encoding = ranked(vocabulary)
    special = encoding.special_tokens_set
    known = Words(encoding)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        if ODD_SPACE.search(text):
            return np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        first, space, rest = text.partition(" ")
        head = np.array(encoding.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join(map(known.__getitem__, rest.split(" "))) if space else head

    return encode
