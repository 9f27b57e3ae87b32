"""Token ids of a public byte-level BPE vocabulary, loaded once per Python worker.

The ids are those that the ``tokenizers`` library gives for ``byte_bpe_50k.json``
without added special tokens: the string of its special token inside a text is
that token.  ``tiktoken`` gives the same ids four times faster from the
vocabulary's ranks; its pattern search gives up on very long runs of white
space, and such a text goes through ``tokenizers``.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"  # the same vocabulary as ranks
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=1)
def plain_tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def ranks_path() -> str:
    """Where this machine keeps the vocabulary file; every executor has its own copy."""
    return public_tokenizers.path(RANKS)


def encode(text: str | None, path: str | None = None) -> np.ndarray:
    """uint32 ids of a whole text; null is empty."""
    if not text:
        return np.empty(0, np.uint32)
    try:
        ids = encoder(path or ranks_path()).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the pattern search ran out of stack
        ids = plain_tokenizer().encode(text, add_special_tokens=False).ids
    return np.asarray(ids, np.uint32)
