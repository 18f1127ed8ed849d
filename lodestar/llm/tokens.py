"""The public byte-level BPE of 50,257 ids.

tiktoken gives the ids of the tokenizers file several times faster from the same ranks (tests compare them); texts that
hold a special token's string, and any that tiktoken refuses, go through the tokenizers library itself.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

#: Strings that the tokenizers file maps to one special id.
SPECIAL = "<|endoftext|>"


@functools.cache
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, json_path: str, ranks_path: str, special: bool = True) -> np.ndarray:
    """Ids of text, no special tokens added; with special=False the string of a special token is ordinary text."""
    if not special or SPECIAL not in text:
        try:
            return np.asarray(_fast(ranks_path).encode_ordinary(text), np.uint32)
        except (ValueError, RuntimeError):
            pass
    t = _exact(json_path)
    t.encode_special_tokens = not special
    return np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
