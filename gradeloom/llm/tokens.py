"""Token ids of a public tokenizer inside tasks; one encoder per Python worker."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Texts of these characters only split the same way in both libraries (a test tries every pair);
#: all others, and those that hold a special token's string, go to ``tokenizers`` itself.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u017f\\u2010-\\u201e\\u2026]*")
#: The two paths also differ on the one special token, which ``tokenizers`` finds inside texts.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def _ranks(path: str):
    """The same vocabulary in tiktoken's format, which encodes the same ids several times faster."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_plain(text: str) -> bool:
    """Whether both libraries give the same ids for this text."""
    return PLAIN.fullmatch(text) is not None and SPECIAL not in text


def token_ids(text: str, path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids that ``tokenizers`` gives for a text, as unsigned 32-bit numbers."""
    if ranks_path and is_plain(text):
        return np.asarray(_ranks(ranks_path).encode_ordinary(text), dtype="<u4")
    return np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_numbers(texts: list[str], path: str, ranks_path: str | None = None) -> list[int]:
    """How many ids ``tokenizers`` gives for each text."""
    plain = [bool(ranks_path) and is_plain(t) for t in texts]
    rest = iter(tokenizer(path).encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
    return [len(_ranks(ranks_path).encode_ordinary(t)) if p else len(next(rest)) for t, p in zip(texts, plain, strict=True)]


@lru_cache(maxsize=4)
def _sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    ranks = _ranks(path)
    return np.array([len(ranks.decode_single_token_bytes(i)) for i in range(ranks.n_vocab)], dtype=np.int64)


def token_starts(text: str, path: str, ranks_path: str | None = None) -> np.ndarray:
    """The code point at which each token of a text starts (for a token inside a code point, that code point)."""
    if not (ranks_path and is_plain(text)):
        return np.array([a for a, _ in tokenizer(path).encode(text, add_special_tokens=False).offsets], dtype=np.int64)
    size = _sizes(ranks_path)[np.asarray(_ranks(ranks_path).encode_ordinary(text), dtype=np.int64)]
    lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    return (np.cumsum(lead) - 1)[np.cumsum(size) - size]
