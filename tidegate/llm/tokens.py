"""Token ids of a public byte-level BPE vocabulary, as ``tokenizers`` gives them.

The vocabulary file is read once per Python worker. In such a file a token's id
is its merge rank, so ``tiktoken`` finds the same ids from the same vocabulary,
several times faster; the tests hold the two against each other. Texts that
contain the string of a special token go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable

# Fixed value: the splitting pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, Callable[[str], bytes]] = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable letter: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(shifted)}


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian unsigned 32-bit words, without special tokens added."""
    if path not in _loaded:
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        byte = _byte_of_letter()
        ranks = {bytes(byte[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        ordinary = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> bytes:
            if any(s in text for s in special):
                ids = slow.encode(text, add_special_tokens=False).ids
            else:
                ids = ordinary(text)
            return np.array(ids, "<u4").tobytes()

        _loaded[path] = encode
    return _loaded[path]
