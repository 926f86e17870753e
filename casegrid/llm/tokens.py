"""Sizes of texts in tokens of a public tokenizer. Its file's place is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files unless CASEGRID_TOKENIZERS names another.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k.tiktoken"
#: Pieces a text falls into before byte pairs are merged (the public pattern of this vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_path() -> str:
    return os.path.join(os.environ.get("CASEGRID_TOKENIZERS", FOLDER), NAME)


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file of ranks, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Number of tokens; 0 for null and empty texts. Marks of special tokens count as ordinary text."""
    if not text:
        return 0
    own = encoding(path)
    step = 100_000  # very long texts go in parts cut at white space, so that memory stays bounded
    if len(text) <= step:
        return len(own.encode_ordinary(text))
    total, a = 0, 0
    while a < len(text):
        b = min(len(text), a + step)
        while b < len(text) and not text[b].isspace() and b - a < 2 * step:
            b += 1
        total += len(own.encode_ordinary(text[a:b]))
        a = b
    return total
