"""Token counts by a public tokenizer; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import numpy as np

#: File of the vocabulary, and the pattern that splits text before its merges. The folder is a parameter, the
#: environment variable CODEQUARRY_TOKENIZERS, or that of an installed package of public vocabularies.
NAME = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = NAME, folder: str | None = None) -> str:
    """The path of a vocabulary file."""
    folder = folder or os.environ.get("CODEQUARRY_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        if spec is None or not spec.submodule_search_locations:
            raise FileNotFoundError("set CODEQUARRY_TOKENIZERS to the folder of the vocabulary files")
        folder = spec.submodule_search_locations[0]
    return os.path.join(folder, name)


@lru_cache(maxsize=4)
def encoding(path: str):
    """(encoding, bytes of each token) for a rank file; loaded once for each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for k, v in ranks.items():
        size[v] = len(k)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
