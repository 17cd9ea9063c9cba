"""Sizes in tokens of a public tokenizer. The vocabulary file's path is a parameter; nothing is trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the length in bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for k, v in ranks.items():
        size[v] = len(k)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def count_tokens(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a text; of null, none."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path)[0].encode_ordinary
        for b in batches:
            yield pd.Series([len(encode(t)) if isinstance(t, str) else 0 for t in b], dtype="int32")

    return count(F.col(text) if isinstance(text, str) else text)
