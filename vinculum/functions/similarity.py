"""String similarities that no built-in gives, as Arrow functions: Indel ratio, token set ratio, character n-gram TF-IDF."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer per row."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def lcs_pairs(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lcs(left[i], right[j]) of many pairs: their integers are the rows of one array, if the left text has at most 64 letters."""
    out = np.zeros(len(i), np.int64)
    long = np.array([len(t) > 64 for t in left], bool)[i]
    out[long] = [lcs(left[x], right[y]) for x, y in zip(i[long], j[long])]
    rows, i, j = np.flatnonzero(~long), i[~long], j[~long]
    if not len(i):
        return out
    n = np.array([len(t) for t in (*left, *right)])
    chars, at = np.unique(np.frombuffer("".join((*left, *right)).encode("utf-32-le"), np.uint32), return_inverse=True)
    row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    masks, own = np.zeros((len(left), len(chars) + 1), np.uint64), (row < len(left)) & (place < 64)
    np.bitwise_or.at(masks, (row[own], at[own]), np.uint64(1) << place[own].astype(np.uint64))
    # no left text has the letter that fills up the right ones
    other = row >= len(left)
    texts = np.full((len(right), n[len(left) :].max()), len(chars))
    texts[row[other] - len(left), place[other]] = at[other]
    for k in range(0, len(i), 50_000):
        x, y = i[k : k + 50_000], j[k : k + 50_000]
        s, flat = np.full(len(x), ~np.uint64(0)), x * masks.shape[1]
        for p in range(n[len(left) :][y].max()):
            u = s & masks.ravel()[flat + texts[y, p]]
            s = s + u | s - u
        out[rows[k : k + 50_000]] = 64 - np.bitwise_count(s).astype(np.int64)
    return out


def ratio(a: str, b: str) -> float:
    """100 times the normalised Indel similarity; of two empty strings 100."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def token_set(a: str, b: str) -> float:
    """The best ratio of the common words and of them with each side's rest; 100 if one side's words are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


def _pairwise(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pairwise(token_set)(a, b)


def ngrams(text: str, low: int = 2, high: int = 4) -> Counter:
    """Character n-grams inside words, each word padded by a space on both sides; a word shorter than n counts once."""
    out: Counter = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in range(low, high + 1):
            out.update([w] if len(w) <= n else (w[i : i + n] for i in range(len(w) - n + 1)))
            if len(w) <= n:
                break
    return out


def tfidf_matrix(texts: list[str], most: int = 1000) -> np.ndarray:
    """Rows of unit length over the n-grams most frequent in all texts; idf is ln((1+n)/(1+df))+1."""
    bags = [ngrams(t) for t in texts]
    total: Counter = Counter()
    for b in bags:
        total.update(b)
    vocab = {g: i for i, g in enumerate(sorted(sorted(total), key=lambda g: -total[g])[:most])}
    m = np.zeros((len(texts), max(1, len(vocab))))
    for i, b in enumerate(bags):
        for g, n in b.items():
            if g in vocab:
                m[i, vocab[g]] = n
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(axis=0))) + 1
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
