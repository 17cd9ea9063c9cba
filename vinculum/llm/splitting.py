"""Splitting oversized items at natural boundaries, balanced.

The fewest pieces that can hold the text are computed, cuts of equal length are aimed at, each is moved to the strongest
boundary nearby (nearest of equals), and if then any piece is over the limit a piece is added and the cuts are aimed
anew. The start of a piece lies `overlap` tokens before the end of the one before it.

Boundaries by strength: blank line, line end, sentence end, clause, white space or a change of word, inside a word. A cut
never falls inside a character: where `overlap` tokens end inside one the overlap grows to its start, or shrinks if that
would repeat a whole piece. The limit holds
for a piece's own tokens, counted again on its text. A single character of more tokens than the limit stays whole.
Items within the limit, null texts and items without a limit give no rows. Null overlaps are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.tokens import TOKENIZER, encoding

# Closing marks in UTF-8 that end a sentence or a clause without a space.
_ENDS = (b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")
_CLAUSES = (b"\xef\xbc\x8c", b"\xef\xbc\x9b", b"\xef\xbc\x9a", b"\xe3\x80\x81")


def strengths(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Strength of a cut before each byte position: 5 blank line, 4 line end, 3 sentence, 2 clause, 1 word, 0 inside one, -1 inside a character."""
    b = np.frombuffer(b"\n\n\n" + raw + b"\n", np.uint8)
    one, two, three, now = (b[at + 3 - k] for k in (1, 2, 3, 0))
    space = lambda x: (x == 32) | (x == 10) | (x == 9) | (x == 13)
    out = np.zeros(len(at), np.int8)
    letter = lambda x: (x > 127) | ((x | 32) >= 97) & ((x | 32) <= 122) | (x >= 48) & (x <= 57)
    out[space(now) | space(one) | (letter(now) != letter(one))] = 1
    shut = np.isin(one, (34, 39, 41, 93)) & np.isin(two, (46, 33, 63))
    out[space(now) & np.isin(one, (44, 59, 58))] = 2
    out[space(now) & (np.isin(one, (46, 33, 63)) | shut)] = 3
    mark = three.astype(np.int32) << 16 | two.astype(np.int32) << 8 | one
    for marks, s in ((_CLAUSES, 2), (_ENDS, 3)):
        out[np.isin(mark, [int.from_bytes(m, "big") for m in marks])] = s
    ended = (now != 10) & (one == 10)
    out[ended] = 4
    out[ended & ((two == 10) | (two == 13) & (three == 10) | space(two) & (three == 10))] = 5
    out[(now & 0xC0) == 0x80] = -1
    return out


def cuts(n: int, limit: int, overlap: int, strength: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Starts and ends, in tokens, of k pieces. strength: of the cut before each token."""
    length = (n + (k - 1) * overlap) / k
    step = length - overlap
    reach = int(min(step * 0.45, limit * 0.2))
    starts, ends = [0], []
    for i in range(1, k):
        aim = int(round(length + (i - 1) * step))
        lo, hi = max(aim - reach, starts[-1] + 1, ends[-1] + 1 if ends else 1), min(aim + reach, n - 1)
        if hi < lo:
            lo = hi = min(max(lo, 1), n - 1)
        near = strength[lo : hi + 1].astype(np.float64) - np.abs(np.arange(lo, hi + 1) - aim) / (4.0 * max(1, n))
        end = lo + int(np.argmax(near))
        ends.append(end)
        start = max(end - overlap, starts[-1] + 1)
        while start > starts[-1] and strength[start] < 0:
            start -= 1
        if start <= starts[-1]:  # a character of more tokens than the overlap: the next one's start, or none shared
            start = next((k for k in range(starts[-1] + 1, end) if strength[k] >= 0), end)
        starts.append(start)
    return starts, [*ends, n]


def split_text(text: str, limit: int, overlap: int, enc, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of each piece; none if the text is within the limit."""
    ids = np.array(enc.encode_ordinary(text), np.int64)
    n = len(ids)
    if n <= limit:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    at = np.concatenate(([0], np.cumsum(size[ids])))
    strength = strengths(raw, at[:-1])
    if len(raw) == len(text):
        chars = at
    else:
        heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        chars = heads[at]
    overlap = max(0, min(overlap, limit - 1))
    k = -(-(n - overlap) // (limit - overlap))
    whole = int((strength >= 0).sum())
    while True:
        starts, ends = cuts(n, limit, overlap, strength, k)
        if all(e - s <= limit for s, e in zip(starts, ends)) and all(strength[e] >= 0 for e in ends[:-1]):
            pieces = [(int(chars[s]), int(chars[e])) for s, e in zip(starts, ends)]
            own, order = {}, sorted(range(k), key=lambda i: starts[i] - ends[i])
            for i in order:  # the longest first, and no more of a try that failed
                own[i] = len(enc.encode_ordinary(text[pieces[i][0] : pieces[i][1]]))
                if own[i] > limit:
                    break
            else:
                own = [own[i] for i in range(k)]
                return [(a, b, t) for (a, b), t in zip(pieces, own)]
        if k >= min(n - overlap, whole) or k > 4 * (n // max(1, limit - overlap) + 4):
            break
        k += 1
    return _hard(text, limit, overlap, at, chars, strength, enc)


def _hard(text: str, limit: int, overlap: int, at: np.ndarray, chars: np.ndarray, strength: np.ndarray, enc) -> list[tuple[int, int, int]]:
    """Where no balanced cut keeps the limit: from the left, the longest piece that does."""
    heads = [i for i in range(len(strength)) if strength[i] >= 0] + [len(strength)]
    out, i = [], 0
    while True:
        j = i + 1
        while j + 1 < len(heads) and heads[j + 1] - heads[i] <= limit:
            j += 1
        while j > i + 1 and len(enc.encode_ordinary(text[chars[heads[i]] : chars[heads[j]]])) > limit:
            j -= 1
        a, b = int(chars[heads[i]]), int(chars[heads[j]])
        out.append((a, b, len(enc.encode_ordinary(text[a:b]))))
        if j == len(heads) - 1:
            return out
        back = j
        while back > i + 1 and heads[j] - heads[back] < overlap:
            back -= 1
        i = back


def split_oversized(docs: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs (doc_id, source, text), limits (source, max_tokens, overlap_tokens) to the pieces of the items over their limit.

    (doc_id, source, piece_no, n_pieces, start_pos, end_pos, tokens, text); positions in characters. A row per source in
    limits; the least limit counts if there are several.
    """
    per = limits.where("source is not null and max_tokens > 0").groupBy("source").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    per = per.select("source", "l.max_tokens", F.coalesce("l.overlap_tokens", F.lit(0)).alias("overlap_tokens"))
    # a token has one byte at least, so shorter texts are within the limit
    over = docs.select("doc_id", "source", "text").join(per, "source").where(F.octet_length("text") > F.col("max_tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, size = encoding(tokenizer)
        for b in batches:
            rows = []
            for doc, source, text, limit, overlap in zip(b["doc_id"], b["source"], b["text"], b["max_tokens"], b["overlap_tokens"]):
                pieces = split_text(text, int(limit), int(overlap), enc, size)
                rows += [(doc, source, i, len(pieces), a, e, t, text[a:e]) for i, (a, e, t) in enumerate(pieces, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "source", "piece_no", "n_pieces", "start_pos", "end_pos", "tokens", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over.select("doc_id", "source", "text", "max_tokens", "overlap_tokens").mapInPandas(run, f"doc_id {kind}, source string, piece_no int, n_pieces int, start_pos int, end_pos int, tokens int, text string")
