"""Near-duplicate records with small edits, by a byte-position inverted index with count filtering.

Each text becomes a fingerprint of `positions` bytes: byte i is taken from the smallest value of hash function i over
the text's word shingles, so two texts agree in byte i with (about) the probability of their Jaccard similarity, wherever
the shared words stand; insertions and reordering do no harm. `width` neighbouring bytes and their position form the
keys of an inverted index. The groups of positions that two texts share are tallied, pairs that reach the minimum which
the threshold guarantees (least_matches()) are kept and verified on their whole texts by the exact similarity of their
shingle sets. What is found is exact.

The guarantee is one of probability: missed() is the share of pairs of a similarity that stay under the minimum. With
300 positions in groups of 5 and a minimum of 2 (threshold .6) that is 4.5 % at a similarity of .6, .29 % at .66, .02 % at
.7; at a threshold of .8 the minimum is 7, and 3e-5 of the pairs at .8 are missed. More `positions` miss less.

Texts with equal words are one class and take part once: copies neither lengthen the index's lists nor multiply pairs.
A list longer than `HOT` leaves the sorted walk and is paired in blocks of about `BLOCK`, as many as the list asks for.
Words are runs of ASCII letters and digits, lower-cased. Null texts and texts under `min_words` words take no part.
Repeated rows count once. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.operators.components import connected_components
from vinculum.operators.skew import hot_keys, salted_join
from vinculum.session import materialise

#: Lists longer than HOT are paired in blocks of about BLOCK.
HOT, BLOCK = 64, 1024
#: Share of pairs at the threshold that may stay under the minimum of matches, where that minimum is over 2.
LOSS = 1e-4

_SEPARATE = bytes(c if 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_SEPARATE).split()


class _Hashes(dict):
    """Word to 64-bit hash; forgets when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
_STEPS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def class_of(kind: int, w: list[bytes]) -> int:
    """A hash of the words; its last bit is the kind."""
    h = xxhash.xxh3_64_intdigest(b" ".join(w)) & ~1 | kind
    return h - 2**64 if h >= 2**63 else h


def shingles(text: str, n: int) -> np.ndarray:
    """Hashes of the runs of n words, 64 bits, as they come."""
    return shingles_of(words(text), n)


def shingles_of(w: list[bytes], n: int) -> np.ndarray:
    if len(w) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    m = len(w) - n + 1
    out = h[:m] * _STEPS[0]
    for j in range(1, n):
        out += h[j : j + m] * _STEPS[j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def missed(similarity: float, lists: int, width: int, least: int) -> float:
    """The probability that a pair of this similarity agrees in fewer than `least` of the groups of positions."""
    p = (similarity + (1 - similarity) / 256) ** width
    return sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(least))


def least_matches(threshold: float, lists: int, width: int, loss: float = LOSS) -> int:
    """The greatest minimum that all but `loss` of the pairs at the threshold reach, 2 at least."""
    least = 2
    while least < lists and missed(threshold, lists, width, least + 1) <= loss:
        least += 1
    return least


def _factors(positions: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**31, (positions, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def fingerprint(text: str, n: int, positions: int) -> np.ndarray:
    """`positions` bytes; of a text shorter than a shingle, none."""
    s = (shingles(text, n) >> np.uint64(32)).astype(np.uint32)
    return _fingerprint(s, _factors(positions)) if len(s) else np.empty(0, np.uint8)


def _fingerprint(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), 2**32 - 1, np.uint32)
    for i in range(0, len(s), 1024):  # long texts in blocks
        np.minimum(low, (factors * s[i : i + 1024]).min(axis=1), out=low)
    return ((low >> np.uint32(5)) & np.uint32(255)).astype(np.uint8)


def _postings(n: int, min_words: int, positions: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(positions)
        lists = positions // width
        place = np.arange(lists, dtype=np.int64) << 40
        shift = np.int64(1) << (8 * np.arange(width, dtype=np.int64))
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if len(w) < min_words:
                    continue
                cls = class_of(kind, w)
                if cls in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(cls)
                s = (shingles_of(w, n) >> np.uint64(32)).astype(np.uint32)
                if len(s):
                    f = _fingerprint(s, factors)[: lists * width].reshape(lists, width).astype(np.int64) @ shift
                    keys.append(f + place + (np.int64(cls & 1) << 50))
                    owners.append(cls)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(owners, np.int64), lists))], ["key", "cls"])

    return run


def _pairs(hot: int):
    """Sorted postings (key, cls) to pairs (a, b); the postings of lists longer than `hot` come as (cls, null, key)."""

    def split(k: np.ndarray, c: np.ndarray):
        a, b, hk, hc = [], [], [], []
        if len(k):
            new = np.empty(len(k), bool)
            new[0], new[1:] = True, k[1:] != k[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(k)))
            each = np.repeat(size, size)
            long = each > hot
            hk, hc = k[long], c[long]
            some = (each > 1) & ~long
            k, c = k[some], c[some]
            for d in range(1, hot):
                same = k[d:] == k[:-d]
                if not same.any():
                    break
                a.append(c[:-d][same])
                b.append(c[d:][same])
        cat = lambda x: np.concatenate(x) if len(x) else np.empty(0, np.int64)
        return cat(a), cat(b), np.asarray(hk, np.int64), np.asarray(hc, np.int64)

    def batch(a, b, hk, hc):
        n, m = len(a), len(hk)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, hc])), pa.array(np.concatenate([b, hc]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([np.zeros(n, np.int64), hk]), mask=np.arange(n + m) < n)], ["a", "b", "key"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ck = cc = np.empty(0, np.int64)
        streaming = None  # the key of a long list that is passed on as it comes
        for x in batches:
            k, c = np.concatenate([ck, x.column(0).to_numpy()]), np.concatenate([cc, x.column(1).to_numpy()])
            if not len(k):
                continue
            keep = np.ones(len(k), bool)
            keep[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c = k[keep], c[keep]
            if streaming is not None:
                own = k == streaming
                if own.any():
                    yield batch(c[:0], c[:0], k[own], c[own])
                if own.all():
                    ck = cc = np.empty(0, np.int64)
                    continue
                k, c, streaming = k[~own], c[~own], None
            cut = int(np.searchsorted(k, k[-1]))
            if len(k) - cut > hot:
                streaming, cut = int(k[-1]), len(k)
            ck, cc = k[cut:], c[cut:]
            yield batch(*split(k[:cut], c[:cut]))
        yield batch(*split(ck, cc))

    return run


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep, sims, last, own = [], [], None, None
            for i, (ca, ta, tb) in enumerate(zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist())):
                if ca != last:
                    last, own = ca, set(shingles(ta, n).tolist())
                other = set(shingles(tb, n).tolist())
                both = len(own & other)
                union = len(own) + len(other) - both
                if union and both >= threshold * union - 1e-9:
                    keep.append(i)
                    sims.append(both / union)
            y = x.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([y.column(0), y.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return run


def _classify(min_words: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep, cls = [], []
            for i, (kind, text) in enumerate(zip(x.column(0).to_pylist(), x.column(2).to_pylist())):
                w = words(text)
                if len(w) >= min_words:
                    keep.append(i)
                    cls.append(class_of(kind, w))
            y = x.take(pa.array(keep, pa.int64()))
            out = {"cls": pa.array(cls, pa.int64()), "id": y.column(1)} | ({"text": y.column(2)} if keep_text else {})
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def classes(texts: DataFrame, min_words: int, keep_text: bool = False) -> DataFrame:
    """(kind 0/1, id, text) to (cls, id[, text]) of the texts with enough words: equal words of one kind have the same cls."""
    rows = texts.where("text is not null and id is not null").select("kind", "id", "text")
    return rows.mapInArrow(_classify(min_words, keep_text), "cls long, id string" + ", text string" * keep_text)


def similar_classes(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, min_words: int = 40, positions: int = 300, width: int = 5, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kind 0/1, id, text) to the pairs of classes (a, b, similarity) and the members (cls, id).

    least: the minimum of groups of positions that a pair shares, by the threshold if not given.
    """
    if not 1 <= width <= 5 or positions // width > 1024 or shingle > 64:
        raise ValueError("near duplicates: width 1 to 5, at most 1024 lists, shingles of at most 64 words")
    min_words = max(min_words, shingle)
    least = least or least_matches(threshold, positions // width, width)
    members = materialise(classes(texts, min_words).distinct())
    rows = texts.where("text is not null and id is not null").select("kind", "text")
    index = rows.mapInArrow(_postings(shingle, min_words, positions, width), "key long, cls long")
    walked = materialise(index.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_pairs(HOT), "a long, b long, key long"))
    hot = walked.where("b is null").select("key", F.col("a").alias("cls"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = dealt.select("key", F.col("cls").alias("a"), F.col("own").alias("x"), F.col("other").alias("y"))
    right = dealt.select("key", F.col("cls").alias("b"), F.col("other").alias("x"), F.col("own").alias("y"))
    more = left.join(right, ["key", "x", "y"]).where("a < b").select("a", "b")
    tally = walked.where("b is not null").select("a", "b").unionByName(more).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pairs = materialise(tally.select("a", "b"))
    # only the first record of each class that has a partner brings its text
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    first = members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")).select("id").distinct()
    brought = texts.where("text is not null").select("kind", "id", "text").join(first, "id", "left_semi")
    chosen = materialise(classes(brought, min_words, True).join(wanted, "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "text"))
    both = pairs.join(chosen.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(chosen.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, threshold), "a long, b long, similarity double"), members


def near_duplicate_pairs(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, min_words: int = 40, **how) -> DataFrame:
    """texts (kind, id, text) to every pair (kind, id_a, id_b) of different ids of one kind, id_a < id_b.

    Pairs of copies are expanded too; near_duplicate_groups() gives the same links in one row per record.
    """
    pairs, members = similar_classes(texts, shingle, threshold, min_words, **how)
    # a class of many copies is split: its members on one side, what they meet copied to every part
    hot = hot_keys(members, "cls")
    m = lambda c: members.select(F.col("cls").alias(c), F.col("id").alias(f"id_{c}"))
    kind = F.col("a").bitwiseAND(F.lit(1)).alias("kind")
    across = salted_join(m("a"), pairs.select("a", "b"), "a", F.col("id_a"), "inner", hot=hot)
    across = salted_join(across, m("b"), "b", F.col("id_a"), "inner", hot=hot).select(kind, "id_a", "id_b")
    within = salted_join(m("a"), members.select(F.col("cls").alias("a"), F.col("id").alias("id_b")), "a", F.col("id_a"), "inner", hot=hot).where("id_a < id_b").select(kind, "id_a", "id_b")
    both = across.unionByName(within).where("id_a <> id_b")
    return both.select(F.col("kind").cast("int").alias("kind"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_groups(texts: DataFrame, shingle: int = 5, threshold: float = 0.8, min_words: int = 40, **how) -> DataFrame:
    """texts (kind, id, text) to one row (kind, id, group_id, n_copies, n_links) per record that has enough words.

    group_id: the smallest id reached by links; n_copies: records with the same words; n_links: other texts that are
    similar enough, each counted once however many copies it has.
    """
    pairs, members = similar_classes(texts, shingle, threshold, min_words, **how)
    pairs = materialise(pairs.select("a", "b"))
    size = members.groupBy("cls").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"))
    links = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).groupBy("cls").agg(F.count("*").alias("n_links"))
    comp = connected_components(pairs).select(F.col("id").alias("cls"), "component")
    named = size.join(comp, "cls", "left").join(links, "cls", "left").select("cls", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "cls").alias("component"), "first_id")
    group = named.groupBy("component").agg(F.min("first_id").alias("group_id"))
    of_class = named.join(group, "component").drop("component", "first_id")
    return members.join(of_class, "cls").select((F.col("cls").bitwiseAND(F.lit(1))).cast("int").alias("kind"), "id", "group_id", "n_copies", "n_links")
