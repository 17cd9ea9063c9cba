"""Evaluation texts leaking into training text, by a generalised suffix automaton of the test items.

The items' words go into one automaton; the words of a document are streamed through it, and the length of the longest
run that some item holds is tracked at every word. Runs of at least `min_words` are leaks.
Words are runs of letters and digits, lower-cased; what stands between them is ignored. Items shorter than `min_words`
cannot leak. Null or empty texts and items hold nothing. Repeated items and documents give the same rows once.

The automaton is as large as the items (2 states a word at most). Items over `shard_words` words are split into several
automata. They are built, sent and released one after the other, so what the driver and a task hold is bounded whatever
the number of items; the corpus is read once for each. An item of more words than that is one automaton of its own size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.session import materialise

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


class Automaton:
    """Generalised suffix automaton over word ids. items: of each state, the items that hold its longest string."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        pairs: set[int] = set()
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in words(text or "")]
            if len(w) < min_words:
                continue
            pairs.update(a << 32 | b for a, b in zip(w, w[1:]))
            last = 0
            for c in w:
                last = self._extend(last, c, ends)
                ends[last].add(item)
        self.pairs = np.array(sorted(pairs), np.int64)
        for s in sorted(range(len(ends)), key=self.length.__getitem__, reverse=True):
            if self.link[s] >= 0 and self.length[self.link[s]] >= min_words:
                ends[self.link[s]] |= ends[s]
        self.items = {s: tuple(sorted(e)) for s, (e, n) in enumerate(zip(ends, self.length)) if n >= min_words and e}
        self._freeze()

    def _freeze(self) -> None:
        """Most states have one way on: it goes into arrays, the others into one dictionary."""
        self.word, self.to, self.ways = array("i"), array("i"), {}
        for s, follow in enumerate(self.next):
            c, q = next(iter(follow.items()), (-1, 0))
            self.word.append(c)
            self.to.append(q)
            if len(follow) > 1:
                self.ways.update({s << 32 | c: q for c, q in follow.items()})
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def step(self, state: int, c: int) -> int:
        """The state after c, -1 if there is none."""
        return self.to[state] if self.word[state] == c else self.ways.get(state << 32 | c, -1)

    def _new(self, length: int, link: int, follow: dict[int, int], ends: list[set[int]]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int, ends: list[set[int]]) -> int:
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this string already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        new, p = self._new(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return new

    def candidates(self, w: list[str]) -> list[tuple[int, int]]:
        """Stretches [i, j) whose neighbouring words all stand side by side in some item; no leak lies outside."""
        m = self.min_words
        if len(w) < m or not len(self.pairs):
            return []
        get = self.vocab.get
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        out = []
        for i, j in zip(known[::2].tolist(), known[1::2].tolist()):
            if j - i < m:
                continue
            code = ids[i : j - 1] << 32 | ids[i + 1 : j]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            runs = np.flatnonzero(np.diff(np.concatenate(([False], self.pairs[at] == code, [False])).astype(np.int8)))
            out += [(i + a, i + b + 1) for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()) if b - a + 1 >= m]
        return out

    def spans(self, w: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Items to their longest run in the words w, and the words' spans [i, j) that some item holds."""
        longest: dict[int, int] = {}
        spans: list[tuple[int, int]] = []
        m = self.min_words
        for i, j in self.candidates(w):
            state = size = 0
            for k in range(i, j):
                c = self.vocab[w[k]]
                after = self.step(state, c)
                while state and after < 0:
                    state = self.link[state]
                    size = self.length[state]
                    after = self.step(state, c)
                if after >= 0:
                    state = after
                    size += 1
                if size >= m:
                    if spans and spans[-1][1] >= k + 1 - size:
                        spans[-1] = (min(spans[-1][0], k + 1 - size), k + 1)
                    else:
                        spans.append((k + 1 - size, k + 1))
                    s, n = state, size
                    while s > 0 and n >= m:
                        for x in self.items.get(s, ()):
                            if longest.get(x, 0) < n:
                                longest[x] = n
                        s = self.link[s]
                        n = self.length[s]
        return longest, spans


def shards(items: DataFrame, min_words: int, shard_words: int) -> tuple[int, Iterator[Automaton]]:
    """How many automata there are, and one after the other; the driver holds one shard's items at a time."""
    clean = items.select("item_id", "item_text").where("item_id is not null and item_text is not null").distinct()
    total = clean.agg(F.sum(F.size(F.split("item_text", r"\s+")))).first()[0] or 0
    n = -(-total // shard_words) or 1
    return n, (Automaton([tuple(r) for r in clean.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").collect()], min_words) for k in range(n))


def _scan(docs: DataFrame, items: DataFrame, min_words: int, shard_words: int, found, schema: str) -> DataFrame:
    """The rows that found(automaton, doc_id, text) gives of every document and automaton."""
    spark = docs.sparkSession
    n, automata = shards(items, min_words, shard_words)
    out = None
    for a in automata:
        held = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names = [x.split()[0] for x in schema.split(", ")]
            for b in batches:
                yield pd.DataFrame([r for d, t in zip(b["doc_id"], b["text"]) for r in found(held.value, d, t)], columns=names)

        part = docs.where("text is not null").select("doc_id", "text").mapInPandas(run, schema)
        if n > 1:
            part = materialise(part)
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 13, shard_words: int = 250_000) -> DataFrame:
    """docs (doc_id, text), items (item_id, item_text) to (doc_id, item_id, longest): the longest common run in words."""
    kind, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    found = lambda a, doc, text: [(doc, i, n) for i, n in a.spans(words(text))[0].items()]
    rows = _scan(docs, items, min_words, shard_words, found, f"doc_id {kind}, item_id {item}, longest int")
    return rows.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def _cut(text: str, found: list[tuple[int, int]], max_words: int, max_share: float) -> tuple:
    """(text without the spans, spans, words in them, words, dropped)."""
    at = [m.span() for m in WORD.finditer(text)]
    spans: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if spans and i <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(j, spans[-1][1]))
        else:
            spans.append((i, j))
    leaked = sum(j - i for i, j in spans)
    drop = any(j - i > max_words for i, j in spans) or leaked > max_share * max(1, len(at))
    kept, end = [], 0
    for i, j in spans:
        kept.append(text[end : at[i][0]])
        end = at[j - 1][1]
    return None if drop else "".join([*kept, text[end:]]), len(spans), leaked, len(at), drop


def remove_leaks(docs: DataFrame, items: DataFrame, min_words: int = 13, max_words: int = 50, max_share: float = 0.5, shard_words: int = 250_000) -> DataFrame:
    """docs (doc_id, text) to (doc_id, text, n_spans, leaked_words, n_words, dropped).

    Every leaked span is cut out of the text. A document is dropped (its text is null) if one span is longer than
    `max_words` or the spans hold more than `max_share` of its words. Documents without a leak come out as they are.
    With one automaton the texts are cut as they stream by. With several the spans of each are written down and brought
    to the documents by a join, in which only few documents have a partner.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text", "n_spans", "leaked_words", "n_words", "dropped"]
    n, automata = shards(items, min_words, shard_words)
    if n == 1:
        held = docs.sparkSession.sparkContext.broadcast(next(automata))
        rows = docs.select("doc_id", "text", F.lit(None).cast("array<array<int>>").alias("spans"))
    else:
        held = None
        found = lambda a, doc, text: [(doc, text_key(text), i, j) for i, j in a.spans(words(text))[1]]
        spans = _scan(docs, items, min_words, shard_words, found, f"doc_id {kind}, k long, i int, j int").distinct()
        spans = materialise(spans.groupBy("doc_id", "k").agg(F.collect_list(F.array("i", "j")).alias("spans")))
        rows = docs.select("doc_id", "text", _keys("text").alias("k")).join(spans, ["doc_id", "k"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, given in zip(b["doc_id"], b["text"], b["spans"]):
                if isinstance(text, str):
                    found = held.value.spans(words(text))[1] if held else [] if given is None else [tuple(map(int, x)) for x in given]
                    out.append((doc, *_cut(text, found, max_words, max_share)))
                else:
                    out.append((doc, None, 0, 0, 0, False))
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, f"doc_id {kind}, text string, n_spans int, leaked_words int, n_words int, dropped boolean")


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _keys(column: str):
    @F.pandas_udf("long")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([text_key(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return keys(column)
