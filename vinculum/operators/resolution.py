"""Entity resolution: type groups, similarity, ordered greedy clusters, merge, upsert.

Entities: entity_id, entity_text, entity_type, confidence, document_ids array<string>, ord (their order).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.constants import BOOSTED_TYPES, DEFAULT_THRESHOLD, THRESHOLDS, TYPE_GROUPS
from vinculum.functions.columns import canonical_form
from vinculum.functions.similarity import lcs_pairs, ngrams, ratio, tfidf_matrix, token_set
from vinculum.operators.components import connected_components
from vinculum.operators.skew import salted_join
from vinculum.session import materialise

#: Texts of a block. Every block of a type group meets every other one of it, so the size changes no result.
BLOCK_TEXTS = 1_000
#: The n-grams most frequent in a type group that its texts are compared by; tfidf_matrix() has the same number.
VOCABULARY = 1_000
#: Records of a list that meets another one in near_matches(), and of the part of it that is bounded at once; no result depends on them.
LIST_RECORDS, TILE_RECORDS = 4_000, 2_000


def parent_type(kind: Column) -> Column:
    pairs = [x for p, cs in TYPE_GROUPS.items() for c in cs for x in (F.lit(c), F.lit(p))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def _at_most(left: list[str], right: list[str]) -> np.ndarray:
    """Upper bounds of .4 Indel ratio + .3 token set ratio, from letter counts and shared words."""
    letters = {c: i for i, c in enumerate(sorted(set("".join(left)) | set("".join(right))))}

    def count(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), max(1, len(letters))), np.float32)
        for i, t in enumerate(texts):
            for c in t:
                out[i, letters[c]] += 1
        return out

    def words(texts: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            for w in set(t.split()):
                out.setdefault(w, []).append(i)
        return out

    # without a shared word the sorted words are compared; sorting changes spaces only
    spaces = lambda texts: np.array([len(t) - len(" ".join(t.split())) + 1 for t in texts], np.float32)
    x, y = count(left), count(right)
    both = np.zeros((len(left), len(right)), np.float32)
    for k in range(x.shape[1]):
        i, j = np.flatnonzero(x[:, k]), np.flatnonzero(y[:, k])
        if len(i) and len(j):
            both[np.ix_(i, j)] += np.minimum(x[i, k][:, None], y[j, k][None, :])
    size = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :]
    total = np.maximum(1, size)
    r = np.where(size > 0, 2 * both / total, 1.0)
    share = np.zeros(r.shape, bool)
    other = words(right)
    for w, own in words(left).items():
        if w in other:
            share[np.ix_(own, other[w])] = True
    a, b = spaces(left)[:, None], spaces(right)[None, :]
    loose = np.minimum(1.0, 2 * (both + np.minimum(a, b)) / np.maximum(1, total - 2 * np.maximum(a, b)))
    return 0.4 * r + 0.3 * np.where(share, 1.0, loose)


def similarity(texts: list[str], confidence: np.ndarray, group: str, floor: float = -1.0) -> np.ndarray:
    """.3 TF-IDF + .4 Indel ratio + .3 token set ratio, raised for some types, times the mean confidence.

    Pairs whose upper bound is under `floor` are 0; the others are exact.
    """
    m = tfidf_matrix(texts)
    out = 0.3 * (m @ m.T)
    mean = (confidence[:, None] + confidence[None, :]) / 2
    boost = 1.2 if group in BOOSTED_TYPES else 1.0
    most = np.minimum((out + _at_most(texts, texts)) * boost, 1.0 if boost > 1 else np.inf) * mean
    need = np.triu(most >= floor - 1e-6, 1)
    for i, j in zip(*np.nonzero(need)):
        out[i, j] += 0.4 * ratio(texts[i], texts[j]) / 100 + 0.3 * token_set(texts[i], texts[j]) / 100
    out = np.where(need, np.minimum(out * boost, 1.0 if boost > 1 else np.inf) * mean, 0.0)
    return out + out.T


def greedy(sim: np.ndarray, threshold: float) -> list[int]:
    """Clusters in order: a record opens one, and later ones join it, in one sweep, if like any member so far."""
    n = len(sim)
    owner = [-1] * n
    for i in range(n):
        if owner[i] >= 0:
            continue
        owner[i], members = i, [i]
        for j in range(i + 1, n):
            if owner[j] < 0 and sim[j, members].max() >= threshold:
                owner[j] = i
                members.append(j)
    return owner


def grouped(entities: DataFrame) -> DataFrame:
    """Adds grp and key, a number of the row."""
    return materialise(entities.withColumn("grp", parent_type(F.col("entity_type"))).withColumn("key", F.monotonically_increasing_id()))


def _threshold() -> Column:
    pairs = [F.lit(x) for p in THRESHOLDS.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("grp")), F.lit(DEFAULT_THRESHOLD))


def _vocabularies(rows: DataFrame) -> dict[str, tuple[dict[str, int], np.ndarray]]:
    """Of each type group, its n-grams with their places, and their idf, from all its rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple[str, str], list[int]] = {}
            for g, t, n in zip(b["grp"], b["entity_text"], b["n"]):
                for x, k in ngrams(t).items():
                    have = out.setdefault((g, x), [0, 0])
                    have[0] += k * n
                    have[1] += n
            yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["grp", "gram", "total", "df"])

    texts = rows.groupBy("grp", "entity_text").agg(F.count("*").alias("n"))
    grams = texts.mapInPandas(count, "grp string, gram string, total long, df long").groupBy("grp", "gram").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("total"), "gram"))
    kept = grams.withColumn("r", first).where(F.col("r") <= VOCABULARY).toPandas()
    size = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    out = {g: ({}, np.zeros(1)) for g in size}
    for g, b in kept.groupby("grp"):
        out[g] = ({x: i for i, x in enumerate(b["gram"])}, np.log((1 + size[g]) / (1 + b["df"].to_numpy(float))) + 1)
    return out


def _weights(texts: list[str], vocab: dict[str, int], idf: np.ndarray) -> np.ndarray:
    m = np.zeros((len(texts), len(idf)))
    for i, t in enumerate(texts):
        for x, n in ngrams(t).items():
            if x in vocab:
                m[i, vocab[x]] = n
    m *= idf
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _like_texts(rows: DataFrame) -> DataFrame:
    """(grp, s, t, alike): texts of a type group whose likeness, before the mean confidence, may reach its threshold.

    All pairs are bounded, block by block, and those whose bound reaches the threshold are computed. A text is paired
    with itself as well.
    """
    rows = rows.where("entity_text is not null and confidence is not null and grp is not null")
    vocab = rows.sparkSession.sparkContext.broadcast(_vocabularies(rows))
    texts = rows.groupBy("grp", "entity_text").agg(F.max("confidence").alias("most"))
    best = rows.groupBy("grp").agg(F.max("confidence").alias("best"))
    # a text whose mean confidence with any other is under the threshold has no pair
    texts = materialise(texts.join(F.broadcast(best), "grp").where((F.col("most") + F.col("best")) / 2 >= _threshold() - 1e-6).drop("best"))
    blocks = texts.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("entity_text"), F.col("n")).cast("int")
    spread = texts.join(F.broadcast(blocks), "grp").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("grp", "entity_text", "most", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        g, x, y = b["grp"].iat[0], b["x"].iat[0], b["y"].iat[0]
        left, right = b[b["own"] == x], b[b["own"] == y]
        s, t = left["entity_text"].tolist(), right["entity_text"].tolist()
        if not s or not t:
            return pd.DataFrame({"grp": [], "s": [], "t": [], "alike": []}, dtype=object)
        floor, boost = THRESHOLDS.get(g, DEFAULT_THRESHOLD), 1.2 if g in BOOSTED_TYPES else 1.0
        cap = 1.0 if boost > 1 else np.inf
        cos = 0.3 * (_weights(s, *vocab.value[g]) @ _weights(t, *vocab.value[g]).T)
        mean = (left["most"].to_numpy()[:, None] + right["most"].to_numpy()[None, :]) / 2
        need = np.minimum((cos + _at_most(s, t)) * boost, cap) * mean >= floor - 1e-5
        i, j = np.nonzero(np.triu(need) if x == y else need)
        alike = np.array([min((cos[a, c] + 0.4 * ratio(s[a], t[c]) / 100 + 0.3 * token_set(s[a], t[c]) / 100) * boost, cap) for a, c in zip(i, j)], float)
        keep = alike * mean[i, j] >= floor
        i, j, alike = i[keep], j[keep], alike[keep]
        return pd.DataFrame({"grp": [g] * len(i), "s": [s[a] for a in i], "t": [t[c] for c in j]}, dtype=object).assign(alike=alike)

    return spread.groupBy("grp", "x", "y").applyInPandas(run, "grp string, s string, t string, alike double")


def _alike(like: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs of rows (grp, entity_text, confidence and cols, as a_ and b_) of texts that are alike, with their similarity."""
    side = lambda p, t: rows.select("grp", F.col("entity_text").alias(t), F.col("confidence").alias(f"{p}_confidence"), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    met = like.join(side("a", "s"), ["grp", "s"]).join(side("b", "t"), ["grp", "t"])
    return met.withColumn("similarity", F.col("alike") * ((F.col("a_confidence") + F.col("b_confidence")) / 2)).where(F.col("similarity") >= _threshold())


def similar_pairs(entities: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs of a type group at its threshold; id_a comes first in order."""
    rows = grouped(entities)
    at = lambda p: F.struct(F.col(f"{p}_ord"), F.col(f"{p}_key"))
    met = _alike(_like_texts(rows), rows, ["entity_id", "ord", "key"]).where((F.col("s") != F.col("t")) | (at("a") < at("b")))
    first = at("a") < at("b")
    pick = lambda c, x, y: F.when(first, F.col(x)).otherwise(F.col(y)).alias(c)
    return met.select(pick("id_a", "a_entity_id", "b_entity_id"), pick("id_b", "b_entity_id", "a_entity_id"), "similarity")


def greedy_classes(cls: list[int], links: dict[int, set[int]]) -> list[int]:
    """greedy() of rows of classes, in order, where rows are alike if their classes are linked."""
    at: dict[int, list[int]] = {}
    for i, c in enumerate(cls):
        at.setdefault(c, []).append(i)
    owner, free = [-1] * len(cls), 0
    while free < len(cls):
        if owner[free] >= 0:
            free += 1
            continue
        owner[free], queue, liked = free, [], set()
        now = free
        while True:
            for c in links.get(cls[now], ()):
                if c not in liked:
                    liked.add(c)
                    for j in at[c]:
                        if j > now and owner[j] < 0:
                            heapq.heappush(queue, j)
            if not queue:
                break
            now = heapq.heappop(queue)
            owner[now] = free
    return owner


def clusters(entities: DataFrame) -> DataFrame:
    """(entity_id, cluster_id): the id of the cluster's first record.

    Clusters are taken in order inside the connected parts of the pairs, which none crosses. Records of a type group
    with equal text and confidence are one class there.
    """
    rows = grouped(entities)
    same = ["grp", "entity_text", "confidence"]
    classes = materialise(rows.groupBy(*same).agg(F.min("key").alias("cls")))
    links = materialise(_alike(_like_texts(rows), classes, ["cls"]).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")))
    part = connected_components(links.where("a <> b")).select(F.col("id").alias("cls"), "component")
    linked = links.select(F.col("a").alias("cls")).union(links.select("b")).distinct()
    part = materialise(linked.join(part, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")))
    rows = rows.select("entity_id", "ord", "key", *same).join(classes.withColumnsRenamed({c: f"c_{c}" for c in same}), F.expr(" and ".join(f"{c} <=> c_{c}" for c in same))).select("entity_id", "ord", "key", "cls")
    rows = materialise(rows.join(part, "cls", "left"))
    bucket = F.pmod(F.xxhash64("component"), F.lit(1024)).alias("bucket")

    def run(b: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        to: dict[int, set[int]] = {}
        for x, y in zip(pairs["a"], pairs["b"]):
            to.setdefault(x, set()).add(y)
            to.setdefault(y, set()).add(x)
        ids, first = [], []
        for _, own in b.sort_values(["ord", "key"]).groupby("component", sort=False):
            name = own["entity_id"].tolist()
            ids += name
            first += [name[i] for i in greedy_classes(own["cls"].tolist(), to)]
        return pd.DataFrame({"entity_id": ids, "cluster_id": first}, dtype=object)

    own = rows.where("component is not null").select(bucket, "component", "entity_id", "ord", "key", "cls").groupBy("bucket")
    pairs = links.join(part.withColumnRenamed("cls", "a"), "a").select(bucket, "a", "b").groupBy("bucket")
    met = own.cogroup(pairs).applyInPandas(run, "entity_id string, cluster_id string")
    return met.unionByName(rows.where("component is null").select("entity_id", F.col("entity_id").alias("cluster_id")))


def cluster_components(entities: DataFrame) -> DataFrame:
    """As clusters(), but of everything that pairs link, in any order: for groups of any size."""
    pairs = similar_pairs(entities).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    comp = connected_components(pairs).select(F.col("id").alias("entity_id"), "component")
    return entities.select("entity_id").join(comp, "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("cluster_id"))


def merge(entities: DataFrame, cluster: DataFrame) -> DataFrame:
    """One record per cluster: the canonical id has the greatest confidence, then length, then comes first."""
    e = entities.join(cluster, "entity_id").withColumn("grp", parent_type(F.col("entity_type")))
    often = e.groupBy("cluster_id", "entity_text").agg(F.count("*").alias("freq"))
    e = e.join(often, ["cluster_id", "entity_text"])
    size, spaces = F.length("entity_text"), F.length("entity_text") - F.length(F.replace("entity_text", F.lit(" "), F.lit("")))
    rank = F.when(F.col("grp").isin("COURT", "JUDGE"), F.struct(size.alias("x"), spaces.alias("y"))).when(F.col("grp") == "PARTY", F.struct(spaces.alias("x"), F.lit(0).alias("y"))).otherwise(F.struct(F.col("freq").cast("int").alias("x"), size.alias("y")))
    out = e.groupBy("cluster_id").agg(
        F.max_by("entity_id", F.struct("confidence", size.alias("n"), (-F.col("ord")).alias("o"))).alias("canonical_id"),
        F.max_by("entity_text", F.struct(rank.alias("r"), (-F.col("ord")).alias("o"))).alias("canonical_text"),
        F.min_by("entity_type", "ord").alias("entity_type"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_merged"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("document_ids")))).alias("document_ids"),
    )
    return out


def mappings(cluster: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of the records merged away."""
    return cluster.join(merged.select("cluster_id", "canonical_id"), "cluster_id").where("entity_id <> canonical_id").select("entity_id", "canonical_id")


def cross_document(entities: DataFrame) -> DataFrame:
    """(entity_id, document_ids) of entities whose canonical form occurs in more than one document."""
    form = canonical_form(F.col("entity_text"))
    docs = entities.select(form.alias("form"), F.explode("document_ids").alias("d")).groupBy("form").agg(F.sort_array(F.collect_set("d")).alias("document_ids")).where(F.size("document_ids") > 1)
    return entities.select("entity_id", form.alias("form")).join(docs, "form").select("entity_id", "document_ids")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class _Meeting:
    """Two lists of texts: how many letters and whole words their pairs have in common, and what their ratios are at most."""

    def __init__(self, left: list[str], right: list[str]):
        self.own = [[set(t.split()) for t in texts] for texts in (left, right)]
        k = len(left)
        self.n = np.array([len(t) for t in (*left, *right)], np.float32)
        self.n_words = np.array([len(w) for words in self.own for w in words], np.float32)
        # letters of the words, one more for each
        self.size = np.array([sum(map(len, ws)) + len(ws) for words in self.own for ws in words], np.float32)
        # whitespace and other characters of the texts
        codes = np.frombuffer("".join((*left, *right)).encode("utf-32-le"), np.uint32)
        chars, at = np.unique(codes, return_inverse=True)
        row = np.repeat(np.arange(len(self.n)), self.n.astype(np.int64))
        blank = np.array([chr(c).isspace() for c in chars], bool)
        counts = np.bincount(row * len(chars) + at, minlength=len(self.n) * len(chars)).reshape(len(self.n), len(chars))
        self.space, counts = counts[:, blank].sum(axis=1).astype(np.float32), counts[:, ~blank]
        # a letter's first, second and further occurrence: the products of these rows are sums of minima
        most = np.minimum(counts[:k].max(axis=0, initial=0), counts[k:].max(axis=0, initial=0))
        held = np.concatenate([np.zeros((len(counts), 0), np.float32), *((counts[:, [c]] > np.arange(m)).astype(np.float32) for c, m in enumerate(most) if m)], axis=1)
        self.x, self.y = held[:k], held[k:]

    def side(self, values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return values[i], values[len(self.x) + j]

    def common(self) -> np.ndarray:
        """Letters of the common words, one more for each."""
        held: list[dict[str, list[int]]] = [{}, {}]
        for h, words in zip(held, self.own):
            for r, ws in enumerate(words):
                for w in ws:
                    h.setdefault(w, []).append(r)
        both = held[0].keys() & held[1].keys()
        # a product of matrices for frequent words
        often = [w for w in both if len(held[0][w]) * len(held[1][w]) > 0.001 * len(self.x) * len(self.y)]
        m = [np.zeros((len(side), len(often)), np.float32) for side in (self.x, self.y)]
        for c, w in enumerate(often):
            m[0][held[0][w], c], m[1][held[1][w], c] = len(w) + 1, 1
        out = m[0] @ m[1].T
        for w in both.difference(often):
            out[np.ix_(held[0][w], held[1][w])] += len(w) + 1
        return out

    def most(self, i: np.ndarray, j: np.ndarray, both: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds, 0 to 1, of the Indel ratio and of the token set ratio of pairs with their common letters and words."""
        both, common = both.astype(float), common.astype(float)
        minimum = lambda v: np.minimum(*self.side(v, i, j))
        total = sum(self.side(self.n, i, j)).astype(float)
        indel = np.where(total > 0, 2 * (both + minimum(self.space)) / np.maximum(1, total), 1.0)
        a, b = self.side(self.size, i, j)
        token = 2 * (both + minimum(self.n_words)) / np.maximum(1, (a + b).astype(float) - 2)
        token = np.maximum(token, np.where(common > 0, 2 * (common - 1) / np.maximum(1, common + np.minimum(a, b) - 2), 0.0))
        return indel, np.where((common > 0) & ((common == a) | (common == b)), 1.0, np.minimum(token, 1.0))

    def reach(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bounds of the ratios) of the pairs whose bounds have a mean of `threshold` and more."""
        k = len(self.x)
        # by letters: spaces and words count as the greater number of both, lengths as the smaller one, so that one product tells
        ends = np.maximum(self.space, self.n_words)[:, None] > np.arange(max(self.space.max(initial=0), self.n_words.max(initial=0)))
        length = np.minimum(self.n, np.maximum(self.size - 1, 0))[:, None] * np.float32(threshold / 2)
        one = np.ones_like(length)
        x = np.concatenate([self.x, ends[:k].astype(np.float32), -length[:k], one[:k]], axis=1)
        y = np.concatenate([self.y, ends[k:].astype(np.float32), one[k:], -length[k:]], axis=1)
        need = x @ y.T >= -1e-3
        # by words: what is in common has to be this long beside the shorter side
        common, least = self.common(), 2 * threshold - 1
        if common.any():
            size = np.maximum(((2 + least * (self.size - 2)) / max(2 - least, 1e-9) - 1e-3), 0.5).astype(np.float32)
            need |= common >= size[:k, None]
            need |= common >= size[None, k:]
        i, j = np.nonzero(need)
        both = np.concatenate([np.zeros(0, np.float32), *((self.x[i[p : p + 100_000]] * self.y[j[p : p + 100_000]]).sum(axis=1) for p in range(0, len(i), 100_000))])
        indel, token = self.most(i, j, both, common[i, j])
        keep = indel + token >= 2 * threshold - 1e-6
        return i[keep], j[keep], indel[keep], token[keep]


def _may_match(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds, 0 to 1, of the Indel ratio and of the token set ratio of all pairs."""
    m = _Meeting(left, right)
    return m.most(np.arange(len(left))[:, None], np.arange(len(right))[None, :], m.x @ m.y.T, m.common())


def _near(left: list[str], right: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of the pairs at the threshold: of those whose bounds reach it first the Indel ratio is computed."""
    i, j, _, token = _Meeting(left, right).reach(threshold)
    n = np.array([len(t) for t in left])[i] + np.array([len(t) for t in right])[j]
    indel = np.where(n > 0, 2 * lcs_pairs(left, right, i, j) / np.maximum(1, n), 1.0)
    keep = indel + token >= 2 * threshold - 1e-6
    out = [(x, y, (ratio(left[x], right[y]) + token_set(left[x], right[y])) / 200) for x, y in zip(i[keep].tolist(), j[keep].tolist())]
    return [x for x in out if x[2] >= threshold]


def near_matches(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """new and old (entity_id, entity_text, entity_type) to the pairs of one type (entity_id, match_id, similarity).

    Similarity is the mean of the Indel and the token set ratio of the lower-cased texts, 0 to 1. Every new record meets
    every old one of its type, in lists of about LIST_RECORDS; only pairs whose bound reaches the threshold are computed.
    """

    def lists(df: DataFrame, c: str, t: str) -> DataFrame:
        df = materialise(df.where("entity_text is not null").select("entity_type", F.col("entity_id").alias(c), F.lower("entity_text").alias(t)))
        parts = df.groupBy("entity_type").agg(F.ceil(F.count("*") / LIST_RECORDS).alias("k"))
        own = salted_join(df, parts, "entity_type", F.col(c), "inner").withColumn("part", F.pmod(F.xxhash64(c), F.col("k")))
        own = own.groupBy("entity_type", "part").agg(F.collect_list(F.struct(c, t)).alias("x"))
        return materialise(own.select("entity_type", F.col(f"x.{c}").alias(c), F.col(f"x.{t}").alias(t)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, s, others, t in zip(batch["entity_id"], batch["s"], batch["match_id"], batch["t"]):
                for x in range(0, len(s), TILE_RECORDS):
                    for y in range(0, len(t), TILE_RECORDS):
                        out += [(ids[x + i], others[y + j], v) for i, j, v in _near(list(s[x : x + TILE_RECORDS]), list(t[y : y + TILE_RECORDS]), threshold)]
            yield pd.DataFrame(out, columns=["entity_id", "match_id", "similarity"])

    left, right = lists(new, "entity_id", "s"), lists(old, "match_id", "t")
    met = left.join(right, "entity_type").select("entity_id", "s", "match_id", "t")
    # few meetings a task, which reads all of its lists at once
    size = lambda df, c: df.groupBy("entity_type").agg(F.count("*").alias(c))
    n = size(left, "a").join(size(right, "b"), "entity_type").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    met = met.repartition(max(4 * new.sparkSession.sparkContext.defaultParallelism, -(-n // 16)))
    return met.mapInPandas(run, "entity_id string, match_id string, similarity double").distinct()


def upsert_actions(new: DataFrame, old: DataFrame, near: DataFrame) -> DataFrame:
    """new (entity_id), old (entity_id), near (entity_id, match_id, similarity) to (entity_id, target_id, action)."""
    best = near.groupBy("entity_id").agg(F.max_by("match_id", F.struct("similarity", "match_id")).alias("match_id"))
    known = old.select("entity_id", F.lit(True).alias("known")).distinct()
    j = new.select("entity_id").distinct().join(known, "entity_id", "left").join(best, "entity_id", "left")
    action = F.when(F.col("known"), "updated").when(F.col("match_id").isNotNull(), "merged").otherwise("created")
    return j.select("entity_id", F.when(F.col("known").isNull() & F.col("match_id").isNotNull(), F.col("match_id")).otherwise(F.col("entity_id")).alias("target_id"), action.alias("action"))
