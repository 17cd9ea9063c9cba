"""Personal information inside free text: candidates, boosted trees, typed placeholders.

High-recall generators propose spans of five kinds (email, phone, id_number, address, name), overlapping freely. Boosted
trees score each from its format and its context. Where spans overlap, the one of the greatest score over its kind's
threshold stands. Thresholds are calibrated on candidates the trees have not seen.

There are no labelled texts, so the trees are fitted on candidates that labelling rules are sure about: form fields and
signature lines, addresses of mail that spell the name beside them, labels before numbers on the one side; case names,
organisations, courts, invoices, sections and exhibits on the other. What a rule says nothing about is left to the trees.
They are fitted on the candidates of a random sample of about `SAMPLE` texts (by hash), the only part that does not see all
rows, and of a few made texts with signs that are no mail addresses. Given names that a sure context shows, and words
written small, are counted over all texts in two count-min sketches of a fixed size (`BUCKETS`), which hold every name
and word; a word that is common in small letters is hardly a name where all letters are capitals.

Whole texts are read. Null texts stay null, empty ones empty; repeated rows come out as often as they come in, and count
once in find_personal(). Names inside mail addresses are part of those.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.boosting import Boosted

SAMPLE = 4_000
#: Counters in each of the two rows of a sketch.
BUCKETS = 1 << 18
KINDS = ("email", "phone", "id_number", "address", "name")

# Words that tell what stands beside them.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Hon|Judge|Justice|Rev)"
STREET = r"(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Ln|Lane|Dr|Drive|Ct|Court|Way|Ter|Terrace|Pl|Place|Sq|Square|Pkwy|Parkway|Hwy|Highway|Cir|Circle)"
ORGANISATION = re.compile(r"\b(?:Inc|LLC|L\.L\.C|Ltd|Limited|Corp|Corporation|Co|Company|Court|County|District|Authority|Fund|Partners|Cooperative|Association|Bank|Trust|Board|Department|Agency|University|College|Insurance|Terminal|Rptr|App|Act|Code|Section|Exhibit|Article|Rule|Chapter|Part|Union|Group|Holdings|Council|Commission|City|State|States)\b")
PHONE_LABEL = re.compile(r"(?:phone|tel|mobile|cell|call|text(?:ed)?|fax|reach me on|daytime|weekends|contact)\W*(?:number|no|on|at)?\W*$", re.I)
ID_LABEL = re.compile(r"(?:ssn|itin|soc(?:ial)?\.? ?sec(?:urity)?\.?|passport|licen[cs]e|dl|national id|identity card|id card|taxpayer|identification|tin|whose number is|identified by)\W*(?:number|no|is|id)?\W*(?:number|no)?\W*$", re.I)
OTHER_LABEL = re.compile(r"(?:invoice|docket|section|exhibit|order|case|account|file|policy|claim|numbered|dated|rptr|page|no)\W*(?:number(?:ed)?|no)?\W*$", re.I)
FIELD = re.compile(r"(?:/s/|from:|cc:|bcc:|to:|witness:|signed:|name:|attn:|heir:|\| ?(?:contact|name|client|witness) ?\||\b(?:cc|to): [^\n;]*;)\W*$", re.I)

_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’\-][^\W\d_]+)*"
_INI = r"[A-Z]\."
_GAP = r"[ \t]?\n?[ \t]?"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?)"
_PHONE = re.compile(r"(?<![\w$.\-/])(?:\+\d{1,3}[ .\-]?|\d{1,2}[ .\-])?(?:\(\d{2,4}\)|\d{2,4})(?: ?/ ?|[ .\-]?)\d{3,4}[ .\-]?\d{4}(?![\w\-])(?: ?(?:ext|x)\.? ?\d+)?")
_NUMBER = re.compile(r"(?<![\w$.\-/])(?:\d{3}([- ]?)\d{2}\1\d{4}|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]\d{3}-\d{4}-\d{4})(?![\w\-])")
_ADDRESS = re.compile(
    rf"(?<![\w$.])(?:(?:(?:Flat|Apt|Unit|Suite)\.? \w+, )?\d{{1,5}} (?:[NSEW]\. )?(?:{_CAP} ){{1,3}}{STREET}\b\.?|P\.? ?O\.? Box \d+|(?:Rue|Calle|Via|Avenida|Plaza|Piazza)(?: (?:de|des|del|della|di|la|las|los|du))* {_CAP} \d+|[A-ZÄÖÜ][a-zäöüß]+(?:gasse|strasse|straße|weg|platz|allee) \d+)"
    rf"(?:,? (?:(?:Apt|Unit|Suite|Fl)\.? ?\w+|#\w+))?(?:(?:, ?|\n| )(?:\d{{4,5}} )?{_CAP}(?: {_CAP})?,? [A-Z]{{2}}\b(?: \d{{5}}(?:-\d{{4}})?)?|, ?(?:\d{{4,5}} )?{_CAP})?"
)
# Patterns are tried only where a cheap one, that starts with a set of characters, finds what they need.
_DIGITS = re.compile(r"\d[\d .\-/()]{4,}\d")
_PLACES = re.compile(r"\d(?: (?:[NSEW]\. )?[A-ZÀ-ÖØ-Þ]|(?<=[^\W\d_A-Z] \d)|(?<=Box \d))")
_ABROAD = re.compile(r"(?:gasse|strasse|straße|weg|platz|allee|\b(?:Rue|Calle|Via|Avenida|Plaza|Piazza) [^\d\n]*) $")
_REST = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_NAME = re.compile(
    rf"[A-ZÀ-ÖØ-Þ](?<![\w.@].)(?:(?=((?:{_REST}|\.(?: ?{_INI})?)(?: {_INI}(?: ?{_INI})?)?{_GAP}{_CAP})(?![\w@]))|(?=({_REST},[ \n](?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+|{_INI})(?: {_INI})?)(?![\w@])))"
)
_TITLED = re.compile(rf"{TITLE}\.?[ \n]({_CAP})(?![\w@])")
# mail addresses are looked for from their sign to both sides
_SIGN = re.compile(r"@|[\[(]at[\])]", re.I)
_LOCAL = re.compile(rf"[A-Za-z0-9_%+\-]+(?:{_DOT}[A-Za-z0-9_%+\-]+)*\s?$", re.I)
_HOST = re.compile(rf"\s?[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+", re.I)
_BEFORE = re.compile(r"([\w.&'’/#:]+)[ \n*|(\[\"]*$")
_AFTER = re.compile(r"^[ \n,*|)\]\"]*([\w.&'’/#]+)")
_LETTERS = re.compile(r"[^\W\d_]+")
_MAIL_NEAR = re.compile(r"^[\s,\-(<|*]*(?:e-?mail|at|mail)?[\s:\-(<|]*(?:\n?\|? ?(?:Phone|Mail)[^\n]*\n\|? ?(?:Mail \|)? ?)?([A-Za-z0-9_%+\-.]+?)(?:@|\s?[\[(]at)", re.I)
_LOOSE_HOST = re.compile(r"[A-Za-z0-9\-]+(?:[.:][A-Za-z0-9\-]+)*")
_LOOSE_PLACE = re.compile(rf"\d{{1,5}} {_CAP}(?: {_CAP}){{0,2}}")
_SMALL = re.compile(r"(?<![^\W\d_])[a-zß-öø-ÿ]{2,}(?![^\W\d_])")
N_FEATURES = 33


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower() if not s.isascii() else s.lower()


def names(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, pattern): 0 given name before surname, 1 after it and a comma, 2 surname after a title."""
    for m in _NAME.finditer(text):
        if m[1] is not None:
            yield m.start(), m.end(1), 0
        else:
            yield m.start(), m.end(2), 1
    for m in _TITLED.finditer(text):
        if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".@_"):
            yield *m.span(1), 2


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, pattern) of every proposed span."""
    out = []
    for sign in _SIGN.finditer(text):
        start = max(0, sign.start() - 320)
        local, host = _LOCAL.search(text[start : sign.start()]), _HOST.match(text, sign.end())
        if local and host and (sign[0] != "@" or not (local[0][-1].isspace() or host[0][0].isspace())):
            out.append((0, start + local.start(), host.end(), 0))
        elif sign[0] == "@" and local and not local[0][-1].isspace() and (host := _LOOSE_HOST.match(text, sign.end())):
            out.append((0, start + local.start(), host.end(), 1))
    spans = set()
    for m in _DIGITS.finditer(text):
        for kind, pattern in ((1, _PHONE), (2, _NUMBER)):
            spans.update((kind, *x.span(), 0) for x in pattern.finditer(text, max(0, m.start() - 5), min(len(text), m.end() + 12)))
    for m in _PLACES.finditer(text):
        if m.end() == m.start() + 1 and text[m.start() - 4 : m.start()] != "Box " and not _ABROAD.search(text, max(0, m.start() - 40), m.start()):
            continue
        x = _ADDRESS.search(text, max(0, m.start() - 44), min(len(text), m.end() + 140))
        while x and x.end() <= m.start():
            x = _ADDRESS.search(text, x.end(), min(len(text), m.end() + 140))
        if x:
            spans.add((3, *x.span(), 0))
        else:  # a number before capitals
            a = m.start()
            while a and text[a - 1].isdigit():
                a -= 1
            if (x := _LOOSE_PLACE.match(text, a)) and (not a or not (text[a - 1].isalnum() or text[a - 1] in "$._")):
                spans.add((3, *x.span(), 1))
    out += sorted(spans)
    out += [(4, *name) for name in names(text)]
    return out


_CAPITALS = re.compile(r"(?:\b[A-ZÀ-ÖØ-Þ'’\-]+\b[ ,.\n]+){3}$"), re.compile(r"(?:[ ,.\n]+\b[A-ZÀ-ÖØ-Þ'’\-]+\b){3}")


def _shouted(text: str, a: int, b: int) -> bool:
    """Whether three words in capitals stand before or after, where capitals tell little."""
    return bool(_CAPITALS[0].search(text[max(0, a - 60) : a]) or _CAPITALS[1].match(text[b : b + 60]))


class Sketch:
    """Count-min over words: two rows of counters."""

    def __init__(self, rows: np.ndarray | None = None):
        self.rows = np.zeros((2, BUCKETS), np.int64) if rows is None else rows
        self.known: dict[str, int] = {}

    @staticmethod
    def places(word: str) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h % BUCKETS, (h >> 32) % BUCKETS

    def add(self, word: str, n: int) -> None:
        x, y = self.places(word)
        self.rows[0, x] += n
        self.rows[1, y] += n

    def get(self, word: str, other: int = 0) -> int:
        """The count, at least 2; `other` if it is none."""
        n = self.known.get(word)
        if n is None:
            if len(self.known) > 200_000:
                self.known.clear()
            x, y = self.places(word)
            self.known[word] = n = int(min(self.rows[0, x], self.rows[1, y]))
        return n if n > 1 else other

    def __getstate__(self):
        return {"rows": self.rows, "known": {}}


def features(text: str, cand: tuple[int, int, int, int], given: Sketch, small: Sketch) -> list[float]:
    kind, a, b, pattern = cand
    span = text[a:b]
    before, after = text[max(0, a - 45) : a], text[b : b + 45]
    m, n = _BEFORE.search(before), _AFTER.search(after)
    prev, following = m[1] if m else "", n[1] if n else ""
    digits = sum(c.isdigit() for c in span)
    beside = following if re.match(r",? \S", after) else ""
    f = [0.0] * N_FEATURES
    f[0], f[1] = kind, pattern
    f[2] = 1.0 if FIELD.search(before) else 0.0
    f[3] = 1.0 if re.fullmatch(TITLE + r"\.?", prev) else 0.0
    f[4] = 1.0 if re.search(r"\d[\w.]* $", before) else 0.0
    f[5] = 1.0 if re.fullmatch(STREET + r"\.?", beside) else 0.0
    f[6] = 1.0 if ORGANISATION.search(span) or ORGANISATION.match(beside) else 0.0
    f[7] = 1.0 if following == "v." else 0.0
    f[8] = 1.0 if prev == "v." else 0.0
    f[9] = 1.0 if re.match(r",? [A-Z]{2}(?: \d{5}|[.,\n]|$)", after) else 0.0
    f[10] = 1.0 if prev[:1].isupper() else 0.0
    f[11] = 1.0 if following[:1].isupper() else 0.0
    f[12] = 1.0 if not before or before[-1] == "\n" else 0.0
    f[13] = 1.0 if before[-1:] in ("*", "|") or before[-2:] == "| " else 0.0
    f[14] = 1.0 if after[:1] in ("*", "<", ";") or after[:2] in (" |", " <", " (") else 0.0
    f[15] = 1.0 if prev[:1].islower() else 0.0
    f[16] = 1.0 if following[:1].islower() else 0.0
    f[17] = digits
    f[18] = len(span)
    if kind == 4:
        w = [fold(x) for x in _LETTERS.findall(span)]
        full = [x for x in w if len(x) > 1] or [""]
        f[19] = np.log1p(given.get(full[0], 0))
        f[20] = np.log1p(given.get(full[-1], 0)) if len(full) > 1 else 0.0
        f[21] = len(w) - len(full)
        f[27] = np.log1p(given.get(fold(prev), 0)) if before[-1:] in (" ", "\n") else 0.0
        f[28] = len(full)
        f[22] = 1.0 if span.isupper() else 0.0
        f[23] = 1.0 if len(full) > 1 and _spelt(after, full) else 0.0
        if f[22] and _shouted(text, a, b):
            f[30], f[31], f[32] = 1.0, np.log1p(small.get(full[0], 0)), np.log1p(small.get(full[-1], 0)) if len(full) > 1 else 0.0
        f[24] = 1.0 if text.rfind("#", max(0, a - 80), a) > text.rfind("\n", max(0, a - 80), a) else 0.0
    elif kind in (1, 2):
        f[25] = 1.0 if PHONE_LABEL.search(before) else 0.0
        f[26] = 1.0 if ID_LABEL.search(before) else 0.0
        f[27] = 1.0 if OTHER_LABEL.search(before) else 0.0
        f[28] = 1.0 if span[0].isalpha() else 0.0
        f[29] = len(re.findall(r"[ .\-/()]+", span)) + (3.0 if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", span) else 0.0)
    elif kind == 0:
        tail = re.split(r"[.\s\])]", span.rstrip("."))[-1]
        f[30] = len(tail) if tail.isalpha() else 0
        f[31] = 1.0 if before[-1:] in ("`", "@", "/", ":") and not before.lower().endswith("mailto:") or after[:1] in (":", "/", "`") and not after[1:2].isspace() else 0.0
    elif kind == 3:
        f[31] = 1.0 if re.search(r"\b(?:Rooms?|Sections?|Exhibits?|Nos?\.|Chapters?|Parts?|Articles?) $", before) else 0.0
    return f


def _spelt(after: str, words: list[str]) -> bool:
    """Whether a mail address follows that spells the name."""
    m = _MAIL_NEAR.match(after)
    local = m[1].lower() if m else ""
    return bool(local) and any(len(w) > 3 and w in local for w in words)


def label(text: str, cand: tuple[int, int, int, int], f: list[float]) -> int | None:
    """What a rule is sure about: 1, 0, or None."""
    kind = cand[0]
    if kind == 4:
        if f[6] or f[7] or f[8] or f[5] or (f[4] and not f[2]):
            return 0
        if f[30] and not f[23]:  # all is in capitals: a known given name beside a word that is never written small
            known = f[20] if cand[3] == 1 else f[19]
            other = f[31] if cand[3] == 1 else f[32]
            return 0 if f[31] and f[32] or f[28] > 1 and not known or f[28] + f[21] < 2 else 1 if known > 1 and not other else None
        if f[23] or f[2] and not f[9]:
            return 1
        if cand[3] == 0 and f[28] == 2 and not f[21] and not f[19] and f[20] > 1 and f[11]:
            return 0  # the given name stands second, and what follows is its surname
        if f[3] and cand[3] == 2 and not f[9] and not f[11]:
            return 1 if not re.search(r"\d[^.\n]{0,40}$", text[max(0, cand[1] - 40) : cand[1]]) else 0
        if f[9] or f[24] or f[22] and f[21] and f[12]:
            return 0
        if cand[3] == 1 and not f[20] and not f[21]:  # what follows the comma is no given name
            return 0
        if cand[3] == 1 and f[20] > 1:
            return 1
        if cand[3] == 0 and f[21] and f[28] == 1 and f[27]:
            return 0  # the initial belongs to the given name before it
        if cand[3] == 0 and f[21] and f[28] == 1 and not f[22] and not (f[12] and not f[16]):
            return 1  # an initial and one word in running text
        if cand[3] == 0 and f[21] and f[28] == 2 and not f[19] and not f[3]:
            return 0  # what stands before the initial is no given name
        return None
    if kind == 1:
        return 0 if f[27] or f[26] else 1 if f[25] else None
    if kind == 2:
        return 0 if f[25] else 1 if f[26] else 0 if f[27] else None
    if kind == 0:
        return 0 if cand[3] or f[30] < 2 or f[31] else 1
    return 0 if cand[3] or f[7] or f[8] or f[31] else 1


class Model:
    """Trees and thresholds by kind, and the counts of given names and of words written small."""

    def __init__(self, given: Sketch, small: Sketch, rows: list[tuple[list[float], int]], seed: int = 0):
        self.given, self.small = given, small
        self.boosted, self.thresholds = {}, np.full(len(KINDS), 0.5)
        for kind in range(len(KINDS)):
            own = [r for r in rows if r[0][0] == kind]
            if not own:
                continue
            x, y = np.array([r[0] for r in own], np.float64), np.array([r[1] for r in own], np.float64)
            order = np.random.default_rng(seed).permutation(len(y))
            x, y = x[order], y[order]
            # rules speak by context; trees that see it on some rows only learn what the spans look like elsewhere
            hide = np.random.default_rng(seed + 1).random(len(y)) < 0.5
            x[np.ix_(hide, [2, 14, 23, 25, 26])] = 0
            cut = max(1, len(y) * 3 // 4)
            self.boosted[kind] = Boosted().fit(x[:cut], y[:cut])
            if cut < len(y):
                self.thresholds[kind] = self.boosted[kind].calibrate(x[cut:], y[cut:], np.zeros(len(y) - cut, int), 1)[0]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of what is personal in each text, in order, without overlap."""
        found = [candidates(t) for t in texts]
        x = [features(t, c, self.given, self.small) for t, cs in zip(texts, found) for c in cs]
        if not x or not self.boosted:
            return [[] for _ in texts]
        x, p = np.array(x, np.float64), np.zeros(len(x))
        for kind, trees in self.boosted.items():
            own = x[:, 0] == kind
            if own.any():
                p[own] = trees.predict(x[own])
        out, i = [], 0
        for cs in found:
            # mail and street addresses hold what looks like names; a longer span goes first among equals
            own = sorted(((c[0] not in (0, 3), -round(float(p[i + k]), 2), c[1] - c[2], c) for k, c in enumerate(cs) if p[i + k] >= self.thresholds[c[0]]), key=lambda r: r[:3])
            i += len(cs)
            taken: list[tuple[int, int, int]] = []
            for *_, (kind, a, b, _p) in own:
                if all(b <= s or e <= a for _, s, e in taken):
                    taken.append((kind, a, b))
            out.append(sorted(taken, key=lambda s: s[1]))
        return out


def _counted(texts: DataFrame) -> tuple[Sketch, Sketch, int]:
    """Given names in sure contexts and words written small, counted over all texts; and how many texts there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, small, n = Counter(), Counter(), 0
        sketches = Sketch(), Sketch()
        for b in batches:
            n += len(b)
            for text in b["text"]:
                small.update(_SMALL.findall(text))
                for a, e, g in names(text):
                    if g == 2:
                        continue
                    w = [x for x in (fold(x) for x in _LETTERS.findall(text[a:e])) if len(x) > 1]
                    if len(w) == 2 and (FIELD.search(text[max(0, a - 45) : a]) or _spelt(text[e : e + 90], w[-1:] if g == 0 else w[:1])) and not ORGANISATION.search(text[a:e]):
                        given[w[g]] += 1
            for counter, sketch in zip((given, small), sketches):
                for w, k in counter.items():
                    sketch.add(fold(w), k)
                counter.clear()
        rows = [(which, r, i, sketch.rows[r, i]) for which, sketch in enumerate(sketches) for r in (0, 1) for i in np.flatnonzero(sketch.rows[r])]
        yield pd.DataFrame([*rows, (2, 0, 0, n)], columns=["which", "r", "i", "n"])

    counts = texts.where("text is not null").select("text").mapInPandas(run, "which int, r int, i int, n long").groupBy("which", "r", "i").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most 4 * BUCKETS rows
    out = []
    for which in (0, 1):
        own = got[got["which"] == which]
        rows = np.zeros((2, BUCKETS), np.int64)
        rows[own["r"], own["i"]] = own["n"]
        out.append(Sketch(rows))
    return out[0], out[1], int(got.loc[got["which"] == 2, "n"].sum())


def made_texts(seed: int) -> list[str]:
    """Signs that are no mail addresses, which a corpus may lack."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9)))
    forms = ("run {}@v{}.{} again", "clone git@{}:{}/{} first", "the image {}@sha256:{}{}", "log in as {}@localhost, port {}{}", "@{}.{}({})", "pairs {}@{} and {}", "see `{}@{}.{}` there", "{}@{}.{} is the matrix product")
    return [form.format(word(), rng.integers(1, 99) if "@v" in form or "port" in form else word(), word()[: rng.integers(1, 3)] if "matrix" in form or "@{}.{}(" in form else word()) for form in forms for _ in range(25)]


def fit(texts: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Model:
    """texts (kind, id, text) to a model."""
    given, small, n = _counted(texts)
    # a share by hash, so that no task sends more than its part of the sample
    low = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, sample / max(1, n)) * (1 << 40))
    some = texts.where(F.col("text").isNotNull() & low).select("text").limit(2 * sample).toPandas()["text"].tolist()
    rows = []
    for t in some + made_texts(seed) if some else []:
        for c in candidates(t):
            f = features(t, c, given, small)
            y = label(t, c, f)
            if y is not None:
                rows.append((f, y))
    return Model(given, small, rows, seed)


def find_personal(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """texts (kind, id, text) to (kind, id, what, start_pos, end_pos), positions in characters; distinct rows."""
    held = texts.sparkSession.sparkContext.broadcast(model or fit(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = held.value.spans(list(b["text"]))
            rows = [(k, i, KINDS[w], s, e) for k, i, own in zip(b["kind"], b["id"], found) for w, s, e in own]
            yield pd.DataFrame(rows, columns=["kind", "id", "what", "start_pos", "end_pos"])

    return texts.where("text is not null").select("kind", "id", "text").mapInPandas(run, "kind int, id string, what string, start_pos int, end_pos int").distinct()


def redact(texts: DataFrame, model: Model | None = None) -> DataFrame:
    """texts (kind, id, text) to (kind, id, text, n_items): every item replaced by its kind in brackets, the rest as it is."""
    held = texts.sparkSession.sparkContext.broadcast(model or fit(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts_ = [t if isinstance(t, str) else "" for t in b["text"]]
            out, n = [], []
            for t, given, own in zip(texts_, b["text"], held.value.spans(texts_)):
                parts, end = [], 0
                for w, s, e in own:
                    parts += [t[end:s], f"[{KINDS[w].upper()}]"]
                    end = e
                out.append("".join([*parts, t[end:]]) if isinstance(given, str) else None)
                n.append(len(own))
            yield pd.DataFrame({"kind": b["kind"], "id": b["id"], "text": out, "n_items": n})

    return texts.select("kind", "id", "text").mapInPandas(run, "kind int, id string, text string, n_items int")
