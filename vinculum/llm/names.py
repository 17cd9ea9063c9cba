"""Variant spellings of names typed by people, by noisy-channel attribution.

Names are parsed into forms: of a person given name, surname and generational suffix, of an organisation its words
without legal form, and its numbers or series. Frequent forms are candidate canonical forms. A form is attributed to
the candidate of the greatest posterior: log of the candidate's rows (prior) plus the log likelihood of typing the form
for it (typos, initials, nicknames, bare surnames, abbreviated, dropped or reordered words). It stays its own where no
candidate beats that. Forms linked by attribution, or by a record that gives both as full names, are one entity.

Candidates meet over blocks, at every size the same ones. A candidate is found under its surname, or under its telling
words (its one or two rarest, without which no form is typed for it; a slip is as common as the word it may stand for); a form looks under its surname, or under each of
its words; all of them with any one letter left out. So no word is too common to meet over: what is common is telling
for few candidates only. Blocks that many forms look into are salted. Forms are counted before they are joined, so a name
that a third of all rows bear is one row there.

Nicknames are a short fixed list and what the records teach: two given names that records with one surname give side by
side as entity_text and canonical_name, under two surnames at least.

Different suffixes, series, years or numbers never agree, nor do different given names that are both in common use.
Other kinds than persons and organisations take no part, nor do null or unreadable names without a readable canonical
name. Repeated rows count once. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.operators.components import connected_components
from vinculum.operators.skew import salted_join
from vinculum.session import materialise

# Titles, suffixes, legal forms and nicknames in common English use.
TITLES = "mr mrs ms miss dr prof professor hon honorable judge justice sir".split()
TAILS = "esq esquire j jj cj phd md jd".split()
SUFFIXES = "jr sr ii iii iv".split()
LEGAL = "inc incorporated llc ltd limited corp corporation co company plc lp llp pllc gmbh".split()
NICKNAMES = {
    k: v.split() for k, v in {
        "abby": "abigail", "al": "albert alan alexander", "alex": "alexander alexandra", "andy": "andrew", "barb": "barbara", "bea": "beatrice beatriz", "becky": "rebecca", "ben": "benjamin", "bert": "bertrand albert", "beth": "elizabeth",
        "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher christine", "chuck": "charles",
        "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "dot": "dorothy", "dottie": "dorothy", "drew": "andrew", "ed": "edward", "eddie": "edward",
        "ellie": "eleanor", "flo": "florence", "fran": "frances", "frank": "francis franklin", "fred": "frederick", "fritz": "frederick", "gene": "eugene", "gerry": "gerald", "greg": "gregory", "gus": "gustav augustus", "gwen": "gwendolyn",
        "hal": "harold henry", "hank": "henry", "harry": "harold henry", "jack": "john", "jackie": "jacqueline", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome", "jim": "james", "jimmy": "james", "joe": "joseph",
        "joey": "joseph", "jon": "jonathan", "josh": "joshua", "kit": "katherine christopher", "kate": "katherine catherine", "kathy": "katherine kathleen", "katie": "katherine", "ken": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "lenny": "leonard",
        "leo": "leonard leopold", "liz": "elizabeth", "liza": "elizabeth", "lou": "louis louise", "lucy": "lucille lucinda", "maddie": "madeline", "maggie": "margaret", "mandy": "amanda", "matt": "matthew", "meg": "margaret", "mike": "michael", "ned": "edward", "nat": "nathaniel natalie", "nate": "nathaniel nathan",
        "nell": "eleanor helen", "nellie": "eleanor helen", "nick": "nicholas", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret", "pete": "peter", "phil": "philip", "pip": "philip", "polly": "mary", "ray": "raymond",
        "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "ronnie": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "sandra alexander", "sasha": "alexander alexandra", "steve": "stephen steven", "sue": "susan", "susie": "susan",
        "ted": "theodore edward", "teddy": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "tori": "victoria", "trish": "patricia", "ursie": "ursula", "val": "valerie valeria",
        "vic": "victor", "vicky": "victoria", "vince": "vincent", "vinnie": "vincent", "walt": "walter", "will": "william", "win": "winston", "zach": "zachary", "zack": "zachary",
    }.items()
}

# Log likelihoods of what typing does to a name.
TYPO, NICKNAME, INITIAL, BARE, MIDDLE, SHORT, DROPPED = -3.0, -1.0, -1.0, -1.5, -4.0, -1.0, -2.0
#: A form stays its own if it is e**OWN times as likely; it is rare that two entities bear such like names.
OWN = -4.0
#: A candidate's second word tells as well if it is at most so many times as common as its rarest.
TELLING = 4


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def parse_person(text: str | None) -> tuple[str, str, str, str] | None:
    """(given name or initial, middle initial, surname, suffix), each may be blank but the surname; None: unreadable."""
    parts = [p.split() for p in fold(text or "").replace("’", "'").split(",")]
    suffix, words = "", []
    for p in parts:
        kept = []
        for t in p:
            bare = t.strip(".'\"()").lower()
            if bare in SUFFIXES and (kept or words):
                suffix = bare
            elif bare in TAILS and (words or kept) and (len(bare) > 1 or p is not parts[0]):
                continue
            elif bare:
                kept.append(t)
        if kept:
            words.append(kept)
    if words and words[0][0].strip(".").lower() in TITLES and (len(words[0]) > 1 or len(words) > 1):
        words[0] = words[0][1:]
    words = [w for w in words if w]
    if not words:
        return None
    split = lambda w: [x for t in w for x in (re.findall(r"[A-Za-z](?=\.)", t) if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]?\.?", t) else [t.strip(".")]) if x]
    if len(words) > 1:  # surname first
        surname, first = split(words[0]), split(words[1])
    else:
        w = split(words[0])
        upper = [len(x) > 1 and x.isupper() for x in w]
        if len(w) > 1 and upper[0] and not any(upper[1:]):
            surname, first = w[:1], w[1:]
        else:
            surname, first = w[-1:], w[:-1]
    clean = lambda x: re.sub(r"[^a-z]", "", x.lower())
    name = clean("".join(surname))
    first = [clean(x) for x in first if clean(x)]
    if len(name) < 2:
        return None
    return (first[0] if first else "", first[1][0] if len(first) > 1 else "", name, suffix)


def parse_organisation(text: str | None) -> tuple[list[str], str] | None:
    """(words without legal form, in order of the alphabet; numbers and series); None: unreadable."""
    s = fold(text or "").lower().replace("&", " ")
    s = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[1].replace(".", "") + " ", s)
    s = re.sub(r"limited liability co(mpany|rporation|\.)?", " ", s)
    tokens = re.findall(r"[a-z]+|\d+", s)
    words, marks = [], []
    i = 0
    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
        if t in ("series", "class", "fund", "no", "number") and after and (after.isdigit() or after in ("i", "v", "vi", *SUFFIXES) or len(after) == 1 and t in ("series", "class")):
            marks.append(after)
            if t == "fund":
                words.append(t)
            i += 2
            continue
        if t.isdigit() or t in SUFFIXES[2:]:
            marks.append(t)
        elif t not in LEGAL and t not in ("the", "of", "and"):
            words.append(t)
        i += 1
    return (sorted(words), " ".join(sorted(marks))) if words else None


def distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; 3 stands for more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) > 8:
        return 3
    two, one = None, list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        now = [x]
        for y in range(1, len(b) + 1):
            d = min(one[y] + 1, now[-1] + 1, one[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, two[y - 2] + 1)
            now.append(d)
        two, one = one, now
    return min(one[-1], 3)


def _typos(a: str, b: str) -> float:
    d = distance(a, b)
    return 0.0 if d == 0 else TYPO * d if d == 1 and min(len(a), len(b)) >= 4 or d == 2 and min(len(a), len(b)) >= 8 else -math.inf


def person_likelihood(f: dict, c: dict) -> float:
    """Log likelihood that the form f is typed for the full name c."""
    if f["suffix"] != c["suffix"]:
        return -math.inf
    score = _typos(f["surname"], c["surname"])
    g, h = f["given"], c["given"]
    if not g:
        score += BARE
    elif len(g) == 1:
        score += INITIAL if h[0] == g else -math.inf
    elif g != h:
        if h in NICKNAMES.get(g, ()) or g in NICKNAMES.get(h, ()) or h in f["nicks"]:
            score += NICKNAME
        elif f["given_rows"] >= 0.1 * c["given_rows"] and f["given_rows"] >= 3:
            return -math.inf  # both are names in common use
        else:
            nick = [_typos(n, h) for n in NICKNAMES.get(g, ())] + [_typos(g, n) for n in NICKNAMES.get(h, ())]
            score += max([_typos(g, h), *(NICKNAME + t for t in nick)])
    if f["middle"] and len(c["middles"]) and f["middle"] not in c["middles"]:
        score += MIDDLE
    return score


def short_for(a: str, b: str) -> bool:
    """a abbreviates b: a beginning of it, or its letters in order from the first."""
    if len(a) >= len(b) or len(a) < 2 or a[0] != b[0]:
        return False
    if b.startswith(a):
        return True
    letters = iter(b)
    return len(a) >= 3 and len(b) >= 5 and all(x in letters for x in a)


def organisation_likelihood(f: list[str], c: list[str], telling: list[str]) -> float:
    """Log likelihood that the words f are typed for c; one of c's telling (rarest) words must be among them."""
    left, score = list(c), 0.0
    for exact in (True, False):
        for w in f:
            if exact:
                if w in left:
                    left.remove(w)
            elif f.count(w) > c.count(w) or w not in c:
                best = max(((SHORT if short_for(w, x) or short_for(x, w) else _typos(w, x), x) for x in left), default=(-math.inf, ""))
                if best[0] == -math.inf:
                    return -math.inf
                score += best[0]
                left.remove(best[1])
    if all(w in left for w in telling) or len(left) > 2:
        return -math.inf
    return score + DROPPED * len(left)


def _left_out(s: str) -> list[str]:
    return [s, *{s[:i] + s[i + 1 :] for i in range(len(s))}] if len(s) >= 4 else [s]


_FORM = "form string, kind string, given string, middle string, surname string, suffix string, words array<string>, full boolean"


def _forms(kind: str, text: str | None) -> tuple | None:
    if kind == "P":
        p = parse_person(text)
        if p is None:
            return None
        g, m, s, x = p
        full = len(g) > 1
        return (f"P|{g}|{'' if full else m}|{s}|{x}", "P", g, m, s, x, [], full)
    o = parse_organisation(text)
    return o and (f"O|{' '.join(o[0])}|{o[1]}", "O", "", "", "", o[1], o[0], True)


def parse(names: DataFrame) -> DataFrame:
    """names (id, type, name, canonical) to one row (id, form, other, and the form's parts): the fuller reading of the two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, kind, name, canonical in zip(b["id"], b["kind"], b["name"], b["canonical"]):
                x, y = _forms(kind, name), _forms(kind, canonical)
                if x and y and kind == "P" and not x[7]:
                    if y[7] or len(y[2]) > len(x[2]):
                        x, y = (*y[:3], y[3] or x[3], *y[4:]), x
                if x is None:
                    x, y = y, None
                if x:
                    both = y is not None and y[7] and x[7] and y[0] != x[0]
                    rows.append((i, *x, y[0] if both else None, *((y[1:7] if both else (None,) * 6))))
            yield pd.DataFrame(rows, columns=["id", "form", "kind", "given", "middle", "surname", "suffix", "words", "full", "o_form", "o_kind", "o_given", "o_middle", "o_surname", "o_suffix", "o_words"])

    kinds = F.lower(F.btrim("type"))
    kind = F.when(kinds.isin("person", "judge"), "P").when(kinds.isin("organization", "organisation"), "O")
    rows = names.select("id", kind.alias("kind"), "name", "canonical").where("kind is not null and id is not null").distinct()
    other = ", ".join(f"o_{x}" for x in ("form string", "kind string", "given string", "middle string", "surname string", "suffix string", "words array<string>"))
    return rows.mapInPandas(run, f"id string, {_FORM}, {other}")


def _blocks(f: dict) -> tuple[list[str], list[str]]:
    """The keys under which a form looks for candidates, and those under which it is found as one."""
    if f["kind"] == "O":
        seek = [f"O|{f['suffix']}|{k}" for w in set(f["words"]) for k in _left_out(w)]
        return seek, [f"O|{f['suffix']}|{k}" for w in f["telling"] for k in _left_out(w)]
    g, s, x = f["given"], f["surname"], f["suffix"]
    if not g:
        return [], []
    firsts = {g[:1], *(n[0] for n in NICKNAMES.get(g, ())), *(n[0] for n in f["nicks"])}
    keys = [f"P|{x}|{k}|{a}" for k in _left_out(s) for a in firsts] + [f"P|{x}|{s}|-{g[1:4]}"] * (len(g) > 3)
    return keys, keys if f["full"] else []


def _bare(forms: DataFrame) -> DataFrame:
    """Bare surnames (f) with the full name (c) that is most frequent of that surname, the one of the greatest posterior.

    Where nobody bears the surname it is taken for a slip, and meets the most frequent full name under each of its keys.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(key=[_left_out(s) for s in b["surname"]]).explode("key")

    people = forms.where("full and kind = 'P'").groupBy("surname", "suffix").agg(F.max(F.struct("rows", "form")).alias("m"))
    bare = forms.where("kind = 'P' and given = ''").select("form", "surname", "suffix")
    borne = bare.join(people, ["surname", "suffix"]).select(F.col("form").alias("f"), F.col("m.form").alias("c"))
    kind = "surname string, suffix string, {} string, key string"
    slips = bare.join(people, ["surname", "suffix"], "left_anti").select("surname", "suffix", "form").mapInPandas(spread, kind.format("form"))
    keyed = people.select("surname", "suffix", F.col("m.form").alias("c")).mapInPandas(spread, kind.format("c"))
    rows = keyed.select("suffix", "key", "c").join(forms.select(F.col("form").alias("c"), "rows"), "c")
    best = rows.groupBy("suffix", "key").agg(F.max(F.struct("rows", "c")).alias("m"))
    return borne.unionByName(slips.join(best, ["suffix", "key"]).select(F.col("form").alias("f"), F.col("m.c").alias("c")))


def attribute(forms: DataFrame) -> DataFrame:
    """Forms with counts to the links (a, b): form a is typed for form b."""
    cols = ["form", "kind", "given", "surname", "suffix", "middle", "words", "full", "rows", "middles", "given_rows", "nicks", "telling"]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for form, n, f in zip(b["form"], b["n"], b.to_dict("records")):
                seek, found = _blocks(f)
                rows += [(form, n, k, False) for k in sorted(set(seek))] + [(form, n, k, True) for k in sorted(set(found))]
            yield pd.DataFrame(rows, columns=["form", "n", "key", "found"])

    given = forms.select("form", F.size("words").alias("n"), "kind", "given", "surname", "suffix", "words", "full", "nicks", "telling")
    keyed = materialise(given.mapInPandas(spread, "form string, n int, key string, found boolean"))
    cands = keyed.where("found").select("key", F.col("form").alias("c"), F.col("n").alias("cn"))
    # what no candidate is found under is not shuffled far: both sides come by the key
    met = salted_join(keyed.where("not found").select("key", F.col("form").alias("f"), "n"), cands, "key", F.col("f"), "inner")
    pairs = met.where("f <> c and cn between n and n + 2").select("f", "c").distinct()
    side = lambda p: forms.select(*(F.col(x).alias(f"{p}_{x}") for x in cols))
    met = pairs.unionByName(_bare(forms)).distinct().join(side("f"), F.col("f") == F.col("f_form")).join(side("c"), F.col("c") == F.col("c_form"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f, c = ([{k[2:]: v for k, v in r.items()} for r in b[[x for x in b.columns if x[:2] == p]].to_dict("records")] for p in ("f_", "c_"))
            s = [person_likelihood(x, y) if x["kind"] == "P" else organisation_likelihood(list(x["words"]), list(y["words"]), list(y["telling"])) for x, y in zip(f, c)]
            post = [v + math.log(y["rows"]) for v, y in zip(s, c)]
            keep = [p > (math.log(x["rows"]) + OWN if x["full"] else -math.inf) and p > -math.inf for p, x in zip(post, f)]
            yield pd.DataFrame({"a": b["f"], "b": b["c"], "posterior": post}).loc[keep]

    scored = met.mapInPandas(score, "a string, b string, posterior double")
    return scored.groupBy("a").agg(F.max(F.struct("posterior", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def _nicknames(rows: DataFrame) -> DataFrame:
    """(given, nicks): what the records teach. Slips of the pen are none."""

    def other(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[_typos(x, y) == -math.inf for x, y in zip(b["given"], b["o_given"])]]

    both = rows.where("kind = 'P' and o_form is not null and surname = o_surname and given <> o_given").select("given", "o_given", "surname").distinct()
    taught = both.mapInPandas(other, "given string, o_given string, surname string")
    ways = taught.unionByName(taught.select(F.col("o_given").alias("given"), F.col("given").alias("o_given"), "surname"))
    sure = ways.groupBy("given", "o_given").agg(F.countDistinct("surname").alias("n")).where("n >= 2")
    return sure.groupBy("given").agg(F.sort_array(F.collect_set("o_given")).alias("nicks"))


def _word_counts(used: DataFrame) -> DataFrame:
    """used (form, w) to (w, n): the forms of the most frequent word that w may be a slip of; a slip of a common word tells nothing."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(key=[_left_out(w) for w in b["w"]]).explode("key")

    keyed = materialise(used.groupBy("w").agg(F.count("*").alias("n")).mapInPandas(spread, "w string, n long, key string"))
    most = keyed.groupBy("key").agg(F.max("n").alias("n"))
    return keyed.select("w", "key").join(most, "key").groupBy("w").agg(F.max("n").alias("n"))


def link_names(names: DataFrame) -> DataFrame:
    """names (id, type, name, canonical) to (id, entity, form): the same entity, the same name meant."""
    rows = materialise(parse(names))
    parts = ["form", "kind", "given", "middle", "surname", "suffix", "words", "full"]
    both = rows.select(*parts, F.lit(1).alias("n")).unionByName(rows.where("o_form is not null").select(*(F.col(f"o_{x}").alias(x) for x in parts[:-1]), F.lit(True).alias("full"), F.lit(0).alias("n")))
    forms = both.groupBy("form").agg(*(F.first(x).alias(x) for x in ("kind", "given", "surname", "suffix", "words", "full")), F.max("middle").alias("middle"), F.array_remove(F.collect_set("middle"), "").alias("middles"), F.greatest(F.sum("n"), F.lit(1)).alias("rows"))
    forms = materialise(forms)
    given = forms.where("kind = 'P'").groupBy("given").agg(F.count("*").alias("given_rows"))
    used = forms.where("kind = 'O'").select("form", F.explode("words").alias("w")).distinct()
    rarest = salted_join(used, _word_counts(used), "w", F.col("form"), "inner").groupBy("form").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "w"))), 1, 2).alias("r"))
    telling = rarest.select("form", F.transform(F.filter("r", lambda x: x["n"] <= TELLING * F.col("r")[0]["n"]), lambda x: x["w"]).alias("telling"))
    none = F.array().cast("array<string>")
    forms = forms.join(given, "given", "left").join(telling, "form", "left").join(_nicknames(rows), "given", "left")
    forms = materialise(forms.withColumns({"given_rows": F.coalesce("given_rows", F.lit(0)), "telling": F.coalesce("telling", none), "nicks": F.coalesce("nicks", none)}))
    links = attribute(forms).unionByName(rows.where("o_form is not null").select(F.col("form").alias("a"), F.col("o_form").alias("b"))).distinct()
    entity = connected_components(links).select(F.col("id").alias("form"), "component")
    return rows.select("id", "form").join(entity, "form", "left").select("id", F.coalesce("component", "form").alias("entity"), "form").distinct()


def linked_pairs(linked: DataFrame) -> DataFrame:
    """(id, entity) to every pair (id_a, id_b) of one entity, id_a < id_b."""
    one = linked.select("id", "entity").distinct()
    a, b = one.select("entity", F.col("id").alias("id_a")), one.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").where("id_a < id_b").select("id_a", "id_b").distinct()
