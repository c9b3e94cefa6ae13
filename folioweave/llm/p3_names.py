"""Problem 3: spellings of one person or organisation, by merge and rematch over blocked profiles.

A spelling is read into a form: a person's given names or initials and surname, or an organisation's words with its own
name first. Forms meet in blocks, one for each surname or own name and each string made by deleting one of its letters,
so that any two names one typing error apart share a block. Within a block every form begins as a profile. Profiles with
the same full names merge, nicknames and one typing error allowed; then a shortened form (initials, abbreviations, words
left out, acronyms) merges into the one profile it can stand for, and the grown profiles are matched again until nothing
changes. A shortened form that can stand for several profiles merges into none. Blocks overlap; what they link is joined
as connected components.

Defined results: null and blank names are no spellings; spellings of problem 6 share a form; of an entity's types the
most frequent one counts, places have one spelling each, and a name whose types say nothing is read in both ways.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.p6_lookalikes import _LATIN, _TO_LATIN, transducer
from folioweave.session import cut
from folioweave.sources.tables import table

# Titles, legal forms, words that many organisations share, fields before sorts, letters without a decomposition, short names.
TITLES = frozenset("dr prof mr mrs ms miss mx sir phd md msc ing dipl".split())
LEGAL = frozenset("inc ltd llc plc gmbh ag sa co".split())
FILLERS = frozenset("the of and for de la".split())
FIELDS = frozenset("agricultural archive climate coastal drones energy ferry forestry grid harbor harbour hydrographic international maritime mineral rail seismic survey telecom telecoms transport water".split())
SORTS = frozenset(
    "academy agency association authority board bureau center centre college commission committee company consortium cooperative corporation council department division federation foundation group institute "
    "laboratory league ministry office programme school service society trust union university assn assoc auth coop corp comm cncl ctr dept dpt fdn found inst lab labs univ".split()
)
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})
SHORT_NAMES = [
    set(x.split())
    for x in """alexander aleksander alexandr aleksandr alex sasha sandy xander|alejandro alex jandro|anthony antony tony|antonio tono toni|benjamin ben benny benji|charles charlie chuck carl|christopher chris kit|catherine katherine kathrine catharine
kate katie kathy cathy kat kitty|daniel dan danny|dmitri dmitry dmitriy dima mitya|dorothy dot dottie dolly|edward ed eddie ned ted teddy|ekaterina yekaterina katya katia|elizabeth elisabeth liz lizzie beth betty eliza lisa|
francisco paco pancho curro kiko|francis frank|friedrich frederick fritz fred|gabriela gabriella gaby gabi|giuseppe beppe peppe pino|guadalupe lupe lupita|hans johannes johann jan|henrietta etta hettie hetty harriet|henry harry hank|
ignacio nacho|james jim jimmy jamie|jennifer jen jenny|john jack johnny|jose pepe chepe|josephine jo josie fina|josefina fina pepa|jorgen jurgen|lawrence laurence larry laurie|margaret margret peggy maggie meg madge|malgorzata gosia malgosia|
matthew matt|mateo matteo teo|mercedes merche|michael mike mick mickey mikey|nikolai nikolay nikolaj kolya|patricia pat patty tricia trish|pavel pasha|quentin quin quinn|rebecca becca becky|richard dick rick rich ricky|robert rob bob bobby robbie bert|
samuel sam sammy|sebastian seb bastian basti|sofia sophia sonya|theodore theo ted teddy|thomas tom tommy|ulrike ulli uli|victoria vicky vicki tori|vladimir volodya vova|william will willy willie bill billy liam|wilhelm willi|
wolfgang wolf wolfi|yevgenia evgenia eugenia zhenya""".replace("\n", " ").split("|")
]
_SHORT: dict[str, list[int]] = {}
for _k, _names in enumerate(SHORT_NAMES):
    for _n in _names:
        _SHORT.setdefault(_n, []).append(_k)

Form = tuple[tuple[str, ...], str]


def plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower().translate(LETTERS)) if not unicodedata.combining(c))


def look(name: str) -> str:
    """What the name looks like: problem 6's form with single spaces, all widths plain, lone look-alikes as the other words' letters."""
    words = unicodedata.normalize("NFKC", transducer()(name)).split()
    if any(_LATIN.search(w) for w in words):
        words = ["".join(_TO_LATIN.get(c, c) for c in w) if not _LATIN.search(w) else w for w in words]
    return " ".join(words)


def person(name: str, flip: bool = False) -> str | None:
    """'given names|surname', an initial with its stop; flip: the surname stands first."""
    first, comma, rest = name.partition(",")
    if comma and plain(rest).replace(".", "").strip() in TITLES:
        comma, name = "", first
    spaced = lambda s: [w for w in re.sub(r"\.", ". ", plain(s)).split() if w.rstrip(".") not in TITLES and w != "."]
    initial = lambda w: len(w.rstrip(".")) == 1
    if comma:
        surname, given = spaced(first), spaced(rest)
    else:
        words = spaced(name)
        while len(words) > 1 and initial(words[-1]) and not initial(words[0]):
            words = [*words[-1:], *words[:-1]] if not initial(words[-2]) else [*words[-2:], *words[:-2]]
        if flip and len(words) == 2:
            words = words[::-1]
        surname, given = words[-1:], words[:-1]
    if not surname or not given or initial(surname[-1]):
        return None
    return " ".join(w.rstrip(".") + "." if initial(w) else w.rstrip(".") for w in given) + "|" + "-".join(w.rstrip(".") for w in surname)


def organisation(name: str) -> str | None:
    """The own name first, the sort of organisation last; an acronym is marked with '='."""
    if re.fullmatch(r"[A-Z]{3,6}", name):
        return "=" + name.lower()
    name = re.sub(r"\bco-op", "coop", re.sub(r"['’]", "", name), flags=re.I)
    name = "".join(" " * (b.isupper() and a.islower()) + b for a, b in zip(" " + name, name))
    name = re.sub(r"^(?:the )?(.+?) of (.+)$", r"\2 \1", name, flags=re.I)
    words = [w for w in re.split(r"[\W_]+", plain(name)) if w and w not in FILLERS]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    if words and words[0] in LEGAL:
        words = [w for w in words if w not in LEGAL]
    head = next((k for k, w in enumerate(words) if w not in FIELDS and w not in SORTS and len(w) > 1), 0)
    words = words[head:] + words[:head]
    return " ".join([w for w in words if w not in SORTS] + [w for w in words if w in SORTS]) or None


def apart(a: str, b: str) -> int:
    """0: equal, 1: one letter more, less, other, or two neighbours swapped; else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return 1 if x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:]) else 2


def given_apart(a: str, b: str) -> int:
    if a == b or set(_SHORT.get(a, ())) & set(_SHORT.get(b, ())):
        return 0
    if min(len(a), len(b)) < 3 or (a in _SHORT and b in _SHORT):
        return 2
    return apart(a, b)


def shortens(a: str, b: str) -> bool:
    """Whether a is an abbreviation of b."""
    a = a[:-1] if len(a) > 3 and a[-1] == "s" else a
    if len(a) >= len(b) or a[:1] != b[:1]:
        return False
    rest = iter(b)
    return b.startswith(a) or (len(a) > 1 and all(c in rest for c in a) and len(a) <= 5)


def persons(a: str, b: str) -> tuple[str, int] | None:
    """('same' or 'short', typing errors): a is the same as b, or a shortened form of it."""
    ga, _, sa = a.partition("|")
    gb, _, sb = b.partition("|")
    cost = apart(sa, sb) if min(len(sa), len(sb)) >= 5 else 2 * (sa != sb)
    if cost > 1:
        return None
    x, y = ga.split(), gb.split()
    for m, n in zip(x[1:], y[1:]):
        if m[0] != n[0] or not (m.endswith(".") or n.endswith(".")) and given_apart(m, n) > 0:
            return None
    if x[0].endswith("."):
        if x[0][0] != y[0][0]:
            return None
        return ("short", cost) if not y[0].endswith(".") or len(x) < len(y) else ("same", cost) if x == y else None
    if y[0].endswith("."):
        return None
    cost += given_apart(x[0], y[0])
    return ("same", cost) if cost <= 1 else None


def organisations(a: str, b: str) -> tuple[str, int] | None:
    if a[:1] == "=" or b[:1] == "=":
        words = b.split()
        return ("short", 0) if a[:1] == "=" and b[:1] != "=" and len(words) >= 3 and "".join(w[0] for w in words) == a[1:] else None
    x, y = a.split(), b.split()
    if len(x) > len(y) or (len(x) == 1 and len(y) > 1):
        return None
    best: dict[tuple[int, int], tuple[int, bool]] = {}

    def align(i: int, j: int) -> tuple[int, bool]:
        """(typing errors, shortened) of the best way to find x[i:] in y[j:]."""
        if i == len(x):
            return 0, j < len(y)
        if len(x) - i > len(y) - j:
            return 9, True
        if (i, j) not in best:
            ways = []
            c = apart(x[i], y[j]) if min(len(x[i]), len(y[j])) >= 4 else 2 * (x[i] != y[j])
            if c <= 1:
                n, s = align(i + 1, j + 1)
                ways.append((n + c, s))
            elif shortens(x[i], y[j]):
                n, s = align(i + 1, j + 1)
                ways.append((n, True if s or i or j else s))
            if i:
                n, _ = align(i, j + 1)
                ways.append((n, True))
            best[i, j] = min(ways, default=(9, True))
        return best[i, j]

    cost, short = align(0, 0)
    return ("short" if short else "same", cost) if cost <= 1 else None


def resolved(forms: list[str]) -> list[list[str]]:
    """Profiles of a block's forms."""
    forms = sorted(forms)
    of = list(range(len(forms)))

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    stands: dict[int, list[tuple[int, int]]] = {}
    for i, a in enumerate(forms):
        for j, b in enumerate(forms):
            if i == j or a[0] != b[0]:
                continue
            got = (persons if a[0] == "p" else organisations)(a[1:], b[1:])
            if got and got[0] == "same":
                of[max(root(i), root(j))] = min(root(i), root(j))
            elif got:
                stands.setdefault(i, []).append((got[1], j))
    changed = True
    while changed:  # a profile that grew may be the only one left for a form
        changed = False
        for i, to in stands.items():
            for cost in (0, 1):
                there = {root(j) for c, j in to if c == cost}
                if there:
                    break
            if len(there) == 1 and (r := there.pop()) != root(i):
                of[max(root(i), r)] = min(root(i), r)
                changed = True
    out: dict[int, list[str]] = {}
    for k, f in enumerate(forms):
        out.setdefault(root(k), []).append(f)
    return list(out.values())


def keys(form: str) -> set[str]:
    """Blocks of a form, which begins with its kind."""
    kind, text = form[0], form[1:]
    if text[:1] == "=":
        return {f"={text[1:]}"}
    name = text.partition("|")[2] if kind == "p" else text.split()[0]
    out = {kind + name}
    if len(name) >= (5 if kind == "p" else 4):
        out |= {kind + name[:k] + name[k + 1 :] for k in range(len(name))}
    if kind == "o" and len(words := text.split()) >= 3:
        out.add("=" + "".join(w[0] for w in words))
    return out


def looks(extractions: DataFrame) -> DataFrame:
    """(name, look, person, org, place): every spelling and how often it has a type."""
    none = F.array().cast("array<struct<name:string,type:string>>")
    entities = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type")))
    related = F.flatten(F.transform("relations", lambda r: F.transform(F.array(r["source"], r["target"]), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("type")))))
    said = extractions.select(F.explode(F.concat(F.coalesce(entities, none), F.coalesce(related, none))).alias("e")).select("e.name", "e.type").where("trim(name) != ''")
    counts = said.groupBy("name").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("person", "org", "place")])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(look=b["name"].map(look))

    return counts.mapInPandas(part, "name string, person long, org long, place long, look string")


def read_forms(names: DataFrame) -> DataFrame:
    """(look, form) of every look that is a person's or an organisation's."""
    seen = names.groupBy("look").agg(*[F.sum(t).alias(t) for t in ("person", "org", "place")])
    two = seen.where(F.col("look").rlike("^[^\\s,.]{2,} [^\\s,.]{2,}$") & (F.col("person") > 0)).select(F.split(F.lower("look"), " ").alias("w"))
    place = two.select(F.explode(F.array(F.struct(F.col("w")[0].alias("last"), F.lit(1).alias("at")), F.struct(F.col("w")[1].alias("last"), F.lit(-1).alias("at")))).alias("e")).select("e.*").groupBy("last").agg(F.sum("at").alias("given"))
    seen = seen.withColumn("last", F.lower(F.regexp_extract("look", "(\\S+)$", 1))).join(place.where("given > 0"), "last", "left")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, p, o, q, given in zip(b["look"], b["person"], b["org"], b["place"], b["given"]):
                most = max(p, o, q)
                sure = most > 1 and sorted((p, o, q))[1] < most
                if not sure or p == most:
                    rows.append((x, "p", person(x, given > 0)))
                if not sure or o == most:
                    rows.append((x, "o", organisation(x)))
            yield pd.DataFrame([(x, k + f) for x, k, f in rows if f], columns=["look", "form"])

    return seen.select("look", "person", "org", "place", "given").mapInPandas(part, "look string, form string")


def links(forms: DataFrame) -> DataFrame:
    """(a, b): forms that one block puts into one profile."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, f) for f in b["form"] for k in keys(f)], columns=["key", "form"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p[0], f) for x in b["forms"] for p in resolved(list(x)) for f in p[1:]], columns=["a", "b"])

    blocks = forms.select("form").distinct().mapInPandas(block, "key string, form string").groupBy("key").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    return blocks.where("size(forms) > 1").select("forms").distinct().mapInPandas(part, "a string, b string").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(form, label): the least form of each connected component, for every form of an edge."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("form")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["form"]).groupBy("a").agg(F.min("label").alias("near"))
        new = cut(labels.join(near, labels["form"] == near["a"]).select("form", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")))
        labels = new.select("form", "label")
        if not new.where("moved").limit(1).count():
            return labels


def spellings(extractions: DataFrame) -> DataFrame:
    """(label, name): names with one label mean the same person or organisation."""
    names = cut(looks(extractions))
    forms = cut(read_forms(names))
    labels = components(links(forms))
    meant = forms.join(labels, "form", "left").select("look", F.coalesce("label", "form").alias("label"))
    return names.join(meant, "look", "left").select(F.coalesce("label", F.concat(F.lit("="), "look")).alias("label"), "name").distinct()


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p3_found: each two spellings of one person or organisation."""
    named = spellings(table(spark, folder, "extractions", "entities", "relations"))
    a, b = named.withColumnRenamed("name", "name_a"), named.withColumnRenamed("name", "name_b")
    return a.join(b, "label").where("name_a < name_b").select("name_a", "name_b").distinct()


QUERIES = {"p3_found": found}
SQL: dict[str, str] = {}
