"""Problem 6: one form for text that looks the same.

A transducer over grapheme clusters, compiled once. Its keys are single characters (widths, styled letters, ligatures,
radicals, presentation forms, spaces, invisible characters, hyphens), clusters of a base and the marks that compose
with it (accents, kana and its voicing marks in either width, Arabic letters and their signs, Indic vowel signs),
sequences of Korean letters, and words in which one script's letters stand for those of another that look alike.
Building the table checks that no key has two images and no image holds a key, so one pass is enough and a second
changes nothing. The compiled pattern takes the longest match at each place: a mixed word, else a cluster, else a
character.

Kept on purpose: Chinese and Japanese punctuation, joiners between letters of scripts that use them and within emoji,
superscripts and other signs that look unlike any plain character, foreign letters in words of their own.

Defined results: null and empty texts are never found and stay as they are; null names, entities and relations are
passed over; repeated rows give one result row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import p2_encoding
from folioweave.session import cut
from folioweave.sources.tables import table

# Ranges whose compatibility form looks the same (styled letters, ligatures, radicals, presentation and
# half-width forms, letter-like singletons), spaces, invisible characters and hyphens.
SAME_LOOK = [(0x1D400, 0x1D7FF), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB50, 0xFD3D), (0xFD50, 0xFDC7), (0xFE70, 0xFEFC), (0x2F00, 0x2FD5), (0x2E80, 0x2EF3), (0xF900, 0xFAD9), (0xFF61, 0xFF9F), (0x2126, 0x2126), (0x212A, 0x212B), (0xFF01, 0xFF5E)]
EAST_ASIAN_MARKS = "！，．：；？（）［］｛｝～、。「」『』《》〈〉【】…—"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u200b\u2060\ufeff\u180e\u034f\u2061\u2062\u2063\u2064"
HYPHENS = "\u2010\u2011"
JOINERS = "\u200c\u200d"
# Letters that look like the Latin letter beneath.
LOOK_CYRILLIC, AS_LATIN = "аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅ", "aeopcyxijshdqwABEKMHOPCTXYIJS"
LOOK_GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυιρ", "ABEZHIKMNOPTYXovuip"
LOOK_ARMENIAN, ARMENIAN_AS_LATIN = "օսոհցզՕՍՏԼ", "ounhgqOUSL"

_EAST = re.compile("[\u2e80-\u9fff\uf900-\ufaff\u3000-\u30ff\uff00-\uffef\uac00-\ud7a3]")


def _mapping() -> dict[str, str]:
    """The single-character table; raises if two rules disagree or an image needs mapping again."""
    pairs: list[tuple[str, str]] = []
    for lo, hi in SAME_LOOK:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            to = unicodedata.normalize("NFKC", ch)
            if to != ch and ch not in EAST_ASIAN_MARKS and " " not in to and unicodedata.category(ch) != "Cn":
                pairs.append((ch, to))
    pairs += [(c, " ") for c in SPACES] + [(c, "") for c in INVISIBLE] + [(c, "-") for c in HYPHENS]
    out: dict[str, str] = {}
    for a, b in pairs:
        if out.setdefault(a, b) != b:
            raise ValueError(f"two images of {a!r}")
    for a, b in out.items():
        if any(c in out for c in b):
            raise ValueError(f"the image of {a!r} needs mapping again")
    return out


def _compositions() -> tuple[set[str], set[str]]:
    """Characters that begin a canonical composition, and those that end one."""
    firsts, marks = set(), set()
    for cp in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(cp))
        if parts and parts[0] != "<" and " " in parts:
            a, b = (chr(int(x, 16)) for x in parts.split())
            if unicodedata.normalize("NFC", a + b) == chr(cp):
                firsts.add(a)
                marks.add(b)
    return firsts, marks


def _class(chars: set[str] | str) -> str:
    """The inside of a character class, as runs, in the notation of Python's patterns."""
    cps, runs = sorted(map(ord, chars)), []
    for cp in cps:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_GREEK, _CYRILLIC, _ARMENIAN = re.compile("[Ͱ-Ͽ]"), re.compile("[Ѐ-ӿ]"), re.compile("[\u0531-\u0587]")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_TO_LATIN = dict(zip(LOOK_CYRILLIC + LOOK_GREEK + LOOK_ARMENIAN, AS_LATIN + GREEK_AS_LATIN + ARMENIAN_AS_LATIN))
_TO_CYRILLIC = {b: a for a, b in zip(LOOK_CYRILLIC, AS_LATIN)}
# What may stand within a word without being a letter of any script.
_WITHIN = "\\u0300-\\u036f\\u00ad\\u200b\\u2060\\ufeff\\u200c\\u200d"
_L = f"A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f{_WITHIN}"
_O = f"\\u0370-\\u03ff\\u0400-\\u04ff\\u0531-\\u0587{_WITHIN}"
_MIXED = f"(?:[{_L}]++(?=[{_O}])|[{_O}]++(?=[{_L}]))"
# Korean letters, first, middle and last, that compose to syllables.
_JAMO = "[\\u1100-\\u1112][\\u1161-\\u1175][\\u11a8-\\u11c2]?|[\\uac00-\\ud7a3][\\u11a8-\\u11c2]"
_HALF_MARKS = "\uff9e\uff9f"


class Transducer:
    def __init__(self):
        self.table = _mapping()
        firsts, marks = _compositions()
        marks -= {chr(c) for c in range(0x1161, 0x11C3)}
        singles, self.marks = _class(set(self.table)), _class(marks | set(_HALF_MARKS))
        cluster = f"(?:[^\\W\\d_]|[{_class(firsts)}])[{self.marks}]+|{_JAMO}"
        rest = f"(?P<cluster>{cluster})|(?P<joiner>[{JOINERS}])|(?P<one>[{singles}])"
        self.pattern = re.compile(f"(?P<word>(?<![{_L}{_O}]){_MIXED}[{_L}{_O}]++)|{rest}")
        self.inner = re.compile(rest)
        self.touches = self._touches(set(self.table) | marks | set(_HALF_MARKS + JOINERS) | {chr(c) for c in [*range(0x300, 0x370), *range(0x1161, 0x11C3)]})

    @staticmethod
    def _touches(keys: set[str]) -> str:
        """What a text must hold for the transducer to touch it, as a pattern of Java: a character outside the widest
        runs without a key (few ranges, the commonest first, so that most characters take one comparison), or letters of
        two scripts side by side. Spark skips other rows without Python."""
        cps = sorted(ord(c) for c in keys)
        free = sorted(((b - a - 1, a + 1, b - 1) for a, b in zip([-1, *cps], [*cps, 0x110000]) if b - a > 24), key=lambda x: x[1])
        runs = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for _, a, b in free)
        latin, other = "A-Za-z\\x{c0}-\\x{24f}", "\\x{370}-\\x{4ff}\\x{531}-\\x{587}"
        return f"[^{runs}]|[{latin}](?=[{other}])|[{other}](?=[{latin}])"

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self._image, text)

    def _image(self, m: re.Match) -> str:
        kind, s = m.lastgroup, m[0]
        if kind == "word":
            return self.inner.sub(self._image, self._one_script(s))
        if kind == "cluster":
            return unicodedata.normalize("NFC", "".join(self.table.get(c, c) for c in s))
        if kind == "joiner":
            return s if _joins(m.string, m.start()) else ""
        if s == "\u3000":
            return s if _beside_east(m.string, m.start()) else " "
        return self.table[s]

    @staticmethod
    def _one_script(w: str) -> str:
        if not _LATIN.search(w):
            return w
        other = [c for c in w if _GREEK.match(c) or _CYRILLIC.match(c) or _ARMENIAN.match(c)]
        if all(c in _TO_LATIN for c in other):
            return "".join(_TO_LATIN.get(c, c) for c in w)
        latin = [c for c in w if _LATIN.match(c)]
        if all(c in _TO_CYRILLIC for c in latin) and all(_CYRILLIC.match(c) for c in other):
            return "".join(_TO_CYRILLIC.get(c, c) for c in w)
        return w


def _joins(s: str, i: int) -> bool:
    """Whether a joiner at i stands between letters or marks of a script that uses joiners, or within an emoji."""
    before = s[i - 1] if i else ""
    after = s[i + 1] if i + 1 < len(s) else ""

    def uses(c: str) -> bool:
        return bool(c) and ("؀" <= c <= "ۿ" or "܀" <= c <= "ހ" or "ऀ" <= c <= "෿" or "က" <= c <= "႟" or "ក" <= c <= "᠏")

    def pictured(c: str) -> bool:
        return bool(c) and (ord(c) >= 0x1F000 or "☀" <= c <= "➿" or c in "\ufe0f\u2640\u2642\u2695")

    return (uses(before) and uses(after) and (_virama(before) or _virama(after) or "؀" <= before <= "ۿ")) or (pictured(before) and pictured(after) and s[i] == "‍")


def _virama(c: str) -> bool:
    return unicodedata.combining(c) == 9


def _beside_east(s: str, i: int) -> bool:
    """An ideographic space counts as East Asian punctuation only next to East Asian text, and not next to other letters."""
    around = [c for c in (s[i - 1 : i], s[i + 1 : i + 2]) if c]
    return bool(around) and all(_EAST.match(c) or c in "\n" for c in around) and any(_EAST.match(c) for c in around)


@functools.cache
def transducer() -> Transducer:
    return Transducer()


def normalised(rows: DataFrame) -> DataFrame:
    """rows (rec_table, rec_key, field, source, text) that the transducer changes, with their `form`."""
    schema = "rec_table string, rec_key string, field string, source string, text string, form string"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer()
        for b in batches:
            form = b["text"].map(t)
            yield b.assign(form=form)[form != b["text"]]

    high = F.length("text") != F.octet_length("text")
    return rows.where(high & F.col("text").rlike(transducer().touches)).select("rec_table", "rec_key", "field", "source", "text").mapInPandas(part, schema)


def texts_of(chunks: DataFrame) -> DataFrame:
    """Chunk texts as records; `source` is the file, as problem 2 reads it."""
    return chunks.where("id is not null and text is not null").select(F.lit("chunks").alias("rec_table"), F.col("id").alias("rec_key"), F.lit("text").alias("field"), F.coalesce("doc", F.lit("")).alias("source"), F.col("text").alias("text"))


def names_of(extractions: DataFrame) -> DataFrame:
    """Every entity name, relation source and relation target of an extraction, one row each."""

    def names(field: str, each) -> DataFrame:
        return extractions.where("id is not null").select(F.lit("extractions").alias("rec_table"), F.col("id").alias("rec_key"), F.lit(field).alias("field"), F.lit("").alias("source"), F.explode(each).alias("text"))

    both = F.flatten(F.transform("relations", lambda r: F.array(r["source"], r["target"])))
    return names("entities", F.transform("entities", lambda e: e["name"])).unionByName(names("relations", both)).where("text is not null")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p6_found: records that the transducer changes, without chunks that are garbled (problem 2).

    Problem 2 learns from all its records, but judges here only the chunks that changed: no other can be taken away.
    """
    chunks, runs = table(spark, folder, "chunks", "id", "doc", "text"), table(spark, folder, "conv_results", "conv_id", "project", "method")
    changed = cut(normalised(texts_of(chunks)))
    garbled = p2_encoding.restored(changed, p2_encoding.fit(p2_encoding.records_of(chunks, runs)))
    names = normalised(names_of(table(spark, folder, "extractions", "id", "entities", "relations")))
    mine = changed.select("rec_table", "rec_key").distinct().join(garbled.select("rec_key"), "rec_key", "left_anti")
    return mine.select("rec_table", "rec_key").unionByName(names.select("rec_table", "rec_key").distinct())


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """p6_forms: every chunk text and every name that changes, with its one form."""
    rows = texts_of(table(spark, folder, "chunks", "id", "doc", "text")).unionByName(names_of(table(spark, folder, "extractions", "id", "entities", "relations")))
    return normalised(rows).select("rec_table", "rec_key", "field", "text", "form").distinct()


QUERIES = {"p6_found": found, "p6_forms": forms}
SQL: dict[str, str] = {}
