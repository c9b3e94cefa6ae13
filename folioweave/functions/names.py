"""Names: one normal form, blocking keys, similarity, siblings and acronyms.

Normal form and similarity need Unicode decomposition and a subsequence length, which Spark has no expressions for: they
are Arrow UDFs, to be used on distinct names or on candidate pairs only. The rest are column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from folioweave.functions.text import WS, words

# The similarity that links, for names whose shorter one has up to 4, up to 6, and more characters.
THRESHOLDS = [(4, 95), (6, 91)]
THRESHOLD = 88
LENGTH_APART = 12
_BRAHMIC = ("ऀ", "෿")
_SQUEEZE = re.compile(r"[^\wऀ-෿]+")


@lru_cache(100_000)
def normal_form(name: str) -> str:
    """without accents (signs of Indic scripts stay), compatibility forms unfolded, only words, lower case."""
    if not name.isascii():
        parts = unicodedata.normalize("NFKD", name)
        name = unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c) or _BRAHMIC[0] <= c <= _BRAHMIC[1]))
    return _SQUEEZE.sub(" ", name).lower().strip()


@F.pandas_udf(StringType())
def normalised(names: pd.Series) -> pd.Series:
    """F18 on a column; null gives an empty form."""
    return names.map(lambda n: normal_form(n or ""))


def script(norm: Column) -> Column:
    """`bn`, `la`, or `u` and the number of the 256-block of the first character that is no space; empty for none."""
    first = F.substring(F.regexp_replace(norm, "^ +", ""), 1, 1)
    return F.when(first == "", "").when(first.rlike("[ঀ-৿]"), "bn").when(first.rlike("[A-Za-z0-9]"), "la").otherwise(F.concat(F.lit("u"), F.floor(F.ascii(first) / 256).cast("string")))


def block_keys(norm: Column) -> Column:
    """for each word, script with its first two and with its last two characters; a name without words has one key."""
    tag, w = script(norm), words(norm)
    keys = F.concat(F.transform(w, lambda t: F.concat(tag, F.lit(":p"), F.substring(t, 1, 2))), F.transform(w, lambda t: F.concat(tag, F.lit(":s"), F.right(t, F.lit(2)))))
    return F.when(F.size(w) == 0, F.array(F.concat(tag, F.lit(":")))).otherwise(F.array_distinct(keys))


def threshold(a: Column, b: Column, base: int = THRESHOLD) -> Column:
    """the similarity two normal forms must reach; short ones need more."""
    short = F.least(F.length(a), F.length(b))
    out = F.lit(base)
    for upto, least in reversed(THRESHOLDS):
        out = F.when(short <= upto, max(base, least)).otherwise(out)
    return out


def siblings(a: Column, b: Column) -> Column:
    """the same words but for one, and that one a number, or the same up to its last digit."""
    x, y = words(a), words(b)
    apart = F.filter(F.zip_with(x, y, lambda s, t: F.struct(s.alias("s"), t.alias("t"))), lambda p: ~p["s"].eqNullSafe(p["t"]))
    s, t = F.get(apart, F.lit(0))["s"], F.get(apart, F.lit(0))["t"]
    number = s.rlike(r"^\p{Nd}+$") & t.rlike(r"^\p{Nd}+$")
    last = s.rlike(r"\p{Nd}$") & t.rlike(r"\p{Nd}$") & (F.regexp_replace(s, ".$", "") == F.regexp_replace(t, ".$", ""))
    return F.coalesce((F.size(x) > 0) & (F.size(x) == F.size(y)) & (F.size(apart) == 1) & (number | last), F.lit(False))


def acronym(name: Column) -> Column:
    """the letters of a single upper-case word of two to six letters; null for other names."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    one = F.size(F.filter(F.split(F.trim(name), f"[{WS}]+"), lambda w: w.rlike(r"^\p{L}"))) <= 1
    return F.when(one & F.length(letters).between(2, 6) & (F.trim(name) == F.upper(F.trim(name))), F.upper(letters))


def initials(name: Column) -> Column:
    """the initials of two or more words that begin with a letter; null for other names."""
    w = F.filter(F.split(F.trim(name), f"[{WS}]+"), lambda w: w.rlike(r"^\p{L}"))
    return F.when(acronym(name).isNull() & (F.size(w) >= 2), F.upper(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyrö)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def _ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """the best of three similarities between the shared words, and these with either side's own words."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    return max(_ratio(both, left), _ratio(both, right), _ratio(left, right))


def set_ratio(x: frozenset[str], y: frozenset[str], least: float = 0) -> float:
    """F21 of two sets of words, neither empty; where it is below `least`, any number below that.

    The shared words begin both sides, so a common subsequence is sought in what follows them only.
    """
    both = x & y
    n, k = (sum(map(len, z)) + len(z) - 1 for z in (x, y))
    shared = sum(map(len, both)) + len(both) - 1 if both else 0
    best = 200.0 * shared / (shared + min(n, k))
    a, b = x - both, y - both
    if a and b:
        start = shared + 1 if both else 0
        if best < 200.0 * min(n, k) / (n + k) >= least:
            best = max(best, 200.0 * (start + common_length(" ".join(sorted(a)), " ".join(sorted(b)))) / (n + k))
    return best


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """F21 on two columns of normal forms."""
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)
