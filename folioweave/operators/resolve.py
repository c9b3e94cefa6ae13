"""Entity resolution: spellings of one name to one entity.

Names are joined by the same normal form, by similarity of normal forms that share a block, by an acronym and the only
name it may stand for, and by hash embeddings that a looser similarity confirms; entities are the connected components.

Similar names are sought in blocks (script, first or last two characters of a word) of one length band each, with the band
beside it. A block of more than TILE names is cut into tiles by a hash, and every pair of tiles is a task of its own, so
no task holds more than two tiles; names go to tasks, pairs never leave them unless they link. Within a tile, lengths and
marks of 64 bits leave few pairs to be measured exactly, each in one of the blocks it shares. The marks bound the
similarity from above, so none that links is lost. The pairs passed over are still quadratic in a block.

Defined results: names that are null or blank are no mentions; names that normalise to nothing join no other by form or by
similarity; of equally frequent labels the longer, then the first seen; of equally frequent types the first seen.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioweave.functions.names import LENGTH_APART, THRESHOLD, THRESHOLDS, acronym, block_keys, initials, normalised, script, set_ratio, siblings, threshold
from folioweave.functions.text import strip
from folioweave.operators.components import components
from folioweave.operators.ranking import numbered
from folioweave.session import cut
from folioweave.sources.tables import table

TILE = 4000
COSINE, LOOSE = 0.92, 60
LETTERS, PAIRS = 48, 512
# A name's mark, and how many pairs of marks are passed over at once.
MARK = np.dtype([("p", "<u8"), ("q", "<u8"), ("signs", "<u8"), ("length", "<i4"), ("whole", "<i2"), ("subset", "u1"), ("close", "u1")])
SCAN = 1 << 17


def names_of(mentions: DataFrame) -> DataFrame:
    """A2: (id, name, norm, freq, ord, type, types) of every distinct spelling of mentions (name, type, ord); `ord` is
    where it is first seen, and numbers it; `types` its types with their counts and first places."""
    m = mentions.select(strip(F.col("name")).alias("name"), F.coalesce(F.when(F.col("type") != "", F.col("type")), F.lit("other")).alias("type"), "ord").where("name != ''")
    by_type = m.groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    names = by_type.groupBy("name").agg(F.sum("n").alias("freq"), F.min("first").alias("ord"), F.collect_list(F.struct("type", "n", "first")).alias("types"))  # a name has as many entries as there are types
    return names.withColumn("norm", normalised("name"))


def _same_form(names: DataFrame) -> DataFrame:
    """Links of equal normal forms: each to the least name of its form, so a form that many share gives a star, no clique."""
    least = names.where("norm != ''").groupBy("norm").agg(F.min("name").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return names.join(least, "norm").select(F.col("name").alias("a"), "b").where("a != b")


def blocks(forms: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, band, left, right, mine, own, norm, name, keys, marks): what every task compares. `forms` has one row for each
    normal form; `keys` are all its keys."""
    band = F.floor(F.length("norm") / (LENGTH_APART + 1))
    marked = forms.where("norm != ''").select("norm", "name", band.alias("own"), block_keys(F.col("norm")).alias("all"), _marks("norm", "name").alias("marks"))
    keyed = marked.select("norm", "name", "own", F.array_join("all", " ").alias("keys"), "marks", F.explode("all").alias("key"))
    # A form goes to its own band as the shorter side and to the one before as the longer side.
    placed = keyed.select("key", "norm", "name", "keys", "marks", "own", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band")).where("band >= 0")
    sizes = placed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n")).select("key", "band", F.ceil(F.col("n") / tile).cast("int").alias("tiles"), "n").where("n > 1")
    sized = placed.join(sizes, ["key", "band"]).withColumn("mine", F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("left"), F.greatest(t, F.col("mine")).alias("right")))
    return sized.select("*", F.explode(pairs).alias("p")).select("key", "band", "p.left", "p.right", "mine", "own", "norm", "name", "keys", "marks")


@lru_cache(200_000)
def _place(token: str) -> tuple[int, int]:
    h = hashlib.md5(token.encode()).digest()
    return h[15], 1 if h[14] & 1 else -1


def _embedding(name: str) -> np.ndarray:
    v = np.zeros(256, dtype=np.float32)
    for t in re.findall("[a-z0-9]+", name.lower()):
        at, s = _place(t)
        v[at] += s
    size = float(np.sqrt((v * v).sum()))
    return v / size if size else v


def _letters(texts: list[str]) -> np.ndarray:
    """How often each of LETTERS classes of characters is in each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % LETTERS
    of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    return np.bincount(of * LETTERS + codes, minlength=len(texts) * LETTERS).reshape(len(texts), LETTERS).astype(np.int32)


def _pair_bits(texts: list[str]) -> np.ndarray:
    """Bits of the pairs of characters in each text, spaces around it, in PAIRS classes: (words of 64, texts)."""
    codes = np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(x) + 2 for x in texts])
    within = of[1:] == of[:-1]
    at = (codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA6B) >> np.uint64(7)) % np.uint64(PAIRS)
    held = np.zeros((len(texts), PAIRS), bool)
    held[of[1:][within], at[within]] = True
    return np.ascontiguousarray(np.packbits(held, axis=1).view(np.uint64).T)


def _bar(short: int) -> int:
    return next((max(bar, THRESHOLD) for upto, bar in THRESHOLDS if short <= upto), THRESHOLD)


def _word_set(norm: str) -> str:
    """What is measured of a normal form: each of its words once."""
    return " ".join(sorted(set(norm.split())))


@lru_cache(200_000)
def _pairs_of(word: str) -> int:
    bits, padded = 0, f" {word} "
    for a, b in zip(padded, padded[1:]):
        bits |= 1 << ((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B) >> 7) % 128
    return bits


def _mark(norm: str, name: str) -> bytes:
    """Bits of the pairs of characters in the word set (two words of 64) and of the embedding's signed places, with what
    another name must share of them at least, as MARK. With L characters in common, the word sets of two names, l and m long, differ in
    3 (l + m - 2 L) pairs of characters at most, and the shared words in none."""
    n, bits = len(_word_set(norm)), 0
    for w in set(norm.split()):
        bits |= _pairs_of(w)
    v: dict[int, int] = {}
    for t in re.findall("[a-z0-9]+", name.lower()):
        at, s = _place(t)
        v[at] = v.get(at, 0) + s
    signs, square = 0, sum(x * x for x in v.values())
    for at, x in v.items():
        if x:
            signs |= 1 << (at * 2 + (x > 0)) % 64
    on = bits.bit_count()
    whole = max(-1000, math.floor(4 * (on - 3 * (1 - THRESHOLD / 100) * n) - 1e-6))
    subset = max(0, math.ceil(on - (1 - THRESHOLD / (200 - THRESHOLD)) * n - 1e-6))
    close = max(0, math.ceil(signs.bit_count() - (1 - COSINE**2) * square - 1e-3)) if square else 255
    return struct.pack("<QQQihBB", bits & (1 << 64) - 1, bits >> 64, signs, n, whole, subset, min(close, 255))


@F.pandas_udf(BinaryType())
def _marks(norms: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([_mark(x, y) for x, y in zip(norms, names)], dtype=object)


def _near(m: dict[str, np.ndarray], size: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of `rows` and `cols` (places, in order of size) whose marks allow a link; with `same`, each once."""
    fields = ("p", "q", "signs", "whole", "subset", "close")
    r, i = {f: m[f][cols] for f in fields}, 0
    lengths = size[cols]
    while i < len(rows):
        low, step = int(np.searchsorted(lengths, size[rows[i]] - LENGTH_APART)) if not same else i, 1
        step = max(1, SCAN // max(1, len(cols) - low))
        at = rows[i : i + step]
        high = int(np.searchsorted(lengths, size[at[-1]] + LENGTH_APART, "right"))
        if high > low:
            x, y = {f: m[f][at][:, None] for f in fields}, {f: r[f][None, low:high] for f in fields}
            both = np.bitwise_count(x["p"] & y["p"])
            both += np.bitwise_count(x["q"] & y["q"])
            allowed = both >= np.minimum(x["subset"], y["subset"])
            allowed |= both.astype(np.int16) * np.int16(8) >= x["whole"] + y["whole"]
            allowed |= np.bitwise_count(x["signs"] & y["signs"]) >= np.maximum(x["close"], y["close"])
            a, b = np.nonzero(allowed)
            if same:
                a, b = a[a + i < b + low], b[a + i < b + low]
            a, b = at[a], cols[low + b]
            keep = np.abs(size[a] - size[b]) <= LENGTH_APART
            yield a[keep], b[keep]
        i += step


def _earlier(keys: list[str], key: str) -> list[np.ndarray]:
    """Which of the keys before `key` each name has, as bits; the keys most names have come first."""
    before = [[k for k in x.split(" ") if k < key] for x in keys]
    often = Counter(k for x in before for k in x)
    place = {k: i for i, (k, n) in enumerate(often.most_common()) if n > 1}
    bits = [sum(1 << place[k] for k in x if k in place) for x in before]
    return [np.array([x >> w & (1 << 64) - 1 for x in bits], np.uint64) for w in range(0, len(place), 64)]


def similar_links(part: pa.Table) -> pa.Table:
    """Links among the names of one pair of tiles: by similarity, or by embedding and a looser similarity."""
    norms = part["norm"].to_pylist()
    order = sorted(range(len(norms)), key=lambda i: len(norms[i]))
    norms = [norms[i] for i in order]
    names, keys, marks = (part[c].take(pa.array(order)).to_pylist() for c in ("name", "keys", "marks"))
    mine, own = (part[c].to_numpy()[order] for c in ("mine", "own"))
    key, band, left, right = (part[c][0].as_py() for c in ("key", "band", "left", "right"))
    size = np.array([len(x) for x in norms])
    held = np.frombuffer(b"".join(marks), MARK)
    m = {f: np.ascontiguousarray(held[f]) for f in MARK.names}
    short, long = np.flatnonzero(own == band), np.flatnonzero(own != band)  # two of the next band meet there
    if left == right:
        sides = [(short, short, True), (short, long, False)]
    else:
        here, there = mine == left, mine == right
        sides = [(short[here[short]], np.flatnonzero(there), False), (long[here[long]], short[there[short]], False)]
    earlier = _earlier(keys, key)
    vectors, text, words = lru_cache(None)(lambda i: _embedding(names[i])), lru_cache(None)(lambda i: _word_set(norms[i])), lru_cache(None)(lambda i: frozenset(norms[i].split()))
    bars = np.array([_bar(x) for x in size.tolist()])  # the shorter of two has the higher bar
    out = []
    for a, b in _gathered(_of_block(m, size, sides, earlier)):
        if len(a):
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            texts = [text(i) for i in used.tolist()]
            close = np.bitwise_count(m["signs"][a] & m["signs"][b]) >= np.maximum(m["close"][a], m["close"][b])
            at = _likely(at[: len(a)], at[len(a) :], np.maximum(bars[a], bars[b]), m["length"][used], _letters(texts), _pair_bits(texts)) | close
            for i, j, c in zip(a[at].tolist(), b[at].tolist(), close[at].tolist()):
                bar = max(bars[i], bars[j])
                c = c and vectors(i) @ vectors(j) >= COSINE
                ratio = set_ratio(words(i), words(j), LOOSE if c else bar)
                if (ratio >= bar and not _siblings(norms[i], norms[j])) or (c and ratio >= LOOSE):
                    out.append((names[i], names[j]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.string()), "b": pa.array([b for _, b in out], pa.string())})


def _of_block(m: dict[str, np.ndarray], size: np.ndarray, sides: list[tuple], earlier: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for rows, cols, same in sides:
        for a, b in _near(m, size, rows, cols, same) if len(rows) and len(cols) else ():
            for e in earlier:
                first = (e[a] & e[b]) == 0  # else another block's pair
                a, b = a[first], b[first]
            yield a, b


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in parts of about SCAN: what is counted of a name is counted once a part."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= SCAN:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _likely(a: np.ndarray, b: np.ndarray, bar: np.ndarray, length: np.ndarray, letters: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which pairs may reach their bar by the letters and, as with the marks, by the pairs of characters they share."""
    n, k = length[a], length[b]
    common = np.minimum(letters[a], letters[b]).sum(axis=1)
    on, other, both = (sum(np.bitwise_count(w).astype(np.int32) for w in x) for x in ((p[a] for p in pairs), (p[b] for p in pairs), (p[a] & p[b] for p in pairs)))
    whole = (200.0 * common / (n + k) >= bar) & (on + other - 2 * both <= 3 * (1 - bar / 100) * (n + k) + 1e-6)
    apart = 1 - bar / (200 - bar)
    subset = (on - both <= apart * n + 1e-6) | (other - both <= apart * k + 1e-6)
    return whole | subset & (200.0 * common / (common + np.minimum(n, k)) >= bar)


def _siblings(a: str, b: str) -> bool:
    x, y = a.split(), b.split()
    apart = [(s, t) for s, t in zip(x, y) if s != t]
    if len(x) != len(y) or len(apart) != 1:
        return False
    s, t = apart[0]
    return (s.isdigit() and t.isdigit()) or (s[:-1] == t[:-1] and s[-1:].isdigit() and t[-1:].isdigit())


def _similar(names: DataFrame, tile: int) -> DataFrame:
    forms = names.groupBy("norm").agg(F.min("name").alias("name"))
    width = 4 * max(names.sparkSession.sparkContext.defaultParallelism, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = blocks(forms, tile).repartition(width, "key", "band", "left", "right")  # by number: small data is long work, which AQE would put together
    return tasks.groupBy("key", "band", "left", "right").applyInArrow(similar_links, "a string, b string")


def acronym_links(names: DataFrame) -> DataFrame:
    """(a, b) of every acronym and the only name with as many words and those initials; none where two names have them."""
    short = names.select(F.col("name").alias("a"), acronym(F.col("name")).alias("key")).where("key is not null")
    long = names.select("name", initials(F.col("name")).alias("key")).where("key is not null and length(key) between 2 and 6")
    only = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("b")).where("n = 1")
    return short.join(only, "key").select("a", "b")


def resolved(mentions: DataFrame, fuzzy: bool = True, tile: int = TILE) -> DataFrame:
    """(name, norm, cid, label, type, count, freq) of every spelling of mentions (name, type, ord).

    `fuzzy=False` leaves out the two kinds of links by similarity; there is no cap on the number of names.
    """
    names = cut(names_of(mentions))
    links = _same_form(names).unionByName(acronym_links(names))
    if fuzzy:
        links = links.unionByName(cut(_similar(names, tile)))  # components read links twice
    by = cut(components(names.select(F.col("name").alias("id")), links))
    members = names.join(by.withColumnRenamed("id", "name"), "name")
    return members.join(rolled_up(members), "component").select("name", "norm", "freq", "cid", "label", "type", "count")


def rolled_up(members: DataFrame) -> DataFrame:
    """(component, cid, label, type, count): the label most frequent, then longest, then first; the type most
    frequent, then first; entities numbered by where their first name is first seen."""
    best = F.min(F.struct((-F.col("freq")).alias("f"), (-F.length("name")).alias("l"), "ord", "name")).alias("best")
    heads = members.groupBy("component").agg(best, F.sum("freq").alias("count"), F.min("ord").alias("ord"))
    kinds = members.select("component", F.explode("types").alias("t")).groupBy("component", "t.type").agg(F.sum("t.n").alias("n"), F.min("t.first").alias("first"))
    kind = kinds.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "type")).alias("k"))
    both = heads.join(kind, "component").select("component", "ord", F.col("best.name").alias("label"), F.col("k.type").alias("type"), "count")
    return numbered(both, "ord", "cid").withColumn("cid", F.concat(F.lit("e"), F.col("cid").cast("string"))).drop("ord")


def extraction_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions (id, name, type, ord) of the extractions table; repeated rows count once."""
    rows = table(spark, folder, "extractions", "id", "entities").where("id is not null").groupBy("id").agg(F.first("entities").alias("entities"))
    each = rows.select("id", F.posexplode("entities").alias("rank", "e"))
    return each.select("id", "e.name", "e.type", F.struct(F.col("id").alias("doc"), F.lit(0).cast("long").alias("idx"), "rank").alias("ord"))


def resolution_query(spark: SparkSession, folder: str) -> DataFrame:
    """entity_resolution: entities of the extractions table, all kinds of links."""
    return resolved(extraction_mentions(spark, folder)).select("name", "cid", "label", "type", "count")


def _part_mentions(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    return p.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.struct(F.lit("part").alias("doc"), F.col("p_partkey").alias("idx"), F.lit(0).alias("rank")).alias("ord"))


def components_query(spark: SparkSession, folder: str) -> DataFrame:
    """entity_components: the names of parts, customers and suppliers by normal form and acronym."""
    c = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    s = table(spark, folder, "supplier", "s_suppkey", "s_name")

    def rows(df: DataFrame, doc: str, key: str, name, kind) -> DataFrame:
        return df.select(name.alias("name"), kind.alias("type"), F.struct(F.lit(doc).alias("doc"), F.col(key).alias("idx"), F.lit(0).alias("rank")).alias("ord"))

    m = _part_mentions(spark, folder).unionByName(rows(c, "customer", "c_custkey", F.lower(F.col("c_name")), F.col("c_mktsegment")))
    m = m.unionByName(rows(c, "customer-raw", "c_custkey", F.col("c_name"), F.col("c_mktsegment"))).unionByName(rows(s, "supplier", "s_suppkey", F.regexp_replace("s_name", "#", " "), F.lit("org")))
    return resolved(m, fuzzy=False).select("name", "norm", "cid", "label", "type", "count")


def blocking_query(spark: SparkSession, folder: str) -> DataFrame:
    """name_blocking: how many part, customer and supplier names share each blocking key."""
    p, c, s = (table(spark, folder, t, n).select(F.col(n).alias("name")) for t, n in (("part", "p_name"), ("customer", "c_name"), ("supplier", "s_name")))
    norm = p.unionByName(c).unionByName(s).distinct().select("name", normalised("name").alias("norm"))
    return norm.select(F.explode(block_keys(F.col("norm"))).alias("key"), script(F.col("norm")).alias("script")).groupBy("key", "script").agg(F.count(F.lit(1)).alias("names"))


def siblings_query(spark: SparkSession, folder: str) -> DataFrame:
    """numbered_siblings: for every supplier and the next one by key, whether they are siblings, and the similarity they would need."""
    s = table(spark, folder, "supplier", "s_suppkey", "s_name").select("s_suppkey", F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", " ")).alias("a"))
    t = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("a").alias("b"))
    return s.join(t, "s_suppkey").select("s_suppkey", siblings(F.col("a"), F.col("b")).alias("siblings"), threshold(F.col("a"), F.col("b")).alias("needed"))


def acronym_query(spark: SparkSession, folder: str) -> DataFrame:
    """acronym_links: acronyms of the extractions' names with what they stand for."""
    return acronym_links(extraction_mentions(spark, folder).select(strip(F.col("name")).alias("name")).where("name != ''").distinct())


_FORM = "trim(lower(regexp_replace(name, '[^A-Za-z0-9_]+', ' ', 'g')))"
_KEYS = "list_distinct(list_concat(list_transform(string_split(norm, ' '), lambda t: 'la:p' || substr(t, 1, 2)), list_transform(string_split(norm, ' '), lambda t: 'la:s' || right(t, 2))))"
_WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_INITIAL_WORDS = rf"list_filter(regexp_split_to_array(trim(name), '{_WS}'), lambda w: regexp_matches(w, '^\p{{L}}'))"

QUERIES = {
    "entity_resolution": resolution_query,
    "entity_components": components_query,
    "name_blocking": blocking_query,
    "numbered_siblings": siblings_query,
    "acronym_links": acronym_query,
}
SQL = {
    "entity_components": f"""
    WITH RECURSIVE m AS (SELECT p_name AS name, p_type AS type, 'part' AS doc, p_partkey AS idx FROM part UNION ALL SELECT lower(c_name), c_mktsegment, 'customer', c_custkey FROM customer
            UNION ALL SELECT c_name, c_mktsegment, 'customer-raw', c_custkey FROM customer UNION ALL SELECT replace(s_name, '#', ' '), 'org', 'supplier', s_suppkey FROM supplier),
         n AS (SELECT name, count(*) AS freq, min({{'doc': doc, 'idx': idx}}) AS ord, {_FORM} AS norm FROM m GROUP BY name),
         w AS (SELECT name, {_INITIAL_WORDS} AS w, regexp_replace(name, '[^A-Za-z]', '', 'g') AS l FROM n),
         ac AS (SELECT name, upper(l) AS key FROM w WHERE len(w) <= 1 AND length(l) BETWEEN 2 AND 6 AND trim(name) = upper(trim(name))),
         ini AS (SELECT upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS key, min(name) AS name FROM w WHERE len(w) BETWEEN 2 AND 6 AND name NOT IN (SELECT name FROM ac) GROUP BY key HAVING count(*) = 1),
         e AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.norm = b.norm AND a.norm != '' AND a.name != b.name UNION SELECT ac.name, ini.name FROM ac JOIN ini USING (key)),
         b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
         r AS (SELECT name AS id, name AS c FROM n UNION SELECT b.b, r.c FROM r JOIN b ON b.a = r.id),
         cc AS (SELECT id AS name, min(c) AS c FROM r GROUP BY id),
         mem AS (SELECT n.*, c FROM n JOIN cc USING (name)),
         lab AS (SELECT c, first(name ORDER BY freq DESC, length(name) DESC, ord) AS label, sum(freq)::BIGINT AS count, min(ord) AS ord FROM mem GROUP BY c),
         ty AS (SELECT c, type, count(*) AS k, min({{'doc': doc, 'idx': idx}}) AS f FROM m JOIN mem USING (name) GROUP BY ALL),
         tt AS (SELECT c, first(type ORDER BY k DESC, f) AS type FROM ty GROUP BY c),
         num AS (SELECT c, label, count, 'e' || (row_number() OVER (ORDER BY ord) - 1) AS cid FROM lab)
    SELECT name, norm, cid, label, type, count FROM mem JOIN num USING (c) JOIN tt USING (c)
    """,
    "name_blocking": f"""
    WITH m AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer UNION SELECT s_name FROM supplier), n AS (SELECT name, {_FORM} AS norm FROM m), k AS (SELECT unnest({_KEYS}) AS key FROM n)
    SELECT key, 'la' AS script, count(*) AS names FROM k GROUP BY key
    """,
    "numbered_siblings": """
    WITH s AS (SELECT s_suppkey, string_split(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS a FROM supplier),
         p AS (SELECT x.s_suppkey, x.a, y.a AS b FROM s x JOIN s y ON y.s_suppkey = x.s_suppkey + 1),
         d AS (SELECT *, list_filter(range(1, len(a) + 1), lambda i: a[i] != b[i]) AS i FROM p)
    SELECT s_suppkey, len(a) = len(b) AND len(i) = 1 AND ((regexp_matches(a[i[1]], '^[0-9]+$') AND regexp_matches(b[i[1]], '^[0-9]+$'))
        OR (a[i[1]][:-2] = b[i[1]][:-2] AND regexp_matches(a[i[1]], '[0-9]$') AND regexp_matches(b[i[1]], '[0-9]$'))) AS siblings,
        CASE WHEN least(length(array_to_string(a, ' ')), length(array_to_string(b, ' '))) <= 4 THEN 95 WHEN least(length(array_to_string(a, ' ')), length(array_to_string(b, ' '))) <= 6 THEN 91 ELSE 88 END AS needed FROM d
    """,
    "acronym_links": rf"""
    WITH n AS (SELECT DISTINCT regexp_replace(e.name, '^{_WS}|{_WS}$', '', 'g') AS name FROM (SELECT unnest(entities) AS e FROM extractions) WHERE e.name IS NOT NULL),
         w AS (SELECT name, {_INITIAL_WORDS} AS w, regexp_replace(name, '[^A-Za-z]', '', 'g') AS l FROM n WHERE name != ''),
         ac AS (SELECT name, upper(l) AS key FROM w WHERE len(w) <= 1 AND length(l) BETWEEN 2 AND 6 AND trim(name) = upper(trim(name))),
         ini AS (SELECT upper(array_to_string(list_transform(w, lambda x: x[1]), '')) AS key, min(name) AS name FROM w WHERE len(w) >= 2 AND name NOT IN (SELECT name FROM ac) GROUP BY key HAVING count(*) = 1)
    SELECT ac.name AS a, ini.name AS b FROM ac JOIN ini USING (key) WHERE length(key) BETWEEN 2 AND 6
    """,
}
