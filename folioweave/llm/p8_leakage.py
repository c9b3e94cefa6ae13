"""Problem 8: evaluation passages inside a training corpus.

Spaced-seed hashing: a seed is a fixed mask over SPAN consecutive words, of which some are ignored. Every position of
every document and of every item is hashed under every mask; equal hashes are hits. A hit at (document position, item
position) fixes a diagonal, and around it the overlap is verified: the longest exact run of words, and the longest run
that tolerates substitutions.

Any RUN consecutive equal words contain a hit under every mask, so exact passages are never missed; a passage of which
words were replaced is found as long as one mask ignores those words.

Items are hashed once. Where their hashes are few (MOST_HELD), they go to the executors as one sorted array that sieves
the documents' hashes before anything is shuffled; beyond that, the hashes are joined by a shuffle. Both ways end in
the same join of hits with items, and give the same rows.

Defined results: null and empty texts hold nothing; an item of fewer than RUN words can't be found; repeated documents
are each reported; an item or document with a null id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import small_side
from folioweave.sources.tables import table

RUN = 12
# The masks (1: the word counts). All have span 12; they ignore two to four inner words; the last two
# reach passages in which every fifth or sixth word is another.
MASKS = ["111111111111", "110111011011", "101101110111", "111010111101", "111011110111", "111011111011"]
MOST_HELD = 2_000_000  # hashes: 16 MB
MISMATCHES = 0.2  # share of substituted words that a tolerant overlap may have


def words(text: str | None) -> list[str]:
    """Lower-case; every character but letters, digits, combining marks and white space deleted; split on white space."""
    return _JOINED.sub("", (text or "").lower()).split()


try:
    import regex

    _JOINED = regex.compile(r"[^\p{L}\p{Nd}\p{No}\p{M}\s]")
except ImportError:  # combining marks are not word characters for re
    import unicodedata

    class _Joined:
        @staticmethod
        def sub(_: str, s: str) -> str:
            return "".join(c for c in s if c.isspace() or unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "No"))

    _JOINED = _Joined()


def _hash_words(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in ws], dtype=np.uint64)


_WEIGHTS = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, RUN * 2, dtype=np.uint64) | np.uint64(1)


def seeds(ws: list[str]) -> np.ndarray:
    """(mask, position) -> hash, as signed 64-bit numbers; no columns for fewer than RUN words."""
    n = len(ws) - RUN + 1
    if n < 1:
        return np.zeros((len(MASKS), 0), dtype=np.int64)
    h = _hash_words(ws)
    out = np.zeros((len(MASKS), n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for m, mask in enumerate(MASKS):
            out[m] = np.uint64(m + 1) * np.uint64(0x9E3779B97F4A7C15)
            for p, on in enumerate(mask):
                if on == "1":
                    v = h[p : p + n] * _WEIGHTS[p]
                    out[m] += (v ^ (v >> np.uint64(29))) * _WEIGHTS[RUN + p]
    return out.view(np.int64)


def _seed_rows(rows: DataFrame, key: str, sieve: np.ndarray | None) -> DataFrame:
    """(key, seed, pos): every hash of every text; with a sieve, only hashes in it."""
    held = None if sieve is None else rows.sparkSession.sparkContext.broadcast(sieve)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if held is None else held.value
        for b in batches:
            ids, hashes, places = [], [], []
            for i, text in zip(b[key], b["text"]):
                s = seeds(words(text))
                if not s.size:
                    continue
                if known is not None:
                    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    m, p = np.nonzero(known[at] == s) if len(known) else (np.zeros(0, int), np.zeros(0, int))
                else:
                    m, p = np.indices(s.shape).reshape(2, -1)
                ids.append(np.full(len(p), i))
                hashes.append(s[m, p])
                places.append(p)
            if ids:
                yield pd.DataFrame({key: np.concatenate(ids), "seed": np.concatenate(hashes), "pos": np.concatenate(places)})

    return rows.where(f"{key} is not null and text is not null").select(key, "text").mapInPandas(part, f"{key} long, seed long, pos int")


def overlap(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """On a diagonal (a[i] against b[i - shift], hashes of words): the longest exact run, and length and matches of the best
    tolerant overlap: the stretch with the greatest sum of +1 a match and 1 - 1 / MISMATCHES a substitution."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi <= lo:
        return 0, 0, 0
    same = a[lo:hi] == b[lo - shift : hi - shift]
    apart = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, 1.0 - 1.0 / MISMATCHES))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return int(np.diff(apart).max()) - 1, end - start, int(same[start:end].sum())


def leaks(documents: DataFrame, benchmark: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, overlap_matches) of every pair with a hit, best over its diagonals."""
    items = benchmark.select(F.col("item_id"), F.col("text")).where("item_id is not null").dropDuplicates()
    item_seeds = _seed_rows(items, "item_id", None)
    n = item_seeds.count()
    sieve = np.unique(item_seeds.select("seed").toPandas()["seed"].to_numpy()) if n <= most_held else None
    docs = documents.select("doc_id", "text")
    doc_seeds = _seed_rows(docs, "doc_id", sieve)
    items_at = item_seeds.select("item_id", "seed", F.col("pos").alias("item_pos"))
    hits = doc_seeds.join(small_side(items_at) if n <= most_held else items_at, "seed")
    diagonals = hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    by_doc = diagonals.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))  # at most as many as the document has words
    pairs = by_doc.join(docs.withColumnRenamed("text", "doc_text"), "doc_id").join(small_side(items.withColumnRenamed("text", "item_text")), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, shifts, x, y in zip(b["doc_id"], b["item_id"], b["shifts"], b["doc_text"], b["item_text"]):
                xs, ys = _hash_words(words(x)), _hash_words(words(y))
                got = [overlap(xs, ys, int(s)) for s in shifts]
                best = max(got, key=lambda g: (g[2], -g[1]))
                rows.append((d, i, max(g[0] for g in got), best[1], best[2]))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "exact_words", "overlap_words", "overlap_matches"])

    checked = pairs.mapInPandas(verify, "doc_id long, item_id long, exact_words int, overlap_words int, overlap_matches int")
    return checked.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("exact_words", "overlap_words", "overlap_matches")])


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p8_found: documents that hold at least RUN consecutive words of an item."""
    return _leaks(spark, folder).where(F.col("exact_words") >= RUN).select("doc_id", "item_id")


def tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """p8_leaks: every pair that shares a seed and has a tolerant overlap of RUN words or more, substitutions included, with its extent."""
    return _leaks(spark, folder).where(F.col("overlap_matches") >= RUN)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """p8_items: by leaked item, the number of documents that hold it."""
    return found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": found, "p8_leaks": tolerant, "p8_items": items}
_PAIRS = r"""
    WITH w AS (SELECT doc_id AS id, 'd' AS kind, string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{Nd}\p{No}\p{M}\s]', '', 'g'), '\s+', ' ', 'g')), ' ') AS ws FROM documents
               UNION ALL SELECT item_id, 'i', string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{Nd}\p{No}\p{M}\s]', '', 'g'), '\s+', ' ', 'g')), ' ') FROM benchmark),
         g AS (SELECT DISTINCT id, kind, array_to_string(ws[p:p + 11], ' ') AS gram FROM (SELECT id, kind, ws, unnest(range(1, len(ws) - 10)) AS p FROM w WHERE len(ws) >= 12)),
         pairs AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.gram = i.gram WHERE d.kind = 'd' AND i.kind = 'i')
"""
SQL = {
    "p8_found": _PAIRS + "SELECT doc_id, item_id FROM pairs",
    "p8_items": _PAIRS + "SELECT item_id, count(*) AS documents FROM pairs GROUP BY item_id",
}
