"""Problem 9: combine sources to target shares, each row at most `max_repeats` times, and report the shares reached.

The multivariate-hypergeometric splitting tree works on blocks, not on rows. Every row falls into one of BLOCKS
blocks of its source by a hash; a source's quota is whole passes over its blocks, then a part of one pass that ends
inside a block. The root holds, for each source, how many block copies are to be written; each inner node draws its
left child's share of every source from one multivariate hypergeometric; each leaf is an output shard. A source's
block copies are permuted and dealt to the shards by these counts, so the shards' parts are disjoint; rows are then
shuffled within their shard only.

The numbers of blocks and shards follow from the size. Only blocks x sources numbers reach the driver, at most MOST_BLOCKS a
source, and the block plan is the only thing broadcast, behind a check of its size. Texts are tokenised once; the vocabulary
file is the parameter `tokenizer`.

Defined results: rows with a null source are left out of size and mixture; a null or empty text has 0 tokens; a source
without documents reaches 0; a target whose source is missing is reported; no target rows give an empty mixture.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import cut, small_side
from folioweave.sources.tables import table

# Rows that a block, and tokens that a shard, should have; and how few and how many of them there may be.
BLOCK_ROWS, BLOCKS, MOST_BLOCKS = 5_000, 1024, 1 << 16
SHARD_TOKENS, SHARDS, MOST_SHARDS = 50_000_000, 16, 1 << 12
SEED = 20250301
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the split pattern published with this vocabulary.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """`rows` with the column `tokens` in place of the text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoder(tokenizer)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return rows.withColumn("tokens", count(column)).drop(column)


def _blocked(docs: DataFrame, seed: int, blocks: int, tokenizer: str) -> DataFrame:
    """(source, block, ord, doc_id, tokens): `ord` orders rows within a block."""
    sized = token_counts(docs.where("source is not null").select("doc_id", "source", "text"), "text", tokenizer)
    spin = F.xxhash64("doc_id", F.lit(seed))
    return sized.withColumn("block", F.pmod(spin, F.lit(blocks)).cast("int")).withColumn("ord", F.xxhash64(spin, F.lit(seed + 1)))


class Plan:
    """Quotas by source and the shard of every block copy."""

    def __init__(self, report: pd.DataFrame, copies: pd.DataFrame):
        self.report, self.copies = report, copies


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): exact counts of every source, divided at random among shards of near-equal size."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    take = rng.multivariate_hypergeometric(counts, total * left // shards, method="marginals") if total else counts * 0
    return np.concatenate([split_tree(take, left, rng), split_tree(counts - take, shards - left, rng)])


def plan(blocks: pd.DataFrame, targets: pd.DataFrame, shards: int = SHARDS, seed: int = SEED) -> Plan:
    """blocks: source, block, tokens. targets: source, target_share, max_repeats."""
    blocks = blocks.sort_values(["source", "block"])
    size = blocks.groupby("source")["tokens"].sum()
    total = int(size.sum())
    targets = targets.dropna(subset=["source"]).sort_values("source").reset_index(drop=True)
    own = targets["source"].map(size).fillna(0).astype("int64")
    wanted = targets["target_share"].fillna(0.0) * total
    most = own * targets["max_repeats"].fillna(0).clip(lower=0)
    report = targets.assign(tokens=own, wanted=wanted, quota=np.minimum(np.floor(wanted).astype("int64"), most.astype("int64")), short=most < wanted)
    rng = np.random.default_rng(seed)
    rows, per_source = [], []
    for s, quota, n in zip(report["source"], report["quota"], report["tokens"]):
        b = blocks[blocks["source"] == s]
        ids, tok = b["block"].to_numpy(), b["tokens"].to_numpy()
        got, left, k = [], int(quota), 0
        while n and left > 0:  # at most max_repeats passes
            order = rng.permutation(len(ids))
            ends = np.cumsum(tok[order])
            whole = int(np.searchsorted(ends, left, side="right"))
            got += [(s, int(ids[i]), k, -1) for i in order[:whole]]
            if whole < len(ids):
                rest = left - (int(ends[whole - 1]) if whole else 0)
                if rest:
                    got.append((s, int(ids[order[whole]]), k, rest))
                break
            left -= int(ends[-1])
            k += 1
        per_source.append(got)
    counts = np.array([len(g) for g in per_source], dtype="int64")
    split = split_tree(counts, shards, rng) if len(counts) else np.zeros((shards, 0), dtype="int64")
    for j, got in enumerate(per_source):
        shard_of = np.repeat(np.arange(shards), split[:, j])
        for at, g in zip(rng.permutation(len(got)), got):
            rows.append((*g, int(shard_of[at])))
    return Plan(report, pd.DataFrame(rows, columns=["source", "block", "copy", "most_tokens", "shard"]))


def _planned(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, Plan]:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    targets = table(spark, folder, "mix_targets", "source", "target_share", "max_repeats")
    blocks = min(MOST_BLOCKS, max(BLOCKS, docs.count() // BLOCK_ROWS))
    blocked = cut(_blocked(docs, seed, blocks, tokenizer))
    named = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    # Sources that no target names still count towards the total, in one row.
    known = targets.select("source", F.lit(True).alias("known")).distinct()
    sums = named.join(small_side(known), "source", "left").groupBy(F.when(F.col("known"), F.col("source")).alias("source"), F.when(F.col("known"), F.col("block")).otherwise(-1).alias("block")).agg(F.sum("tokens").alias("tokens"))
    held = sums.toPandas()
    held["source"] = held["source"].where(held["source"].notna(), "\0other")
    shards = min(MOST_SHARDS, max(SHARDS, int(held["tokens"].sum()) // SHARD_TOKENS))
    return blocked, plan(held, targets.toPandas(), shards, seed)


def _copies(spark: SparkSession, p: Plan) -> DataFrame:
    return spark.createDataFrame(p.copies if len(p.copies) else None or p.copies.values.tolist(), "source string, block int, copy int, most_tokens long, shard int")


def mixture(blocked: DataFrame, p: Plan, seed: int = SEED) -> DataFrame:
    """Every row copy of the mixture: shard, pos, doc_id, source, copy, tokens."""
    from pyspark.sql import Window

    spark = blocked.sparkSession
    dealt = blocked.join(small_side(_copies(spark, p)), ["source", "block"])
    whole = dealt.where("most_tokens < 0").select("shard", "doc_id", "source", "copy", "tokens")
    # At most one block of each source is cut; its rows are taken in order while they fit.
    run = Window.partitionBy("source", "copy", "block").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = dealt.where("most_tokens >= 0").withColumn("upto", F.sum("tokens").over(run)).where("upto <= most_tokens").select("shard", "doc_id", "source", "copy", "tokens")
    rows = whole.unionByName(part)
    order = F.xxhash64("doc_id", "copy", F.lit(seed + 2))
    return rows.withColumn("pos", order)


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p9_found: sources that `max_repeats` copies can't bring to their share."""
    _, p = _planned(spark, folder)
    short = p.report[p.report["short"]]["source"].tolist()
    return spark.createDataFrame([(s,) for s in short], "source string")


def mix(spark: SparkSession, folder: str) -> DataFrame:
    """p9_mix: the mixture itself; rows of a shard are in random order by `pos`."""
    blocked, p = _planned(spark, folder)
    return mixture(blocked, p).repartition("shard").sortWithinPartitions("shard", "pos")  # shuffled locally: ids only move


def shares(spark: SparkSession, folder: str) -> DataFrame:
    """p9_shares: by target, the share wanted, the share the written mixture has, its rows and tokens."""
    blocked, p = _planned(spark, folder)
    got = mixture(blocked, p).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_rows"), (F.max("copy") + 1).alias("passes"))
    told = p.report.fillna({"target_share": 0.0, "max_repeats": 0}).astype({"max_repeats": "int64"})
    wanted = spark.createDataFrame(told[["source", "target_share", "max_repeats", "tokens", "quota"]].values.tolist() or [], "source string, target_share double, max_repeats long, tokens long, quota long")
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    both = wanted.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("source", "target_share", "max_repeats", "tokens", "quota", zero("mixed_tokens"), zero("mixed_rows"), zero("passes"), F.coalesce(F.round(F.col("mixed_tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("share"))


QUERIES = {"p9_found": found, "p9_mix": mix, "p9_shares": shares}
# Sizes in code points stand in for tokens: the answer is the same for any usual measure.
SQL = {
    "p9_found": """
        WITH size AS (SELECT source, sum(length(text)) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
             total AS (SELECT sum(n) AS n FROM size)
        SELECT m.source AS source FROM mix_targets m LEFT JOIN size s ON m.source = s.source, total t
        WHERE m.max_repeats * coalesce(s.n, 0) < m.target_share * t.n""",
}
