"""Problem 10: pages of repeated keywords, link lists and product labels instead of sentences.

Content and link features of a page go to bagged decision trees (a random forest that offers every feature to every
split), trained on weak labels: rules that vote only where a page is plain. The page's probability is then smoothed
with the rate of spam at its host, which is estimated from all pages of the host, pre-aggregated, and pulled towards
the rate of the whole crawl where a host has few pages.

The trees are trained on at most TRAIN_ROWS weakly labelled pages, chosen by a hash of the id; features, host rates
and predictions cover every page.

Defined results: null and empty texts are no spam; a null site stands for itself alone (no smoothing); repeated pages
each count; with labels of one kind only, the rules' vote is the prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.operators.lookup import looked_up
from folioweave.session import cut
from folioweave.sources.tables import table

TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 6
HOST_STRENGTH = 20.0  # pages that the whole crawl's rate counts for at a host
HOST_WEIGHT = 0.35
FEATURES = ["words", "prose", "links", "top", "top5", "unique", "repeated", "separators", "numbered", "short_lines", "stuffed", "same_lines", "line_words"]

_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*", re.S)
_SEP = re.compile(r"^[»«|/;,·•>\-–—*+#]+$|[;,|/»·]$")
_SENTENCE = re.compile(r"(?<=[.!?。！？।؟])[\"”»“’)」]*(?:\s+(?=[^\sa-z])|(?=[぀-ヿ一-鿿]))|\n+")
_END = re.compile(r"[.!?。！？।؟][\"”»“’)」]*\s*$")
_EDGE = re.compile(r"^[^\w]+|[^\w\u0900-\u0dff\u0e00-\u0e7f]+$")
_NUMBERED = re.compile(r"\(\d+\)$|^[A-Z]{2,5}-?\d+$|^\d+[.,]\d\d$|^\d+/\d+\w*$")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]")
# Frequent function words, which say nothing when repeated.
FUNCTION = frozenset(
    "the and was for had that with are were this from have has not its his her their which who will been one two all any more "
    "der die das und den dem des ein eine ist bei von für mit nicht auf les des une est dans pour que qui par sur pas plus avec "
    "los las una con por para del está".split()
)


def _words(s: str) -> list[str]:
    return [w for w in (_EDGE.sub("", t).lower() for t in s.split()) if w and not w.isdigit()]


def features(text: str) -> tuple:
    """The values of FEATURES for one page; of the whole text."""
    total = max(1, len(text))
    links = sum(len(m[0]) for m in _LINK.finditer(text))
    bare = _LINK.sub(" ", text)
    tokens = text.split()
    ws = _words(bare)
    n = max(1, len(ws))
    counts = Counter(w for w in ws if len(w) > 2 and w not in FUNCTION)
    common = counts.most_common(5)
    pairs = list(zip(ws, ws[1:]))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    prose = stuffed = pieces = 0
    seen: Counter = Counter()
    for p in (x.strip() for x in _SENTENCE.split(bare)):
        if not p:
            continue
        own = _words(p)
        unspaced = len(_UNSPACED.findall(p))
        size = len(p)
        pieces += size
        seen[p] += size
        key = max(Counter(w for w in own if len(w) > 2 and w not in FUNCTION).values(), default=0)
        broken = sum(bool(_SEP.search(t)) for t in p.split()) * 3 > len(p.split())
        if (_END.search(p) or unspaced >= 12) and not broken and (len(own) >= 2 or unspaced >= 4):
            if key >= 2 and (key * 5 >= len(own) or unspaced >= 4):
                stuffed += size
            else:
                prose += size
    separators = sum(bool(_SEP.search(t)) for t in tokens)
    short = sum(len(x) for x in lines if not _END.search(x) and len(x.split()) <= 7 and len(_UNSPACED.findall(x)) < 12)
    return (
        float(len(tokens)), prose / total, links / total, common[0][1] / n if common else 0.0, sum(c for _, c in common) / n, len(set(ws)) / n,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0, separators / max(1, len(tokens)), sum(bool(_NUMBERED.search(t)) for t in tokens) / max(1, len(tokens)),
        short / total, stuffed / total, sum(s for p, s in seen.items() if s > len(p)) / max(1, pieces), len(tokens) / max(1, len(lines)),
    )


def with_features(documents: DataFrame) -> DataFrame:
    """(doc_id, site, empty, one double column for each of FEATURES)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([features(t or "") for t in b["text"]], columns=FEATURES)
            yield pd.concat([b[["doc_id", "site"]].reset_index(drop=True), b["text"].fillna("").str.strip().eq("").rename("empty").reset_index(drop=True), got], axis=1)

    return documents.select("doc_id", "site", "text").mapInPandas(part, "doc_id long, site string, empty boolean, " + ", ".join(f"{f} double" for f in FEATURES))


def weak_label() -> Column:
    """1: plainly spam, 0: plainly not, null: no vote."""
    c = F.col
    listing = (c("prose") < 0.3) & (c("words") > 5)
    spam = (c("links") > 0.6) | (listing & ((c("links") > 0.3) | (c("numbered") > 0.15) | (c("repeated") > 0.35) | (c("separators") > 0.3) | (c("short_lines") > 0.6) & (c("words") > 15))) | (c("stuffed") > 0.5) & (c("top") > 0.12) & (c("words") > 12)
    ham = c("empty") | (c("prose") > 0.55) & (c("links") < 0.3)
    return F.when(spam & ~c("empty"), 1.0).when(ham, 0.0)


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, site, page, host, score, spam): the trees' probability, the host's rate, and both fused."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pages = cut(with_features(documents).withColumn("label", weak_label()))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(pages)
    labelled = vectors.where("label is not null").withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(TRAIN_ROWS).select("label", "features")
    kinds = {r["label"] for r in labelled.select("label").distinct().collect()}
    if len(kinds) < 2:
        scored = pages.withColumn("page", F.coalesce("label", F.lit(0.0)))
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=0.7, seed=10, maxBins=32).fit(labelled)
        scored = forest.transform(vectors).withColumn("page", vector_to_array("probability")[1])
    scored = scored.select("doc_id", "site", "empty", "page")
    everywhere = scored.agg(F.avg("page").alias("all"))  # one row
    hosts = scored.where("site is not null").groupBy("site").agg(F.sum("page").alias("w"), F.count(F.lit(1)).alias("n"))
    rates = hosts.crossJoin(F.broadcast(everywhere)).select("site", ((F.col("w") + HOST_STRENGTH * F.col("all")) / (F.col("n") + HOST_STRENGTH)).alias("host"), "all")
    # A host with many pages meets its rate by a broadcast, the others by a shuffle; pages without a host have none.
    known = looked_up(scored, rates, "site").select("doc_id", "site", "empty", "page", "host", "all")
    alone = scored.where("site is null").crossJoin(F.broadcast(everywhere)).select("doc_id", "site", "empty", "page", F.lit(None).cast("double").alias("host"), "all")
    both = known.unionByName(alone)
    logit = lambda x: F.log((x + 1e-3) / (1 - x + 1e-3))
    lean = F.coalesce(HOST_WEIGHT * (logit(F.col("host")) - logit(F.col("all"))), F.lit(0.0))
    score = 1 / (1 + F.exp(-(logit(F.col("page")) + lean)))
    return both.select("doc_id", "site", F.round("page", 6).alias("page"), F.round("host", 6).alias("host"), F.round(score, 6).alias("score"), ((score >= 0.5) & ~F.col("empty")).alias("spam"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents", "doc_id", "site", "text"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p10_found: the spam pages."""
    return _judged(spark, folder).where("spam").select("doc_id").distinct()


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    """p10_hosts: pages and spam pages by host."""
    return _judged(spark, folder).groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("spam").cast("long")).alias("spam_pages"))


QUERIES = {"p10_found": found, "p10_hosts": hosts, "p10_scores": _judged}
SQL: dict[str, str] = {}
