"""Recall: units ranked for a query by BM25, filtered, federated, judged for confidence, and cut to small answers.

A unit is (unit_id, kind, ref, label, type, text, docs, doc_count); a document is a unit without a label. Statistics are
over all units, filters come after the ranking. `write_index` keeps an inverted index: postings sorted by term, so that a
query reads only the row groups that hold its terms.

Defined results: null and empty texts have no terms, are never hits and count in the number of units and in the average
length; equal scores rank by unit; a query without terms has no hits. Scores are summed in the order of the terms, so
equal texts score equally, and are rounded only after ranking. k is held between 1 and 50; what is no number is 8.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioweave.functions import lexicon as lx
from folioweave.functions.text import basename, clipped, sentences, strings, words
from folioweave.operators.ranking import top_within
from folioweave.session import cut, small_side
from folioweave.sources.tables import table

K1, B = 1.5, 0.75
K, K_MOST = 8, 50
SHOWN = 10
QUERY = "Who repaired the pumping station at Old Harrowmere?"
# Fixed value: a token is a run of letters, digits and the whole Bengali block, of at least two characters.
TOKEN = r"[\p{L}\p{N}_\x{0980}-\x{09FF}]+"
STOP = sorted({w.lower() for w in lx.STOPWORDS} | set(lx.BENGALI_STOP) | set(lx.OVERLAP_WORDS))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t or ""))


def composed(rows: DataFrame, column: str) -> DataFrame:
    """`rows` with a column in composed form; only texts beyond ASCII go through Python, and null becomes empty."""
    text = F.coalesce(column, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return rows.where(plain).withColumn(column, text).unionByName(rows.where(~plain).withColumn(column, _composed(column)))


def split_terms(text: Column) -> Column:
    """All tokens of composed text, lower-cased, in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def tokens(text: Column) -> Column:
    """all tokens of a text, composed and lower-cased, in order, with repeats."""
    return split_terms(_composed(text))


def unit_text(label: Column, text: Column) -> Column:
    """the label twice, then the text."""
    label = F.coalesce(label, F.lit(""))
    return F.concat(label, F.lit(" "), label, F.lit(" "), F.coalesce(text, F.lit("")))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, sorted."""
    return sorted({w for w in re.findall("[\\wঀ-৿]+", unicodedata.normalize("NFC", query).lower()) if len(w) > 1})


def clamped(k: object) -> int:
    """K between 1 and 50; 8 where it is no number."""
    try:
        return max(1, min(int(k or K), K_MOST))  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return K


def overlap(a: Column, b: Column) -> Column:
    """How many distinct tokens two token lists share, common words aside; where `a` has only common words, of all tokens."""
    stop = strings(STOP)
    own = F.array_except(a, stop)
    return F.when(F.size(own) == 0, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(own, F.array_except(b, stop))))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def scored(rows: DataFrame, key: str, query: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, key, score) of every row (key, groups, text) that holds a term; statistics by group.

    One pass over the texts keeps a length and the counts of the query's few terms; the statistics are one row a group.
    """
    groups = groups or []
    terms = query_terms(query)
    count = lambda w: F.size(F.filter("tokens", lambda t: t == F.lit(w)))
    tf = F.array(*[count(w) for w in terms]) if terms else F.array().cast("array<int>")
    read = composed(rows.select(*groups, key, "text"), "text").select(*groups, key, split_terms(F.col("text")).alias("tokens"))
    held = cut(read.select(*groups, key, F.size("tokens").alias("length"), tf.alias("tf")))
    df = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]) if terms else F.array().cast("array<bigint>")
    stats = held.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("length"), F.lit(1e-9)).alias("average"), df.alias("df"))
    part = F.zip_with("tf", "df", lambda f, d: F.when(f > 0, _idf(F.col("n"), d) * _weight(f, F.col("length"), F.col("average"))).otherwise(0.0))
    hits = held.where(F.exists("tf", lambda f: f > 0))
    both = hits.join(small_side(stats), groups) if groups else hits.crossJoin(F.broadcast(stats))  # a single row
    return both.select(*groups, key, F.aggregate(part, F.lit(0.0), lambda a, x: a + x).alias("score"))


def ranked(documents: DataFrame, query: str, k: int = SHOWN, key: str = "doc_id") -> DataFrame:
    """(rank, key, score) of the k best documents (key, text) for a query."""
    best = scored(documents, key, query).orderBy(F.desc("score"), key).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), key))  # k rows
    return best.select(rank.alias("rank"), key, F.round("score", 3).alias("score"))


def filtered(units: DataFrame, query: str, k: object = None, doc: str | None = None, entity_type: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(rank, unit_id, score) of the k best units that pass the filters; ranked among all before.

    `docs` (ref, doc) holds all documents of every entity, of which a unit shows only the first few.
    """
    rows = scored(units.select("unit_id", unit_text(F.col("label"), F.col("text")).alias("text")), "unit_id", query)
    keep = units
    if doc:
        want = doc.strip().rsplit("/", 1)[-1].lower()
        held = docs if docs is not None else units.select("ref", F.explode("docs").alias("doc"))
        keep = keep.where("kind = 'entity'").join(held.where(F.lower(basename(F.col("doc"))) == want).select("ref").distinct(), "ref", "left_semi")
    if entity_type:
        keep = keep.where((F.col("kind") == "entity") & (F.lower("type") == entity_type.strip().lower()))
    if doc or entity_type:
        rows = rows.join(keep.select("unit_id"), "unit_id", "left_semi")
    best = rows.orderBy(F.desc("score"), "unit_id").limit(clamped(k))
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "unit_id")).alias("rank"), "unit_id", F.round("score", 3).alias("score"))


def hits(best: DataFrame, units: DataFrame, spans: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """Ranked units as they are returned, every field within its bytes, with at most five documents and
    spans each; scores under `floor`, if it is positive, dropped. spans (ref, doc, start, end)."""
    rows = best.where(F.col("score") >= floor) if floor > 0 else best
    rows = units.join(F.broadcast(rows), "unit_id")  # at most 50
    clip_docs = F.transform(F.slice("docs", 1, lx.HIT_DOCS), lambda d: clipped(d, lx.DOC_BYTES))
    many = F.when(F.col("doc_count") > lx.HIT_DOCS, F.col("doc_count"))
    out = rows.select("rank", "score", "kind", "ref", clipped(F.col("label"), lx.LABEL_BYTES).alias("label"), clipped(F.col("text"), lx.TEXT_BYTES).alias("text"), clip_docs.alias("docs"), many.alias("doc_count"))
    if spans is None:
        return out.orderBy("rank")
    mine = spans.join(F.broadcast(out.where("kind = 'entity'").select("ref")), "ref", "left_semi")
    few = top_within(mine, ["ref"], [F.col("doc"), F.col("start"), F.col("end")], lx.HIT_SPANS, "n").groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("doc", "start", "end"))).alias("spans"))
    return out.join(few, "ref", "left").orderBy("rank")


def federated(rows: DataFrame, query: str, k: object = None) -> DataFrame:
    """(rank, project, unit, score): the k best of each project by its own statistics, merged by rounded score,
    then by project, then by rank. rows (project, ord, unit, text); projects without a name are passed over."""
    each = top_within(scored(rows.where("project is not null"), "unit", query, ["project", "ord"]), ["project", "ord"], [F.desc("score"), F.col("unit")], clamped(k), "place")
    merged = each.withColumn("score", F.round("score", 3)).orderBy(F.desc("score"), "ord", "place").limit(clamped(k))
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "ord", "place"))
    return merged.select(at.alias("rank"), "project", "unit", "score")


def postings(units: DataFrame) -> DataFrame:
    """(term, unit_id, tf, length) of every unit (unit_id, label, text)."""
    rows = composed(units.select("unit_id", unit_text(F.col("label"), F.col("text")).alias("text")), "text")
    read = rows.select("unit_id", split_terms(F.col("text")).alias("tokens"))
    each = read.select("unit_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return each.groupBy("term", "unit_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def write_index(units: DataFrame, path: str) -> None:
    """Postings sorted by term, their document frequencies likewise, and the two figures of the whole: all of them rows."""
    spark = units.sparkSession
    posts = postings(units)
    posts.repartitionByRange("term", "unit_id").sortWithinPartitions("term", "unit_id").write.mode("overwrite").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    lengths = held.select("unit_id", "length").distinct().agg(F.sum("length").alias("tokens"))
    n = units.agg(F.count(F.lit(1)).alias("n"))
    n.join(F.broadcast(lengths)).select("n", (F.coalesce("tokens", F.lit(0)) / F.greatest("n", F.lit(1))).alias("average")).coalesce(1).write.mode("overwrite").parquet(f"{path}/whole")


def searched(spark: SparkSession, path: str, query: str, k: object = None) -> DataFrame:
    """(rank, unit_id, score) from a written index; `term` filters reach the scans of postings and of terms."""
    terms = query_terms(query)
    posts = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms))
    df = spark.read.parquet(f"{path}/terms").where(F.col("term").isin(terms))  # one row for each term of the query
    whole = spark.read.parquet(f"{path}/whole")
    each = posts.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole)).select("unit_id", "term", (_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.col("average"))).alias("w"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("term", "w"))), lambda x: x["w"])  # at most the query's terms
    rows = each.groupBy("unit_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x).alias("score"))
    best = rows.orderBy(F.desc("score"), "unit_id").limit(clamped(k))
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "unit_id")).alias("rank"), "unit_id", F.round("score", 3).alias("score"))


def many_ranked(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, unit_id, score) for every query (query_id, text) of a stated set, by its terms' postings.

    units (unit_id, text). Postings are cut to the queries' terms before they meet them, and each query's best are kept
    by part before they are shuffled to one place.
    """
    u = cut(composed(units.select("unit_id", "text"), "text").select("unit_id", split_terms(F.col("text")).alias("tokens")))
    stats = u.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.size("tokens")), F.lit(1e-9)).alias("average"))
    q = composed(queries.select("query_id", "text"), "text").select("query_id", F.explode(F.array_distinct(split_terms(F.col("text")))).alias("term"))
    asked = q.select("term").distinct()
    posts = u.select("unit_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(small_side(asked), "term", "left_semi").groupBy("term", "unit_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    posts = cut(posts)
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = posts.join(small_side(df), "term").crossJoin(F.broadcast(stats)).select("term", "unit_id", (_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.col("average"))).alias("w"))
    each = rated.join(small_side(q), "term").groupBy("query_id", "unit_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("ws"))  # one entry for each term of the query
    total = each.select("query_id", "unit_id", F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"]).alias("score"))
    return top_within(total, ["query_id"], [F.desc("score"), F.col("unit_id")], k, "rank").select("query_id", "rank", "unit_id", F.round("score", 3).alias("score"))


def low_confidence(best: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, unit_id, shared, low_confidence) of every query's best hit; a query without one has none."""
    top = queries.select("query_id", "text").join(best.where("rank = 1").select("query_id", "unit_id"), "query_id", "left")
    told = top.join(units.select("unit_id", F.col("text").alias("hit")), "unit_id", "left")
    shared = overlap(F.array_distinct(tokens(F.col("text"))), F.array_distinct(tokens(F.col("hit"))))
    return told.select("query_id", "unit_id", F.when(F.col("unit_id").isNotNull(), shared).otherwise(0).alias("shared")).withColumn("low_confidence", F.col("shared") == 0)


def word_overlap(units: DataFrame, query: str, k: object = None) -> DataFrame:
    """Q10: (rank, unit_id, score) by how many words, as they stand in lower case, a unit shares with the query."""
    asked = sorted(set(query.lower().split()))
    score = F.size(F.array_intersect(F.array_distinct(words(F.lower("text"))), strings(asked)))
    best = units.where("text is not null").select("unit_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "unit_id").limit(clamped(k))
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "unit_id")).alias("rank"), "unit_id", "score")


def topk(spark: SparkSession, folder: str) -> DataFrame:
    """recall_bm25_topk: the ten best documents for QUERY."""
    return ranked(table(spark, folder, "documents", "doc_id", "text"), QUERY)


def _units(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as units of the kind `entity`: the heading path is the label, the first word of it the type."""
    c = table(spark, folder, "chunks", "id", "doc", "heading_path", "text").dropDuplicates(["id"])
    return c.select(F.col("id").alias("unit_id"), F.lit("entity").alias("kind"), F.col("id").alias("ref"), F.col("heading_path").alias("label"), F.when(F.col("doc").endswith(".pdf"), "pdf").otherwise("other").alias("type"), "text", F.array("doc").alias("docs"), F.lit(1).cast("long").alias("doc_count"))


def filtered_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_filtered: the best chunks of PDF files for QUERY, ranked among all chunks before the filter."""
    u = _units(spark, folder)
    return filtered(u, QUERY, SHOWN, entity_type="PDF")


def hits_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_hits: the best chunks for QUERY as they are returned, with a floor on the score."""
    u = _units(spark, folder)
    return hits(filtered(u, QUERY, SHOWN), u, floor=1.0).select("rank", "score", "ref", "label", "text", F.array_join("docs", "; ").alias("docs"))


def federated_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_federated: documents of every source as a project of its own."""
    d = table(spark, folder, "documents", "doc_id", "text", "source")
    return federated(d.select(F.col("source").alias("project"), F.col("source").alias("ord"), F.col("doc_id").alias("unit"), "text"), QUERY, SHOWN)


def _benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = table(spark, folder, "benchmark", "item_id", "suite", "text").withColumnRenamed("item_id", "query_id")
    u = table(spark, folder, "documents", "doc_id", "text").withColumnRenamed("doc_id", "unit_id")
    return q, u, many_ranked(q, u, K)


def confidence_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_confidence: every benchmark text as a query, its best document, and whether that is off the topic."""
    q, u, best = _benchmark(spark, folder)
    return low_confidence(best, q, u)


def evaluation_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_at_k: share of benchmark texts, by suite, one of whose sentences stands in one of their K best documents."""
    q, u, best = _benchmark(spark, folder)
    asked = q.select("query_id", "suite", sentences(F.col("text")).alias("expected"))
    seen = best.join(u, "unit_id").join(asked, "query_id").select("query_id", F.exists("expected", lambda s: F.contains(F.lower("text"), F.lower(s))).alias("found"))
    found = seen.groupBy("query_id").agg(F.max("found").alias("found"))
    return asked.join(found, "query_id", "left").groupBy("suite").agg(F.round(F.avg(F.coalesce("found", F.lit(False)).cast("int")), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))


def overlap_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_word_overlap: the plain ranking by shared words."""
    return word_overlap(table(spark, folder, "documents", F.col("doc_id").alias("unit_id"), "text"), QUERY, SHOWN)


_ASKED = "[" + ", ".join(f"'{w}'" for w in query_terms(QUERY)) + "]"
_TOKENS = lambda x: f"list_filter(regexp_extract_all(lower(nfc_normalize({x})), '{TOKEN}'), lambda t: length(t) > 1)"


def _bm25(units: str, by: str = "") -> str:
    """WITH parts that end in s (key, score) for units (key, ts[, by])."""
    comma = f"{by}, " if by else ""
    join = f"JOIN st USING ({by})" if by else ", st"
    return f"""u AS ({units}),
         st AS (SELECT {comma}count(*) AS n, avg(len(ts)) AS al FROM u GROUP BY {by or "ALL"}),
         p AS (SELECT {comma}key, length, term, count(*) AS tf FROM (SELECT {comma}key, len(ts) AS length, unnest(ts) AS term FROM u) WHERE list_contains({_ASKED}, term) GROUP BY ALL),
         d AS (SELECT {comma}term, count(*) AS df FROM p GROUP BY ALL),
         s AS (SELECT {comma}key, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / al)) ORDER BY term)) AS score FROM p JOIN d USING ({comma}term) {join} GROUP BY ALL)"""


_U = f"SELECT id AS key, any_value(doc) AS doc, any_value(heading_path) AS label, any_value(text) AS text, {_TOKENS('''coalesce(any_value(heading_path), '') || ' ' || coalesce(any_value(heading_path), '') || ' ' || coalesce(any_value(text), '')''')} AS ts FROM chunks GROUP BY id"
_MANY = f"""q AS (SELECT item_id AS query_id, suite, text, list_distinct({_TOKENS("text")}) AS ts FROM benchmark),
         u AS (SELECT doc_id AS unit_id, coalesce(text, '') AS text, {_TOKENS("coalesce(text, '')")} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM u),
         p AS (SELECT unit_id, length, term, count(*) AS tf FROM (SELECT unit_id, len(ts) AS length, unnest(ts) AS term FROM u) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
         qt AS (SELECT query_id, unnest(ts) AS term FROM q),
         s AS (SELECT query_id, unit_id, list_sum(list(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / al)) ORDER BY term)) AS score FROM qt JOIN p USING (term) JOIN d USING (term), st GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s QUALIFY rank <= {K})"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"

QUERIES = {
    "recall_bm25_topk": topk,
    "recall_filtered": filtered_query,
    "recall_hits": hits_query,
    "recall_federated": federated_query,
    "recall_confidence": confidence_query,
    "recall_at_k": evaluation_query,
    "recall_word_overlap": overlap_query,
}


def _sql() -> dict[str, str]:
    from folioweave.operators import segment

    parts = segment.SQL["sentence_split"].replace("FROM documents WHERE text IS NOT NULL", "FROM benchmark").replace("doc_id", "item_id")
    return {
        "recall_bm25_topk": f"""WITH {_bm25("SELECT doc_id AS key, " + _TOKENS("coalesce(text, '')") + " AS ts FROM documents")}
    SELECT CAST(row_number() OVER (ORDER BY score DESC, key) AS INTEGER) AS rank, key AS doc_id, round(score, 3) AS score FROM s ORDER BY rank LIMIT {SHOWN}""",
        "recall_filtered": f"""WITH {_bm25(_U)} SELECT row_number() OVER (ORDER BY score DESC, key)::INTEGER AS rank, key AS unit_id, round(score, 3) AS score FROM s JOIN u USING (key) WHERE doc LIKE '%.pdf' ORDER BY rank LIMIT {SHOWN}""",
        "recall_hits": f"""WITH {_bm25(_U)}, b AS (SELECT row_number() OVER (ORDER BY score DESC, key)::INTEGER AS rank, key, round(score, 3) AS score FROM s ORDER BY rank LIMIT {SHOWN}),
    c AS (SELECT rank, score, key AS ref, coalesce(label, '') AS label, text, doc FROM b JOIN u USING (key) WHERE score >= 1)
    SELECT rank, score, ref, (SELECT max(label[:i]) FROM range({lx.LABEL_BYTES + 1}) t(i) WHERE strlen(label[:i]) <= {lx.LABEL_BYTES}) AS label,
           (SELECT max(text[:i]) FROM range({lx.TEXT_BYTES + 1}) t(i) WHERE strlen(text[:i]) <= {lx.TEXT_BYTES}) AS text, doc AS docs FROM c""",
        "recall_federated": f"""WITH {_bm25("SELECT source, doc_id AS key, " + _TOKENS("coalesce(text, '')") + " AS ts FROM documents WHERE source IS NOT NULL", "source")},
    e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS place FROM s QUALIFY place <= {SHOWN}),
    m AS (SELECT row_number() OVER (ORDER BY round(score, 3) DESC, source, place)::INTEGER AS rank, source AS project, key AS unit, round(score, 3) AS score FROM e)
    SELECT * FROM m WHERE rank <= {SHOWN}""",
        "recall_confidence": f"""WITH {_MANY}, t AS (SELECT q.query_id, r.unit_id, q.ts AS a, {_TOKENS("u.text")} AS b FROM q LEFT JOIN r ON r.query_id = q.query_id AND rank = 1 LEFT JOIN u ON u.unit_id = r.unit_id),
    o AS (SELECT *, list_filter(a, lambda x: NOT list_contains({_STOP}, x)) AS c FROM t),
    z AS (SELECT query_id, unit_id, coalesce(CASE WHEN len(c) = 0 THEN len(list_intersect(a, list_distinct(b))) ELSE len(list_intersect(c, list_distinct(b))) END, 0)::INTEGER AS shared FROM o)
    SELECT *, shared = 0 AS low_confidence FROM z""",
        "recall_at_k": f"""WITH {_MANY}, se AS ({parts.strip().replace("WITH t AS", "WITH t AS", 1)}),
    f AS (SELECT DISTINCT r.query_id FROM r JOIN u USING (unit_id) JOIN se ON se.item_id = r.query_id AND contains(lower(u.text), lower(se.sentence)))
    SELECT suite, round(avg((query_id IN (SELECT query_id FROM f))::INTEGER), 6) AS recall, count(*) AS queries FROM q GROUP BY suite""",
        "recall_word_overlap": f"""WITH x AS (SELECT doc_id AS unit_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[{segment._SPACE}]+')), {[*sorted(set(QUERY.lower().split()))]})) AS score FROM documents WHERE text IS NOT NULL)
    SELECT row_number() OVER (ORDER BY score DESC, unit_id)::INTEGER AS rank, unit_id, score::INTEGER AS score FROM x WHERE score > 0 ORDER BY rank LIMIT {SHOWN}""",
    }


SQL = _sql()
