"""Problem 4: how distinctive a term is for its record.

Probabilistic relevance weighting: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average length)), with
idf = ln(1 + (N - df + 0.5) / (df + 0.5)); df, N and the average length are taken over all records of a field.
Repeated rows of an id count once. Statistics are pre-aggregated per (field, term) before they meet the postings. Terms
that make up at least HOT of all postings, of which there can't be more than 1 / HOT, meet theirs by a broadcast, or are
dropped by one where the caller asks for rare terms only; the others by a shuffle in which no key is that frequent.

Defined results: null texts, null facts and null elements hold no terms; a record without terms has no rows and
counts in N and in the average length as 0; an empty table gives no rows; ties keep their equal scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.sources.tables import table

K1, B = 1.2, 0.75
HOT = 1e-3
# Fixed value: what counts as a term.
TERM = "[A-Za-z]{5,}"


def records(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """(id, field, text), one row per id and field."""
    a = chunks.where("id is not null").select("id", F.lit("text").alias("field"), F.col("text").alias("text"))
    b = extractions.where("id is not null").select("id", F.lit("facts").alias("field"), F.array_join("facts", "\n").alias("text"))
    return a.unionByName(b).dropDuplicates(["id", "field"])


def terms(text: Column) -> Column:
    """All terms of a text, lower-cased, in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def postings(rows: DataFrame) -> DataFrame:
    """(id, field, term, tf, length): length is the record's number of terms."""
    said = rows.select("id", "field", terms(F.col("text")).alias("terms"))
    return said.select("id", "field", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "field", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def collection(rows: DataFrame) -> DataFrame:
    """(field, n, avg_length) over all records: one row per field."""
    return rows.select("field", F.size(terms(F.col("text"))).alias("length")).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def weight(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def scored(chunks: DataFrame, extractions: DataFrame, most_df: int | None = None, least_tf: dict[str, int] | None = None) -> DataFrame:
    """(id, field, term, tf, df, score) of every posting that meets the bounds."""
    rows = records(chunks, extractions)
    posts = postings(rows)
    freq = document_frequency(posts)
    all_posts = F.broadcast(freq.agg(F.sum("df").alias("all")))  # one row
    often = freq.crossJoin(all_posts).where(F.col("df") >= F.greatest(HOT * F.col("all"), F.lit((most_df or 0) + 2))).select("field", "term", "df")
    often = F.broadcast(often)  # at most 1 / HOT
    if least_tf:
        keep = F.lit(False)
        for field, tf in least_tf.items():
            keep = keep | ((F.col("field") == field) & (F.col("tf") >= tf))
        posts = posts.where(keep)
    stats = collection(rows)  # one row per field
    met = posts.join(often.select("field", "term"), ["field", "term"], "left_anti").join(freq.where(F.col("df").between(2, most_df)) if most_df else freq, ["field", "term"])
    if not most_df:
        met = met.unionByName(posts.join(often, ["field", "term"]))
    met = met.join(F.broadcast(stats), "field")
    return met.select("id", "field", "term", "tf", "df", F.round(weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("avg_length")), 6).alias("score"))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "chunks", "id", "text"), table(spark, folder, "extractions", "id", "facts")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found: rare terms that one record repeats; the score's two factors, bounded."""
    return scored(*_inputs(spark, folder), most_df=8, least_tf={"text": 3, "facts": 2}).select("id", "field", "term")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """p4_scores: every term of every record with its score."""
    return scored(*_inputs(spark, folder))


def top(spark: SparkSession, folder: str) -> DataFrame:
    """p4_top: the five most characteristic terms of each record; ties by term."""
    rank = Window.partitionBy("id", "field").orderBy(F.desc("score"), "term")
    return scored(*_inputs(spark, folder)).withColumn("rank", F.row_number().over(rank)).where("rank <= 5").select("id", "field", "term", "score", "rank")


QUERIES = {"p4_found": found, "p4_scores": scores, "p4_top": top}
_BASE = """
    WITH r AS (SELECT id, 'text' AS field, any_value(text) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id
               UNION ALL SELECT id, 'facts', any_value(array_to_string(facts, chr(10))) FROM extractions WHERE id IS NOT NULL GROUP BY id),
         t AS (SELECT id, field, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{5,}'), lambda x: lower(x)) AS ts FROM r),
         st AS (SELECT field, count(*) AS n, avg(len(ts)) AS al FROM t GROUP BY field),
         p AS (SELECT id, field, length, term, count(*) AS tf FROM (SELECT id, field, len(ts) AS length, unnest(ts) AS term FROM t) GROUP BY id, field, length, term),
         d AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
         s AS (SELECT p.id, p.field, p.term, p.tf, d.df, round(ln(1 + (st.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / st.al)), 6) AS score
               FROM p JOIN d USING (field, term) JOIN st USING (field))
"""
SQL = {
    "p4_found": _BASE + "SELECT id, field, term FROM s WHERE df BETWEEN 2 AND 8 AND tf >= CASE field WHEN 'text' THEN 3 ELSE 2 END",
    "p4_scores": _BASE + "SELECT id, field, term, tf, df, score FROM s",
    "p4_top": _BASE + "SELECT id, field, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5",
}
