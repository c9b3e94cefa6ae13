"""Segmentation: documents to chunks that remember their headings, and chunk-level filters, duplicates and caps.

Lines, headings and sentences are found by column expressions. Cutting over-long sentences and packing sentences up to the
limit depends on everything packed before, within one section: an Arrow UDF over one section's sentences.

Defined results: null and empty documents have no chunks; pieces under 8 characters are dropped and take no number;
headings that stand before no text give no chunk; of equal texts the first by (doc, idx) stays; texts that are null are no
chunks; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioweave.functions.text import WS, low_value, sentences, strip, without_comments
from folioweave.sources.tables import table

CHUNK_CHARS = 1200
LEAST_CHARS = 8
MAX_CHUNKS = 1500


def cut_long(sentence: str, limit: int) -> list[str]:
    """a sentence in pieces of at most `limit`, each cut at the last space of its second half if there is one."""
    pieces, at = [], 0
    while len(sentence) - at > limit:
        space = sentence.rfind(" ", at + limit // 2, at + limit)
        stop = space if space > at else at + limit
        pieces.append(sentence[at:stop].strip())
        at = stop
    pieces.append(sentence[at:].strip() if pieces else sentence)
    return [p for p in pieces if p]


def pack(parts: list[str], limit: int) -> list[str]:
    """sentences joined by spaces as long as they fit."""
    out: list[list[str]] = []
    size = 0
    for s in (p for part in parts for p in cut_long(part, limit)):
        if out and size + len(s) + 1 <= limit:
            out[-1].append(s)
            size += len(s) + 1
        else:
            out.append([s])
            size = len(s)
    return [" ".join(p) for p in out]


def packed(parts: Column, limit: int = CHUNK_CHARS) -> Column:
    """F5, F6 and P10 on an array of sentences."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ps: [p for p in pack([] if ps is None else list(ps), limit) if len(p) >= LEAST_CHARS])

    return run(parts)


def sections(documents: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, at, heading_path, body) of every stretch of lines between headings.

    Headings are marked by expressions; the stack of open headings is kept by an Arrow UDF, in one pass over a document's
    lines. Documents are never shuffled.
    """
    lines = F.split(F.regexp_replace(without_comments(F.col(text)), "\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")
    marked = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, rf"^(#{{1,6}})[{WS}]+", 1)).alias("level"), x.alias("line")))
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc"), marked.alias("lines"))

    @F.pandas_udf("array<struct<heading_path:string,body:string>>")
    def split(column: pd.Series) -> pd.Series:
        def one(lines) -> list[dict]:
            out, path, body = [], [], []

            def close() -> None:
                text = "\n".join(body).strip()
                if text:
                    out.append({"heading_path": " > ".join(t for _, t in path), "body": text})
                body.clear()

            for x in lines:
                if x["level"]:
                    close()
                    while path and path[-1][0] >= x["level"]:
                        path.pop()
                    path.append((x["level"], x["line"][x["level"] :].strip()))
                else:
                    body.append(x["line"])
            close()
            return out

        return column.map(one)

    return rows.select("doc", F.posexplode(split("lines")).alias("at", "s")).select("doc", "at", F.when(F.col("s.heading_path") == "", F.col("doc")).otherwise(F.col("s.heading_path")).alias("heading_path"), F.col("s.body").alias("body"))


def segmented(documents: DataFrame, doc: str = "doc", text: str = "text", limit: int = CHUNK_CHARS) -> DataFrame:
    """(id, doc, heading_path, text, idx) of every chunk; idx counts the chunks kept in a document."""
    found = sections(documents, doc, text)
    parts = F.when(F.size(sentences(F.col("body"))) > 0, sentences(F.col("body"))).otherwise(F.array("body"))
    pieces = found.select("doc", "at", "heading_path", packed(parts, limit).alias("pieces")).where(F.size("pieces") > 0)
    # A section's first number is the sum of the pieces of those before it: sections, not pieces, go through the window.
    before = F.coalesce(F.sum(F.size("pieces")).over(Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("first", before).select("doc", "heading_path", "first", F.posexplode("pieces").alias("n", "text"))
    idx = (F.col("first") + F.col("n")).cast("long")
    return rows.select(F.concat("doc", F.lit("#"), idx.cast("string")).alias("id"), "doc", "heading_path", "text", idx.alias("idx"))


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Of equal texts the first by (doc, idx, id). Equal texts combine before the shuffle, so a text that a third of
    all rows share is no hot key."""
    first = F.min(F.struct("doc", "idx", "id", "heading_path")).alias("c")
    return chunks.where("text is not null").groupBy("text").agg(first).select("c.id", "c.doc", "c.heading_path", "text", "c.idx")


def kept_chunks(chunks: DataFrame) -> DataFrame:
    """P2 then W1."""
    return distinct_chunks(chunks.where(~low_value(F.col("text"))))


def capped(chunks: DataFrame, cap: int | None = MAX_CHUNKS) -> DataFrame:
    """The first `cap` chunks by (doc, idx); all where `cap` is None. A top-k, no window over one partition."""
    return chunks if cap is None else chunks.orderBy("doc", "idx").limit(cap)


def cap_report(chunks: DataFrame, cap: int = MAX_CHUNKS) -> DataFrame:
    """(chunks, unique_chunks, low_value, kept, truncated), one row."""
    rows = chunks.where("text is not null").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(low_value(F.col("text"))).alias("low_value"))
    unique = kept_chunks(chunks).agg(F.count(F.lit(1)).alias("unique_chunks"))
    n = F.col("unique_chunks")
    return rows.join(F.broadcast(unique)).select("chunks", "low_value", "unique_chunks", F.least(n, F.lit(cap)).alias("kept"), F.greatest(n - cap, F.lit(0)).cast("long").alias("truncated"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "id", "doc", "heading_path", "text", "idx")


def segment_query(spark: SparkSession, folder: str) -> DataFrame:
    """segment_documents: chunks of the documents table."""
    return segmented(table(spark, folder, "documents", "doc_id", "text"), "doc_id")


def sections_query(spark: SparkSession, folder: str) -> DataFrame:
    """heading_sections: sections of chunk texts, of which some hold Markdown headings."""
    return sections(distinct_chunks(_chunks(spark, folder)), "id").select(F.col("doc").alias("id"), "at", "heading_path", F.length("body").alias("chars"))


def sentence_query(spark: SparkSession, folder: str) -> DataFrame:
    """sentence_split: sentences of every document."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))


def dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_dedup: chunks that are kept."""
    return kept_chunks(_chunks(spark, folder)).select("id", "doc", "idx", F.sha2("text", 256).alias("sha"))


def cap_query(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_cap: the first MAX_CHUNKS of them (the cap is the feature)."""
    return capped(kept_chunks(_chunks(spark, folder))).select("id", "doc", "idx")


def report_query(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_report: how many chunks there are, are dropped and are cut off."""
    return cap_report(_chunks(spark, folder))


def low_value_query(spark: SparkSession, folder: str) -> DataFrame:
    """low_value_filter: documents of low value."""
    return table(spark, folder, "documents", "doc_id", "text").where(low_value(F.col("text"))).select("doc_id")


_WORDS = "list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w != '')"
_LOW = r"""(len(w) >= 40 AND (
        len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w) < 0.12
        OR (pipes >= 4 AND runs >= 2) OR runs >= 5
        OR regexp_matches(text, '<xapG:|<x:xmpmeta|xmlns:rdf|<rdf:')
        OR len(list_filter(w, lambda x: regexp_matches(x, '^[0-9A-Fa-f]{12,}$'))) >= 2
        OR len(list_filter(w, lambda x: regexp_matches(x, '^[-+(]?\p{Nd}[\p{Nd}.,%/:()\-]*\)?$'))) / len(w) > 0.55))"""
_MEASURED = f"""*, {_WORDS} AS w, len(regexp_extract_all(text, '\\p{{Nd}}{{6,}}')) AS runs, len(regexp_extract_all(text, '[|]')) AS pipes"""
_KEPT = f"""m AS (SELECT {_MEASURED} FROM chunks WHERE text IS NOT NULL), l AS (SELECT *, {_LOW} AS low FROM m),
         k AS (SELECT text, min({{'doc': doc, 'idx': idx, 'id': id}}) AS c FROM l WHERE NOT low GROUP BY text)"""

QUERIES = {
    "segment_documents": segment_query,
    "heading_sections": sections_query,
    "sentence_split": sentence_query,
    "chunk_dedup": dedup_query,
    "chunk_cap": cap_query,
    "chunk_report": report_query,
    "low_value_filter": low_value_query,
}
_SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL = {
    "sentence_split": rf"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
         m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([.!?])[{_SPACE}]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '([।。！？])[{_SPACE}]*', '\1' || chr(1), 'g') AS t FROM t),
         s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')), lambda x: x != '') AS s FROM m)
    SELECT doc_id, (unnest(generate_series(1, len(s))) - 1)::INTEGER AS at, unnest(s) AS sentence FROM s
    """,
    "chunk_dedup": f"WITH {_KEPT} SELECT c.id AS id, c.doc AS doc, c.idx AS idx, sha256(text) AS sha FROM k",
    "chunk_cap": f"WITH {_KEPT} SELECT c.id AS id, c.doc AS doc, c.idx AS idx FROM k ORDER BY c.doc, c.idx LIMIT {MAX_CHUNKS}",
    "chunk_report": f"""WITH {_KEPT}, n AS (SELECT count(*) AS n FROM k)
    SELECT (SELECT count(*) FROM l) AS chunks, (SELECT count(*) FILTER (low) FROM l) AS low_value, n AS unique_chunks, least(n, {MAX_CHUNKS}) AS kept, greatest(n - {MAX_CHUNKS}, 0) AS truncated FROM n""",
    "low_value_filter": f"WITH m AS (SELECT {_MEASURED} FROM documents WHERE text IS NOT NULL) SELECT doc_id FROM m WHERE {_LOW}",
}
