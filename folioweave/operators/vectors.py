"""Hash embeddings and cosine similarity.

Defined results: texts without tokens have the zero vector and cosine 0 with everything; null texts count as empty; null
vectors are left out; equal similarities rank by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import small_side
from folioweave.sources.tables import table

DIMENSIONS = 256
K = 10


def bucket(token: Column) -> Column:
    """M2: the last byte of a token's MD5."""
    return F.conv(F.substring(F.md5(token), 31, 2), 16, 10).cast("int")


def sign(token: Column) -> Column:
    """M2: +1 if the byte before the last is odd, else -1."""
    return F.when(F.conv(F.substring(F.md5(token), 29, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)


def hash_embedding(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, value) of every non-zero place of each row's unit vector."""
    tokens = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    sums = counted.groupBy(key, bucket(F.col("token")).alias("bucket")).agg(F.sum(sign(F.col("token")) * F.col("n")).alias("x")).where("x != 0")
    norms = sums.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norms, sums[key] == norms["_k"]).select(key, "bucket", (F.col("x") / F.col("norm")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    """M3: sum of products, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """M3: cosine of two vectors; 0 where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, cosine): the k nearest rows of `vectors` (vec_id, embedding) for each of `queries`.

    The queries are a stated set, held against all rows in blocks: each block of rows keeps its k best for a query before
    anything is shuffled.
    """
    from pyspark.sql import Window

    q = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    v = vectors.where("embedding is not null").withColumn("block", F.spark_partition_id())
    pairs = v.join(small_side(q), F.col("vec_id") != F.col("query_id")).select("query_id", "block", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("cosine"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cosine"), "vec_id"))
    near = pairs.withColumn("rank", best("query_id", "block")).where(F.col("rank") <= k)
    return near.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


def embedding_query(spark: SparkSession, folder: str) -> DataFrame:
    """hash_embedding: places of all documents' vectors."""
    got = hash_embedding(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return got.select("doc_id", "bucket", F.round("value", 6).alias("value"))


def cosine_query(spark: SparkSession, folder: str) -> DataFrame:
    """cosine_topk: for every vector whose id is divisible by 50, its K nearest among all."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    return nearest(v, v.where("vec_id % 50 = 0"))


QUERIES = {"hash_embedding": embedding_query, "cosine_topk": cosine_query}
SQL = {
    "hash_embedding": """
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
         h AS (SELECT doc_id, ('0x' || substr(md5(token), 31, 2))::INTEGER AS bucket, CASE WHEN ('0x' || substr(md5(token), 29, 2))::INTEGER % 2 = 1 THEN 1.0 ELSE -1.0 END AS s FROM t),
         x AS (SELECT doc_id, bucket, sum(s)::DOUBLE AS x FROM h GROUP BY ALL HAVING sum(s) != 0),
         n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id)
    SELECT doc_id, bucket, round(x / norm, 6) AS value FROM x JOIN n USING (doc_id)
    """,
    "cosine_topk": f"""
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
         p AS (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE vec_id != query_id),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM p)
    SELECT query_id, rank::INTEGER AS rank, vec_id, round(c, 6) AS cosine FROM r WHERE rank <= {K}
    """,
}
