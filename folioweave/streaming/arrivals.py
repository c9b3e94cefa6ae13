"""Files as they arrive: a file stream converted batch by batch into a table of documents.

A file source never tells of deletions: `Memories.digest` reconciles those. A batch that is run again writes its own folder
again, so nothing is doubled; readers take the newest row of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.sources.files import converted

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Convert files that come into `folder`; with `once` what is there now, then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        files = rows.select(F.lit(0).cast("long").alias("ord"), "path", F.col("length").alias("size"), "content")
        seen = rows.select("path", "modificationTime")
        converted(files).drop("ord").join(seen, "path").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest row of every path; an empty or missing target raises as a table would."""
    rows = spark.read.parquet(target)
    columns = [c for c in rows.columns if c != "path"]
    newest = rows.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("modificationTime", "batch")).alias("r"))
    return newest.select("path", "r.*")
