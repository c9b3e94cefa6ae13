"""Files to documents: listing, reading, classification and conversion, as columns of a binary-file scan.

The listing reads no contents; text is decoded by expressions; only what needs a parser from outside or a look at single
bytes goes through an Arrow UDF, on those rows alone. Every file comes out with a status, none fails the batch.

Defined results: empty files are `empty`, too large ones and archives that stayed `skipped`, formats whose converter is not
installed `failed`, binaries of unknown kind `unsupported`; undecodable bytes become U+FFFD.
"""

from __future__ import annotations

import importlib.util
import io
import os
import zipfile
from collections.abc import Iterable
from glob import glob

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from folioweave.functions import lexicon as lx
from folioweave.functions.text import basename, extension, html_text, reordered, skip_category, strip
from folioweave.operators.ranking import numbered

MAX_MB = 200
LISTED = 500
SNIFFED, PRINTABLE = 65536, 0.85
SUPPORTED = lx.TEXT_EXTENSIONS + lx.DATA_EXTENSIONS + lx.IMAGE_EXTENSIONS + lx.OFFICE_EXTENSIONS + lx.ARCHIVE_EXTENSIONS
FENCED = {"json": "json", "ndjson": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml"}


def walk(paths: Iterable[str], all_types: bool = True) -> list[tuple[int, str]]:
    """(order, path) of local files named, matched by a pattern or found in folders. Links are not followed out of
    a folder; unknown types and hidden ones within folders only as asked; files named by hand always."""
    out: dict[str, str] = {}

    def add(path: str, root: str | None = None) -> None:
        real = os.path.realpath(path)
        if real in out or not os.path.isfile(real):
            return
        if root is not None:
            if os.path.islink(path) and not real.startswith(os.path.realpath(root) + os.sep):
                return
            known = os.path.splitext(path)[1][1:].lower() in SUPPORTED
            hidden = any(p.startswith(".") for p in os.path.relpath(path, root).split(os.sep))
            if not known and (not all_types or hidden):
                return
        out[real] = path

    for p in paths:
        if any(c in p for c in "*?[") and not os.path.exists(p):
            for hit in glob(p, recursive=True):
                add(hit, os.path.dirname(hit) or ".")
        elif os.path.isdir(p):
            for f in sorted(os.path.join(d, f) for d, _, fs in os.walk(p, followlinks=False, onerror=lambda _: None) for f in fs):
                add(f, p)
        else:
            add(os.path.expanduser(p))
    return list(enumerate(out.values()))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of supported files under a folder of any file system; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return files.where(extension(F.col("path")).isin(SUPPORTED))


def read(spark: SparkSession, paths: Iterable[str], all_types: bool = True) -> DataFrame:
    """(ord, path, size, content) of local files, in the order in which they were found."""
    found = [(i, "file:" + os.path.abspath(p)) for i, p in walk(paths, all_types)]
    if not found:
        return spark.createDataFrame([], "ord long, path string, size long, content binary")
    order = spark.createDataFrame(found, "ord long, path string")
    files = spark.read.format("binaryFile").load([p for _, p in found]).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.col("length").alias("size"), "content")
    # A scan passes over files without bytes: the listing, made by the driver, has them.
    return order.join(files, "path", "left").select("ord", "path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("content", F.lit(bytearray())).alias("content"))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """As `read` for a folder of any file system, listed by the cluster; ordered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), "content")
    return numbered(files.select("path", "size"), "path", "ord").join(files.select("path", "content"), "path").select("ord", "path", "size", "content")


def first_of_hash(files: DataFrame) -> DataFrame:
    """S3: of byte-identical files the first by `ord`; contents stay where they are until the last join."""
    keyed = files.withColumn("sha", F.sha2("content", 256))
    first = keyed.select("sha", "ord").groupBy("sha").agg(F.min("ord").alias("first"))
    return keyed.join(first, "sha").where(F.col("ord") == F.col("first")).drop("first")


def decoded(content: Column) -> Column:
    """Text by its byte order mark, else UTF-8; malformed bytes replaced."""
    head = F.hex(F.substring(content, 1, 4))
    rest = lambda n: F.substring(content, n + 1, 2147483647)

    return (
        F.when(head.startswith("EFBBBF"), F.decode(rest(3), "UTF-8"))
        .when(head == "FFFE0000", F.decode(rest(4), "UTF-32"))
        .when(head == "0000FEFF", F.decode(rest(4), "UTF-32"))
        .when(head.startswith("FFFE"), F.regexp_replace(F.decode(rest(2), "UTF-16LE"), "^﻿+", ""))
        .when(head.startswith("FEFF"), F.regexp_replace(F.decode(rest(2), "UTF-16BE"), "^﻿+", ""))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


@F.pandas_udf(DoubleType())
def printable(head: pd.Series) -> pd.Series:
    """Share of bytes that text has, of the first of a file; 0 with a NUL among them."""

    def share(b: bytes) -> float:
        b = bytes(b or b"")
        return 0.0 if not b or 0 in b else sum(9 <= x <= 13 or 32 <= x <= 126 or x >= 128 for x in b) / len(b)

    return head.map(share)


@F.pandas_udf(BooleanType())
def zip_within(content: pd.Series) -> pd.Series:
    """Whether a zip container unpacks within bounds and holds no archive; anything else passes."""

    def fine(c: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                infos = z.infolist()
        except Exception:  # no zip
            return True
        total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos) or 1
        nested = (".zip", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".tar")
        return total <= MAX_MB * 4 << 20 and total / packed <= 200 and not any(i.filename.lower().endswith(nested) for i in infos)

    return content.map(fine)


def markdown_of(content: pd.Series, ext: pd.Series) -> pd.Series:
    """Markdown by a converter that may be installed; null where there is none or it fails."""
    if importlib.util.find_spec("markitdown") is None:
        return pd.Series([None] * len(content), dtype=object)
    from markitdown import MarkItDown  # optional

    tool = MarkItDown()

    def one(c: bytes, e: str) -> str | None:
        try:
            return tool.convert_stream(io.BytesIO(bytes(c)), file_extension="." + e).text_content
        except Exception:  # a bad file is a status, not a failure
            return None

    return pd.Series([one(c, e) for c, e in zip(content, ext)], dtype=object)


def converted(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    """(ord, path, name, sha, size, status, method, error, text, chars) of every file (ord, path, size, content).

    In this order: skipped by name, empty, too large, archive, then by extension, then by a look at the content.
    """
    name, ext = basename(F.col("path")), extension(F.col("path"))
    base = files.withColumn("name", name).withColumn("ext", ext).withColumn("sha", F.sha2("content", 256)).withColumn("skip", skip_category(F.col("path")))
    archive = F.col("ext").isin(lx.ARCHIVE_EXTENSIONS)
    verdict = lambda status, method, error: F.struct(F.lit(status).alias("status"), F.lit(method).alias("method"), error.alias("error"))
    early = (
        F.when(F.col("skip").isNotNull(), verdict("skipped", "skipped-type", F.col("skip")))
        .when(F.col("size") == 0, verdict("empty", "empty-file", F.lit("")))
        .when(F.lit(max_mb > 0) & (F.col("size") > max_mb << 20), verdict("skipped", "too-large", F.lit(f">{max_mb}MB")))
        .when(archive, verdict("skipped", "archive", F.lit("not-expanded")))
    )
    rows = base.withColumn("early", early)
    text_like, html, office = F.col("ext").isin(lx.TEXT_EXTENSIONS + lx.DATA_EXTENSIONS), F.col("ext").isin("html", "htm"), F.col("ext").isin([e for e in lx.OFFICE_EXTENSIONS if e not in ("html", "htm")])
    late = rows.where("early is null")
    none = F.lit(None).cast("string")

    def shaped(df: DataFrame, status: Column, method: Column, error: Column, text: Column) -> DataFrame:
        kept = F.when(status == "ok", reordered(text))
        return df.select("ord", "path", "name", "sha", "size", status.alias("status"), method.alias("method"), error.alias("error"), kept.alias("text"), F.coalesce(F.length(kept), F.lit(0)).cast("long").alias("chars"))

    done = rows.where("early is not null")
    out = shaped(done, F.col("early.status"), F.col("early.method"), F.col("early.error"), none)
    plain = late.where(text_like).withColumn("raw", strip(decoded(F.col("content"))))
    fence = F.coalesce(*[F.when(F.col("ext") == e, lang) for e, lang in FENCED.items()])
    body = F.when(fence.isNotNull() & (F.col("raw") != ""), F.concat(F.lit("```"), fence, F.lit("\n"), F.col("raw"), F.lit("\n```"))).otherwise(F.col("raw"))
    out = out.unionByName(shaped(plain, F.when(F.col("raw") == "", "empty").otherwise("ok"), F.when(F.col("ext").isin(lx.TEXT_EXTENSIONS), "text-passthrough").otherwise("data-passthrough"), F.lit(""), body))
    web = late.where(html).withColumn("raw", html_text(decoded(F.col("content"))))
    out = out.unionByName(shaped(web, F.when(F.col("raw") == "", "empty").otherwise("ok"), F.lit("html-text"), F.lit(""), F.col("raw")))
    tool = F.pandas_udf(markdown_of, "string")
    rich = late.where(office).withColumn("within", zip_within("content")).withColumn("raw", tool("content", "ext"))
    missing = importlib.util.find_spec("markitdown") is None
    status = F.when(~F.col("within"), "skipped").when(F.col("raw").isNull(), "failed").when(strip(F.col("raw")) == "", "empty").otherwise("ok")
    method = F.when(~F.col("within"), "zip-too-large").when(F.col("raw").isNull(), "converter-missing" if missing else "converter-error").otherwise("markitdown")
    out = out.unionByName(shaped(rich, status, method, F.when(status == "ok", "").when(~F.col("within"), "decompression-bound").otherwise(method), F.col("raw")))
    other = late.where(~(text_like | html | office)).withColumn("marked", F.hex(F.substring("content", 1, 4)).rlike("^(EFBBBF|FFFE|FEFF|0000FEFF)")).withColumn("share", printable(F.substring("content", 1, SNIFFED)))
    readable = F.col("marked") | (F.col("share") >= PRINTABLE)
    raw = strip(decoded(F.col("content")))
    unknown = F.when(~readable, "unsupported").when(raw == "", "unsupported").otherwise("ok")
    how = F.when(~readable, F.when(F.col("ext") == "", "no-ext").otherwise(F.concat(F.lit("."), F.col("ext")))).otherwise(F.when(F.col("marked"), "text-fallback-bom").otherwise("text-fallback"))
    return out.unionByName(shaped(other, unknown, how, F.when(~readable, "binary").otherwise(""), raw))


def as_markdown(name: Column, method: Column, text: Column) -> Column:
    """S26's counterpart: a document with the line that tells where it is from."""
    return F.concat(F.lit("<!-- source: "), name, F.lit(" · method: "), method, F.lit(" -->\n\n"), text)
