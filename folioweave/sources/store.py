"""A home of memories: one folder a project, one Parquet table each for its parts, on any file system Spark reaches.

Tables are written to a folder beside the live one, which then takes its place; the marker of presence comes last. Loads
check the schema: what is missing or doesn't fit is no memory, never an error.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a memory with their columns; the store's version.
TABLES = {
    "documents": "name string, output string, status string, method string, chars long, sha string",
    "manifest": "path string, sha string, out string, method string",
    "corpus": "doc string, text string",
    "entities": "cid string, label string, type string, subtype string, count long, community long",
    "aliases": "name string, norm string, cid string",
    "node_docs": "cid string, doc string",
    "node_facts": "cid string, fact string, doc string, heading_path string, salience long, confidence double, pos int, start long, end long",
    "edges": "source string, target string, weight long, labels array<string>, relations array<struct<type string, from string, to string>>",
    "themes": "community long, label string, summary string, size long, members array<string>",
    "units": "unit_id long, kind string, ref string, label string, type string, text string, docs array<string>, doc_count long",
    "stats": "files long, converted long, chunks long, unique_chunks long, chunks_truncated long, chunks_skipped_low_value long, entities long, relations long, communities long, mode string, synopsis string",
}
VERSION = 2


def slug(name: str) -> str:
    """F25 for a plain string."""
    return re.sub("[^a-zA-Z0-9._-]+", "-", name or "").strip("-_.").lower()[:120] or "default"


class Store:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.home).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, project: str, *parts: str) -> str:
        return "/".join([self.home, slug(project), *parts])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def projects(self) -> list[str]:
        """Names of all projects, sorted."""
        if not self.exists(self.home):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.home)) if s.isDirectory() and self.exists(f"{s.getPath().toString()}/memory.json"))

    def write(self, project: str, name: str, df: DataFrame) -> None:
        """A table in place of the one before, which stays readable until then."""
        schema = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", TABLES[name])]
        fresh, live = self.folder(project, f".{name}-{uuid.uuid4().hex}"), self.folder(project, name)
        df.select(*schema).write.parquet(fresh)
        self._fs.delete(self._path(live), True)
        self._fs.rename(self._path(fresh), self._path(live))

    def text(self, path: str, content: str) -> None:
        """A small text file, whole or not at all."""
        fresh = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(fresh), True)
        try:
            out.write(bytearray(content.encode("utf-8")))
        finally:
            out.close()
        self._fs.delete(self._path(path), False)
        self._fs.rename(self._path(fresh), self._path(path))

    def commit(self, project: str) -> None:
        self.text(self.folder(project, "memory.json"), json.dumps({"project": slug(project), "version": VERSION}))

    def present(self, project: str) -> bool:
        """Whether a project's memory is there, with a version that is a number."""
        marker = self.folder(project, "memory.json")
        if not self.exists(marker):
            return False
        try:
            found = json.loads(self.spark.read.text(marker, wholetext=True).first()[0])
            return isinstance(found["version"], int)
        except Exception:  # torn or foreign: no memory
            return False

    def load(self, project: str, name: str) -> DataFrame | None:
        """A table of a memory; None where it is missing or is not what it should be."""
        path = self.folder(project, name)
        if not self.exists(path):
            return None
        try:
            df = self.spark.read.parquet(path)
            want = self.spark.createDataFrame([], TABLES[name]).schema
            return df.select(*want.names) if {f.name: f.dataType.simpleString() for f in want}.items() <= {f.name: f.dataType.simpleString() for f in df.schema}.items() else None
        except Exception:  # unreadable: no memory
            return None

    def forget(self, project: str, secure: bool = False) -> bool:
        """A project deleted; with `secure` its files are first overwritten with random bytes, as far as the file
        system overwrites in place (local ones do)."""
        path = self.folder(project)
        if not self.exists(path):
            return False
        if secure:
            files = self._fs.listFiles(self._path(path), True)
            while files.hasNext():
                status = files.next()
                out, left = self._fs.create(status.getPath(), True), status.getLen()
                try:
                    while left > 0:
                        block = bytearray(os.urandom(min(left, 1 << 20)))
                        out.write(block)
                        left -= len(block)
                finally:
                    out.close()
        return self._fs.delete(self._path(path), True)

    def copy(self, source: str, target: str) -> None:
        """Tables or files copied between folders by the file system."""
        util = self.spark._jvm.org.apache.hadoop.fs.FileUtil
        conf = self.spark._jsc.hadoopConfiguration()
        here = self._path(source)
        util.copy(here.getFileSystem(conf), here, self._path(target).getFileSystem(conf), self._path(target), False, True, conf)

    def export(self, project: str, target: str) -> list[str]:
        """A bundle of all tables but those tied to this machine (manifest), with memory.md and notes."""
        names = [n for n in [*TABLES, "index", "notes", "memory.md", "memory.json"] if n not in ("manifest",) and self.exists(self.folder(project, n))]
        for n in names:
            self.copy(self.folder(project, n), f"{target}/{n}")
        return names

    def take_in(self, project: str, bundle: str) -> list[str]:
        """A bundle as a project's memory; what was there is kept beside it, a manifest is dropped."""
        if not self.exists(f"{bundle}/memory.json") or not self.exists(f"{bundle}/units"):
            raise ValueError("no exported bundle")
        if self.exists(self.folder(project)):
            self._fs.rename(self._path(self.folder(project)), self._path(f"{self.home}/.before-{slug(project)}-{uuid.uuid4().hex}"))
        names = [n for n in [*TABLES, "index", "notes", "memory.md", "memory.json"] if n != "manifest" and self.exists(f"{bundle}/{n}")]
        for n in sorted(names, key="memory.json".__eq__):  # the marker last
            self.copy(f"{bundle}/{n}", self.folder(project, n))
        return names


def export_tables(entities: DataFrame, node_docs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities.csv and relations.csv as frames, lists joined with `; `, sorted by id."""
    docs = node_docs.groupBy("cid").agg(F.array_join(F.sort_array(F.collect_set("doc")), "; ").alias("docs"))  # one cell of a text file
    e = entities.join(docs, "cid", "left").select(F.col("cid").alias("id"), "label", "type", "count", "community", F.coalesce("docs", F.lit("")).alias("docs")).orderBy("id")
    return e, edges.select("source", "target", "weight", F.array_join("labels", "; ").alias("labels")).orderBy("source", "target")
