"""A memory from end to end: files or documents in, tables out, and the questions that are asked of them.

    memory = Memories(spark, "/shared/memories")
    memory.digest("field-notes", ["/data/notes"])
    memory.recall("field-notes", "who repaired the pump?")

Each stage is a function from frames to frames; what several stages read is cut once into the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from folioweave.functions import lexicon as lx
from folioweave.functions.text import clipped
from folioweave.operators import communities as com
from folioweave.operators import extract, graph, interchange, recall, resolve, segment
from folioweave.session import cut
from folioweave.sources import archives, files, render
from folioweave.sources.store import Store, slug


@F.pandas_udf(StructType().add("start", LongType()).add("end", LongType()))
def located(text: pd.Series, fact: pd.Series) -> pd.DataFrame:
    """Where a fact of at least 8 characters stands in its document, case and white space aside; nulls where it doesn't."""
    held: dict[str, tuple[str, list[int]]] = {}

    def flat(s: str) -> tuple[str, list[int]]:
        out, at = [], []
        for i, c in enumerate(s):
            if c.isspace():
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
            else:
                low = c.lower()
                out.append(low if len(low) == 1 else c)
                at.append(i)
        return "".join(out), at

    rows = []
    for t, f in zip(text, fact):
        start = end = None
        if isinstance(t, str) and isinstance(f, str) and len(want := flat(f)[0]) >= 8:
            if t not in held:
                held.clear()  # facts come sorted by document
                held[t] = flat(t)
            low, at = held[t]
            k = low.find(want)
            if k >= 0:
                start, end = at[k], at[k + len(want) - 1] + 1
        rows.append((start, end))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int64")


def built(documents: DataFrame, limit: int = segment.CHUNK_CHARS, cap: int | None = None, fuzzy: bool = True) -> dict[str, DataFrame]:
    """All tables of a memory from documents (doc, text). `cap` limits the chunks that are read."""
    chunks = cut(segment.segmented(documents, "doc", "text", limit))
    kept = segment.kept_chunks(chunks)
    unique = cut(segment.capped(kept, cap))
    rows = cut(extract.extracted(unique))
    mentions = extract.mentions(rows)
    named = cut(resolve.resolved(mentions.select("name", "type", F.struct("doc", "idx", "rank").alias("ord")), fuzzy))
    alias = named.select("name", "norm", "cid")
    heads = named.select("cid", "label", "type", "count").distinct()
    here = cut(graph.present(mentions, alias))
    edges = cut(graph.edges(here, extract.relations(rows), alias))
    docs = graph.node_docs(here)
    held = cut(graph.node_facts(graph.held_facts(here, graph.fact_rows(rows), heads)))
    spans = held.join(documents.select("doc", "text"), "doc").sortWithinPartitions("doc").withColumn("span", located("text", "fact"))
    facts = cut(spans.select("cid", "fact", "doc", "heading_path", "salience", "confidence", F.col("pos").cast("int").alias("pos"), "span.start", "span.end"))
    placed = com.communities(heads, edges)
    entities = cut(heads.join(placed, "cid").select("cid", "label", "type", extract.subtype(F.col("label"), F.col("type")).alias("subtype"), "count", "community"))
    members = graph.member_order(entities.select("cid", "count", "community"), graph.degrees(edges))
    themes = cut(com.themes(members, entities.select("cid", "label"), facts))
    units = cut(com.units(themes, entities, facts, docs))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    dropped = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(segment.low_value(F.col("text"))).alias("chunks_skipped_low_value"))
    stats = n(documents, "files").join(dropped).join(n(unique, "unique_chunks")).join(n(kept, "_all")).join(n(entities, "entities")).join(n(edges, "relations")).join(n(themes, "communities")).join(com.synopsis(themes))  # each a single row
    stats = stats.select("files", F.col("files").alias("converted"), "chunks", "unique_chunks", (F.col("_all") - F.col("unique_chunks")).alias("chunks_truncated"), "chunks_skipped_low_value", "entities", "relations", "communities", F.lit("deterministic").alias("mode"), "synopsis")
    return {"corpus": documents.select("doc", "text"), "entities": entities, "aliases": alias, "node_docs": docs, "node_facts": facts, "edges": edges, "themes": themes, "units": units, "stats": stats}


class Memories:
    """Q1, Q4 to Q9 over a home of projects. A call that finds no memory says so, none raises for bad data."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.store = spark, Store(spark, home)

    def convert(self, project: str, paths: Iterable[str], incremental: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(conversions, plan, manifest); only files whose content is new are converted."""
        found = files.read(self.spark, paths)
        flat = archives.expanded(found.select("path", "content")).join(found.select(F.col("path").alias("archive0"), "ord"), F.coalesce("archive", "path") == F.col("archive0"))
        ordered = flat.select(F.struct("ord", "path").alias("ord"), "path", F.length("content").cast("long").alias("size"), "content")
        once = cut(files.first_of_hash(ordered))
        empty = self.spark.createDataFrame([], "path string, sha string, out string, method string")
        manifest = (self.store.load(project, "manifest") if incremental else None) or empty
        corpus = self.store.load(project, "corpus") if incremental else None
        outputs = corpus.select(F.concat("doc", F.lit(".md")).alias("out")) if corpus is not None else empty.select("out")
        roots = ["file:" + p.rstrip("/") + "/" for p in paths]
        under = F.lit(False)
        for r in roots:
            under |= F.col("path").startswith(r)
        plan = cut(interchange.planned(once.select("path", "sha"), manifest, outputs, under))
        todo = once.join(plan.where("action = 'convert'").select("path"), "path", "left_semi")
        names = interchange.output_names(once.select("path"))
        done = cut(files.converted(todo).join(names, "path"))
        fresh = done.where("status = 'ok'").select("path", "sha", "out", "method")
        return done, plan, cut(interchange.next_manifest(plan, manifest, fresh))

    def digest(self, project: str, paths: Iterable[str], reset: bool = False, cap: int | None = None) -> dict[str, int]:
        """Q7: convert what is new, rebuild the memory from all documents; the counts of documents added, updated, left and removed."""
        paths = list(paths)
        done, plan, manifest = self.convert(project, paths, not reset)
        before = None if reset else self.store.load(project, "corpus")
        new = done.where("status = 'ok'").select(F.regexp_replace("out", r"\.md$", "").alias("doc"), "text")
        docs = new
        if before is not None:
            gone = plan.where("action = 'removed'").select(F.regexp_replace("out", r"\.md$", "").alias("doc"))
            docs = before.join(new.select("doc").unionByName(gone), "doc", "left_anti").unionByName(new)
        docs = cut(docs)
        ok = manifest.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("out").alias("output"), "method", "out").join(docs.select(F.concat("doc", F.lit(".md")).alias("out"), F.length("text").cast("long").alias("chars")), "out").select("name", "output", "method", "chars")
        records = interchange.document_records(ok, manifest.select("out", "sha"), done.select(F.col("path").alias("source"), "status", "method"))
        self._save(project, built(docs, cap=cap) | {"documents": records, "manifest": manifest})
        return {r["outcome"]: r["n"] for r in interchange.tally(plan, done.where("status = 'ok'")).collect()}  # four numbers

    def _save(self, project: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            if name != "units":
                self.store.write(project, name, df)
        recall.write_index(tables["units"], self.store.folder(project, "index"))
        self.store.write(project, "units", tables["units"])
        self.store.commit(project)

    def digest_documents(self, project: str, documents: DataFrame, cap: int | None = None, hashed: bool = True) -> None:
        """A memory of documents (doc, text) that are tables already; without `hashed` they count as of unknown source."""
        docs = cut(documents.select(F.col("doc").cast("string").alias("doc"), "text"))
        records = docs.select(F.col("doc").alias("name"), F.concat("doc", F.lit(".md")).alias("output"), F.lit("ok").alias("status"), F.lit("table").alias("method"), F.length("text").cast("long").alias("chars"), F.when(F.lit(hashed), F.sha2("text", 256)).alias("sha"))
        self._save(project, built(docs, cap=cap) | {"documents": records})

    def recall(self, project: str, query: str, k: object = None, doc: str | None = None, entity_type: str | None = None, floor: float = 0.0) -> DataFrame | None:
        """Q1: the best units as they are returned; None where there is no memory. Without filters the index answers."""
        units = self.store.load(project, "units") if self.store.present(project) else None
        if units is None:
            return None
        docs = self.store.load(project, "node_docs").withColumnRenamed("cid", "ref")
        best = recall.filtered(units, query, k, doc, entity_type, docs) if doc or entity_type else recall.searched(self.spark, self.store.folder(project, "index"), query, k)
        spans = self.store.load(project, "node_facts").where("start is not null").select(F.col("cid").alias("ref"), "doc", "start", "end")
        return recall.hits(best, units, spans, floor)

    def recall_all(self, projects: Iterable[str], query: str, k: object = None) -> DataFrame | None:
        """Q2: hits of several memories, merged; projects without one are passed over."""
        frames = []
        for at, p in enumerate(dict.fromkeys(map(slug, projects))):
            if (units := self.store.load(p, "units")) is not None:
                frames.append(units.select(F.lit(p).alias("project"), F.lit(at).alias("ord"), F.col("unit_id").alias("unit"), recall.unit_text(F.col("label"), F.col("text")).alias("text")))
        if not frames:
            return None
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        return recall.federated(rows, query, k)

    def overview(self, project: str) -> dict | None:
        """Q4: synopsis, stats and the first themes."""
        stats, themes = self.store.load(project, "stats"), self.store.load(project, "themes")
        if stats is None or themes is None:
            return None
        first = themes.orderBy("community").limit(lx.THEMES_SHOWN).select(clipped(F.col("label"), lx.LABEL_BYTES).alias("label"), clipped(F.col("summary"), lx.TEXT_BYTES).alias("summary"))
        row = stats.first().asDict()
        return {"synopsis": row.pop("synopsis"), "stats": row, "themes": [r.asDict() for r in first.collect()]}  # at most 20

    def status(self) -> list[dict]:
        """Q9: every project with its counts."""
        return [{"project": p, **(s.first().asDict() if (s := self.store.load(p, "stats")) is not None else {})} for p in self.store.projects()]

    def diff(self, a: str, b: str) -> dict[str, DataFrame] | None:
        """Q5: documents, entities and themes of two memories by state; None where one is missing."""
        if slug(a) == slug(b):
            raise ValueError("two different projects, please")
        x, y = ({n: self.store.load(p, n) for n in ("documents", "entities", "themes")} for p in (a, b))
        if any(v is None for v in (*x.values(), *y.values())):
            return None
        docs = interchange.compared_documents(*(m["documents"].where("status = 'ok'").select("name", "sha") for m in (x, y)))
        labels = lambda n, o: interchange.compared_labels(*(m[n].select("label", F.col(o).alias("ord")) for m in (x, y)))
        return {"documents": interchange.difference(docs, "name"), "entities": interchange.difference(labels("entities", "cid"), "label"), "themes": interchange.difference(labels("themes", "community"), "label")}

    def merge(self, sources: Iterable[str], into: str) -> int:
        """Q6: the corpora of several memories as one, rebuilt; the number of its documents."""
        frames = []
        for at, p in enumerate(sources):
            corpus = self.store.load(p, "corpus")
            if corpus is None:
                raise ValueError(f"no memory: {p}")
            frames.append(corpus.select(F.lit(p).alias("project"), F.struct(F.lit(at).alias("at"), "doc").alias("ord"), F.concat("doc", F.lit(".md")).alias("name"), F.col("text").alias("content")))
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        rows = cut(rows)
        names = interchange.merged(rows)
        texts = rows.select("project", F.col("name").alias("source_name"), "content")
        docs = cut(names.join(texts, ["project", "source_name"]).where(F.sha2("content", 256) == F.col("sha")).select(F.regexp_replace("name", r"\.md$", "").alias("doc"), F.col("content").alias("text")))
        self.digest_documents(into, docs, hashed=False)  # texts are not the bytes they came from
        return docs.count()

    def export(self, project: str, target: str) -> list[str]:
        """The bundle, with memory.md, notes, CSV and GraphML."""
        t = {n: self.store.load(project, n) for n in ("entities", "node_docs", "node_facts", "edges", "themes", "stats", "documents")}
        if any(v is None for v in t.values()):
            return []
        lines = render.memory_lines(slug(project), t["stats"], t["themes"], t["entities"], t["node_facts"], t["documents"])
        lines.select("line").coalesce(1).write.mode("overwrite").text(self.store.folder(project, "memory.md"))
        notes = render.notes(t["documents"], t["node_docs"], t["node_facts"], t["entities"])
        notes.write.mode("overwrite").parquet(self.store.folder(project, "notes"))
        es, rs = render.export_tables(t["entities"], t["node_docs"], t["edges"])
        es.write.mode("overwrite").option("header", True).csv(f"{target}/entities.csv")
        rs.write.mode("overwrite").option("header", True).csv(f"{target}/relations.csv")
        render.graphml_lines(t["entities"], t["node_docs"], t["edges"]).select("line").coalesce(1).write.mode("overwrite").text(f"{target}/graph.graphml")
        return [*self.store.export(project, target), "entities.csv", "relations.csv", "graph.graphml"]

    def import_bundle(self, project: str, bundle: str) -> list[str]:
        return self.store.take_in(project, bundle)

    def forget(self, project: str, secure: bool = False) -> bool:
        return self.store.forget(project, secure)

    def list_digestible(self, folder: str) -> tuple[int, list[str]]:
        """How many supported files a folder holds, and the first 500 paths."""
        found = files.listing(self.spark, folder)
        return found.count(), [r["path"] for r in found.orderBy("path").limit(files.LISTED).select("path").collect()]
