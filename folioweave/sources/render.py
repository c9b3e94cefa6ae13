"""A memory as files people read: memory.md, a note for each document, CSV and GraphML.

Notes and graph files are written by the cluster as text; memory.md is made of bounded lists (themes shown with eight
members, 25 facts) and of one line for each theme and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import basename
from folioweave.operators.ranking import top_within
from folioweave.sources.store import export_tables

KEY_FACTS = 25


def key_facts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(place, cid, label, fact, doc) of the 25 most frequent entities that hold a fact among the first 25 of all."""
    top = entities.orderBy(F.desc("count"), F.substring("cid", 2, 20).cast("long")).limit(KEY_FACTS)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.substring("cid", 2, 20).cast("long")))  # 25 rows
    return top.select("cid", "label", place.alias("place")).join(facts.where("pos = 1").select("cid", "fact", "doc"), "cid").select("place", "cid", "label", "fact", "doc")


def memory_lines(project: str, stats: DataFrame, themes: DataFrame, entities: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(part, at, line) of memory.md, to be written in that order."""
    s = stats.select(
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"),
        F.concat(F.lit(f"# Memory — {project}\n\n> "), F.concat_ws(" · ", *[F.concat(F.col(c).cast("string"), F.lit(f" {n}")) for c, n in (("files", "files"), ("entities", "entities"), ("relations", "relations"), ("communities", "themes"))]), F.lit("\n\n## Overview\n\n"), F.when(F.trim("synopsis") == "", "_(empty)_").otherwise(F.col("synopsis")), F.lit("\n\n## Themes\n")).alias("line"),
    )
    t = themes.select(F.lit(1), "community", F.concat(F.lit("### "), "label", F.lit("\n"), "summary", F.lit("\n\n**Entities:** "), F.array_join("members", ", "), F.lit("\n")))
    head = lambda part, text: stats.select(F.lit(part), F.lit(-1).cast("long"), F.lit(text))
    k = key_facts(entities, facts).select(F.lit(2), F.col("place").cast("long"), F.concat(F.lit("- **"), "label", F.lit("** — "), "fact", F.lit(" _(source: "), "doc", F.lit(")_")))
    d = documents.where("status = 'ok'").select(F.lit(3), F.lit(0).cast("long"), F.concat(F.lit("- `"), basename(F.col("name")), F.lit("` — "), F.col("chars").cast("string"), F.lit(" chars (via "), F.coalesce("method", F.lit("?")), F.lit(")")))
    return s.union(t).union(head(2, "## Key facts\n")).union(k).union(head(3, "\n## Documents\n")).union(d).orderBy("part", "at", "line")


def notes(documents: DataFrame, node_docs: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, note) for every converted document: its entities sorted, its facts once each.

    What a note holds is what its document holds; entities and facts are distinct before they are gathered.
    """
    doc = F.regexp_replace(basename(F.coalesce("output", "name")), r"\.md$", "")
    d = documents.where("status = 'ok'").select(doc.alias("doc"), basename(F.col("name")).alias("name"), "method", "chars")
    e = node_docs.join(labels.select("cid", "label"), "cid").select("doc", "label").distinct().groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("entities"))
    f = facts.groupBy("doc", "fact").agg(F.min(F.struct(F.substring("cid", 2, 20).cast("long").alias("c"), "pos")).alias("o")).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "fact"))), lambda x: F.concat(F.lit("- "), x["fact"])), "\n").alias("facts"))
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {title}\n\n"), F.col(c), F.lit("\n"))).otherwise("")
    note = F.concat(F.lit("# "), "name", F.lit("\n\n_Converted via "), F.coalesce("method", F.lit("?")), F.lit(" · "), F.col("chars").cast("string"), F.lit(" chars._\n"), part("Entities", "entities"), part("Facts", "facts"))
    return d.join(e, "doc", "left").join(f, "doc", "left").select("doc", note.alias("note"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(entities: DataFrame, node_docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, line) of a GraphML file, sorted by ids."""
    es, rs = export_tables(entities, node_docs, edges)
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), _escaped(c.cast("string")), F.lit("</data>"))
    keys = [("label", "node", "string"), ("type", "node", "string"), ("count", "node", "long"), ("community", "node", "long"), ("docs", "node", "string"), ("weight", "edge", "long"), ("labels", "edge", "string")]
    head = '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in keys) + '\n<graph edgedefault="undirected">'
    n = es.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), _escaped(F.col("id")), F.lit('">'), *[data(k, F.col(k)) for k in ("label", "type", "count", "community", "docs")], F.lit("</node>")).alias("line"))
    r = rs.select(F.lit(2), "source", "target", F.concat(F.lit('<edge source="'), _escaped(F.col("source")), F.lit('" target="'), _escaped(F.col("target")), F.lit('">'), data("weight", F.col("weight")), data("labels", F.col("labels")), F.lit("</edge>")))
    ends = entities.sparkSession.createDataFrame([(0, "", "", head), (3, "", "", "</graph>\n</graphml>")], "part int, a string, b string, line string")
    return n.union(r).unionByName(ends).orderBy("part", "a", "b")
