"""The graph of a memory: nodes with documents and facts, weighted edges with labels and typed directions.

Everything is an aggregation over chunk-level rows, of which a chunk has a bounded number (8 names, 28 pairs, 6 facts);
what a node or an edge gathers is kept as rows, not as lists that grow with the corpus. Pairs of one chunk are made inside
the chunk's row; edges combine before their shuffle, so a pair that occurs everywhere is no hot key.

Defined results: names that resolve to nothing are left out; a chunk that names an entity twice counts it once; relations
of an entity with itself are no edges; facts of a chunk without entities belong to no node; of equal facts of a node the
first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions.text import W
from folioweave.operators import extract
from folioweave.operators.ranking import numbered, rank_within, top_within
from folioweave.session import cut
from folioweave.sources.tables import table

FACTS_PER_NODE = 25


def number(cid: Column) -> Column:
    """The number of an entity's id (`e12` is 12)."""
    return F.substring(cid, 2, 20).cast("long")


def present(mentions: DataFrame, alias: DataFrame) -> DataFrame:
    """(id, doc, idx, cid, rank) of every entity of a chunk; alias (name, cid)."""
    return mentions.join(alias.select("name", "cid"), "name").groupBy("id", "doc", "idx", "cid").agg(F.min("rank").alias("rank"))


def node_docs(here: DataFrame) -> DataFrame:
    """A5: (cid, doc), distinct."""
    return here.select("cid", "doc").distinct()


def edges(here: DataFrame, relations: DataFrame, alias: DataFrame) -> DataFrame:
    """(source, target, weight, labels, relations) of every pair of entities; the lower number is the source.

    `labels` are at most the ten kinds of relation and co_occurs, `relations` at most two directions of nine types.
    """
    row = here.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "cid"))).alias("es"))  # at most 8 of a chunk
    pairs = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["cid"].alias("s"), b["cid"].alias("t")))))
    together = row.select(F.explode_outer(pairs).alias("p")).where("p is not null").select("p.s", "p.t", F.lit("co_occurs").alias("label"))
    a, b = alias.select(F.col("name").alias("source"), F.col("cid").alias("s")), alias.select(F.col("name").alias("target"), F.col("cid").alias("t"))
    named = relations.join(a, "source").join(b, "target").where("s != t").select("s", "t", F.col("relation").alias("label"))
    first = number(F.col("s")) < number(F.col("t"))
    both = together.unionByName(named).select(F.when(first, F.col("s")).otherwise(F.col("t")).alias("source"), F.when(first, F.col("t")).otherwise(F.col("s")).alias("target"), "label", F.col("s").alias("from"), F.col("t").alias("to"))
    typed = F.when(~F.col("label").isin("related_to", "co_occurs"), F.struct(F.col("label").alias("type"), "from", "to"))
    return both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set(typed)).alias("relations"))


def degrees(es: DataFrame) -> DataFrame:
    """(cid, degree) summed over both ends."""
    ends = es.select(F.col("source").alias("cid"), "weight").unionByName(es.select(F.col("target").alias("cid"), "weight"))
    return ends.groupBy("cid").agg(F.sum("weight").alias("degree"))


def _names(fact: Column, label: Column) -> Column:
    """Whether a fact names a label: as words of its own, or anywhere where the label has no letters to bound."""
    low, text = F.lower(label), F.lower(fact)
    quoted = F.concat(F.lit(rf"(?<![{W}])\Q"), F.replace(low, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?![{W}])"))
    return F.rlike(text, quoted) | (~low.rlike("[a-z0-9]") & F.contains(text, low))


def held_facts(here: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, fact, doc, heading_path, idx, at, salience, confidence) of every fact with each entity that holds it.

    facts (id, doc, heading_path, idx, at, fact); labels (cid, label). Facts meet the at most 8 entities of their own chunk.
    """
    with_labels = here.join(labels.select("cid", "label"), "cid").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "cid", "label"))).alias("es"))
    rows = facts.join(with_labels, "id")
    named = rows.withColumn("named", F.filter("es", lambda e: _names(F.col("fact"), e["label"])))
    n = F.size("named")
    holders = F.when(n > 0, F.col("named")).otherwise(F.slice("es", 1, 1))
    confidence = F.when(n > 0, F.round(F.least(F.lit(0.95), 0.6 + 0.1 * n), 2)).otherwise(F.lit(0.5))
    return named.select(F.explode_outer(holders).alias("e"), "fact", "doc", "heading_path", "idx", "at", n.cast("long").alias("salience"), confidence.alias("confidence")).where("e is not null").select("e.cid", "fact", "doc", "heading_path", "idx", "at", "salience", "confidence")


def node_facts(held: DataFrame, cap: int = FACTS_PER_NODE) -> DataFrame:
    """The first `cap` distinct facts of every node, with `pos`; equal facts combine before the shuffle."""
    first = held.groupBy("cid", "fact").agg(F.min(F.struct("doc", "idx", "at", "heading_path", "salience", "confidence")).alias("f"))
    rows = first.select("cid", "fact", "f.doc", "f.idx", "f.at", "f.heading_path", "f.salience", "f.confidence")
    return top_within(rows, ["cid"], [F.col("doc"), F.col("idx"), F.col("at")], cap, "pos")


def fact_rows(rows: DataFrame) -> DataFrame:
    """Facts of `extract.extracted` rows: (id, doc, heading_path, idx, at, fact)."""
    return rows.select("id", "doc", "heading_path", "idx", F.posexplode_outer("facts").alias("at", "fact")).where("fact is not null")


def dangling(es: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node; none in a sound memory."""
    ids = nodes.select("cid")
    return es.join(ids.withColumnRenamed("cid", "source"), "source", "left_anti").unionByName(es.join(ids.withColumnRenamed("cid", "target"), "target", "left_anti")).distinct()


def member_order(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(community, place, cid): by degree, count and id, all descending. nodes (cid, community, count)."""
    rows = nodes.join(degree, "cid", "left").select("community", "cid", "count", F.coalesce("degree", F.lit(0)).alias("degree"))
    return rank_within(rows, ["community"], [F.col("degree").desc(), F.col("count").desc(), F.col("cid").desc()], "place").select("community", "place", "cid", "degree")


class Spelled:
    """The chunks table as a graph in which every spelling is an entity of its own: what the SQL can follow too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.rows = cut(extract.extracted(extract.chunk_rows(spark, folder)))
        self.mentions = extract.mentions(self.rows)
        first = self.mentions.groupBy("name").agg(F.min(F.struct("doc", "idx", "rank")).alias("ord"), F.count(F.lit(1)).alias("count"))
        self.alias = cut(numbered(first, "ord", "n").select("name", F.concat(F.lit("e"), F.col("n").cast("string")).alias("cid"), "count"))
        self.here = present(self.mentions, self.alias)
        self.labels = self.alias.select("cid", F.col("name").alias("label"))

    def edges(self) -> DataFrame:
        return edges(self.here, extract.relations(self.rows), self.alias)


def edges_query(spark: SparkSession, folder: str) -> DataFrame:
    """entity_cooccurrence_edges: edges between the names of the chunks table."""
    es = Spelled(spark, folder).edges()
    directions = F.transform("relations", lambda r: F.concat_ws(" ", r["type"], r["from"], r["to"]))
    return es.select("source", "target", "weight", F.array_join("labels", "; ").alias("labels"), F.array_join(F.array_sort(directions), "; ").alias("relations"))


def degree_query(spark: SparkSession, folder: str) -> DataFrame:
    """weighted_degree: names by weighted degree, count and id, ranked over all."""
    g = Spelled(spark, folder)
    nodes = g.alias.select("cid", "count", F.lit(0).alias("community"))
    return member_order(nodes, degrees(g.edges())).select("place", "cid", "degree")


def facts_query(spark: SparkSession, folder: str) -> DataFrame:
    """node_facts: the facts that every name holds."""
    g = Spelled(spark, folder)
    got = node_facts(held_facts(g.here, fact_rows(g.rows), g.labels))
    return got.select("cid", "pos", "fact", "doc", "salience", "confidence")


def docs_query(spark: SparkSession, folder: str) -> DataFrame:
    """node_documents: in how many documents every name stands."""
    g = Spelled(spark, folder)
    return node_docs(g.here).groupBy("cid").agg(F.count(F.lit(1)).alias("docs")).join(g.labels, "cid").select("cid", "label", "docs")


def check_query(spark: SparkSession, folder: str) -> DataFrame:
    """graph_integrity: edges of the chunks' graph without a node; there must be none."""
    g = Spelled(spark, folder)
    return dangling(g.edges(), g.alias).select("source", "target", "weight")


def resolved_relations_query(spark: SparkSession, folder: str) -> DataFrame:
    """extraction_relations: relations of the extractions table by kind, repeated rows counted once."""
    rows = table(spark, folder, "extractions", "id", "relations").where("id is not null").groupBy("id").agg(F.first("relations").alias("relations"))
    return rows.select(F.explode_outer("relations").alias("r")).where("r is not null").groupBy(F.col("r.relation").alias("relation")).agg(F.count(F.lit(1)).alias("n"))


GRAPH_SQL = f"""{extract.NAMES_SQL}, {extract.PARTS_SQL}, {extract.TYPED_SQL},
    al AS (SELECT name, 'e' || (row_number() OVER (ORDER BY min({{'doc': doc, 'idx': idx, 'rank': rank}})) - 1) AS cid, count(*) AS count FROM ty GROUP BY name),
    he AS (SELECT ty.id, doc, idx, rank, name AS label, cid FROM ty JOIN al USING (name)),
    rel AS ({extract.SQL["typed_relations"].replace("WITH " + extract.NAMES_SQL + ", " + extract.PARTS_SQL + ",", "WITH", 1)}),
    lk AS (SELECT a.cid AS s, b.cid AS t, 'co_occurs' AS label FROM he a JOIN he b ON a.id = b.id AND a.rank < b.rank
           UNION ALL SELECT a.cid, b.cid, relation FROM rel JOIN al a ON a.name = source JOIN al b ON b.name = target WHERE a.cid != b.cid),
    od AS (SELECT CASE WHEN substr(s, 2)::BIGINT < substr(t, 2)::BIGINT THEN s ELSE t END AS source, CASE WHEN substr(s, 2)::BIGINT < substr(t, 2)::BIGINT THEN t ELSE s END AS target, label, s, t FROM lk),
    ed AS (SELECT source, target, count(*) AS weight, array_to_string(list_sort(list_distinct(list(label))), '; ') AS labels,
           coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN label NOT IN ('related_to', 'co_occurs') THEN label || ' ' || s || ' ' || t END))), '; '), '') AS relations FROM od GROUP BY ALL)"""
_FOLDED = extract._FOLD("lower(fact)")
_FACTS = extract.SQL["chunk_facts"].replace("WITH " + extract.NAMES_SQL + ", " + extract.PARTS_SQL + ",", "WITH", 1)

QUERIES = {
    "entity_cooccurrence_edges": edges_query,
    "weighted_degree": degree_query,
    "node_facts": facts_query,
    "node_documents": docs_query,
    "graph_integrity": check_query,
    "extraction_relations": resolved_relations_query,
}
SQL = {
    "entity_cooccurrence_edges": f"WITH {GRAPH_SQL} SELECT * FROM ed",
    "weighted_degree": f"""WITH {GRAPH_SQL}, dg AS (SELECT cid, sum(weight)::BIGINT AS degree FROM (SELECT source AS cid, weight FROM ed UNION ALL SELECT target, weight FROM ed) GROUP BY cid),
    nd AS (SELECT cid, count, coalesce(degree, 0) AS degree FROM al LEFT JOIN dg USING (cid)) SELECT row_number() OVER (ORDER BY degree DESC, count DESC, cid DESC) AS place, cid, degree FROM nd""",
    "node_facts": f"""WITH {GRAPH_SQL}, fa0 AS ({_FACTS}),
    fx AS (SELECT fa0.*, doc, idx, {_FOLDED} AS low FROM fa0 JOIN cl USING (id)),
    pa AS (SELECT fx.id, fx.at AS nr, fact, fx.doc, fx.idx, he.cid, he.rank, regexp_matches(low, '(^|[^A-Za-z0-9_])' || lower(label) || '($|[^A-Za-z0-9_])') OR (NOT regexp_matches(lower(label), '[a-z0-9]') AND contains(lower(fact), lower(label))) AS named FROM fx JOIN he USING (id)),
    nn AS (SELECT *, count(*) FILTER (named) OVER (PARTITION BY id, nr) AS n, row_number() OVER (PARTITION BY id, nr ORDER BY rank) AS r FROM pa),
    ho AS (SELECT *, CASE WHEN n > 0 THEN round(least(0.95, 0.6 + 0.1 * n), 2) ELSE 0.5 END::DOUBLE AS confidence FROM nn WHERE named OR (n = 0 AND r = 1)),
    un AS (SELECT cid, fact, min({{'doc': doc, 'idx': idx, 'nr': nr, 's': n, 'c': confidence}}) AS f FROM ho GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY f.doc, f.idx, f.nr)::INTEGER AS pos FROM un)
    SELECT cid, pos, fact, f.doc AS doc, f.s AS salience, f.c AS confidence FROM rk WHERE pos <= {FACTS_PER_NODE}""",
    "node_documents": f"WITH {GRAPH_SQL} SELECT cid, label, count(DISTINCT doc) AS docs FROM he GROUP BY ALL",
    "graph_integrity": f"WITH {GRAPH_SQL} SELECT source, target, weight FROM ed WHERE source NOT IN (SELECT cid FROM al) OR target NOT IN (SELECT cid FROM al)",
    "extraction_relations": "WITH x AS (SELECT id, first(relations) AS r FROM extractions WHERE id IS NOT NULL GROUP BY id), y AS (SELECT unnest(r) AS r FROM x) SELECT r.relation AS relation, count(*) AS n FROM y WHERE r IS NOT NULL GROUP BY ALL",
}
