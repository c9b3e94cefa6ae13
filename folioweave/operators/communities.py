"""Communities of a graph by modularity, as table rounds; their summaries; and the units that recall searches.

Louvain's two steps on DataFrames. In a round every node weighs moving to each neighbouring community by the change of
modularity and takes the best; half of the nodes, by a hash that changes with the round, may move at once, so that two
neighbours don't swap for ever. When moves cease, communities become nodes and the rounds start again. No community or
component is ever collected; each round's lineage is cut. Ties go to the least id, so the result is the same every time.

Defined results: nodes without edges are communities of their own; a graph without nodes has none; communities are
numbered by size, then by least member number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions.text import clipped, defanged, redacted, scrubbed, tabular
from folioweave.functions import lexicon as lx
from folioweave.operators.graph import Spelled, held_facts, fact_rows, member_order, degrees, node_facts, number
from folioweave.operators.ranking import numbered, top_within
from folioweave.session import cut

ROUNDS = 10
LEVELS = 4
SUMMARY_NAMES, SUMMARY_FACTS, FACTS_READ = 5, 3, 12
CARD_FACTS = 5
SYNOPSIS_LABELS = 8


def _moves(links: DataFrame, own: DataFrame, double: float, turn: int) -> DataFrame:
    """One round: (u, c, k, moved). links (u, v, w) both ways, loops counted twice; own (u, c, k)."""
    total = own.groupBy("c").agg(F.sum("k").alias("tot"))
    near = links.where("u != v").join(own.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
    # Staying is an offer too, also where no neighbour shares the community.
    offers = near.unionByName(own.select("u", "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
    mine = own.select(F.col("u").alias("u2"), F.col("c").alias("was"), "k")
    rated = offers.join(total, "c").join(mine, F.col("u") == F.col("u2")).withColumn("stays", F.col("c") == F.col("was"))
    rated = rated.withColumn("gain", F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / F.lit(double))
    best = rated.groupBy("u").agg(F.min(F.struct((-F.round("gain", 9)).alias("less"), "c")).alias("best"), F.max(F.when(F.col("stays"), F.round("gain", 9))).alias("stay"), F.max("was").alias("was"), F.max("k").alias("k"))
    goes = (-F.col("best.less") > F.col("stay")) & (F.pmod(F.xxhash64("u", F.lit(turn // 2)) + turn, F.lit(2)) == 0)
    return best.select("u", F.when(goes, F.col("best.c")).otherwise(F.col("was")).alias("c"), "k", goes.alias("moved"))


def modularity(links: DataFrame, own: DataFrame) -> float:
    """Modularity of communities own (u, c) on links (u, v, w) both ways; 0 without links."""
    a, b = own.select("u", F.col("c").alias("cu")), own.select(F.col("u").alias("v"), F.col("c").alias("cv"))
    both = links.join(a, "u").join(b, "v")
    inside = both.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w"))).alias("in")).first()
    if not inside["all"]:
        return 0.0
    square = both.groupBy("cu").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return (inside["in"] or 0.0) / inside["all"] - square / inside["all"] ** 2


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """(cid, community) of every node (cid); edges (source, target, weight)."""
    e = edges.select("source", "target", F.col("weight").cast("double").alias("w"))
    links = cut(e.select(F.col("source").alias("u"), F.col("target").alias("v"), "w").unionByName(e.select(F.col("target").alias("u"), F.col("source").alias("v"), "w")))
    double = links.agg(F.sum("w")).first()[0] or 0.0
    member = links.select(F.col("u").alias("cid"), F.col("u").alias("c")).distinct()
    for level in range(levels if double else 0):
        own = cut(links.groupBy("u").agg(F.sum("w").alias("k")).select("u", F.col("u").alias("c"), "k"))
        any_moved, quiet = False, 0
        for turn in range(rounds):
            step = cut(_moves(links, own, double, 32 * level + turn))
            moved = step.where("moved").limit(1).count() > 0
            own, any_moved, quiet = step.select("u", "c", "k"), any_moved or moved, 0 if moved else quiet + 1
            if quiet == 3:  # both halves of one division had their turn
                break
        if not any_moved:
            break
        into = own.select("u", F.col("c").alias("to"))
        member = cut(member.join(into, F.col("c") == F.col("u")).select("cid", F.col("to").alias("c")))
        ends = links.join(into, "u").select(F.col("to").alias("a"), "v", "w").join(into.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        links = cut(ends.groupBy("a", "b").agg(F.sum("w").alias("w")).select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
    all_nodes = nodes.select("cid").join(member, "cid", "left").select("cid", F.coalesce("c", "cid").alias("c"))
    sizes = all_nodes.groupBy("c").agg(F.count(F.lit(1)).alias("size"), F.min(number(F.col("cid"))).alias("least"))
    order = numbered(sizes.select("c", F.struct((-F.col("size")).alias("less"), "least").alias("o")), "o", "community")
    return all_nodes.join(order.select("c", "community"), "c").select("cid", "community")


def _safe(c: Column) -> Column:
    return defanged(scrubbed(c))


def themes(placed: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(community, label, summary, size, members) of every community.

    placed (community, place, cid), labels (cid, label), facts (cid, pos, fact). Of a community's facts, in the order of its
    members, the first FACTS_READ are read and the first SUMMARY_FACTS that are no table rows shown; `members` are the
    labels of the first eight.
    """
    sizes = placed.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    names = placed.where(F.col("place") <= 8).join(labels, "cid").groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("members"))
    # A member has at most 25 facts, so the first FACTS_READ facts can come from any member: two-stage top-k.
    read = top_within(placed.join(facts, "cid").select("community", "place", "pos", "fact"), ["community"], [F.col("place"), F.col("pos")], FACTS_READ, "r")
    shown = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("r", "fact"))), lambda x: x["fact"]), lambda f: ~tabular(f))
    told = read.groupBy("community").agg(F.slice(F.transform(shown, lambda f: redacted(_safe(f))), 1, SUMMARY_FACTS).alias("told"))
    both = sizes.join(names, "community").join(told, "community", "left")
    head = F.array_join(F.transform(F.slice("members", 1, SUMMARY_NAMES), _safe), ", ")
    summary = F.trim(F.concat(F.lit("Theme around "), head, F.lit(". "), F.coalesce(F.array_join("told", " "), F.lit(""))))
    return both.select("community", F.element_at("members", 1).alias("label"), summary.alias("summary"), "size", "members")


def synopsis(ts: DataFrame) -> DataFrame:
    """T5: one row with the line that tells a memory's first themes."""
    first = ts.orderBy("community").limit(SYNOPSIS_LABELS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("community", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    n = ts.agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("This memory covers "), F.col("n").cast("string"), F.lit(" themes: "), F.col("labels"), F.lit("."))
    return n.join(F.broadcast(first)).select(clipped(F.when(F.col("n") == 0, "No content digested yet.").otherwise(line), lx.SYNOPSIS_BYTES).alias("synopsis"))


def units(ts: DataFrame, entities: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(unit_id, kind, ref, label, type, text, docs, doc_count): themes by number, then entities by number.

    entities (cid, label, type); facts (cid, pos, fact); docs (cid, doc). A unit carries its first five documents.
    """
    cards = facts.where(F.col("pos") <= CARD_FACTS).groupBy("cid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"]), "; ").alias("card"))
    near = top_within(docs, ["cid"], [F.col("doc")], lx.HIT_DOCS, "r").groupBy("cid").agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    counts = docs.groupBy("cid").agg(F.count(F.lit(1)).alias("doc_count"))
    text = F.trim(F.concat(F.col("label"), F.lit(" ("), F.col("type"), F.lit("). "), F.coalesce("card", F.lit(""))))
    e = entities.join(cards, "cid", "left").join(near, "cid", "left").join(counts, "cid", "left")
    rows = e.select(F.struct(F.lit(1).alias("kind"), number(F.col("cid")).alias("n")).alias("order"), F.lit("entity").alias("kind"), F.col("cid").alias("ref"), "label", "type", text.alias("text"), F.coalesce("docs", F.array().cast("array<string>")).alias("docs"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"))
    t = ts.where("summary != ''").select(F.struct(F.lit(0).alias("kind"), F.col("community").alias("n")).alias("order"), F.lit("theme").alias("kind"), F.col("community").cast("string").alias("ref"), "label", F.lit(None).cast("string").alias("type"), F.col("summary").alias("text"), F.array().cast("array<string>").alias("docs"), F.lit(0).cast("long").alias("doc_count"))
    return numbered(t.unionByName(rows), "order", "unit_id").drop("order")


def communities_query(spark: SparkSession, folder: str) -> DataFrame:
    """communities: every name of the chunks table with its community."""
    g = Spelled(spark, folder)
    return communities(g.alias, g.edges()).join(g.labels, "cid").select("cid", "label", "community")


def _components_themes(spark: SparkSession, folder: str) -> tuple[Spelled, DataFrame, DataFrame]:
    """Themes over the first letters of names, which SQL can follow, in place of communities."""
    g = Spelled(spark, folder)
    nodes = g.alias.select("cid", "count", F.ascii(F.substring("name", 1, 1)).cast("long").alias("community"))
    placed = member_order(nodes, degrees(g.edges()))
    facts = cut(node_facts(held_facts(g.here, fact_rows(g.rows), g.labels)))
    return g, themes(placed, g.labels, facts), facts


def themes_query(spark: SparkSession, folder: str) -> DataFrame:
    """theme_summaries: summaries over names grouped by their first character."""
    return _components_themes(spark, folder)[1].select("community", "label", "summary", "size")


def units_query(spark: SparkSession, folder: str) -> DataFrame:
    """recall_units: those themes and all names as units of recall."""
    g, ts, facts = _components_themes(spark, folder)
    docs = g.here.select("cid", "doc").distinct()
    u = units(cut(ts), g.alias.select("cid", F.col("name").alias("label"), F.lit("other").alias("type")), facts, docs)
    return u.select("unit_id", "kind", "ref", "label", "text", F.array_join("docs", "; ").alias("docs"), "doc_count")


def _sql() -> dict[str, str]:
    from folioweave.operators import extract, graph

    safe = lambda x: extract._DEFANG(extract._sql_scrub(x))
    facts = graph.SQL["node_facts"]
    base = f"""{facts[: facts.rindex("SELECT cid, pos")]},
    nf AS (SELECT cid, pos, fact FROM rk WHERE pos <= {graph.FACTS_PER_NODE}),
    dg AS (SELECT cid, sum(weight)::BIGINT AS degree FROM (SELECT source AS cid, weight FROM ed UNION ALL SELECT target, weight FROM ed) GROUP BY cid),
    pl AS (SELECT cid, name AS label, ascii(name[1])::BIGINT AS community, row_number() OVER (PARTITION BY ascii(name[1]) ORDER BY coalesce(degree, 0) DESC, count DESC, cid DESC) AS place FROM al LEFT JOIN dg USING (cid)),
    fr AS (SELECT community, fact, row_number() OVER (PARTITION BY community ORDER BY place, pos) AS r FROM pl JOIN nf USING (cid)),
    fu AS (SELECT community, r, regexp_replace({safe("fact")}, '\\p{{Nd}}{{6,}}', '[number]', 'g') AS f, row_number() OVER (PARTITION BY community ORDER BY r) AS q FROM fr WHERE r <= {FACTS_READ} AND NOT {extract._TAB("fact")}),
    tl AS (SELECT community, string_agg(f, ' ' ORDER BY r) AS told FROM fu WHERE q <= {SUMMARY_FACTS} GROUP BY community),
    hd AS (SELECT community, string_agg({safe("label")}, ', ' ORDER BY place) FILTER (place <= {SUMMARY_NAMES}) AS head, first(label ORDER BY place) AS label, count(*) AS size FROM pl GROUP BY community),
    th AS (SELECT community, label, trim('Theme around ' || head || '. ' || coalesce(told, '')) AS summary, size FROM hd LEFT JOIN tl USING (community))"""
    return {
        "theme_summaries": base + " SELECT * FROM th",
        "recall_units": base
        + f""", cd AS (SELECT cid, string_agg(fact, '; ' ORDER BY pos) AS card FROM nf WHERE pos <= {CARD_FACTS} GROUP BY cid),
    dd AS (SELECT cid, list_sort(list(DISTINCT doc)) AS docs FROM he GROUP BY cid),
    un0 AS (SELECT 0 AS k, community AS o, 'theme' AS kind, community::VARCHAR AS ref, label, summary AS text, '' AS docs, 0 AS doc_count FROM th
        UNION ALL SELECT 1, substr(cid, 2)::BIGINT, 'entity', cid, name, trim(name || ' (other). ' || coalesce(card, '')), array_to_string(docs[:{lx.HIT_DOCS}], '; '), len(docs) FROM al LEFT JOIN cd USING (cid) LEFT JOIN dd USING (cid))
    SELECT row_number() OVER (ORDER BY k, o) - 1 AS unit_id, kind, ref, label, text, docs, doc_count FROM un0""",
    }


QUERIES = {"communities": communities_query, "theme_summaries": themes_query, "recall_units": units_query}
SQL = _sql()
