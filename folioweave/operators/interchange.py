"""Memories compared, merged and kept up to date: set algebra on documents, entities and themes, all as joins.

Defined results: of equal labels the first seen is shown; labels compare in lower case, blank ones count for nothing;
documents without a hash are never called changed; of byte-identical documents the first by project and name stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions.text import basename, skip_category, strip
from folioweave.operators.ranking import top_within
from folioweave.sources.tables import table

LISTED = 50
NAME_BYTES, NAME_KEPT = 200, 80


def compared_documents(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, state): only_in_a, only_in_b, changed or same, of documents (name, sha)."""
    x = a.where("name != ''").groupBy("name").agg(F.max("sha").alias("x"), F.lit(True).alias("ina"))
    y = b.where("name != ''").groupBy("name").agg(F.max("sha").alias("y"), F.lit(True).alias("inb"))
    state = F.when(F.col("inb").isNull(), "only_in_a").when(F.col("ina").isNull(), "only_in_b").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return x.join(y, "name", "full_outer").select("name", state.alias("state"))


def first_labels(rows: DataFrame) -> DataFrame:
    """(key, label) of rows (label, ord): the first label of each that differs only in case."""
    each = rows.select(strip(F.col("label")).alias("label"), "ord").where("label != ''")
    return each.groupBy(F.lower("label").alias("key")).agg(F.min(F.struct("ord", "label")).alias("f")).select("key", F.col("f.label").alias("label"))


def compared_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, label, state): only_in_a, only_in_b or shared, of entities or themes (label, ord); shared ones show A's."""
    x, y = first_labels(a).withColumnRenamed("label", "x"), first_labels(b).withColumnRenamed("label", "y")
    state = F.when(F.col("y").isNull(), "only_in_a").when(F.col("x").isNull(), "only_in_b").otherwise("shared")
    return x.join(y, "key", "full_outer").select("key", F.coalesce("x", "y").alias("label"), state.alias("state"))


def difference(states: DataFrame, name: str, listed: int = LISTED) -> DataFrame:
    """Q5, T4: (state, count, names): how many of each state, and the first `listed` names in order."""
    key = "key" if "key" in states.columns else name
    first = top_within(states, ["state"], [F.col(key)], listed, "r").groupBy("state").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(name).alias("n")))), lambda x: x["n"]).alias("names"))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("count")).join(first, "state")


def merged(rows: DataFrame) -> DataFrame:
    """(name, project, source_name, sha) of the union of corpora (project, ord, name, content): identical documents once,
    the first of a name keeps it, others of that name get their hash's first eight digits before the suffix."""
    each = rows.select("ord", "project", "name", F.sha2("content", 256).alias("sha")).where("name is not null and sha is not null")
    once = each.groupBy("sha").agg(F.min(F.struct("ord", "name", "project")).alias("f")).select("sha", "f.ord", "f.name", "f.project")
    first = once.groupBy("name").agg(F.min(F.struct("ord", "sha")).alias("g"))  # names combine before the shuffle
    suffix = F.regexp_extract("name", r"(\.[^./]*)$", 1)
    stem = F.expr("substring(name, 1, length(name) - length(regexp_extract(name, '([.][^./]*)$', 1)))")
    other = F.concat(stem, F.lit("."), F.substring("sha", 1, 8), suffix)
    return once.join(first, "name").select(F.when((F.col("g.sha") == F.col("sha")), F.col("name")).otherwise(other).alias("name"), "project", F.col("name").alias("source_name"), "sha")


def planned(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame, under_root: Column) -> DataFrame:
    """(path, sha, out, action) of every path: reused, convert, removed or preserved.

    inputs (path, sha), manifest (path, sha, out), outputs (out) that exist; `under_root` says of a manifest's path
    (column `path`) that its source is gone from a folder that was asked for.
    """
    m = manifest.select("path", F.col("sha").alias("was"), "out")
    both = inputs.select("path", "sha", F.lit(True).alias("given")).join(m, "path", "full_outer").join(outputs.select("out").distinct().withColumn("there", F.lit(True)), "out", "left")
    action = (
        F.when(F.col("given") & (F.col("sha") == F.col("was")) & F.col("there"), "reused")
        .when(F.col("given"), "convert")
        .when(under_root, "removed")
        .otherwise("preserved")
    )
    return both.select("path", F.coalesce("sha", "was").alias("sha"), "was", "out", action.alias("action"))


def tally(plan: DataFrame, ok: DataFrame | None = None) -> DataFrame:
    """(outcome, n): added, updated, unchanged, removed; `ok` (path) are the conversions that came out."""
    done = plan if ok is None else plan.join(ok.select("path").withColumn("ok", F.lit(True)), "path", "left")
    came = F.lit(True) if ok is None else F.coalesce("ok", F.lit(False))
    outcome = F.when(F.col("action") == "reused", "unchanged").when(F.col("action") == "removed", "removed").when((F.col("action") == "convert") & came, F.when(F.col("was").isNull(), "added").otherwise("updated"))
    return done.withColumn("outcome", outcome).where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def next_manifest(plan: DataFrame, manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """U4: (path, sha, out, method): preserved and reused entries, and fresh ones (path, sha, out, method) that came out."""
    kept = manifest.join(plan.where("action in ('preserved', 'reused')").select("path"), "path", "left_semi").select("path", "sha", "out", "method")
    return kept.unionByName(fresh.select("path", "sha", "out", "method"))


def output_names(files: DataFrame) -> DataFrame:
    """(path, out) of files (path): the first of a name, by path, keeps it; others, and names over NAME_BYTES, get
    the first characters of theirs and of their path's SHA-1."""
    base = F.concat(basename(F.col("path")), F.lit(".md"))
    rows = files.select("path").distinct().withColumn("base", base)
    first = rows.groupBy(F.lower("base").alias("low")).agg(F.min("path").alias("first"))
    short = F.concat(F.substring(basename(F.col("path")), 1, NAME_KEPT), F.lit("."), F.substring(F.sha1(F.encode("path", "UTF-8")), 1, 8), F.lit(".md"))
    both = rows.join(first, F.lower("base") == F.col("low"))
    return both.select("path", F.when((F.col("path") != F.col("first")) | (F.octet_length("base") > NAME_BYTES), short).otherwise(F.col("base")).alias("out"))


def document_records(converted: DataFrame, manifest: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, output, status, method, chars, sha): converted documents with their source's hash by output name, and
    runs that gave none, unless a document of that name is there."""
    ok = converted.join(manifest.groupBy("out").agg(F.max("sha").alias("sha")), converted["output"] == F.col("out"), "left").select("name", "output", F.lit("ok").alias("status"), "method", "chars", "sha")
    bad = runs.where("status != 'ok'").select(basename(F.col("source")).alias("name"), F.lit(None).cast("string").alias("output"), "status", "method", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("string").alias("sha"))
    return ok.unionByName(bad.join(ok.select("name").distinct(), "name", "left_anti").select(ok.columns))


def conversion_tally(runs: DataFrame) -> DataFrame:
    """A10: (status, n); a run without a status counts under `?`."""
    return runs.groupBy(F.coalesce("status", F.lit("?")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def timeout_seconds(megabytes: Column, rich: Column, base: int = 120, most: int = 900) -> Column:
    """M6: seconds that a conversion may take: `base` and one, or for rich formats four, a megabyte, up to `most`; 0 is none."""
    return F.when(F.lit(base) <= 0, 0).otherwise(F.least(base + F.when(rich, 4).otherwise(1) * megabytes, F.lit(most)))


def _memories(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two memories of the documents table: all documents, and those with a language, as they were before some were counted."""
    d = table(spark, folder, "documents", "doc_id", "text", "lang", "n_chars")
    a = d.select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha"))
    b = d.where("lang is not null").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("n_chars").isNull(), F.sha2(F.upper("text"), 256)).otherwise(F.sha2("text", 256)).alias("sha"))
    return a, b


def diff_query(spark: SparkSession, folder: str) -> DataFrame:
    """memory_diff: documents of two memories by state."""
    return difference(compared_documents(*_memories(spark, folder)), "name").select("state", "count", F.array_join("names", ";").alias("names"))


def label_query(spark: SparkSession, folder: str) -> DataFrame:
    """memory_diff_entities: names of the extractions with relations against the names in relations."""
    e = table(spark, folder, "extractions", "id", "entities", "relations").where("id is not null").groupBy("id").agg(F.first("entities").alias("entities"), F.first("relations").alias("relations"))
    a = e.select("id", F.posexplode_outer("entities").alias("at", "e")).select(F.col("e.name").alias("label"), F.struct("id", "at").alias("ord"))
    b = e.select("id", F.posexplode_outer("relations").alias("at", "r")).select(F.col("r.source").alias("label"), F.struct("id", "at").alias("ord"))
    return compared_labels(a, b)


def merge_query(spark: SparkSession, folder: str) -> DataFrame:
    """memory_merge: the documents of all sources as corpora in which a site's documents share one name."""
    d = table(spark, folder, "documents", "doc_id", "text", "source", "site").where("source is not null")
    name = F.concat(F.coalesce("site", F.lit("none")), F.lit(".md"))
    return merged(d.select("source", name.alias("name"), F.struct("source", name.alias("name"), "doc_id").alias("ord"), F.col("source").alias("project"), F.col("text").alias("content")))


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, folder, "documents", "doc_id", "text", "lang", "n_chars", "source")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"))
    gone = table(spark, folder, "benchmark", "item_id", "text", "suite").select(F.concat("suite", F.lit("/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"), F.concat(F.col("item_id").cast("string"), F.lit(".gone.md")).alias("out"))
    known = d.where("lang is not null").select(path.alias("path"), F.when(F.col("n_chars").isNull(), "old").otherwise(F.sha2("text", 256)).alias("sha"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("out"))
    inputs = d.select(path.alias("path"), F.sha2("text", 256).alias("sha"))
    outputs = known.where("length(out) < 6").select("out")  # some outputs have vanished
    plan = planned(inputs, known.unionByName(gone), outputs, F.col("path").startswith("exam"))
    return plan, known.unionByName(gone)


def plan_query(spark: SparkSession, folder: str) -> DataFrame:
    """incremental_plan: what happens to every document against a manifest in which some changed, vanished or are unknown."""
    return _plan(spark, folder)[0].select("path", "action")


def tally_query(spark: SparkSession, folder: str) -> DataFrame:
    """incremental_tally: how many documents that adds, updates, leaves and removes."""
    return tally(_plan(spark, folder)[0])


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversion runs, repeated rows once."""
    return table(spark, folder, "conv_results", "conv_id", "project", "source", "output", "status", "method", "chars").dropDuplicates(["conv_id"])


def conversions_query(spark: SparkSession, folder: str) -> DataFrame:
    """conversion_tally: conversion runs by status, and what their source's name alone would have them skipped for."""
    r = _runs(spark, folder)
    return r.groupBy("status", F.coalesce(skip_category(F.col("source")), F.lit("convert")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def names_query(spark: SparkSession, folder: str) -> DataFrame:
    """output_names: output names of all sources of conversion runs."""
    return output_names(_runs(spark, folder).where("source is not null").select(F.concat_ws("/", "project", "source").alias("path")))


def records_query(spark: SparkSession, folder: str) -> DataFrame:
    """document_records: documents of the conversion runs with what did not come out."""
    r = _runs(spark, folder)
    ok = r.where("status = 'ok'").groupBy("source").agg(F.max("output").alias("output"), F.max("method").alias("method"), F.max("chars").alias("chars")).select(F.col("source").alias("name"), "output", "method", "chars")
    manifest = r.where("status = 'ok'").select(F.col("output").alias("out"), F.sha2("source", 256).alias("sha"))
    return document_records(ok, manifest, r.groupBy("source", "status").agg(F.max("method").alias("method")).select("source", "status", "method"))


QUERIES = {
    "memory_diff": diff_query,
    "memory_diff_entities": label_query,
    "memory_merge": merge_query,
    "incremental_plan": plan_query,
    "incremental_tally": tally_query,
    "conversion_tally": conversions_query,
    "output_names": names_query,
    "document_records": records_query,
}


def _sql() -> dict[str, str]:
    from folioweave.functions import lexicon as lx
    from folioweave.operators.extract import _STRIP, _sql_list

    low = "lower(regexp_extract(source, '[^/]*$'))"
    ext = rf"regexp_extract({low}, '[^/.][^/]*\.([^./]+)$', 1)"
    plan = """d AS (SELECT coalesce(source, 'none') || '/' || doc_id AS path, sha256(text) AS sha, lang, n_chars, doc_id FROM documents),
    k AS (SELECT path, CASE WHEN n_chars IS NULL THEN 'old' ELSE sha END AS was, doc_id || '.md' AS out FROM d WHERE lang IS NOT NULL UNION ALL SELECT suite || '/' || item_id, sha256(text), item_id || '.gone.md' FROM benchmark),
    p AS (SELECT coalesce(d.path, k.path) AS path, was, CASE WHEN d.path IS NOT NULL AND sha = was AND length(out) < 6 THEN 'reused' WHEN d.path IS NOT NULL THEN 'convert' WHEN k.path LIKE 'exam%' THEN 'removed' ELSE 'preserved' END AS action FROM d FULL JOIN k ON d.path = k.path)"""
    runs = "r AS (SELECT conv_id, any_value(project) AS project, any_value(source) AS source, any_value(output) AS output, any_value(status) AS status, any_value(method) AS method, any_value(chars) AS chars FROM conv_results GROUP BY conv_id)"
    return {
        "memory_diff": f"""WITH a AS (SELECT doc_id::VARCHAR AS name, sha256(text) AS sha FROM documents), b AS (SELECT doc_id::VARCHAR AS name, sha256(CASE WHEN n_chars IS NULL THEN upper(text) ELSE text END) AS sha FROM documents WHERE lang IS NOT NULL),
    s AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_in_a' WHEN a.name IS NULL THEN 'only_in_b' WHEN a.sha != b.sha THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.name = b.name)
    SELECT state, count(*) AS count, array_to_string(list_sort(list(name))[:{LISTED}], ';') AS names FROM s GROUP BY state""",
        "memory_diff_entities": f"""WITH x AS (SELECT id, first(entities) AS e, first(relations) AS r FROM extractions WHERE id IS NOT NULL GROUP BY id),
    a AS (SELECT {_STRIP("v.name")} AS label, id, at_ FROM (SELECT id, unnest(e) AS v, unnest(generate_series(1, len(e))) AS at_ FROM x)),
    b AS (SELECT {_STRIP("v.source")} AS label, id, at_ FROM (SELECT id, unnest(r) AS v, unnest(generate_series(1, len(r))) AS at_ FROM x)),
    fa AS (SELECT lower(label) AS key, first(label ORDER BY id, at_, label) AS x FROM a WHERE label != '' GROUP BY ALL), fb AS (SELECT lower(label) AS key, first(label ORDER BY id, at_, label) AS y FROM b WHERE label != '' GROUP BY ALL)
    SELECT key, coalesce(x, y) AS label, CASE WHEN y IS NULL THEN 'only_in_a' WHEN x IS NULL THEN 'only_in_b' ELSE 'shared' END AS state FROM fa FULL JOIN fb USING (key)""",
        "memory_merge": """WITH d AS (SELECT source AS project, coalesce(site, 'none') || '.md' AS name, doc_id, sha256(text) AS sha FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sha ORDER BY project, name, doc_id) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY project, name, doc_id) AS r FROM o)
    SELECT CASE WHEN r = 1 THEN name ELSE regexp_replace(name, '([.][^./]*)$', '') || '.' || sha[:8] || regexp_extract(name, '([.][^./]*)$', 1) END AS name, project, name AS source_name, sha FROM n""",
        "incremental_plan": f"WITH {plan} SELECT path, action FROM p",
        "incremental_tally": f"WITH {plan}, o AS (SELECT CASE WHEN action = 'reused' THEN 'unchanged' WHEN action = 'removed' THEN 'removed' WHEN action = 'convert' AND was IS NULL THEN 'added' WHEN action = 'convert' THEN 'updated' END AS outcome FROM p) SELECT outcome, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY outcome",
        "conversion_tally": f"""WITH {runs}, c AS (SELECT status, CASE WHEN list_contains({_sql_list(lx.IMAGE_EXTENSIONS + lx.VIDEO_EXTENSIONS + lx.AUDIO_EXTENSIONS)}, {ext}) THEN 'media' WHEN list_contains({_sql_list(lx.FONT_EXTENSIONS)}, {ext}) THEN 'font'
        WHEN list_contains({_sql_list(lx.POINTER_EXTENSIONS)}, {ext}) THEN 'gdrive-pointer' WHEN list_contains({_sql_list(lx.JUNK_EXTENSIONS)}, {ext}) OR list_contains({_sql_list(lx.JUNK_NAMES)}, {low}) THEN 'junk' ELSE 'convert' END AS category FROM r)
    SELECT status, category, count(*) AS n FROM c GROUP BY ALL""",
        "output_names": f"""WITH {runs}, f AS (SELECT DISTINCT CASE WHEN project IS NULL THEN source ELSE project || '/' || source END AS path FROM r WHERE source IS NOT NULL), b AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM f),
    g AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path) AS k FROM b)
    SELECT path, CASE WHEN k > 1 OR strlen(name) + 3 > {NAME_BYTES} THEN name[:{NAME_KEPT}] || '.' || sha1(path)[:8] || '.md' ELSE name || '.md' END AS out FROM g""",
        "document_records": f"""WITH {runs}, o AS (SELECT source AS name, max(output) AS output, max(method) AS method, max(chars) AS chars FROM r WHERE status = 'ok' GROUP BY source),
    m AS (SELECT output AS out, max(sha256(source)) AS sha FROM r WHERE status = 'ok' GROUP BY output),
    b AS (SELECT source, status, max(method) AS method FROM r WHERE status != 'ok' GROUP BY ALL)
    SELECT name, output, 'ok' AS status, method, chars, sha FROM o LEFT JOIN m ON out = output
    UNION ALL SELECT regexp_extract(source, '[^/]*$'), NULL, status, method, 0, NULL FROM b WHERE regexp_extract(source, '[^/]*$') NOT IN (SELECT name FROM o WHERE name IS NOT NULL)""",
    }


SQL = _sql()
