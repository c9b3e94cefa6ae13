"""Names: similarity, siblings, blocks, acronyms, and resolution against all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioweave.functions import names
from folioweave.operators import resolve
from folioweave.operators.components import components
from folioweave.operators.ranking import numbered, rank_within, top_within


def common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_common_length(a, b):
    assert names.common_length(a, b) == common(a, b)


def test_token_sets():
    assert names.token_set_ratio("helios", "helios energy") == 100
    assert names.token_set_ratio("", "") == 100 == names.token_set_ratio("a", "")  # nothing shared equals nothing
    assert names.token_set_ratio("energy helios", "helios energy") == 100


def test_normal_form(spark):
    got = spark.createDataFrame([("José  Díaz!",), ("ﬁ ＡＢＣ",), ("काली",), (None,), ("--",)], "n string").select(names.normalised("n")).collect()
    assert [r[0] for r in got] == ["jose diaz", "fi abc", "काली", "", ""]


def test_siblings_blocks_thresholds(spark):
    pairs = [("reykjavik 1", "reykjavik 2", True), ("site1", "site2", True), ("helios a", "helios b", False), ("", "", False), ("a 1 2", "a 2 1", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert df.where(names.siblings(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert [resolve._siblings(a, b) for a, b, _ in pairs] == [w for *_, w in pairs]
    keys = spark.createDataFrame([("lena marsh",), ("",), ("ভোলা",)], "n string").select(names.block_keys(F.col("n"))).collect()
    assert sorted(keys[0][0]) == ["la:ple", "la:pma", "la:sna", "la:ssh"] and keys[1][0] == [":"] and keys[2][0][0].startswith("bn:p")
    t = spark.createDataFrame([("abcd", "abcdef"), ("abcdef", "abcdefg"), ("abcdefg", "abcdefgh")], "a string, b string").select(names.threshold(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in t] == [95, 91, 88]


def test_acronyms(spark):
    df = spark.createDataFrame([("NGA",), ("Nordic Grid Authority",), ("Iron Works",), ("IW",), ("Inner Wall",), ("x",)], "name string")
    assert [tuple(r) for r in resolve.acronym_links(df).collect()] == [("NGA", "Nordic Grid Authority")]


def mentions(spark, *spelled):
    rows = [(n, "org" if "Energy" in n else "other", ("d", i, 0)) for i, n in enumerate(spelled)]
    return spark.createDataFrame(rows, "name string, type string, ord struct<doc:string,idx:long,rank:int>")


def test_mixed_resolution(spark):
    names_ = ["Helios", "Helios Energy", "Helios Energy", "Lena Marsh", "Dr. Lena Marsh", "NGA", "Nordic Grid Authority", "José", "Jose", "MacDonald", "McDonald", "Reykjavik-1", "Reykjavik-2", "করিম", "করিমা", " ", None, "International Atomic Agency", "International Atomic Agencyy"]
    got = {r["name"]: r for r in resolve.resolved(mentions(spark, *[n for n in names_ if n])).collect()}
    same = lambda a, b: got[a]["cid"] == got[b]["cid"]
    assert same("Helios", "Helios Energy") and same("Lena Marsh", "Dr. Lena Marsh") and same("NGA", "Nordic Grid Authority") and same("José", "Jose") and same("MacDonald", "McDonald") and same("International Atomic Agency", "International Atomic Agencyy")
    assert not same("Reykjavik-1", "Reykjavik-2") and not same("করিম", "করিমা")
    assert got["Helios"]["cid"] == "e0" and got["Helios"]["label"] == "Helios Energy" and got["Helios"]["count"] == 3 and got["Helios"]["type"] == "org"
    assert " " not in got


@pytest.mark.parametrize("tile", [3, 1000])
def test_blocks_and_tiles_lose_no_link(spark, tile):
    random.seed(5)
    base = ["northern grid authority", "helios energy company", "marine survey office", "blue harbour trust"]
    spelled = {"".join(random.choice("abcdeghinorst ") if random.random() < 0.06 else c for c in random.choice(base)).strip() for _ in range(70)}
    forms = sorted({names.normal_form(s) for s in spelled})
    want = set()
    for i, a in enumerate(forms):
        for b in forms[i + 1 :]:
            share = {t[:2] for t in a.split()} & {t[:2] for t in b.split()} or {t[-2:] for t in a.split()} & {t[-2:] for t in b.split()}
            r, short = names.token_set_ratio(a, b), min(len(a), len(b))
            bar = 95 if short <= 4 else 91 if short <= 6 else 88
            if share and abs(len(a) - len(b)) <= 12 and (r >= bar and not resolve._siblings(a, b) or resolve._embedding(a) @ resolve._embedding(b) >= 0.92 and r >= 60):
                want.add((a, b))
    df = spark.createDataFrame([(f, f) for f in forms], "name string, norm string")
    assert {tuple(sorted(r)) for r in resolve._similar(df, tile).collect()} == want and want


def test_words_that_repeat_are_measured_once(spark):
    df = spark.createDataFrame([(f, f) for f in ("abc abc abc xyz", "abc qrs tuv xyz", "other name")], "name string, norm string")
    assert [tuple(sorted(r)) for r in resolve._similar(df, 1000).collect()] == [("abc abc abc xyz", "abc qrs tuv xyz")]


def test_a_large_block_leaves_few_pairs_to_measure():
    random.seed(7)
    base = sorted({"".join(random.choice("abcdefghiklmnoprstuvwyz") for _ in range(12)) for _ in range(3000)})
    forms = [f"{b} company" for b in base] + [f"{b[:5]}{b[6:]} company" for b in base[::100]]
    held = np.frombuffer(b"".join(resolve._mark(f, f) for f in forms), resolve.MARK)
    m = {f: held[f] for f in resolve.MARK.names}
    size = np.array([len(f) for f in forms])
    order = np.argsort(size, kind="stable")
    a, b = (np.concatenate(x) for x in zip(*resolve._near(m, size, order, order, True)))
    left = resolve._likely(a, b, np.full(len(a), 88), m["length"], resolve._letters(forms), resolve._pair_bits(forms))
    assert {(i * 100, len(base) + i) for i in range(len(base[::100]))} <= {tuple(sorted(x)) for x in zip(a[left].tolist(), b[left].tolist())}
    assert left.sum() < len(forms) ** 2 / 2 / 1000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abéc", min_size=1, max_size=6), min_size=1, max_size=5), st.lists(st.text("abéc", min_size=1, max_size=6), min_size=1, max_size=5))
def test_set_ratio_and_marks(x, y):
    a, b = " ".join(x), " ".join(y)
    ratio = names.token_set_ratio(a, b)
    assert names.set_ratio(frozenset(x), frozenset(y)) == ratio
    m = {f: np.frombuffer(resolve._mark(a, a) + resolve._mark(b, b), resolve.MARK)[f] for f in resolve.MARK.names}
    size, one, two = np.array([len(a), len(b)]), np.array([0]), np.array([1])
    passed = abs(len(a) - len(b)) > names.LENGTH_APART or any(len(r) for r, _ in resolve._near(m, size, one, two, False))
    texts = [resolve._word_set(z) for z in (a, b)]
    for bar in (88, 91, 95):
        assert ratio < bar or passed and resolve._likely(one, two, np.array([bar]), m["length"], resolve._letters(texts), resolve._pair_bits(texts))[0]
    assert resolve._embedding(a) @ resolve._embedding(b) < resolve.COSINE or passed


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (None, 1)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 50, 51, 60]], "id long")
    got = dict(components(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 60: 60}
    assert components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks(spark):
    rows = [(g, i) for g in ("a", "b") for i in range(50)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    assert {(r["g"], r["x"]): r["rank"] for r in rank_within(df, ["g"], [F.col("x").desc()]).collect()} == {(g, x): (50 - x if g != "c" else 1) for g, x in rows}
    assert sorted((r["x"], r["n"]) for r in numbered(df.where("g = 'a'"), "x", "n").collect()) == [(i, i) for i in range(50)]
    assert sorted(tuple(r) for r in top_within(df, ["g"], [F.col("x")], 2).collect()) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("c", 1, 1)]
