"""One form of look-alike text, and mixing to exact shares."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm import p6_lookalikes as p6
from folioweave.llm import p9_mixing as p9


@pytest.mark.parametrize("text, want", [("ｶﾞｽ", "ガス"), ("が", "が"), ("한", "한"), ("آ", "آ"), ("école", "école"), ("Αpple", "Apple"), ("a b", "a b"), ("so­ft", "soft"), ("ﬁne", "fine"), ("привет", "привет"), ("你好，世界。", "你好，世界。"), ("👩‍🔬", "👩‍🔬"), ("", "")])
def test_forms(text, want):
    t = p6.transducer()
    assert t(text) == want and t(want) == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_a_second_pass_changes_nothing_of_single_characters(text):
    t = p6.transducer()
    once = t(text)
    assert t(once) == t(t(once))


def test_shares_blocks_and_repeats():
    blocks = pd.DataFrame([(s, b, 100) for s, n in (("big", 50), ("small", 5)) for b in range(n)], columns=["source", "block", "tokens"])
    targets = pd.DataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("gone", 0.1, 2)], columns=["source", "target_share", "max_repeats"])
    p = p9.plan(blocks, targets, shards=4)
    got = p.copies.groupby("source").size().to_dict()
    assert got["small"] == 15 and p.report.set_index("source")["short"].to_dict() == {"big": False, "gone": True, "small": True}
    assert not p.copies.duplicated(["source", "block", "copy"]).any() and p.copies.groupby(["source", "block"])["copy"].nunique().max() <= 3
    assert (p.copies[p.copies["source"] == "big"].groupby("block").size() == 1).all()


def test_the_tree_divides_exactly():
    counts = np.array([100, 7, 0, 33])
    split = p9.split_tree(counts, 5, np.random.default_rng(1))
    assert (split.sum(axis=0) == counts).all() and split.shape == (5, 4) and split.sum(axis=1).max() - split.sum(axis=1).min() <= 2


def test_p6_found_gathers_no_rows_that_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    words = ["é" + "".join(map(chr, x)) for x in np.random.default_rng(1).integers(0x400, 0x9000, (2000, 4))]
    chunks = [(str(i), f"doc {i % 50}", "ｆｕｌｌ " + " ".join(words[i::200])) for i in range(200)]
    spark.createDataFrame(chunks, "id string, doc string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([], "conv_id long, project string, method string").write.parquet(f"{tmp_path}/conv_results.parquet")
    spark.createDataFrame([], "id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,relation:string,target:string>>").write.parquet(f"{tmp_path}/extractions.parquet")
    gathered = []
    for name in ("collect", "toPandas"):
        whole = getattr(type(spark.range(1)), name)
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, whole=whole: gathered.append(len(out := whole(df))) or out)
    got = p6.QUERIES["p6_found"](spark, str(tmp_path))
    assert gathered and max(gathered) < 200  # ciphers and blocks of the sketch and the sieve
    assert {r["rec_key"] for r in got.collect()} <= {x[0] for x in chunks}
