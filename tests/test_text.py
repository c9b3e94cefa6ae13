"""Text expressions on literals."""

import re

import pytest
from pyspark.sql import functions as F

from folioweave.functions import bengali, text


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_sentences(spark):
    got = one(spark, "  He met Dr. Lena Marsh. It rained! ভোলা যাই। ঢাকা। 你好。再见。 end. lower", text.sentences(F.col("t")), text.sentences_abbreviated(F.col("t")))
    assert got[0] == ["He met Dr.", "Lena Marsh.", "It rained! ভোলা যাই।", "ঢাকা।", "你好。", "再见。", "end. lower"]
    assert got[1][0] == "He met Dr. Lena Marsh."


def test_control_tokens_do_not_form_again(spark):
    got = one(spark, "a <tool_<tool_call>call>b <|im_start|> c  <｜x｜>d </ THINK > <<< data >>>", text.scrubbed(F.col("t")), text.defanged(F.col("t")))
    assert got[0] == "a b c d <<< data >>>" and got[1].endswith("[delim]")


@pytest.mark.parametrize("line, want", [("a|b|c|d", True), ("call 123456", True), ("Male | No | Rural", True), ("one | two words of it here now | x", False), ("plain", False), ("কল ১২৩৪৫৬", True)])
def test_tabular(spark, line, want):
    assert one(spark, line, text.tabular(F.col("t")))[0] == want


@pytest.mark.parametrize("doc, want", [("word " * 50, True), (" ".join(f"w{i}" for i in range(50)), False), (" ".join(f"{i},5" for i in range(60)), True), ("x", False), (None, False), (" ".join(f"w{i}" for i in range(45)) + " <rdf:x", True)])
def test_low_value(spark, doc, want):
    assert one(spark, doc, text.low_value(F.col("t")))[0] == want


@pytest.mark.parametrize("value", ["", "abc", "é" * 9, "ভোলা জেলা", "a😀b😀", None])
@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4, 5, 7, 100])
def test_clip_splits_no_character(spark, value, limit):
    want = (value or "").encode()[:limit].decode("utf-8", "ignore")
    assert one(spark, value, text.clipped(F.col("t"), limit))[0] == want


def test_names_of_files(spark):
    got = [one(spark, p, text.extension(F.col("t")), text.skip_category(F.col("t")), text.basename(F.col("t"))) for p in ("a/b/photo.JPG", "x.ttf", "d/x.gsheet", ".DS_Store", "notes.txt", "noext")]
    assert [g[0] for g in got] == ["jpg", "ttf", "gsheet", "", "txt", ""]
    assert [g[1] for g in got] == ["media", "font", "gdrive-pointer", "junk", None, None]


@pytest.mark.parametrize("name, want", [("My Project!", "my-project"), ("--.x.--", "x"), ("", "default"), (None, "default"), ("a" * 200, "a" * 120)])
def test_slug(spark, name, want):
    assert one(spark, name, text.slug(F.col("t")))[0] == want


def test_provenance_line(spark):
    line = "<!-- source: report.pdf · method: text-passthrough+bn-unicode -->"
    got = one(spark, line, text.source_of(F.col("t"), F.lit("x.md")), text.method_of(F.col("t")))
    assert tuple(got) == ("report.pdf", "text-passthrough+bn-unicode")
    assert tuple(one(spark, "plain", text.source_of(F.col("t"), F.lit("x.md")), text.method_of(F.col("t")))) == ("x", "")


def test_html(spark):
    page = "<html><head><title>t</title></head><body><!-- c --><h2>Title</h2><p>A &amp; B<br>next</p><ul><li>one<li>two</ul><script>x()</script></body></html>"
    assert one(spark, page, text.html_text(F.col("t")))[0] == "## Title\n\nA & B\nnext\n\n- one\n- two"


def test_broken_bengali(spark):
    clean, broken = "কাজ শেষ সবাই ফিরে যান পাম্প ঘর বন্ধ ছিল " * 4, "িক াজ েশ ষ সব াই িফ ের য ান প ামপ ঘর বন ধ িছ ল " * 4
    assert [one(spark, t, text.broken_bengali(F.col("t")))[0] for t in (clean, broken, "ক")] == [False, True, False]


TABLE = bengali.Table({"Av": "আ", "A": "অ", "K": "ক", "w": "ি", "‡": "ে", "v": "া", "i": "র", "©": "্", "g": "ম", "e": "ব", "b": "ন"}, before=[("vv", "v")], after=[("  ", " ")])


def test_legacy_bengali_order_of_signs():
    c = bengali.Converter(TABLE)
    assert c("Av") == "আ" and c("wK") == "কি" and c("‡Kv") == "কো" and c("Kvvg") == "কাম"
    assert c("Kgi©") == "কর্ম"  # ra with halant goes before the consonant it was typed after
    assert c("K©©g") == c("K©g")


def test_legacy_bengali_only_where_dense(spark):
    rows = spark.createDataFrame([(1, "plain English text with one é in it"), (2, "wK‡Kv ÷øæØÞþðñòóô ÷øæØÞþðñòóô"), (3, None), (4, "")], "id int, text string")
    got = {r["id"]: r for r in bengali.converted(rows, "text", TABLE).collect()}
    assert not got[1]["legacy"] and got[2]["legacy"] and got[2]["text"].startswith("কি") and got[3]["text"] is None and len(got) == 4
    mixed = "A plain line and the next\n" + "wK‡Kv ÷øæØÞþðñ òóô"
    line = bengali.converted(spark.createDataFrame([(1, mixed)], "id int, text string"), "text", TABLE, mixed=True).first()["text"].split("\n")
    assert line[0] == "A plain line and the next" and re.search("কি", line[1])
