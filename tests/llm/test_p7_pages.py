"""Scanned pages: exact counts at every size, broken and misread words, headers, paragraphs."""

import pytest

from folioweave.llm import p7_pages as p7
from folioweave.operators.lookup import looked_up

LINES = "The northern pump hall was opened again after the long winter repair and\nthe harbour crew checked every valve before the inspection began there"


def repaired(spark, texts):
    rows = spark.createDataFrame([("chunks", str(i), t) for i, t in enumerate(texts)], "rec_table string, rec_key string, text string")
    return {r["rec_key"]: r for r in p7.repaired(rows).collect()}


@pytest.fixture(scope="module")
def found(spark):
    page = "Harbour ledger\n" + LINES + "\n— 12 —"
    texts = [LINES] * 40 + [page] * 8 + [LINES.replace("harbour", "har-\nbour"), LINES.replace("winter", "vvinter"), "", "plain", LINES.replace("inspection", "inspec tion"), "x" * 5000 + " y"]
    return repaired(spark, texts)


def test_clean_texts_and_wrapped_lines_are_left_alone(found):
    assert not {str(i) for i in range(40)} & found.keys() and not {"50", "51", "53"} & found.keys()


def test_page_numbers_go(found):
    assert {str(i) for i in range(40, 48)} <= found.keys()
    assert "12" not in found["40"]["repaired"] and found["40"]["traces"] == "header"


def test_a_line_that_many_texts_repeat_counts_for_a_header(spark):
    rows = spark.createDataFrame([("chunks", str(i), f"Harbour ledger\nbody {i} goes on and on here") for i in range(p7.REPEATS)] + [("chunks", "x", "Lone title\nbody")], "rec_table string, rec_key string, text string")
    assert {r["rec_key"]: r["repeated"] for r in p7.with_repeated(rows).collect()} == {**{str(i): ["harbour ledger"] for i in range(p7.REPEATS)}, "x": None}


def test_words_are_mended(found):
    assert "harbour crew" in found["48"]["repaired"] and "broken" in found["48"]["traces"]
    assert "winter" in found["49"]["repaired"] and found["49"]["traces"] == "misread"
    assert "inspection" in found["52"]["repaired"]


def test_lines_become_paragraphs(found):
    assert "\n" not in found["49"]["repaired"]


def test_no_records(spark):
    assert repaired(spark, []) == {}


def test_a_rare_word_is_judged_by_its_exact_count():
    counts = {"harbour": 400, "winter": 30}
    assert p7.best_correction("harhour", 3, counts) == ("harbour", 400)
    assert p7.best_correction("harhour", 300, counts) is None  # a word of its own
    assert p7.best_correction("xyz", 0, counts) is None


def test_lookups_lose_nothing(spark):
    asked = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(50)] + [(None, 1), ("none", 2)], "w string, i int")
    counts = spark.createDataFrame([("hot", 7), ("hot", 8)] + [(f"k{i}", i) for i in range(50)], "w string, n int")
    assert looked_up(asked, counts, "w").count() == 900 * 2 + 50


def test_rows_do_not_depend_on_which_words_are_broadcast(spark, monkeypatch):
    texts = [LINES] * 40 + ["the harbour was calm today " * 32] * 80
    texts += ["the foot of the path was wet"] * 60 + ["a footpath led there"] * 8 + ["they took the foot-\npath again"]  # a rare whole of frequent pieces
    texts += ["the boathouse was shut"] * 8 + ["the b0athouse was shut"]  # a strange token's repair may be rare
    texts += ["the harhour was shut"] * 6  # misread as often as rare words occur
    got = []
    for rate in (1e-9, 15 / 15000, 40 / 15000):
        monkeypatch.setattr(p7, "RATE", rate)
        rows = spark.createDataFrame([("chunks", str(i), t) for i, t in enumerate(texts)], "rec_table string, rec_key string, text string")
        floor = p7.frequent(p7.word_counts(rows))[1]
        got.append((floor, {r["rec_key"]: (r["repaired"], r["traces"]) for r in p7.repaired(rows).collect()}))
    (small, first), (middle, second), (large, third) = got
    assert small == p7.KNOWN < 8 < middle < p7.EVIDENCE < large < 60
    assert first == second == third
    assert {x for x, _ in first.values()} == {"they took the footpath again", "the boathouse was shut", "the harbour was shut"}
