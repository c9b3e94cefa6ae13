"""Every query on tables that are empty, and on tables with nulls everywhere, repeats, long texts and clashing extra columns."""

import pytest

from folioweave.llm import catalog

SCHEMAS = {
    "chunks": "id string, project string, doc string, heading_path string, text string, idx long, digested_at timestamp, loaded_at timestamp, n long, term string, word string, path string, source string",
    "extractions": "id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,relation:string,target:string>>, facts array<string>, loaded_at timestamp, field string, text string",
    "conv_results": "conv_id long, project string, source string, output string, status string, method string, error string, chars long, converted_at timestamp, loaded_at timestamp, text string",
    "sent_sample": "id string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, site string, fetched_at timestamp, loaded_at timestamp, tokens long, page double, label double",
    "benchmark": "item_id long, suite string, lang string, text string, pos int",
    "mix_targets": "source string, target_share double, max_repeats int, tokens long",
}
LONG = "The pump of the northern hall was repaired by the crew before noon. " * 3000
TEXT = "<p>Dr. Lena Mårsh met **Tony** at 5 p.m. Then \\textbf{all} left!</p>\nharbour led-\nger"
BENCH = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = {
    "chunks": [(i, "p", d, h, t, 0, None, None, 1, "t", "w", "x", "s") for i, d, h, t in [("a", "d", "A > **B**", TEXT), ("a", "d", "A > **B**", TEXT), ("b", "d", None, None), ("c", None, "", ""), (None, "d", "x", "text"), ("l", "d", "h", LONG), ("m", "d", "h", "Ã©cole Ð¿ÑÐ¸Ð²ÐµÑ � ｆｕｌｌ é"), ("x", None, None, "x" * 30000)]],
    "extractions": [("a", [("Lena Marsh", "person"), (None, None), None], [("L. Marsh", "r", None), None], ["Lena Marsh met Lena Marsh.", None], None, "f", "t"), ("a", [("Lena Marsh", "person"), (None, None), None], [("L. Marsh", "r", None), None], ["Lena Marsh met Lena Marsh.", None], None, "f", "t"), ("b", None, None, None, None, None, None), (None, [("N", "org")], [], [], None, None, None), ("c", [("", ""), ("   ", "org"), ("Ｌｅｎａ Marsh", "person")], [], [""], None, None, None)],
    "conv_results": [(1, "p", "s", None, "ok", "pdf · Ã©tÃ©", None, None, None, None, "t"), (1, "p", "s", None, "ok", "pdf · Ã©tÃ©", None, None, None, None, "t"), (None, None, None, None, None, None, None, None, None, None, None), (2, None, None, None, None, "", None, None, None, None, None)],
    "sent_sample": [("a", "t"), ("a", "t"), (None, None), ("none", ""), ("b", ""), ("l", ""), ("x", "")],
    "documents": [(1, BENCH + " more", "en", "s1", 5, "h", None, None, 1, 0.5, 1.0), (1, BENCH + " more", "en", "s1", 5, "h", None, None, 1, 0.5, 1.0), (2, None, None, None, None, None, None, None, None, None, None), (3, "", None, "s1", None, "h", None, None, None, None, None), (None, BENCH, None, "s2", None, None, None, None, None, None, None), (4, LONG, "en", "s2", 9, None, None, None, None, None, None), (5, "buy | cheap | buy | cheap | " * 40, "en", "s2", 9, "h", None, None, None, None, None)],
    "benchmark": [(1, "s", "en", BENCH, 0), (1, "s", "en", BENCH, 0), (2, None, None, None, None), (None, None, None, BENCH, None), (3, "s", "en", "too short", 1)],
    "mix_targets": [("s1", 0.5, 2, 0), ("s2", 0.4, 1, 0), ("gone", 0.1, 3, 0), (None, None, None, None)],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "dirty"):
        out[kind] = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(ROWS[name] if kind == "dirty" else [], schema).coalesce(2).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, folders, name):
    assert catalog.queries()[name](spark, str(folders["empty"])).collect() == []


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_dirty_tables(spark, folders, name):
    rows = catalog.queries()[name](spark, str(folders["dirty"])).collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows}) and all(x is not None for r in rows for x in r)
    if name == "p8_found":
        assert [tuple(r) for r in rows] == [(1, 1)]
    if name == "p1_found":
        assert ("a", "text") in {tuple(r) for r in rows} and ("a", "heading_path") in {tuple(r) for r in rows}
    if name == "p5_found":
        assert {r["id"] for r in rows} == {"a", "l", "x"} and sum(r["id"] == "l" for r in rows) == 3000
    if name == "p6_found":
        assert ("extractions", "c") in {tuple(r) for r in rows}
