"""Merge and rematch of spellings."""

import __spark_entry__
from folioweave.llm.p3_names import look, organisation, person, resolved


def profiles(kind, *names):
    read = {n: kind + (person if kind == "p" else organisation)(n) for n in names}
    return {frozenset(n for n, f in read.items() if f in p) for p in resolved(sorted(set(read.values())))}


def test_it_is_registered():
    assert "p3_found" in __spark_entry__.queries()


def test_spellings_of_a_person():
    names = "Anthony Thotpiju", "Tony Tohtpiju", "Thotpiju, A.", "Thotpiju A.", "Ms Thotpiju, Tony", "A.B. Thotpiju", "ANTHONY THOTPIJU", "Anthony Thotpiju, PhD", "A Thotpiju"
    assert profiles("p", *names, "Rahima Thotpiju") == {frozenset(names), frozenset(["Rahima Thotpiju"])}


def test_an_initial_that_fits_two_persons_links_neither():
    assert len(profiles("p", "Anthony Thotpiju", "Anirban Thotpiju", "A. Thotpiju")) == 3


def test_spellings_of_an_organisation():
    names = "Xanto Rail & Ferry Bureau", "Xanto Rail/Ferry Bureau", "The Xanto Rail and Ferry Bureau Inc.", "Rail and Ferry Bureau of Xanto", "XRFB", "Xanto R. Ferry Bureau", "Xanto Rail Ferry Bureu", "XantoRail Ferry Bureau", "Xanto Rail Ferry"
    assert profiles("o", *names, "Xanto Water Trust") == {frozenset(names), frozenset(["Xanto Water Trust"])}


def test_a_shortened_form_that_fits_two_organisations_links_neither():
    assert len(profiles("o", "Brimfijo Grid Corporation", "Brimfijo Grid Department", "Brimfijo Grid")) == 3


def test_order_width_and_capitals_of_an_organisation():
    assert organisation("Laboratory Tunflarebo Water") == organisation("Tunflarebo Water Laboratory")
    assert organisation("GLÖLSESIHI GRID COMPANY") == organisation("Glölsesihi Grid Company")
    assert len(profiles("o", "Thamtehu Water Co-op", "Thamtehu Water Cooperative")) == 1


def test_a_lone_look_alike_is_an_initial():
    assert person(look("\u0420. Pabrejisi")) == "p.|pabrejisi"
