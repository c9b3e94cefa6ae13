"""Sentence boundaries: marks that are never closed, far closers, and signs that only look like digits."""

import signal

import pytest

from folioweave.llm.p5_sentences import Knowledge, Splitter


def split(text):
    return [text[a:b] for a, b in Splitter(Knowledge({}))(text)]


@pytest.fixture(autouse=True)
def ends():
    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError))
    signal.alarm(10)
    yield
    signal.alarm(0)


@pytest.mark.parametrize("mark", ["(", "（", "“", "„", "«", "「", "『", "‘"])
def test_an_opener_that_is_never_closed_is_an_ordinary_character(mark):
    assert split(f"The {mark}pump ran. The valve broke.") == [f"The {mark}pump ran.", "The valve broke."]


@pytest.mark.parametrize("a, z", ["()", "（）", "(）", "“”", "„“", "«»"])
def test_a_closer_is_found_however_far_it_is(a, z):
    inner = "the pump ran. Nobody saw it. " * 60
    text = f"The log {a}{inner}{z} was kept. The valve broke."
    assert split(text) == [text[: text.index(" The valve")], "The valve broke."]


def test_a_superscript_digit_before_a_stop():
    assert split("The hall has 40 m². The valve broke.") == ["The hall has 40 m².", "The valve broke."]


def test_words_asked_for_are_all_that_is_consulted():
    from folioweave.llm import p5_sentences as p5

    asked = set()

    class Recorder(Knowledge):
        def __call__(self, kind, word):
            asked.add(word)
            return super().__call__(kind, word)

    for text in ("Dr. Lena met Mr. A. Smith at 5 p.m. Today. (See Fig. 3.) “He left.” Then… He came?! Yes.", "损失。J. Smith说。Dr. Ann came."):
        asked.clear()
        p5.Splitter(Recorder({}))(text)
        assert {w for w in asked if w} <= p5.words_asked(text)


def test_an_abbreviation_is_told_by_what_follows_it():
    counts = {("dot", "Dr"): 900, ("bare", "Dr"): 5, ("cap", "Dr"): 880, ("names", "Dr"): 800, ("starts", "Dr"): 20, ("dot", "hand"): 900, ("bare", "hand"): 5, ("cap", "hand"): 880, ("names", "hand"): 20, ("starts", "hand"): 800}
    s = Splitter(Knowledge(counts))
    assert s._abbreviation("Dr", Knowledge({})) and not s._abbreviation("hand", Knowledge({}))
