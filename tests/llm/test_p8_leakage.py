"""Seeds of passages in which words are replaced regularly."""

import pytest

from folioweave.llm.p8_leakage import seeds


@pytest.mark.parametrize("every", range(5, 13))
def test_a_passage_with_every_nth_word_replaced_has_a_seed(every):
    a = [f"w{i}" for i in range(24)]
    for phase in range(every):
        b = ["x" if i % every == phase else w for i, w in enumerate(a)]
        assert (seeds(a) == seeds(b)).any()
